"""Subtitle files as columns: flat text, cues, time codes and line cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .punctuation import strip

# Patterns of timing lines, mark-up and credit lines.
TIMING = r"\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}\s*-->"
INDEX = r"^\s*\d+\s*$"
MARKUP = (
    r"<[^>]*>",
    r"\{[^}]*\}",
    r"\[[^\]]*\]",
    r"\([^)]*\)",
    "[♪♫♩♬]",
    "(?m)^\\s*[-–—]\\s*",
    r"(?m)^\s*[A-Z][A-Za-z0-9.'-]{0,15}(?: [A-Z][A-Za-z0-9.'-]{0,15})?\s*:",
)
CREDIT = r"(?i)(subtitle|www\.|http|\.me|\.com|opensubtitles|movieddl|downloaded from|api\.|encoded by|sync(ed)? by|corrected by)"
SNIFFED = 8000


def looks_like_cues(body: Column) -> Column:
    head = F.substring(body, 1, SNIFFED)
    return head.rlike(TIMING) | F.contains(head, F.lit(" --> "))


def strip_markup(text: Column) -> Column:
    for pattern in MARKUP:
        text = F.regexp_replace(text, pattern, " ")
    return text


def flat_text(body: Column) -> Column:
    """Spoken words of a subtitle file. An index line goes only where a timing line follows it."""
    unix = F.regexp_replace(F.translate(body, "﻿", ""), "\r\n?", "\n")
    blocks = F.split(unix, r"\n\s*\n")

    def spoken(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")
        opens = (F.size(lines) > 1) & F.get(lines, 0).rlike(INDEX) & F.get(lines, 1).rlike(TIMING)
        return F.when(opens, F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1)))).otherwise(F.filter(lines, lambda x: ~x.rlike(TIMING)))

    joined = F.array_join(F.flatten(F.transform(blocks, spoken)), "\n")
    return F.array_join(F.filter(F.split(strip_markup(joined), r"(?U)\s+"), lambda w: w != ""), " ")


def seconds(code: Column) -> Column:
    """Seconds of HH:MM:SS with , or . and three digits, else of H:M:S; null where it is neither."""
    exact = r"(\d\d):(\d\d):(\d\d)[,.](\d\d\d)"
    part = lambda i: F.regexp_extract(code, exact, i).cast("double")
    pieces = F.split(code, ":")
    loose = F.get(pieces, 0).try_cast("double") * 3600 + F.get(pieces, 1).try_cast("double") * 60 + F.get(pieces, 2).try_cast("double")
    return F.when(code.rlike(exact), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000).when(F.size(pieces) == 3, loose)


def clock(total: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = total.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def clean_line(line: Column) -> Column:
    bare = F.replace(F.regexp_replace(line, r"<[^>]+>|\{[^}]*\}", ""), F.lit("\\h"), F.lit(" "))
    return strip(F.regexp_replace(bare, "^\\s*[-–—]\\s*", ""))


def is_credit(line: Column) -> Column:
    return line.rlike(CREDIT)


def cues(files: DataFrame, body: str = "body") -> DataFrame:
    """One row for each cue of each file: cue, cue_start, cue_end, lines. Blocks without times are skipped."""
    blocks = files.select("*", F.posexplode(F.split(F.trim(F.col(body)), r"\r?\n\r?\n")).alias("cue", "_block")).drop(body)
    lines = blocks.withColumn("_lines", F.split("_block", r"\r?\n"))
    at = F.array_position(F.transform("_lines", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    timed = lines.withColumn("_at", at).where(F.col("_at") > 0)
    sides = F.split(F.get("_lines", F.col("_at") - 1), "-->")
    out = timed.withColumns({"cue_start": seconds(strip(F.get(sides, 0))), "cue_end": seconds(strip(F.get(sides, 1))), "lines": F.slice("_lines", F.greatest(F.col("_at"), F.lit(0)) + 1, F.greatest(F.size("_lines") - F.col("_at"), F.lit(0)))})
    return out.where(F.col("cue_start").isNotNull() & F.col("cue_end").isNotNull()).drop("_block", "_lines", "_at")


def spoken_lines(found: DataFrame) -> DataFrame:
    """Cleaned lines of cues without blank and credit lines: line number and text."""
    lines = found.select("*", F.posexplode("lines").alias("line", "_raw")).drop("lines").withColumn("text", clean_line(F.col("_raw"))).drop("_raw")
    return lines.where((F.col("text") != "") & ~is_credit(F.col("text")))
