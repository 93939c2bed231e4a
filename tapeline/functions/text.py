"""Small string functions: paths, trailing context, JSON in replies, escapes, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .punctuation import strip


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its extension; a leading dot doesn't start one."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def leading_id(name: Column) -> Column:
    return F.lower(F.substring_index(name, "_", 1))


def context_tail(text: Column, limit: int = 100) -> Column:
    """The end of a text, at most `limit` characters, from the first sentence or word boundary in them; null if blank."""
    bare = strip(text)
    window = F.right(bare, F.lit(limit))
    ends = F.array(*(F.when(F.instr(window, d) > 0, F.instr(window, d) + 1) for d in (". ", "? ", "! ")))
    sentence, word = F.array_min(ends), F.when(F.instr(window, " ") > 0, F.instr(window, " "))
    cut = F.coalesce(sentence, word)
    from_cut = strip(F.substring(window, cut + 1, F.lit(limit)))
    return F.when(bare == "", None).when(F.char_length(bare) <= limit, bare).when(cut.isNull(), window).otherwise(F.nullif(from_cut, F.lit("")))


def json_object(reply: Column) -> Column:
    """The JSON object in a reply as a string: the whole, or from the first brace to the last; null if neither parses."""
    whole = strip(reply)
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(F.try_parse_json(whole).isNotNull(), whole), F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """top / bottom, and `empty` where bottom is zero."""
    return F.when(bottom == 0, F.lit(empty).cast("double")).otherwise(top.cast("double") / F.nullif(bottom, F.lit(0)).cast("double"))


def milliseconds(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")
