"""Totals, deltas between systems, pivots and text reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_pipes, ratio


def speed_totals(files: DataFrame, keys: list[str]) -> DataFrame:
    """Audio and wall seconds (each file's rounded to two places first), their ratio, peaks and file counts."""
    return files.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum(F.round("audio_s", 2)).alias("audio_s"), F.sum(F.round("wall_s", 2)).alias("wall_s"),
        F.max("gpu_mib").alias("peak_gpu_mib"), F.max("rss_mib").alias("peak_rss_mib"),
    ).withColumn("rtf", ratio(F.col("audio_s"), F.col("wall_s")))


def words_per_file(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("track") == "").groupBy("source_media").agg(F.count("*").alias("n"))


def captions_per_track(tags: DataFrame) -> DataFrame:
    return tags.groupBy("track").agg(F.count("*").alias("n"))


def duration_totals(spans: DataFrame, key: str) -> DataFrame:
    """Count and duration by key and in all (null key)."""
    return spans.rollup(key).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("duration"))


def system_deltas(scores: DataFrame, base: str, value: str = "wer") -> DataFrame:
    """Each system's value less that of the base system, by track."""
    first = scores.where(F.col("system") == base).select("track", F.col(value).alias("_base"))
    return scores.where(F.col("system") != base).join(first, "track").withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def by_model(scores: DataFrame, models: list[str], value: str = "wer") -> DataFrame:
    """One row for each excerpt, one column for each model: the chart's data."""
    return scores.groupBy("excerpt").pivot("model", models).agg(F.first(value))


def checkpoints(start: Column, end: Column, step: int = 30) -> Column:
    """Windows of `step` seconds from the start of a span, the last one clipped."""
    return F.transform(F.sequence(start, F.greatest(start, end - 1), F.lit(step)), lambda s: F.struct(s.alias("start"), F.least(s + step, end).alias("end")))


def _cells(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(escape_pipes(F.col(c).cast("string")) for c in columns)), F.lit(" |"))


def _table_head(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)


def markdown(rows: DataFrame, key: str, columns: list[str], order: list[str], title: str) -> DataFrame:
    """One document (column body) of small tables: a section with a table for each key, lines put together in order."""
    lines = rows.select(key, F.struct(*order, _cells(columns).alias("line")).alias("o"))
    sections = lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("o")), lambda x: x["line"]), "\n").alias("table"))
    text = sections.select(F.struct(key, F.concat(F.lit("\n## "), F.col(key).cast("string"), F.lit(f"\n\n{_table_head(columns)}\n"), F.col("table")).alias("s")).alias("o"))
    return text.agg(F.concat(F.lit(f"# {title}\n"), F.array_join(F.transform(F.sort_array(F.collect_list("o")), lambda x: x["s"]), "\n")).alias("body"))


def markdown_lines(rows: DataFrame, key: str, columns: list[str], order: list[str], title: str) -> DataFrame:
    """The same document as rows (column value) in order, of any size: written as text, its files follow one another."""
    keys = F.col(key).cast("string")
    body = rows.select(keys.alias("section"), F.lit(1).alias("part"), F.struct(*order).alias("o"), _cells(columns).alias("value"))
    none = F.lit(None).cast(body.schema["o"].dataType).alias("o")
    heads = rows.select(keys.alias("section")).distinct().select("section", F.lit(0).alias("part"), none, F.concat(F.lit("\n## "), "section", F.lit(f"\n\n{_table_head(columns)}")).alias("value"))
    top = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("section"), F.lit(-1).alias("part"), none, F.lit(f"# {title}").alias("value"))
    return top.unionByName(heads).unionByName(body).orderBy(F.col("section").asc_nulls_first(), "part", "o").select("value")


def console(rows: DataFrame, columns: dict[str, str], order: list[str] | None = None, headings: dict[str, str] | None = None, missing: str = "-") -> DataFrame:
    """Lines of a table by printf formats, {column: format}. With headings, a line of them and a rule come first; nulls show as `missing`."""
    width = {c: re.match(r"%(-?\d*)", f)[1] for c, f in columns.items()}
    blank = lambda c: F.format_string(f"%{width[c]}s", F.lit(missing))
    cell = lambda c, f: F.when(F.col(c).isNull(), blank(c)).otherwise(F.format_string(f, c))
    keys = F.struct(*(order or list(columns)))
    lines = rows.select(F.lit(1).alias("part"), keys.alias("o"), F.concat_ws(" ", *(cell(c, f) for c, f in columns.items())).alias("line"))
    if headings is not None:
        head = " ".join(f"%{width[c]}s" % headings.get(c, c) for c in columns)
        first = rows.sparkSession.createDataFrame([(-1, head), (0, "-" * len(head))], "part int, line string")
        lines = first.select("part", F.lit(None).cast(lines.schema["o"].dataType).alias("o"), "line").unionByName(lines)
    return lines.orderBy("part", "o").select("line")


def merged_summary(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries replace old ones of the same key; all others stay."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns))
