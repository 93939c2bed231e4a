"""Writers of tag logs, score tables, documents and text files by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_json(row: Column) -> Column:
    """A tag as JSON: absent information keys stay absent, vector and frame_info are explicit nulls.

    row: a struct of the tag's columns.
    """
    info = F.coalesce(F.to_json(row["additional_info"]), F.lit("{}"))
    plain = F.to_json(F.struct(row["start_time"].alias("start_time"), row["end_time"].alias("end_time"), row["tag"].alias("tag"), row["vector"].alias("vector"), row["source_media"].alias("source_media"), row["track"].alias("track")), {"ignoreNullFields": "false"})
    frame = F.coalesce(F.to_json(F.struct(row["frame_info"].alias("frame_info"))), F.lit("{}"))
    tail = F.when(row["frame_info"].isNull(), F.lit('"frame_info":null')).otherwise(F.substring(frame, F.lit(2), F.char_length(frame) - 2))
    return F.concat(F.lit('{"type":"tag","data":'), F.substring(plain, F.lit(1), F.char_length(plain) - 1), F.lit(',"additional_info":'), info, F.lit(","), tail, F.lit("}}"))


def tag_lines(tags: DataFrame) -> DataFrame:
    return tags.select(tag_json(F.struct(*tags.columns)).alias("value"))


def write_tags(tags: DataFrame, path: str) -> None:
    tag_lines(tags).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header, for small score tables; nulls are empty."""
    rows.coalesce(1).write.option("emptyValue", "").csv(path, header=True)


def document(parts: dict[str, DataFrame], order: dict[str, list[str]]) -> DataFrame:
    """A JSON document (column body) with one array for each small table."""
    out = None
    for name, rows in parts.items():
        keys = order[name]
        sorted_rows = F.sort_array(F.collect_list(F.struct(F.struct(*keys).alias("_k"), F.struct(*rows.columns).alias("_r"))))
        one = rows.agg(F.transform(sorted_rows, lambda x: x["_r"]).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("body"))


def write_text_by_key(rows: DataFrame, key: str, path: str) -> None:
    """The column `text` in one folder for each key."""
    rows.select(key, "text").repartition(key).write.partitionBy(key).text(path)
