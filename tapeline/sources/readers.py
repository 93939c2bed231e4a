"""Readers of tag logs, transcripts, subtitle files, excerpt specifications and media lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.subtitles import flat_text, looks_like_cues
from ..functions.text import basename, stem
from ..schema import EXCERPT_FILE, TAG_MESSAGE


#: One split of a scan, by default.
SPLIT_BYTES = 128 << 20


def spread(table: DataFrame) -> DataFrame:
    """A stored table of one file below one split is read by one task however many cores there are: its rows are dealt over them.

    Larger tables stay as they are.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SPLIT_BYTES or len(table.inputFiles()) != 1:
        return table
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism)


def read_tags(spark: SparkSession, path: str, track: str, by_basename: bool = False) -> DataFrame:
    """Tags of one track from JSON lines, with `seq` for stable order of equal starts. Blank and other lines are skipped.

    Media are keyed by their full path, so files of one name in two folders stay apart; by_basename joins them.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    # Lines of a split are in order, splits by file and place.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    numbered = lines.select(F.from_json("value", TAG_MESSAGE).alias("m"), place.alias("seq"))
    kept = numbered.where((F.col("m.type") == "tag") & (F.coalesce("m.data.track", F.lit("")) == track))
    found = kept.select("m.data.*", "seq")
    return found.withColumn("source_media", basename(F.col("source_media"))) if by_basename else found


def hypothesis_texts(tags: DataFrame) -> DataFrame:
    """name and hyp: the tags of each medium joined in order of start."""
    ordered = F.sort_array(F.collect_list(F.struct("start_time", "seq", "tag")))
    return tags.groupBy(F.col("source_media").alias("name")).agg(F.array_join(F.transform(ordered, lambda x: x["tag"]), " ").alias("hyp"))


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path, name, key (stem) and body of whole files; a byte order mark goes."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return files.select(where.alias("path"), basename(where).alias("name"), stem(where).alias("key"), F.regexp_replace("value", "^﻿", "").alias("body"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """key and ref from a folder of texts (subtitle files are told by their first 8000 characters) or a JSON map."""
    if path.endswith(".json"):
        body = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
        return body.select(F.explode("m").alias("key", "ref")).withColumn("key", stem(F.col("key")))
    found = read_texts(spark, path)
    return found.select("key", F.trim(F.when(looks_like_cues(F.col("body")), flat_text(F.col("body"))).otherwise(F.col("body")), F.lit(" \t\n\r\x0b\x0c")).alias("ref"))


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """model, id, hyp: one folder for each model."""
    found = read_texts(spark, path)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("model"), F.col("key").alias("id"), F.col("body").alias("hyp"))


def read_excerpts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXCERPT_FILE).json(path, multiLine=True).select(F.explode("excerpts").alias("e")).select("e.*")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXCERPT_FILE).json(path, multiLine=True).select(F.explode("meta.categories").alias("category", "description"))


def list_media(spark: SparkSession, path: str, glob: str = "*.mp4") -> DataFrame:
    """path and length of media files; their bytes aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")


def has_audio(probe: Column) -> Column:
    """Whether a probe of audio streams lists any; output that isn't JSON counts as yes, so that no file is lost."""
    streams = F.get_json_object(probe, "$.streams")
    listed = F.coalesce(F.size(F.from_json(streams, "array<string>")), F.lit(0)) > 0
    return F.when(F.try_parse_json(probe).isNull(), True).otherwise(streams.isNotNull() & listed)


def with_audio(media: DataFrame, probes: DataFrame) -> DataFrame:
    """media (path, ...) without those whose probe (path, probe) lists no audio stream; unprobed ones stay."""
    silent = probes.where(~has_audio(F.col("probe"))).select("path").distinct()
    return media.join(silent, "path", "left_anti")


def duration(probe: Column) -> Column:
    return F.get_json_object(probe, "$.format.duration").try_cast("double")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Score rows of a results document."""
    return spark.read.json(path, multiLine=True).select(F.explode("per_excerpt").alias("e")).select("e.*")
