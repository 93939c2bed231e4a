"""Sentences from timed words, and the tags made of both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.punctuation import ends_sentence, strip
from ..functions.text import milliseconds

SENTENCE = "file string, sentence long, start double, end double, text string, min_word_probability double, mean_word_probability double"


def words_of(segments: DataFrame) -> DataFrame:
    """One row for each word, numbered through its file."""
    flat = segments.select("file", "seg", F.posexplode("words").alias("_i", "_w")).select("file", "seg", "_i", "_w.*")
    return flat.withColumn("pos", F.row_number().over(W.partitionBy("file").orderBy("seg", "_i")).cast("long") - 1).drop("_i")


def sentence_ids(words: DataFrame, max_gap: float = 5.0) -> DataFrame:
    """words with `group`: a new one behind every sentence end; the last, if it has no end, also splits at long gaps."""
    by = W.partitionBy("file").orderBy("pos")
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = words.withColumn("_end", ends_sentence(F.col("word")))
    marked = marked.withColumn("_sid", F.sum(F.coalesce(F.lag(F.col("_end").cast("int")).over(by), F.lit(0))).over(so_far))
    whole = W.partitionBy("file")
    marked = marked.withColumns({"_last": F.max("_sid").over(whole), "_closed": F.max_by("_end", "pos").over(whole)})
    gap = F.col("start") - F.lag("end").over(by) > max_gap
    # The first word of the open run begins a group already.
    split = (F.col("_sid") == F.col("_last")) & ~F.col("_closed") & (F.lag("_sid").over(by) == F.col("_sid")) & gap
    marked = marked.withColumn("_split", F.coalesce(split, F.lit(False)).cast("int"))
    return marked.withColumn("group", F.col("_sid") + F.sum("_split").over(so_far)).drop("_end", "_sid", "_last", "_closed", "_split")


def widest_gap_cuts(starts: list[float], ends: list[float], max_words: int) -> list[int]:
    """Where to cut a run so that no piece is longer than max_words: always at the widest inner gap, the first of ties.

    One pass makes a tree with the widest gap of every stretch above the others in it; the cuts are its top. So the time
    grows with the run, also where each cut takes off one word.
    """
    n, most = len(starts), max(max_words, 1)
    if n <= most:
        return []
    gaps = [start - end for start, end in zip(starts[1:], ends)]
    left, right, path = [-1] * n, [-1] * n, []
    for i in range(1, n):
        last = -1
        while path and gaps[path[-1] - 1] < gaps[i - 1]:
            last = path.pop()
        left[i] = last
        if path:
            right[path[-1]] = i
        path.append(i)
    cuts, open_runs = [], [(0, n, path[0])]
    while open_runs:
        a, b, at = open_runs.pop()
        if b - a > most:
            cuts.append(at)
            open_runs += [(a, at, left[at]), (at, b, right[at])]
    return sorted(cuts)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pieces(starts: pd.Series, ends: pd.Series, most: pd.Series) -> pd.Series:
    def one(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
        first = np.zeros(len(a), dtype=np.int32)
        first[widest_gap_cuts(a.tolist(), b.tolist(), m)] = 1
        return np.cumsum(first, dtype=np.int32)

    return pd.Series([one(*x) for x in zip(starts, ends, most, strict=True)], dtype=object)


def bounded(words: DataFrame, max_words: int = 150) -> DataFrame:
    """words with `piece` inside their group. Only the times of groups that are too long leave the JVM, many groups in a call."""
    rest = [c for c in words.columns if c not in ("file", "group")]
    runs = words.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("pos", *(c for c in rest if c != "pos")))).alias("_w"))
    too_long = F.size("_w") > max_words
    times = lambda c: F.when(too_long, F.col(f"_w.{c}").cast("array<double>")).otherwise(F.array().cast("array<double>"))
    placed = runs.withColumn("_p", _pieces(times("start"), times("end"), F.lit(max_words))).select("file", "group", "_p", F.posexplode("_w").alias("_i", "_x"))
    piece = F.coalesce(F.get("_p", F.col("_i")), F.lit(0)).alias("piece")
    return placed.select(*(F.col(c) if c in ("file", "group") else F.col(f"_x.{c}").alias(c) for c in words.columns), piece)


def to_sentences(segments: DataFrame, max_gap: float = 5.0, max_words: int = 150) -> DataFrame:
    """Captions of each file in order, with confidences of their words. Files without word times keep their segments."""
    words = bounded(sentence_ids(words_of(segments), max_gap), max_words)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "word")))
    made = words.groupBy("file", "group", "piece").agg(
        F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), strip(F.array_join(F.transform(ordered, lambda x: x["word"]), "")).alias("text"),
        F.round(F.min("probability"), 4).alias("min_word_probability"), F.round(F.avg("probability"), 4).alias("mean_word_probability"),
    )
    made = made.where(F.col("text") != "").select("file", F.struct("group", "piece").alias("_o"), "start", "end", "text", "min_word_probability", "mean_word_probability")
    untimed = segments.withColumn("_any", F.max(F.size("words") > 0).over(W.partitionBy("file"))).where(~F.coalesce(F.col("_any"), F.lit(False)) & (strip(F.col("text")) != ""))
    plain = untimed.select("file", F.struct(F.col("seg").cast("long").alias("group"), F.lit(0).alias("piece")).alias("_o"), "start", "end", strip(F.col("text")).alias("text"), F.lit(None).cast("double").alias("min_word_probability"), F.lit(None).cast("double").alias("mean_word_probability"))
    both = made.unionByName(plain)
    return both.withColumn("sentence", F.row_number().over(W.partitionBy("file").orderBy("_o")).cast("long") - 1).select("file", "sentence", "start", "end", "text", "min_word_probability", "mean_word_probability")


def _info(**given):
    names = ("language", "model", "probability", "avg_logprob", "no_speech_prob", "compression_ratio", "temperature", "min_word_probability", "mean_word_probability")
    null = lambda n: F.lit(None).cast("string" if n in ("language", "model") else "double")
    return F.struct(*(given.get(n, null(n)).alias(n) for n in names))


def _tag(start, end, text, track: str, info):
    return [milliseconds(start).alias("start_time"), milliseconds(end).alias("end_time"), text.alias("tag"), F.lit(None).cast("array<double>").alias("vector"), F.col("file").alias("source_media"), F.lit(track).alias("track"), info.alias("additional_info"), F.lit(None).cast("string").alias("frame_info")]


def word_tags(segments: DataFrame, language=None) -> DataFrame:
    """One tag for each word that isn't blank, with its segment's signals."""
    language = F.lit(None).cast("string") if language is None else language
    w = segments.withColumn("_w", F.explode("words")).withColumn("_lang", language)
    info = _info(language=F.col("_lang"), probability=F.round("_w.probability", 4), avg_logprob=F.round("avg_logprob", 4), no_speech_prob=F.round("no_speech_prob", 4), compression_ratio=F.round("compression_ratio", 3), temperature=F.round("temperature", 2))
    return w.where(strip(F.col("_w.word")) != "").select(*_tag(F.col("_w.start"), F.col("_w.end"), strip(F.col("_w.word")), "", info))


def sentence_tags(sentences: DataFrame, model: str, language=None, track: str = "auto_captions") -> DataFrame:
    language = F.lit(None).cast("string") if language is None else language
    info = _info(language=language, model=F.lit(model), min_word_probability=F.col("min_word_probability"), mean_word_probability=F.col("mean_word_probability"))
    return sentences.select(*_tag(F.col("start"), F.col("end"), F.col("text"), track, info))


def tags(segments: DataFrame, model: str, word_level: bool = True, sentence_level: bool = True, max_gap: float = 5.0, max_words: int = 150) -> DataFrame:
    """Both tracks together. Switching a track off drops its tags and changes no time."""
    parts = ([word_tags(segments)] if word_level else []) + ([sentence_tags(to_sentences(segments, max_gap, max_words), model)] if sentence_level else [])
    if not parts:
        return sentence_tags(to_sentences(segments.limit(0)), model)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def in_order(found: DataFrame) -> DataFrame:
    """Tags of each file together, by start and track; the word track, an empty name, goes first. No order among files."""
    return found.repartition("source_media").sortWithinPartitions("source_media", "start_time", "track", "end_time", "tag")
