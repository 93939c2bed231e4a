"""Cleaning of decoded segments: silence, repetition, collapsed spans, isolated artifacts, straddled cuts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import phrase_key, words_of
from ..functions.punctuation import strip
from ..functions.text import milliseconds

# The shortest span, and the shipped limits of signals and gaps.
MIN_SPAN = 0.1


@dataclass(frozen=True)
class Limits:
    no_speech_max: float = 0.6
    logprob_min: float = -1.0
    compression_max: float = 2.4
    artifact_gap: float = 10.0
    artifact_words: int = 3
    artifact_count: int = 4
    straddle_gap: float = 2.0


def is_silence(no_speech: Column, logprob: Column, limits: Limits = Limits()) -> Column:
    """Both signals beyond their limits; either alone is speech."""
    return (no_speech > limits.no_speech_max) & (logprob < limits.logprob_min)


def is_repetition(temperature: Column, compression: Column, limits: Limits = Limits()) -> Column:
    return (temperature > 0) & (compression > limits.compression_max)


def repeats(fragment: Column, previous: Column) -> Column:
    """Whether phrase keys are equal, or one holds the other and the fragment has three words or more."""
    inside = F.contains(previous, fragment) | F.contains(fragment, previous)
    return F.coalesce((fragment != "") & (previous != "") & ((fragment == previous) | ((F.size(F.split(fragment, " ")) >= 3) & inside)), F.lit(False))


def stretched(words: Column, start: Column, end: Column) -> Column:
    """Words spread evenly over a span."""
    step = (end - start) / F.nullif(F.size(words), F.lit(0))
    return F.transform(words, lambda w, i: F.struct((start + i * step).alias("start"), (start + (i + 1) * step).alias("end"), w["word"].alias("word"), w["probability"].alias("probability")))


def drop_bad(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Without blank, silent and repetitive segments: row by row, no shuffle."""
    bad = is_silence(F.col("no_speech_prob"), F.col("avg_logprob"), limits) | is_repetition(F.col("temperature"), F.col("compression_ratio"), limits)
    return segments.where((strip(F.col("text")) != "") & ~F.coalesce(bad, F.lit(False)))


def filter_segments(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Segments worth keeping. Spans below 100 ms go when they repeat what was last kept, and are lengthened otherwise.

    What was last kept depends on earlier decisions only through runs of short segments: a long segment is always
    kept. So a run is a long segment and the short ones behind it: one array of keys, one fold, and no run leaves the engine.
    """
    by_file = W.partitionBy("file").orderBy("seg")
    raw = segments.withColumn("_next", F.lead("start").over(by_file))
    good = drop_bad(raw, limits).withColumns({"_short": milliseconds(F.col("end") - F.col("start")) < int(MIN_SPAN * 1000), "_key": phrase_key(F.col("text"))})
    so_far = by_file.rowsBetween(W.unboundedPreceding, W.currentRow)
    good = good.withColumn("_run", F.sum(F.when(F.col("_short"), 0).otherwise(1)).over(so_far))
    packed = good.groupBy("file", "_run").agg(F.sort_array(F.collect_list(F.struct(F.col("seg").alias("at"), F.struct(*good.columns).alias("row")))).alias("rows"))
    start = F.struct(F.lit(None).cast("string").alias("kept"), F.array().cast("array<boolean>").alias("stays"))

    def judge(state, x):
        again = x["row"]["_short"] & repeats(x["row"]["_key"], state["kept"])
        return F.struct(F.when(again, state["kept"]).otherwise(x["row"]["_key"]).alias("kept"), F.concat(state["stays"], F.array(~again)).alias("stays"))

    judged = packed.withColumn("stays", F.when(F.size("rows") == 1, F.array(F.lit(True))).otherwise(F.aggregate("rows", start, judge)["stays"]))
    kept = judged.select(F.explode(F.filter(F.arrays_zip("rows", "stays"), lambda x: x["stays"])).alias("x")).select("x.rows.row.*")
    longer = F.col("start") + MIN_SPAN
    fixed = F.when(F.col("_next").isNull(), longer).otherwise(F.least(longer, F.greatest("_next", "end")))
    end = F.when(F.col("_short"), fixed).otherwise(F.col("end"))
    words = F.when(F.col("_short"), stretched(F.col("words"), F.col("start"), fixed)).otherwise(F.col("words"))
    return kept.withColumn("words", words).withColumn("end", end).select(*segments.columns)


def isolation(start: Column, end: Column, by_file: W) -> Column:
    """Silence to the nearer neighbour; infinite beyond the first and the last."""
    inf = F.lit(math.inf)
    return F.least(F.coalesce(start - F.lag(end).over(by_file), inf), F.coalesce(F.lead(start).over(by_file) - end, inf))


def drop_artifacts(segments: DataFrame, limits: Limits = Limits(), file: str = "file", order: tuple[str, ...] = ("seg",)) -> DataFrame:
    """Without the lone occurrences of a file's recurring stock phrases.

    A phrase is short, occurs artifact_count times or more, and its median isolation reaches artifact_gap; then its
    occurrences with that isolation go. Neighbours are those of the rows given.
    """
    if limits.artifact_gap <= 0:
        return segments
    by_file = W.partitionBy(file).orderBy(*order)
    short = F.size(words_of(F.col("text"))) <= limits.artifact_words
    marked = segments.withColumns({"_gap": isolation(F.col("start"), F.col("end"), by_file), "_key": F.when(short, F.nullif(phrase_key(F.col("text")), F.lit("")))})
    same = W.partitionBy(file, "_key")
    drop = F.col("_key").isNotNull() & (F.count("*").over(same) >= limits.artifact_count) & (F.median("_gap").over(same) >= limits.artifact_gap) & (F.col("_gap") >= limits.artifact_gap)
    return marked.withColumn("_drop", drop).where(~F.col("_drop")).select(*segments.columns)


def word_runs(words: DataFrame, keys: list[str], max_gap: float, order: str = "pos") -> DataFrame:
    """words with `run`: islands of words with no more than max_gap between them."""
    by = W.partitionBy(*keys).orderBy(order)
    new = F.when(F.col("start") - F.lag("end").over(by) > max_gap, 1).otherwise(0)
    return words.withColumn("_new", new).withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def anchor_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The run of most spoken time, then of most words, then the first."""
    per_run = runs.groupBy(*keys, "run").agg(F.sum(F.col("end") - F.col("start")).alias("spoken"), F.count("*").alias("n"))
    return per_run.groupBy(*keys).agg(F.max_by("run", F.struct("spoken", "n", -F.col("run"))).alias("anchor"), F.count("*").alias("runs"))


def _laid(durations: list[float], begin: float, room: float) -> list[tuple[float, float]]:
    """Spans back to back from `begin`, shrunk evenly into `room` where they need more."""
    need = sum(durations)
    scale = 0.0 if room <= 0 or need <= 0 else min(1.0, room / need)
    out = []
    for d in durations:
        out.append((begin, begin + d * scale))
        begin = out[-1][1]
    return out


def _repair_file(rows: pd.DataFrame, max_gap: float) -> pd.DataFrame:
    rows = rows.sort_values("seg", kind="stable").reset_index(drop=True)
    floor = 0.0
    starts, ends, words_out = rows["start"].tolist(), rows["end"].tolist(), rows["words"].tolist()
    for i in range(len(rows)):
        words = [dict(w) for w in (words_out[i] if words_out[i] is not None else [])]
        cuts = [0, *(j for j in range(1, len(words)) if words[j]["start"] - words[j - 1]["end"] > max_gap), len(words)]
        if len(cuts) > 2:
            spoken = lambda r: (sum(w["end"] - w["start"] for w in words[cuts[r] : cuts[r + 1]]), cuts[r + 1] - cuts[r], -r)  # noqa: B023, E731
            best = max(range(len(cuts) - 1), key=spoken)
            a, b = cuts[best], cuts[best + 1]
            left = [w["end"] - w["start"] for w in words[:a]]
            begin = max(words[a]["start"] - sum(left), floor)
            spans = _laid(left, begin, words[a]["start"] - begin)
            right = [w["end"] - w["start"] for w in words[b:]]
            room = rows["start"][i + 1] - words[b - 1]["end"] if i + 1 < len(rows) else math.inf
            spans += [(w["start"], w["end"]) for w in words[a:b]] + _laid(right, words[b - 1]["end"], room)
            for w, (s, e) in zip(words, spans, strict=True):
                w["start"], w["end"] = s, e
            starts[i], ends[i], words_out[i] = words[0]["start"], words[-1]["end"], words
        floor = ends[i]
    return rows.assign(start=starts, end=ends, words=words_out)


def repair_straddles(segments: DataFrame, max_gap: float = 2.0) -> DataFrame:
    """Words on the wrong side of a cut are laid back against the segment's anchor run.

    Each repair may start no earlier than the end of the segment before, as repaired, so a file with a straddled
    segment is one ordered fold. Other files, nearly all, never leave the engine.
    """
    gaps = F.zip_with(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), lambda b, a: b["start"] - a["end"] > max_gap)
    straddled = segments.withColumn("_hit", F.coalesce(F.exists(gaps, lambda x: x), F.lit(False))).withColumn("_file_hit", F.max("_hit").over(W.partitionBy("file")))
    calm = straddled.where(~F.col("_file_hit")).select(*segments.columns)
    hit = straddled.where("_file_hit").select(*segments.columns)
    return calm.unionByName(hit.groupBy("file").applyInPandas(lambda rows: _repair_file(rows, max_gap), segments.schema))


def clean(segments: DataFrame, limits: Limits = Limits(), cut_by_activity: bool = False) -> DataFrame:
    """Repair (where decoding was cut by voice activity), filter, then the artifact guard. The order matters."""
    if cut_by_activity:
        segments = repair_straddles(segments, limits.straddle_gap)
    return drop_artifacts(filter_segments(segments, limits), limits)
