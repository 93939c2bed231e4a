"""The three ways through the engine: tagging, reference scoring, benchmark scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import clean, metrics, pairing, sentences
from ..operators.alignment import utterance_counts
from ..operators.bootstrap import gap_intervals, rate_intervals
from . import models
from .config import Config


def tag(segments: DataFrame, config: Config = Config(), classifier=None) -> DataFrame:
    """Tags of decoded segments: repair, filter, artifact guard, punctuation, then words and sentences, in order."""
    limits = clean.Limits(config.no_speech_max, config.logprob_min, config.compression_max, config.artifact_gap, config.artifact_words, config.artifact_count)
    kept = clean.clean(segments, limits, config.cut_by_activity)
    if config.punctuate and classifier is not None:
        words = models.punctuate(sentences.words_of(kept), classifier, config.mark_threshold, config.demote_marks, config.window, config.stride, config.batch_size)
        kept = models.reattach(kept, words)
    return sentences.in_order(sentences.tags(kept, config.model, config.word_level, config.sentence_level, config.sentence_gap, config.max_caption_words))


def calibrate(texts: DataFrame, rules: normalize.Rules = normalize.Rules(), n_boot: int = 2000, seed: int = 1234) -> dict[str, DataFrame]:
    """Per-excerpt and per-category tables of texts (id, category, model, ref, hyp, sub)."""
    keys = ["id", "category", "model"]
    true = metrics.score_pairs(texts.select(*keys, "ref", "hyp"), rules)
    sub = metrics.score_pairs(texts.where(F.col("sub").isNotNull()).select(*keys, F.col("sub").alias("ref"), "hyp"), rules, subtitle=True)
    excerpt = true.select(*keys, "wer", *metrics.COUNTS, "n_ref", "mer", "cer").join(sub.select("id", "model", F.col("wer").alias("sub_wer")), ["id", "model"], "left").withColumn("calibration", F.col("sub_wer") - F.col("wer"))
    group = ["category", "model"]
    buckets = [utterance_counts(x, keys) for x in (true, sub)]
    rates = rate_intervals(buckets[0], group, ["id", "utterance"], n_boot, seed)
    gaps = gap_intervals(*buckets, group, ["id", "utterance"], n_boot, seed)
    category = metrics.calibration(true, sub, group).join(rates, group, "left").join(gaps.select(*group, F.col("lo").alias("cal_lo"), F.col("hi").alias("cal_hi")), group, "left")
    return {"per_excerpt": excerpt, "per_category": category}


def benchmark(hyps: DataFrame, refs: DataFrame, language: str = "en", normalizer=normalize.basic) -> DataFrame:
    """n, wer and cer of tagged media against references, paired by name."""
    return metrics.asr_scores(pairing.paired(hyps, refs), language, normalizer)
