"""Error rates from pooled counts, character error rates, rollups and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.text import ratio
from .alignment import align, char_distance, counts

COUNTS = ["n_sub", "n_del", "n_ins", "n_match"]


def wer(s: Column, d: Column, i: Column, c: Column, empty: float | None = 0.0) -> Column:
    return ratio(s + d + i, s + d + c, empty)


def mer(s: Column, d: Column, i: Column, c: Column, empty: float | None = 0.0) -> Column:
    return ratio(s + d + i, s + d + i + c, empty)


def cer(ref: Column, hyp: Column) -> Column:
    """Character distance of space-joined tokens per reference character (one at least)."""
    a, b = F.array_join(ref, " "), F.array_join(hyp, " ")
    return char_distance(a, b).cast("double") / F.greatest(F.char_length(a), F.lit(1))


def pooled(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Counts summed over keys, then rates: long references weigh more."""
    out = scores.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTS))
    four = [F.col(c) for c in COUNTS]
    return out.withColumns({"n_ref": F.col("n_sub") + F.col("n_del") + F.col("n_match"), "wer": wer(*four), "mer": mer(*four)})


def with_corpus(scores: DataFrame, file: str) -> DataFrame:
    """Per-file rows and the corpus row (null file) in one pass, rates per reference word to four places; null where there is none."""
    out = scores.rollup(file).agg(*(F.sum(c).alias(c) for c in COUNTS))
    n = F.col("n_sub") + F.col("n_del") + F.col("n_match")
    four = [F.col(c) for c in COUNTS]
    rates = {f"{k}_rate": F.round(ratio(F.col(f"n_{k}"), n, None), 4) for k in ("sub", "del", "ins")}
    return out.withColumns({"n_ref": n, "wer": F.round(wer(*four, empty=None), 4), "mer": F.round(mer(*four, empty=None), 4)} | rates)


def score_pairs(pairs: DataFrame, rules: normalize.Rules = normalize.Rules(), subtitle: bool = False) -> DataFrame:
    """Counts and rates of pairs (ref, hyp texts). Pairs without reference tokens are dropped.

    The reference is read line by line, so an unclosed bracket there ends with its line; the hypothesis is read whole.
    A subtitle reference follows the hypothesis' rules for digits.
    """
    lines = normalize.lines_of_tokens(F.col("ref"), rules, reference=not subtitle)
    made = pairs.withColumns({"ref_lines": lines, "hyp_tokens": normalize.tokens(F.col("hyp"), rules, reference=False)})
    # The filter stands behind the alignment: before it, it would be moved to the texts and make their tokens once more.
    out = align(made.withColumn("ref_tokens", F.flatten("ref_lines")), "ref_tokens", "hyp_tokens").where(F.size("ref_tokens") > 0).select("*", *counts(F.col("ops")))
    four = [F.col(c) for c in COUNTS]
    return out.withColumns({"n_ref": F.size("ref_tokens").cast("long"), "wer": wer(*four), "mer": mer(*four), "cer": cer(F.col("ref_tokens"), F.col("hyp_tokens"))})


def _asr_errors(pairs: DataFrame, language: str, normalizer) -> DataFrame:
    """pairs (ref, hyp texts, ...) with counts, character errors and reference characters; empty references are dropped."""
    ref, hyp = normalizer(F.col("ref")), normalizer(F.col("hyp"))
    if language in normalize.UNSEGMENTED:
        ref, hyp = normalize.without_spaces(ref), normalize.without_spaces(hyp)
    made = pairs.withColumns({"_r": ref, "_h": hyp}).where(F.col("_r") != "")
    words = {"_rt": normalize.words_of(F.col("_r")), "_ht": normalize.words_of(F.col("_h"))}
    out = align(made.withColumns(words), "_rt", "_ht", "_ops").select("*", *counts(F.col("_ops")))
    return out.withColumns({"char_errors": char_distance(F.col("_r"), F.col("_h")).cast("long"), "n_chars": F.char_length("_r").cast("long")}).drop("_r", "_h", "_rt", "_ht", "_ops")


def _asr_rates(language: str) -> list[Column]:
    word = F.lit(None).cast("double") if language in normalize.UNSEGMENTED else F.round(wer(*(F.sum(c) for c in COUNTS)), 4)
    return [F.count("*").alias("n"), word.alias("wer"), F.round(ratio(F.sum("char_errors"), F.sum("n_chars")), 4).alias("cer")]


def asr_scores(pairs: DataFrame, language: str, normalizer=normalize.basic) -> DataFrame:
    """n, wer and cer of a corpus of (ref, hyp) texts, to four places; scripts without word breaks are scored by characters only."""
    return _asr_errors(pairs, language, normalizer).agg(*_asr_rates(language))


def file_scores(pairs: DataFrame, language: str, normalizer=normalize.basic) -> DataFrame:
    """The same for each file of (name, ref, hyp), and in the row without a name for the corpus: one pass."""
    return _asr_errors(pairs.select("name", "ref", "hyp"), language, normalizer).rollup("name").agg(*_asr_rates(language))


def calibration(true_scores: DataFrame, subtitle_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled rates against both references and their gap. The subtitle side may cover fewer texts: both counts are given."""
    t = pooled(true_scores, keys).select(*keys, F.col("wer").alias("true_wer"), F.col("n_ref").alias("true_n_ref"))
    s = pooled(subtitle_scores, keys).select(*keys, F.col("wer").alias("sub_wer"), F.col("n_ref").alias("sub_n_ref"))
    return t.join(s, keys, "left").withColumn("calibration", F.col("sub_wer") - F.col("true_wer"))


def token_jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
