"""Corpus scores of translations: BLEU and chrF from summed n-gram statistics, one Arrow pass and one small sum."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import PUNCTUATION

BLEU_ORDER, CHAR_ORDER, WORD_ORDER, BETA = 4, 6, 2, 2
# The public mteval-v13a tokenization that BLEU figures are published with.
_ENTITIES = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_CUTS = (
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)


def bleu_words(text: str) -> list[str]:
    for old, new in _ENTITIES:
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, by in _CUTS:
        text = pattern.sub(by, text)
    return text.split()


def chrf_words(text: str) -> list[str]:
    """Words with one mark cut from their end or, failing that, their start."""
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in PUNCTUATION:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in PUNCTUATION:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def _overlap(ref, hyp, n: int) -> tuple[int, int, int]:
    r, h = _grams(ref, n), _grams(hyp, n)
    return sum((r & h).values()), sum(h.values()), sum(r.values())


def statistics(ref: str, hyp: str) -> list[int]:
    """Matches, hypothesis and reference n-grams: words for BLEU, then characters without spaces and words for chrF; lengths last."""
    rw, hw = bleu_words(ref), bleu_words(hyp)
    rc, hc = "".join(ref.split()), "".join(hyp.split())
    rp, hp = chrf_words(ref), chrf_words(hyp)
    out = [x for n in range(1, BLEU_ORDER + 1) for x in _overlap(rw, hw, n)]
    out += [x for n in range(1, CHAR_ORDER + 1) for x in _overlap(rc, hc, n)]
    out += [x for n in range(1, WORD_ORDER + 1) for x in _overlap(rp, hp, n)]
    return [*out, len(rw), len(hw)]


def bleu(totals: list[int]) -> float:
    """Percent. Orders without a match count as half of the one before (exponential smoothing)."""
    *_, n_ref, n_hyp = totals
    if not n_hyp:
        return 0.0
    logs, half = 0.0, 1.0
    for k in range(BLEU_ORDER):
        match, count, _ = totals[3 * k : 3 * k + 3]
        if not count:
            return 0.0
        if not match:
            half *= 2
        logs += math.log((match or 1 / half) / count)
    return 100 * math.exp(min(0.0, 1 - n_ref / n_hyp) + logs / BLEU_ORDER)


def chrf(totals: list[int]) -> float:
    """Percent: the F-score, weighing recall BETA times, of precision and recall averaged over the orders that both sides have."""
    precision, recall, orders = 0.0, 0.0, 0
    for k in range(BLEU_ORDER, BLEU_ORDER + CHAR_ORDER + WORD_ORDER):
        match, n_hyp, n_ref = totals[3 * k : 3 * k + 3]
        if n_hyp and n_ref:
            precision, recall, orders = precision + match / n_hyp, recall + match / n_ref, orders + 1
    if not precision + recall:
        return 0.0
    p, r = precision / orders, recall / orders
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r)


def translation_scores(pairs: DataFrame) -> DataFrame:
    """n, bleu and chrf (character and word orders) of all pairs (ref, hyp) with a reference, to two places."""
    width = len(statistics("", ""))

    def run(batches):
        for batch in batches:
            rows = [statistics(r, h or "") for r, h in zip(batch.column("ref").to_pylist(), batch.column("hyp").to_pylist(), strict=True)]
            if rows:
                total = [sum(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), *(pa.array([x], pa.int64()) for x in total)], ["n", *(f"s{i}" for i in range(width))])

    schema = "n long, " + ", ".join(f"s{i} long" for i in range(width))
    parts = pairs.where(F.trim("ref") != "").select("ref", "hyp").mapInArrow(run, schema)
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"s{i}") for i in range(width)))

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sums = [row[f"s{i}"] for i in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array([row["n"]], pa.int64()), pa.array([round(bleu(sums), 2)]), pa.array([round(chrf(sums), 2)])], ["n", "bleu", "chrf"])

    return total.mapInArrow(finish, "n long, bleu double, chrf double")
