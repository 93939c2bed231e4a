"""Hand-verified texts, where a folder of them is at hand: exact counts and rates of every excerpt and model.

HAND_VERIFIED_DIR names the folder: references/, subtitle_refs/ and hypotheses/<model>/ of texts, and results/per_excerpt.csv.
"""

import csv
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapeline.operators import metrics
from tapeline.sources import readers

PLACE = os.environ.get("HAND_VERIFIED_DIR")


@pytest.mark.skipif(not PLACE, reason="HAND_VERIFIED_DIR isn't set")
def test_counts_and_rates(spark):
    folder = Path(PLACE)
    texts = lambda name: readers.read_texts(spark, str(folder / name)).select(F.col("key").alias("id"), F.col("body").alias("ref"))
    hyps = readers.read_hypotheses(spark, str(folder / "hypotheses"))
    scored = lambda name, **side: {(r.model, r.id): r for r in metrics.score_pairs(hyps.join(texts(name), "id"), **side).collect()}
    true, sub = scored("references"), scored("subtitle_refs", subtitle=True)
    with open(folder / "results" / "per_excerpt.csv") as f:
        rows = list(csv.DictReader(f))
    assert len(rows) == len(true)
    for row in rows:
        got = true[row["model"], row["excerpt"]]
        assert (got.n_sub, got.n_del, got.n_ins, got.n_match, got.n_ref) == tuple(int(row[c]) for c in ("S", "D", "I", "C", "n_ref"))
        for name, value in (("true_wer", got.wer), ("true_mer", got.mer), ("true_cer", got.cer), ("sub_wer", sub[row["model"], row["excerpt"]].wer)):
            assert not row[name] or value == pytest.approx(float(row[name]), abs=1e-6)
