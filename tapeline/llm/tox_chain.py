"""Toxicity: a classifier chain over toxicity categories.

Categories are predicted in a fixed order; the model of a category sees the document's term features and the
probabilities of all categories before it. While training, those earlier probabilities are out-of-fold
predictions, so a later model learns how far to trust an earlier one on documents it hasn't seen. A fold's
predictions come from terms chosen, and models fitted, without that fold.

Categories are conditions on the columns of the label table, in the order of the chain; the last one is the verdict. The
label table of the query has one toxicity label and one quality label, which give
  toxic_junk   toxic text in a document of bad quality
  toxic_prose  toxic text in a document of good quality
  toxic        toxic text of either kind, or where quality isn't labelled
Rows where a category's columns are null teach the other categories only.
Each model is a logistic regression on the presence of hashed terms: whole words (letters only, without case)
and word beginnings of four and five bytes. A text without any known term gets what the models' offsets say,
which the sample's documents and one without any term together decide.

The sample is bounded by max_per_class documents of each class of the verdict; terms are taken from their whole texts, and scoring reads whole
texts: of a very long one a stretch at a time, cut between words (runs of over a megabyte of letters are cut too). Null and empty texts have no
term. Terms of equal weight are chosen by smaller hash. Repeated rows are scored alike; a null doc_id is scored like any other and teaches nothing; extra columns aren't
read; an empty table gives an empty result. Without labelled rows of both classes of a category its probability is the share of its label 1 (0 without any).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_of, labelled_ids, text_slices
from .textbytes import LOWER, SpanHash

BITS = 20
STRETCH = 1 << 20
_U = np.uint64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[128:] = True


def default_categories() -> dict[str, Column]:
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return {"toxic_junk": toxic & ~good, "toxic_prose": toxic & good, "toxic": toxic}


def stretches(text: bytes, limit: int = STRETCH):
    """Pieces of a text of at most limit bytes, cut behind a byte that isn't a letter where there is one."""
    while len(text) > limit:
        ends = np.flatnonzero(~_LETTER[np.frombuffer(text[:limit], dtype=np.uint8)])
        at = int(ends[-1]) + 1 if len(ends) else limit
        yield text[:at]
        text = text[at:]
    yield text


def _terms(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = LOWER[np.frombuffer(b" ".join(pieces) + b" ", dtype=np.uint8)]
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in pieces])))
    letter = _LETTER[buf]
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(buf) and letter[0]:
        change = np.concatenate(([0], change))
    ws, we = change[0::2], change[1::2]
    spans = SpanHash(buf)
    doc = np.searchsorted(starts, ws, side="right") - 1
    out, docs = [spans.of(ws, we)], [doc]
    for k in (4, 5):
        long = we - ws > k
        out.append(spans.of(ws[long], ws[long] + k) ^ _U(k))
        docs.append(doc[long])
    return (np.concatenate(out) >> _U(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _found(texts: list[bytes]):
    """Hashed terms and their texts, a bounded number of bytes at a time; repeats included."""
    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in stretches(text):
            if held and size + len(piece) > STRETCH:
                terms, at = _terms(held)
                yield terms, np.array(owner)[at]
                held, owner, size = [], [], 0
            held.append(piece)
            owner.append(i)
            size += len(piece)
    if held:
        terms, at = _terms(held)
        yield terms, np.array(owner)[at]


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts, with the text of each; each once for a text, ascending in (text, term)."""
    found = [np.unique((doc << BITS) + terms) for terms, doc in _found(texts)]
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return both & ((1 << BITS) - 1), both >> BITS


def _marked(out: np.ndarray, chosen: np.ndarray, parts) -> np.ndarray:
    column = np.full(1 << BITS, -1, dtype=np.int16)
    column[chosen] = np.arange(len(chosen))
    for terms, doc in parts:
        at = column[terms]
        hit = at >= 0
        out[doc[hit], at[hit]] = 1
    return out


def presence(chosen: np.ndarray, terms: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Rows of texts by chosen terms: 1 where the term is present."""
    return _marked(np.zeros((rows, len(chosen)), dtype=np.float32), chosen, [(terms, doc)])


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 100, rate: float = 0.15, ridge: float = 3e-4, blank: float = 0.1) -> np.ndarray:
    """Adam on the cross-entropy; the weight of a document is the root of what would make both classes weigh the same.

    A text without any term is of no category: such a document is added to the sample, with a share `blank` of its weight.
    """
    theta = np.zeros(x.shape[1] + 1, dtype=np.float32)
    y = y.astype(np.float32)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    if not len(y) or y.min() == y.max():
        theta[-1] = 12.0 if len(y) and y[0] else -12.0
        return theta
    weight = np.where(y == 1, np.sqrt((len(y) - y.sum()) / y.sum()), 1)
    weight = (weight / weight.sum()).astype(np.float32)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1])))
        wrong = (p - y) * weight
        nothing = np.float32(blank) / (1 + np.exp(-theta[-1]))
        grad = np.append(x.T @ wrong + np.float32(ridge) * theta[:-1], wrong.sum() + nothing)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def _predict(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -60, 60)))


def choose_terms(terms: np.ndarray, doc: np.ndarray, verdict: np.ndarray, use: np.ndarray, n_terms: int) -> np.ndarray:
    """The terms that tell the verdict's classes apart best, by symmetric divergence, on the documents in use; ascending."""
    held = use[doc]
    y = verdict[doc[held]]
    by_class = [np.bincount(terms[held][y == c], minlength=1 << BITS) for c in (0, 1)]
    rates = [(by_class[c] + 0.5) / ((verdict[use] == c).sum() + 1) for c in (0, 1)]
    gain = (rates[1] - rates[0]) * np.log(rates[1] / rates[0])
    gain[(by_class[0] + by_class[1]) < 3] = -1
    best = np.argsort(-gain, kind="stable")[:n_terms]
    return np.sort(best[gain[best] >= 0])


def train(names: list[str], labels: np.ndarray, fold: np.ndarray, terms: np.ndarray, doc: np.ndarray, n_terms: int = 768) -> dict:
    """labels: documents by categories, NaN where unknown. terms and doc: the term hashes of all documents and whose they are."""
    known = ~np.isnan(labels)
    if len(set(labels[known[:, -1], -1].tolist())) < 2:
        return {"names": names, "constant": [float(labels[known[:, c], c].mean()) if known[:, c].any() else 0.0 for c in range(len(names))]}
    verdict = np.nan_to_num(labels[:, -1]).astype(int)
    everyone = np.ones(len(labels), dtype=bool)
    parts = [(fold != k, choose_terms(terms, doc, verdict, fold != k, n_terms)) for k in np.unique(fold)]
    chosen = choose_terms(terms, doc, verdict, everyone, n_terms)
    x = presence(chosen, terms, doc, len(labels))
    inside = [presence(c, terms, doc, len(labels)) for _, c in parts]
    earlier = np.zeros((len(labels), 0), dtype=np.float32)
    chain = []
    for c in range(len(names)):
        y, has = np.nan_to_num(labels[:, c]), known[:, c]
        held = np.zeros(len(y))
        for (away, _), features in zip(parts, inside, strict=True):
            seen = np.hstack((features, earlier))
            held[~away] = _predict(_fit_logistic(seen[away & has], y[away & has]), seen[~away])
        chain.append(_fit_logistic(np.hstack((x, earlier))[has], y[has]))
        earlier = np.hstack((earlier, held[:, None].astype(np.float32)))
    return {"names": names, "chosen": chosen, "chain": chain}


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    """A column of probabilities for each category, in the chain's order."""
    if "constant" in model:
        return np.tile(np.array(model["constant"]), (len(texts), 1))
    x = _marked(np.zeros((len(texts), len(model["chosen"])), dtype=np.float32), model["chosen"], _found(texts))
    for theta in model["chain"]:
        x = np.hstack((x, _predict(theta, x)[:, None]))
    return x[:, len(model["chosen"]) :].astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, max_per_class: int = 2000, n_terms: int = 768, train_folds: int = 4, folds: int = 5, held_out_fold: int = 0) -> dict:
    """Learn from labelled rows outside the held-out fold. The terms of the sample's texts are found on the executors."""
    categories = categories or default_categories()
    names = list(categories)
    given = labels.where(fold_of("doc_id", folds) != held_out_fold).select("doc_id", *(c.cast("int").alias(n) for n, c in categories.items()))
    ids, _ = labelled_ids(given, names[-1], max_per_class)
    if ids is None:
        return train(names, np.zeros((0, len(names))), np.zeros(0, dtype=int), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def run(batches):
        for part, texts in text_slices(batches):
            terms, doc = terms_of(texts)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("sample_id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(terms.astype(np.int32)))], ["sample_id", "terms"])

    hit = docs.select(F.col("doc_id").cast("long").alias("sample_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids.select("sample_id")), "sample_id")
    each = hit.mapInArrow(run, "sample_id long, terms array<int>").groupBy("sample_id").agg(F.min("terms").alias("terms"))
    per_id = given.groupBy(F.col("doc_id").alias("sample_id")).agg(*(F.max(n).alias(n) for n in names))
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(each.join(per_id.join(F.broadcast(ids.select("sample_id")), "sample_id"), "sample_id"), "sample")
        found = [(r.sample_id, np.array(r.terms, dtype=np.int64), [r[n] for n in names]) for r in rows.toLocalIterator()]
    found.sort(key=lambda f: f[0])
    labels_of = np.array([[np.nan if x is None else x for x in f[2]] for f in found], dtype=float).reshape(-1, len(names))
    fold = np.array([zlib.crc32(b"%d" % f[0]) // 8 % train_folds for f in found], dtype=np.int64)
    terms = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
    return train(names, labels_of, fold, terms, np.repeat(np.arange(len(found)), [len(f[1]) for f in found]), n_terms)


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.35, **sample) -> DataFrame:
    """doc_id, held_out, p_<category> for each category, and toxic (1 where the last category's probability reaches the threshold)."""
    model = fit(docs, labels, **sample)
    names = ["doc_id", *(f"p_{c}" for c in model["names"])]

    def run(batches):
        for part, texts in text_slices(batches):
            p = score_texts(model, texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, i], pa.float64()) for i in range(p.shape[1]))], names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names[1:]))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), *names[1:], (F.col(names[-1]) >= threshold).cast("int").alias("toxic"))
