"""Language ID: a byte convolutional network with filters of several widths, max pooling and a softmax, in numpy.

Every byte value has an embedding; filters of widths 2, 3 and 4 pass over windows of fixed length; each filter's largest
activation in a window feeds a softmax over the languages. A text of any length is cut into such windows, all of
them are scored, and the sum of their log-probabilities decides. A filter's response to a byte at one of its
places is a row of a small table (embedding times weights), and the two places of a pair share one table, so
scoring gathers rows of pair tables instead of multiplying.

Training windows come from at most max_per_lang documents of each language, windows_per_doc from each, at hashed
places of the whole text. Documents with a null language or doc_id teach nothing. Null texts and texts without a letter are `und` with score 0. With one known
language that one is the answer with score 1; with none, `und`. Languages of equal probability: the first by name. Very long
texts are scored window by window, some at a time. Repeated rows are predicted alike; extra columns
aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, join_counted, text_slices

WINDOW = 128
EMBED = 8
FILTERS = 10
WIDTHS = (2, 3, 4)
_SYMBOLS = 256  # every byte has an embedding of its own
UNDETERMINED = "und"

def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each filled up with blanks, and the number of windows of each text."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], dtype=np.int64)
    joined = b"".join(t.ljust(int(k) * WINDOW) for t, k in zip(texts, counts, strict=True))
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, WINDOW), counts


def _init(langs: int, rng) -> dict:
    out = {"embed": rng.normal(0, 0.5, (_SYMBOLS, EMBED))}
    for w in WIDTHS:
        out[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
        out[f"bias{w}"] = np.zeros(FILTERS)
    out["soft"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, langs))
    out["soft_bias"] = np.zeros(langs)
    return {k: v.astype(np.float32) for k, v in out.items()}


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 7) -> dict:
    """Adam on the cross-entropy of single windows; gradients written out by hand."""
    rng = np.random.default_rng(seed)
    net = _init(len(langs), rng)
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(y), 128):
            at = order[first : first + 128]
            x, target = windows[at], y[at]
            emb = net["embed"][x]
            pooled, where = [], []
            for w in WIDTHS:
                act = sum(emb[:, j : WINDOW - w + 1 + j] @ net[f"conv{w}"][j] for j in range(w))
                best = act.argmax(1)
                pooled.append(np.take_along_axis(act, best[:, None, :], 1)[:, 0] + net[f"bias{w}"])
                where.append(best)
            raw = np.concatenate(pooled, 1)
            hidden = np.maximum(raw, 0)
            p = _softmax(hidden @ net["soft"] + net["soft_bias"])
            p[np.arange(len(at)), target] -= 1
            p /= len(at)
            grad = {"soft": hidden.T @ p, "soft_bias": p.sum(0), "embed": np.zeros_like(net["embed"])}
            back = (p @ net["soft"].T) * (raw > 0)
            rows = np.arange(len(at))[:, None]
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grad[f"bias{w}"] = g.sum(0)
                conv = np.zeros_like(net[f"conv{w}"])
                for j in range(w):
                    conv[j] = np.einsum("bfe,bf->ef", emb[rows, where[i] + j], g)
                    np.add.at(grad["embed"], x[rows, where[i] + j], g[:, :, None] * net[f"conv{w}"][j].T[None])
                grad[f"conv{w}"] = conv
            step += 1
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v2[k] = 0.999 * v2[k] + 0.001 * grad[k] ** 2
                net[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return compiled(net, langs)


def compiled(net: dict, langs: list[str]) -> dict:
    """Tables for scoring: per width, a table of each pair of places and, for odd widths, of the last place."""
    out = {"langs": langs, "soft": net["soft"], "soft_bias": net["soft_bias"], "tables": []}
    for w in WIDTHS:
        one = [net["embed"] @ net[f"conv{w}"][j] for j in range(w)]
        tables = [((one[j][:, None, :] + one[j + 1][None, :, :]).reshape(-1, FILTERS), j, True) for j in range(0, w - 1, 2)]
        if w % 2:
            tables.append((one[-1], w - 1, False))
        out["tables"].append((w, net[f"bias{w}"], tables))
    return out


def window_log_probs(model: dict, windows: np.ndarray) -> np.ndarray:
    windows = windows.astype(np.int32)
    pairs = windows[:, :-1] * _SYMBOLS + windows[:, 1:]
    pooled = []
    for w, bias, tables in model["tables"]:
        span = WINDOW - w + 1
        act = None
        for table, j, paired in tables:
            part = np.take(table, (pairs if paired else windows)[:, j : j + span], axis=0)
            act = part if act is None else np.add(act, part, out=act)
        pooled.append(act.max(1) + bias)
    p = _softmax(np.maximum(np.concatenate(pooled, 1), 0) @ model["soft"] + model["soft_bias"])
    return np.log(p + 1e-9)


def has_letter(text: bytes) -> bool:
    """ASCII letters first: cheap, and true of nearly every text."""
    return bool(_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "replace")))


_ASCII_LETTER = regex.compile(rb"[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")


def predict_texts(model: dict, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and the share of the decision it gets: the softmax of mean log-probabilities, weighted by windows."""
    found = np.array([has_letter(t) for t in texts], dtype=bool)
    names, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
    if model["langs"] and len(model["langs"]) == 1:
        names[found], score[found] = model["langs"][0], 1.0
    elif model["langs"] and found.any():
        windows, counts = windows_of([t for t, ok in zip(texts, found, strict=True) if ok])
        logs = np.concatenate([window_log_probs(model, windows[i : i + 512]) for i in range(0, len(windows), 512)])
        ends = np.cumsum(counts)
        total = np.add.reduceat(logs, ends - counts)
        p = _softmax(total / np.sqrt(counts)[:, None])
        best = total.argmax(1)
        names[found] = np.array(model["langs"], dtype=object)[best]
        score[found] = p[np.arange(len(best)), best]
    return names.tolist(), np.clip(score, 0, 1)


def fit(docs: DataFrame, max_per_lang: int = 300, max_docs: int = 30_000, windows_per_doc: int = 4, folds: int = 4, held_out_fold: int = 2) -> dict:
    """Learn from text and language of rows outside the held-out fold. Every language found there is learned.

    The sample: of each language the max_per_lang documents first in the order of a hash of their id (fewer, one at
    least, where languages are so many that the whole would pass max_docs), and windows_per_doc windows of each at
    places drawn from that hash.
    """
    from pyspark.sql import Window as W

    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", folds) != held_out_fold) & F.col("doc_id").isNotNull())
    counted = taught.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = counted.count()
    if not n_langs:
        return {"langs": []}
    per_lang = max(1, min(max_per_lang, max_docs // n_langs))
    # A hash threshold per language leaves about three times the rows wanted, so that no large group is ranked.
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    body = F.col("text").cast("string")
    cuts = [F.substring(body, (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length(body) - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)) for i in range(windows_per_doc)]
    light = taught.select(F.col("lang").alias("language"), "doc_id", draw.alias("draw"), F.array(*cuts).alias("cuts"))
    sizes = counted.select(F.col("lang").alias("language"), F.col("n").alias("rows"), "n")
    near = join_counted(light, sizes, ["language"], counted.agg(F.sum("n")).first()[0])
    cut = near.where(F.col("draw") < (F.lit(1 << 30) / F.col("n") * (3 * per_lang + 20))).drop("n")
    ranked = cut.withColumn("place", F.row_number().over(W.partitionBy("language").orderBy("draw", "doc_id", "cuts"))).where(F.col("place") <= per_lang)
    rows = sorted(ranked.select("language", "draw", "doc_id", "cuts").collect())
    langs = sorted({r.language for r in rows})
    if len(langs) < 2:
        return {"langs": langs}
    texts = [c.encode()[:WINDOW] for r in rows for c in r.cuts]
    number = {lang: k for k, lang in enumerate(langs)}
    y = np.array([number[r.language] for r in rows for _ in r.cuts])
    windows, _ = windows_of(texts)
    return train(windows, y, langs)


def identify(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, **sample) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; one scan without a shuffle after training."""
    model = fit(docs, folds=folds, held_out_fold=held_out_fold, **sample)

    def run(batches):
        for part, texts in text_slices(batches, limit=500_000):
            names, score = predict_texts(model, texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold_of("doc_id", folds) == held_out_fold).alias("held_out"), "lang_pred", "score")
