"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its unary score is linear in its own features and in those of the lines before and
after it; transitions tie neighbours together. Forward-backward gives each line's marginal; their mean, weighted
by line length, is the document's raw quality, which a two-parameter logistic fitted on the training documents
turns into a probability.

Labels are those of documents; which lines of a bad document are the bad ones isn't known. So line labels are latent.
Training begins with every line taking its document's label, then alternates: the distribution of a document's line labels is
the field's own, moved no further than needed (posterior regularization) for bad lines to make up a stated share of
a bad document's text in expectation, and good lines nearly all of a good one's; then the field is fitted to these
distributions, of lines and of neighbours. Documents of good and bad lines so teach where labels change.

The training sample is bounded by max_per_class documents, train_chars characters of each (whole texts up to that, and
windows at hashed places of longer ones, so that no part of a text is out of reach) and train_lines lines of each.
Scoring reads whole texts, with memory in proportion to their lines and not to lines times features.

Null or empty texts are one empty line and get that line's score. Very long texts are cut into segments of lines for
speed, joined exactly; in lines beyond 64 KB words are compared within stretches of about that size. Scores have no order, so there
are no ties; repeated rows are scored alike. Extra columns of the input aren't read by score and pass through keep_good.
A null doc_id is scored like any other. An empty table gives an empty result; without labelled rows of both classes, every
score is the share of label 1 (1.0 without any label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, text_slices
from .textbytes import SpanHash, pack, word_bounds

# Classes of bytes: letters, digits, blanks, marks.
_CLASS = np.full(256, 8, dtype=np.uint8)  # 8: other ASCII
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in ".,;:"]] = 5
_CLASS[[ord(c) for c in "!?'\"()-"]] = 6
_CLASS[128:] = 7
_N = 9
_PAIRS = _N * _N
N_OWN = _PAIRS + 8
#: Bytes of a line that are counted together, and rows and bytes of such stretches that are held at a time.
STRETCH, CHUNK_ROWS, CHUNK_BYTES = 1 << 16, 20_000, 1 << 20
SEGMENT = 256


def _stretch_counts(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each stretch of bytes: pairs of byte classes, words, words like the one before and the one before that, words seen before, bytes of words."""
    n = len(begins)
    low = begins[0]
    seg = buf[low : ends[-1] + 1]
    row_of = np.repeat(np.arange(n), np.append(begins[1:], ends[-1] + 1) - begins)
    cls = _CLASS[seg]
    inner = seg[:-1] != 10
    pair = row_of[:-1][inner] * _PAIRS + cls[:-1][inner] * np.int64(_N) + cls[1:][inner]
    out = np.zeros((n, _PAIRS + 5))
    out[:, :_PAIRS] = np.bincount(pair, minlength=n * _PAIRS).reshape(n, _PAIRS)
    seg = np.append(seg, np.uint8(10))
    ws, we = word_bounds(seg)
    if len(ws):
        words, at = SpanHash(seg).of(ws, we), row_of[np.minimum(ws, len(row_of) - 1)]
        out[:, _PAIRS] = np.bincount(at, minlength=n)
        for k in (1, 2):
            hit = (words[k:] == words[:-k]) & (at[k:] == at[:-k])
            out[:, _PAIRS + k] = np.bincount(at[k:][hit], minlength=n)
        order = np.lexsort((words, at))
        again = (words[order][1:] == words[order][:-1]) & (at[order][1:] == at[order][:-1])
        out[:, _PAIRS + 3] = np.bincount(at[order][1:][again], minlength=n)
        out[:, _PAIRS + 4] = np.bincount(at, weights=we - ws, minlength=n)
    return out


def _own_features(texts: list[bytes]):
    """Features of consecutive lines, a bounded number at a time: (first line, features)."""
    buf, starts = pack(texts)
    ends = np.flatnonzero(buf == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    seen_before = np.zeros(len(ends), dtype=bool)
    at = 0
    for text in texts:
        seen: set[int] = set()
        hashes = [xxhash.xxh3_64_intdigest(line) for line in text.split(b"\n")]
        if len(hashes) > 1:
            for k, h in enumerate(hashes):
                seen_before[at + k] = h in seen
                seen.add(h)
        at += len(hashes)
    parts = np.maximum(1, -(-(ends - begins) // STRETCH))
    line = np.repeat(np.arange(len(ends)), parts)
    part = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    row_begin = begins[line] + part * STRETCH
    row_end = np.minimum(row_begin + STRETCH, ends[line])
    first = 0
    carried, carried_line = np.zeros(_PAIRS + 5), -1  # of a line that goes on in the next chunk
    while first < len(line):
        stop = min(first + CHUNK_ROWS, int(np.searchsorted(row_end, row_begin[first] + CHUNK_BYTES, side="right")))
        stop = max(stop, first + 1)
        counts = _stretch_counts(buf, row_begin[first:stop], row_end[first:stop])
        rows = line[first:stop]
        if rows[0] == carried_line:
            counts[0] += carried
        edge = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        sums, lines = np.add.reduceat(counts, edge), rows[edge]
        if stop < len(line) and line[stop] == lines[-1]:
            carried, carried_line = sums[-1], lines[-1]
            sums, lines = sums[:-1], lines[:-1]
        first = stop
        if not len(lines):
            continue
        length = ends[lines] - begins[lines]
        n_words, many = sums[:, _PAIRS], np.maximum(sums[:, _PAIRS], 1)
        own = np.empty((len(lines), N_OWN), dtype=np.float32)
        own[:, :_PAIRS] = np.sqrt(sums[:, :_PAIRS] / (length + 1)[:, None])
        own[:, _PAIRS] = np.log1p(length) / 5
        own[:, _PAIRS + 1] = np.log1p(n_words) / 4
        own[:, _PAIRS + 2 : _PAIRS + 5] = sums[:, _PAIRS + 1 : _PAIRS + 4] / many[:, None]
        own[:, _PAIRS + 5] = sums[:, _PAIRS + 4] / many / 10
        own[:, _PAIRS + 6] = seen_before[lines] & (n_words > 0)
        own[:, _PAIRS + 7] = 1
        yield int(lines[0]), own


def line_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each line, and each text's first line (one more than texts)."""
    lengths = [np.diff(np.flatnonzero(np.frombuffer(b"\n" + t + b"\n", dtype=np.uint8) == 10)) - 1 for t in texts]
    return np.concatenate(lengths) if lengths else np.zeros(0, dtype=np.int64), np.concatenate(([0], np.cumsum([len(x) for x in lengths]))).astype(np.int64)


def _beside(own: np.ndarray, first_line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the line before and of the line after; zeros beyond a text's ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first_line[:-1]] = 0
    after[first_line[1:] - 1] = 0
    return before, after


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with its neighbours, the bytes of each line, and each text's first line (one more). For bounded samples."""
    length, first_line = line_bounds(texts)
    own = np.concatenate([x for _, x in _own_features(texts)])
    return np.hstack((own, *_beside(own, first_line))), length, first_line


def unaries(texts: list[bytes], w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unary score of each line, the bytes of each line, and each text's first line; features are held by chunks."""
    length, first_line = line_bounds(texts)
    weights = w.reshape(3, N_OWN).T
    part = np.empty((len(length), 3))
    for first, own in _own_features(texts):
        part[first : first + len(own)] = own @ weights
    before, _ = _beside(part[:, 1], first_line)
    _, after = _beside(part[:, 2], first_line)
    return part[:, 0] + before + after + b, length, first_line


_NEVER = -1e30


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(x.take(0, axis), x.take(1, axis))


def forward_backward(unary: np.ndarray, first_line: np.ndarray, trans: np.ndarray, start: np.ndarray, with_pairs: bool = False, segment: int = SEGMENT):
    """Marginals of state 1 (good) for lines of many chains at once.

    Chains are cut into segments, and step t works on all segments longer than t: forward for each state before the
    segment, backward for each state at its end. Segments of a chain are then joined through these states, so that
    the result doesn't depend on the cuts, and a chain of n lines takes about n / segment + 2 * segment steps.

    unary: score of good against bad. With with_pairs, also the summed pair marginals, and the first-state marginals, of all.
    """
    total = len(unary)
    if not total:
        p = np.zeros(0)
        return (p, np.zeros((2, 2)), np.zeros(2)) if with_pairs else p
    n = np.diff(first_line)
    cuts = -(-n // segment)
    chain = np.repeat(np.arange(len(n)), cuts)
    k = np.arange(len(chain)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    head = first_line[:-1][chain] + k * segment
    size = np.minimum(segment, first_line[1:][chain] - head)
    opens = k == 0
    u = np.zeros((total, 2))
    u[:, 1] = unary
    order = np.argsort(-size, kind="stable")
    sorted_head, sorted_size = head[order], size[order]
    steps = int(sorted_size[0])
    active = np.searchsorted(-sorted_size, -np.arange(steps), side="left")
    ahead, back = np.empty((total, 2, 2)), np.empty((total, 2, 2))  # [line, state before, state] and [line, state, state at the end]
    ahead[head] = np.where(opens[:, None, None], start[None, None], trans[None]) + u[head][:, None]
    for t in range(1, steps):
        at = sorted_head[: active[t]] + t
        ahead[at] = _logsum(ahead[at - 1][:, :, :, None] + trans[None, None], 2) + u[at][:, None]
    tail = head + size - 1
    back[tail] = np.where(np.eye(2, dtype=bool), 0.0, _NEVER)[None]
    for t in range(steps - 1, 0, -1):
        at = sorted_head[: active[t]] + t
        back[at - 1] = _logsum(trans[None, :, :, None] + (u[at][:, :, None] + back[at])[:, None], 2)
    before, behind = np.zeros((len(head), 2)), np.zeros((len(head), 2))
    before[opens, 1] = _NEVER
    for i in np.flatnonzero(~opens):
        before[i] = _logsum(before[i - 1][:, None] + ahead[tail[i - 1]], 0)
    for i in np.flatnonzero(~opens)[::-1]:
        rest = u[head[i]] + _logsum(back[head[i]] + behind[i][None], 1)
        behind[i - 1] = _logsum(trans + rest[None], 1)
    alpha = _logsum(ahead + np.repeat(before, size, axis=0)[:, :, None], 1)
    beta = _logsum(back + np.repeat(behind, size, axis=0)[:, None], 2)
    both = alpha + beta
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    if not with_pairs:
        return p
    inner = np.ones(total, dtype=bool)
    inner[first_line[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = alpha[at - 1][:, :, None] + trans[None] + (u[at] + beta[at])[:, None]
    pairs = np.exp(pairs - np.logaddexp(both[at, 0], both[at, 1])[:, None, None])
    return p, pairs.sum(0), np.array([(1 - p[first_line[:-1]]).sum(), p[first_line[:-1]].sum()])


def _raw_quality(p: np.ndarray, length: np.ndarray, first_line: np.ndarray) -> np.ndarray:
    weight = length + 1.0
    return np.add.reduceat(p * weight, first_line[:-1]) / np.add.reduceat(weight, first_line[:-1])


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def line_targets(unary: np.ndarray, length: np.ndarray, first_line: np.ndarray, trans: np.ndarray, start: np.ndarray, y: np.ndarray, bad_share: float, good_share: float):
    """The field's distribution of line labels, moved to documents' labels: marginals, summed pairs and first states.

    Of the text of a bad document an expected bad_share at least is in bad lines, of a good one good_share in good
    lines. The nearest such distribution (by relative entropy) is the field with every line's score moved in proportion to its
    share of the text; how far is found by halving, for all documents together.
    """
    n = np.diff(first_line)
    weight = length + 1.0
    weight *= np.repeat(n / np.add.reduceat(weight, first_line[:-1]), n)  # mean 1 in each document
    toward, need = np.where(y == 1, 1.0, -1.0), np.where(y == 1, good_share, bad_share)

    def share(move: np.ndarray) -> np.ndarray:
        p = forward_backward(unary + np.repeat(toward * move, n) * weight, first_line, trans, start)
        good = np.add.reduceat(p * weight, first_line[:-1]) / n
        return np.where(y == 1, good, 1 - good)

    low, high = np.zeros(len(y)), np.full(len(y), 32.0)
    high[share(low) >= need] = 0
    for _ in range(8):
        half = (low + high) / 2
        enough = share(half) >= need
        low, high = np.where(enough, low, half), np.where(enough, half, high)
    return forward_backward(unary + np.repeat(toward * high, n) * weight, first_line, trans, start, with_pairs=True)


def train(sample: list[tuple[list[bytes], int]], totals: dict[int, int] | None = None, steps: int = 100, rate: float = 0.1, ridge: float = 1e-4, bad_share: float = 0.5, good_share: float = 0.95, supervised: int = 40, renew: int = 15) -> dict:
    """Fit the field by Adam, for `supervised` steps to the documents' labels on all their lines, then to line_targets, made anew every `renew` steps.

    sample: windows of a document, each a chain of its own, and its label. totals: documents of each class where the
    sample was taken; the final logistic's offset is moved from the sample's class balance to theirs.
    """
    doc_y = np.array([label for _, label in sample])
    if len(set(doc_y.tolist())) < 2:
        return {"constant": float(doc_y.mean()) if len(doc_y) else 1.0}
    chains = [(w, label, d) for d, (windows, label) in enumerate(sample) for w in windows]
    y, doc = np.array([c[1] for c in chains]), np.array([c[2] for c in chains])
    # A part at a time: the features' making takes many times the size of the texts.
    parts = [line_features([c[0] for c in chains[k : k + 100]]) for k in range(0, len(chains), 100)]
    x, length = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first_line = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    del parts
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x -= mean
    x /= scale
    line_y = np.repeat(y, np.diff(first_line)).astype(float)
    inner = np.ones(len(line_y), dtype=bool)
    inner[first_line[:-1]] = False
    seen = np.zeros((2, 2))
    at = line_y.astype(int)
    np.add.at(seen, (at[np.flatnonzero(inner) - 1], at[inner]), 1)
    targets = line_y, seen, np.bincount(y, minlength=2).astype(float)
    theta = np.zeros(x.shape[1] + 1 + 4 + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = x.shape[1]
    for step in range(1, steps + 1):
        w, b, trans, start = theta[:k], theta[k], theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :]
        unary = x @ w.astype(np.float32) + b
        if step > supervised and (step - supervised) % renew == 1:
            targets = line_targets(unary, length, first_line, trans, start, y, bad_share, good_share)
        p, pairs, first = forward_backward(unary, first_line, trans, start, with_pairs=True)
        wrong = p - targets[0]
        grad = np.concatenate((wrong.astype(np.float32) @ x, [wrong.sum()], (pairs - targets[1]).ravel(), first - targets[2])) / len(line_y)
        grad += ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, trans, start = theta[:k], theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :]
    p = forward_backward(x @ w.astype(np.float32) + theta[k], first_line, trans, start)
    w = w / scale
    model = {"w": w.astype(np.float32), "b": float(theta[k] - mean @ w), "trans": trans, "start": start, "a": 1.0, "c": 0.0}
    weight = length + 1.0
    doc_of_line = np.repeat(doc, np.diff(first_line))
    z = _logit(np.bincount(doc_of_line, weights=p * weight) / np.bincount(doc_of_line, weights=weight))
    a, c = 0.5, 0.0
    for _ in range(50):  # Newton's method with a ridge that keeps separable data finite
        q = 1 / (1 + np.exp(-(a * z + c)))
        g = np.array([((q - doc_y) * z).sum() + 0.1 * (a - 0.5), (q - doc_y).sum() + 0.1 * c])
        r = q * (1 - q)
        h = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -0.5, 0.5), c - np.clip(step[1], -0.5, 0.5)
    model["a"], model["c"] = max(float(a), 1e-3), float(c)
    if totals:
        model["c"] += float(np.log(totals[1] / totals[0]) - np.log(doc_y.sum() / (len(doc_y) - doc_y.sum())))
    return model


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    unary, length, first_line = unaries(texts, model["w"], model["b"])
    p = forward_backward(unary, first_line, model["trans"], model["start"])
    return 1 / (1 + np.exp(-(model["a"] * _logit(_raw_quality(p, length, first_line)) + model["c"])))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 1000, train_chars: int = 10_000, train_lines: int = 80, folds: int = 5, held_out_fold: int = 0) -> dict:
    """Learn from labelled rows outside the held-out fold of crc32(doc_id) mod folds."""
    open_rows = labels.where(fold_of("doc_id", folds) != held_out_fold)
    sample, totals = labelled_sample(docs, open_rows, "quality", max_per_class, train_chars)
    each = [(windows, [max(1, train_lines // len(windows))] * len(windows), label) for windows, label in sample]
    return train([([b"\n".join(w.split(b"\n")[:n]) for w, n in zip(windows, most, strict=True)], label) for windows, most, label in each], totals)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle. A null doc_id stays null."""
    def run(batches):
        for part, texts in text_slices(batches, limit=1_000_000):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_texts(model, texts), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; no shuffle."""
    model = fit(docs, labels)

    def run(batches):
        for part, texts in text_slices(batches, limit=1_000_000):
            yield part.filter(pa.array(score_texts(model, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
