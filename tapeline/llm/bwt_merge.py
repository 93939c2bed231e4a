"""Suffix-array dedup: every byte under a window-long string that also starts earlier in the corpus goes.

A global suffix array isn't built: the refinement would pass `window` times over all bytes of the corpus. Shards whose
transforms are merged are instead brought together by what their suffixes can share.
1. Routing, which decides nothing. Each window (window bytes) belongs to its smallest 32-byte gram, by hash, the leftmost of ties
   (winnowing). Equal windows belong to equal grams at the same place, so they meet under the gram's key. Consecutive windows of one gram
   are one run: about one for each 35 bytes. Keys are counted; runs of keys that stand once are done.
2. The other runs' bytes (segments) are cut from their texts and meet under their key. Equal segments, byte by byte, are one
   row of what follows, with several places: all but its earliest place start removed windows.
3. Merge. The distinct segments of a key, or of some keys together, are dealt over shards. Each shard's suffixes are sorted and its
   transform taken, and the interleave of all shards is refined round by round. Round h orders all suffixes by two bytes more, by stably
   sorting the transforms' symbols (byte pairs) in the present interleave, without comparing suffixes again; block numbers carried along
   mark where common prefixes end, and suffixes that are told apart leave. When they agree on `window` bytes a block of two or more
   suffixes is a repeated interval, and all but its earliest suffix start a removed window.
Keys that hold more than one in HOT_KEYS of all runs are dealt over as many tasks as they need, which put equal segments together
first. Where the distinct segments of a key pass key_bytes, each of its windows is routed by itself, by a hash of all its bytes, and goes
through the same steps: the result is the same.

Texts are UTF-8 bytes, of any length, read whole. Earlier means a smaller doc_id, then an earlier start. Null and empty texts have no byte. A null
doc_id sorts before all others. Rows with equal doc_id and text are one document and show the same result; rows of one
doc_id with different texts are ordered by a hash of the text. Extra columns aren't read. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, free_shuffles, join_counted, text_slices
from .textbytes import SpanHash, pack

_U = np.uint64
GRAM = 32
_PLACE_BITS = 31
_NONE = np.zeros(0, dtype=np.int64)
ID = ["ord", "th"]
SEGMENTS = "key long, salt int, ord long, th long, start long, segment binary"
#: What a task says of a segment: its windows are removed, it stands for its salt, or its key is too large for one task.
REMOVED, FIRST, CROWDED = 0, 1, 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[w - 1 : w - 1 + n])


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes: they only route."""
    sums = SpanHash(buf)
    x = (sums.sums[GRAM:] - sums.sums[:-GRAM]) * sums.down[: len(buf) - GRAM + 1]
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def runs_of(texts: list[bytes], window: int):
    """Runs of windows with one gram: text, start, windows, hash of the gram."""
    buf, starts = pack(texts)
    empty = np.zeros(0, dtype=np.int64)
    if len(buf) <= window:
        return empty, empty, empty, empty.astype(_U)
    grams = gram_hashes(buf)
    rank = (grams >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(grams), dtype=_U)
    least = (sliding_min(rank, window - GRAM + 1) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))[: len(least)]
    begins = np.flatnonzero(np.arange(len(least)) <= np.repeat(starts[1:] - 1 - window, np.diff(starts))[: len(least)])
    if not len(begins):
        return empty, empty, empty, empty.astype(_U)
    gram_at = least[begins]
    first = np.flatnonzero(np.concatenate(([True], gram_at[1:] != gram_at[:-1])))
    s = begins[first]
    of = doc[s].astype(np.int64)
    return of, s - starts[of], np.diff(np.append(first, len(begins))), grams[gram_at[first]]


def shard_transforms(segments: list[bytes], shard: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix arrays of all shards behind one another, as segment and start of each suffix, their transforms, and the step back.

    shard: that of each segment, ascending. Suffixes of all shards are sorted together, each shard for itself, by doubling the
    prefixes that their ranks stand for. A transform has the `stride` bytes before each suffix as one symbol (0 where a segment
    has fewer); the step back leads to the row of the suffix that is longer by them.
    """
    lengths = np.array([len(s) for s in segments])
    # Bytes move up by two: 0 stands beyond an end, 1 (of 0xFF, which UTF-8 doesn't have) ends a segment.
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", dtype=np.uint8) + np.uint8(2)
    which = np.repeat(np.arange(len(segments)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    at, end = np.arange(len(text)), ends[which]
    start = at - (end - lengths[which])
    beyond = lambda values, k: np.where(at + k <= end, values[np.minimum(at + k, len(text) - 1)], 0)

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        return order, rank

    key = shard[which].astype(np.int64)
    for k in range(4):
        key = key << 8 | beyond(text, k)
    order, rank = ranked(key)
    known = 4
    while known <= int(lengths.max()) and rank.max() < len(text):
        order, rank = ranked(rank * (len(text) + 1) + beyond(rank, known))
        known *= 2
    row_of = np.empty(len(order), dtype=np.int64)
    row_of[order] = at
    symbol = np.zeros(len(order), dtype=np.uint16)
    for back in range(stride, 0, -1):
        symbol = symbol * np.uint16(256) + (text[np.maximum(order - back, 0)] - np.uint8(2))
    # Adding one leaves 0 free, and loses no pair: UTF-8 has no 0xFF.
    which, start = which[order], start[order]
    symbol = np.where(start < stride, np.uint16(0), symbol + np.uint16(1))
    return which, start, symbol, row_of[np.maximum(order - stride, 0)]


def merge_transforms(segments: list[bytes], length: int, shard_bytes: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that share their first `length` bytes with another: segment, start, and block (equal where they agree).

    Rows of all shards are interleaved. A round has the rows in the order of their first bytes, with numbers of
    blocks that agree on them; the next one steps every row back and sorts stably by the symbol stepped over, so no
    suffix is compared again. A row alone in its block is resolved, and so is every row before it: both leave the
    interleave.
    """
    stride = 1 if length % 2 else 2
    ends = np.cumsum([len(s) + 1 for s in segments])
    owner, place, transform, step = shard_transforms(segments, (ends - 1) // shard_bytes, stride)
    step = step.astype(np.int32)
    # A row begins at the end of what it will be compared by; ends nearer than `length` to a segment's start lead nowhere.
    row = np.flatnonzero(place >= length).astype(np.int32)
    block = np.zeros(len(row), dtype=np.int32)
    for _ in range(length // stride):
        if not len(row):
            break
        symbol = transform.take(row)
        order = np.argsort(symbol, kind="stable")
        symbol, block, row = symbol.take(order), block.take(order), step.take(row.take(order))
        edge = np.empty(len(row) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        np.not_equal(symbol[1:], symbol[:-1], out=edge[1:-1])
        edge[1:-1] |= block[1:] != block[:-1]
        block = np.cumsum(edge[:-1], dtype=np.int32)
        several = np.flatnonzero(~(edge[1:] & edge[:-1]))
        if len(several) < len(row):
            row, block = row.take(several), block.take(several)
    return owner[row], place[row], block


def later_windows(segments: list[bytes], ids: np.ndarray, window: int) -> np.ndarray:
    """Rows (segment, start, number) of consecutive windows that equal one with a smaller id. ids: ord, th and start of each segment."""
    owner, place, block = merge_transforms(segments, window)
    if not len(owner):
        return np.zeros((0, 3), dtype=np.int64)
    at = ids[owner, 2] + place
    order = np.lexsort((at, ids[owner, 1], ids[owner, 0], block))
    owner, place, block, at = owner[order], place[order], block[order], at[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], block[1:] != block[:-1])), np.arange(len(block)), 0))
    same = (ids[owner, 0] == ids[owner[first], 0]) & (ids[owner, 1] == ids[owner[first], 1]) & (at == at[first])
    owner, place = owner[~same], place[~same]
    if not len(owner):
        return np.zeros((0, 3), dtype=np.int64)
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    opens = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))))
    return np.stack((owner[opens], place[opens], np.diff(np.append(opens, len(owner)))), axis=1)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))


def _runs(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for part, texts in text_slices(batches, limit=1_000_000):
            of, start, n, key = runs_of(texts, window)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("ord").take(at), part.column("th").take(at), *(pa.array(x.astype(np.int32)) for x in (start, n))], ["key", "ord", "th", "start", "n"])

    return keyed.mapInArrow(run, "key long, ord long, th long, start int, n int")


def _segments(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of runs (key, salt, ord, th, start, n), cut from their texts."""
    asked = wanted.groupBy(*ID).agg(F.collect_set(F.struct("key", "salt", "start", "n")).alias("asked"))

    def run(batches):
        for batch in batches:
            lists = batch.column("asked")
            fields = {c: lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "start", "n")}
            counts = np.diff(lists.offsets.to_numpy())
            raws = [t.encode() for t in batch.column("text").to_pylist()]
            doc = np.repeat(np.arange(len(raws)), counts)
            for k in range(0, len(doc), 20_000):
                part = slice(k, k + 20_000)
                cut = [raws[d][a : a + m - 1 + window] for d, a, m in zip(doc[part].tolist(), fields["start"][part].tolist(), fields["n"][part].tolist(), strict=True)]
                at = pa.array(doc[part])
                yield pa.RecordBatch.from_arrays([pa.array(fields["key"][part]), pa.array(fields["salt"][part]), batch.column("ord").take(at), batch.column("th").take(at), pa.array(fields["start"][part].astype(np.int64)), pa.array(cut, pa.binary())], ["key", "salt", "ord", "th", "start", "segment"])

    return keyed.join(asked, ID).select(*ID, "text", "asked").mapInArrow(run, SEGMENTS)


def settle(batches, window: int, batch_bytes: int, key_bytes: int):
    """Rows (kind, key, ord, th, start, n, segment) of sorted segments (key, salt, ord, th, start, segment).

    Equal segments behind the first are removed. The distinct ones of a key stand for it if it is salted (salt 0 or
    more), and are merged if it isn't, keys together up to batch_bytes; those of a key beyond key_bytes are crowded. No
    more than about key_bytes + batch_bytes are held.
    """
    names = ["kind", "key", "ord", "th", "start", "n", "segment"]
    types = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    out: list[tuple] = []
    batch, held = [], 0  # of keys to be merged
    now, firsts, distinct, size, crowded = None, [], {}, 0, False

    def given(kind: int, row: tuple) -> None:
        out.append((kind, *row[:4], len(row[4]) - window + 1, None if kind == REMOVED else row[4]))

    def merge() -> None:
        if len(batch) > 1:
            ids = np.array([r[1:4] for r in batch], dtype=np.int64)
            for i, start, n in later_windows([r[4] for r in batch], ids, window).tolist():
                key, o, t, begin, _ = batch[i]
                out.append((REMOVED, key, o, t, begin + start, n, None))
        batch.clear()

    def close() -> None:
        nonlocal held
        if now is None or crowded:
            return
        if now[1] >= 0:
            for row in firsts:
                given(FIRST, row)
        elif len(firsts) > 1:
            batch.extend(firsts)
            held += size
            if held > batch_bytes:
                merge()
                held = 0

    def flush():
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    for part in batches:
        for key, salt, *row in zip(*(part.column(c).to_pylist() for c in ("key", "salt", "ord", "th", "start", "segment")), strict=True):
            if (key, salt) != now:
                close()
                now, firsts, distinct, size, crowded = (key, salt), [], {}, 0, False
            segment = row[3]
            earlier = distinct.get(segment)
            if earlier is not None:
                if earlier != row[:3]:
                    given(REMOVED, (key, *row))
            elif crowded:
                given(FIRST if salt >= 0 else CROWDED, (key, *row))
            else:
                distinct[segment] = row[:3]
                firsts.append((key, *row))
                size += len(segment) + 1
                if size > key_bytes:
                    for first in firsts:
                        given(FIRST if salt >= 0 else CROWDED, first)
                    firsts, crowded = [], True
            if len(out) >= 20_000:
                yield flush()
    close()
    merge()
    if out:
        yield flush()


def _settled(segments: DataFrame, window: int, batch_bytes: int, key_bytes: int, scratch: Scratch, name: str) -> DataFrame:
    dealt = segments.repartition("key", "salt").sortWithinPartitions("key", "salt", *ID, "start")
    found = scratch.keep(dealt.mapInArrow(lambda batches: settle(batches, window, batch_bytes, key_bytes), "kind int, key long, ord long, th long, start long, n long, segment binary"), name)
    free_shuffles(segments.sparkSession)
    return found


def _windows(crowded: DataFrame, window: int, salts: int) -> DataFrame:
    """Each window of crowded segments as a segment of its own, under a hash of all its bytes."""
    def run(batches):
        for batch in batches:
            for key, salt, start, segment in zip(*(batch.column(c) for c in ("ord", "th", "start", "segment")), strict=True):
                raw, begin = segment.as_py(), start.as_py()
                cut = [raw[i : i + window] for i in range(len(raw) - window + 1)]
                m = len(cut)
                keys = np.array([xxhash.xxh3_64_intdigest(w) for w in cut], dtype=_U).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([key.as_py()] * m, pa.int64()), pa.array([salt.as_py()] * m, pa.int64()), pa.array(np.arange(begin, begin + m)), pa.array(cut, pa.binary())], ["key", "ord", "th", "start", "segment"])

    made = crowded.select(*ID, "start", "segment").mapInArrow(run, "key long, ord long, th long, start long, segment binary")
    return made.withColumn("salt", F.pmod(F.xxhash64(*ID), F.lit(salts)).cast("int")).select("key", "salt", *ID, "start", "segment")


def repeats(docs: DataFrame, scratch: Scratch, window: int = 100, batch_bytes: int = 50_000, key_bytes: int = 3_000_000, hot_share: int = HOT_KEYS) -> DataFrame:
    """ord, th, start and n: runs of n removed windows of the documents. A key with more than one in hot_share of the runs is dealt over tasks."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    runs = scratch.keep(_runs(keyed, window), "runs")
    total = runs.count()
    many = max(total // hot_share, 1)
    counts = runs.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    several = scratch.keep(counts.withColumn("salts", F.when(F.col("rows") > many, F.ceil(F.col("rows") / many)).otherwise(0).cast("int")), "several")
    free_shuffles(spark)
    met = join_counted(runs, several, ["key"], total).where(F.col("salts").isNotNull())
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64(*ID), F.col("salts"))).otherwise(-1).cast("int")
    wanted = scratch.keep(met.select("key", salt.alias("salt"), *ID, "start", "n"), "wanted")
    free_shuffles(spark)
    scratch.drop("runs", "several")
    sizes = (window, batch_bytes, key_bytes, scratch)
    segments = scratch.keep(_segments(keyed, wanted, window), "segments")
    free_shuffles(spark)
    scratch.drop("wanted")
    parts = [_settled(segments, *sizes, "settled")]
    scratch.drop("segments")
    alone = lambda df: df.where(F.col("kind") == FIRST).select("key", F.lit(-1).alias("salt"), *ID, "start", "segment")
    if not alone(parts[0]).isEmpty():
        parts.append(_settled(alone(parts[0]), *sizes, "settled_hot"))
    crowded = [p.where(F.col("kind") == CROWDED) for p in parts]
    crowded = crowded[0] if len(crowded) == 1 else crowded[0].unionByName(crowded[1])
    if not crowded.isEmpty():
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts.append(_settled(_windows(crowded, window, salts), *sizes, "settled_windows"))
        parts.append(_settled(alone(parts[-1]), *sizes, "settled_all"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.where(F.col("kind") == REMOVED).select(*ID, "start", "n")


def _cut(raw: bytes, starts: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Starts and ends of the maximal removed spans, and what is left of one text."""
    order = np.argsort(starts)
    begin, end = starts[order], np.maximum.accumulate((starts + n - 1 + window)[order])
    opens = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    a, b = begin[opens], end[np.append(opens[1:], len(begin)) - 1]
    kept = b"".join(raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
    return a, b, kept


def dedup(docs: DataFrame, window: int = 100, keep_bytes: bool = False, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; keep_bytes adds the spans and the kept bytes."""
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.keep(repeats(docs, scratch, window, **sizes).groupBy(*ID).agg(F.collect_set(F.struct("start", "n")).alias("runs")), "gone", result=True)
    schema = "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,stop:long>>, kept binary" * keep_bytes

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            lists = batch.column("runs")
            begin, n = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
            bounds = lists.offsets.to_numpy()
            for k, (o, text) in enumerate(zip(batch.column("ord").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                raw, part = text.encode(), slice(bounds[k], bounds[k + 1])
                a, b, kept = _cut(raw, begin[part], n[part], window) if bounds[k + 1] > bounds[k] else (_NONE, _NONE, raw)
                row = (o, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest())
                out.append(row + ([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], kept) * keep_bytes)
            if out:
                types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()] * keep_bytes
                names = ["ord", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * keep_bytes
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    out = _keyed(docs).join(gone, ID, "left").select("ord", "text", "runs").mapInArrow(run, schema)
    return out.select(F.when(F.col("ord") != -(1 << 63), F.col("ord")).alias("doc_id"), *[c for c in out.columns if c != "ord"])
