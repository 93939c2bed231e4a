"""Best-fit packing by a plan over the histogram of lengths.

Documents are tokenized and cut into pieces of at most `capacity` tokens; that is the only pass over texts. The
histogram of piece lengths (at most `capacity` numbers, however large the corpus) goes to the driver, where best-fit
decreasing runs over counts: all bins with the same room are one group, and each step fills a whole group or uses
up a whole length. Where that takes more sequences than the tokens need, a second plan fills one kind of sequence after
the other as tightly as the lengths left allow, and the better plan is taken. The plan is a list of ranges: pieces of one length with ranks from a to b take the sequences from
s on, at one offset. Its size depends on the capacity alone. Each piece then finds its slot by its rank within its
length: the rank inside its input partition, counted while tokenizing, plus the number of such pieces in earlier
partitions. No length, however frequent, is ranked in one task.

pack() plans over the whole table and heeds no order. pack_in_order() keeps the order in which the table is stored: it
plans for each stretch of consecutive documents by itself, and numbers sequences stretch by stretch.

Null and empty texts are one piece of one token (the end id). Very long texts are tokenized whole, one at a time.
Repeated rows are packed each on its own; among pieces of one length those that come first in the input get the earlier
slots. Extra columns aren't read. Null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_dir, store

_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_RUN = 10_000
_BLANK_RUN = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_vocabulary(spec: dict) -> None:
    """Fails unless the file is plain byte-level BPE whose ids are merge ranks: only then are the ids below those of the file."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    plain &= not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    plain &= not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        raise ValueError("not a plain byte-level BPE file")
    vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if {vocab.get(c) for c in byte_alphabet()} != set(range(256)) or any(vocab.get(a + b) != 256 + rank for rank, (a, b) in enumerate(pairs)):
        raise ValueError("ids are not merge ranks")


def build_encoder(vocabulary: bytes):
    """text -> ids as numpy, equal to the ids of the tokenizers library for the same file.

    A byte-level vocabulary numbers its tokens by merge rank, so the ranks are the ids; added tokens keep theirs. A file
    of another kind is an error.
    """
    import tiktoken

    spec = json.loads(vocabulary)
    check_vocabulary(spec)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=added)
    one_piece = tiktoken.Encoding("one piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    plain = lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    fixed = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not _BLANK_RUN.search(text):
            return plain(text)
        # The split pattern can't take in a very long run of blanks. It is one piece: all of it at the end of a text or
        # before an added token, else all but its last blank, which belongs to what follows.
        out = []
        for part in filter(None, fixed.split(text)) if fixed else [text]:
            at = 0
            for run in _BLANK_RUN.finditer(part):
                end = run.end() - (run.end() < len(part))
                out += [plain(part[at : run.start()]), one_piece.encode_to_numpy(part[run.start() : end], disallowed_special=())]
                at = end
            out.append(plain(part[at:]))
        return np.concatenate(out)

    return encode


_encoders: dict[int, object] = {}


def pieces(docs: DataFrame, vocabulary: bytes, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, carry: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Pieces of every document, with the input partition and the rank there among pieces of the same length.

    Only the first piece of a longer document may be shorter than `capacity`. keep_ids adds the token ids, carry
    (name: type and column) values of the document.
    """
    carry = carry or {}
    carried = list(carry)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = zlib.crc32(vocabulary)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank", *carried] + ["ids"] * keep_ids

    def run(batches):
        if key not in _encoders:
            _encoders[key] = build_encoder(shared.value)
        encode = _encoders[key]
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            doc_at, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc_at.append(i)
                    numbers.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        kept.append(ids[a:b])
            n = np.array(lengths, dtype=np.int64)
            order = np.argsort(n, kind="stable")
            run_start = np.searchsorted(n[order], n[order], side="left")
            rank = np.empty(len(n), dtype=np.int64)
            rank[order] = np.arange(len(n)) - run_start
            rank += seen[n]
            seen += np.bincount(n, minlength=capacity + 1)
            doc_at = pa.array(doc_at, pa.int64())
            cols = [batch.column("doc_id").take(doc_at), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(n), pa.array(sums, pa.int64()), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(rank)]
            cols += [batch.column(n).take(doc_at) for n in carried]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long" + "".join(f", {n} {kind}" for n, (kind, _) in carry.items()) + ", ids array<long>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.alias(n) for n, (_, c) in carry.items())).mapInArrow(run, schema)


def sequences_of(rows: np.ndarray, histogram: dict[int, int]) -> int:
    """How many sequences a plan fills."""
    if not len(rows):
        return 0
    ends = np.append(rows[1:, 1], 0)
    last = np.append(rows[1:, 0] != rows[:-1, 0], True)
    ends[last] = [histogram[n] for n in rows[last, 0].tolist()]
    return int((rows[:, 2] + ends - rows[:, 1]).max())


def plan(histogram: dict[int, int], capacity: int = 2048) -> np.ndarray:
    """A plan of few sequences: best-fit decreasing, or tightest filling where that takes fewer.

    Rows: length, first rank, first sequence, offset; ranks run on to the next row.
    """
    first = best_fit_decreasing(histogram, capacity)
    if sequences_of(first, histogram) * capacity - sum(n * c for n, c in histogram.items()) < capacity:
        return first  # no plan has fewer
    second = tightest_filling(histogram, capacity)
    return min(first, second, key=lambda rows: sequences_of(rows, histogram))


def tightest_filling(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit of whole sequences over counts: behind the longest length left goes the set of others that leaves the least room.

    The set is found by subset sums, as bits of one integer; among equally good ones the longest lengths are taken, as
    short ones fill gaps later. As many sequences as the counts allow get the same set, so the steps depend on the
    number of lengths and not on the corpus.
    """
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left, reverse=True)
    rank = dict.fromkeys(lengths, 0)
    rows, sequences = [], 0
    while left:
        lengths = [n for n in lengths if n in left]
        chosen = {lengths[0]: 1}
        room = capacity - lengths[0]
        mask = (1 << (room + 1)) - 1
        items = [(n, min(left[n] - (n == lengths[0]), room // n)) for n in lengths if n <= room]
        reach = [1]  # sums of the items from the shortest on
        for n, count in reversed(items):
            sums, step = reach[-1], 1
            while count > 0:  # counts in powers of two
                take = min(step, count)
                sums |= (sums << (n * take)) & mask
                count, step = count - take, step * 2
            reach.append(sums)
        goal = reach[-1].bit_length() - 1
        for k, (n, count) in enumerate(items):
            if not goal:
                break
            behind = reach[len(items) - 1 - k]
            take = min(count, goal // n)
            while not behind >> (goal - take * n) & 1:
                take -= 1
            if take:
                chosen[n] = chosen.get(n, 0) + take
                goal -= take * n
        times, offset = min(left[n] // m for n, m in chosen.items()), 0
        for n, m in chosen.items():
            for _ in range(m):
                rows.append((n, rank[n], sequences, offset))
                rank[n] += times
                offset += n
            left[n] -= m * times
            if not left[n]:
                del left[n]
        sequences += times
    out = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def best_fit_decreasing(histogram: dict[int, int], capacity: int = 2048) -> np.ndarray:
    """Best-fit decreasing over counts."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, count)
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        tight = length
        while left:
            while tight < capacity and not room[tight]:
                tight += 1
            if tight >= capacity:
                break
            first, count = room[tight].pop()
            used = min(left, count)
            rows.append((length, rank, first, capacity - tight))
            room[tight - length].append((first, used))
            if used < count:
                room[tight].append((first + used, count - used))
            left, rank = left - used, rank + used
            if tight - length >= length:  # the bins just used are a tighter fit now
                tight = length
        if left:
            fit = capacity // length
            full, over = divmod(left, fit)
            for k in range(fit):
                if full:
                    rows.append((length, rank, sequences, k * length))
                    rank += full
            if full:
                room[capacity - fit * length].append((sequences, full))
            for k in range(over):
                rows.append((length, rank, sequences + full, k * length))
                rank += 1
            if over:
                room[capacity - over * length].append((sequences + full, 1))
            sequences += full + (over > 0)
    out = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, vocabulary: bytes, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = store(pieces(docs, vocabulary, capacity, end_id, keep_ids), scratch_dir(docs.sparkSession))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    # One sorted key for (length, rank): ranks stay below the total.
    wide = int(max(histogram.values(), default=0)) + 1
    keys = slots[:, 0] * wide + slots[:, 1]
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("part_rank") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence = slots[at, 2] + rank - slots[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(slots[at, 3])], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(run, schema)


def stored_place(docs: DataFrame) -> tuple[Column, Column]:
    """File and row of each row of a stored table: its order as written, in whatever order files are read.

    File names begin with the number of the partition that wrote them. A table that isn't stored has its partitions
    for files.
    """
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        docs.select(name, row)
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return F.lpad(F.shiftright(at, 33).cast("string"), 12, "0"), at.bitwiseAND((1 << 33) - 1)
    return F.concat(F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 12, "0"), name), row


def pack_in_order(docs: DataFrame, vocabulary: bytes, span: int = 4096, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence and its offset there; sequences follow the order in which docs are stored.

    Each stretch of `span` documents of a file is packed by itself. Inside a stretch, sequences go by their earliest document.
    """
    spark = docs.sparkSession
    file, row = stored_place(docs)
    carry = {"file": ("string", file), "stretch": ("long", F.floor(row / span)), "place": ("long", row)}
    cut = pieces(docs, vocabulary, capacity, end_id, carry=carry)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "file", "stretch"]

    def place(table):
        length, at, piece = (table.column(n).to_numpy() for n in ("length", "place", "piece"))
        order = np.lexsort((piece, at, length))
        rank = np.empty(len(length), dtype=np.int64)
        rank[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order], side="left")
        sizes, counts = np.unique(length, return_counts=True)
        slots = plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), capacity)
        wide = int(counts.max()) + 1
        found = np.searchsorted(slots[:, 0] * wide + slots[:, 1], length * wide + rank, side="right") - 1
        sequence = slots[found, 2] + rank - slots[found, 1]
        first = np.full(int(sequence.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, at)
        number = np.empty(len(first), dtype=np.int64)
        number[np.argsort(first, kind="stable")] = np.arange(len(first))
        return pa.Table.from_arrays([*(table.column(n) for n in names), pa.array(number[sequence]), pa.array(slots[found, 3])], [*names, "local", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, file string, stretch long, local long, offset long"
    placed = store(cut.groupBy("file", "stretch").applyInArrow(place, schema), scratch_dir(spark))
    # One row for each stretch: the sequences before it.
    sizes = sorted((r.file, r.stretch, r.n) for r in placed.groupBy("file", "stretch").agg((F.max("local") + 1).alias("n")).collect())
    before = np.cumsum([0, *(n for *_, n in sizes)]).tolist()
    base = spark.createDataFrame([(f, k, b) for (f, k, _), b in zip(sizes, before, strict=False)], "file string, stretch long, base long")
    return placed.join(F.broadcast(base), ["file", "stretch"]).select(*names[:5], (F.col("base") + F.col("local")).alias("sequence_id"), "offset")
