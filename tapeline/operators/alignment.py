"""Word alignment of references and hypotheses, and its attribution to utterances."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bound

OPS = "array<struct<op:string,ref_idx:int,hyp_idx:int>>"


#: Cells of the table of costs that are held at once, and pairs whose operations are.
CELLS, PAIRS = 1 << 20, 256
KINDS = ("match", "sub", "del", "ins")


def _operations(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in KINDS of a cheapest alignment of two arrays of codes, with unit costs.

    Equal tokens always match. Where several ways cost the same, going back from the end, a match goes before a
    substitution, that before a deletion, that before an insertion. A row of the table is one numpy step: it holds costs
    less their column, so that a running minimum carries insertions along. Only the rows that begin a block are kept;
    going back, one block after the other is computed again, so a long pair never holds the whole table.
    """
    n, m = len(a), len(b)
    step = max(1, CELLS // (m + 1), isqrt(n))

    def below(cost: np.ndarray, i: int, row: np.ndarray) -> np.ndarray:
        row[0] = cost[0] + 1
        np.minimum(cost[1:] + 1, cost[:-1], out=row[1:])
        np.subtract(cost[:-1], 1, out=row[1:], where=b == a[i])
        return np.minimum.accumulate(row, out=row)

    tops = [np.zeros(m + 1, dtype=np.int32)]
    for top in range(step, n, step):
        cost = tops[-1]
        for i in range(top - step, top):
            cost = below(cost, i, np.empty_like(cost))
        tops.append(cost)
    block = np.empty((min(step, n) + 1, m + 1), dtype=np.int32)
    at, x, y = block.item, a.tolist(), b.tolist()
    out: list[int] = []
    i, j, first = n, m, n
    while i or j:
        if i and i == first:  # up to a row that begins a block: the block above
            first = (i - 1) // step * step
            block[0] = tops.pop()
            for k in range(first, i):
                below(block[k - first], k, block[k - first + 1])
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(0)
        elif i and j and at(i - first, j) == at(i - 1 - first, j - 1):
            i, j = i - 1, j - 1
            out.append(1)
        elif i and at(i - first, j) == at(i - 1 - first, j) + 1:
            i -= 1
            out.append(2)
        else:
            j -= 1
            out.append(3)
    return out[::-1]


def align_tokens(ref: list[str], hyp: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Operations of a cheapest alignment of two lists of tokens, with their places in both."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(t, len(codes)) for t in side], dtype=np.int64) for side in (ref, hyp))
    out, i, j = [], 0, 0
    for k in _operations(a, b):
        out.append((KINDS[k], None if k == 3 else i, None if k == 2 else j))
        i, j = i + (k != 3), j + (k != 2)
    return out


def _ends(lists: pa.Array) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)]))


def _aligned(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    """Operations of some pairs as one Arrow array, built by columns."""
    tokens = pa.concat_arrays([refs.flatten(), hyps.flatten()])
    codes = tokens.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    r, h = _ends(refs), _ends(hyps)
    done = [np.array(_operations(codes[r[k] : r[k + 1]], codes[r[-1] + h[k] : r[-1] + h[k + 1]]), dtype=np.int8) for k in range(len(refs))]
    ops = np.concatenate([np.empty(0, dtype=np.int8), *done])
    sizes = np.array([len(x) for x in done], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ref, hyp = ops != 3, ops != 2
    # A pair's places begin at 0: less what all pairs before it have.
    place = lambda on, before: pa.array((np.cumsum(on) - 1 - np.repeat(before, sizes)).astype(np.int32), mask=~on)
    kinds = pa.array(KINDS, pa.string()).take(pa.array(ops))
    items = pa.StructArray.from_arrays([kinds, place(ref, r[:-1]), place(hyp, h[:-1])], ["op", "ref_idx", "hyp_idx"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)


def align(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", out: str = "ops") -> DataFrame:
    """pairs with the operations of aligning two token arrays. A null array counts as empty.

    A batch is taken and given back in pieces, so a worker holds the operations of a few pairs however long its input is.
    """
    names = [*pairs.columns, out]

    def run(batches):
        for batch in batches:
            for piece in (batch.slice(k, PAIRS) for k in range(0, batch.num_rows, PAIRS)):
                yield pa.RecordBatch.from_arrays([*piece.columns, _aligned(piece.column(ref), piece.column(hyp))], names)

    return pairs.mapInArrow(run, ", ".join(_ddl(f) for f in pairs.schema.fields) + f", {out} {OPS}")


def _ddl(field) -> str:
    return f"`{field.name}` {field.dataType.simpleString()}"


def counts(ops: Column) -> list[Column]:
    """n_sub, n_del, n_ins and n_match of an operation array."""
    one = lambda kind, name: F.size(F.filter(ops, lambda o: o["op"] == kind)).cast("long").alias(name)
    return [one("sub", "n_sub"), one("del", "n_del"), one("ins", "n_ins"), one("match", "n_match")]


def aligned_counts_sql(ref: Column, hyp: Column) -> Column:
    """struct(cost, s, d, i) by a fold over the reference: the DP without Python, for short texts.

    Each cell carries its counts forward along the way that the walk back from the end would take, so the last cell
    has the same counts as the operations.
    """
    cell = lambda c, s, d, i: F.struct(c.cast("int").alias("cost"), s.cast("int").alias("s"), d.cast("int").alias("d"), i.cast("int").alias("i"))
    zero = F.lit(0)
    first = F.transform(F.sequence(F.lit(0), F.size(hyp)), lambda j: cell(j, zero, zero, j))

    def step(row, token):
        edge = F.get(row, 0)
        start = F.array(cell(edge["cost"] + 1, edge["s"], edge["d"] + 1, edge["i"]))

        def add(done, j):
            diag, up, left = F.get(row, j), F.get(row, j + 1), F.element_at(done, -1)
            best = F.least(diag["cost"], up["cost"], left["cost"])
            picked = (
                F.when(F.get(hyp, j) == token, cell(diag["cost"], diag["s"], diag["d"], diag["i"]))
                .when(diag["cost"] == best, cell(diag["cost"] + 1, diag["s"] + 1, diag["d"], diag["i"]))
                .when(up["cost"] == best, cell(up["cost"] + 1, up["s"], up["d"] + 1, up["i"]))
                .otherwise(cell(left["cost"] + 1, left["s"], left["d"], left["i"] + 1))
            )
            return F.concat(done, F.array(picked))

        return F.when(F.size(hyp) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(hyp) - 1), start, add))

    return F.element_at(F.aggregate(ref, first, step), -1)


#: Code points for tokens: from the first ideographs up to where surrogates begin.
_FIRST_CODE, _CODES = 0x4E00, 0xD800 - 0x4E00


def token_distance(ref: Column, hyp: Column) -> Column:
    """Substitutions, deletions and insertions together, natively: tokens become single characters, then levenshtein.

    For texts of at most 35,328 distinct tokens; more are an error, and `align` is for them.
    """
    character = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + _FIRST_CODE), 4, "0")), "UTF-16BE")
    code = lambda tokens, numbered: F.array_join(F.transform(tokens, lambda t: F.element_at(numbered, t)), "")

    def distance(vocabulary: Column) -> Column:
        numbered = F.map_from_arrays(vocabulary, F.transform(vocabulary, lambda _, i: character(i)))
        return F.when(F.size(vocabulary) > _CODES, F.raise_error(F.lit("too many distinct tokens for token_distance; use align")).cast("int")).otherwise(bound(numbered, lambda n: F.levenshtein(code(ref, n), code(hyp, n))))

    return bound(F.array_distinct(F.concat(ref, hyp)), distance)


def char_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, 0).otherwise(F.levenshtein(a, b))


def utterance_counts(aligned: DataFrame, keys: list[str], lines: str = "ref_lines", ops: str = "ops") -> DataFrame:
    """Counts for each reference line, lines without operations included.

    A reference token belongs to its line. An inserted token belongs to the line of the next reference token, or to
    the last line behind the last one.
    """
    bounds = F.aggregate(lines, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + F.size(x))))
    based = aligned.withColumn("_ends", bounds)
    each = based.select(*keys, "_ends", F.posexplode(ops).alias("_k", "_o")).select(*keys, "_ends", "_k", F.col("_o.op").alias("op"), F.col("_o.ref_idx").alias("r"))
    ahead = W.partitionBy(*keys).orderBy("_k").rowsBetween(W.currentRow, W.unboundedFollowing)
    nearest = F.first("r", ignorenulls=True).over(ahead)
    last = F.size("_ends") - 1
    placed = each.withColumn("_r", nearest).withColumn("utterance", F.when(F.col("_r").isNull(), last).otherwise(F.size(F.filter("_ends", lambda e: e <= F.col("_r")))))
    total = placed.groupBy(*keys, "utterance").agg(*(F.count_if(F.col("op") == k).alias(n) for k, n in (("sub", "n_sub"), ("del", "n_del"), ("ins", "n_ins"), ("match", "n_match"))))
    every = aligned.where(F.size(lines) > 0).select(*keys, F.explode(F.sequence(F.lit(0), F.size(lines) - 1)).alias("utterance"))
    return every.join(total, [*keys, "utterance"], "left").na.fill(0, ["n_sub", "n_del", "n_ins", "n_match"])
