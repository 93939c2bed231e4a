"""Mixing sources to target weights: Pfair scheduling of blocks.

Documents of a source, in the order of a hash of their id, form blocks of block_docs documents. Block j (from 1) of a
source of weight w has release floor((j - 1) / w) and deadline ceil(j / w); in each slot the released block with the
earliest deadline goes (ties: the heavier source, then its name). Weights are exact rationals that add up to one, so
every block meets its deadline: after any number of slots a source is less than one block away from its weight,
however long the corpus. One task makes the schedule of all blocks as a stream; a document finds its slot among those
of its source's hash range.

Every document gets a slot; none is dropped or repeated. The bound holds up to the first slot that would go to a source
without a block left (on_target); from there on the blocks of other sources still go within their release and
deadline, and slots that none of them takes stay empty.

A null source is a source of its own. Null, empty or very long texts are documents like others, and so are null doc_ids. Repeated rows each have a
place; rows with equal hashes are ordered by doc_id, equal rows in any order. Extra columns pass through mixed, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hash ranges in which a source's documents are ranked: no source is ranked in one task.
RANGE_BITS = 12


def shares(weights: dict[str, float], granularity: int) -> dict[str, int]:
    """Whole shares that add up to the granularity: largest remainders, and one for each positive weight below one share."""
    left = {k: Fraction(w) for k, w in weights.items() if w > 0}
    if len(left) > granularity:
        raise ValueError("more sources than slots in a period; raise the granularity")
    out: dict[str, int] = {}
    while True:
        spare, total = granularity - len(out), sum(left.values())
        small = [k for k, w in left.items() if spare * w < total]
        if not small:
            break
        out |= dict.fromkeys(small, 1)
        left = {k: w for k, w in left.items() if k not in out}
    quota = {k: spare * w / total for k, w in left.items()}
    out |= {k: int(x) for k, x in quota.items()}
    for k in sorted(quota, key=lambda k: (int(quota[k]) - quota[k], k))[: granularity - sum(out.values())]:
        out[k] += 1
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the positive weights."""
    exact = {k: Fraction(w) for k, w in weights.items() if w > 0}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {k: int(x * scale) for k, x in exact.items()}
    common = math.gcd(*out.values())
    return {k: x // common for k, x in out.items()}


def schedule(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """(source, block from 0, slot, release, deadline, on target) of all blocks, in the order of slots.

    The block after a source's last one takes part too, unseen: in its slot the bound ends.
    """
    total = sum(weights.values())
    waiting = [(0, k, 0) for k in weights]
    heapq.heapify(waiting)
    ready, slot, on_target = [], 0, True
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[k]), -weights[k], k, j, release))
        deadline, _, k, j, release = heapq.heappop(ready)
        if j < blocks.get(k, 0):
            yield k, j, slot, release, deadline, on_target
            heapq.heappush(waiting, ((j + 1) * total // weights[k], k, j + 1))
        else:
            on_target = False
        slot += 1


def _schedule_table(spark, weights: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    names = ["of", "block", "slot", "release", "deadline", "on_target"]

    def run(batches):
        for batch in batches:
            rows = schedule(weights, blocks) if batch.num_rows else iter(())
            while part := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names)

    return spark.range(0, 1, 1, 1).mapInArrow(run, "of string, block long, slot long, release long, deadline long, on_target boolean")


def scheduled(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, block_docs: int = 32, granularity: int | None = None, max_sources: int = 1_000_000) -> DataFrame:
    """row (a struct of the columns of docs), block, slot, release, deadline, place and on_target of every row of docs.

    Without weights, a source's target is its number of documents to the power alpha. Targets are exact; with a
    granularity they are whole shares of that many slots. One number for each source goes to the driver, so more than
    max_sources sources are an error.
    """
    name = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    draw = F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), name.alias("of"), draw.alias("draw"))
    keyed = packed.withColumn("range", F.shiftrightunsigned("draw", 64 - RANGE_BITS).cast("int"))
    counts = keyed.groupBy("of", "range").agg(F.count("*").alias("n"))
    supply = {r.of: r.n for r in counts.groupBy("of").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()}
    if len(supply) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if weights is None:
        wanted = {k: n**alpha for k, n in supply.items()}
    else:
        wanted = {("0" if k is None else "1" + k): w for k, w in weights.items()}
        unknown = set(supply) - {k for k, w in wanted.items() if w > 0}
        if unknown:
            raise ValueError(f"sources without a target weight: {sorted(unknown)[:5]}")
    if granularity is not None:
        wanted = shares(wanted, max(granularity, 4 * len(wanted))) if wanted else {}
    share = whole(wanted)
    blocks = {k: -(-n // block_docs) for k, n in supply.items()}
    if any((blocks.get(k, 0) + len(share) + 1) * sum(share.values()) // w >= 1 << 62 for k, w in share.items()):
        raise ValueError("a target weight is too small: slots pass 64 bits")

    # One row for each hash range of a source: what stands before it, and the places of its blocks.
    before = F.coalesce(F.sum("n").over(W.partitionBy("of").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).withColumn("first", F.floor(F.col("before") / block_docs))
    spans = offsets.withColumn("block", F.explode(F.sequence("first", F.floor((F.col("before") + F.col("n") - 1) / block_docs))))
    found = spans.join(_schedule_table(docs.sparkSession, share, blocks), ["of", "block"])
    places = found.groupBy("of", "range", "before", "first").agg(F.sort_array(F.collect_list(F.struct("block", "slot", "release", "deadline", "on_target"))).alias("spans"))
    ranked = keyed.withColumn("at", F.row_number().over(W.partitionBy("of", "range").orderBy("draw", "row.doc_id")) - 1)
    placed = ranked.join(places, ["of", "range"]).withColumn("rank", F.col("at") + F.col("before"))
    placed = placed.withColumns({"block": F.floor(F.col("rank") / block_docs), "place": (F.col("rank") % block_docs).cast("int")})
    span = F.element_at("spans", (F.col("block") - F.col("first") + 1).cast("int"))
    return placed.withColumn("span", span).select("row", "block", "span.slot", "span.release", "span.deadline", "place", "span.on_target")


def order(docs: DataFrame, **targets) -> DataFrame:
    """doc_id, source, block, slot, release, deadline, place and on_target of every row."""
    out = scheduled(docs.select("doc_id", "source", F.xxhash64("text").alias("text")), **targets)
    names = ("block", "slot", "release", "deadline")
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.source", *(F.col(n).cast("long").alias(n) for n in names), "place", "on_target")


def mixed(docs: DataFrame, **targets) -> DataFrame:
    """docs, all rows and columns, in the order of the mix: partitions hold consecutive ranges of slots."""
    return scheduled(docs, **targets).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
