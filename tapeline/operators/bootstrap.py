"""Bootstrap intervals over utterance counts, with draws that any engine can repeat.

Draw i of replicate r in a group is a counter-based generator: a linear congruence of (seed, r, i) modulo a Mersenne
prime, reduced to the group's number of utterances. Groups don't share a stream, so one group's interval never depends
on another's. Counts come in as one row of four integers per utterance. Replicates are dealt over tasks, and a task sums
its draws by numpy steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import COUNTS, mer, wer

PRIME = 2_147_483_647
STEP_R, STEP_I, START = 48_271, 69_621, 16_807


#: Tasks that share a group's replicates, utterances in one row on the way there, and draws that are held at once.
PARTS, CHUNK, DRAWS = 16, 8192, 1 << 18


def _drawn(data: np.ndarray, reps: range, seed: int, stream: int) -> list[list[int]]:
    """Summed counts of replicates: data has a row for each utterance."""
    k, out = len(data), []
    for rep in reps:
        total = np.zeros(data.shape[1], dtype=np.int64)
        for start in range(0, k, DRAWS):
            x = np.arange(start, min(start + DRAWS, k), dtype=np.int64)
            x = (x * STEP_I + (rep * STEP_R + seed + stream * 7_919)) % PRIME
            for _ in range(2):
                x = (x * START + 12_345) % PRIME
            total += data[x % k].sum(axis=0)
        out.append(total.tolist())
    return out


def replicates(buckets: DataFrame, keys: list[str], order: list[str], n_boot: int, seed: int, stream: int = 0) -> DataFrame:
    """keys, rep and summed counts of each replicate. Rows with a null key have none.

    Draws are neither rows nor shuffled: utterances are sorted over all tasks and packed, and each of a group's PARTS tasks
    gets the packed counts, 32 bytes an utterance, and sums its share of the replicates over them.
    """
    n = max(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets.sparkSession.sparkContext.defaultParallelism)
    kept = buckets.dropna(subset=keys).select(*keys, *order, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS))
    # Tasks and rows in them are in order, so what one number of rows has is a stretch of the order.
    placed = kept.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    packed = placed.groupBy(*keys, F.floor(F.col("_at") / CHUNK).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("_at", *COUNTS))).alias("_w"))
    parted = packed.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"), "_chunk", *(F.col(f"_w.{c}").alias(c) for c in COUNTS))
    dealt = parted.repartition(n, *keys, "_part").sortWithinPartitions(*keys, "_part", "_chunk")
    kinds = {f.name: f.dataType for f in buckets.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys) + ", rep long, " + ", ".join(f"{c} long" for c in COUNTS)
    names = [*keys, "rep", *COUNTS]

    def run(batches):
        def summed(key, chunks):
            part = key[-1].as_py()
            reps = range(part, n_boot, PARTS)
            totals = np.array(_drawn(np.concatenate(chunks), reps, seed, stream), dtype=np.int64).reshape(-1, len(COUNTS))
            same = [pa.repeat(v, len(reps)) for v in key[:-1]]
            return pa.RecordBatch.from_arrays([*same, pa.array(reps, pa.int64()), *(pa.array(c) for c in totals.T)], names)

        open_key, chunks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                key = [batch.column(k)[i] for k in (*keys, "_part")]
                if chunks and key != open_key:
                    yield summed(open_key, chunks)
                    chunks = []
                open_key = key
                chunks.append(np.stack([batch.column(c)[i].values.to_numpy() for c in COUNTS], axis=1))
        if chunks:
            yield summed(open_key, chunks)

    return dealt.mapInArrow(run, schema)


def _bounds(values: Column, n_boot: int) -> tuple[Column, Column]:
    lo = int(0.025 * n_boot)
    hi = max(lo, int(0.975 * n_boot) - 1)
    ranked = F.sort_array(F.collect_list(values))
    return F.element_at(ranked, lo + 1), F.element_at(ranked, hi + 1)


def rate_intervals(buckets: DataFrame, keys: list[str], order: list[str], n_boot: int = 2000, seed: int = 1234) -> DataFrame:
    """Order-statistic intervals of the pooled word and match error rates. Groups without utterances have no row."""
    reps = replicates(buckets, keys, order, n_boot, seed)
    four = [F.col(c) for c in COUNTS]
    rated = reps.withColumns({"w": wer(*four), "m": mer(*four)})
    (wl, wh), (ml, mh) = _bounds(F.col("w"), n_boot), _bounds(F.col("m"), n_boot)
    return rated.groupBy(*keys).agg(wl.alias("wer_lo"), wh.alias("wer_hi"), ml.alias("mer_lo"), mh.alias("mer_hi"))


def gap_intervals(true_buckets: DataFrame, sub_buckets: DataFrame, keys: list[str], order: list[str], n_boot: int = 2000, seed: int = 1234) -> DataFrame:
    """Interval and mean of (rate against subtitles - rate against the true reference), each resampled by itself."""
    four = [F.col(c) for c in COUNTS]
    t = replicates(true_buckets, keys, order, n_boot, seed, 1).select(*keys, "rep", wer(*four).alias("t"))
    s = replicates(sub_buckets, keys, order, n_boot, seed, 2).select(*keys, "rep", wer(*four).alias("s"))
    both = t.join(s, [*keys, "rep"]).withColumn("gap", F.col("s") - F.col("t"))
    lo, hi = _bounds(F.col("gap"), n_boot)
    return both.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"), F.avg("gap").alias("mean"))
