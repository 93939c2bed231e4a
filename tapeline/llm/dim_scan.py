"""Approximate nearest neighbours by inner product: inverted lists scanned dimension by dimension.

The largest inner product is the smallest distance after one more coordinate is added: sqrt(M^2 - |x|^2), with M the
largest norm. In that space
1. k-means centroids are fitted in numpy on a bounded sample of train_vectors rows; every vector is put on the list of
   its nearest centroid. Lists are dealt over groups of about group_vectors, neighbouring small lists together and a large
   list over several groups, so that a list that holds a third of all vectors is many tasks.
2. How many lists a query probes follows from the data: the sample's own nearest neighbours are found exactly, and
   the probe share is the least that holds target_recall of them. Clustered vectors need few lists, vectors without any
   structure many.
3. Each query first scans its nearest list. The k-th distance found there bounds its search. It then probes further lists,
   nearest centroid first, but not those whose centroid distance less the list's radius is above that bound.
4. A group takes in its vectors, and its queries once, with the lists that they ask for; vectors are rotated by a random orthogonal
   matrix. Lists are scanned in stretches, by column blocks, for all their queries at once: after d of D dimensions a
   candidate goes when sqrt(D / d) times its partial distance exceeds (1 + epsilon / sqrt(d)) times the query's
   bound, a test whose error probability falls exponentially in epsilon squared. After every stretch the survivors, scored on
   the original vectors in double precision, tighten the bounds of their queries for the next.
5. The best of all groups are ranked.

Lists, radii and centroids are bounded by max_lists; the queries of a group are dealt over blocks of query_block. When fewer
than k candidates lie on the probed lists, a query probes on until they hold more than k, so small tables are searched whole.

Vectors that are null, of another length than the most common one, zero, or with null or non-finite components take no
part. Equal vectors tie and the smaller vec_id comes first. Rows of one vec_id are each candidates of others, never of
themselves; a query vec_id with several vectors asks with the smallest of them. Extra columns aren't read. An empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 16
STRETCH = 1024
#: Floats of distances that a task holds at a time.
PANEL = 1 << 21


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (double array) of rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return good


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)[0]
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and its distance."""
    best, dist = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    half = (centers**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        s = half - part @ centers.T
        best[i : i + 4096] = s.argmin(1)
        dist[i : i + 4096] = np.sqrt(np.maximum(((part - centers[best[i : i + 4096]]) ** 2).sum(1), 0))
    return best, dist


def probe_share_of(x: np.ndarray, near: np.ndarray, centers: np.ndarray, k: int, target_recall: float, queries: int = 256) -> float:
    """The share of lists, nearest centroid first, that holds target_recall of the sample's own k nearest."""
    asked = np.arange(0, len(x), max(1, len(x) // queries))
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    gap = (x**2).sum(1)[:, None] - 2 * x @ x[asked].T
    gap[asked, np.arange(len(asked))] = np.inf
    top = np.argpartition(gap, k - 1, axis=0)[:k].T
    order = np.argsort((centers**2).sum(1)[None] / 2 - x[asked] @ centers.T, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centers))[None], 1)
    ranks = np.take_along_axis(place, near[top], 1)
    return float(np.quantile(ranks, target_recall, method="higher") + 1) / len(centers)


def groups_of(size: np.ndarray, centers: np.ndarray, group_vectors: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each list, and over how many groups its vectors are dealt. Small lists that lie side by side share one."""
    parts = np.maximum(1, -(-size // group_vectors))
    middle = centers - centers.mean(0)
    axis = np.linalg.svd(middle, full_matrices=False)[2][0] if len(centers) > 1 else np.ones(centers.shape[1])
    first = np.zeros(len(size), dtype=np.int64)
    group, held = 0, 0
    for i in np.argsort(middle @ axis, kind="stable"):
        if parts[i] > 1:
            continue
        if held and held + size[i] > group_vectors:
            group, held = group + 1, 0
        first[i] = group
        held += size[i]
    group += 1
    for i in np.flatnonzero(parts > 1):
        first[i] = group
        group += int(parts[i])
    return first, parts


class Best:
    """The k best scores of each query of a task, and the squared distances that they allow."""

    def __init__(self, queries: int, k: int, bound2: np.ndarray, shift: np.ndarray):
        self.k, self.bound2, self.shift = k, bound2.copy(), shift
        self.score, self.row = np.full((queries, k), -np.inf), np.full((queries, k), -1, dtype=np.int64)

    def take(self, at: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows for queries at (sorted). Ties go to the smaller id."""
        asked, first, n = np.unique(at, return_index=True, return_counts=True)
        wide = int(n.max())
        score, row = np.full((len(asked), self.k + wide), -np.inf), np.full((len(asked), self.k + wide), -1, dtype=np.int64)
        score[:, : self.k], row[:, : self.k] = self.score[asked], self.row[asked]
        line, place = np.repeat(np.arange(len(asked)), n), self.k + np.arange(len(at)) - np.repeat(first, n)
        score[line, place], row[line, place] = scores, rows
        order = np.lexsort((np.where(row >= 0, ids[row], np.iinfo(np.int64).max), -score), axis=1)[:, : self.k]
        self.score[asked], self.row[asked] = np.take_along_axis(score, order, 1), np.take_along_axis(row, order, 1)
        # |q - x|^2 = |q|^2 + M^2 - 2 <q, x>, so the k-th score bounds the distance.
        self.bound2[asked] = np.minimum(self.bound2[asked], self.shift[asked] - 2 * self.score[asked, -1])


def scan(best: Best, asked: np.ndarray, q: np.ndarray, q_original: np.ndarray, x: np.ndarray, x_original: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, epsilon: float) -> int:
    """Scan rows (of one list) for the queries `asked`; returns the multiplications done. q and x are rotated. own: each query's vec_id."""
    dims, work = q.shape[1], 0
    for low in range(0, len(rows), STRETCH):
        part = rows[low : low + STRETCH]
        for begin in range(0, len(asked), max(1, PANEL // len(part))):
            at = asked[begin : begin + max(1, PANEL // len(part))]
            bound2 = best.bound2[at]
            pairs = None
            partial = np.zeros((len(at), len(part)))
            seen = 0
            while seen < dims:
                width = min(BLOCK, dims - seen)
                a, b = q[at, seen : seen + width], x[part, seen : seen + width]
                if pairs is None:
                    partial += (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)
                    work += partial.size * width
                else:
                    partial += ((a[pairs[0]] - b[pairs[1]]) ** 2).sum(1)
                    work += len(partial) * width
                seen += width
                limit = np.maximum(bound2, 0) * seen / dims * ((1 + epsilon / math.sqrt(seen)) ** 2 if seen < dims else 1 + 1e-6) + 1e-9
                if pairs is None:
                    stay = partial <= limit[:, None]
                    if seen == dims or np.count_nonzero(stay) * 8 < stay.size:
                        pairs = np.nonzero(stay)
                        partial = partial[pairs]
                else:
                    stay = partial <= limit[pairs[0]]
                    pairs, partial = (pairs[0][stay], pairs[1][stay]), partial[stay]
                if pairs is not None and not len(partial):
                    break
            one, other = at[pairs[0]], part[pairs[1]]
            fine = ids[other] != own[one]
            one, other = one[fine], other[fine]
            if len(one):
                # Row by row, so that equal vectors score alike to the last bit.
                score = np.concatenate([(x_original[other[i : i + 65536]] * q_original[one[i : i + 65536]]).sum(1) for i in range(0, len(one), 65536)])
                best.take(one, other, score, ids)
    return work


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", train_vectors: int = 20_000, max_lists: int = 2500, group_vectors: int = 32_768, query_block: int = 20_000, target_recall: float = 0.98, epsilon: float = 2.1, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    all_good = usable(vectors, id_col, vec_col).withColumn("dim", F.size("v"))
    dims = all_good.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m2")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, n, m2 = dims.dim, dims.n, dims.m2
    good = all_good.where(F.col("dim") == dim).select("vec_id", "v")
    lists = int(min(max_lists, max(1, round(math.sqrt(n)))))
    full = dim + 1
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(full, full)))[0]

    def lifted(v: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors of the space where distance orders inner products."""
        extra = np.zeros((len(v), 1)) if query else np.sqrt(np.maximum(m2 - (v**2).sum(1), 0))[:, None]
        return np.hstack((v, extra)) @ rotation

    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = good.where(draw < int(min(1.0, 1.5 * train_vectors / n) * (1 << 30))).limit(train_vectors).select("v").toArrow()["v"].combine_chunks()
    trained = lifted(_matrix(sample, dim)) if len(sample) else np.zeros((1, full))
    centers = kmeans(trained, lists, seed=seed)
    lists = len(centers)
    probe_share = probe_share_of(trained, nearest(trained, centers)[0], centers, k, target_recall)

    def assign(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            if len(v):
                near, dist = nearest(lifted(v), centers)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(dist)], ["vec_id", "v", "list", "dist"])

    with Scratch(spark) as scratch:
        index = scratch.keep(good.mapInArrow(assign, "vec_id long, v array<double>, list int, dist double"), "index")
        facts = {r.list: (r.n, r.radius) for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}  # max_lists rows at most
        size = np.array([facts.get(i, (0, 0.0))[0] for i in range(lists)])
        radius = np.array([facts.get(i, (0, 0.0))[1] for i in range(lists)])
        group, parts = groups_of(size, centers, group_vectors)
        places = F.broadcast(spark.createDataFrame([(i, int(group[i]), int(parts[i])) for i in range(lists)], "list int, first int, parts int"))
        dealt = index.join(places, "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int").alias("group"), "list", "vec_id", "v")

        def routes(first: bool):
            """Rows (query, group, lists asked for there): the nearest list that isn't empty, or the further ones."""
            def run(batches):
                for batch in batches:
                    v = _matrix(batch.column("v"), dim)
                    if not len(v):
                        continue
                    q = lifted(v, query=True)
                    d = np.sqrt(np.maximum(((q**2).sum(1)[:, None] - 2 * q @ centers.T + (centers**2).sum(1)), 0))
                    d[:, size == 0] = np.inf
                    order = np.argsort(d, axis=1, kind="stable")
                    bound = None if first else batch.column("bound").to_numpy(zero_copy_only=False)
                    at, to, wanted = [], [], []
                    for i, row in enumerate(order):
                        row = row[np.isfinite(d[i, row])]
                        if first:
                            row = row[:1]
                        else:
                            least = int(np.searchsorted(np.cumsum(size[row]), k + 1)) + 1  # lists that hold more than k vectors
                            near = (d[i, row] - radius[row] <= bound[i] * (1 + 1e-9)) | (np.arange(len(row)) < least)
                            row = row[: max(least, math.ceil(probe_share * lists))]
                            row = row[near[: len(row)]][1:]
                        by_group: dict[int, list[int]] = {}
                        for one in row.tolist():
                            for part in range(int(parts[one])):
                                by_group.setdefault(int(group[one]) + part, []).append(one)
                        at += [i] * len(by_group)
                        to += by_group
                        wanted += by_group.values()
                    if at:
                        picked = batch.take(pa.array(at, pa.int64()))
                        b = pa.array(np.full(len(at), np.inf)) if first else picked.column("bound")
                        yield pa.RecordBatch.from_arrays([picked.column("query_id"), picked.column("v"), b, pa.array(to, pa.int32()), pa.array(wanted, pa.list_(pa.int32()))], ["query_id", "q", "bound", "group", "lists"])
            return run

        def scanned(probes: DataFrame, name: str) -> DataFrame:
            """The k best of each (query, group): queries and vectors of a group meet in one task.

            Queries of a group are dealt over blocks too, as many as their count asks for, so a task is bounded on both sides.
            """
            probes = scratch.keep(probes, f"{name}_probes")
            blocks = probes.groupBy("group").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))  # a row for each group
            asked = probes.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
            met = dealt.join(blocks, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

            def run(key, queries, rows):
                names = ["query_id", "vec_id", "score"]
                if not (rows.num_rows and queries.num_rows):
                    return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
                ids, list_of = rows.column("vec_id").to_numpy(), rows.column("list").to_numpy()
                v = _matrix(rows.column("v").combine_chunks(), dim)
                x = lifted(v)
                qv = _matrix(queries.column("q").combine_chunks(), dim)
                q, own = lifted(qv, query=True), queries.column("query_id").to_numpy()
                best = Best(len(own), k, queries.column("bound").to_numpy() ** 2, (qv**2).sum(1) + m2)
                wanted = queries.column("lists").combine_chunks()
                asked_list, asked_by = wanted.flatten().to_numpy(), np.repeat(np.arange(len(own)), np.diff(wanted.offsets.to_numpy()))
                by_list = np.argsort(list_of, kind="stable")
                edges = np.searchsorted(list_of[by_list], np.arange(lists + 1))
                for one in np.unique(asked_list).tolist():
                    part = by_list[edges[one] : edges[one + 1]]
                    if len(part):
                        scan(best, np.sort(asked_by[asked_list == one]), q, qv, x, v, part, ids, own, epsilon)
                at, place = np.nonzero(best.row >= 0)
                return pa.table({"query_id": pa.array(own[at]), "vec_id": pa.array(ids[best.row[at, place]]), "score": pa.array(best.score[at, place])})

            left = asked.groupBy("group", "block").cogroup(met.groupBy("group", "block"))
            return left.applyInArrow(run, "query_id long, vec_id long, score double")

        def ranked(rows: DataFrame) -> DataFrame:
            order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        queries = scratch.keep(index.where(is_query).select(F.col("vec_id").alias("query_id"), "v").groupBy("query_id").agg(F.min("v").alias("v")), "queries")
        probe_schema = "query_id long, q array<double>, bound double, group int, lists array<int>"
        near = scratch.keep(ranked(scanned(queries.mapInArrow(routes(True), probe_schema), "near")), "near")
        # Fewer than k found leave no bound.
        kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        q2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        bound = F.when(F.col("n") >= k, F.sqrt(F.greatest(q2 + m2 - 2 * F.col("least"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
        rest = queries.join(kth, "query_id", "left").select("query_id", "v", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
        far = scanned(rest.mapInArrow(routes(False), probe_schema), "far")
        both = near.select("query_id", "vec_id", "score").unionByName(far)
        found = ranked(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        return scratch.keep(found, "result", result=True)
