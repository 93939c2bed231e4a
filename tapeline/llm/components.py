"""Connected components of a graph given as edges: hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def find(parent: dict, x):
    """Root of x in a union-find forest, with path halving; x joins the forest when new."""
    parent.setdefault(x, x)
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def unite(parent: dict, x, y) -> bool:
    x, y = find(parent, x), find(parent, y)
    if x == y:
        return False
    if y < x:
        x, y = y, x
    parent[y] = x
    return True


def components(edges: DataFrame, scratch: Scratch | None = None, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of edges (a long, b long).

    Each round contracts: every root takes the smallest root that an edge joins it to, chains of roots are cut short by
    jumping, and edges are rewritten to roots, so that edges inside a component vanish and the graph shrinks. Every
    root with an edge hooks or is hooked to, so a round at least halves the roots that have edges. Each
    round's tables are written, so that lineage stays short and lost executors cost one round at most.
    """
    if scratch is None:
        with Scratch(edges.sparkSession) as own:
            return own.keep(components(edges, own, name), name, result=True)
    written: list[str] = []

    def kept(df: DataFrame, what: str) -> DataFrame:
        written.append(f"{name}_{what}")
        return scratch.keep(df, written[-1])

    def clear(but: str) -> None:
        scratch.drop(*(x for x in written if x != f"{name}_{but}"))
        written[:] = [f"{name}_{but}"]

    flat = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = kept(flat, "edges0")
    labels = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node"))
    labels, k = kept(labels, "labels0"), 0
    while not live.isEmpty():
        k += 1
        # Hook: b takes the smallest a. Only the larger end hooks, so there are no cycles.
        hooks = kept(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), f"hooks{k}")
        step, moving = 0, True
        while moving:
            top = hooks.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            jumped = hooks.join(top, "up", "left")
            moved = kept(jumped.select("node", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")), f"hooks{k}_{step}")
            hooks, step, moving = moved.select("node", "up"), step + 1, not moved.where("moved").isEmpty()
        roots = hooks.select(F.col("node").alias("root"), "up")
        labels = kept(labels.join(roots, labels["component"] == roots["root"], "left").select("node", F.coalesce("up", "component").alias("component")), f"labels{k}")
        at_a = roots.select(F.col("root").alias("a"), F.col("up").alias("up_a"))
        at_b = roots.select(F.col("root").alias("b"), F.col("up").alias("up_b"))
        new = live.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("up_a", "a").alias("x"), F.coalesce("up_b", "b").alias("y"))
        new = new.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        live = kept(new, f"edges{k}")
    clear(f"labels{k}")
    return labels
