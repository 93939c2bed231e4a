"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct word shingles (64-bit hashes of 64-bit word hashes). Two documents link when the
Jaccard similarity of their sets is at least percent / 100. Links are found exactly, up to such hashes, in five steps.
T(n) is the least overlap that a set of n shingles has with any partner: percent / 100 of n, rounded up.

1. Documents with equal sets form a class (128-bit digest); only its smallest doc_id goes on.
2. T-occurrence bound on prefixes. In one global order (by hash), linked sets share some t shingles within the first
   n - T(n) + t of each. Every set shows such a prefix, with t an eighth of its size; shingles that stand in the prefixes
   of several classes are counted, by one aggregation over the corpus, and a set goes on only if as many of its own are
   among them as its smallest partner would share. Passages that many documents hold don't pair them: they add to a
   count, and no list of a shingle's documents is ever built.
3. The same bound on whole sets, for those that are left: T(n) of a set's shingles stand in other sets that are left.
4. Search. Sets that share a shingle of their shortest prefix, in an order that puts shingles that few sets hold first,
   are joined to candidate components. Each is one task:
   inverted lists over its sets, and for each set (by size) the T-occurrence problem: which earlier sets stand on at
   least T of its lists? Its longest lists, at most T - 1, are set aside; the short ones are merged and sets on at least
   T - L of them remain; these are probed by binary search in the L long lists. Pairs already joined by other links
   aren't probed. A component of more than block_tokens shingles is cut into blocks of like size that each hold the
   same few pivots too, which joins the blocks of a group of near copies; then only the sets that aren't joined to the
   component's largest group are searched against all its blocks.
5. Components of the links.

Null, empty and wordless texts have no shingle and link with nothing. A text with fewer words than a shingle is one
shingle. Rows with a null doc_id have a null component and join nothing. Rows of one doc_id are one document, also
if their texts differ. Ties and repeated rows: equal rows get equal results. Very long texts are read whole, one at a
time. Extra columns aren't read by near_duplicates and links, and pass through one_of_each, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, free_shuffles, join_counted, text_slices
from .components import components
from .textbytes import mix

_U = np.uint64
#: Rows of three numbers that may be broadcast: some 10 MB.
BROADCAST_ROWS = 250_000
PIVOTS = 8


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. bytes.lower() folds A-Z only, bytes.split() cuts at ASCII blanks."""
    split = [t.lower().split() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in split])))
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in split for w in ws), dtype=_U, count=int(bounds[-1]))
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, dtype=_U)
    for k in range(width):
        rolled = mix(rolled * _U(0x9E3779B97F4A7C15) + words[k : k + n] + _U(k))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=_U)
            for k in range(a, b):
                whole = mix((whole + words[k : k + 1]) * _U(0xC2B2AE3D27D4EB4F))
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shown(n: int, percent: int) -> int:
    """t of a set of n shingles: what it shares, within its prefix, with a partner that isn't smaller."""
    return min(least_overlap(n, percent), 1 + n // 8)


def prefix(s: np.ndarray, percent: int) -> np.ndarray:
    n = len(s)
    return s[: n - least_overlap(n, percent) + shown(n, percent)] if n else s


def _least_overlap(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("long")


def _shown(n: Column, percent: int) -> Column:
    return F.least(_least_overlap(n, percent), 1 + F.floor(n / 8)).cast("long")


def linked(common: np.ndarray | int, a: int, b: np.ndarray | int, percent: int):
    return (100 + percent) * common >= percent * (a + b)


PROBED_LISTS = 16


def search(ids: list[int], sets: list[np.ndarray], percent: int, sides: list[int] | None = None, short_list: int = 8, every: bool = False):
    """Links (x, y) of the sets of one task: those needed for a union, or every one. sides: only pairs across 0 and 1."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by_token = np.argsort(tokens, kind="stable")  # owners ascend within a list
    listed, posted = tokens[by_token], owner[by_token]
    begin = np.flatnonzero(np.concatenate(([True], listed[1:] != listed[:-1])))
    length = np.diff(np.append(begin, len(listed)))
    list_no = np.repeat(np.arange(len(begin)), length)
    list_of = np.empty(len(tokens), dtype=np.int64)
    list_of[by_token] = list_no
    postings = list_no * len(order) + posted  # all lists behind one another: ascending, so one binary search probes any
    ends = np.cumsum(sizes)
    side = None if sides is None else np.array(sides)[order]
    named = np.array([ids[i] for i in order])
    group = np.unique(named, return_inverse=True)[1]  # the component of each set so far; rows of one id are one from the start

    def confirmed(x: int, others: np.ndarray, counts: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Which of the candidates reach the overlap. Long lists are probed some at a time; a candidate that can't reach it any more leaves."""
        need = -(-percent * (sizes[x] + sizes[others]) // (100 + percent))
        at, counts = np.arange(len(others)), counts.copy()
        for k in range(0, len(long), PROBED_LISTS):
            at = at[counts[at] + len(long) - k >= need[at]]
            if not len(at):
                break
            probes = long[k : k + PROBED_LISTS, None] * len(order) + others[at]
            place = np.minimum(np.searchsorted(postings, probes), len(postings) - 1)
            counts[at] += (postings[place] == probes).sum(0)
        return counts >= need

    for x in range(len(order)):
        mine = list_of[ends[x] - sizes[x] : ends[x]]
        shared = mine[length[mine] > 1]
        need = least_overlap(int(sizes[x]), percent)
        if len(shared) < need:
            continue
        shared = shared[np.argsort(length[shared], kind="stable")]
        n_long = min(need - 1, int((length[shared] > short_list).sum()))
        short, long = shared[: len(shared) - n_long], shared[len(shared) - n_long :]
        # The short lists behind one another are ascending runs, which the stable sort merges as they stand.
        n = length[short]
        at = np.repeat(begin[short] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        found = posted[at]
        found = np.sort(found[found < x], kind="stable")
        if not len(found):
            continue
        edge = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        others, counts = found[edge], np.diff(np.append(edge, len(found)))
        # A set of b shingles needs more than T when b is larger than its least; sizes below percent can't link.
        fits = (counts >= need - n_long) & linked(sizes[others], int(sizes[x]), sizes[others], percent) & (named[others] != named[x])
        if side is not None:
            fits &= side[others] != side[x]
        others, counts = others[fits], counts[fits]
        if every:
            yield from ((int(named[x]), int(named[y])) for y in others[confirmed(x, others, counts, long)])
            continue
        # One link joins a whole component, so its likeliest members are probed first, more of them in each turn.
        turn = 1
        while True:
            apart = group[others] != group[x]
            others, counts = others[apart], counts[apart]
            if not len(others):
                break
            likely = np.lexsort((-counts, group[others]))
            others, counts = others[likely], counts[likely]
            opens = np.concatenate(([True], group[others][1:] != group[others][:-1]))
            rank = np.arange(len(others)) - np.maximum.accumulate(np.where(opens, np.arange(len(others)), 0))
            now = rank < turn
            for y in others[now][confirmed(x, others[now], counts[now], long)].tolist():
                if group[x] != group[y]:
                    group[group == group[y]] = group[x]
                    yield int(named[x]), int(named[y])
            others, counts, turn = others[~now], counts[~now], turn * 4


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sets(docs: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, set size, two hashes of the set, and its prefix or all its shingles in ascending order, of every row."""
    def run(batches):
        for part, texts in text_slices(batches):
            sets = shingle_sets(texts, width)
            sums = [np.array([s.sum(dtype=_U), mix(s).sum(dtype=_U)], dtype=_U).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), _lists(sets if whole else [prefix(s, percent) for s in sets])],
                ["doc_id", "n_shingles", "d1", "d2", "tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, tokens array<long>")


def _met(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """row, token, rows: the tokens of rows (row, d1, tokens, ...) that stand in a row of another class too, and in how many rows they stand.

    Tokens that stand in more than one in HOT_KEYS of the places are known on the map side; no other is hot in the join.
    """
    spread = rows.select("row", "d1", F.explode("tokens").alias("token"))
    total = rows.agg(F.sum(F.size("tokens"))).first()[0] or 0
    seen = spread.groupBy("token").agg(F.count("*").alias("rows"), F.min("d1").alias("lo"), F.max("d1").alias("hi"))
    shared = F.col("lo") != F.col("hi")
    several = scratch.keep(seen.where(shared | (F.col("rows") > total // HOT_KEYS)).select("token", "rows", F.col("rows").alias("among"), shared.alias("shared")), name)
    free_shuffles(rows.sparkSession)
    return join_counted(spread.select("row", "token"), several, ["token"], total).where("shared").select("row", "token", F.col("among").alias("rows"))


def _well_shared(rows: DataFrame, least: Column, scratch: Scratch, name: str) -> DataFrame:
    """Rows with at least `least` such tokens, without their tokens."""
    enough = _met(rows, scratch, f"{name}_tokens").groupBy("row").agg(F.count("*").alias("met"))
    found = scratch.keep(rows.drop("tokens").join(enough, "row").where(F.col("met") >= least).drop("met"), name)
    free_shuffles(rows.sparkSession)
    scratch.drop(f"{name}_tokens")
    return found


def _postings(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node, token, row: the shortest prefix of each set that passes the bound, in the order of how few sets hold a shingle.

    Linked sets share a shingle of these prefixes as of any global order's; in this one it's seldom part of a passage
    that other groups share. Shingles that one set holds come first: they only count.
    """
    met = _met(sets, scratch, "postings_tokens").join(sets.select("row", F.col("doc_id").alias("node"), "n_shingles"), "row")
    least = _least_overlap(F.col("n_shingles"), percent)
    ranked = met.withColumns({"met": F.count("*").over(W.partitionBy("row")), "place": F.row_number().over(W.partitionBy("row").orderBy("rows", "token"))})
    kept = ranked.where((F.col("met") >= least) & (F.col("place") <= F.col("met") - least + 1))
    found = scratch.keep(kept.select("node", "token", "row"), "postings")
    free_shuffles(sets.sparkSession)
    return found


def _edges(postings: DataFrame) -> DataFrame:
    """Edges (a, b) that join all documents that share a token.

    Documents of a token are joined to the smallest of their block, and these to the smallest of all; only tokens
    that stand in many places have several blocks.
    """
    total = postings.count()
    many = max(total // HOT_KEYS, 1000)
    hot = postings.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > many)
    hot = hot.select("token", F.ceil(F.col("rows") / many).cast("int").alias("blocks"))  # fewer than HOT_KEYS rows
    dealt = postings.select("node", "token").join(F.broadcast(hot), "token", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))).drop("blocks")
    heads = dealt.groupBy("token", "block").agg(F.min("node").alias("head"), F.max("node").alias("tail"))
    stars = dealt.join(heads.where(F.col("head") != F.col("tail")).drop("tail"), ["token", "block"]).select(F.col("head").alias("a"), F.col("node").alias("b"))
    tops = heads.groupBy("token").agg(F.min("head").alias("a"), F.max("head").alias("last")).where(F.col("a") != F.col("last")).drop("last")
    return stars.unionByName(heads.join(tops, "token").select("a", F.col("head").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def _task(*parts: str) -> Column:
    return F.xxhash64(*(F.col(p).cast("long") for p in parts))


def _dealt(members: DataFrame, percent: int, block_tokens: int, scratch: Scratch, name: str) -> DataFrame:
    """members of large components with level (their class of like sizes), block in it, and the blocks of the level."""
    total = members.groupBy("component").agg(F.sum("n_shingles").alias("total")).where(F.col("total") > block_tokens).drop("total")
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    large = members.join(total, "component").withColumn("level", level)
    blocks = large.groupBy("component", "level").agg(F.ceil(F.sum("n_shingles") / block_tokens).cast("int").alias("blocks"))
    return scratch.keep(large.join(blocks, ["component", "level"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))), name)


def _first_tasks(members: DataFrame, large: DataFrame) -> DataFrame:
    """row, task, side: a small component is a task; of a large one each block is, with pivots of its and the next levels."""
    small = members.join(large.select("component").distinct(), "component", "left_anti").select("row", _task("component").alias("task"))
    own = large.select("row", _task("component", "level", "block").alias("task"))
    pivots = large.withColumn("place", F.row_number().over(W.partitionBy("component", "level").orderBy(F.xxhash64(F.lit(3), F.col("row")), "row"))).where(F.col("place") <= PIVOTS)
    spread = pivots.select("row", "component", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"))
    targets = large.select("component", "level", "blocks").distinct()
    copies = spread.join(targets, ["component", "level"]).select("row", "component", "level", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return small.unionByName(own).unionByName(copies.select("row", _task("component", "level", "block").alias("task"))).distinct().withColumn("side", F.lit(-1))


def _second_tasks(large: DataFrame, joined: DataFrame, block_tokens: int) -> DataFrame:
    """row, task, side: documents that aren't joined to their component's largest group (0), against all its blocks (1)."""
    grouped = large.join(joined.select(F.col("node").alias("doc_id"), F.col("component").alias("group")), "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id"))
    sizes = grouped.groupBy("component", "group").agg(F.count("*").alias("n"))
    main = sizes.groupBy("component").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
    rest = grouped.join(main, "component").where(F.col("group") != F.col("main")).drop("block", "blocks")
    cuts = rest.groupBy("component", "level").agg(F.ceil(F.sum("n_shingles") / block_tokens).cast("int").alias("cuts"))
    asked = rest.join(cuts, ["component", "level"]).withColumn("cut", F.pmod(F.xxhash64(F.lit(5), F.col("row")), F.col("cuts")))
    near = lambda df: df.withColumn("other", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)))
    key = ("component", "level", "cut", "other", "block")
    targets = large.select("component", F.col("level").alias("other"), "blocks").distinct()
    left = near(asked).join(targets, ["component", "other"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sources = asked.select("component", "level", "cuts").distinct()
    right = large.select("row", "component", F.col("level").alias("other"), F.col("block").cast("int").alias("block"))
    right = near(sources).join(right, ["component", "other"]).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    side = lambda df, n: df.select("row", _task(*key).alias("task"), F.lit(n).alias("side"))
    return side(left, 0).unionByName(side(right, 1))


def _links(sets: DataFrame, tasks: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Search every task. Its sets arrive together and are held one task at a time."""
    if tasks.count() <= BROADCAST_ROWS:
        tasks = F.broadcast(tasks)

    def run(batches):
        ids, held, sides, now = [], [], [], None

        def close():
            out = list(search(ids, held, percent, None if all(x < 0 for x in sides) else sides, every=every)) if len(ids) > 1 else []
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column("tokens")
            flat, offsets = lists.values.to_numpy().view(_U), lists.offsets.to_numpy()
            for k, (task, doc, side) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("task", "doc_id", "side")), strict=True)):
                if task != now:
                    yield from close()
                    ids, held, sides, now = [], [], [], task
                ids.append(doc)
                held.append(flat[offsets[k] : offsets[k + 1]])
                sides.append(side)
        yield from close()

    rows = sets.join(tasks, "row").select("task", "doc_id", "side", "tokens")
    return rows.repartition("task").sortWithinPartitions("task", "doc_id").mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every row with its set's size, digest and prefix; and the classes of equal sets with their smallest doc_id and their rows."""
    rows = scratch.keep(_sets(docs, width, percent, whole=False).withColumn("row", F.monotonically_increasing_id()), "rows")
    whole = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = whole.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    return rows, scratch.keep(classes, "classes")


def _class_links(docs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int, block_tokens: int, scratch: Scratch, every: bool = False) -> DataFrame:
    """Links (a, b) between the smallest documents of classes."""
    key = ["d1", "d2", "n_shingles"]
    whole = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select("row", "doc_id", *key, "tokens")
    n = F.col("n_shingles")
    live = _well_shared(whole, _shown(_least_overlap(n, percent), percent), scratch, "live")
    reps = scratch.keep(live.groupBy(*key).agg(F.min("doc_id").alias("doc_id")), "reps")
    few = reps.count() <= BROADCAST_ROWS
    ids, exact = reps.select("doc_id").distinct(), reps
    if few:
        ids, exact = F.broadcast(ids), F.broadcast(exact)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    made = _sets(texts, width, percent, whole=True).join(exact, ["doc_id", *key], "left_semi")
    made = made.groupBy("doc_id", *key).agg(F.first("tokens").alias("tokens"))
    sets = scratch.keep(made.withColumn("row", F.monotonically_increasing_id()), "sets")
    left = _well_shared(sets, _least_overlap(n, percent), scratch, "left")
    sets = scratch.keep(sets.join(left.select("row"), "row", "left_semi"), "sets_left")
    candidates = components(_edges(_postings(sets, percent, scratch)), scratch, "candidates")
    free_shuffles(docs.sparkSession)
    light = sets.select("row", "doc_id", "n_shingles")
    members = scratch.keep(light.join(candidates, F.col("doc_id") == F.col("node")).drop("node"), "members")
    large = _dealt(members, percent, block_tokens, scratch, "large")
    tasks = scratch.keep(_first_tasks(members, large), "tasks1")
    links = scratch.keep(_links(sets, tasks, percent, every), "links1")
    if not large.isEmpty():
        joined = components(links, scratch, "joined")
        tasks = scratch.keep(_second_tasks(large, joined, block_tokens), "tasks2")
        links = links.unionByName(scratch.keep(_links(sets, tasks, percent, every), "links2"))
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block_tokens: int = 500_000) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row of docs."""
    spark = docs.sparkSession
    key = ["d1", "d2", "n_shingles"]
    with Scratch(spark) as scratch:
        rows, classes = _classes(docs, width, percent, scratch)
        links = _class_links(docs, rows, classes, width, percent, block_tokens, scratch)
        # Rows of one doc_id with several texts link their classes.
        whole = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select("doc_id", *key)
        several = whole.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
        held = whole.join(several, "doc_id", "left_semi").distinct().join(classes, key).select("doc_id", "rep").distinct()
        same_id = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
        found = components(links.unionByName(same_id), scratch, "found")
        labeled = classes.join(found, F.col("rep") == F.col("node"), "left").select(*key, "rows", F.coalesce("component", "rep").alias("class_component"))
        total = classes.agg(F.sum("rows")).first()[0] or 0
        out = join_counted(rows.select("doc_id", *key), labeled, key, total)
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.col("doc_id")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_component")).alias("component_id"))
        return scratch.keep(out, "result", result=True)


def links(docs: DataFrame, width: int = 5, percent: int = 80, block_tokens: int = 1 << 62) -> tuple[DataFrame, DataFrame]:
    """Every link: pairs (a, b) of class representatives, and membership (doc_id, class_id) of every document with shingles.

    All pairs of a candidate component are looked at in one task, so this is for corpora without very large groups.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows, classes = _classes(docs, width, percent, scratch)
        pairs = _class_links(docs, rows, classes, width, percent, block_tokens, scratch, every=True)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        member = rows.where(F.col("doc_id").isNotNull()).join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", F.col("rep").alias("class_id")).distinct()
        return scratch.keep(pairs, "pairs", result=True), scratch.keep(member, "member", result=True)


def one_of_each(docs: DataFrame, **rule) -> DataFrame:
    """One row of the smallest doc_id of each group; rows without id, and documents without shingles, all stay.

    Of several rows of that doc_id the one with the longest text stays, of equally long ones the first in text order.
    """
    found = near_duplicates(docs, **rule).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("component"), F.max("n_shingles").alias("n"))
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("body"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    both = packed.join(found.withColumnRenamed("doc_id", "id"), "id", "left")
    alone = F.col("component").isNull() | (F.col("n") == 0)
    chosen = both.where(~alone & (F.col("component") == F.col("id")))
    first = W.partitionBy("id").orderBy(F.char_length("body").desc_nulls_last(), "body")
    chosen = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") == 1)
    return both.where(alone).select("row").unionByName(chosen.select("row")).select("row.*")
