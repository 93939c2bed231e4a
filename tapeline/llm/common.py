"""Helpers shared by the corpus operators: shared scratch tables, Arrow slicing and bounded training samples."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread

#: ASCII white space of every word and line rule here: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; texts and vectors of one small file are dealt over all cores."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "embeddings") else found


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; where that is unset, a local one, on local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tapeline-"))
            current = spark.sparkContext.getCheckpointDir()
        base = current
    return f"{base}/tapeline-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back: cuts lineage, and survives the loss of executors."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Scratch tables of one operator. All go when the block ends, also by an error, but those that its result reads.

    The latter go when the session's program ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, scratch_dir(spark)
        self.names: set[str] = set()
        self.results: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str, result: bool = False) -> DataFrame:
        (self.results if result else self.names).add(name)
        return store(df, f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            discard(self.spark, f"{self.path}/{name}")

    def __exit__(self, kind, *_) -> None:
        if kind is not None or not self.results:
            discard(self.spark, self.path)
            return
        self.drop(*list(self.names))
        atexit.register(_remove_at_end, self.spark, self.path)


def _remove_at_end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by now
        discard(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of queries whose results are stored: it waits for garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Keys that stand in more than one in this many rows may be broadcast: there can't be more of them than that.
HOT_KEYS = 50_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Left join with a table of distinct keys, whose column `rows` says in how many of the left's `total` rows a key stands.

    The hot keys, fewer than HOT_KEYS whatever the size of the tables, are broadcast; the other rows meet by shuffling,
    where no key has more than one in HOT_KEYS of them. `rows` isn't in the result.
    """
    many = total // HOT_KEYS
    hot, cold = right.where(F.col("rows") > many).drop("rows"), right.where(F.col("rows") <= many).drop("rows")
    first = left.join(F.broadcast(hot.withColumn("_met", F.lit(True))), keys, "left")
    rest = first.where(F.col("_met").isNull()).select(*left.columns).join(cold, keys, "left")
    return first.where("_met").drop("_met").unionByName(rest)


def fold_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(0))


def text_slices(batches, limit: int = 2_000_000, column: str = "text"):
    """Cut Arrow batches into slices of at most `limit` text bytes (a longer text is a slice of its own).

    Yields (slice of the batch, list of bytes; null as b"").
    """
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        first, size = 0, 0
        sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() if v.is_valid else None for v in texts)]
        for i, n in enumerate(sizes):
            if i > first and size + n > limit:
                yield batch.slice(first, i - first), [x or b"" for x in texts.slice(first, i - first).to_pylist()]
                first, size = i, 0
            size += n
        if batch.num_rows > first:
            yield batch.slice(first), [x or b"" for x in texts.slice(first).to_pylist()]


def hashed_windows(text: Column, seed: Column, chars: int, windows: int) -> Column:
    """Texts of up to chars characters whole; of longer ones, that many in windows at places drawn from a hash of seed and number."""
    wide = chars // windows
    place = lambda k: (F.pmod(F.xxhash64(seed, F.lit(k)), F.greatest(F.length(text) - wide, F.lit(0)) + 1) + 1).cast("int")
    return F.when(F.length(text) <= chars, F.array(text)).otherwise(F.array(*(F.substring(text, place(k), F.lit(wide)) for k in range(windows))))


def labelled_ids(labels: DataFrame, label: str, max_per_class: int) -> tuple[DataFrame | None, dict[int, int]]:
    """sample_id and y of at most max_per_class documents of each class, first in the order of a hash of their id; and the count of each class.

    Conflicting labels of one id count as the larger one. The table has at most 2 * max_per_class rows; None without any.
    """
    per_id = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    totals = {r.y: r["count"] for r in per_id.groupBy("y").count().collect()}
    rows = []
    for y in (0, 1):
        rows += per_id.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class).collect()
    if not rows:
        return None, totals
    return labels.sparkSession.createDataFrame([(r.doc_id, r.y) for r in rows], "sample_id long, y int"), totals


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int, train_chars: int, windows: int = 4) -> tuple[list[tuple[list[bytes], int]], dict[int, int]]:
    """A bounded training sample: windows of at most max_per_class documents of each class of `label`; and the count of each class.

    Of each document at most train_chars characters are taken: all, or windows at hashed places of the whole text. The
    bound is the product of these parameters, whatever the size of the corpus. `labels` has doc_id and
    the label, and is already restricted to the rows that may be learnt from. Repeated rows of one id give the smallest windows.
    """
    ids, totals = labelled_ids(labels, label, max_per_class)
    if ids is None:
        return [], totals
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hit = docs.select("doc_id", hashed_windows(text, F.col("doc_id"), train_chars, windows).alias("cuts")).join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id"))
    out = hit.groupBy("sample_id", "y").agg(F.min("cuts").alias("cuts")).collect()
    return [([c.encode() for c in r.cuts], r.y) for r in sorted(out, key=lambda r: r.sample_id)], totals
