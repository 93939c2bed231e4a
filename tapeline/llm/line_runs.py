"""Line dedup, native: levelled sorted runs of line hashes.

An index of line keys lives in sorted runs on shared storage. Each new batch of documents is reduced to its keys
(with the number of lines and of documents that hold a key and the largest id among them), merge-anti-joined with every run to
find the keys that no run knows, and added as a run of its own at level 0. Keys that some run knows already add
to the counts in a small delta beside the run. When a level holds `fanout` runs, they are merged into one run of the
next level, so a key is rewritten once for each level, and a batch meets few runs. Runs are bucketed by hash, one sorted file
for each bucket: the anti-joins move the batch, not the runs, and a compaction is merge joins of runs, bucket by bucket, without
any shuffle.

Keys are 128 bits of xxhash64 over the stripped line with A-Z lower-cased. Only keys of min_chars code points count.
A key found in min_docs documents or more loses all its lines but those of the largest doc_id that holds it.

Null and empty texts are one empty line, never dropped. Rows with a null doc_id don't count as documents and never
are the largest; they lose lines of such keys. Repeated rows of one doc_id are one document in the counts, and each
row is cleaned; all lines of a key in its largest doc_id stay. Very long texts are split and joined as arrays, whole. Extra columns pass
through clean() untouched, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, discard, join_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
COUNTS = ["n_lines", "n_docs", "max_doc"]
#: Bits of the bitmap of documents that lose lines: 16 for each of them, but no more than this, 32 MB, is broadcast.
FILTER_BITS = 1 << 28
#: Bits of one row of that bitmap, as bitmap_construct_agg makes them.
ROW_BITS = 32_768


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space, A-Z lower-cased; plain ASCII takes the faster function."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, place and key hashes of every line whose key is long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    keys = lines.where(F.octet_length("line") >= min_chars).select("doc_id", "text_hash", "place", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select("doc_id", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def batch_keys(lines: DataFrame) -> DataFrame:
    """Keys of a batch: lines and documents that hold them and the largest id. Both steps combine before they shuffle."""
    per_doc = lines.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy(*KEY).agg(F.sum("n").alias("n_lines"), F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))


class LineRuns:
    """The levelled index: unknown() gives the keys of a batch that no run knows, add() takes a batch in.

    A context: its tables go when the block ends, also by an error.
    """

    def __init__(self, spark: SparkSession, place: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.place, self.fanout = spark, place, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.deltas: list[str] = []
        self.written: set[str] = set()
        self.tag = uuid.uuid4().hex

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self._drop(list(self.written))
        self.levels, self.deltas = [], []

    @contextlib.contextmanager
    def _sorted_scans(self):
        """Let scans of runs say that a bucket, one file, is sorted: joins then merge without sorting again."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _write(self, keys: DataFrame, dealt: bool = False) -> str:
        """A run of keys; dealt: rows of a bucket are in one partition already."""
        name = f"line_run_{self.tag}_{uuid.uuid4().hex}"
        self.written.add(name)
        keys = keys.select(*KEY, *COUNTS)
        keys = keys if dealt else keys.repartition(self.buckets, *KEY)
        keys.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.place}/{name}").saveAsTable(name)
        return name

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unknown(self, keys: DataFrame) -> DataFrame:
        for name in self._runs():
            keys = keys.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        known = bool(self._runs())
        with self._sorted_scans():
            run = self._write(self.unknown(keys))
            if known:
                self.deltas.append(self._write(keys.join(self.spark.table(run).hint("merge"), KEY, "left_anti")))
        self._push(0, run)

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            one = self._compacted(self.levels[level] + self.deltas)
            self.levels[level], self.deltas = [], []
            self._push(level + 1, one)

    def _compacted(self, names: list[str]) -> str:
        """One run of several: pairs of runs are merged, then pairs of the results."""
        while len(names) > 1:
            merged = []
            for a, b in zip(names[::2], names[1::2]):
                with self._sorted_scans():
                    left = self.spark.table(a).hint("merge").select(*KEY, *(F.col(c).alias(f"{c}_a") for c in COUNTS))
                    right = self.spark.table(b).select(*KEY, *(F.col(c).alias(f"{c}_b") for c in COUNTS))
                    both = left.join(right, KEY, "full")
                    total = lambda c: (F.coalesce(F.col(f"{c}_a"), F.lit(0)) + F.coalesce(F.col(f"{c}_b"), F.lit(0))).alias(c)
                    merged.append(self._write(both.select(*KEY, total("n_lines"), total("n_docs"), F.greatest("max_doc_a", "max_doc_b").alias("max_doc")), dealt=True))
                self._drop([a, b])
            names = merged + names[len(names) // 2 * 2 :]
        return names[0]

    def totals(self) -> DataFrame:
        """The counts of all keys: everything is compacted into one run."""
        names = self._runs() + self.deltas
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_lines long, n_docs long, max_doc long")
        one = self._compacted(names)
        self.levels, self.deltas = [[one]], []
        return self.spark.table(one)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, f"{self.place}/{name}")
            self.written.discard(name)


def dropped_places(docs: DataFrame, scratch: Scratch, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """doc_id, text_hash and the sorted places of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    intake = scratch.keep(keyed_lines(docs, min_chars).withColumn("batch", F.pmod(F.hash("doc_id"), F.lit(batches))), "intake")
    with LineRuns(spark, scratch.path, fanout) as index:
        for b in range(batches):
            index.add(batch_keys(intake.where(F.col("batch") == b)))
        common = scratch.keep(index.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "max_doc", F.col("n_lines").alias("rows"), F.lit(True).alias("common")), "common")
    # A key may be on a third of all lines: such keys are known on the map side.
    met = join_counted(intake.select("doc_id", "text_hash", "place", *KEY), common, KEY, intake.count())
    gone = met.where(F.col("common") & ~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    return scratch.keep(gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("places")), "places", result=True)


def _parted(packed: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of packed (id, hash) that are surely not in right (at, of), and all others: those in it and a few besides.

    A bitmap of bounded size over a hash of both numbers tells them apart. A row whose bit another one has set is among the others, so a full
    bitmap costs moves, not results.
    """
    bits = min(FILTER_BITS, 16 * max(right.count(), 1))
    spot = lambda a, b: F.pmod(F.xxhash64(F.col(a), F.col(b)), F.lit(bits))
    part = lambda df: df.withColumns({"part": F.floor(F.col("spot") / ROW_BITS), "bit": F.col("spot") % ROW_BITS}).drop("spot")
    # Dealt by row first: bitmaps made before a shuffle would be one of each row for every task.
    bitmap = part(right.select(spot("at", "of").alias("spot"))).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    probed = part(packed.withColumn("spot", spot("id", "hash"))).join(F.broadcast(bitmap), "part", "left")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return probed.where(~found).select(*packed.columns), probed.where(found).select(*packed.columns)


def _with_kept(docs: DataFrame, places: DataFrame) -> DataFrame:
    """row (a struct of the columns of docs), n_lines, n_dropped and kept. Kept lines are slices between dropped places: linear in the text.

    Documents that lose no line stay where they are. Those that do are shuffled to their places at any size: a planner that goes by the size of
    the stored, compressed places would broadcast small ones and move texts only for large ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("body"))
    right = places.select(F.col("doc_id").alias("at"), F.col("text_hash").alias("of"), "places")
    calm, hit = _parted(packed, right)
    met = hit.join(right.hint("merge"), hit["id"].eqNullSafe(right["at"]) & (hit["hash"] == right["of"]), "left").drop("at", "of")
    both = calm.withColumn("places", F.lit(None).cast("array<int>")).unionByName(met)
    kept = F.expr(
        """CASE WHEN places IS NULL THEN body ELSE
           element_at(transform(array(split(body, '\\n')), l -> array_join(flatten(zip_with(
             concat(array(-1), places), concat(places, array(size(l))),
             (a, b) -> slice(l, a + 2, b - a - 1))), '\\n')), 1) END"""
    )
    return both.select("row", "body", F.size(F.split("body", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def digest(docs: DataFrame, **rule) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    with Scratch(docs.sparkSession) as scratch:
        out = _with_kept(docs.select("doc_id", "text"), dropped_places(docs, scratch, **rule))
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def clean(docs: DataFrame, **rule) -> DataFrame:
    """docs with the lines dropped from text, and n_chars, where there is one, set anew. All rows stay."""
    with Scratch(docs.sparkSession) as scratch:
        out = _with_kept(docs, dropped_places(docs, scratch, **rule))
    kind = {f.name: f.dataType for f in docs.schema.fields}
    row = F.col("row").withField("text", F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(F.col("kept")))
    if "n_chars" in kind:
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("kept").cast(kind["n_chars"])).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")


DIGEST_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
  SELECT doc_id, lines,
         list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM split
), held AS (
  SELECT DISTINCT doc_id, unnest(keys) AS k FROM keyed
), common AS (
  SELECT k, max(doc_id) AS max_doc FROM held WHERE length(k) >= 40 GROUP BY k HAVING count(*) >= 5
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(keys) AS k, unnest(range(len(lines))) AS place FROM keyed
), marked AS (
  SELECT n.doc_id, n.place, n.line, (c.k IS NOT NULL AND c.max_doc <> n.doc_id) AS gone
  FROM numbered n LEFT JOIN common c ON n.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
