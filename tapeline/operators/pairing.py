"""Pairing of hypotheses with references, cues with excerpts, and two systems side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import leading_id, stem


def pair(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """name, hyp, ref_key, ref, status of every hypothesis (name, hyp) against references (key, ref).

    An exact stem wins. Else the lower-case stem may equal the leading id of exactly one reference. status: exact, id,
    ambiguous or missing; the last two have no reference.
    """
    h = hyps.select("name", "hyp", stem(F.col("name")).alias("_stem"))
    exact = refs.select(F.col("key").alias("_stem"), F.col("key").alias("_exact_key"), F.col("ref").alias("_exact_ref"))
    ids = refs.groupBy(leading_id(F.col("key")).alias("_id")).agg(F.count("*").alias("_n"), F.min("key").alias("_id_key"), F.min_by("ref", "key").alias("_id_ref"))
    both = h.join(exact, "_stem", "left").withColumn("_id", F.lower("_stem")).join(ids, "_id", "left")
    is_exact, one = F.col("_exact_key").isNotNull(), F.col("_n") == 1
    status = F.when(is_exact, "exact").when(one, "id").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return both.select("name", "hyp", F.when(is_exact, F.col("_exact_key")).when(one, F.col("_id_key")).alias("ref_key"), F.when(is_exact, F.col("_exact_ref")).when(one, F.col("_id_ref")).alias("ref"), status.alias("status"))


def paired(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """Only the matched pairs; an error where nothing matches."""
    found = pair(hyps, refs).where(F.col("ref_key").isNotNull()).select("name", "hyp", "ref_key", "ref")
    if found.isEmpty():
        raise ValueError("no hypothesis/reference pairs matched")
    return found


def excerpt_texts(excerpts: DataFrame, refs: DataFrame, hyps: DataFrame, subs: DataFrame) -> DataFrame:
    """Excerpts by model: reference and hypothesis are needed, subtitles may lack. hyps: (model, id, hyp)."""
    return excerpts.join(refs.select("id", "ref"), "id").join(hyps.select("model", "id", "hyp"), "id").join(subs.select("id", "sub"), "id", "left")


def overlapping(cues: DataFrame, spans: DataFrame, keys: list[str], bucket: float = 60.0) -> DataFrame:
    """Pairs of a cue (cue_start, cue_end) and a span (span_start, span_end) of equal keys that overlap, ends included.

    Both are dealt over buckets of time, so the join is an equality join and no key's rows all meet; a pair is taken
    only in the bucket where its overlap begins.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket))).alias("_cell")
    c, s = cues.select("*", cells("cue_start", "cue_end")), spans.select("*", cells("span_start", "span_end"))
    hit = (F.col("cue_end") >= F.col("span_start")) & (F.col("cue_start") <= F.col("span_end"))
    first = F.floor(F.greatest("cue_start", "span_start") / bucket)
    return c.join(s, [*keys, "_cell"]).where(hit & (F.col("_cell") == first)).drop("_cell")


def by_substring(names: DataFrame, keys: DataFrame) -> DataFrame:
    """key and the first name (in order) that contains the key's first two characters, without case.

    Names are split into all their two-character pieces, so this too is an equality join.
    """
    pieces = names.select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("name") - 1, F.lit(1))), lambda i: F.substring(F.lower("name"), i, F.lit(2))))).alias("_two"))
    return keys.withColumn("_two", F.lower(F.left("key", F.lit(2)))).join(pieces, "_two", "left").groupBy("key").agg(F.min("name").alias("name"))


def with_reference(media: DataFrame, refs: DataFrame) -> DataFrame:
    """Media (path) that have a reference by stem or by its leading id: a semi join on either name."""
    keyed = media.withColumn("_stem", stem(F.col("path")))
    exact = refs.select(F.col("key").alias("_stem"))
    by_id = refs.select(leading_id(F.col("key")).alias("_low"))
    first = keyed.join(exact, "_stem", "left_semi")
    rest = keyed.join(exact, "_stem", "left_anti").withColumn("_low", F.lower("_stem")).join(by_id, "_low", "left_semi")
    return first.select(*media.columns).unionByName(rest.select(*media.columns))


def sample_with_partner(rows: DataFrame, partners: DataFrame, limit: int) -> DataFrame:
    """The first `limit` ids of rows that also occur among partners, the last row of an id counting, with its partner."""
    one = rows.groupBy("id").agg(F.max_by("text", "seq").alias("text"), F.min("seq").alias("_first"))
    other = partners.groupBy("id").agg(F.max_by("text", "seq").alias("partner"))
    return one.join(other, "id").orderBy("_first", "id").limit(limit).drop("_first")


def excluding(rows: DataFrame, listed: DataFrame, key: str, listed_key: str | None = None) -> DataFrame:
    """rows without those whose key is on an exclude list; nulls on the list exclude nothing."""
    names = listed.select(F.col(listed_key or key).alias("_listed")).where(F.col("_listed").isNotNull()).distinct()
    return rows.join(names, rows[key] == names["_listed"], "left_anti")


def counts_side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of both sides over all keys of either."""
    return a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), key, "full_outer").na.fill(0, ["n_a", "n_b"])


def side_by_side(a: DataFrame, b: DataFrame, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Row i of A beside row i of B in each key; a dash where a side has ended. With a limit, also how many were left out."""
    by = W.partitionBy(key).orderBy(*order)
    number = lambda df, name: df.select(key, F.row_number().over(by).alias("i"), F.col("text").alias(name))
    both = number(a, "a").join(number(b, "b"), [key, "i"], "full_outer").withColumns({"a": F.coalesce("a", F.lit("—")), "b": F.coalesce("b", F.lit("—"))})
    if limit is None:
        return both
    total = F.max("i").over(W.partitionBy(key))
    return both.withColumn("omitted", F.greatest(total - limit, F.lit(0))).where(F.col("i") <= limit)


def matched_replies(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """Items (batch, i, text) with the reply of their 1-based number; null where it lacks or is blank. Others are ignored."""
    fine = replies.where(F.trim("reply") != "").groupBy("batch", F.col("id").alias("i")).agg(F.max_by("reply", "seq").alias("reply"))
    return asked.join(fine, ["batch", "i"], "left")
