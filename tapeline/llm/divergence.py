"""Quality rules, native: how far a document's histograms lie from its language's reference.

Two histograms are compared by Jensen-Shannon distance (base 2, so 0 to 1): shares of character classes, and shares
of the language's common short words together with all other words. References are sums over all documents of a
language: class counts, and the `common` most frequent words of at most four code points. Guards: a document needs
min_words words for the class test and min_common_words for the word test; below, the test passes. A language needs
min_docs documents for a reference of its own; rarer languages and null use the reference of all documents together.

Before that come base rules: fewer than 20 words, or over 30 % of words inside repeated windows of eight words.

Texts are read twice: once for the short words of the languages, combined before their shuffle, and once for all counts of a document,
without a shuffle or a row for each word. Very long texts are arrays of words in one row. Null texts have no words and fail the
base rules, as do empty ones. Of equally frequent words the first in byte order is the more common one. Repeated rows are judged alike, each on its own.
Extra columns aren't read. Null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, join_counted

CLASSES = ("upper", "digit", "mark", "symbol", "blank", "wide", "rest")
SHORT = 4
ALL = "*"


def _words(text: Column) -> Column:
    """Runs of non-blank characters; the strip keeps split from making an empty first or last word."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _repeat_words(base: DataFrame) -> DataFrame:
    """n_repeat_words from `words`: window hashes by doubling, and a sort only where some window repeats."""
    eight = base.withColumn("_w1", F.expr("CASE WHEN n_words >= 9 THEN transform(words, w -> xxhash64(w)) ELSE cast(array() AS array<bigint>) END"))
    for width, out in ((1, "_w2"), (2, "_w4"), (4, "_w8")):
        src = {1: "_w1", 2: "_w2", 4: "_w4"}[width]
        eight = eight.withColumn(out, F.expr(f"zip_with(slice({src}, 1, greatest(size({src}) - {width}, 0)), slice({src}, {1 + width}, greatest(size({src}) - {width}, 0)), (a, b) -> xxhash64(a, b))")).drop(src)
    eight = eight.withColumn("_again", F.expr("size(array_distinct(_w8)) < size(_w8)"))
    eight = eight.withColumn("_sorted", F.expr("CASE WHEN _again THEN sort_array(transform(_w8, (h, i) -> named_struct('h', h, 'i', i))) END"))
    eight = eight.withColumn("_at", F.expr("CASE WHEN _again THEN sort_array(array_distinct(flatten(zip_with(slice(_sorted, 1, size(_sorted) - 1), slice(_sorted, 2, size(_sorted) - 1), (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) ELSE cast(array() AS array<int>) END)))) END"))
    covered = F.expr("CASE WHEN _again THEN aggregate(zip_with(slice(_at, 1, size(_at) - 1), slice(_at, 2, size(_at) - 1), (a, b) -> least(b - a, 8)), 8, (s, x) -> s + x) ELSE 0 END")
    return eight.withColumn("n_repeat_words", covered.cast("long")).drop("_w8", "_again", "_sorted", "_at")


def base_stats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ref, tops) with the contract's counts, the class counts, and c0, c1 ... of the words in tops."""
    out = docs.withColumn("words", _words(F.col("text")))
    out = out.withColumns({"_lines": F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != ""), "_apart": F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: F.char_length(w) <= SHORT), "  "), F.lit(" "))})
    ascii_only = F.octet_length("text") == F.char_length("text")
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_chars": F.char_length("text").cast("long"),
            "symbol": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "upper": F.regexp_count("text", F.lit("[A-Z]")).cast("long"),
            "digit": F.regexp_count("text", F.lit("[0-9]")).cast("long"),
            "mark": F.regexp_count("text", F.lit("[.,;:!?'\"()-]")).cast("long"),
            "wide": F.when(ascii_only, 0).otherwise(F.regexp_count("text", F.lit(r"[^\x00-\x7F]"))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # Every short word between two blanks of its own: what they lose without a word tells how often it stands there.
            "hits": F.transform("tops", lambda w: ((F.octet_length("_apart") - F.octet_length(F.replace(F.col("_apart"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("long")),
        }
    ).drop("text", "_lines", "_apart", "tops")
    out = _repeat_words(out).withColumn("blank", F.col("n_chars") - F.col("word_chars"))
    return out.withColumn("rest", F.col("n_chars") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("symbol") - F.col("blank") - F.col("wide"))


def references(docs: DataFrame, common: int, min_docs: int, scratch: Scratch) -> DataFrame:
    """ref, rows, tops and top_shares: documents of each language, its most frequent short words and their share of its words.

    Languages are the rows of a table, as many as there are; ALL is among them. Counted over all texts.
    """
    # A null as word stands for all longer words; a null as position for the document itself.
    words = docs.select("lang", "missing", F.posexplode_outer(_words(F.col("text"))).alias("at", "word"))
    of_doc = F.col("at").isNull() | (F.col("at") == 0)
    counted = words.groupBy("lang", F.when(F.char_length("word") <= SHORT, F.col("word")).alias("w")).agg(F.count("word").alias("n"), F.count_if(of_doc & ~F.col("missing")).alias("docs"), F.count_if(of_doc).alias("rows"))
    counted = scratch.keep(counted, "words")
    sizes = counted.groupBy("lang").agg(F.sum("docs").alias("docs"), F.sum("rows").alias("rows"), F.sum("n").alias("total"))
    own = F.col("lang").isNotNull() & (F.col("docs") >= min_docs)
    langs = scratch.keep(sizes.withColumn("own", own), "langs")
    every = counted.groupBy("w").agg(F.sum("n").alias("n")).withColumn("ref", F.lit(ALL))
    by_lang = counted.where(F.col("w").isNotNull() & (F.col("n") > 0)).join(langs.where("own").select("lang"), "lang").select(F.concat(F.lit("="), "lang").alias("ref"), "w", "n")
    both = by_lang.unionByName(every.where(F.col("w").isNotNull() & (F.col("n") > 0)).select("ref", "w", "n"))
    top = both.withColumn("place", F.row_number().over(W.partitionBy("ref").orderBy(F.desc("n"), "w"))).where(F.col("place") <= common)
    lists = top.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("place", "w", "n"))).alias("top"))
    totals = langs.where("own").select(F.concat(F.lit("="), "lang").alias("ref"), "total", "rows")
    totals = totals.unionByName(langs.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("own"), 0).otherwise(F.col("rows"))), F.lit(0)).alias("rows")).withColumn("ref", F.lit(ALL)))
    out = totals.join(lists, "ref", "left")
    none = F.array().cast("array<struct<place:int,w:string,n:bigint>>")
    top = F.coalesce("top", none)
    return scratch.keep(out.select("ref", "rows", F.transform(top, lambda x: x["w"]).alias("tops"), F.transform(top, lambda x: x["n"] / F.col("total")).alias("top_shares")), "references")


def _distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance of two lists of shares."""
    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    total = F.lit(0.0)
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total = total + part(a, m) / 2 + part(b, m) / 2
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge(docs: DataFrame, max_class_distance: float = 0.24, max_word_distance: float = 0.32, min_words: int = 50, min_common_words: int = 100, common: int = 24, min_docs: int = 20) -> DataFrame:
    """Counts, distances and the verdict of every document."""
    with Scratch(docs.sparkSession) as scratch:
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").isNull().alias("missing"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        refs = references(base, common, min_docs, scratch)
        total = refs.agg(F.sum("rows")).first()[0] or 0
        # A language of its own has its row; all others go by the reference of all.
        known = refs.where(F.col("ref") != ALL).select(F.expr("substring(ref, 2)").alias("lang"), "rows", F.col("tops").alias("own_tops"))
        of_all = [r.tops for r in refs.where(F.col("ref") == ALL).select("tops").collect()]
        words = F.array(*(F.lit(w) for w in of_all[0])) if of_all and of_all[0] else F.array().cast("array<string>")
        met = join_counted(base, known, ["lang"], total)
        ref = F.when(F.col("own_tops").isNull(), F.lit(ALL)).otherwise(F.concat(F.lit("="), F.col("lang")))
        stats = base_stats(met.select("doc_id", "text", ref.alias("ref"), F.coalesce("own_tops", words).alias("tops")))
        rows = scratch.keep(stats.select("doc_id", "ref", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "hits", *CLASSES), "rows", result=True)

        per_ref = rows.groupBy("ref").agg(*(F.sum(c).alias(c) for c in CLASSES))
        sums = scratch.keep(per_ref, "sums")
        whole = sums.agg(*(F.sum(c).alias(c) for c in CLASSES)).withColumn("ref", F.lit(ALL))
        each = sums.where(F.col("ref") != ALL).unionByName(whole.select("ref", *CLASSES))
        n = F.greatest(sum((F.col(c) for c in CLASSES), F.lit(0)), F.lit(1))
        shares = each.select("ref", F.array(*(F.col(c) / n for c in CLASSES)).alias("class_ref"))
        table = scratch.keep(refs.join(shares, "ref", "left").select("ref", "rows", "class_ref", F.concat("top_shares", F.array_repeat(F.lit(0.0), F.greatest(F.lit(common) - F.size("top_shares"), F.lit(0)))).alias("word_ref")), "table", result=True)
        out = join_counted(rows, table, ["ref"], total)

    chars = sum((F.col(c) for c in CLASSES), F.lit(0))
    class_p = [F.when(chars > 0, F.col(c) / F.greatest(chars, F.lit(1))).otherwise(0.0) for c in CLASSES]
    class_q = [F.col("class_ref")[i] for i in range(len(CLASSES))]
    words_n = F.greatest(F.col("n_words"), F.lit(1))
    hits = [F.coalesce(F.get("hits", F.lit(k)), F.lit(0)) / words_n for k in range(common)]
    word_q = [F.col("word_ref")[k] for k in range(common)]
    other = lambda xs: F.greatest(F.lit(1.0) - sum(xs, F.lit(0.0)), F.lit(0.0))
    out = out.withColumns({"class_distance": _distance(class_p, class_q), "word_distance": _distance([*hits, other(hits)], [*word_q, other(word_q)])})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = ((F.col("n_words") < min_words) | (F.col("class_distance") <= max_class_distance)) & ((F.col("n_words") < min_common_words) | (F.col("word_distance") <= max_word_distance))
    return out.select("doc_id", "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "word_distance")
