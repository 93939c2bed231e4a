"""Registry of the engine's queries on the standard tables, with DuckDB SQL for the same results.

Each query binds operators of the package to whole tables. Queries whose result SQL can't give in reasonable time have no
SQL; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize, numbers, punctuation, subtitles, text
from .operators import alignment, bootstrap, clean, metrics, pairing, reports, sentences, translation
from .sources import readers, writers
from .streaming import context

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Tables whose queries compute long on each row.
_TEXTS = ("documents", "conversations", "pages")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return readers.spread(found) if name in _TEXTS else found


def _dealt(rows: DataFrame) -> DataFrame:
    """Over all cores and in more tasks as data grow: for rows that cost far more to work on than to move, and come in few files or row groups."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


_long = lambda c, name: c.cast("long").alias(name)

# --- normalization -------------------------------------------------------------------------------------------------

_SPLIT_SQL = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


def _tokens_sql(source: str, key: str, fillers: bool) -> str:
    drop = " AND p NOT IN (" + ", ".join(f"'{f}'" for f in normalize.FILLERS) + ")" if fillers else ""
    return rf"""
WITH a AS (SELECT {key}, regexp_replace(lower(regexp_replace(text, '[\[({{][^\])}}]*[\])}}]', ' ', 'g')), '[-–—]', ' ', 'g') AS t FROM {source}),
b AS (SELECT {key}, list_filter(list_transform(flatten(list_transform({_SPLIT_SQL.format("t")},
        lambda w: string_split(regexp_replace(replace(w, '’', ''''), '[^\p{{L}}\p{{N}}_'']+', ' ', 'g'), ' '))),
        lambda p: trim(p, '''')), lambda p: p <> ''{drop}) AS toks FROM a)
SELECT {key}, len(toks)::BIGINT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM b"""


@query(_tokens_sql("documents", "doc_id", False))
def norm_tokens(spark, sf_dir):
    toks = normalize.tokens(F.col("text"))
    return _t(spark, sf_dir, "documents").withColumn("toks", toks).select("doc_id", _long(F.size("toks"), "n_tokens"), F.array_join("toks", " ").alias("tokens"))


@query(_tokens_sql("conversations", "conv_id, turn", True))
def norm_drop_fillers(spark, sf_dir):
    toks = normalize.tokens(F.col("text"), normalize.Rules(drop_fillers=True))
    return _t(spark, sf_dir, "conversations").withColumn("toks", toks).select("conv_id", "turn", _long(F.size("toks"), "n_tokens"), F.array_join("toks", " ").alias("tokens"))


@query(r"SELECT doc_id, regexp_replace(text, '[\[({][^\])}]*[\])}]', ' ', 'g') AS bare FROM documents")
def norm_strip_annotations(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", normalize.strip_annotations(F.col("text")).alias("bare"))


_ONES_SQL = "[" + ", ".join(f"'{w}'" for w in numbers.ONES) + "]"
_TENS_SQL = "[" + ", ".join(f"'{w}'" for w in numbers.TENS) + "]"


@query(f"""
WITH n AS (SELECT DISTINCT p_retailprice::BIGINT AS n FROM part UNION SELECT DISTINCT l_orderkey FROM lineitem UNION SELECT DISTINCT -s_suppkey FROM supplier),
x AS (SELECT n, abs(n) AS a, {_ONES_SQL} AS ones, {_TENS_SQL} AS tens FROM n),
y AS (SELECT n, a, ones, tens, a // 1000 AS hi, a % 1000 AS lo FROM x),
z AS (SELECT n, a, hi, lo, list_transform([hi, lo], lambda v: CASE WHEN v = 0 THEN '' ELSE
  concat_ws(' ', CASE WHEN v >= 100 THEN ones[v // 100 + 1] || ' hundred' END,
    CASE WHEN v % 100 = 0 THEN NULL WHEN v % 100 < 20 THEN ones[v % 100 + 1] WHEN v % 10 = 0 THEN tens[v % 100 // 10 - 1]
         ELSE tens[v % 100 // 10 - 1] || ' ' || ones[v % 10 + 1] END) END) AS w FROM y)
SELECT n, CASE WHEN n < 0 THEN 'minus ' ELSE '' END || CASE WHEN a = 0 THEN 'zero' WHEN a >= 1000000 THEN a::VARCHAR WHEN hi = 0 THEN w[2] WHEN lo = 0 THEN w[1] || ' thousand' ELSE w[1] || ' thousand ' || w[2] END AS words FROM z""")
def spell_numbers(spark, sf_dir):
    n = _t(spark, sf_dir, "part").select(F.round("p_retailprice").cast("long").alias("n")).union(_t(spark, sf_dir, "lineitem").select("l_orderkey")).union(_t(spark, sf_dir, "supplier").select(-F.col("s_suppkey"))).distinct()
    return n.select("n", numbers.int_words(F.col("n")).alias("words"))


def _below_thousand_sql(v: str) -> str:
    return f"""concat_ws(' ', CASE WHEN {v} >= 100 THEN ({_ONES_SQL})[{v} // 100 + 1] || ' hundred' END, CASE WHEN {v} % 100 = 0 THEN NULL WHEN {v} % 100 < 20 THEN ({_ONES_SQL})[{v} % 100 + 1]
 WHEN {v} % 10 = 0 THEN ({_TENS_SQL})[{v} % 100 // 10 - 1] ELSE ({_TENS_SQL})[{v} % 100 // 10 - 1] || ' ' || ({_ONES_SQL})[{v} % 10 + 1] END)"""


def _int_words_sql(v: str) -> str:
    """Words for a whole number, not negative and below a million."""
    return f"CASE WHEN {v} = 0 THEN 'zero' WHEN {v} < 1000 THEN {_below_thousand_sql(v)} ELSE trim({_below_thousand_sql(f'({v} // 1000)')} || ' thousand ' || {_below_thousand_sql(f'({v} % 1000)')}) END"


@query(rf"""WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS p, o_orderkey % 101 AS q, o_custkey AS c, o_orderkey * 97 AS z FROM orders),
x AS (SELECT *, CASE WHEN p % 7 = 0 THEN p::VARCHAR ELSE format('{{:,}}', p) || '.' || lpad((p % 100)::VARCHAR, 2, '0') END AS price, z::VARCHAR AS zs FROM o),
d AS (SELECT *, CASE WHEN p % 7 = 0 THEN {_int_words_sql('p')} ELSE {_int_words_sql('p')} || ' point ' || ({_ONES_SQL})[p % 100 // 10 + 1] || ' ' || ({_ONES_SQL})[p % 10 + 1] END AS price_words FROM x)
SELECT o_orderkey, 'paid ' || regexp_replace(price, '[,.]', ' ', 'g') || ' and ' || q || ' for ' || c || ' or ' || zs AS as_reference,
 'paid ' || price_words || ' and ' || {_int_words_sql('q')} || ' percent for ' || c || ' or ' || CASE WHEN z < 1000000 THEN {_int_words_sql('z')} ELSE zs END AS as_hypothesis FROM d""")
def spoken_numbers(spark, sf_dir):
    """One text as reference, where digits stay, and as hypothesis, where currency, decimals, commas and percents are spelled."""
    o = _t(spark, sf_dir, "orders")
    p = F.floor("o_totalprice").cast("long")
    price = F.when(p % 7 == 0, p.cast("string")).otherwise(F.concat(F.format_number(p, 0), F.lit("."), F.lpad((p % 100).cast("string"), 2, "0")))
    body = F.concat(F.lit("Paid $"), price, F.lit(" and "), F.col("o_orderkey") % 101, F.lit("% for #"), F.col("o_custkey"), F.lit(" or "), F.col("o_orderkey") * 97)
    said = lambda reference: F.array_join(normalize.tokens(F.col("body"), reference=reference), " ")
    return o.select("o_orderkey", body.alias("body")).select("o_orderkey", said(True).alias("as_reference"), said(False).alias("as_hypothesis"))


_PUNCT_SQL = "'" + normalize.PUNCTUATION.replace("'", "''") + "'"


@query(f"SELECT item_id, array_to_string({_SPLIT_SQL.format(f'translate(lower(text), {_PUNCT_SQL}, repeat(chr(1), 0))')}, ' ') AS key FROM benchmark")
def phrase_keys(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", normalize.phrase_key(F.col("text")).alias("key"))


@query(f"SELECT conv_id, turn, array_to_string({_SPLIT_SQL.format('lower(text)')}, ' ') AS plain, length(regexp_replace(text, '\\s+', '', 'g'))::BIGINT AS n_dense FROM conversations")
def basic_normalizer(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", normalize.basic(F.col("text")).alias("plain"), _long(F.char_length(normalize.without_spaces(F.col("text"))), "n_dense"))


# --- alignment and rates -------------------------------------------------------------------------------------------


def turn_pairs(spark, sf_dir) -> DataFrame:
    """User turns with the assistant turn after them, as reference and hypothesis."""
    turns = _t(spark, sf_dir, "conversations")
    u = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ref"))
    a = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return _dealt(u.join(a, ["conv_id", "turn"]))


_PAIRS_SQL = "SELECT u.conv_id, u.turn, u.text AS ref, a.text AS hyp FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def _line_tokens_sql(text: str) -> str:
    """A list of token lists, one for each line with tokens."""
    bare = rf"regexp_replace(lower(regexp_replace(l, '[\[({{][^\])}}]*[\])}}]', ' ', 'g')), '[-–—]', ' ', 'g')"
    pieces = rf"list_filter(list_transform(flatten(list_transform({_SPLIT_SQL.format(bare)}, lambda w: string_split(regexp_replace(replace(w, '’', ''''), '[^\p{{L}}\p{{N}}_'']+', ' ', 'g'), ' '))), lambda q: trim(q, '''')), lambda q: q <> '')"
    return rf"list_filter(list_transform(string_split_regex({text}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'), lambda l: {pieces}), lambda x: len(x) > 0)"


#: Characters beyond ASCII of the table, as ones that no token has: levenshtein counts bytes.
_WIDE_SQL = "translate({0}, 'ßäçèéêíñóöüàâîôûëïùú', 'ABCDEFGHIJKLMNOPQRST')"


def _aligned_sql(pairs: str, keys: str, r: str, h: str) -> str:
    """Recursive CTEs up to `al`: keys, lines, r, h, cost and path (m, s, d, i) of a cheapest alignment of two token lists.

    A row of the table of costs for each token of r. Along a row, the running minimum of cost less column carries
    insertions; a cell that isn't reached by one takes a match before a substitution, that before a deletion.
    """
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda t: ", ".join(f"{t}.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE p AS (SELECT *, {r} AS r, {h} AS h FROM ({pairs})),
dp AS (
 SELECT {keys}, 0::BIGINT AS i, j, j AS cost, repeat('i', j) AS path FROM (SELECT {keys}, unnest(range(len(h) + 1)) AS j FROM p)
 UNION ALL
 SELECT {keys}, i, j, cost, a.path || repeat('i', j - a.j) FROM (
  SELECT *, last_value(CASE WHEN base = cost THEN {{'j': j, 'path': bpath}} END IGNORE NULLS) OVER w AS a FROM (
   SELECT {keys}, i, j, base, bpath, j + min(base - j) OVER (PARTITION BY {keys} ORDER BY j) AS cost FROM (
    SELECT {keys}, i, j, CASE WHEN j = 0 THEN up + 1 WHEN eq THEN diag ELSE least(diag, up) + 1 END AS base,
           CASE WHEN j = 0 THEN upath || 'd' WHEN eq THEN dpath || 'm' WHEN diag <= up THEN dpath || 's' ELSE upath || 'd' END AS bpath FROM (
     SELECT {of('dp')}, dp.i + 1 AS i, dp.j, dp.cost AS up, dp.path AS upath, lag(dp.cost) OVER v AS diag, lag(dp.path) OVER v AS dpath, p.r[dp.i + 1] = p.h[dp.j] AS eq
     FROM dp JOIN p ON {on('p', 'dp')} WHERE dp.i < len(p.r) WINDOW v AS (PARTITION BY {of('dp')} ORDER BY dp.j))))
  WINDOW w AS (PARTITION BY {keys} ORDER BY j ROWS UNBOUNDED PRECEDING))
),
al AS (SELECT p.*, dp.cost, dp.path, (length(dp.path) - length(replace(dp.path, 's', '')))::BIGINT AS s, (length(dp.path) - length(replace(dp.path, 'd', '')))::BIGINT AS d,
 (length(dp.path) - length(replace(dp.path, 'i', '')))::BIGINT AS i, (length(dp.path) - length(replace(dp.path, 'm', '')))::BIGINT AS c
 FROM dp JOIN p ON {on('p', 'dp')} AND dp.i = len(p.r) AND dp.j = len(p.h))"""


def _lined_sql(pairs: str) -> str:
    return f"SELECT * FROM (SELECT *, {_line_tokens_sql('ref')} AS lines, flatten({_line_tokens_sql('hyp')}) AS hyp_tokens FROM ({pairs})) WHERE len(lines) > 0"


_TURN_ALIGNED = _aligned_sql(_lined_sql(_PAIRS_SQL), "conv_id, turn", "flatten(lines)", "hyp_tokens")
_FOUR_SQL = "s AS n_sub, d AS n_del, i AS n_ins, c AS n_match"


@query(_TURN_ALIGNED + f""" SELECT conv_id, turn, {_FOUR_SQL}, (s + d + c)::BIGINT AS n_ref, (s + d + i)::DOUBLE / (s + d + c)::DOUBLE AS wer, (s + d + i)::DOUBLE / (s + d + i + c)::DOUBLE AS mer,
 levenshtein({_WIDE_SQL.format("array_to_string(r, ' ')")}, {_WIDE_SQL.format("array_to_string(h, ' ')")})::DOUBLE / greatest(length(array_to_string(r, ' ')), 1)::DOUBLE AS cer FROM al""")
def pair_wer(spark, sf_dir):
    scored = metrics.score_pairs(turn_pairs(spark, sf_dir))
    return scored.select("conv_id", "turn", *metrics.COUNTS, "n_ref", "wer", "mer", "cer")


@query(_aligned_sql(f"SELECT *, flatten({_line_tokens_sql('ref')}) AS r0, flatten({_line_tokens_sql('hyp')}) AS h0 FROM ({_PAIRS_SQL})", "conv_id, turn", "r0", "h0") + f" SELECT conv_id, turn, {_FOUR_SQL}, cost::BIGINT AS distance FROM al")
def pair_totals(spark, sf_dir):
    """Distance by the native path, beside the counts of the operations."""
    toks = turn_pairs(spark, sf_dir).withColumns({"r": normalize.tokens(F.col("ref")), "h": normalize.tokens(F.col("hyp"))})
    out = alignment.align(toks.select("conv_id", "turn", "r", "h"), "r", "h")
    return out.select("conv_id", "turn", *alignment.counts(F.col("ops")), _long(alignment.token_distance(F.col("r"), F.col("h")), "distance"))


@query(_TURN_ALIGNED + """, g AS (SELECT conv_id % 7 AS category, sum(s)::BIGINT AS n_sub, sum(d)::BIGINT AS n_del, sum(i)::BIGINT AS n_ins, sum(c)::BIGINT AS n_match FROM al GROUP BY ROLLUP (conv_id % 7))
SELECT category, n_sub, n_del, n_ins, n_match, (n_sub + n_del + n_match)::BIGINT AS n_ref, round((n_sub + n_del + n_ins)::DOUBLE / (n_sub + n_del + n_match)::DOUBLE, 4) AS wer, round((n_sub + n_del + n_ins)::DOUBLE / (n_sub + n_del + n_ins + n_match)::DOUBLE, 4) AS mer,
 round(n_sub::DOUBLE / (n_sub + n_del + n_match)::DOUBLE, 4) AS sub_rate, round(n_del::DOUBLE / (n_sub + n_del + n_match)::DOUBLE, 4) AS del_rate, round(n_ins::DOUBLE / (n_sub + n_del + n_match)::DOUBLE, 4) AS ins_rate FROM g""")
def aligned_rollup(spark, sf_dir):
    """Counts of real alignments, pooled by category and over the corpus."""
    scored = metrics.score_pairs(turn_pairs(spark, sf_dir))
    return metrics.with_corpus(scored.withColumn("category", F.col("conv_id") % 7), "category")


_FILES_SQL = f"SELECT conv_id AS name, string_agg(ref, ' ' ORDER BY turn) AS ref, string_agg(hyp, ' ' ORDER BY turn) AS hyp FROM ({_PAIRS_SQL}) WHERE turn < 3 GROUP BY conv_id"


@query(_aligned_sql(f"SELECT * FROM (SELECT name, {_SPLIT_SQL.format('lower(ref)')} AS r0, {_SPLIT_SQL.format('lower(hyp)')} AS h0 FROM ({_FILES_SQL})) WHERE len(r0) > 0", "name", "r0", "h0") + f""",
e AS (SELECT name, s, d, i, c, levenshtein({_WIDE_SQL.format("array_to_string(r, ' ')")}, {_WIDE_SQL.format("array_to_string(h, ' ')")})::BIGINT AS chars, length(array_to_string(r, ' '))::BIGINT AS n_chars FROM al)
SELECT name, count(*)::BIGINT AS n, round(sum(s + d + i)::DOUBLE / sum(s + d + c)::DOUBLE, 4) AS wer, round(sum(chars)::DOUBLE / sum(n_chars)::DOUBLE, 4) AS cer FROM e GROUP BY ROLLUP (name)""")
def file_scores(spark, sf_dir):
    """Rates of every file, and of the corpus in the row without a name."""
    pairs = turn_pairs(spark, sf_dir).where(F.col("turn") < 3)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", c))), lambda x: x[c]), " ").alias(c)
    return metrics.file_scores(pairs.groupBy(F.col("conv_id").alias("name")).agg(joined("ref"), joined("hyp")), "en")


def _bleu_words_sql(c: str) -> str:
    out = f"' ' || {c} || ' '"
    for pattern, by in (("([\\{-\\~\\[-` -&\\(-\\+:-@/])", " \\1 "), ("([^0-9])([\\.,])", "\\1 \\2 "), ("([\\.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 ")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"list_filter(string_split_regex({out}, '\\s+'), lambda x: x <> '')"


def _chrf_words_sql(c: str) -> str:
    marks = "'" + normalize.PUNCTUATION.replace("'", "''") + "'"
    cut = f"CASE WHEN length(x) > 1 AND contains({marks}, right(x, 1)) THEN [left(x, length(x) - 1), right(x, 1)] WHEN length(x) > 1 AND contains({marks}, left(x, 1)) THEN [left(x, 1), substr(x, 2)] ELSE [x] END"
    return f"flatten(list_transform({_SPLIT_SQL.format(c)}, lambda x: {cut}))"


def _gram_counts_sql(items: str, name: str, most: int) -> str:
    """A CTE of clipped matches and counts of the n-grams of two lists, summed over all pairs: n, hits, hyp, ref."""
    side = lambda c: f"SELECT id, n, g, count(*) AS k FROM (SELECT id, n, unnest(list_transform(range(greatest(len({c}) - n + 1, 0)), lambda a: array_to_string({c}[a + 1 : a + n], chr(1)))) AS g FROM {items}, range(1, {most + 1}) z(n)) GROUP BY id, n, g"
    return f"{name} AS (SELECT n, coalesce(sum(least(a.k, b.k)) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL), 0) AS hits, coalesce(sum(b.k), 0) AS hyp, coalesce(sum(a.k), 0) AS ref FROM ({side('r')}) a FULL JOIN ({side('h')}) b USING (id, n, g) GROUP BY n)"


@query(f"""WITH q AS (SELECT row_number() OVER () AS id, ref, hyp FROM ({_PAIRS_SQL}) WHERE trim(ref) <> ''),
w AS (SELECT id, {_bleu_words_sql("replace(ref, chr(10), ' ')")} AS r, {_bleu_words_sql("replace(hyp, chr(10), ' ')")} AS h FROM q),
ch AS (SELECT id, string_split(regexp_replace(ref, '\\s+', '', 'g'), '') AS r, string_split(regexp_replace(hyp, '\\s+', '', 'g'), '') AS h FROM q),
pw AS (SELECT id, {_chrf_words_sql('ref')} AS r, {_chrf_words_sql('hyp')} AS h FROM q),
{_gram_counts_sql('w', 'gw', 4)}, {_gram_counts_sql('ch', 'gc', 6)}, {_gram_counts_sql('pw', 'gp', 2)},
ln_ AS (SELECT sum(len(r)) AS nr, sum(len(h)) AS nh FROM w),
b AS (SELECT n, hits, hyp, sum(CASE WHEN hits = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS z FROM gw),
bl AS (SELECT sum(ln(CASE WHEN hits = 0 THEN 1.0 / (2 ** z) ELSE hits END / hyp)) / 4 AS l FROM b),
f AS (SELECT avg(hits / hyp::DOUBLE) AS p, avg(hits / ref::DOUBLE) AS r FROM (SELECT * FROM gc UNION ALL SELECT * FROM gp) WHERE hyp > 0 AND ref > 0)
SELECT (SELECT count(*) FROM q)::BIGINT AS n, round(100 * exp(least(0, 1 - nr / nh::DOUBLE) + l), 2) AS bleu, round(100 * 5 * p * r / (4 * p + r), 2) AS chrf FROM ln_, bl, f""")
def translation_scores(spark, sf_dir):
    return translation.translation_scores(turn_pairs(spark, sf_dir))


_UTTERED_PAIRS = f"SELECT conv_id, turn, regexp_replace(ref, '([.?!]) ', '\\1' || chr(10), 'g') AS ref, hyp FROM ({_PAIRS_SQL})"


@query(_aligned_sql(_lined_sql(_UTTERED_PAIRS), "conv_id, turn", "flatten(lines)", "hyp_tokens") + """,
o AS (SELECT conv_id, turn, lines, len(r) AS nr, path, unnest(range(length(path))) AS k FROM al),
u AS (SELECT conv_id, turn, substr(path, k + 1, 1) AS op, lines, k - (length(left(path, k)) - length(replace(left(path, k), 'i', ''))) AS idx FROM o),
e AS (SELECT conv_id, turn, op, least(len(list_filter(range(1, len(lines) + 1), lambda x: len(flatten(list_slice(lines, 1, x))) <= idx)), len(lines) - 1) AS utterance FROM u),
every_ AS (SELECT conv_id, turn, unnest(range(len(lines))) AS utterance FROM al)
SELECT v.conv_id, v.turn, v.utterance::BIGINT AS utterance, count(*) FILTER (op = 's')::BIGINT AS n_sub, count(*) FILTER (op = 'd')::BIGINT AS n_del, count(*) FILTER (op = 'i')::BIGINT AS n_ins, count(*) FILTER (op = 'm')::BIGINT AS n_match
FROM every_ v LEFT JOIN e ON e.conv_id = v.conv_id AND e.turn = v.turn AND e.utterance = v.utterance GROUP BY v.conv_id, v.turn, v.utterance""")
def utterance_buckets(spark, sf_dir):
    pairs = metrics.score_pairs(turn_pairs(spark, sf_dir).withColumn("ref", F.regexp_replace("ref", r"([.?!]) ", "$1\n")))
    return alignment.utterance_counts(pairs, ["conv_id", "turn"]).withColumn("utterance", F.col("utterance").cast("long"))


_JACCARD_WORDS = _SPLIT_SQL.format("lower({})")


@query(f"""WITH p AS ({_PAIRS_SQL}), w AS (SELECT conv_id, turn, list_distinct({_SPLIT_SQL.format('lower(ref)')}) AS a, list_distinct({_SPLIT_SQL.format('lower(hyp)')}) AS b FROM p)
SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))::DOUBLE END AS jaccard FROM w""")
def token_jaccard(spark, sf_dir):
    words = lambda c: normalize.words_of(F.lower(c))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", metrics.token_jaccard(words("ref"), words("hyp")).alias("jaccard"))


def _scores(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    n = F.col("n_chars")
    return d.select("doc_id", "source", "lang", (n % 7).alias("n_sub"), (n % 5).alias("n_del"), (n % 3).alias("n_ins"), (n % 101).alias("n_match"))


_SCORES_SQL = "SELECT doc_id, source, lang, n_chars % 7 AS s, n_chars % 5 AS d, n_chars % 3 AS i, n_chars % 101 AS c FROM documents"
_RATES_SQL = "CASE WHEN sum(s+d+c) = 0 THEN {0} ELSE sum(s+d+i)::DOUBLE / sum(s+d+c)::DOUBLE END AS wer, CASE WHEN sum(s+d+i+c) = 0 THEN {0} ELSE sum(s+d+i)::DOUBLE / sum(s+d+i+c)::DOUBLE END AS mer"
_SUMS_SQL = "sum(s)::BIGINT AS n_sub, sum(d)::BIGINT AS n_del, sum(i)::BIGINT AS n_ins, sum(c)::BIGINT AS n_match, sum(s+d+c)::BIGINT AS n_ref"


@query(f"WITH x AS ({_SCORES_SQL}) SELECT l.quality, x.source, {_SUMS_SQL}, {_RATES_SQL.format('0.0::DOUBLE')} FROM x JOIN labels l USING (doc_id) GROUP BY l.quality, x.source")
def category_rollup(spark, sf_dir):
    return metrics.pooled(_scores(spark, sf_dir).join(_t(spark, sf_dir, "labels"), "doc_id"), ["quality", "source"])


@query(f"""WITH x AS ({_SCORES_SQL}) SELECT source, {_SUMS_SQL}, round(sum(s+d+i)::DOUBLE / nullif(sum(s+d+c), 0)::DOUBLE, 4) AS wer, round(sum(s+d+i)::DOUBLE / nullif(sum(s+d+i+c), 0)::DOUBLE, 4) AS mer,
 round(sum(s)::DOUBLE / nullif(sum(s+d+c), 0)::DOUBLE, 4) AS sub_rate, round(sum(d)::DOUBLE / nullif(sum(s+d+c), 0)::DOUBLE, 4) AS del_rate, round(sum(i)::DOUBLE / nullif(sum(s+d+c), 0)::DOUBLE, 4) AS ins_rate
FROM x GROUP BY ROLLUP (source)""")
def corpus_rollup(spark, sf_dir):
    return metrics.with_corpus(_scores(spark, sf_dir), "source")


@query(f"""WITH x AS ({_SCORES_SQL}), t AS (SELECT lang, {_SUMS_SQL}, {_RATES_SQL.format('0.0::DOUBLE')} FROM x GROUP BY lang),
u AS (SELECT lang, {_SUMS_SQL}, {_RATES_SQL.format('0.0::DOUBLE')} FROM (SELECT x.* FROM x JOIN labels USING (doc_id)) GROUP BY lang)
SELECT lang, t.wer AS true_wer, t.n_ref AS true_n_ref, u.wer AS sub_wer, u.n_ref AS sub_n_ref, u.wer - t.wer AS calibration FROM t LEFT JOIN u USING (lang)""")
def calibration_delta(spark, sf_dir):
    all_scores = _scores(spark, sf_dir)
    return metrics.calibration(all_scores, all_scores.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id"), ["lang"])


# --- bootstrap -----------------------------------------------------------------------------------------------------

N_BOOT = 2000


def _buckets(spark, sf_dir, table: str, key: str, nation: str) -> DataFrame:
    region = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(nation), F.col("n_regionkey").cast("long").alias("region"))
    k = F.col(key)
    return _t(spark, sf_dir, table).join(region, nation).select("region", k.alias("id"), (k % 7).alias("n_sub"), (k % 4).alias("n_del"), (k % 3).alias("n_ins"), (k % 29 + 1).alias("n_match"))


def _buckets_sql(table: str, key: str, nation: str) -> str:
    return f"SELECT n_regionkey::BIGINT AS region, {key} AS id, {key} % 7 AS s, {key} % 4 AS d, {key} % 3 AS i, {key} % 29 + 1 AS c, row_number() OVER (PARTITION BY n_regionkey ORDER BY {key}) - 1 AS slot FROM {table} JOIN nation ON n_nationkey = {nation}"


def _reps_sql(stream: int) -> str:
    p, r, i, m = bootstrap.PRIME, bootstrap.STEP_R, bootstrap.STEP_I, bootstrap.START
    x = f"((rep * {r} + i * {i} + {1234 + stream * 7919}) % {p})"
    for _ in range(2):
        x = f"(({x} * {m} + 12345) % {p})"
    return f"""SELECT b.region, dr.rep, sum(s) AS s, sum(d) AS d, sum(b.i) AS i, sum(c) AS c FROM
 (SELECT region, rep, {x} % k AS slot FROM (SELECT region, count(*) AS k FROM b GROUP BY region) g, (SELECT range AS rep FROM range({N_BOOT})) r, LATERAL (SELECT unnest(range(g.k)) AS i) q) dr
 JOIN b ON b.region = dr.region AND b.slot = dr.slot GROUP BY b.region, dr.rep"""


_LO, _HI = int(0.025 * N_BOOT) + 1, int(0.975 * N_BOOT)


@query(f"""WITH b AS ({_buckets_sql('supplier', 's_suppkey', 's_nationkey')}), r AS ({_reps_sql(0)}),
w AS (SELECT region, list_sort(list((s+d+i)::DOUBLE / (s+d+c)::DOUBLE)) AS w, list_sort(list((s+d+i)::DOUBLE / (s+d+i+c)::DOUBLE)) AS m FROM r GROUP BY region)
SELECT region, w[{_LO}] AS wer_lo, w[{_HI}] AS wer_hi, m[{_LO}] AS mer_lo, m[{_HI}] AS mer_hi FROM w""")
def bootstrap_ci(spark, sf_dir):
    return bootstrap.rate_intervals(_buckets(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), ["region"], ["id"], N_BOOT)


@query(f"""WITH tb AS ({_buckets_sql('supplier', 's_suppkey', 's_nationkey')}), sb AS ({_buckets_sql('customer', 'c_custkey', 'c_nationkey')}),
t AS ({_reps_sql(1).replace('FROM b ', 'FROM tb ').replace('JOIN b ON', 'JOIN tb b ON')}), s AS ({_reps_sql(2).replace('FROM b ', 'FROM sb ').replace('JOIN b ON', 'JOIN sb b ON')}),
g AS (SELECT t.region, (s.s+s.d+s.i)::DOUBLE / (s.s+s.d+s.c)::DOUBLE - (t.s+t.d+t.i)::DOUBLE / (t.s+t.d+t.c)::DOUBLE AS gap FROM t JOIN s ON t.region = s.region AND t.rep = s.rep)
SELECT region, list_sort(list(gap))[{_LO}] AS lo, list_sort(list(gap))[{_HI}] AS hi, round(avg(gap), 9) AS mean FROM g GROUP BY region""")
def bootstrap_gap(spark, sf_dir):
    out = bootstrap.gap_intervals(_buckets(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), _buckets(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), ["region"], ["id"], N_BOOT)
    return out.withColumn("mean", F.round("mean", 9))


# --- cleaning ------------------------------------------------------------------------------------------------------


def _moments(spark, sf_dir) -> DataFrame:
    """Events as timed phrases of a user: whole seconds, so that both engines compute alike."""
    e = _t(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("seg"), start.alias("start"), (start + F.floor("value")).alias("end"), F.col("event_type").alias("text"))


_MOMENTS_SQL = "SELECT user_id AS file, event_id AS seg, epoch(date_trunc('second', ts))::DOUBLE AS start, epoch(date_trunc('second', ts))::DOUBLE + floor(value) AS stop, event_type AS text FROM events"


@query(f"""WITH m AS ({_MOMENTS_SQL}), n AS (SELECT *, least(coalesce(start - lag(stop) OVER w, 'inf'::DOUBLE), coalesce(lead(start) OVER w - stop, 'inf'::DOUBLE)) AS gap FROM m WINDOW w AS (PARTITION BY file ORDER BY start, seg)),
k AS (SELECT file, text, count(*) AS c, median(gap) AS g FROM n GROUP BY file, text)
SELECT n.file, n.seg, n.text FROM n JOIN k ON n.file = k.file AND n.text = k.text WHERE NOT (c >= 4 AND g >= 14400 AND gap >= 14400)""")
def isolated_artifact(spark, sf_dir):
    limits = clean.Limits(artifact_gap=14_400.0)
    return clean.drop_artifacts(_moments(spark, sf_dir), limits, order=("start", "seg")).select("file", "seg", "text")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE NOT (l_discount > 0.05 AND l_tax < 0.04)")
def silence_filter(spark, sf_dir):
    limits = clean.Limits(no_speech_max=0.05, logprob_min=0.04)
    return _t(spark, sf_dir, "lineitem").where(~clean.is_silence(F.col("l_discount"), F.col("l_tax"), limits)).select("l_orderkey", _long(F.col("l_linenumber"), "l_linenumber"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE NOT (l_tax > 0 AND l_quantity > 25)")
def repetition_filter(spark, sf_dir):
    limits = clean.Limits(compression_max=25)
    return _t(spark, sf_dir, "lineitem").where(~clean.is_repetition(F.col("l_tax"), F.col("l_quantity"), limits)).select("l_orderkey", _long(F.col("l_linenumber"), "l_linenumber"))


@query(f"""WITH m AS ({_MOMENTS_SQL}), f AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY file ORDER BY start, seg) > 7200 THEN 1 ELSE 0 END AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start, seg ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT file, run::BIGINT AS run, count(*)::BIGINT AS n, min(start) AS first_start, max(stop) AS last_end FROM r GROUP BY file, run""")
def gap_islands(spark, sf_dir):
    m = _moments(spark, sf_dir).withColumn("pos", F.struct("start", "seg"))
    return clean.word_runs(m, ["file"], 7200.0).groupBy("file", "run").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query(f"""WITH m AS ({_MOMENTS_SQL}), f AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY file ORDER BY start, seg) > 7200 THEN 1 ELSE 0 END AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start, seg ROWS UNBOUNDED PRECEDING) AS run FROM f),
p AS (SELECT file, run::BIGINT AS run, sum(stop - start) AS spoken, count(*) AS n FROM r GROUP BY file, run)
SELECT DISTINCT file, first_value(run) OVER (PARTITION BY file ORDER BY spoken DESC, n DESC, run) AS anchor, count(*) OVER (PARTITION BY file) AS runs FROM p""")
def straddle_runs(spark, sf_dir):
    m = _moments(spark, sf_dir).withColumn("pos", F.struct("start", "seg"))
    return clean.anchor_runs(clean.word_runs(m, ["file"], 7200.0), ["file"])


def turn_segments(spark, sf_dir) -> DataFrame:
    """Conversation turns as decoded segments: words of 200 ms every 300 ms; every seventh turn has collapsed times."""
    c = _dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    words = normalize.words_of(F.col("text"))
    base = F.col("turn") * 1000.0
    flat = F.col("turn") % 7 == 6
    one = lambda w, i: F.struct(F.when(flat, base).otherwise(base + i * 0.3).alias("start"), F.when(flat, base).otherwise(base + i * 0.3 + 0.2).alias("end"), F.concat(F.lit(" "), w).alias("word"), ((i * 37 + 11) % 100 / 100.0).alias("probability"))
    made = c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("seg"), base.alias("start"), F.when(flat, base + 0.02).otherwise(base + F.size(words) * 0.3).alias("end"), "text", F.lit(-0.2).alias("avg_logprob"), F.lit(0.01).alias("no_speech_prob"), F.lit(1.0).alias("compression_ratio"), F.lit(0.0).alias("temperature"), F.transform(words, one).alias("words"))
    return made


_PHRASES = ("Thank you.", "thank you", "So on it goes now", "on it, goes")


@query(f"""WITH RECURSIVE g AS (SELECT conv_id::VARCHAR AS file, turn::BIGINT AS seg, turn % 3 > 0 AS flat, turn * 1000.0::DOUBLE AS start, ['thank you', 'thank you', 'so on it goes now', 'on it goes'][(conv_id * 3 + turn * turn) % 4 + 1] AS k, len({_SPLIT_SQL.format('text')})::BIGINT AS n_words, turn % 5 <> 4 AS fine FROM conversations),
x AS (SELECT *, lead(start) OVER (PARTITION BY file ORDER BY seg) AS nxt FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seg) AS idx FROM x WHERE fine),
f AS (SELECT o.*, k AS kept, true AS stays FROM o WHERE idx = 1
 UNION ALL SELECT file, seg, flat, start, k, n_words, fine, nxt, idx, CASE WHEN again THEN kept ELSE k END, NOT again FROM (SELECT o.*, f.kept, o.flat AND o.k <> '' AND f.kept <> '' AND (o.k = f.kept OR len(string_split(o.k, ' ')) >= 3 AND (contains(f.kept, o.k) OR contains(o.k, f.kept))) AS again FROM f JOIN o ON o.file = f.file AND o.idx = f.idx + 1))
SELECT file, seg, start, round(CASE WHEN NOT flat THEN start + n_words * 0.3::DOUBLE WHEN nxt IS NULL THEN start + 0.1 ELSE least(start + 0.1, greatest(nxt, start + 0.02)) END, 6) AS end, n_words FROM f WHERE stays""")
def collapsed_segments(spark, sf_dir):
    """Turns as stock phrases, two in three of them collapsed to 20 ms, one in five without text."""
    made = turn_segments(spark, sf_dir).withColumn("n", F.size("words"))
    phrase = F.get(F.array(*(F.lit(p) for p in _PHRASES)), ((F.col("file").cast("long") * 3 + F.col("seg") * F.col("seg")) % 4).cast("int"))
    short = F.col("seg") % 3 > 0
    made = made.withColumns({"text": F.when(F.col("seg") % 5 == 4, " ").otherwise(phrase), "end": F.col("start") + F.when(short, 0.02).otherwise(F.col("n") * 0.3)}).drop("n")
    found = clean.filter_segments(made)
    return found.select("file", _long(F.col("seg"), "seg"), "start", F.round("end", 6).alias("end"), _long(F.size("words"), "n_words"))


@query(f"""WITH g AS (SELECT conv_id::VARCHAR AS file, turn::BIGINT AS seg, turn % 7 = 6 AS flat, turn * 1000.0::DOUBLE AS b, len({_SPLIT_SQL.format('text')}) AS n FROM conversations),
w AS (SELECT file, seg, b, n, flat, unnest(range(n)) AS i FROM g),
t AS (SELECT *, CASE WHEN flat THEN b ELSE b + i * 0.3::DOUBLE END - CASE WHEN i = 0 THEN 50 ELSE 0 END AS s, CASE WHEN flat THEN b ELSE b + i * 0.3::DOUBLE + 0.2::DOUBLE END - CASE WHEN i = 0 THEN 50 ELSE 0 END AS e FROM w),
r AS (SELECT file, seg, b, n, flat, max(s) FILTER (i = 0) AS s0, max(e) FILTER (i = 0) AS e0, max(s) FILTER (i = 1) AS s1, max(e) FILTER (i = n - 1) AS last_e, list(e - s ORDER BY i) AS d FROM t GROUP BY file, seg, b, n, flat),
a AS (SELECT g.file, g.seg, g.b, g.n, g.flat, s0, e0, s1, last_e, d, coalesce(list_reduce(list_prepend(0.0::DOUBLE, d[2:]), lambda x, y: x + y), 0) AS rest, lead(g.b) OVER (PARTITION BY g.file ORDER BY g.seg) AS nxt FROM g LEFT JOIN r ON r.file = g.file AND r.seg = g.seg),
c AS (SELECT *, CASE WHEN n < 2 THEN NULL ELSE d[1] > rest OR (d[1] = rest AND n <= 2) END AS early, CASE WHEN flat THEN b + 0.02 ELSE b + n * 0.3::DOUBLE END AS whole FROM a),
z AS (SELECT *, CASE WHEN n < 2 THEN whole WHEN early THEN e0 + rest * CASE WHEN nxt IS NULL THEN 1 WHEN rest <= 0 OR nxt - e0 <= 0 THEN 0 ELSE least(1, (nxt - e0) / rest) END ELSE last_e END AS stop FROM c)
SELECT file, seg, round(CASE WHEN n < 2 THEN b WHEN early THEN s0 ELSE greatest(s1 - d[1], coalesce(lag(stop) OVER (PARTITION BY file ORDER BY seg), 0)) END, 6) AS start, round(stop, 6) AS end FROM z""")
def repaired_straddles(spark, sf_dir):
    s = turn_segments(spark, sf_dir)
    far = F.transform("words", lambda w, i: F.when(i == 0, F.struct((w["start"] - 50).alias("start"), (w["end"] - 50).alias("end"), w["word"].alias("word"), w["probability"].alias("probability"))).otherwise(w))
    return clean.repair_straddles(s.withColumn("words", far)).select("file", _long(F.col("seg"), "seg"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


# --- sentences and punctuation -------------------------------------------------------------------------------------


def turn_words(spark, sf_dir) -> DataFrame:
    c = _dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return c.select("conv_id", "turn", F.posexplode(normalize.words_of(F.col("text"))).alias("pos", "word"))


_WORDS_SQL = f"SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT conv_id, turn, {_SPLIT_SQL.format('text')} AS ws FROM conversations)"
_STEM_SQL = "trim(left(word, length(word) - 1), " + _PUNCT_SQL + ")"
_ABB_SQL = ", ".join(f"'{a}'" for a in punctuation.ABBREVIATIONS)
_ENDS_SQL = f"(CASE WHEN right(word, 1) NOT IN ('.', '?', '!', '。', '？', '！') THEN false WHEN right(word, 1) <> '.' THEN true WHEN {_STEM_SQL} = '' THEN true WHEN regexp_matches({_STEM_SQL}, '^\\p{{Latin}}$') THEN false ELSE lower({_STEM_SQL}) NOT IN ({_ABB_SQL}) END)"


@query(f"SELECT conv_id, turn, pos::BIGINT AS pos, {_ENDS_SQL} AS closes FROM ({_WORDS_SQL})")
def sentence_ends(spark, sf_dir):
    return turn_words(spark, sf_dir).select("conv_id", "turn", _long(F.col("pos"), "pos"), punctuation.ends_sentence(F.col("word")).alias("closes"))


@query(f"""WITH w AS (SELECT conv_id, turn, pos, word, {_ENDS_SQL} AS closes FROM ({_WORDS_SQL})),
s AS (SELECT *, sum(coalesce(lag_c, 0)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT *, lag(closes::INT) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS lag_c FROM w))
SELECT concat_ws('#', conv_id, turn) AS file, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY sid) - 1)::BIGINT AS sentence, string_agg(word, ' ' ORDER BY pos) AS text, count(*)::BIGINT AS n_words, min((pos * 37 + 11) % 100) / 100.0::DOUBLE AS min_word_probability
FROM s GROUP BY conv_id, turn, sid""")
def sentence_split(spark, sf_dir):
    seg = turn_segments(spark, sf_dir).withColumns({"file": F.concat_ws("#", "file", "seg"), "seg": F.lit(0)})
    # Collapsed times would still be in order; sentences look at punctuation only.
    out = sentences.to_sentences(seg, max_gap=1e9, max_words=100_000)
    return out.select("file", "sentence", "text", _long(F.size(F.split("text", " ")), "n_words"), "min_word_probability")


def paused_segments(spark, sf_dir) -> DataFrame:
    """Each turn as a file of one segment: words of a quarter second, with a pause that grows every fifth word and a long one every 17th."""
    c = _dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    at = lambda i: i * 0.5 + F.floor(i / 5) * F.floor(i / 5) * 0.125 + F.floor(i / 17) * 6.0
    one = lambda w, i: F.struct(at(i).alias("start"), (at(i) + 0.25).alias("end"), F.concat(F.lit(" "), w).alias("word"), ((i * 37 + 11) % 128 / 128.0).alias("probability"))
    return c.select(F.concat_ws("#", "conv_id", "turn").alias("file"), F.lit(0).alias("seg"), F.lit(0.0).alias("start"), F.lit(900.0).alias("end"), F.rtrim("text", F.lit(".?!")).alias("text"), F.lit(-0.2).alias("avg_logprob"), F.lit(0.01).alias("no_speech_prob"), F.lit(1.0).alias("compression_ratio"), F.lit(0.0).alias("temperature"), F.transform(normalize.words_of(F.rtrim("text", F.lit(".?!"))), one).alias("words"))


def _paused_words_sql() -> str:
    """The words of paused_segments with their starts."""
    return f"""SELECT concat_ws('#', conv_id, turn) AS file, word, pos, pos * 0.5 + (pos // 5) * (pos // 5) * 0.125 + (pos // 17) * 6.0::DOUBLE AS s, {_ENDS_SQL} AS closes FROM ({_WORDS_SQL.replace("SELECT conv_id, turn, " + _SPLIT_SQL.format('text'), "SELECT conv_id, turn, " + _SPLIT_SQL.format("rtrim(text, '.?!')"))})"""


_BOUNDED_SQL = f"""WITH RECURSIVE w AS ({_paused_words_sql()}),
a AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid, s - lag(s + 0.25) OVER (PARTITION BY file ORDER BY pos) AS gap, last_value(closes) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closed FROM w),
b AS (SELECT *, CASE WHEN NOT closed AND sid = max(sid) OVER (PARTITION BY file) AND lag(sid) OVER (PARTITION BY file ORDER BY pos) = sid AND gap > 5 THEN 1 ELSE 0 END AS cut FROM a),
c AS (SELECT *, sid + sum(cut) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM b),
l AS (SELECT file, grp, list(word ORDER BY pos) AS ws, list(gap ORDER BY pos) AS gaps, list((pos * 37 + 11) % 128 / 128.0::DOUBLE ORDER BY pos) AS pr, list(s ORDER BY pos) AS ss FROM c GROUP BY file, grp),
cuts AS (SELECT file, grp, 0::BIGINT AS lo, len(ws) AS hi, gaps FROM l
 UNION ALL SELECT file, grp, unnest([lo, m]), unnest([m, hi]), gaps FROM (SELECT *, lo + list_position(gaps[lo + 2 : hi], list_max(gaps[lo + 2 : hi])) AS m FROM cuts WHERE hi - lo > 12)),
p AS (SELECT l.file, l.grp, lo, trim(array_to_string(ws[lo + 1 : hi], ' ')) AS text, list_min(pr[lo + 1 : hi]) AS mi, list_avg(pr[lo + 1 : hi]) AS me, ss[lo + 1] AS start, ss[hi] + 0.25 AS stop FROM cuts JOIN l ON l.file = cuts.file AND l.grp = cuts.grp WHERE hi - lo <= 12)"""


@query(_BOUNDED_SQL + " SELECT file, row_number() OVER (PARTITION BY file ORDER BY grp, lo) - 1 AS sentence, start, stop AS end, text, round(mi, 4) AS min_word_probability, round(me, 4) AS mean_word_probability FROM p WHERE text <> ''")
def sentence_bounded(spark, sf_dir):
    """Open ends split at long pauses, and captions of more than twelve words at their widest pause."""
    return sentences.to_sentences(paused_segments(spark, sf_dir), max_gap=5.0, max_words=12).select("file", "sentence", "start", "end", "text", "min_word_probability", "mean_word_probability")


_MARKS_RE = "[.,!?;:…。？！、，；：-]+$"
_CORE_SQL = f"regexp_replace(word, '{_MARKS_RE}', '')"
_AFFIX_SQL = f"CASE WHEN {_CORE_SQL} = '' THEN word ELSE {_CORE_SQL} END AS core, CASE WHEN {_CORE_SQL} = '' THEN '' ELSE substr(word, length({_CORE_SQL}) + 1) END AS trail"


@query(f"SELECT conv_id, turn, pos::BIGINT AS pos, {_AFFIX_SQL} FROM ({_WORDS_SQL})")
def word_affixes(spark, sf_dir):
    a = punctuation.affixes(F.concat(F.lit(" "), F.col("word")))
    return turn_words(spark, sf_dir).withColumn("a", a).select("conv_id", "turn", _long(F.col("pos"), "pos"), F.col("a.core").alias("core"), F.col("a.trail").alias("trail"))


_LABEL_SQL = "['0', '.', ',', '?', '-', ':'][(pos * 5 + turn) % 6 + 1]"


def _merged_sql() -> str:
    """Words of turns with core, the mark to write, and the one with demotion."""
    return f"""WITH a AS (SELECT conv_id, turn, pos, word, {_AFFIX_SQL}, {_LABEL_SQL} AS label, ((pos * 31) % 100) / 100.0::DOUBLE AS conf FROM ({_WORDS_SQL})),
b AS (SELECT *, trail <> '' AND right(trail, 1) IN ('.', '!', '?', '…', '。', '？', '！') AS te, label IN ('.', '?') AS le, CASE WHEN label = '0' THEN '' ELSE label END AS plain FROM a)
SELECT conv_id, turn, pos, word, core, CASE WHEN te AND NOT le THEN CASE WHEN conf >= 0.9 THEN plain ELSE trail END WHEN te THEN trail WHEN le THEN label WHEN trail <> '' THEN trail ELSE plain END AS demoted,
 CASE WHEN te THEN trail WHEN le THEN label WHEN trail <> '' THEN trail ELSE plain END AS mark FROM b"""


@query(f"SELECT conv_id, turn, pos::BIGINT AS pos, mark, demoted FROM ({_merged_sql()})")
def merge_mark(spark, sf_dir):
    labels = F.array(*(F.lit(x) for x in ("0", ".", ",", "?", "-", ":")))
    label = F.get(labels, ((F.col("pos") * 5 + F.col("turn")) % 6).cast("int"))
    conf = (F.col("pos") * 31) % 100 / 100.0
    trail = punctuation.affixes(F.col("word"))["trail"]
    mark, demoted = punctuation.merged_mark(trail, label, conf), punctuation.merged_mark(trail, label, conf, 0.9, demote=True)
    return turn_words(spark, sf_dir).select("conv_id", "turn", _long(F.col("pos"), "pos"), mark.alias("mark"), demoted.alias("demoted"))


@query(f"""WITH a AS (SELECT conv_id, turn, pos, word, {_ENDS_SQL} AS closes FROM ({_WORDS_SQL})),
b AS (SELECT *, coalesce(lag(closes) OVER (PARTITION BY conv_id, turn ORDER BY pos), true) AS first FROM a)
SELECT conv_id, turn, pos::BIGINT AS pos, CASE WHEN first AND regexp_matches(word, '\\p{{L}}') THEN regexp_extract(word, '^([^\\p{{L}}]*)', 1) || upper(regexp_extract(word, '^[^\\p{{L}}]*(\\p{{L}})', 1)) || substr(word, length(regexp_extract(word, '^([^\\p{{L}}]*)', 1)) + 2) ELSE word END AS word FROM b""")
def recase(spark, sf_dir):
    return punctuation.recase(turn_words(spark, sf_dir), ["conv_id", "turn"], ["pos"]).select("conv_id", "turn", _long(F.col("pos"), "pos"), "word")


@query("""WITH w AS (SELECT doc_id, n_chars AS n, greatest(ceil((n_chars - 200) / 150.0), 0)::BIGINT AS last FROM documents),
e AS (SELECT doc_id, n, last, unnest(range(last + 1)) AS k FROM w)
SELECT doc_id, (k * 150)::BIGINT AS start, least(k * 150 + 200, n)::BIGINT AS stop, (CASE WHEN k = 0 THEN 0 ELSE k * 150 + 25 END)::BIGINT AS keep_from, (CASE WHEN k = last THEN n ELSE k * 150 + 175 END)::BIGINT AS keep_to FROM e""")
def overlap_windows(spark, sf_dir):
    w = _t(spark, sf_dir, "documents").select("doc_id", F.explode(punctuation.windows(F.col("n_chars"))).alias("w"))
    return w.select("doc_id", *(_long(F.col(f"w.{n}"), n) for n in ("start", "stop", "keep_from", "keep_to")))


@query("""WITH s AS (SELECT o_orderkey, (o_custkey % 500)::BIGINT AS a, (o_custkey % 500 + o_orderkey % 200 + 1)::BIGINT AS b FROM orders), e AS (SELECT o_orderkey, b, unnest(range(a, b, 30)) AS c FROM s)
SELECT o_orderkey, c::BIGINT AS start, least(c + 30, b)::BIGINT AS stop FROM e""")
def checkpoints(spark, sf_dir):
    s = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 500).alias("a"), (F.col("o_custkey") % 500 + F.col("o_orderkey") % 200 + 1).alias("b"))
    return s.select("o_orderkey", F.explode(reports.checkpoints(F.col("a"), F.col("b"))).alias("w")).select("o_orderkey", _long(F.col("w.start"), "start"), _long(F.col("w.end"), "stop"))


# --- subtitles -----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, format('{:02d}:{:02d}:{:02d}', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS clock, n_chars::DOUBLE + (doc_id * 37 % 1000) / 1000.0::DOUBLE AS seconds, n_chars::DOUBLE AS whole FROM documents""")
def timecodes(spark, sf_dir):
    """Clocks read back with milliseconds behind a comma or a dot, and without any."""
    clock = subtitles.clock(F.col("n_chars"))
    mark = F.when(F.col("doc_id") % 2 == 0, ",").otherwise(".")
    ms = F.lpad((F.col("doc_id") * 37 % 1000).cast("string"), 3, "0")
    return _t(spark, sf_dir, "documents").select("doc_id", clock.alias("clock"), subtitles.seconds(F.concat(clock, mark, ms)).alias("seconds"), subtitles.seconds(clock).cast("double").alias("whole"))


_MARKUP_SQL = "html"
for _p in subtitles.MARKUP:
    _MARKUP_SQL = "regexp_replace(" + _MARKUP_SQL + ", '" + _p.replace("'", "''") + "', ' ', 'g')"


@query(f"SELECT page_id, array_to_string({_SPLIT_SQL.format(_MARKUP_SQL)}, ' ') AS plain FROM pages")
def markup_strip(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(normalize.words_of(subtitles.strip_markup(F.col("html"))), " ").alias("plain"))


def _cue_file(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").withColumn("line", F.regexp_replace("text", r"[\r\n]+", " "))
    at = lambda s: F.concat(subtitles.clock(s), F.lit(",500"))
    block = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), at(F.col("turn") * 10), F.lit(" --> "), at(F.col("turn") * 10 + 4), F.lit("\n- <i>"), F.col("line"), F.lit("</i>\nsynced by someone"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", block.alias("b"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("body"))


@query(r"""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue, regexp_replace(text, '[\r\n]+', ' ', 'g') AS line FROM conversations),
d AS (SELECT conv_id, turn, cue, regexp_replace(regexp_replace('- ' || regexp_replace(line, '<[^>]+>|\{[^}]*\}', '', 'g'), '^\s*[-–—]\s*', ''), '^\s+|\s+$', '', 'g') AS text FROM c)
SELECT conv_id, cue::BIGINT AS cue, turn * 10 + 0.5::DOUBLE AS cue_start, turn * 10 + 4.5::DOUBLE AS cue_end, text FROM d WHERE text <> ''
AND NOT regexp_matches(text, '(?i)(subtitle|www\.|http|\.me|\.com|opensubtitles|movieddl|downloaded from|api\.|encoded by|sync(ed)? by|corrected by)')""")
def cue_lines(spark, sf_dir):
    lines = subtitles.spoken_lines(subtitles.cues(_cue_file(spark, sf_dir)))
    return lines.select("conv_id", _long(F.col("cue"), "cue"), F.col("cue_start").cast("double").alias("cue_start"), F.col("cue_end").cast("double").alias("cue_end"), "text")


@query(f"""WITH m AS ({_MOMENTS_SQL}) SELECT c.seg AS cue_id, s.seg AS span_id FROM m c JOIN m s ON c.file = s.file AND s.text = 'purchase' AND c.stop >= s.start - 3600 AND c.start <= s.start + 3600""")
def cue_overlap(spark, sf_dir):
    m = _moments(spark, sf_dir)
    cues = m.select("file", F.col("seg").alias("cue_id"), F.col("start").alias("cue_start"), F.col("end").alias("cue_end"))
    spans = m.where(F.col("text") == "purchase").select("file", F.col("seg").alias("span_id"), (F.col("start") - 3600).alias("span_start"), (F.col("start") + 3600).alias("span_end"))
    return pairing.overlapping(cues, spans, ["file"], bucket=3600.0).select("cue_id", "span_id")


# --- pairing -------------------------------------------------------------------------------------------------------

_STEM_URL = "regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')"


@query(f"""WITH r AS (SELECT DISTINCT {_STEM_URL} || CASE WHEN page_id % 3 = 0 THEN '' ELSE '_' || (page_id % 2) END AS key FROM pages),
h AS (SELECT page_id, url AS name, {_STEM_URL} AS stem FROM pages), ids AS (SELECT lower(split_part(key, '_', 1)) AS id, count(*) AS n, min(key) AS k FROM r GROUP BY 1)
SELECT h.page_id, CASE WHEN e.key IS NOT NULL THEN e.key WHEN i.n = 1 THEN i.k END AS ref_key, CASE WHEN e.key IS NOT NULL THEN 'exact' WHEN i.n = 1 THEN 'id' WHEN i.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM h LEFT JOIN r e ON e.key = h.stem LEFT JOIN ids i ON i.id = lower(h.stem)""")
def stem_pairing(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    suffix = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("_"), (F.col("page_id") % 2).cast("string")))
    refs = p.select(F.concat(text.stem(F.col("url")), suffix).alias("key")).distinct().withColumn("ref", F.col("key"))
    hyps = p.select(F.col("url").alias("name"), F.col("page_id").alias("hyp"))
    return pairing.pair(hyps, refs).select(F.col("hyp").alias("page_id"), "ref_key", "status")


@query(f"""WITH r AS (SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN {_STEM_URL} ELSE lower({_STEM_URL}) || '_x' END AS key FROM pages WHERE page_id % 2 = 0)
SELECT page_id FROM pages WHERE {_STEM_URL} IN (SELECT key FROM r) OR lower({_STEM_URL}) IN (SELECT lower(split_part(key, '_', 1)) FROM r)""")
def media_semi(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    s = text.stem(F.col("url"))
    refs = p.where(F.col("page_id") % 2 == 0).select(F.when(F.col("page_id") % 4 == 0, s).otherwise(F.concat(F.lower(s), F.lit("_x"))).alias("key")).distinct()
    return pairing.with_reference(p.select("page_id", F.col("url").alias("path")), refs).select("page_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def exclude_anti(spark, sf_dir):
    urgent = _t(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return pairing.excluding(_t(spark, sf_dir, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey", "c_mktsegment")


@query("""WITH a AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.n, 0)::BIGINT AS n_a, coalesce(b.n, 0)::BIGINT AS n_b FROM a FULL JOIN b ON a.conv_id = b.conv_id""")
def counts_full_outer(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    n = lambda role: c.where(F.col("role") == role).groupBy("conv_id").agg(F.count("*").alias("n"))
    return pairing.counts_side_by_side(n("user"), n("system"), "conv_id")


_SIDES_SQL = """WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations),
a AS (SELECT * FROM n WHERE role = 'user'), b AS (SELECT * FROM n WHERE role = 'assistant'),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.i, b.i)::BIGINT AS i, coalesce(a.text, '—') AS a, coalesce(b.text, '—') AS b FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.i = b.i)"""


@query(_SIDES_SQL + " SELECT * FROM j")
def side_by_side(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    out = pairing.side_by_side(c.where(F.col("role") == "user"), c.where(F.col("role") == "assistant"), "conv_id", ["turn"])
    return out.withColumn("i", F.col("i").cast("long"))


@query(_SIDES_SQL + ", k AS (SELECT *, max(i) OVER (PARTITION BY conv_id) AS m FROM j) SELECT conv_id, i, a, b, greatest(m - 2, 0)::BIGINT AS omitted FROM k WHERE i <= 2")
def first_n(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    out = pairing.side_by_side(c.where(F.col("role") == "user"), c.where(F.col("role") == "assistant"), "conv_id", ["turn"], limit=2)
    return out.select("conv_id", _long(F.col("i"), "i"), "a", "b", _long(F.col("omitted"), "omitted"))


@query("SELECT lower(split_part(c_mktsegment || '_' || c_custkey, '_', 1)) || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS id, count(DISTINCT c_custkey)::BIGINT AS n FROM customer GROUP BY 1")
def leading_ids(spark, sf_dir):
    name = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "X").otherwise(""), F.lit("_"), F.col("c_custkey").cast("string"), F.lit("_b"))
    return _t(spark, sf_dir, "customer").groupBy(text.leading_id(name).alias("id")).agg(F.count_distinct("c_custkey").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) AS text, min(o_orderkey) AS f FROM orders GROUP BY 1)
SELECT a.id, a.text, c_name AS partner FROM a JOIN customer ON c_custkey = a.id ORDER BY f, a.id LIMIT 40""")
def partner_sample(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("text"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("text"))
    return pairing.sample_with_partner(o, c, 40)


@query("""WITH a AS (SELECT conv_id AS batch, turn + 1 AS i, text FROM conversations), r AS (SELECT conv_id AS batch, turn + 1 AS i, text AS reply FROM conversations WHERE turn % 3 <> 1 AND trim(text) <> '')
SELECT a.batch, a.i::BIGINT AS i, a.text, r.reply FROM a LEFT JOIN r ON a.batch = r.batch AND a.i = r.i""")
def matched_replies(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    asked = c.select(F.col("conv_id").alias("batch"), (F.col("turn") + 1).alias("i"), "text")
    replies = c.where(F.col("turn") % 3 != 1).select(F.col("conv_id").alias("batch"), F.col("turn").alias("seq"), (F.col("turn") + 1).alias("id"), F.col("text").alias("reply"))
    return pairing.matched_replies(asked, replies.unionByName(replies.withColumn("id", F.lit(99_999).cast("long"))))


# --- strings, tags, reports ----------------------------------------------------------------------------------------

_TAIL_SQL = """WITH b AS (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM benchmark), w AS (SELECT item_id, t, right(t, 100) AS w FROM b),
c AS (SELECT item_id, t, w, least(nullif(instr(w, '. '), 0) + 1, nullif(instr(w, '? '), 0) + 1, nullif(instr(w, '! '), 0) + 1) AS s, nullif(instr(w, ' '), 0) AS p FROM w)
SELECT item_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 100 THEN t WHEN coalesce(s, p) IS NULL THEN w ELSE nullif(regexp_replace(substr(w, coalesce(s, p) + 1), '^\\s+|\\s+$', '', 'g'), '') END AS tail FROM c"""


@query(_TAIL_SQL)
def context_tail(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", text.context_tail(F.col("text")).alias("tail"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
w AS (SELECT *, right(t, 100) AS w FROM t), c AS (SELECT *, least(nullif(instr(w, '. '), 0) + 1, nullif(instr(w, '? '), 0) + 1, nullif(instr(w, '! '), 0) + 1) AS s, nullif(instr(w, ' '), 0) AS p FROM w),
x AS (SELECT conv_id, turn, role, CASE WHEN t = '' THEN NULL WHEN length(t) <= 100 THEN t WHEN coalesce(s, p) IS NULL THEN w ELSE nullif(regexp_replace(substr(w, coalesce(s, p) + 1), '^\\s+|\\s+$', '', 'g'), '') END AS tail FROM c)
SELECT conv_id, turn, lag(tail) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_language FROM x""")
def carried_context(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("language", F.col("role"))
    return context.prompts(c, "conv_id", "turn").select("conv_id", "turn", "prompt", "previous_language")


@query("""SELECT event_id, json_valid(props) AS parsed, CASE WHEN json_valid(props) THEN props END AS object FROM events""")
def json_in_reply(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("reply", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is:\n"), "props", F.lit("\nDone."))).otherwise(F.col("props")))
    found = text.json_object(F.col("reply"))
    return e.select("event_id", found.isNotNull().alias("parsed"), found.alias("object"))


def _event_tags(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    info = F.struct(F.lit("en").alias("language"), F.when(F.col("event_type") == "click", "m1").alias("model"), *(F.lit(None).cast("double").alias(n) for n in ("probability", "avg_logprob", "no_speech_prob", "compression_ratio", "temperature", "min_word_probability", "mean_word_probability")))
    return e.select(ms.alias("start_time"), (ms + 5).alias("end_time"), F.col("event_type").alias("tag"), F.lit(None).cast("array<double>").alias("vector"), F.concat(F.lit("/media/"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("source_media"), F.when(F.col("event_id") % 4 == 0, "auto_captions").otherwise("").alias("track"), info.alias("additional_info"), F.lit(None).cast("string").alias("frame_info"))


_TAG_SQL = "SELECT epoch_us(ts) // 1000 AS start_time, event_type AS tag, '/media/' || user_id || '.mp4' AS media, CASE WHEN event_id % 4 = 0 THEN 'auto_captions' ELSE '' END AS track FROM events"


@query(f"""SELECT '{{"type":"tag","data":{{"start_time":' || start_time || ',"end_time":' || (start_time + 5) || ',"tag":"' || tag || '","vector":null,"source_media":"' || media || '","track":"' || track || '","additional_info":{{"language":"en"' || CASE WHEN tag = 'click' THEN ',"model":"m1"' ELSE '' END || '}},"frame_info":null}}}}' AS value FROM ({_TAG_SQL})""")
def tag_jsonl(spark, sf_dir):
    return writers.tag_lines(_event_tags(spark, sf_dir))


@query(f"SELECT media AS name, string_agg(tag, ' ' ORDER BY start_time, tag) AS hyp, count(*)::BIGINT AS n FROM ({_TAG_SQL}) WHERE track = '' GROUP BY media")
def tag_texts(spark, sf_dir):
    """Tags through their JSON form and back: one track, joined by medium."""
    from .schema import TAG_MESSAGE

    lines = writers.tag_lines(_event_tags(spark, sf_dir)).select(F.from_json("value", TAG_MESSAGE).alias("m")).where((F.col("m.type") == "tag") & (F.coalesce("m.data.track", F.lit("")) == "")).select("m.data.*")
    ordered = F.sort_array(F.collect_list(F.struct("start_time", "tag")))
    return lines.groupBy(F.col("source_media").alias("name")).agg(F.array_join(F.transform(ordered, lambda x: x["tag"]), " ").alias("hyp"), F.count("*").alias("n"))


@query(f"SELECT track, count(*)::BIGINT AS n FROM ({_TAG_SQL}) GROUP BY track")
def captions_per_track(spark, sf_dir):
    return reports.captions_per_track(_event_tags(spark, sf_dir))


@query(f"SELECT media AS source_media, count(*)::BIGINT AS n FROM ({_TAG_SQL}) WHERE track = '' GROUP BY media")
def words_per_file(spark, sf_dir):
    return reports.words_per_file(_event_tags(spark, sf_dir))


@query("""SELECT l_returnflag, count(*)::BIGINT AS files, sum(l_quantity)::DOUBLE AS audio_s, sum(l_linenumber)::DOUBLE AS wall_s, max(CASE WHEN l_linenumber > 1 THEN l_suppkey END) AS peak_gpu_mib, max(l_partkey) AS peak_rss_mib,
 CASE WHEN sum(l_linenumber) = 0 THEN 0.0 ELSE sum(l_quantity)::DOUBLE / sum(l_linenumber)::DOUBLE END AS rtf FROM lineitem GROUP BY 1""")
def rtf_totals(spark, sf_dir):
    files = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("audio_s"), F.col("l_linenumber").cast("double").alias("wall_s"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("gpu_mib"), F.col("l_partkey").alias("rss_mib"))
    return reports.speed_totals(files, ["l_returnflag"])


@query("SELECT event_type, count(*)::BIGINT AS n, sum(floor(value))::DOUBLE AS duration FROM events GROUP BY ROLLUP (event_type)")
def duration_totals(spark, sf_dir):
    spans = _t(spark, sf_dir, "events").select("event_type", F.lit(0.0).alias("start"), F.floor("value").cast("double").alias("end"))
    return reports.duration_totals(spans, "event_type")


_SYS_SQL = f"WITH x AS ({_SCORES_SQL}), r AS (SELECT source AS system, lang AS track, {_RATES_SQL.format('0.0::DOUBLE')} FROM x GROUP BY source, lang)"


@query(_SYS_SQL + " SELECT r.system, r.track, r.wer, r.wer - b.wer AS delta FROM r JOIN r b ON b.track = r.track AND b.system = 'src0' WHERE r.system <> 'src0'")
def system_delta(spark, sf_dir):
    pooled = metrics.pooled(_scores(spark, sf_dir), ["source", "lang"]).select(F.col("source").alias("system"), F.col("lang").alias("track"), "wer")
    return reports.system_deltas(pooled, "src0").select("system", "track", "wer", "delta")


@query(_SYS_SQL + " SELECT system AS excerpt, max(wer) FILTER (track = 'en') AS en, max(wer) FILTER (track = 'fr') AS fr FROM r GROUP BY system")
def scores_by_model(spark, sf_dir):
    pooled = metrics.pooled(_scores(spark, sf_dir), ["source", "lang"]).select(F.col("source").alias("excerpt"), F.col("lang").alias("model"), "wer")
    return reports.by_model(pooled, ["en", "fr"])


@query("""WITH old AS (SELECT p_brand AS system, count(*) AS n FROM part GROUP BY 1), new AS (SELECT p_brand AS system, sum(p_size)::BIGINT AS n FROM part WHERE p_size > 25 AND p_brand < 'Brand#3' GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE system NOT IN (SELECT system FROM new)""")
def merged_summary(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    old = p.groupBy(F.col("p_brand").alias("system")).agg(F.count("*").alias("n"))
    new = p.where((F.col("p_size") > 25) & (F.col("p_brand") < "Brand#3")).groupBy(F.col("p_brand").alias("system")).agg(F.sum("p_size").alias("n"))
    return reports.merged_summary(old, new, "system")


@query("""WITH l AS (SELECT r_regionkey, r_name, n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |' AS line FROM region JOIN nation ON n_regionkey = r_regionkey),
s AS (SELECT r_name, '
## ' || r_name || '

| n_nationkey | n_name |
|---|---|
' || string_agg(line, chr(10) ORDER BY n_nationkey) AS t FROM l GROUP BY r_name)
SELECT '# Nations
' || string_agg(t, chr(10) ORDER BY r_name) AS body FROM s""")
def markdown_report(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.markdown(rows, "r_name", ["n_nationkey", "n_name"], ["n_nationkey"], "Nations")


from . import catalog_rows  # noqa: E402, F401  (registers its queries here)
