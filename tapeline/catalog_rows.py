"""More of the registry: single filters and expressions, tags, and files that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _BOUNDED_SQL, _ENDS_SQL, _MARKUP_SQL, _PUNCT_SQL, _SPLIT_SQL, _TAG_SQL, _WORDS_SQL, _cue_file, _event_tags, _line_tokens_sql, _long, _merged_sql, _paused_words_sql, _t, paused_segments, query, turn_words
from .functions import normalize, punctuation, subtitles
from .operators import clean, metrics, pairing, reports, sentences
from .plans import models
from .schema import EXCERPT_FILE
from .sources import readers, writers
from .sources.scratch import scratch_folder
from .streaming import context

# --- filters and predicates ----------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn FROM conversations WHERE trim(CASE WHEN turn % 4 = 0 THEN chr(9) || ' ' ELSE text END) <> ''
 AND NOT ((conv_id % 10) / 10.0 > 0.6 AND (turn % 5) / -2.0 < -1.0) AND NOT ((turn % 3) / 5.0 > 0 AND (conv_id % 7) / 2.0 > 2.4)
 AND turn % 4 <> 0""")
def kept_segments(spark, sf_dir):
    """Blank text, silence by two signals, and repetition by temperature and compression, in one pass."""
    c = _t(spark, sf_dir, "conversations")
    signals = {"no_speech_prob": F.col("conv_id") % 10 / 10.0, "avg_logprob": F.col("turn") % 5 / -2.0, "temperature": F.col("turn") % 3 / 5.0, "compression_ratio": F.col("conv_id") % 7 / 2.0}
    return clean.drop_bad(c.withColumns(signals | {"text": F.when(F.col("turn") % 4 == 0, "\t ").otherwise(F.col("text"))})).select("conv_id", "turn")


_PART_KEYS = f"lower(translate(p_type, {_PUNCT_SQL}, repeat(chr(1), 0)))"


@query(f"""WITH k AS (SELECT p_partkey, {_PART_KEYS} AS a, CASE p_partkey % 4 WHEN 0 THEN {_PART_KEYS} WHEN 1 THEN 'so ' || {_PART_KEYS} || ' again' WHEN 2 THEN split_part({_PART_KEYS}, ' ', 1) ELSE '' END AS b FROM part)
SELECT p_partkey, a <> '' AND b <> '' AND (a = b OR (len(string_split(a, ' ')) >= 3 AND (contains(b, a) OR contains(a, b)))) AS again FROM k""")
def repeat_predicate(spark, sf_dir):
    """Equal phrases, phrases inside others, single words, and nothing to compare with."""
    a = normalize.phrase_key(F.col("p_type"))
    which = F.col("p_partkey") % 4
    b = F.when(which == 0, a).when(which == 1, F.concat(F.lit("so "), a, F.lit(" again"))).when(which == 2, F.split_part(a, F.lit(" "), F.lit(1))).otherwise("")
    return _t(spark, sf_dir, "part").select("p_partkey", clean.repeats(a, b).alias("again"))


_LANGUAGES = ("en", "zh", "fr", "ja", "yue", "th", "de", "lo", "my", "km", "ko")


@query(f"SELECT doc_id, [{', '.join(repr(x) for x in _LANGUAGES)}][doc_id % 12 + 1] AS language, coalesce([{', '.join(repr(x) for x in _LANGUAGES)}][doc_id % 12 + 1] IN ({', '.join(repr(x) for x in normalize.UNSEGMENTED)}), false) AS by_characters FROM documents")
def language_class(spark, sf_dir):
    lang = F.get(F.array(*(F.lit(x) for x in _LANGUAGES)), (F.col("doc_id") % 12).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", lang.alias("language"), normalize.is_unsegmented(lang).alias("by_characters"))


@query("""WITH e AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM conversations), r AS (SELECT conv_id AS id, text AS ref FROM conversations WHERE turn = 0),
h AS (SELECT 'm' || turn AS model, conv_id AS id, text AS hyp FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id AS id, text AS sub FROM conversations WHERE role = 'system' OR turn = 4)
SELECT e.id, category, model, ref, hyp, sub FROM e JOIN r ON r.id = e.id JOIN h ON h.id = e.id LEFT JOIN s ON s.id = e.id""")
def excerpt_models(spark, sf_dir):
    """Excerpts by model: those that lack a side have no row, subtitles may lack."""
    c = _t(spark, sf_dir, "conversations")
    key = F.col("conv_id").alias("id")
    excerpts = c.select(key, F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("category")).distinct()
    refs = c.where(F.col("turn") == 0).select(key, F.col("text").alias("ref"))
    hyps = c.where(F.col("role") == "assistant").select(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("model"), key, F.col("text").alias("hyp"))
    subs = c.where((F.col("role") == "system") | (F.col("turn") == 4)).select(key, F.col("text").alias("sub"))
    return pairing.excerpt_texts(excerpts, refs, hyps, subs).select("id", "category", "model", "ref", "hyp", "sub")


@query("""WITH k AS (SELECT DISTINCT c_mktsegment AS key FROM customer UNION SELECT r_name FROM region UNION SELECT 'qz' || r_regionkey FROM region)
SELECT k.key, min(n.n_name) FILTER (contains(lower(n.n_name), lower(left(k.key, 2)))) AS name FROM k CROSS JOIN nation n GROUP BY k.key""")
def substring_pairs(spark, sf_dir):
    keys = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key")).union(_t(spark, sf_dir, "region").select("r_name")).union(_t(spark, sf_dir, "region").select(F.concat(F.lit("qz"), F.col("r_regionkey").cast("string")))).distinct()
    return pairing.by_substring(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), keys)


@query("""WITH w AS (SELECT to_timestamp(floor(epoch(ts) / 300) * 300) AS s, floor(value)::BIGINT % 50 AS words FROM events) SELECT epoch(s)::BIGINT AS starts, sum(words)::BIGINT AS words FROM w GROUP BY s""")
def event_windows(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.floor("value") % 50).alias("words"))
    return context.windowed_words(e).select(F.unix_seconds("window.start").alias("starts"), _long(F.col("words"), "words"))


_PROBE_SQL = """CASE event_id % 5 WHEN 0 THEN '{"streams":[{"index":0}],"format":{"duration":"' || floor(value)::BIGINT || '.5"}}' WHEN 1 THEN '{"streams":[],"format":{"duration":"N/A"}}' WHEN 2 THEN 'no json' WHEN 3 THEN '{}' ELSE '{"streams":[{"index":1},{"index":2}]}' END"""


@query("SELECT event_id, event_id % 5 IN (0, 2, 4) AS audible, CASE WHEN event_id % 5 = 0 THEN floor(value)::DOUBLE + 0.5 END AS duration FROM events")
def media_probes(spark, sf_dir):
    """What probes say of sound and length, unreadable answers among them; joined back to the media that they leave."""
    probe = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"streams":[{"index":0}],"format":{"duration":"'), F.floor("value").cast("string"), F.lit('.5"}}')))
    probe = probe.when(F.col("event_id") % 5 == 1, '{"streams":[],"format":{"duration":"N/A"}}').when(F.col("event_id") % 5 == 2, "no json").when(F.col("event_id") % 5 == 3, "{}").otherwise('{"streams":[{"index":1},{"index":2}]}')
    probes = _t(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("path"), probe.alias("probe"))
    heard = readers.with_audio(probes.select("path"), probes).withColumn("heard", F.lit(True))
    return probes.join(heard, "path", "left").select("event_id", F.coalesce("heard", F.lit(False)).alias("audible"), readers.duration(F.col("probe")).alias("duration"))


# --- words, tags and labels ----------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\\[({{][^\\])}}]*[\\])}}]', ' ', 'g'), '[-–—]', ' ', 'g') AS t FROM conversations),
b AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda p: p <> '') AS toks FROM a)
SELECT conv_id, turn, array_to_string(toks, ' ') AS tokens FROM b""")
def bare_tokens(spark, sf_dir):
    """Apostrophes cut words here, and capitals stay."""
    rules = normalize.Rules(keep_apostrophes=False, lowercase=False)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(normalize.tokens(F.col("text"), rules), " ").alias("tokens"))


@query(f"SELECT item_id, line::BIGINT AS line, tokens FROM (SELECT item_id, unnest(range(len(l))) AS line, unnest(list_transform(l, lambda x: array_to_string(x, ' '))) AS tokens FROM (SELECT item_id, {_line_tokens_sql("regexp_replace(text, '([.?!]) ', '\\1' || chr(13) || chr(10), 'g')")} AS l FROM benchmark))")
def line_tokens(spark, sf_dir):
    lines = normalize.lines_of_tokens(F.regexp_replace("text", r"([.?!]) ", "$1\r\n"))
    return _t(spark, sf_dir, "benchmark").select("item_id", F.posexplode(lines).alias("line", "t")).select("item_id", _long(F.col("line"), "line"), F.array_join("t", " ").alias("tokens"))


@query(f"""WITH m AS (SELECT conv_id, turn, pos, core, mark, CASE WHEN regexp_matches(core, '[\\p{{L}}\\p{{N}}]') THEN core || mark ELSE word END AS word FROM ({_merged_sql()})),
a AS (SELECT *, {_ENDS_SQL} AS closes FROM m), b AS (SELECT *, coalesce(lag(closes) OVER (PARTITION BY conv_id, turn ORDER BY pos), true) AS first FROM a)
SELECT conv_id, turn, pos::BIGINT AS pos, CASE WHEN first AND regexp_matches(word, '\\p{{L}}') THEN regexp_extract(word, '^([^\\p{{L}}]*)', 1) || replace(upper(regexp_extract(word, '^[^\\p{{L}}]*(\\p{{L}})', 1)), 'ẞ', 'SS') || substr(word, length(regexp_extract(word, '^([^\\p{{L}}]*)', 1)) + 2) ELSE word END AS word FROM b""")
def applied_labels(spark, sf_dir):
    """Marks merged with a classifier's labels, then capitals at the new sentence starts."""
    labels = F.array(*(F.lit(x) for x in ("0", ".", ",", "?", "-", ":")))
    words = turn_words(spark, sf_dir).withColumns({"label": F.get(labels, ((F.col("pos") * 5 + F.col("turn")) % 6).cast("int")), "confidence": (F.col("pos") * 31) % 100 / 100.0})
    return punctuation.apply_labels(words, ["conv_id", "turn"], ["pos"]).select("conv_id", "turn", _long(F.col("pos"), "pos"), "word")


@query("""WITH w AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS n, (o_custkey % 100)::DOUBLE AS a, (o_custkey % 100)::DOUBLE + 0.1 AS b FROM orders), e AS (SELECT *, (b - a) / n AS step, unnest(range(n)) AS i FROM w)
SELECT o_orderkey, i::BIGINT AS i, round(a + i * step, 9) AS start, round(a + (i + 1) * step, 9) AS end, 'w' || i AS word FROM e""")
def stretched_words(spark, sf_dir):
    a = (F.col("o_custkey") % 100).cast("double")
    words = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 7).cast("int")), lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("word"), F.lit(0.5).alias("probability")))
    made = _t(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(clean.stretched(words, a, a + 0.1)).alias("i", "w"))
    return made.select("o_orderkey", _long(F.col("i"), "i"), F.round("w.start", 9).alias("start"), F.round("w.end", 9).alias("end"), "w.word")


_BOTH_TRACKS_SQL = f"""{_BOUNDED_SQL},
t AS (SELECT file AS source_media, '' AS track, round(s * 1000)::BIGINT AS start_time, round((s + 0.25) * 1000)::BIGINT AS end_time, word AS tag, NULL::VARCHAR AS model, round((pos * 37 + 11) % 128 / 128.0::DOUBLE, 4) AS probability, NULL::DOUBLE AS least FROM ({_paused_words_sql()})
 UNION ALL SELECT file, 'auto_captions', round(start * 1000)::BIGINT, round(stop * 1000)::BIGINT, text, 'm', NULL::DOUBLE, round(mi, 4) FROM p WHERE text <> '')"""


@query(_BOTH_TRACKS_SQL + " SELECT *, row_number() OVER (PARTITION BY source_media ORDER BY start_time, track, end_time, tag) AS place FROM t")
def both_tracks(spark, sf_dir):
    """Word and sentence tags together, in their order within each file."""
    tags = sentences.in_order(sentences.tags(paused_segments(spark, sf_dir), "m", max_gap=5.0, max_words=12)).withColumn("_at", F.monotonically_increasing_id())
    from pyspark.sql import Window as W

    placed = tags.withColumn("place", F.row_number().over(W.partitionBy("source_media").orderBy("_at")).cast("long"))
    info = F.col("additional_info")
    return placed.select("source_media", "track", "start_time", "end_time", "tag", info["model"].alias("model"), info["probability"].alias("probability"), info["min_word_probability"].alias("least"), "place")


@query(f"SELECT file, count(*)::BIGINT AS n_words, string_agg(' ' || CASE WHEN pos % 3 = 0 THEN replace(upper(word), 'ẞ', 'SS') ELSE word END, '' ORDER BY pos) AS text, max(s) + 0.25 AS last_end FROM ({_paused_words_sql()}) GROUP BY file")
def reattached_words(spark, sf_dir):
    """Rewritten words back in their segments: new text, old times."""
    segments = paused_segments(spark, sf_dir).where(F.size("words") > 0)
    words = sentences.words_of(segments).withColumn("word", F.when(F.col("pos") % 3 == 0, F.upper("word")).otherwise(F.col("word")))
    return models.reattach(segments, words).select("file", _long(F.size("words"), "n_words"), "text", F.element_at("words", -1)["end"].alias("last_end"))


# --- files: written and read again ---------------------------------------------------------------------------------


@query(f"SELECT regexp_extract(media, '([^/]*)$', 1) AS name, string_agg(tag, ' ' ORDER BY start_time, tag) AS hyp FROM ({_TAG_SQL}) WHERE track = 'auto_captions' GROUP BY media")
def tag_log(spark, sf_dir):
    """A tag log as JSON lines, read back: one track, keyed by base name."""
    place = scratch_folder(spark)
    writers.write_tags(_event_tags(spark, sf_dir), place)
    return readers.hypothesis_texts(readers.read_tags(spark, place, "auto_captions", by_basename=True))


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[\r\n]+', ' ', 'g') AS line FROM conversations),
f AS (SELECT conv_id, string_agg('- <i>' || line || '</i>' || chr(10) || 'synced by someone', chr(10) ORDER BY turn) AS html FROM c GROUP BY conv_id)
SELECT conv_id, array_to_string(""" + _SPLIT_SQL.format(_MARKUP_SQL) + ", ' ') AS plain FROM f")
def flat_subtitles(spark, sf_dir):
    return _cue_file(spark, sf_dir).select("conv_id", subtitles.flat_text(F.col("body")).alias("plain"))


@query("SELECT 'n_nationkey=' || n_nationkey AS model, n_name || chr(10) || 'second line' || chr(10) AS hyp FROM nation")
def model_folders(spark, sf_dir):
    """Texts in one folder for each key, read back as one model's hypotheses."""
    place = scratch_folder(spark)
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("\nsecond line")).alias("text"))
    writers.write_text_by_key(rows, "n_nationkey", place)
    return readers.read_hypotheses(spark, place).select("model", "hyp")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'word of ' || n_name ELSE n_name END AS ref FROM nation")
def reference_texts(spark, sf_dir):
    """References from a folder of plain texts and subtitle files, told apart by their first lines."""
    place = scratch_folder(spark)
    body = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("﻿1\n00:00:01,000 --> 00:00:02,000\n<i>word</i> of\n\n2\n00:00:03,000 --> 00:00:04,000\n"), "n_name", F.lit("\n"))).otherwise(F.concat(F.lit("  "), "n_name", F.lit(" \n")))
    writers.write_text_by_key(_t(spark, sf_dir, "nation").select("n_nationkey", body.alias("text")), "n_nationkey", place)
    return readers.read_references(spark, place).select("ref")


@query("SELECT r_regionkey::VARCHAR AS region, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN (r_regionkey * 0.25)::VARCHAR END AS rate FROM region")
def score_csv(spark, sf_dir):
    """A score table as CSV with a header; nulls are empty and come back as nulls."""
    place = scratch_folder(spark)
    rate = F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey") * F.lit(0.25).cast("decimal(4,2)"))
    writers.write_csv(_t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"), rate.alias("rate")), place)
    return spark.read.csv(place, header=True).select("region", "name", "rate")


@query("SELECT s_suppkey AS id, s_name AS model, s_nationkey::BIGINT AS n_ref FROM supplier")
def results_document(spark, sf_dir):
    """Score rows in a JSON document of several tables, read back."""
    place = scratch_folder(spark)
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("model"), F.col("s_nationkey").alias("n_ref"))
    writers.document({"per_excerpt": rows, "per_category": _t(spark, sf_dir, "region")}, {"per_excerpt": ["id"], "per_category": ["r_regionkey"]}).write.text(place)
    return readers.read_results(spark, place).select("id", "model", _long(F.col("n_ref"), "n_ref"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS film, r_name AS primary_category, [n_name, r_name] AS watch_vocab FROM nation JOIN region ON n_regionkey = r_regionkey")
def excerpt_spec(spark, sf_dir):
    """Excerpts of a specification file."""
    place = scratch_folder(spark)
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = n.select(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("film"), F.col("r_name").alias("primary_category"), F.array("n_name", "r_name").alias("watch_vocab")).alias("e"))
    one.agg(F.to_json(F.struct(F.collect_list("e").alias("excerpts"))).alias("value")).write.text(place)
    assert set(EXCERPT_FILE.fieldNames()) >= {"excerpts"}
    return readers.read_excerpts(spark, place).select("id", "film", "primary_category", "watch_vocab")


@query("""WITH x AS (SELECT source, lang, sum(n_chars % 7 + n_chars % 5 + n_chars % 3)::DOUBLE / nullif(sum(n_chars % 7 + n_chars % 5 + n_chars % 101), 0) AS wer FROM documents WHERE lang = 'en' GROUP BY source, lang)
SELECT printf('%-8s %8.3f', source, wer) AS line FROM x UNION ALL SELECT printf('%-8s %8s', 'system', 'WER') UNION ALL SELECT repeat('-', 17)""")
def console_table(spark, sf_dir):
    d, n = _t(spark, sf_dir, "documents").where(F.col("lang") == "en"), F.col("n_chars")
    scores = d.select("source", (n % 7).alias("n_sub"), (n % 5).alias("n_del"), (n % 3).alias("n_ins"), (n % 101).alias("n_match"))
    return reports.console(metrics.pooled(scores, ["source"]).select("source", "wer"), {"source": "%-8s", "wer": "%8.3f"}, ["source"], {"source": "system", "wer": "WER"})
