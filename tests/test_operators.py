"""Alignment, rates, bootstrap, cleaning, sentences and pairing."""

import math
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline import catalog
from tapeline.functions import normalize, punctuation
from tapeline.operators import alignment, bootstrap, clean, metrics, pairing, reports, sentences, translation
from tapeline.schema import SEGMENT


def counted(ref, hyp):
    ops = alignment.align_tokens(ref.split(), hyp.split())
    return tuple(sum(o == k for o, _, _ in ops) for k in ("sub", "del", "ins", "match"))


@pytest.mark.parametrize(("ref", "hyp", "want"), [("a b c d", "a x c d e", (1, 0, 1, 3)), ("a b c", "a c", (0, 1, 0, 2)), ("a b", "", (0, 2, 0, 0)), ("a b", "a b", (0, 0, 0, 2)), ("a", "x y z", (1, 0, 2, 0)), ("", "x", (0, 0, 1, 0)), ("", "", (0, 0, 0, 0))])
def test_align(ref, hyp, want):
    assert counted(ref, hyp) == want


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_ways_agree(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "i int, ref array<string>, hyp array<string>")
    got = alignment.align(df).select("i", "ref", "hyp", *alignment.counts(F.col("ops")), alignment.aligned_counts_sql(F.col("ref"), F.col("hyp")).alias("dp"), alignment.token_distance(F.col("ref"), F.col("hyp")).alias("dist")).collect()
    for r in got:
        errors = r.n_sub + r.n_del + r.n_ins
        assert errors == slow_distance(r.ref, r.hyp) == r.dist == r.dp.cost
        assert (r.dp.s, r.dp.d, r.dp.i) == (r.n_sub, r.n_del, r.n_ins)
        assert r.n_sub + r.n_del + r.n_match == len(r.ref) and r.n_sub + r.n_ins + r.n_match == len(r.hyp)


def test_score_pairs_and_buckets(spark):
    df = spark.createDataFrame([("x", "I don't know.\nMaybe today.", "I dunno maybe today"), ("y", "[noise]", "anything"), ("z", "same", "same")], "id string, ref string, hyp string")
    scored = metrics.score_pairs(df)
    got = {r.id: r for r in scored.collect()}
    assert set(got) == {"x", "z"}
    x = got["x"]
    assert (x.n_ref, x.n_sub + x.n_del + x.n_ins, x.n_match) == (5, 2, 3) and got["z"].wer == 0.0
    buckets = alignment.utterance_counts(scored, ["id"]).collect()
    assert sorted((r.id, r.utterance) for r in buckets) == [("x", 0), ("x", 1), ("z", 0)]
    for i in ("x", "z"):
        for c in metrics.COUNTS:
            assert sum(r[c] for r in buckets if r.id == i) == got[i][c]


def test_insertions_belong_to_what_follows(spark):
    df = spark.createDataFrame([("a", "one two\nthree\nfour", "zero one two extra three four tail end")], "id string, ref string, hyp string")
    got = {r.utterance: (r.n_ins, r.n_match) for r in alignment.utterance_counts(metrics.score_pairs(df), ["id"]).collect()}
    assert got == {0: (1, 2), 1: (1, 1), 2: (2, 1)}


def test_rates(spark):
    df = spark.createDataFrame([("a", "m", 1, 0, 1, 3), ("a", "m", 0, 0, 2, 0), ("b", "m", 0, 0, 0, 0)], "c string, m string, n_sub long, n_del long, n_ins long, n_match long")
    got = {r.c: (r.n_ref, r.wer, r.mer) for r in metrics.pooled(df, ["c"]).collect()}
    assert got == {"a": (4, 1.0, 4 / 7), "b": (0, 0.0, 0.0)}
    rolled = {r.c: (r.wer, r.ins_rate) for r in metrics.with_corpus(df, "c").collect()}
    assert rolled == {"a": (1.0, 0.75), "b": (None, None), None: (1.0, 0.75)}
    pair = spark.createDataFrame([(["kitten"], ["sitting"]), ([], ["ab"]), (["a", "b"], ["a", "b"])], "r array<string>, h array<string>")
    assert [r[0] for r in pair.select(metrics.cer(F.col("r"), F.col("h"))).collect()] == [0.5, 2.0, 0.0]
    asr = spark.createDataFrame([("a b c", "a c"), ("", "x")], "ref string, hyp string")
    assert tuple(metrics.asr_scores(asr, "en").first()) == (1, 0.3333, 0.4)
    assert metrics.asr_scores(asr, "zh").first().wer is None


def test_bootstrap(spark):
    rng = random.Random(2)
    rows = [("g", i, rng.randint(0, 3), rng.randint(0, 2), rng.randint(0, 2), rng.randint(3, 9)) for i in range(25)]
    df = spark.createDataFrame(rows, "k string, id int, n_sub long, n_del long, n_ins long, n_match long")
    rates = []
    for rep in range(100):
        total = [0, 0, 0, 0]
        for slot in range(25):
            x = (rep * bootstrap.STEP_R + slot * bootstrap.STEP_I + 9) % bootstrap.PRIME
            for _ in range(2):
                x = (x * bootstrap.START + 12_345) % bootstrap.PRIME
            for c in range(4):
                total[c] += rows[x % 25][2 + c]
        rates.append(sum(total[:3]) / (total[0] + total[1] + total[3]))
    rates.sort()
    got = bootstrap.rate_intervals(df, ["k"], ["id"], 100, 9).first()
    assert (got.wer_lo, got.wer_hi) == (rates[2], rates[96])
    other = df.unionByName(df.withColumn("k", F.lit("h")))
    assert bootstrap.rate_intervals(other, ["k"], ["id"], 100, 9).where("k = 'g'").first().wer_lo == rates[2]
    gap = bootstrap.gap_intervals(df, df.withColumn("n_sub", F.col("n_sub") + 3), ["k"], ["id"], 100).first()
    assert 0 < gap.lo <= gap.mean <= gap.hi


def test_registered_bootstraps_use_the_default_replicates(spark):
    sf = "/root/testdata/sf0.001"
    true, sub = catalog._buckets(spark, sf, "supplier", "s_suppkey", "s_nationkey"), catalog._buckets(spark, sf, "customer", "c_custkey", "c_nationkey")
    ordered = lambda df: sorted(map(tuple, df.collect()))
    assert ordered(catalog.queries()["bootstrap_ci"](spark, sf)) == ordered(bootstrap.rate_intervals(true, ["region"], ["id"]))
    want = bootstrap.gap_intervals(true, sub, ["region"], ["id"]).withColumn("mean", F.round("mean", 9))
    assert ordered(catalog.queries()["bootstrap_gap"](spark, sf)) == ordered(want)
    assert all("range(2000)" in catalog.oracle_sql()[q] for q in ("bootstrap_ci", "bootstrap_gap"))


def segment(i, start, end, text, logprob=-0.2, silence=0.01, ratio=1.0, temp=0.0, words=()):
    return ("f", i, float(start), float(end), text, logprob, silence, ratio, temp, [tuple(w) for w in words])


def kept_texts(df):
    return [r.text for r in df.orderBy("file", "seg").collect()]


def test_filters(spark):
    rows = [segment(0, 0, 1, "keep", -0.1, 0.99), segment(1, 1, 2, "silent", -2.0, 0.99), segment(2, 2, 3, "  "), segment(3, 3, 4, "loop", ratio=3.1, temp=0.6), segment(4, 4, 5, "calm", ratio=3.1)]
    assert kept_texts(clean.drop_bad(spark.createDataFrame(rows, SEGMENT))) == ["keep", "calm"]


def test_collapsed_segments(spark):
    word = (10.0, 10.0, " Right?", 0.9)
    rows = [
        segment(0, 0, 2, "But the prince didn't answer."), segment(1, 2.0, 2.02, "The prince didn't answer."), segment(2, 2.1, 2.12, "But the prince didn't answer."),
        segment(3, 10.0, 10.02, "Right?", words=[word, word]), segment(4, 10.06, 10.07, "right"), segment(5, 20, 21, "No, I don't know"), segment(6, 21, 21.01, "No!"), segment(7, 21.02, 21.03, "no"),
    ]
    got = clean.filter_segments(spark.createDataFrame(rows, SEGMENT)).orderBy("seg").collect()
    assert [r.seg for r in got] == [0, 3, 5, 6]
    right = got[1]
    assert right.end == pytest.approx(10.06) and [w.start for w in right.words] == pytest.approx([10.0, 10.03])
    assert got[3].end == pytest.approx(21.02)


def test_isolated_artifacts(spark):
    def run(rows, **limits):
        return kept_texts(clean.drop_artifacts(spark.createDataFrame(rows, SEGMENT), clean.Limits(**limits)))

    apart = [segment(i, 40 * i, 40 * i + 1, "Thank you.") for i in range(5)]
    assert run(apart) == []
    assert run(apart, artifact_gap=0) == ["Thank you."] * 5
    assert len(run([segment(i, 1.5 * i, 1.5 * i + 1, "Thank you.") for i in range(5)])) == 5
    company = apart[:4] + [segment(4, 160, 161, "Thank you."), segment(5, 161.2, 163, "and now for the rest of it")]
    assert run(company) == ["Thank you.", "and now for the rest of it"]
    assert len(run([segment(i, 40 * i, 40 * i + 1, t) for i, t in enumerate(["a", "b", "c", "d"])])) == 4
    assert len(run([segment(i, 40 * i, 40 * i + 1, "this is a long line") for i in range(5)])) == 5


def test_straddle(spark):
    words = [(126.71, 127.0, " Good", 0.9), (333.3, 333.6, " luck,", 0.9), (333.6, 333.92, " guys.", 0.9)]
    df = spark.createDataFrame([segment(0, 126.71, 333.92, "Good luck, guys.", words=words), segment(1, 400, 401, "x", words=[(400.0, 401.0, "x", 0.9)])], SEGMENT)
    got = clean.repair_straddles(df).orderBy("seg").collect()
    assert got[0].start == pytest.approx(333.01) and got[0].end == 333.92 and got[1].start == 400
    assert [w.end - w.start for w in got[0].words] == pytest.approx([0.29, 0.3, 0.32])
    tight = spark.createDataFrame([segment(0, 0, 332.9, "a", words=[(0.0, 332.9, "a", 0.9)])[:4] + ("a", -0.2, 0.01, 1.0, 0.0, [(0.0, 332.9, "a", 0.9)]), segment(1, 126.71, 333.92, "g", words=words)], SEGMENT)
    again = clean.repair_straddles(tight).orderBy("seg").collect()[1]
    assert again.start >= 332.9 and again.start == pytest.approx(333.01)


def spoken(tokens, step=1.0, length=0.4, probability=0.9):
    return [(i * step, i * step + length, t, probability) for i, t in enumerate(tokens)]


def captions(spark, words, **limits):
    df = spark.createDataFrame([segment(0, 0, 9, "whole", words=words)], SEGMENT)
    return [(r.text, r.start, r.end) for r in sentences.to_sentences(df, **limits).orderBy("sentence").collect()]


def test_sentences(spark):
    words = [(0.0, 0.4, " Hello", 0.9), (0.5, 0.9, " world.", 0.9), (1.0, 1.2, " How", 0.9), (1.2, 1.4, " are", 0.9), (1.4, 1.8, " you?", 0.9)]
    assert captions(spark, words) == [("Hello world.", 0.0, 0.9), ("How are you?", 1.0, 1.8)]
    assert len(captions(spark, [(0.0, 1.0, " one", 0.9), (1.0, 2.0, " two", 0.9), (42.0, 43.0, " three", 0.9)])) == 2
    assert len(captions(spark, [(0.0, 1.0, " one", 0.9), (3.0, 4.0, " two", 0.9)])) == 1
    assert len(captions(spark, [(0.0, 1.0, " one", 0.9), (42.0, 43.0, " two.", 0.9)])) == 1
    untimed = spark.createDataFrame([segment(0, 0, 1, " a "), segment(1, 1, 2, " "), segment(2, 2, 3, "b")], SEGMENT)
    assert [(r.text, r.min_word_probability) for r in sentences.to_sentences(untimed).orderBy("sentence").collect()] == [("a", None), ("b", None)]
    p = [0.3435, 0.5352, 0.4955, 0.9993, 0.9985, 0.999]
    df = spark.createDataFrame([segment(0, 0, 9, "x", words=[(float(i), i + 0.5, " w", q) for i, q in enumerate(p)])], SEGMENT)
    row = sentences.to_sentences(df).first()
    assert (row.min_word_probability, row.mean_word_probability) == (0.3435, 0.7285)


def test_bounded_captions(spark):
    words = spoken([" w"] * 7)
    words[3:] = [(s + 2, e + 2, t, q) for s, e, t, q in words[3:]]
    got = captions(spark, words, max_words=4)
    assert [t.count("w") for t, _, _ in got] == [3, 4]
    assert sentences.widest_gap_cuts([0, 1, 2, 3], [0.5, 1.5, 2.5, 3.5], 1) == [1, 2, 3]


def test_tags(spark):
    words = [(0.0, 0.4, " Hello", 0.87654), (0.5, 0.9, " world.", 0.9), (1.0, 1.1, " ", 0.1)]
    df = spark.createDataFrame([segment(0, 0, 9, "x", words=words)], SEGMENT)
    got = sentences.in_order(sentences.tags(df, "m")).collect()
    assert [(r.start_time, r.end_time, r.tag, r.track) for r in got] == [(0, 400, "Hello", ""), (0, 900, "Hello world.", "auto_captions"), (500, 900, "world.", "")]
    assert got[0].additional_info.probability == 0.8765 and got[0].additional_info.model is None and got[1].additional_info.model == "m"
    assert sentences.tags(df, "m", word_level=False).count() == 1 and sentences.tags(df, "m", False, False).count() == 0


def test_pairing(spark):
    refs = spark.createDataFrame([("clip", "r0"), ("AFGM1_jessep", "r1"), ("dup_a", "r2"), ("dup_b", "r3")], "key string, ref string")
    hyps = spark.createDataFrame([("/x/clip.mp4", "h"), ("/x/afgm1.mp4", "h"), ("/x/dup.mp4", "h"), ("/x/none.mp4", "h"), ("/x/Clip.mp4", "h")], "name string, hyp string")
    got = {r.name: (r.ref, r.status) for r in pairing.pair(hyps, refs).collect()}
    assert got == {"/x/clip.mp4": ("r0", "exact"), "/x/afgm1.mp4": ("r1", "id"), "/x/dup.mp4": (None, "ambiguous"), "/x/none.mp4": (None, "missing"), "/x/Clip.mp4": ("r0", "id")}
    with pytest.raises(ValueError):
        pairing.paired(hyps.where("name like '%none%'"), refs)
    first = pairing.by_substring(spark.createDataFrame([("Groundhog.srt",), ("Afgm.srt",), ("xx",)], "name string"), spark.createDataFrame([("AFGM1",), ("GR2",), ("ZZ",)], "key string"))
    assert {r.key: r.name for r in first.collect()} == {"AFGM1": "Afgm.srt", "GR2": "Groundhog.srt", "ZZ": None}


def test_overlap_matches_brute_force(spark):
    rng = random.Random(4)
    cues = [(rng.choice("ab"), i, s, s + rng.random() * 90) for i in range(60) for s in [rng.random() * 400]]
    spans = [(rng.choice("ab"), i, s, s + rng.random() * 200) for i in range(12) for s in [rng.random() * 400]]
    got = pairing.overlapping(spark.createDataFrame(cues, "film string, c int, cue_start double, cue_end double"), spark.createDataFrame(spans, "film string, s int, span_start double, span_end double"), ["film"], 37.0)
    want = sorted((c[1], s[1]) for c in cues for s in spans if c[0] == s[0] and c[3] >= s[2] and c[2] <= s[3])
    assert sorted((r.c, r.s) for r in got.collect()) == want


def test_side_by_side(spark):
    a = spark.createDataFrame([("f", 1, "a1"), ("f", 2, "a2"), ("f", 3, "a3")], "k string, o int, text string")
    b = spark.createDataFrame([("f", 1, "b1"), ("g", 1, "b2")], "k string, o int, text string")
    got = sorted((r.k, r.i, r.a, r.b) for r in pairing.side_by_side(a, b, "k", ["o"]).collect())
    assert got == [("f", 1, "a1", "b1"), ("f", 2, "a2", "—"), ("f", 3, "a3", "—"), ("g", 1, "—", "b2")]
    assert {(r.k, r.omitted) for r in pairing.side_by_side(a, b, "k", ["o"], 2).collect()} == {("f", 1), ("g", 0)}


def test_reports(spark):
    files = spark.createDataFrame([("s", 10.004, 0.0, None, 5), ("s", 20.0, 0.0, 7, 9), ("t", 4.0, 2.0, None, 1)], "k string, audio_s double, wall_s double, gpu_mib long, rss_mib long")
    got = {r.k: (r.audio_s, r.rtf, r.peak_gpu_mib) for r in reports.speed_totals(files, ["k"]).collect()}
    assert got == {"s": (30.0, 0.0, 7), "t": (4.0, 2.0, None)}
    assert [tuple(x) for x in spark.range(1).select(reports.checkpoints(F.lit(5), F.lit(70)).alias("w")).first().w] == [(5, 35), (35, 65), (65, 70)]
    body = reports.markdown(spark.createDataFrame([("x", 1, "a|b")], "k string, i int, t string"), "k", ["i", "t"], ["i"], "T").first().body
    assert body == "# T\n\n## x\n\n| i | t |\n|---|---|\n| 1 | a\\|b |"
    assert reports.console(files.limit(1), {"k": "%s", "audio_s": "%.1f"}).first().line == "s 10.0"
    table = spark.createDataFrame([("b", 1.25), ("a", None)], "name string, wer double")
    assert [r.line for r in reports.console(table, {"name": "%-6s", "wer": "%7.2f"}, ["name"], {"name": "file"}).collect()] == ["file       wer", "--------------", "a            -", "b         1.25"]
    parts = spark.createDataFrame([("x", 2, "c|d"), ("x", 1, "b"), ("a", 9, "e")], "k string, i int, t string")
    assert "\n".join(r.value for r in reports.markdown_lines(parts, "k", ["i", "t"], ["i"], "T").collect()) == reports.markdown(parts, "k", ["i", "t"], ["i"], "T").first().body


def test_translation_scores(spark):
    assert translation.bleu(translation.statistics("the cat sat on the mat", "the cat sat on the mat")) == pytest.approx(100)
    assert translation.chrf(translation.statistics("the cat", "the cat")) == pytest.approx(100)
    assert translation.bleu(translation.statistics("a b c d", "")) == 0.0 and translation.chrf(translation.statistics("ab", "xy")) == 0.0
    near, far = (translation.statistics("the cat sat on the mat", h) for h in ("the cat sat on a mat", "dogs bark at night here now"))
    assert 100 > translation.bleu(near) > translation.bleu(far) and 100 > translation.chrf(near) > translation.chrf(far)
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), (" ", "x")], "ref string, hyp string")
    row = translation.translation_scores(df).first()
    assert row.n == 1 and row.bleu == pytest.approx(100)
    assert translation.translation_scores(df.limit(0)).first().n == 0


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(metrics.token_jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]
    assert math.isinf(spark.range(1).select(clean.isolation(F.lit(1.0), F.lit(2.0), __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("id"))).first()[0])
    assert normalize.Rules().split_hyphens


def test_alignment_in_blocks_and_pieces(spark, monkeypatch):
    rng = random.Random(5)
    lists = [[rng.choice("abcdef") for _ in range(rng.randint(0, 25))] for _ in range(300)]
    whole = [alignment.align_tokens(r, h) for r, h in zip(lists, lists[1:])]
    for cells in (1, 60):
        monkeypatch.setattr(alignment, "CELLS", cells)
        assert [alignment.align_tokens(r, h) for r, h in zip(lists, lists[1:])] == whole
    kind = "i int, r array<string>, h array<string>"
    df = spark.createDataFrame([(i, r or None, h) for i, (r, h) in enumerate(zip(lists, lists[1:]))] + [(len(whole), ["a", None], [None])], kind).coalesce(1)
    got = {r.i: [tuple(o) for o in r.ops] for r in alignment.align(df, "r", "h").collect()}
    assert got == dict(enumerate([*whole, [("del", 0, None), ("match", 1, 0)]]))

    # What crosses back holds a few pairs, however many a partition has.
    class Frame:
        columns, schema = df.columns, df.schema

        def mapInArrow(self, run, schema):
            return [b.num_rows for b in run([pa.RecordBatch.from_pylist([{"i": 0, "r": ["a"], "h": ["b"]}] * 1000)])]

    assert max(alignment.align(Frame(), "r", "h")) <= alignment.PAIRS


def test_distance_numbers_a_vocabulary_once(spark):
    words = [f"w{i}" for i in range(1500)]
    df = spark.range(20).select(F.array(*(F.lit(w) for w in words)).alias("r"), F.array(*(F.lit(w) for w in words[1:])).alias("h"))
    began = time.time()
    assert [r.d for r in df.select(alignment.token_distance(F.col("r"), F.col("h")).alias("d")).collect()] == [1] * 20
    assert time.time() - began < 30


def test_widest_gaps_of_a_long_run(spark):
    def slow(starts, ends, most):
        cuts, open_runs = [], [(0, len(starts))]
        while open_runs:
            a, b = open_runs.pop()
            if b - a > max(most, 1):
                at = max(range(a + 1, b), key=lambda i: (starts[i] - ends[i - 1], -i))
                cuts.append(at)
                open_runs += [(a, at), (at, b)]
        return sorted(cuts)

    rng = random.Random(2)
    for _ in range(300):
        starts = [i + rng.randint(0, 3) / 2 for i in range(rng.randint(0, 40))]
        ends = [s + 0.25 for s in starts]
        most = rng.randint(0, 9)
        assert sentences.widest_gap_cuts(starts, ends, most) == slow(starts, ends, most)
    # Pauses that grow: every cut takes one word off the end.
    n = 30_000
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 1.0 + i * i).alias("start"), (i * 1.0 + i * i + 0.5).alias("end"), F.lit(" w").alias("word"), F.lit(0.5).alias("probability")))
    one = spark.range(1).select(F.lit("f").alias("file"), F.lit(0).alias("seg"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("w").alias("text"), words.alias("words"))
    began = time.time()
    made = sentences.to_sentences(one, max_gap=1e12, max_words=10)
    assert made.count() == n - 9 and time.time() - began < 30


def test_words_are_dealt_whatever_the_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, "user", f"word {i}. and more") for i in range(40)], "conv_id long, turn long, role string, text string")
    rows.coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    least = 2 * spark.sparkContext.defaultParallelism
    for made in (catalog.turn_words, catalog.turn_segments, catalog.paused_segments):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() >= least
    assert catalog.turn_words(spark, str(tmp_path)).count() == 160


def test_white_space_of_every_script_is_stripped(spark):
    white = [c for c in map(chr, range(0x3001)) if c.isspace()]
    df = spark.createDataFrame([(c, f"{c}a {c}b.{c}") for c in white], "c string, t string")
    for r in df.select("c", punctuation.strip(F.col("t")).alias("s"), punctuation.affixes(F.col("t")).alias("a")).collect():
        assert r.s == f"a {r.c}b." and tuple(r.a) == (r.c, f"a {r.c}b", ".")


def test_large_groups_are_drawn_whole(spark):
    n, seed = 40_000, 1234
    ids = F.col("id")
    df = spark.range(n).orderBy(F.hash("id")).select(F.when(ids % 40 == 0, "small").otherwise("large").alias("k"), "id", (ids % 7).alias("n_sub"), (ids % 4).alias("n_del"), (ids % 3).alias("n_ins"), (ids % 29 + 1).alias("n_match"))
    began = time.time()
    got = {(r.k, r.rep): tuple(r[c] for c in metrics.COUNTS) for r in bootstrap.replicates(df, ["k"], ["id"], 2000, seed, 1).collect()}
    assert time.time() - began < 60 and len(got) == 4000
    for k, mine in (("small", range(0, n, 40)), ("large", [i for i in range(n) if i % 40])):
        for rep in (0, 1, 1999):
            want = [0, 0, 0, 0]
            for i in range(len(mine)):
                x = (rep * bootstrap.STEP_R + i * bootstrap.STEP_I + seed + 7_919) % bootstrap.PRIME
                for _ in range(2):
                    x = (x * bootstrap.START + 12_345) % bootstrap.PRIME
                u = mine[x % len(mine)]
                want = [w + v for w, v in zip(want, (u % 7, u % 4, u % 3, u % 29 + 1))]
            assert got[k, rep] == tuple(want)
