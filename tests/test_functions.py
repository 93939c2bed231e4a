"""Truth tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from tapeline.functions import normalize, numbers, punctuation, subtitles, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


def many(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", make(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_int_words(spark):
    got = many(spark, [0, 7, 19, 20, 42, 100, 101, 999, 1000, 9800, 12_345, 100_000, 999_999, 1_000_000, -5], numbers.int_words, "long")
    assert got == ["zero", "seven", "nineteen", "twenty", "forty two", "one hundred", "one hundred one", "nine hundred ninety nine", "one thousand", "nine thousand eight hundred",
                   "twelve thousand three hundred forty five", "one hundred thousand", "nine hundred ninety nine thousand nine hundred ninety nine", "1000000", "minus five"]


def test_tokens(spark):
    ref = lambda c: F.array_join(normalize.tokens(c), " ")
    hyp = lambda c: F.array_join(normalize.tokens(c, reference=False), " ")
    assert many(spark, ["Um, I don't-- I don't know.", "[music] He said hello (phone rings)", "9800", "gluten-free whole-grain", "café—déjà ‘vu’ don’t", "", None, "ﬁne ½"], ref) == \
        ["um i don't i don't know", "he said hello", "9800", "gluten free whole grain", "café déjà vu don't", "", None, "fine 1 2"]
    assert many(spark, ["$9800", "15%", "3.14", "1,234", "9800.", "-5", "a [b", "1.5%", "99999999999999999999999"], hyp) == \
        ["nine thousand eight hundred", "fifteen percent", "three point one four", "one thousand two hundred thirty four", "9800", "five", "a b", "one point five percent", "99999999999999999999999"]
    drop = lambda c: F.array_join(normalize.tokens(c, normalize.Rules(drop_fillers=True)), " ")
    assert one(spark, "Uh-huh um well, hmm yes", drop) == "well yes"
    bare = lambda c: F.array_join(normalize.tokens(c, normalize.Rules(keep_apostrophes=False)), " ")
    assert one(spark, "don't", bare) == "don t"


def test_lines_of_tokens(spark):
    got = one(spark, "One two [three\nfour] five\r\n\n...\x85six", lambda c: normalize.lines_of_tokens(c))
    assert got == [["one", "two", "three"], ["four", "five"], ["six"]]


def test_phrase_keys(spark):
    assert many(spark, [" Thank   you. ", "THANK YOU!", "--", None], normalize.phrase_key) == ["thank you", "thank you", "", None]
    assert one(spark, "你 好 吗", normalize.without_spaces) == "你好吗"
    assert many(spark, ["zh", "en", None], normalize.is_unsegmented) == [True, False, False]


@pytest.mark.parametrize(("token", "closes"), [*((t, False) for t in ("Mr.", "Dr.", "St.", "etc.", "Mme.", "Sra.", "A.", "M.", "É.", "word", "", "J.")), *((t, True) for t in ("done.", "No.", "really?", "stop!", "好.", "네.", "好。", "ア.", "...", " end. "))])
def test_ends_sentence(spark, token, closes):
    assert one(spark, token, punctuation.ends_sentence) is closes


def test_affixes(spark):
    got = many(spark, [" world!?", " ...", " ", "a-b,", "好。", ""], punctuation.affixes)
    assert [tuple(x) for x in got] == [(" ", "world", "!?"), (" ", "...", ""), (" ", "", ""), ("", "a-b", ","), ("", "好", "。"), ("", "", "")]


def test_merged_mark(spark):
    cases = [("!", ".", 1.0, False, "!"), ("", ".", 0.51, False, "."), (".", "0", 0.9999, False, "."), (".", "0", 0.95, True, ""), (".", "0", 0.85, True, "."), (";", "0", 1.0, False, ";"), ("", "0", 1.0, False, ""), (",", "?", 0.1, False, "?"), ("", ",", 0.2, False, ","), (".", ",", 0.95, True, ",")]
    for original, predicted, confidence, demote, want in cases:
        got = spark.range(1).select(punctuation.merged_mark(F.lit(original), F.lit(predicted), F.lit(confidence), 0.9, demote).alias("m")).first().m
        assert got == want, (original, predicted)


def words(spark, tokens, **more):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(tokens)], "file string, pos int, word string")


def text_of(df):
    return "".join(r.word for r in sorted(df.collect(), key=lambda r: r.pos))


def test_recase(spark):
    assert text_of(punctuation.recase(words(spark, [" what", " now.", " go"]), ["file"], ["pos"])) == " What now. Go"
    assert text_of(punctuation.recase(words(spark, [" said", " Mr.", " smith", " J.", " tolkien.", " ", ' "hello']), ["file"], ["pos"])) == ' Said Mr. smith J. tolkien.  "Hello'


def test_apply_labels(spark):
    tokens = [" what", " should", " we", " do", " now", " what", " did", " you", " do"]
    labels = ["0", "0", "0", "0", ".", "0", "0", "0", "?"]
    labeled = spark.createDataFrame([("f", i, t, lab, 0.99) for i, (t, lab) in enumerate(zip(tokens, labels, strict=True))] + [("f", 9, " ...", ".", 0.99)], "file string, pos int, word string, label string, confidence double")
    assert text_of(punctuation.apply_labels(labeled, ["file"], ["pos"])) == " What should we do now. What did you do? ..."
    with pytest.raises(Exception, match="label"):
        punctuation.apply_labels(labeled.withColumn("label", F.lit(None).cast("string")), ["file"], ["pos"]).collect()


def test_windows_tile(spark):
    for n in (0, 1, 100, 256, 257, 448, 449, 1000):
        w = one(spark, n, lambda c: punctuation.windows(c), "int")
        covered = [k for x in w for k in range(x.keep_from, min(x.keep_to, x.stop))]
        assert covered == list(range(n)), n


def test_subtitles(spark):
    body = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i> there\r\n- MAN: Hi {\\an8}[door]\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n1985\r\n♪ la la ♪ (laughs)"
    assert one(spark, body, subtitles.flat_text) == "Hello there Hi 1985 la la"
    assert many(spark, [body, "plain text", "x --> y", "a --> b"], subtitles.looks_like_cues) == [True, False, True, True]
    assert many(spark, ["01:02:03,004", "00:00:01.500", "1:2:3.25", "nope"], subtitles.seconds) == [3723.004, 1.5, 3723.25, None]
    assert many(spark, [0, 3725, 86399], subtitles.clock, "long") == ["00:00:00", "01:02:05", "23:59:59"]
    files = spark.createDataFrame([("a", body.lstrip("﻿") + "\r\n\r\nbroken block\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nwww.example.org\r\n – bye\\hnow")], "file string, body string")
    found = subtitles.cues(files)
    assert [(r.cue_start, r.cue_end) for r in found.orderBy("cue").collect()] == [(1.0, 2.5), (3.0, 4.0), (5.0, 6.0)]
    assert [r.text for r in subtitles.spoken_lines(found).orderBy("cue", "line").collect()] == ["Hello there", "MAN: Hi [door]", "1985", "♪ la la ♪ (laughs)", "bye now"]


def test_text(spark):
    assert many(spark, ["/a/b.c/movie.one.mp4", "x", "/a/.hidden", "/d/"], text.stem) == ["movie.one", "x", ".hidden", ""]
    assert many(spark, ["AFGM1_jessep", "x"], text.leading_id) == ["afgm1", "x"]
    long = "x" * 30 + " word. Next " + "y" * 80
    assert many(spark, ["  ", "short one", long, "a" * 150, "a" * 90 + " " + "b" * 50], text.context_tail) == [None, "short one", "Next " + "y" * 80, "a" * 100, "b" * 50]
    assert many(spark, ['{"a": 1}', 'Sure:\n```{"a": {"b": 2}}``` ok', "none", "{broken"], text.json_object) == ['{"a": 1}', '{"a": {"b": 2}}', None, None]
    assert one(spark, "a|b", text.escape_pipes) == "a\\|b"
    got = spark.createDataFrame([(1, 2), (1, 0), (0, 0)], "a int, b int").select(text.ratio(F.col("a"), F.col("b")).alias("z"), text.ratio(F.col("a"), F.col("b"), None).alias("n")).collect()
    assert [(r.z, r.n) for r in got] == [(0.5, 0.5), (0.0, None), (0.0, None)]
    assert many(spark, [0.4, 0.9, 333.92, 32.24], text.milliseconds, "double") == [400, 900, 333920, 32240]
