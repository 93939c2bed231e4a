"""Readers, writers, configuration, model plugs with stubs, pipelines and carried context."""

import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tapeline.functions.text import context_tail
from tapeline.operators import sentences
from tapeline.plans import config, models, pipelines
from tapeline.schema import SEGMENT
from tapeline.sources import readers, writers
from tapeline.streaming import context

# The stubs below travel to Python workers, which can't import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def seg(i, start, end, text, words):
    return ("f.mp4", i, float(start), float(end), text, -0.2, 0.01, 1.0, 0.0, words)


def timed(text, start=0.0):
    return [(start + 0.5 * i, start + 0.5 * i + 0.4, " " + w, 0.9) for i, w in enumerate(text.split())]


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([seg(0, 0, 2, "hello there world.", timed("hello there world.")), seg(1, 3, 5, "how are you", timed("how are you", 3.0))], SEGMENT)


def test_tags_round_trip(spark, segments, tmp_path):
    tags = sentences.tags(segments, "m")
    writers.write_tags(tags, str(tmp_path / "log"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    word = next(x for x in lines if x["data"]["track"] == "")
    assert word["type"] == "tag" and word["data"]["vector"] is None and word["data"]["frame_info"] is None
    assert "model" not in word["data"]["additional_info"] and word["data"]["additional_info"]["probability"] == 0.9
    (tmp_path / "log" / "more.txt").write_text('\n{"type":"other","data":{}}\nnot json\n')
    back = readers.read_tags(spark, str(tmp_path / "log"), "")
    assert back.count() == 6
    texts = readers.hypothesis_texts(readers.read_tags(spark, str(tmp_path / "log"), "auto_captions", by_basename=True)).collect()
    assert [(r.name, r.hyp) for r in texts] == [("f.mp4", "hello there world. how are you")]


def test_text_sources(spark, tmp_path):
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "a.txt").write_text("﻿ plain text \n", encoding="utf-8")
    (tmp_path / "refs" / "b.txt").write_text("1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i> all\n", encoding="utf-8")
    assert {r.key: r.ref for r in readers.read_references(spark, str(tmp_path / "refs")).collect()} == {"a": "plain text", "b": "Hi all"}
    (tmp_path / "refs.json").write_text(json.dumps({"a.mp4": "x", "b": "y"}))
    assert {r.key: r.ref for r in readers.read_references(spark, str(tmp_path / "refs.json")).collect()} == {"a": "x", "b": "y"}
    for model in ("m1", "m2"):
        (tmp_path / "hyps" / model).mkdir(parents=True)
        (tmp_path / "hyps" / model / "a.txt").write_text(f"by {model}")
    assert {(r.model, r.id, r.hyp) for r in readers.read_hypotheses(spark, str(tmp_path / "hyps")).collect()} == {("m1", "a", "by m1"), ("m2", "a", "by m2")}
    spec = {"meta": {"categories": {"clean": "quiet"}}, "excerpts": [{"id": "a", "film": "F", "start": "00:00:01", "watch_vocab": ["x"]}]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    assert readers.read_excerpts(spark, str(tmp_path / "spec.json")).first().watch_vocab == ["x"]
    assert readers.read_categories(spark, str(tmp_path / "spec.json")).first().category == "clean"
    (tmp_path / "a.mp4").write_bytes(b"12345")
    assert readers.list_media(spark, str(tmp_path)).first().length == 5
    probes = spark.createDataFrame([('{"programs":[],"streams":[]}',), ('{"streams":[{"index":1}],"format":{"duration":"2.5"}}',), ("broken",), ("{}",), ('{"streams":null}',), ("",)], "probe string")
    assert [tuple(r) for r in probes.select(readers.has_audio(F.col("probe")), readers.duration(F.col("probe"))).collect()] == [(False, None), (True, 2.5), (True, None), (False, None), (False, None), (True, None)]
    files = spark.createDataFrame([("a.mp4",), ("b.mp4",), ("c.mp4",)], "path string")
    known = spark.createDataFrame([("a.mp4", '{"streams":[]}'), ("b.mp4", '{"streams":[{"index":0}]}')], "path string, probe string")
    assert sorted(r.path for r in readers.with_audio(files, known).collect()) == ["b.mp4", "c.mp4"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0), ("a", None)], "id string, wer double")
    writers.write_csv(rows.orderBy("id"), str(tmp_path / "csv"))
    body = next((tmp_path / "csv").glob("part-*.csv")).read_text()
    assert body == "id,wer\na,\nb,2.0\n"
    doc = json.loads(writers.document({"per_excerpt": rows, "n": rows.limit(1)}, {"per_excerpt": ["id"], "n": ["id"]}).first().body)
    assert doc["per_excerpt"] == [{"id": "a", "wer": None}, {"id": "b", "wer": 2.0}]
    (tmp_path / "results.json").write_text(json.dumps({"per_excerpt": [{"id": "a", "wer": 0.5}]}))
    assert readers.read_results(spark, str(tmp_path / "results.json")).first().wer == 0.5
    writers.write_text_by_key(spark.createDataFrame([("k", "one")], "key string, text string"), "key", str(tmp_path / "texts"))
    assert next((tmp_path / "texts" / "key=k").glob("*.txt")).read_text() == "one\n"


def test_config():
    profiles = {"fast": {"model": "small", "word_level": False}}
    got = config.resolve(profiles, "fast", {"word_level": True})
    assert (got.model, got.word_level, got.max_caption_words) == ("small", True, 150)
    for bad in (lambda: config.resolve(profiles, "none"), lambda: config.resolve({}, None, {"nope": 1}), lambda: config.resolve({}, None, {"max_caption_words": 0}), lambda: config.resolve({}, None, {"backend": "none"}), lambda: config.resolve({}, None, {"model": "huge"}, models=["small"]), lambda: config.resolve({}, None, {"stride": 300}), lambda: config.overrides(["nope=1"])):
        with pytest.raises(ValueError):
            bad()
    shipped = config.Config()
    assert not shipped.demote_marks and (shipped.window, shipped.stride, shipped.batch_size) == (200, 150, 16)
    assert shipped.cut_by_activity == shipped.condition_on_previous_text
    assert config.resolve(profiles, "fast", {"carry_context": True, "cut_by_activity": True}, models=["small"]).carry_context
    assert config.overrides(["artifact_gap=5.5", "model=tiny", "punctuate=false"]) == {"artifact_gap": 5.5, "model": "tiny", "punctuate": False}


def test_config_files(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"storage": {"weights": "w", "parts": "~/p"}, "runtime": {"default": {"model": "tiny"}}}))
    monkeypatch.setenv("CONFIG_PATH", str(tmp_path / "c.json"))
    monkeypatch.delenv("WEIGHTS_DIR", raising=False)
    found = config.load_config()
    assert found["storage"]["weights"] == str(tmp_path / "w") and found["storage"]["parts"].endswith("/p") and "~" not in found["storage"]["parts"]
    assert config.load_profiles() == {"default": {"model": "tiny"}}
    monkeypatch.setenv("WEIGHTS_DIR", "/weights")
    assert config.load_config(str(tmp_path / "c.json"))["storage"]["weights"] == "/weights"


class FullStops:
    def predict(self, windows):
        return [(["0"] * (len(w) - 1) + ["."], [0.5] * len(w)) for w in windows]


class Broken:
    def predict(self, windows):
        raise RuntimeError("no weights")


class Short:
    def predict(self, windows):
        return [(["0"], [0.9])] * len(windows)


class Numbering:
    """Labels tell window and place, so that a test sees which window a word's label came from."""

    def __init__(self):
        self.calls = []

    def predict(self, windows):
        self.calls.append(len(windows))
        return [([f"{w[0]}:{i}" for i in range(len(w))], [1.0] * len(w)) for w in windows]


def test_windows_of_the_classifier():
    for n in (0, 1, 199, 200, 201, 350, 351, 1000):
        cores, plug = [str(i) for i in range(n)], Numbering()
        labels, sure = models.label_words(cores, plug, 200, 150, 3)
        assert len(labels) == len(sure) == n and all(c <= 3 for c in plug.calls)
        for i, label in enumerate(labels):
            start, place = map(int, label.split(":"))
            assert start + place == i and (start == 0 or place >= 25) and (place < 175 or start + 200 >= n)


def test_failures_are_counted(spark, segments):
    failures = spark.sparkContext.accumulator(0)
    words = sentences.words_of(segments)
    kept = models.punctuate(words, Broken, failures=failures)
    assert sorted(r.word for r in kept.collect()) == sorted(r.word for r in words.collect())
    kept.count()
    assert failures.value == words.select("file").distinct().count()
    with pytest.raises(Exception, match="no weights"):
        models.punctuate(words, Broken, required=True).collect()


def test_external_normalizer(spark):
    df = spark.createDataFrame([(1, "Ab C"), (2, None)], "id long, t string")
    assert [tuple(r) for r in models.normalized(df, "t", lambda: str.upper).orderBy("id").collect()] == [(1, "AB C"), (2, None)]


def test_tagging_with_punctuation(segments):
    got = pipelines.tag(segments, config.Config(word_level=False), FullStops)
    assert [r.tag for r in got.collect()] == ["Hello there world.", "How are you."]
    for plug in (Broken, Short):
        plain = pipelines.tag(segments, config.Config(word_level=False), plug)
        assert [r.tag for r in plain.collect()] == ["hello there world.", "how are you"]


class Canned:
    def transcribe(self, path, prompt=None):
        if prompt == "bad":
            return "en", []
        return ("fr" if prompt == "swap" else "en"), [{"start": 0.0, "end": 1.0, "text": path, "avg_logprob": -0.2, "no_speech_prob": 0.0, "compression_ratio": 1.0, "temperature": 0.0, "words": []}]


def test_decoder_plug(spark):
    got = models.decode(spark.createDataFrame([("a",), ("b",)], "path string"), Canned).collect()
    assert sorted((r.file, r.seg, r.text) for r in got) == [("a", 0, "a"), ("b", 0, "b")]
    assert models.guarded_transcribe(Canned(), "a", "bad", "en")[1] and models.guarded_transcribe(Canned(), "a", "swap", "en")[0] == "en"
    assert models.guarded_transcribe(Canned(), "a", "fine", "en")[0] == "en"
    assert models.guarded_transcribe(Canned(), "a", "swap", None)[0] == "fr"  # nothing to compare with


class Echo:
    """Says the prompt that it was given; falls silent or changes its language on some."""

    def transcribe(self, path, prompt=None):
        if path == "mute" and prompt:
            return "en", []
        language = "fr" if path == "turn" and prompt else "en"
        return language, [{"start": 0.0, "end": 1.0, "text": f"{path} after {prompt}. Then {path}", "avg_logprob": -0.2, "no_speech_prob": 0.0, "compression_ratio": 1.0, "temperature": 0.0, "words": []}]


def test_decoding_with_carried_context(spark):
    media = spark.createDataFrame([("x", 0, "one"), ("x", 1, "two"), ("x", 2, "mute"), ("x", 3, "turn"), ("y", 0, "alone")], "asset string, seq long, path string").repartition(3)
    said = {r.file: r.text for r in models.decode_in_order(media, Echo, carry_context=True).collect()}
    assert said["one"] == "one after None. Then one" and said["two"] == "two after one after None. Then one. Then two"
    assert said["mute"] == "mute after None. Then mute" and said["turn"] == "turn after None. Then turn" and said["alone"] == "alone after None. Then alone"
    assert {r.text for r in models.decode_in_order(media, Echo).collect()} == {f"{p} after None. Then {p}" for p in ("one", "two", "mute", "turn", "alone")}
    texts = [" ", "short", "A b. " + "c" * 90 + " d", "w " * 80, "x" * 150, "No end here " + "yes! " * 30]
    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(context_tail(F.col("t"))).collect()]
    assert [models.carried_tail(t) for t in texts] == want


ASKED = []


def ask(texts):
    ASKED.append(tuple(texts))
    keep = [{"id": i + 1, "text": t.upper()} for i, t in enumerate(texts) if not (len(texts) > 1 and t == "skip") and t != "never"]
    return "Sure! " + json.dumps({"translations": [*keep, {"id": 99, "text": "x"}]}) + " done"


def test_translation(spark):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(["one", "skip", "never", "two"])], "file string, sentence long, text string")
    assert sorted((r.sentence, r.text) for r in models.translate(df, ask).collect()) == [(0, "ONE"), (1, "SKIP"), (3, "TWO")]
    assert models.translate(df, lambda texts: "garbage").count() == 0


def test_calibrate(spark):
    texts = spark.createDataFrame([("a", "clean", "m", "one two three\nfour five", "one two four five", "one two four"), ("b", "clean", "m", "six seven", "six seven", None), ("c", "noise", "m", "x y", "z y", "x y")], "id string, category string, model string, ref string, hyp string, sub string")
    out = pipelines.calibrate(texts, n_boot=40)
    rows = {r.id: r for r in out["per_excerpt"].collect()}
    assert rows["a"].wer == 0.2 and rows["b"].sub_wer is None and rows["a"].sub_wer == pytest.approx(1 / 3)
    per = {r.category: r for r in out["per_category"].collect()}
    assert per["clean"].true_wer == pytest.approx(1 / 7) and per["clean"].wer_lo <= per["clean"].true_wer <= per["clean"].wer_hi
    hyps = spark.createDataFrame([("/m/a.mp4", "one two")], "name string, hyp string")
    refs = spark.createDataFrame([("A_long", "one two three")], "key string, ref string")
    assert pipelines.benchmark(hyps, refs).first().wer == 0.3333


def test_context(spark, tmp_path):
    rows = [("x", 0, "First part. Second part of it", "en"), ("x", 1, " ", "fr"), ("x", 2, "end", "en"), ("y", 0, "b" * 150, "en"), ("y", 1, "z", "en")]
    schema = "asset string, seq long, text string, language string"
    df = spark.createDataFrame(rows, schema)
    batch = {(r.asset, r.seq): (r.prompt, r.previous_language) for r in context.prompts(df).collect()}
    assert batch["x", 0] == (None, None) and batch["x", 2] == (None, "fr") and batch["y", 1] == ("b" * 100, "en")
    assert batch["x", 1] == ("First part. Second part of it", "en")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = context.prompts_stream(stream).writeStream.format("memory").queryName("prompts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        assert {(r.asset, r.seq): (r.prompt, r.previous_language) for r in spark.table("prompts").collect()} == batch
    finally:
        query.stop()
    windows = context.windowed_words(spark.createDataFrame([(datetime(2024, 1, 1, 0, 1), 3), (datetime(2024, 1, 1, 0, 7), 4)], "ts timestamp, words int"))
    assert sorted(r.words for r in windows.collect()) == [3, 4]
