"""The pipeline's stages: each on the rows of the one before, all but the last with the columns of documents."""

import pytest

import corpus_pipeline
from tapeline.llm import packing, queries
from tapeline.llm.common import scratch_dir, store

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, ids, seen = docs.columns, None, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert docs.columns == columns
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and (ids is None or set(now) <= ids)
        if name in ("lines", "mix"):
            assert set(now) == ids
        ids = set(now)
    packed = seen["pack"]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_final_sequences_follow_the_mix(spark):
    n = {"a": 3000, "b": 1500, "c": 500}
    rows = [(i, f"{k} " * (900 if k == "a" else 40 if k == "b" else 300) + str(i), k) for k, m in n.items() for i in range(len(k) + 10_000 * ord(k), len(k) + 10_000 * ord(k) + m)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    unmixed = store(docs.repartitionByRange(7, "source"), scratch_dir(spark))

    def furthest(packed):
        source, seen, done, worst = {r[0]: r[2] for r in rows}, set(), dict.fromkeys(n, 0), 0
        for r in sorted(packed.collect(), key=lambda r: (r.sequence_id, r.offset)):
            if r.doc_id not in seen:
                seen.add(r.doc_id)
                done[source[r.doc_id]] += 1
            if len(seen) <= 3500:  # all sources have blocks left
                worst = max(worst, *(abs(done[k] - len(seen) * m**0.7 / sum(x**0.7 for x in n.values())) for k, m in n.items()))
        assert seen == set(source)
        return worst

    mixed = store(corpus_pipeline.mix(spark, docs, SF), scratch_dir(spark))
    assert furthest(packing.pack_in_order(mixed, queries.vocabulary(), span=128)) < 128
    assert furthest(corpus_pipeline.pack(spark, mixed, SF)) < furthest(corpus_pipeline.pack(spark, unmixed, SF))
    packed = corpus_pipeline.pack(spark, mixed, SF).groupBy("sequence_id").sum("length").collect()
    assert sorted(r[0] for r in packed) == list(range(len(packed))) and max(r[1] for r in packed) <= 2048
    assert packing.pack_in_order(mixed.limit(0), queries.vocabulary()).count() == 0


def test_quality_stage_keeps_good_documents(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id for r in labels.where("quality = 0").collect()]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.35 * len(bad)


def test_run_leaves_only_its_result(spark):
    import os

    place = os.path.dirname(scratch_dir(spark)).removeprefix("file:")
    before = set(os.listdir(place))
    found = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in queries.table(spark, SF, "documents").collect()}
    assert {r.doc_id for r in found.collect()} <= ids and found.count() > 0
    # The quality, line and near-duplicate operators leave what their results read until the program ends.
    left = [os.listdir(f"{place}/{d}") for d in set(os.listdir(place)) - before if d.startswith("tapeline-")]
    assert ["pack"] in left and not any(n in names for names in left for n in ("quality", "mix", "intake", "rows", "links1"))


def test_scratch_off_local_masters():
    class Away:
        class sparkContext:  # noqa: N801
            master = "spark://far:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError):
        scratch_dir(Away)


def test_registered():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None
    assert len(queries.QUERIES) == 10 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_on_odd_rows(spark, docs, rows, empty):
    """Each stage, on nulls, empty and very long texts, ties, repeated rows and clashing columns, against a plain version: whole rows."""
    from collections import Counter, defaultdict

    from test_exact import ASCII_LOWER, BLANKS, brute_components

    from tapeline.llm import line_crf

    given, columns = Counter(rows), docs.columns
    of = lambda df: Counter(tuple(r) for r in df.collect())

    labels = queries.table(spark, SF, "labels")
    model = line_crf.fit(docs, labels)
    good = Counter({r: n for r, n in given.items() if line_crf.score_texts(model, [(r[1] or "").encode()])[0] >= 0.3})
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == columns and of(kept) == good

    key = lambda line: line.strip(BLANKS).translate(ASCII_LOWER)
    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                held[key(line)].add(i)
    common = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}

    def cleaned(r):
        if r[1] is None:
            return r
        lines = r[1].split("\n")
        left = [x for x in lines if common.get(key(x), r[0]) == r[0]]
        text = "\n".join(left)
        return (r[0], text, r[2], r[3], len(text) if len(left) < len(lines) else r[4], *r[5:])

    got = corpus_pipeline.lines(spark, docs, SF)
    assert got.columns == columns and of(got) == Counter(map(cleaned, given.elements())) and common

    parts = {i: (n, c) for i, n, c in sorted(brute_components(rows, 5, 80), key=lambda x: x[1]) if i is not None}
    alone = [r for r in given.elements() if r[0] is None or not parts[r[0]][0]]
    firsts = defaultdict(list)
    for r in given:
        if r[0] is not None and parts[r[0]][0] and parts[r[0]][1] == r[0]:
            firsts[r[0]].append(r)
    want = Counter(alone) + Counter(min(found, key=lambda r: (r[1] is None, -len(r[1] or ""), (r[1] or "").encode())) for found in firsts.values())
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == columns and of(got) == want

    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == columns and of(mixed) == given
    packed = corpus_pipeline.pack(spark, store(mixed, scratch_dir(spark)), SF)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r[0] for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, empty, SF)
        assert found.count() == 0 and (name == "pack" or found.columns == columns)
