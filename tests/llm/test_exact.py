"""Operators with exact results against brute force, on a table of odd rows, and on an empty one."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tapeline.llm import bwt_merge, components, divergence, divide_skip, line_runs, packing, pfair, queries

BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def collected(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_line_runs(docs, rows, empty):
    held = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    key = lambda line: line.strip(BLANKS).translate(ASCII_LOWER)
    for i, lines in split:
        for line in lines:
            if i is not None:
                held[key(line)].add(i)
    common = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    want = Counter()
    for i, lines in split:
        kept = [x for x in lines if not (key(x) in common and common[key(x)] != i)]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert common
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert collected(line_runs.digest(docs), *names) == want
    assert collected(line_runs.digest(docs, batches=7, fanout=2), *names) == want
    cleaned = line_runs.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert line_runs.digest(empty).count() == 0


def test_line_runs_moves_only_documents_that_lose_lines(spark, docs, monkeypatch):
    """Documents meet their places in one way at any size; a full bitmap moves more of them and changes nothing."""
    from pyspark.sql import functions as F

    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    out = line_runs.digest(docs)
    want = collected(out, *names)
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    packed = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    many = spark.range(200_000).select(F.col("id"), F.xxhash64("id").alias("hash"), F.lit("x").alias("text")).unionByName(packed)
    right = many.where("id IS NULL OR id % 4 = 1").select(F.col("id").alias("at"), F.col("hash").alias("of")).distinct()
    lost = many.where("id IS NULL OR id % 4 = 1").count()
    calm, hit = line_runs._parted(many, right)
    assert calm.where("id IS NULL OR id % 4 = 1").count() == 0 and calm.count() + hit.count() == many.count()
    assert lost <= hit.count() < 1.5 * lost
    for bits in (1, 8):
        monkeypatch.setattr(line_runs, "FILTER_BITS", bits)
        assert line_runs._parted(many, right)[0].count() == 0
        assert collected(line_runs.digest(docs), *names) == want


def test_divergence_counts(docs, rows, empty):
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        hit = {k + j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(8)}
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed] += 1
    got = divergence.judge(docs, min_docs=2)
    assert collected(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not r.kept for r in got.where("base_failed").collect())
    assert all(r.kept for r in got.where("not base_failed and n_words < 50").collect())
    assert divergence.judge(empty).count() == 0


def test_divergence_rejects_another_mix(spark):
    good = [(k, " ".join(f"the w{k}x{j} of and in" for j in range(40)), "en") for k in range(30)]
    odd = [(99, " ".join(f"QX{j}%% ZZ{j}&&" for j in range(80)), "en")]
    got = {r.doc_id: r.kept for r in divergence.judge(spark.createDataFrame(good + odd, "doc_id long, text string, lang string")).collect()}
    assert not got[99] and all(got[k] for k in range(30))


def brute_components(rows, width, percent):
    texts = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        texts.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    parent: dict = {}
    live = [(i, s) for i, s in texts if i is not None and s]
    for i, s in live:
        for j, u in live:
            if len(s & u) * 100 >= percent * len(s | u):
                components.unite(parent, i, j)
    return Counter((i, len(s), None if i is None else components.find(parent, i) if s else i) for i, s in texts)


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 4_000_000), (5, 80, 300)])
def test_divide_skip(docs, rows, width, percent, block):
    got = divide_skip.near_duplicates(docs, width, percent, block)
    assert collected(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, width, percent)


def test_all_links(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if i is not None and s:
            sets[s] = min(i, sets.get(s, i))
    want = {(min(a, b), max(a, b)) for s, a in sets.items() for u, b in sets.items() if a != b and len(s & u) * 100 >= 80 * len(s | u)}
    pairs, member = divide_skip.links(docs)
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 20
    assert {(r.doc_id, r.class_id) for r in member.collect()} >= {(i, i) for i in sets.values()}


@pytest.mark.parametrize("percent", [80, 85])
def test_divide_skip_on_shared_passages_and_long_words(spark, percent):
    """Chains of copies, passages that many documents share, a group too large for a block; words that collide modulo 2**64."""
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("aeioutnslrd") for _ in range(rng.randint(2, 7)))
    passage = [[word() for _ in range(60)] for _ in range(3)]
    texts = [" ".join([word() for _ in range(rng.randint(5, 90))] + rng.choice(passage) + [word() for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    now = [word() for _ in range(80)]
    for _ in range(80):
        now[rng.randrange(80)] = word()
        texts.append(" ".join(now))
    base = [word() for _ in range(70)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(70)] = word()
        texts.append(" ".join(copy))
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts += [thue, thue.translate(str.maketrans("ab", "ba"))]
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows, 5, percent)
    assert len({c for (_, _, c), _ in want.items()}) > 60
    for block in (4_000_000, 500):
        assert collected(divide_skip.near_duplicates(docs, 5, percent, block), "doc_id", "n_shingles", "component_id") == want


def test_one_of_each_keeps_text_and_columns(spark):
    """A row without text never wins over one with text, and columns of any name keep their values."""
    names = ["_id", "_n", "_component", "_first", "id", "row", "body", "n", "component", "place", "rows", "d1", "tokens", "a.b"]
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(5, None), (5, text), (5, ""), (6, text), (7, None), (7, ""), (None, text), (None, None), (8, text + " iota"), (9, "one two")]
    docs = spark.createDataFrame([(*r, *(f"{k}:{n}" for n in names)) for k, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = divide_skip.one_of_each(docs)
    assert got.columns == docs.columns
    kept = {tuple(r) for r in got.collect()}
    assert kept == {(*rows[k], *(f"{k}:{n}" for n in names)) for k in (1, 4, 5, 6, 7, 9)}


def test_one_of_each(docs, rows, empty):
    want = brute_components(rows, 5, 80)
    # A group has one row; rows without an id or without words all stay.
    groups = {c for (i, n, c), _ in want.items() if i is not None and n}
    alone = sum(k for (i, n, _), k in want.items() if i is None or not n)
    kept = divide_skip.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len(groups) + alone
    assert {r.doc_id for r in got if r.doc_id is not None} >= groups
    assert divide_skip.near_duplicates(empty).count() == 0


def test_prefixes_lose_no_link():
    """Linked sets share as many shingles inside their prefixes as the smaller one shows, which is what the bound counts."""
    rng = np.random.default_rng(1)
    linked = 0
    for percent in (30, 80, 85):
        for n in [1, 2, 5, 6, 7, 8, 11, 13, 17, 25, 40, 100, 400, 1500]:
            for _ in range(25):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                most = (100 - percent) * 2 * n // (100 + percent) + 2
                b = np.unique(np.concatenate((a[rng.integers(0, most + 1) :], rng.integers(0, 2**64, rng.integers(0, most + 1), dtype=np.uint64))))
                common = len(np.intersect1d(a, b))
                if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
                    linked += 1
                    met = len(np.intersect1d(divide_skip.prefix(a, percent), divide_skip.prefix(b, percent)))
                    for s in (a, b):
                        assert met >= divide_skip.shown(divide_skip.least_overlap(len(s), percent), percent)
                    short = [s[: len(s) - divide_skip.least_overlap(len(s), percent) + 1] for s in (a, b)]
                    assert len(np.intersect1d(*short))
    assert linked > 300


def brute_repeats(rows, window):
    docs = sorted({(-1 if i is None else i, t or "") for i, t, *_ in rows})
    seen, out = {}, {}
    for i, t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            else:
                seen[w] = 1
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2] if len(raw) else []))[: len(raw)]).sum()) if len(raw) else 0
        out[i, t] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_bwt_merge(docs, rows, empty):
    # Rows of one id with different texts are ordered by a hash, so that id stands aside here.
    ids = Counter()
    for i, t in {(i, t or "") for i, t, *_ in rows}:
        ids[i] += 1
    plain = [r for r in rows if ids[r[0]] == 1]
    sub = docs.sparkSession.createDataFrame(plain, docs.schema).repartition(3)
    want = brute_repeats(plain, 100)
    expected = Counter((i, *want[-1 if i is None else i, t or ""]) for i, t, *_ in plain)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert collected(bwt_merge.dedup(sub), *names) == expected
    # Tiny batches; every key dealt over tasks; every key crowded, alone and with the rest.
    assert collected(bwt_merge.dedup(sub, batch_bytes=300), *names) == expected
    assert collected(bwt_merge.dedup(sub, hot_share=1 << 40), *names) == expected
    assert collected(bwt_merge.dedup(sub, key_bytes=150, hot_share=1 << 40), *names) == expected
    assert collected(bwt_merge.dedup(sub, key_bytes=0), *names) == expected
    assert bwt_merge.dedup(docs, keep_bytes=True).count() == len(rows)
    assert bwt_merge.dedup(empty).count() == 0


def test_merge_transforms_finds_repeated_intervals():
    rng = np.random.default_rng(2)
    for rounds in (1, 4, 5, 8, 9):
        segments = [bytes(rng.integers(97, 99, rng.integers(1, 60), dtype=np.uint8)) for _ in range(40)]
        owner, place, block = bwt_merge.merge_transforms(segments, rounds, shard_bytes=50)
        groups = defaultdict(set)
        for o, p, b in zip(owner.tolist(), place.tolist(), block.tolist(), strict=True):
            groups[b].add((o, p))
        want = defaultdict(set)
        for o, s in enumerate(segments):
            for p in range(len(s) - rounds + 1):
                want[s[p : p + rounds]].add((o, p))
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_best_fit(docs, rows, empty):
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary()
    reference = Tokenizer.from_str(vocabulary.decode())
    want, total = Counter(), 0
    for i, t, *_ in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    got = packing.pack(docs, vocabulary)
    assert collected(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    bins = defaultdict(list)
    for r in got.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-total // 2048)
    assert packing.pack(docs, vocabulary, keep_ids=True).where("size(ids) <> length").count() == 0
    assert packing.pack(empty, vocabulary).count() == 0


def test_plan_is_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(20):
        capacity = int(rng.integers(5, 40))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 200))
        rooms: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [(room, b) for b, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(capacity - n)
        histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        rows = packing.best_fit_decreasing(histogram, capacity)
        used = defaultdict(list)
        for k, (length, rank, sequence, offset) in enumerate(rows.tolist()):
            end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else histogram[length]
            for j in range(end - rank):
                used[sequence + j].append((offset, length))
        assert len(used) == len(rooms)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_plans_reach_the_bound():
    """Where best-fit decreasing leaves room for a whole sequence, filling by subset sums doesn't."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        capacity = int(rng.integers(20, 200))
        lengths = rng.integers(1, capacity // 2, rng.integers(50, 400))
        histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        rows = packing.plan(histogram, capacity)
        n = packing.sequences_of(rows, histogram)
        assert n == -(-int(lengths.sum()) // capacity)
        used = defaultdict(int)
        for k, (length, rank, sequence, offset) in enumerate(rows.tolist()):
            end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else histogram[length]
            for j in range(end - rank):
                for byte in range(offset, offset + length):
                    used[sequence + j, byte] += 1
        assert len(used) == lengths.sum() and max(used.values()) == 1 and max(b for _, b in used) < capacity and len({q for q, _ in used}) == n


def test_ids_of_very_long_runs():
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary()
    reference, encode = Tokenizer.from_str(vocabulary.decode()), packing.build_encoder(vocabulary)
    for run in (" ", "\n", "\t \u00a0", "\x85", "\x1c"):
        for text in (run * 30_000, run * 30_000 + "a", "a" + run * 30_000 + "\nb <|endoftext|>" + run * 20_000 + "<|endoftext|>c", "q" * 30_000 + run * 12_000 + "%"):
            assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids
    assert len(encode(" " * 1_500_000 + "a"))
    spec = json.loads(vocabulary)
    spec["normalizer"] = {"type": "Lowercase"}
    with pytest.raises(ValueError):
        packing.build_encoder(json.dumps(spec).encode())


def test_pfair(docs, rows, empty):
    got = pfair.order(docs, block_docs=2, granularity=40).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    by_slot = {r.slot: r for r in got}
    assert all(r.release <= r.slot < r.deadline for r in got)
    supply = Counter(r[3] for r in rows)
    share = pfair.shares({("0" if k is None else "1" + k): n**0.7 for k, n in supply.items()}, 40)
    horizon = [s for s, r in by_slot.items() if r.on_target]
    assert horizon and sorted(horizon) == list(range(len(horizon)))
    done = Counter()
    for s in range(len(horizon)):
        done["0" if by_slot[s].source is None else "1" + by_slot[s].source] += 1
        for k, a in share.items():
            assert abs(done[k] - (s + 1) * a / 40) < 1
    mixed = pfair.mixed(docs, block_docs=2, granularity=40)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert pfair.order(empty).count() == 0 and pfair.mixed(empty).count() == 0
    with pytest.raises(ValueError):
        pfair.order(docs, weights={"a": 1.0})


def test_pfair_follows_exact_weights(spark):
    weights = {"a": 0.9, "b": 0.05, "c": 0.05}
    docs = spark.range(2000).selectExpr("id AS doc_id", "'x' AS text", "CASE WHEN id % 20 = 0 THEN 'b' WHEN id % 20 = 1 THEN 'c' ELSE 'a' END AS source")
    got = sorted(pfair.order(docs, weights=weights, block_docs=1).collect(), key=lambda r: r.slot)
    total, done = sum(Fraction(w) for w in weights.values()), Counter()
    on_target = [r for r in got if r.on_target]
    assert len(on_target) > 1900 and [r.slot for r in on_target] == list(range(len(on_target)))
    for s, r in enumerate(on_target, 1):
        done[r.source] += 1
        assert r.release <= r.slot < r.deadline
        assert all(abs(done[k] - s * Fraction(w) / total) < 1 for k, w in weights.items())
    assert pfair.shares(weights, 1000) == {"a": 900, "b": 50, "c": 50} and pfair.shares({"a": 1, "b": 1e-9}, 10) == {"a": 9, "b": 1}
    uneven = pfair.whole({f"s{k}": 50_000.0**0.7 if k else 500_000.0**0.7 for k in range(20)})
    total, done = sum(uneven.values()), Counter()
    for s, (k, _, slot, release, deadline, on_target) in enumerate(pfair.schedule(uneven, dict.fromkeys(uneven, 2000)), 1):
        if not on_target:
            break
        done[k] += 1
        assert slot == s - 1 and release <= slot < deadline and all(abs(done[x] * total - s * w) < total for x, w in uneven.items())
    assert s > 9000


def test_components(spark):
    rng = np.random.default_rng(6)
    for n, m in ((50, 40), (200, 150), (30, 29)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] if m != 29 else [(k, k + 1) for k in range(29)]
        parent: dict = {}
        for a, b in pairs:
            if a != b:
                components.unite(parent, a, b)
        got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {x: components.find(parent, x) for x in list(parent)}


def _cut_up(table, rng):
    at = 0
    while at < table.num_rows:
        n = int(rng.integers(0, 4))
        yield from table.slice(at, n).combine_chunks().to_batches()
        at += n


def test_settling_is_the_same_in_any_batches():
    """Salted, merged and crowded keys over any cuts of the stream: in the end the same windows go."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    for turn in range(40):
        window, rows = 4, []
        for k in range(int(rng.integers(1, 40))):
            key = int(rng.integers(0, 3))  # equal windows have equal keys: each key has letters of its own
            rows.append((key, -1, k // 3, 0, 10 * (k % 3), bytes(rng.integers(97 + 2 * key, 99 + 2 * key, rng.integers(4, 8), dtype=np.uint8))))
        rows += [r for r in rows if rng.random() < 0.1]
        seen, want = set(), set()
        for key, _, o, t, start, seg in sorted(set(rows), key=lambda r: (r[0], r[2:5])):
            for i in range(len(seg) - window + 1):
                w = key, seg[i : i + window]
                if w in seen:
                    want.add((o, start + i))
                seen.add(w)
        got, level = set(), [(r[0], int(rng.integers(0, 3)) if turn % 2 else -1, *r[2:]) for r in rows]
        key_bytes = [10**9, 12][turn // 2 % 2]
        while level:
            level.sort(key=lambda r: r[:5])
            table = pa.table({c: pa.array([r[i] for r in level], t) for i, (c, t) in enumerate((("key", pa.int64()), ("salt", pa.int32()), ("ord", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("segment", pa.binary())))})
            level = []
            for batch in bwt_merge.settle(_cut_up(table, rng), window, int(rng.integers(1, 60)), key_bytes):
                for r in batch.to_pylist():
                    if r["kind"] == bwt_merge.REMOVED:
                        got |= {(r["ord"], r["start"] + i) for i in range(r["n"])}
                    elif r["kind"] == bwt_merge.FIRST:
                        level.append((r["key"], -1, r["ord"], r["th"], r["start"], r["segment"]))
                    else:
                        for i in range(r["n"]):
                            w = r["segment"][i : i + window]
                            level.append((r["key"] + 1000 * (1 + int.from_bytes(w, "big")), -1, r["ord"], r["th"], r["start"] + i, w))
        assert got == want


def test_pfair_equals_a_plain_schedule(docs, rows, empty):
    """Slot by slot over all released blocks, with rationals; and each source's documents in the order of their draws."""
    from pyspark.sql import functions as F

    block = 2
    supply = Counter("0" if r[3] is None else "1" + r[3] for r in rows)
    blocks = {k: -(-n // block) for k, n in supply.items()}
    weight = {k: Fraction(n**0.7) for k, n in supply.items()}
    total = sum(weight.values())
    share = {k: w / total for k, w in weight.items()}
    window = lambda k, j: (math.floor(j / share[k]), math.ceil((j + 1) / share[k]))
    placed, done, slot, on_target = {}, dict.fromkeys(supply, 0), 0, True
    while len(placed) < sum(blocks.values()):
        # A source without a block left keeps its turn once, unseen: there the bound ends.
        ready = [(window(k, j)[1], -share[k], k, j) for k, j in done.items() if j <= blocks[k] and window(k, j)[0] <= slot]
        if ready:
            _, _, k, j = min(ready)
            if j < blocks[k]:
                placed[k, j] = (slot, *window(k, j), on_target)
            else:
                on_target = False
            done[k] = j + 1
        slot += 1
    drawn = defaultdict(list)
    for r in docs.select("doc_id", "source", F.xxhash64(F.lit(17), F.col("doc_id"), F.xxhash64("text")).alias("draw")).collect():
        drawn["0" if r.source is None else "1" + r.source].append((r.draw & (1 << 64) - 1, r.draw, r.doc_id))
    want = Counter()
    for k, found in drawn.items():
        found.sort(key=lambda x: (x[0] >> 52, x[1], x[2] is not None, x[2] or 0))
        for rank, (_, _, doc) in enumerate(found):
            want[doc, k, rank // block, rank % block, *placed[k, rank // block]] += 1
    got = Counter((r.doc_id, "0" if r.source is None else "1" + r.source, r.block, r.place, r.slot, r.release, r.deadline, r.on_target) for r in pfair.order(docs, block_docs=block).collect())
    assert got == want
