import random

import pytest

#: Columns beside those of documents, named like columns that the operators make.
CLASHING = "key long, h1 long, n long, rank int, ref string, component long, places string, score double, length int, part int, ord long, th long, words string, _source string, batch int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def _rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioutnslrd") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(40)
    line = "This very same line stands in quite a number of documents."
    texts = [None, "", " ", "\n\n", "one", "two words", "été à l'école, ça va", "<|endoftext|> is text", "\x00nul\x0bbytes\x1c"]
    base = [prose(rng.randint(30, 160)) for _ in range(12)]
    texts += base
    for b in base[:8]:
        w = b.split()
        for _ in range(rng.randint(1, 6)):
            copy = list(w)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [base[0]] * 6 + [base[1].upper(), base[1] + "\n" + base[1]]
    texts += [f"{prose(60)} {shared} {prose(60)}" for _ in range(5)]
    texts += [f"{prose(20)}\n  {line.upper()} \n{prose(5)}\n{line}" for _ in range(7)]
    texts += [" ".join(["again and again we say"] * 30), "z" * 700, prose(9000)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base[2]), (None, None), (rows[11][0], "another text under a used id " + base[3])]
    rng.shuffle(rows)
    langs, sources = ["en", "fr", None], ["a", "b", "c", None]
    extra = (7, 7, 7, 7, "x", 7, "x", 0.5, 7, 7, 7, 7, "x", "x", 7)
    return [(i, t, langs[k % 3], sources[min(k % 7, 3)], None if t is None else len(t), *extra) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
