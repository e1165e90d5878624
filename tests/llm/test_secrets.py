"""op10's models: held-back strings, planted strings in corpus-like texts, a plain count of character pairs."""

import math
import random
import re

import pytest

from docweave.llm import secrets

DIR = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark.read.parquet(DIR))


def test_held_back_strings(model):
    assert model.recall > 0.98 and model.false_rate < 0.005
    fresh = secrets.drawn(3000, seed=123)
    assert sum(model.score(s) > model.threshold for s in fresh) > 0.98 * len(fresh)


def test_table_is_that_of_a_plain_count():
    ones, others = ["abcab", "zz9", "q", "abz", "c9"], ["the", "then", "hen", "ten", "net", "tent"]
    got = secrets.fit(ones, others)

    def chance(strings, a, b):
        used = [s for i, s in enumerate(strings) if i % 5 < 3]
        pairs = [p for s in used for p in zip("\0" + s, s)]
        return math.log((pairs.count((a, b)) + 0.05) / (sum(x == a for x, _ in pairs) + 128 * 0.05))

    for a, b in (("a", "b"), ("\0", "t"), ("h", "e"), ("x", "y")):
        assert abs(got.table[ord(a), ord(b)] - (chance(ones, a, b) - chance(others, a, b))) < 1e-9


def test_planted_strings_are_found_and_words_left_alone(spark, model):
    texts = [r.text for r in spark.read.parquet(DIR).select("text").collect()]
    rng, rows, planted = random.Random(4), [], {}
    for i, t in enumerate(texts):
        if i % 3 == 0 and t:
            secret = secrets.drawn(1, seed=1000 + i)[0]
            at = t.find(" ", rng.randrange(len(t)))
            if at >= 0:
                t = f"{t[:at]} {secret}{t[at:]}"
                planted[i] = (at + 1, at + 1 + len(secret))
        rows.append((i, t))
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}

    def spans(i):
        return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x)]

    assert len(planted) > 50
    assert sum(any(a <= p[0] and p[1] <= b for _, a, b in spans(i)) for i, p in planted.items()) > 0.95 * len(planted)
    assert any(k == "random" for i in planted for k, _, _ in spans(i))
    assert not any(k == "random" for i in got if i not in planted for k, _, _ in spans(i))
    # the same by brute force: every run outside the base matches, its pairs summed one by one
    for i, t in rows:
        base = [s for s in spans(i) if s[0] != "random"]
        wanted = []
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t or ""):
            total = sum(model.table[ord(a), ord(b)] for a, b in zip("\0" + m[0], m[0]))
            if total / len(m[0]) > model.threshold and not any(a < m.end() and m.start() < b for _, a, b in base):
                wanted.append(("random", m.start(), m.end()))
        assert [s for s in spans(i) if s[0] == "random"] == wanted


def test_neither_label_displaces_the_other(spark):
    rows = [(i, f"token={s} the ordinary words of documents about naming") for i, s in enumerate(secrets.drawn(300))]
    few = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"), most_values=20, most_words=50)
    assert few.recall > 0.9 and few.score("ordinary_words_of_naming") < few.threshold
    none = secrets.train(spark.createDataFrame([], "doc_id long, text string"))
    assert none.threshold >= 0


def test_edge_rows(spark, model):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "x"), (2, "a " * 200_000 + "password: hunter22", "x"), (3, "AKIA" + "Q" * 16 + " " + "0f" * 12, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.scan(df, model).collect()), key=str)
    assert got == sorted([(1, 0, 0, 0, ""), (1, 0, 0, 0, ""), (0, 0, 0, 0, ""), (2, 1, 0, 0, "assign:400000:400018"), (3, 0, 1, 1, "access:0:20,hex:21:45")], key=str)
