"""The pipeline's stages, each against brute force on its own input, with odd rows."""

import collections
import random

import pytest
import sentencepiece

import corpus_pipeline as p
from docweave.llm import mixing, secrets
from docweave.llm.queries import PIECES

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, copies long, text_2 string"


@pytest.fixture(scope="module")
def docs(spark):
    """A table with null ids, texts and labels, repeated rows, a long text and columns of clashing names."""
    own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "k", 5, "x") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    long = "the long and the short of it " * 20_000
    odd = [(None, "no id but the words of an ordinary text", None, None, 1, "k", 5, "x"), (None, "no id but the words of an ordinary text", "en", None, 1, "k", 5, "x"), (7_000_001, None, None, None, None, None, None, None), (7_000_002, "", "en", "s", 0, "k", 5, "x"), (7_000_003, long, "en", "s", len(long), "k", 5, "x"), (7_000_004, "her password = hunter2222 and more words", "en", "s", 40, "k", 5, "x"), own[3], own[3]]
    return spark.createDataFrame([*own, *odd], SCHEMA)


def rows_of(df):
    assert df.columns[:5] == list(p.COLUMNS)
    return collections.Counter(tuple(r)[:5] for r in df.collect())


def test_language_id(spark, docs):
    rng = random.Random(1)
    foreign = [(8_000_000 + i, "".join(rng.choices("абвгдежзийклмнопрстуфхцч    ", k=300)), None, "s", 300, "k", 5, "x") for i in range(20)]
    foreign += [(8_100_000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=300)), None, "s", 300, "k", 5, "x") for i in range(20)]
    got = rows_of(p.language_id(spark, docs.union(spark.createDataFrame(foreign, SCHEMA)), DIR))
    wanted = collections.Counter(tuple(r)[:5] for r in docs.collect() if any(ch.isalpha() for ch in r.text or ""))
    labelled = collections.Counter({k: n for k, n in got.items() if k[2] and k in wanted})
    assert sum(got.values()) == sum(wanted.values())
    assert all(r[2] in ("de", "en", "es", "fr") for r in got) and sum((wanted - labelled).values()) == sum(n for k, n in wanted.items() if k[2] is None)


def test_secret_scan(spark, docs):
    model = secrets.train(docs)
    wanted = collections.Counter()
    for r in docs.collect():
        text = r.text and secrets.replaced(r.text, [s for part in secrets.find(r.text, model) for s in part])
        wanted[(r.doc_id, text, r.lang, r.source, None if text is None else len(text))] += 1
    assert rows_of(p.secret_scan(spark, docs, DIR)) == wanted and any("<ASSIGN>" in (k[1] or "") for k in wanted)


def test_mixture(spark, docs):
    got = rows_of(p.mixture(spark, docs, DIR))
    given = collections.Counter(tuple(r)[:5] for r in docs.collect())
    assert got.keys() <= given.keys() and all(n <= 2 * given[k] for k, n in got.items())
    size = lambda t: len((t or "").encode().split())
    by = collections.defaultdict(lambda: [0, 0, 0])
    for k, n in given.items():
        by[k[3]][0] += n * size(k[1])
        by[k[3]][2] = max(by[k[3]][2], size(k[1]))
    for k, n in got.items():
        by[k[3]][1] += n * size(k[1])
    sizes = spark.createDataFrame([(k, x[0]) for k, x in by.items()], "source string, size long")
    targets = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert all(abs(taken - targets[k]) <= max(0.005 * targets[k], most) for k, (_, taken, most) in by.items())
    assert rows_of(p.mixture(spark, docs.repartition(5), DIR)) == got


def test_token_ids(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in p.token_ids(spark, docs, DIR).collect())
    assert got == collections.Counter((r.doc_id, (*sp.encode(r.text or ""), sp.eos_id())) for r in docs.collect())


def test_whole_runs(spark, docs, tmp_path):
    none = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, none, DIR).count() == 0, name
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    first, again = (sorted(((r.doc_id is None, r.doc_id, r.ids_sha256) for r in p.run(spark, str(tmp_path)).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == out.count() > 0
