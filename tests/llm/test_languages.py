"""op3 against its definition, held-out accuracy, ties and odd rows."""

import numpy as np

from docweave.llm import languages as L


def test_bundles_are_those_of_the_definition():
    """Every n-gram's vector by hand: letters' vectors, each rotated by its place, multiplied; summed over the text."""

    def letter(ch):
        return np.random.Generator(np.random.PCG64(ord(ch))).integers(0, 2, L.DIM, dtype=np.int8) * 2 - 1

    for text in ("Abc, d!", "x", "  éa éa 12 éa", "The cat. THE CAT"):
        shown = "".join(ch if ch.isalpha() else " " for ch in text.lower())
        shown = " " + " ".join(shown.split()) + " "
        v = sum(np.prod([np.roll(letter(ch), k) for k, ch in enumerate(shown[i : i + 3])], axis=0) for i in range(len(shown) - 2))
        got, some = L.bundled([text])
        assert some[0] and np.allclose(got[0], v / np.linalg.norm(v), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learnt = L.train(docs.where(~L.held_out()))
    rows = [r for r in L.predict(docs.where(L.held_out() & docs.lang.isNotNull()), learnt, ["doc_id", "lang"]).collect() if r.lang_pred != "und"]
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_ties_go_to_the_first_by_code_point(spark):
    rows = [(i, "same words in both", lang, "x") for i, lang in enumerate(("b", "a", "b", "a", None))] + [(9, None, "a", "x"), (9, None, "a", "x"), (None, "12 34", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    learnt = L.train(df)
    assert sorted(learnt) == ["a", "b"]
    got = L.predict(df, learnt, ["doc_id"]).collect()
    assert [r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 9] == ["a"] * 5
    assert [(r.lang_pred, r.score) for r in got if r.doc_id is None or r.doc_id == 9] == [("und", 0.0)] * 3
    assert L.predict(df.limit(0), learnt, ["doc_id"]).count() == 0
