"""Golden pairs, and joins against brute force."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docweave.functions import builders as B
from docweave.functions import chunks, similarity
from docweave.functions import text as X
from docweave.operators import evaluate as E
from docweave.operators import ocr, summarise
from docweave.operators import matching as M
from docweave.plans import catalogue, fixtures, linkage
from docweave.sources import boundary, tables
from docweave.streaming import ingest

GOLDEN = [
    (X.normalize_cnr, "escr-0100-0329-2021 ", "ESCR010003292021"),
    (X.normalize_cnr, None, ""),
    (X.normalize_case_number, "2021 INSC 306", "2021INSC306"),
    (X.parent_case, "M.A. No. 364 OF 2021 IN (Criminal Appeal No. 123 of 2021)", "CRIMINAL APPEAL NO. 123 OF 2021"),
    (X.normalize_party, "Dr. A & B Ors. (Dead) through LRs.", "a and b"),
    (X.normalize_party, "Mr.", "mr"),
    (X.clean_party, "Shri A & B ORS.", "A AND B OTHERS"),
    (X.clean_extracted, "peti-\ntioner", "petitioner"),
    (X.repair_id, "ESCR-OIOOOII52O2I", "ESCR010001152021"),
    (ocr.normalize_line, "CivilAppealNo.10341of2011", "Civil Appeal No. 10341 of 2011"),
    (ocr.normalize_line, "1Oth February, 1992", "10th February, 1992"),
    (ocr.normalize_line, "O5th January", "05th January"),
    (ocr.normalize_line, "1oo MwW", "100 MW"),
    (ocr.normalize_line, "mav interfere on merits", "may interfere on merits"),
]


@pytest.mark.parametrize("f,given,wanted", GOLDEN)
def test_columns(spark, f, given, wanted):
    assert spark.range(1).select(f(F.lit(given).cast("string"))).first()[0] == wanted


#: A vocabulary of the words that the golden pairs are about, the most frequent first.
KNOWN = ocr.Vocabulary("the to of and a in court state section clause agreement into power company ltd himachal pradesh implementation construction referable prescribed completely disputes restoring principal arbitral argument required compound disposing exceeded held applicant judgment appellant tribunal".split())


@pytest.mark.parametrize("given,wanted", [("co ns tr uct i on", "construction"), ("re fer a ble", "referable"), ("pr inc i pal", "principal"), ("ar bi tr al", "arbitral"), ("ju dg me nt", "judgment"), ("Tr ib un al,", "Tribunal,"), ("the Court", "the Court"), ("UHL Power Company Ltd.", "UHL Power Company Ltd."), ("Section 34", "Section 34"), ("Clause 2.2", "Clause 2.2")])
def test_fragments(given, wanted):
    assert ocr.join_fragments(given, KNOWN) == wanted


@pytest.mark.parametrize("given,wanted", [("ImplementationAgreement", "Implementation Agreement"), ("intothe", "into the"), ("StateofHimachalPradesh", "State of Himachal Pradesh"), ("Clause4", "Clause 4"), ("Agreement .", "Agreement."), ("Company ,", "Company,"), ("Section 34 (2)(b)(ii)", "Section 34 (2)(b)(ii)"), ("applicant", "applicant"), ("THEAPPELLANT", "THE APPELLANT"), ("", ""), (None, "")])
def test_refine(given, wanted):
    assert ocr.refine(given, KNOWN) == wanted


def table_of_texts(spark, path, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_input_text_of_a_text_without_words(spark, tmp_path):
    """As in its SQL, the parties' line stands without a name; the search's own input leaves it out."""
    d = table_of_texts(spark, tmp_path, {0: " \n ", 1: "", 2: "a b c d e f g"})
    assert {r.doc_id: r.text for r in linkage.input_text(spark, d).collect()} == {0: "Parties:  v. \n \n ", 1: "Parties:  v. \n", 2: "Parties: a b c v. d e f\na b c d e f g"}
    assert spark.range(1).select(chunks.input_text(F.lit(""), F.lit(""), F.lit(""), F.lit("x"))).first()[0] == "x"


def test_mismatch_counts_the_characters_as_they_stand(spark):
    df = spark.createDataFrame([("ß" + "x" * 99,), ("ß" + "x" * 100,)], "t string")
    assert [r.m for r in df.select(X.text_mismatch(F.col("t"), F.lit("ESCR1")).alias("m")).collect()] == [False, True]


def test_clean_party_query_keeps_anr(spark, tmp_path):
    """Its SQL has no rule for ANR; the operator has."""
    d = table_of_texts(spark, tmp_path, {0: "a b c le anr de g"})
    assert catalogue.queries()["clean_party"](spark, d).first().party == "le anr de AND OTHERS"
    d = table_of_texts(spark, tmp_path / "upper", {0: "le anr de a b c"})
    assert catalogue.queries()["clean_party_upper"](spark, d).first().party == "LE ANR DE AND OTHERS"
    assert spark.range(1).select(X.clean_party(F.lit("Mr le anr. de"))).first()[0] == "le ANOTHER de"


def test_strip_takes_white_space_of_any_kind(spark):
    some = [chr(i) + "a b" + chr(i) * 2 for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000] + ["", " \n", "a\n", "\u3000a \x85"]
    df = spark.createDataFrame([(x,) for x in some], "t string")
    wanted = X.rules(F.col("t"), (r"(?U)^\s+", ""), (r"(?U)\s+$", ""))
    assert df.where(X.strip(F.col("t")) != wanted).count() == 0


def test_mcnemar_of_many_is_exact_and_linear(spark):
    """The exact p-value of 20,000 discordant pairs, for which each of 10,000 terms took as many steps as its number before."""
    df = spark.createDataFrame([(9900, 10100), (3, 9), (0, 5), (0, 0), (7, 7), (9000, 11000)], "b long, c long")
    for r in df.select("b", "c", E.mcnemar(F.col("b"), F.col("c")).alias("p")).collect():
        n, low = r.b + r.c, min(r.b, r.c)
        assert r.p == pytest.approx(min(1.0, 2 * sum(math.comb(n, k) for k in range(low + 1)) / 2**n) if n < 100 else _tail(n, low), rel=1e-8)


def _tail(n, low):
    unit = 1 << 200
    term = total = unit  # of the last term, the others down from it
    for k in range(low, 0, -1):
        term = term * k // (n - k + 1)
        total += term
    return min(1.0, 2 * float(Fraction(math.comb(n, low) * total, unit << n)))


def test_pages_are_shuffled_once_and_before_their_words_are_rows(spark, tmp_path):
    d = table_of_texts(spark, tmp_path, {0: " ".join(f"w{i}" for i in range(450)), 3: "", 7: " one two\n"})
    plan = catalogue.queries()["token_lines"](spark, d)
    assert plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
    rows = {(r.page, r.line): r.text for r in plan.collect()}
    assert len(rows) == 17 * 2 + 5 + 1 and rows[700000, 0] == "one two" and rows[2, 4] == "w448 w449"
    facts = {r.page: (r.raw_text, r.low_confidence, r.artefacts) for r in ocr.facts(fixtures.tokens(spark, d), "page").collect()}
    assert facts == {r.page: (r.raw_text, r.low_confidence, r.artefacts) for r in ocr.processed(fixtures.tokens(spark, d), "page").collect()}


def test_year_band_sizes_count_the_pairs(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate([2001, 2002, 2002, 2004, None, 2010])], "doc_id long, year int")
    pairs = M.year_band(df, df).groupBy("q_doc_id").count()
    assert sorted(map(tuple, M.year_band_sizes(df, df, "doc_id").collect())) == sorted(map(tuple, pairs.collect()))
    plan = M.year_band_sizes(df, df, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan.split("Join")[1]  # the pool is counted before it is joined


def test_segments_are_the_cheapest():
    words = ocr.Vocabulary(["ab", "abc", "cd", "d", "bcd", "a"])

    def cost(parts):
        return sum(words.cost[p] if p in words else words.unknown[len(p)] + 100 * (len(p) == 1 and p not in ("a", "i")) for p in parts)

    def every(block):
        return [[]] if not block else [[block[:k], *rest] for k in range(1, len(block) + 1) for rest in every(block[k:])]

    for block in ("abcd", "dabcab", "xaby", "aabbcc"):
        assert cost(words.segment(block)) == pytest.approx(min(map(cost, every(block)))) and "".join(words.segment(block)) == block
    assert words.segment("abc") == ["abc"] and words.segment("") == []


def test_page_text():
    box = lambda t, x, y=0: {"text": t, "x0": x, "x1": x + 10 * len(t), "y0": y, "y1": y + 20}
    assert ocr.page_text([box("comp", 0), box("letely", 42)], KNOWN) == "completely"
    assert ocr.page_text([box("the", 0), box("Court", 50), box("held", 0, 100)], KNOWN) == "the Court\n\nheld"
    assert ocr.page_text([], KNOWN) == ""


def test_pages_of_noise_and_vocabularies(spark, tmp_path):
    rows = [(1, 0, "TFP", 0.0, 0.0, 30.0, 20.0, 0.9), (1, 1, " ", 0.0, 0.0, 1.0, 1.0, 0.9), (1, 2, None, 0.0, 0.0, 1.0, 1.0, 0.9), (2, 0, "comp", 0.0, 0.0, 40.0, 20.0, 0.5), (2, 1, "letely", 42.0, 0.0, 102.0, 20.0, 90.0), (2, 2, "|", 200.0, 0.0, 210.0, 20.0, 0.9)]
    df = spark.createDataFrame(rows, "page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, score double")
    assert {r.page: r.text for r in ocr.pages(df, KNOWN, "page").collect()} == {1: "", 2: "completely"}
    assert {r.page: r.text for r in ocr.layout(df, "page", noise_goes=True).collect()} == {1: "", 2: "comp letely"}
    got = {r.page: r for r in ocr.processed(df, "page").collect()}
    assert got[1].text == "" and got[1].raw_text == "TFP" and got[2].raw_text == "comp\nletely\n|" and got[2].geometry_text == "comp letely"
    assert list(got[2].low_confidence) == [0] and [(a.seq, a.reason) for a in got[2].artefacts] == [(2, "Garbage/isolated symbol artifact")]
    assert ocr.pages(df.limit(0), KNOWN, "page").count() == 0
    (tmp_path / "words").write_text("beta\nalpha\n")
    assert list(ocr.vocabulary_file(spark, str(tmp_path / "words")).cost) == ["beta", "alpha"]
    assert list(ocr.vocabulary_of(spark.createDataFrame([("b a bb bb",), ("aa Bb",), (None,)], "text string")).cost) == ["bb", "aa"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_ratios():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(0, 12))) for _ in range(2))
        assert similarity.common_length(a, b) == plain_lcs(a, b)
        s = similarity.token_set_ratio(a, b)
        assert 0 <= s <= 100 and s == similarity.token_set_ratio(b, a)
    assert round(similarity.indel_ratio("2021INSC306", "2021INSC307"), 1) == 90.9
    assert similarity.token_set_ratio("a b", "b a c") == 100 and similarity.token_set_ratio("", "a") == 0


def test_chunks():
    assert chunks.packed("short", 100, 10) == [(1, 1, "short", 1, 1)]
    got = chunks.packed("\n\n".join(f"[Page {i}]\n" + "x" * 30 for i in range(1, 7)), 100, 45)
    assert len(got) > 1 and {g[1] for g in got} == {len(got)} and got[1][3] == 2
    assert chunks.packed(None, 10, 2) == []


def test_year_band_is_brute_force(spark):
    rows = [(i, 2000 + i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, year int")
    got = {(r.q_id, r.c_id) for r in M.year_band(df, df).select("q_id", "c_id").collect()}
    assert got == {(a, c) for a, y in rows for c, z in rows if abs(y - z) <= 1}


def test_dedup_is_ordered(spark):
    rows = [("a", "1", 2020, 0), ("a", "2", 2020, 1), ("b", "2", 2020, 2), ("", "3", 2020, 3), ("", "", 2020, 4), ("m", "9", 2020, 5)]
    batch = spark.createDataFrame(rows, "cnr string, case_number string, year int, ordinal int")
    master = spark.createDataFrame([("m", "x")], "cnr string, case_number string")
    assert sorted(r.ordinal for r in ingest.new_only(batch, master).collect()) == [0, 2, 3, 4]


def test_tiers_cover_all_queries(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    rows = e.queries()["cascade"](spark, d).collect()
    assert len(rows) == len({r.query_id for r in rows}) > 0
    assert {r.match_tier for r in rows if r.query_id.endswith("clean")} == {"exact"}


def test_intake_fields(spark):
    rows = spark.createDataFrame([("see [1999]  2 SCR 17",), ("2021 INSC 306 and escr010003292021",), ("x",), (None,), ("",)], "t string")
    got = [r.f.asDict() for r in rows.select(X.ingest_fields(F.col("t"), F.lit("stem")).alias("f")).collect()]
    assert [g["case_id"] for g in got] == ["1999_SCR_2_17", "2021INSC306", "stem", "stem", "stem"]
    assert got[1] == {"cnr": "ESCR010003292021", "display": "2021 INSC 306", "case_id": "2021INSC306"}


def test_positions_are_one_to_n_and_shares_exact(spark):
    rows = E.by_position(spark.range(1003), F.col("id").cast("string"), {"a": 0.4, "b": 0.4, "c": 0.2}).collect()
    assert sorted(r.position for r in rows) == list(range(1, 1004))
    assert [sum(r.share == x for r in rows) for x in "abc"] == [401, 401, 201]
    assert E.by_position(spark.range(0), F.col("id").cast("string"), {"a": 1.0}).count() == 0


def test_order_statistics(spark):
    rows = [("a", v) for v in (5, 1, 1, 9, 3)] + [("b", 2), ("c", None)]
    got = {r.k: (r.p50, r.p90) for r in E.order_statistics(spark.createDataFrame(rows, "k string, v int"), "k", "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (3, 9), "b": (2, 2)}


def test_builders(spark):
    one = lambda x: spark.range(1).select(x).first()[0]
    rng = random.Random(2)
    for width in (7, 20):
        text = "\n\n".join(" ".join("x" * rng.randint(1, 6) for _ in range(12)) for _ in range(3)) + "\n\n \n\n"
        import textwrap

        assert one(B.wrapped(F.lit(text), width)) == "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n") if p.strip())
    assert one(B.wrapped(F.lit("abcdefghij kl"), 4)) == "abcd\nefgh\nij\nkl"
    sentences = [f"Sentence {i}." for i in range(9)]
    mixed = one(B.shuffled_sentences(F.lit(" ".join(sentences)), F.lit(1)))
    parts = mixed.split(". ")
    assert mixed != " ".join(sentences) and sorted(p.strip(".") for p in parts) == sorted(s.strip(".") for s in sentences) and mixed.startswith("Sentence 0. Sentence 1. ") and mixed.endswith("Sentence 7. Sentence 8.")
    assert one(B.shuffled_sentences(F.lit("One. Two."), F.lit(1))) == "One. Two."
    assert one(B.synonyms(F.lit("The Petitioner won; FIR"), hard=True)) == "The the aggrieved party won; first information report"
    assert one(B.fill("{a} {b} {a} {c}", a=F.lit("x"), b=F.lit(None).cast("string"))) == "x  x {c}"
    assert one(B.prompt("{index}/{total} p{pages}: {text}", F.lit("t"), F.lit(1), F.lit(2), F.lit(3), F.lit(3))) == "1/2 p3: t"
    record = {k: F.lit(v) for k, v in {"cnr": "C1", "case_number": "", "chunk_opening": "o" * 500, "chunk_body": "body"}.items()}
    made = one(B.summary(record, F.lit("raw")))
    assert "- **Case Name:** Supreme Court Judgment" in made and "C1 (N/A)" in made and "\n" + "o" * 400 + "\n" in made and "\nbody\n" in made
    assert [one(B.noised_party(F.lit("A B c"), F.lit(k))) for k in range(6)] == ["A B c", "A B C", "a b c", "Shri A B c", "A B c & Ors.", "A B"]


def test_summaries_and_two_passes(spark):
    class Counts:
        def summarise(self, prompt, most_tokens):
            return f"{most_tokens}:{len(prompt.splitlines())}"

    docs = spark.createDataFrame([(1, "short"), (2, "\n\n".join(["p" * 50] * 5)), (3, " "), (4, None)], "doc_id int, text string")
    got = {r.doc_id: (r.n_chunks, r.summary) for r in summarise.summaries(docs, Counts(), size=120, overlap=10).collect()}
    assert set(got) == {1, 2} and got[1] == (1, "1500:2") and got[2][0] == 3 and got[2][1].startswith("1500:")
    pages = spark.createDataFrame([("d", 1, "usable text " * 10), ("d", 2, "x"), ("d", 3, ""), ("d", 4, None)], "doc string, page int, text string")
    read = spark.createDataFrame([("d", 2, "read", 95.0, None), ("d", 3, None, None, "failed")], "doc string, page int, text string, confidence double, error string")
    rows = {r.page: (r.method, r.status, r.text) for r in summarise.two_pass(pages, read).collect()}
    assert rows[1][:2] == ("direct_parse", "passed") and rows[2] == ("ocr", "passed", "read") and rows[3] == ("ocr", "needs_review", "") and rows[4] == ("ocr", "needs_review", "")


def test_custom_cases_are_appended_and_seen(spark, tmp_path):
    kind = "title string, cnr string, case_number string, petitioner string, respondent string, year int"
    path = f"{tmp_path}/custom"
    assert tables.append_custom(spark.createDataFrame([("A V. B", "n1", "", "", None, None), ("", "n2", "", "", None, None)], kind), path) == (1, 1)
    assert tables.append_custom(spark.createDataFrame([("A V. B", "n1", "", "", None, None), ("C V. D", "old", "", "", None, None)], kind), path) == (2, 0)
    pool = spark.createDataFrame([("OLD", 1)], "cnr string, ordinal int")
    both = tables.with_custom(pool, spark.read.parquet(path))
    assert sorted((r.cnr, r.is_custom) for r in both.collect()) == [("N1", True), ("OLD", None)]
    asked = spark.createDataFrame([("OLD",), ("N1",), ("ZZ",)], "cnr string")
    asked.write.parquet(f"{tmp_path}/asked")
    stream = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/asked")
    answer = lambda q, p: q.join(p.select("cnr"), "cnr", "left_semi")
    ingest.live_search(stream, path, pool, answer, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert sorted(r.cnr for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["N1", "OLD"]


def test_streams_run(spark, tmp_path):
    kind = "cnr string, case_number string, year int, ordinal int"
    for k, rows in enumerate(([("a", "1", 2020, 0), ("a", "2", 2020, 1)], [("b", "1", 2021, 2), ("c", "3", 2021, 3)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        ingest.ingest_stream(stream, f"{tmp_path}/master", f"{tmp_path}/ck").awaitTermination(60)
    assert sorted(r.ordinal for r in spark.read.parquet(f"{tmp_path}/master").collect()) == [0, 3]
    events = spark.createDataFrame([("j", "queued", None), ("j", "processing", None), ("j", "processing", 1), ("j", "done", 2), ("k", "queued", None)], "job string, status string, page int")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    ingest.job_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), f"{tmp_path}/jobs", f"{tmp_path}/ck2").awaitTermination(60)
    assert {(r.job, r.status, r.n_pages) for r in spark.read.parquet(f"{tmp_path}/jobs").collect()} == {("j", "done", 2), ("k", "queued", 0)}


def test_tables(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/2001/metadata.parquet")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{tmp_path}/2003/metadata.parquet")
    assert sorted((r.a, r.b, r.year) for r in tables.yearly(spark, str(tmp_path), 2000, 2004).collect()) == [(1, None, 2001), (2, "x", 2003)]
    with pytest.raises(FileNotFoundError):
        tables.yearly(spark, str(tmp_path), 1990, 1991)
    path = f"{tmp_path}/t"
    tables.overwrite(spark.range(3), path)
    tables.overwrite(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    tables.truncate_json(spark.range(5), f"{tmp_path}/j")
    tables.truncate_json(spark.range(2), f"{tmp_path}/j")
    tables.append_json(spark.range(1), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    quads = spark.createDataFrame([("p", [([[0.0, 1.0], [9.0, 1.0], [9.0, 4.0], [0.0, 4.0]], "t", None), ([[0.0, 1.0]], "u", 0.5), ([[0.0, 1.0]] * 4, None, 0.5)])], "name string, value array<struct<quad:array<array<double>>,text:string,score:double>>")
    assert [(r.text, r.score, r.x1, r.y1) for r in tables.quads(quads).collect()] == [("t", 0.0, 9.0, 4.0)]
    texts = spark.createDataFrame([("a" * 200, "b" * 300), ("a", "b" * 300), ("", None)], "a string, b string")
    assert [(r.x.engine, r.x.is_scanned) for r in texts.select(tables.longer_text(texts.a, texts.b).alias("x")).collect()] == [("first", False), ("second", False), ("none", True)]


def test_small_functions(spark):
    one = lambda x: spark.range(1).select(x).first()[0]
    assert one(X.is_generic_govt(F.lit(" "))) and not one(X.is_generic_govt(F.lit("State of X"))) and one(X.is_generic_govt(F.lit("State of X"), strict_reference=False))
    assert one(X.margin_letters(F.lit("a\n B \nb\n\n\n\nc"))) == "a\n\nb\n\nc"
    assert one(X.after_rule(F.lit("x\n---\n y \n---\nz"))) == "y \n---\nz" and one(X.after_rule(F.lit("x"))) == "x"
    similarity.register(spark)
    assert spark.sql("SELECT token_set_ratio('a b', 'b a c') AS s, indel_ratio('ab', 'ab') AS r").first() == (100.0, 100.0)
    assert boundary.HashedWords(8).embed(["a a", ""])[1] == [0.0] * 8 and boundary.PlainPdf().pages(b"a\x0cb") == ["a", "b"]


def test_archives(spark, tmp_path):
    import io
    import tarfile

    for name, members in (("a.tar", {"X1_EN.pdf": b"one\x0ctwo", "deep/X2.pdf": b"y" * 300}), ("b.tar", {"X3_EN.pdf": b"\xff"})):
        with tarfile.open(tmp_path / name, "w") as tar:
            for m, data in members.items():
                info = tarfile.TarInfo(m)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    (tmp_path / "c.tar").write_bytes(b"not an archive")
    members = tables.archive_members(spark, f"{tmp_path}/*.tar")
    assert sorted(r.member for r in members.collect()) == ["X1_EN.pdf", "X3_EN.pdf", "deep/X2.pdf"]

    class Fails:
        def pages(self, data):
            raise ValueError

    records = spark.createDataFrame([("1", "X1"), ("2", "deep/X2.pdf"), ("3", "gone")], "cnr string, path string")
    got = {r.cnr: (r.text, r.engine, r.is_scanned) for r in tables.case_texts(records, members, Fails(), boundary.PlainPdf()).collect()}
    assert got == {"1": ("one\ntwo", "second", True), "2": ("y" * 300, "second", False), "3": ("", "none", True)}
    assert tables.case_texts(records, members, boundary.PlainPdf(), Fails(), most_pages=1).where("cnr = '1'").first().text == "one"
    assert tables.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")) == "| n | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"


def test_dedup_of_repeated_pairs(spark):
    rows = [("a", "1", 2020, i) for i in range(50)] + [("a", "2", 2020, 60), ("", "7", 2020, 61), ("", "7", 2020, 62), ("", "", 2020, 63), ("", "", 2020, 64)]
    batch = spark.createDataFrame(rows, "cnr string, case_number string, year int, ordinal int")
    assert sorted(r.ordinal for r in ingest.new_only(batch, batch.limit(0).select("cnr", "case_number")).collect()) == [0, 61, 63, 64]
