"""op8's disclosing terms with the parameters that the query runs with."""

import math
import random
import re
from collections import Counter

from docweave.llm import privacy
from docweave.llm.spans import replaced


def test_terms_of_an_entity_in_one_passage_disclose(spark):
    rows = [(0, "please write to Ng Zorblax of the house at spy@mi.org again"), (1, "only Zorblax here"), (2, "and Ng too")]
    rows += [(i, "please write to of the house at again only here and too") for i in range(3, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in privacy.find(df).collect()}
    assert got[0] == "term:16:18,term:19:26,email:43:53" and got[1] == "term:5:12" and got[2] == "term:4:6" and got[3] == ""
    once = spark.createDataFrame([(0, "please write to Ng Zorblax at spy@mi.org again"), *rows[3:]], df.schema)
    assert {r.doc_id: r.spans for r in privacy.find(once).collect()}[0] == "term:16:18,term:19:26,email:30:40"


def test_short_words_do_not_narrow_the_window():
    text = "alpha bravo charlie delta echoes to me or us at a@b.cd"
    found = {t for _, t in privacy.around(text, privacy.base_spans(text), 5)}
    assert found == {"alpha", "bravo", "charlie", "delta", "echoes", "to", "me", "or", "us", "at"}


def brute(texts: list[str | None], window: int = 5, threshold: float = 0.9) -> list[str]:
    """Every document's spans, from plain counts."""
    n, both, seen, has = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        spans = privacy.base_spans(t or "")
        both.update(privacy.around(t or "", spans, window))
        seen.update({privacy.entity(k, t[a:b]) for k, a, b in spans})
        has.update({m.lower() for m in re.findall(r"[^\W\d_]{2,}", t or "")})
    told = set()
    for (e, term), c in both.items():
        content = math.log2(n / seen[e])
        if content > 0 and math.log2(n * c / (has[term] * seen[e])) >= threshold * content:
            told.add(term)
    out = []
    for t in texts:
        spans = privacy.base_spans(t or "") + [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{2,}", t or "") if m[0].lower() in told]
        order = (*privacy.KINDS, "term")
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]), s[2]))))
    return out


def test_spans_are_those_of_plain_counts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, None), (-1, ""), (-1, "Zorblax wrote from zor@blax.org today"), (-1, "Zorblax wrote from zor@blax.org today"), (-2, "nobody but zorblax"), (-3, "a " * 100_000 + "zorblax 1.2.3.4")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, term string, n_ip long")
    got = Counter((r.doc_id, r.spans) for r in privacy.find(df).collect())
    wanted = Counter(zip((i for i, _ in rows), brute([t for _, t in rows]), strict=True))
    assert got == wanted and sum("term:" in s for _, s in wanted) > 20
    parsed = lambda marks: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in marks.split(",") if x)]
    clean = Counter((i, t if not t else replaced(t, parsed(marks))) for (i, t), marks in zip(rows, brute([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.text) for r in privacy.sanitise(df).collect()) == clean and any("<TERM>" in (t or "") and "<EMAIL>" in t for _, t in clean)
    assert privacy.find(df.limit(0)).count() == 0 and privacy.sanitise(df.limit(0)).count() == 0


def test_base_patterns_are_those_of_the_contract():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    rng = random.Random(9)
    parts = ["1.2.3.4", "255.256", ".", "..", "@", "a@b.c", "x-y", " ", "-", "+", "(", ")", "49", "0", "4111111111111111", "5500 0000 0000 0004", "é", "0001", "%"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        wanted = sorted(((k, m.start(), m.end()) for k, pattern in plain.items() for m in re.finditer(pattern, text, re.ASCII) if holds(k, m[0])), key=lambda s: (s[1], privacy.KINDS.index(s[0])))
        assert privacy.base_spans(text) == wanted, text
