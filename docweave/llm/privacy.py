"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give protected entities away.

The base kinds are fixed patterns; their matches are the protected entities. How much a term tells about an entity is
their pointwise mutual information, estimated from documents: log2(N c(t, e) / (c(t) c(e))), where c(t, e) counts the
documents in which the term stands within `window` words of the entity. An entity's information content is
log2(N / c(e)). A term whose information is at least `threshold` of that content discloses the entity: wherever the
term stands it is a span of kind `term`, and sanitise() generalises it. One passage is enough, as most entities stand
in one only; `support` asks for more contexts (the words around the entity; copies of a passage are one context).
Terms are words of two letters or more, as names may be short; those under four don't count towards the window.

Three passes, none of which moves a text: entities and the terms around them; the document counts of those terms over
the whole corpus, summed in each task before they are dealt; and base spans together with the places of the terms that
disclose. Terms are let through by Bloom filters of fixed size and settled by exact joins.

Null texts count as empty. Repeated rows are documents of their own (told apart by a row number given when the texts
are read), so are repeated or null ids. Texts are scanned whole. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import Span, digest, joined, replaced

# The base patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TERM = re.compile(r"[^\W\d_]{2,}")
#: Words of fewer letters don't count towards the window.
COUNTED = 4
ALL_KINDS = (*KINDS, "term")
#: Bits of the Bloom filter: 4 MB, whatever the corpus holds.
BLOOM_BITS = 1 << 25


def emails(text: str) -> Iterator[Span]:
    """From each @, back over the characters that may stand before it (not into the last match), then the domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[Span]:
    """Four numbers at a time out of every dotted run; fours with a number above 255 are dropped."""
    for m in NUMBERS.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in four):
                yield "ip", start, start + size
            start += size + 1


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out = [*emails(text), *ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, value: str) -> str:
    """What a match stands for: numbers by their digits, addresses in lower case."""
    return f"{kind}:{value.lower() if kind == 'email' else re.sub('[^0-9.]' if kind == 'ip' else '[^0-9]', '', value)}"


def around(text: str, spans: list[Span], window: int) -> set[tuple[str, str]]:
    """(entity, term in lower case) for the terms among the `window` words before and after each span, outside all spans."""
    out = set()
    for k, a, b in spans:
        low = max(0, a - 40 * window)
        while low and text[low - 1].isalpha():
            low -= 1
        before, after = [], []
        for side, found in ((before, reversed(list(TERM.finditer(text, low, a)))), (after, TERM.finditer(text, b))):
            n = 0
            for m in found:
                if n == window or m.start() > b + 40 * window:
                    break
                side.append(m)
                n += len(m[0]) >= COUNTED
        for m in (*before, *after):
            if not any(x < m.end() and m.start() < y for _, x, y in spans):
                out.add((entity(k, text[a:b]), m[0].lower()))
    return out


def bloom_places(term: str) -> tuple[int, ...]:
    h = xxhash.xxh64_intdigest(term, 1)
    return tuple((h >> 16 * i ^ h * (2 * i + 1)) % BLOOM_BITS for i in range(4))


def bloom(terms: DataFrame) -> bytes:
    """A Bloom filter of terms(term); tasks set bits in filters of their own, which are joined two by two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            words: dict[int, int] = {}
            for (term,) in common.rows_of(batches, "term"):
                for p in bloom_places(term):
                    words[p >> 5] = words.get(p >> 5, 0) | 1 << (p & 31)
            yield from words.items()

        return common.in_batches(rows(), pa.schema([("at", pa.int64()), ("bits", pa.int64())]), 8192)

    # one row for each 32-bit word that is set: no more than BLOOM_BITS / 32 of them reach the driver
    out = np.zeros(BLOOM_BITS // 32, dtype="<u4")
    found = terms.mapInArrow(common.tidy(run), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype("<u4")
    return out.tobytes()


def passed(bits: np.ndarray, known: dict[str, bool], term: str) -> bool:
    if (ok := known.get(term)) is None:
        if len(known) > 500_000:
            known.clear()
        ok = known[term] = all(bits[p >> 3] >> (p & 7) & 1 for p in bloom_places(term))
    return ok


def disclosing(pairs: DataFrame, counts: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """(term): the terms that disclose some entity. pairs(entity, term, both), counts(term, c); a pair with an empty term counts its entity."""
    ent = pairs.where("term = ''").select("entity", F.col("both").alias("c_e"))
    told = pairs.where("term <> ''").join(counts, "term").join(ent, "entity")
    content = F.log2(F.lit(float(max(n_docs, 1))) / F.col("c_e"))
    pmi = F.log2(F.lit(float(max(n_docs, 1))) * F.col("both") / (F.col("c") * F.col("c_e")))
    return told.where((content > 0) & (pmi >= threshold * content)).select("term").distinct()


def text_key(text: str | None) -> str:
    """What tells texts apart: 128 bits of XXH3; null counts as empty."""
    return xxhash.xxh3_128_hexdigest(text or "")


def find(docs: DataFrame, window: int = 5, threshold: float = 0.9, support: int = 1, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """A row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; with `keys`, text_key too."""
    spark = docs.sparkSession
    common.short_batches(spark)
    id_arrow, id_ddl = common.arrow_type(docs, id_col), common.ddl_type(docs, id_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("entity", pa.string()), ("term", pa.string()), ("context", pa.int64())]

        def rows() -> Iterator[tuple]:
            for (text,) in common.rows_of(batches, "text"):
                if text and (spans := base_spans(text)):
                    told: dict[str, set[str]] = {entity(k, text[a:b]): set() for k, a, b in spans}
                    for e, t in around(text, spans, window):
                        told[e].add(t)
                    for e, terms in told.items():
                        context = xxhash.xxh3_64_intdigest(" ".join(sorted(terms))) - (1 << 63)
                        for t in ("", *terms):  # a document names a pair once, so counting rows counts documents
                            yield e, t, context

        return common.in_batches(rows(), pa.schema(fields), 4096)

    pairs = own.mapInArrow(common.tidy(first), "entity string, term string, context long").groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts"))
    pairs = common.written(pairs.where((F.col("contexts") >= support) | (F.col("term") == "")), "pairs")
    candidates = pairs.where("term <> ''").select("term").distinct()
    shared = spark.sparkContext.broadcast(bloom(candidates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            bits, known, seen = np.frombuffer(shared.value, dtype=np.uint8), {}, {}
            for (text,) in common.rows_of(batches, "text"):
                for term in {m.lower() for m in TERM.findall(text or "")}:
                    if passed(bits, known, term):
                        seen[term] = seen.get(term, 0) + 1
                if len(seen) > 500_000:
                    yield from seen.items()
                    seen.clear()
            yield from seen.items()

        return common.in_batches(rows(), pa.schema([("term", pa.string()), ("c", pa.int64())]), 8192)

    told = spark.createDataFrame([], "term string")
    if candidates.limit(1).count():
        counts = own.mapInArrow(common.tidy(count), "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))
        told = common.written(disclosing(pairs, counts.join(candidates, "term", "left_semi"), own.count(), threshold), "told")
    shared.unpersist()
    telling = spark.sparkContext.broadcast(bloom(told))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("row_id", pa.int64()), ("doc_id", id_arrow), ("term", pa.string()), ("places", pa.string())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("text_key", pa.string())]

        def rows() -> Iterator[tuple]:
            numbers, bits, known = common.task_rows(), np.frombuffer(telling.value, dtype=np.uint8), {}
            some = bool(bits.any())
            for doc_id, text in common.rows_of(batches, "doc_id", "text"):
                text = text or ""
                row_id, spans = next(numbers), base_spans(text)
                yield row_id, doc_id, None, joined(spans, KINDS), *(sum(s[0] == k for s in spans) for k in KINDS), digest(spans, KINDS), text_key(text) if keys else None
                if some and any(passed(bits, known, t) for t in {m.lower() for m in TERM.findall(text)}):
                    places: dict[str, list[str]] = {}
                    for m in TERM.finditer(text):
                        if passed(bits, known, m[0].lower()):
                            places.setdefault(m[0].lower(), []).append(f"term:{m.start()}:{m.end()}")
                    for term, found in places.items():
                        yield row_id, doc_id, term, ",".join(found), *(0,) * len(KINDS), "", None

        return common.in_batches(rows(), pa.schema(fields))

    ddl = f"row_id long, doc_id {id_ddl}, term string, places string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, text_key string"
    read = common.written(own.mapInArrow(common.tidy(second), ddl), "read")
    telling.unpersist()
    bases, hits = read.where("term is null"), read.where("term is not null")
    more = hits.select("row_id", "term", "places").join(told, "term", "left_semi").groupBy("row_id").agg(F.collect_list("places").alias("more"))
    kinds = [*KINDS, "term"]

    def order(x: F.Column) -> F.Column:
        part = F.split(x, ":")
        return F.struct(part[1].cast("long").alias("a"), F.array_position(F.array(*map(F.lit, kinds)), part[0]).alias("k"), part[2].cast("long").alias("b"), x.alias("s"))

    base_list = F.filter(F.split("places", ","), lambda x: x != "")
    spans = F.array_join(F.transform(F.array_sort(F.transform(F.concat(base_list, F.filter(F.split(F.array_join("more", ","), ","), lambda x: x != "")), order)), lambda x: x["s"]), ",")
    out = bases.join(more, "row_id", "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", *["text_key"] * keys, F.when(F.size("more") == 0, F.col("places")).otherwise(spans).alias("spans"))


def sanitise(docs: DataFrame, window: int = 5, threshold: float = 0.9, support: int = 1, text_col: str = "text") -> DataFrame:
    """docs with every span of find() generalised to <KIND> in the text. Rows are matched to their spans by their texts, so ids play no part; null texts stay null, other columns as they are."""
    names = list(docs.columns)

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(text_key)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([t if not t or not m else replaced(t, [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in m.split(","))]) for t, m in zip(texts, marks, strict=True)], dtype=object)

    told = find(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")), window, threshold, support, keys=True)
    told = told.where("spans <> ''").select(F.col("text_key").alias("_told_key"), F.col("spans").alias("_told_spans")).distinct()
    both = docs.withColumn("_own_key", key(F.col(text_col))).join(told, F.col("_own_key") == F.col("_told_key"), "left")
    return both.withColumn(text_col, clean(F.col(text_col), F.col("_told_spans"))).select(*(F.col(f"`{n}`") for n in names))
