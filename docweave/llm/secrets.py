"""Secret scans: base patterns, and character Markov models of random strings against ordinary identifiers.

The base kinds are fixed patterns. Beside them, every run of 20 or more characters of [A-Za-z0-9+/_-] that no base span
touches is scored: two order-1 Markov models over characters, one of random strings, one of ordinary identifiers, give
the log-likelihood ratio per character; above the threshold the run is a span of kind `random`.

Both models are fitted on labelled samples. Positives: the values of base matches, but for those that are words (letters
of one case only, perhaps a capital first), together with strings drawn uniformly from common secret alphabets (seeded).
Negatives: the words of the corpus outside base matches, and identifiers and paths joined of them and of short numbers, plain
numbers and rules of one character (seeded). Of either label a fifth is held back for the threshold and a fifth for Model.recall and Model.false_rate, both
measured on strings of 20 characters or more. The threshold lies where at most `most_false` of the negatives are above
it, and not under zero; where all but `most_missed` of the positives are higher still, it lies midway to them.

The samples are bounded for each label: words and values come from the `texts` documents of smallest hash, and of their
distinct values at most `most_values`, of their distinct words at most `most_words`, the smallest by hash, are taken; so
they don't depend on partitioning and neither label displaces the other. Null texts count as empty. Repeated rows and
ids are rows of their own. Texts are scanned whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import Span, digest, joined, replaced

# The base patterns of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Characters of a run that is scored, at least.
LEAST = 20
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}")
#: A value that is a word isn't a random string.
PLAIN = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]{3,}")
ALL_KINDS = (*KINDS, "random")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches per kind; one that fails its length is dropped and not tried again."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def values(text: str) -> list[str]:
    """What base matches hold as their secret."""
    out = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [m[0] for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [m[0] for m in HEX.finditer(text)]


class Model:
    """Log-likelihood ratios of character pairs, random against ordinary, and a threshold for their mean; recall and false_rate are of held-back strings."""

    def __init__(self, table: np.ndarray, threshold: float, recall: float = float("nan"), false_rate: float = float("nan")) -> None:
        self.table, self.threshold, self.recall, self.false_rate = table, threshold, recall, false_rate

    def score(self, run: str) -> float:
        codes = np.frombuffer(run.encode("ascii"), dtype=np.uint8)
        return float(self.table[np.concatenate([[0], codes[:-1]]), codes].mean())


def log_chances(strings: list[str]) -> np.ndarray:
    """Of each character after each other (0: the start), smoothed."""
    counts = np.full((128, 128), 0.05)
    for s in strings:
        codes = np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)
        np.add.at(counts, (np.concatenate([[0], codes[:-1]]), codes), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def fit(random_ones: list[str], ordinary: list[str], most_false: float = 0.0005, most_missed: float = 0.001) -> Model:
    """Models from three fifths of the strings, the threshold from the fourth, recall and false_rate from the last."""
    table = log_chances([s for i, s in enumerate(random_ones) if i % 5 < 3]) - log_chances([s for i, s in enumerate(ordinary) if i % 5 < 3])
    of = Model(table, 0.0).score

    def scores(strings: list[str], fifth: int) -> np.ndarray:
        return np.array([of(s) for s in strings[fifth::5] if len(s) >= LEAST])

    threshold, low = 0.0, scores(ordinary, 3)
    if len(low):
        threshold = max(0.0, float(np.quantile(low, 1 - most_false)))
        if len(high := scores(random_ones, 3)) and (edge := float(np.quantile(high, most_missed))) > threshold:
            threshold = (threshold + edge) / 2
    seen, false = scores(random_ones, 4) > threshold, scores(ordinary, 4) > threshold
    return Model(table, threshold, *(float(x.mean()) if len(x) else float("nan") for x in (seen, false)))


def drawn(n: int, seed: int = 7) -> list[str]:
    """Random strings of 20 to 64 characters, evenly over the alphabets."""
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABETS[i % len(ALPHABETS)], k=rng.randint(LEAST, 64))) for i in range(n)]


def identifiers(words: list[str], n: int, seed: int = 11) -> list[str]:
    """Ordinary strings of 20 characters or more: names and paths in the usual styles, joined of words and, one part in eight, short numbers; one in twenty is a number, one in forty a rule of one character."""
    rng, out = random.Random(seed), []
    styles = (("_", str), ("-", str), ("/", str), ("", str.capitalize), ("_", str.upper), ("", str), ("_", str.capitalize))
    for i in range(n if words else 0):
        if i % 20 == 0:
            out.append("".join(rng.choices("0123456789", k=rng.randint(LEAST, 40))))
            continue
        if i % 40 == 1:
            out.append(rng.choice("-_/+") * rng.randint(LEAST, 80))
            continue
        (by, cased), made = styles[i % len(styles)], ""
        while len(made) < LEAST:
            part = str(rng.randrange(10_000)) if made and rng.random() < 0.125 else rng.choice(words)
            made += (by if made else "") + (cased(part) if made or by else part)
        out.append(made)
    return out


def train(docs: DataFrame, texts: int = 4_000, most_values: int = 20_000, most_words: int = 100_000, text_col: str = "text") -> Model:
    """Fits the models on what at most `texts` documents hold, at most most_values positives and most_words negatives, and as many drawn and joined strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (text,) in common.rows_of(batches, "text"):
                found = values(text)
                rest = replaced(text, base_spans(text), " ")
                for v in found:
                    yield 1, v
                for w in WORD.findall(rest):
                    yield 0, w

        return common.in_batches(rows(), pa.schema([("label", pa.int32()), ("s", pa.string())]), 4096)

    common.short_batches(docs.sparkSession)
    h = F.xxhash64(F.col(text_col))
    chosen = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), h.alias("h"))
    edge = chosen.select("h").distinct().orderBy("h").limit(texts).agg(F.max("h")).first()[0]
    chosen = chosen.where(F.col("h") <= F.lit(edge if edge is not None else 0)).select("text")
    found = common.written(chosen.mapInArrow(common.tidy(run), "label int, s string").distinct(), "labelled")
    take = lambda label, n: [r.s for r in found.where(F.col("label") == label).orderBy(F.xxhash64("s"), "s").limit(n).select("s").collect()]
    positives, words = take(1, most_values), take(0, most_words)
    common.drop_written(found)
    positives = [v for v in positives if not PLAIN.fullmatch(v)]
    n = max(10_000, len(words) // 4)
    secrets, ordinary = positives + drawn(max(2_000, n)), words + identifiers(words, n)
    mixed = random.Random(5)
    mixed.shuffle(secrets)
    mixed.shuffle(ordinary)
    return fit(secrets, ordinary or ["identifier"])


def find(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the models add."""
    base = base_spans(text)
    more = [("random", m.start(), m.end()) for m in RUN.finditer(text) if model.score(m[0]) > model.threshold]
    return base, [s for s in more if not any(a < s[2] and s[1] < b for _, a, b in base)]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the text with the spans replaced (redacted)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table, threshold = model.table, model.threshold

    def make():
        m = Model(table, threshold)

        def f(row: tuple) -> tuple:
            text = row[1] or ""
            base, more = find(text, m)
            n = [sum(s[0] == k for s in base) for k in KINDS]
            return row[0], *n, digest(base, KINDS), joined(base + more, ALL_KINDS), replaced(text, base + more) if base or more else None

        return f

    schema = {"doc_id": common.arrow_type(own, "doc_id")} | {f"n_{k}": pa.int64() for k in KINDS} | {c: pa.string() for c in ("base_sha256", "spans", "redacted")}
    return common.per_row(own, make, ["doc_id", "text"], schema, f"doc_id {common.ddl_type(own, 'doc_id')}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind; null texts stay null."""
    table, threshold = model.table, model.threshold

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        m = Model(table, threshold)
        return texts.map(lambda t: None if t is None else replaced(t, [s for part in find(t, m) for s in part]))

    common.short_batches(docs.sparkSession)
    return docs.withColumn(text_col, clean(F.col(text_col)))
