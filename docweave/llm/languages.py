"""Language identification by hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, drawn from a hash of its code point. An
n-gram's vector binds its letters' vectors, each permuted by its place (rotated), by componentwise product. A document
bundles (sums) its n-grams' vectors; a language's prototype bundles those of its training documents, each document's
bundle scaled to unit length so that long ones don't rule, and the mean of all prototypes is taken off what is compared.
The answer is the language whose prototype has the largest cosine with the document.

Null texts and texts without a letter get `und` and score 0; ties go to the language first by code point. Null labels
don't teach. Without any labelled row every answer is `und`. Repeated rows and ids are rows of their own. A long text
is counted in slices, whole. Columns other than id, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM, GRAM = 1024, 3
SLICE = 1 << 18
#: n-gram vectors that a Python worker remembers; beyond it the memory starts anew.
MOST_GRAMS = 16_000


class Space:
    """Letters' and n-grams' vectors, made when first met."""

    def __init__(self) -> None:
        self.low = None
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((1024, DIM), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = (np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1)
        return self.letters[code]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of n-grams, given as 21 bits a code point."""
        if len(self.rows) + len(ids) > MOST_GRAMS:
            self.rows, self.vectors = {}, np.zeros((1024, DIM), dtype=np.int8)
        at = np.empty(len(ids), dtype=np.int64)
        for i, g in enumerate(ids.tolist()):
            if (row := self.rows.get(g)) is None:
                row = self.rows[g] = len(self.rows)
                if row >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                v = np.ones(DIM, dtype=np.int8)
                for place in range(GRAM):
                    v *= np.roll(self.letter(g >> 21 * place & 0x1FFFFF), place)
                self.vectors[row] = v
            at[i] = row
        return self.vectors[at].astype(np.float32)


_space = Space()


def letters_only(text: str) -> np.ndarray:
    """Code points of the letters in lower case, 32 for every run of anything else, and at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if _space.low is None:
        _space.low = np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)
    codes = np.concatenate([[32], np.where(_space.low[codes], codes, 32), [32]]).astype(np.int64)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct n-grams and how often each occurs."""
    codes = letters_only(text or "")
    if len(codes) < GRAM:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    parts = []
    for at in range(0, len(codes) - GRAM + 1, SLICE):
        c = codes[at : at + SLICE + GRAM - 1]
        g = sum(c[i : len(c) - GRAM + 1 + i] << 21 * i for i in range(GRAM))
        parts.append(np.unique(g, return_counts=True))
    if len(parts) == 1:
        return parts[0]
    ids, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def bundled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and which of them have any letter."""
    each = [counted(t) for t in texts]
    some = np.array([len(c) > 0 for _, c in each], dtype=bool)
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for start in range(0, len(each), 32):
        part = each[start : start + 32]
        if not any(len(g) for g, _ in part):
            continue
        ids, back = np.unique(np.concatenate([g for g, _ in part]), return_inverse=True)
        last = 0
        weights = np.zeros((len(part), len(ids)), dtype=np.float32)
        for i, (g, c) in enumerate(part):
            weights[i, back[last : last + len(g)]] = c
            last += len(g)
        for at in range(0, len(ids), 16_384):
            out[start : start + len(part)] += weights[:, at : at + 16_384] @ _space.grams(ids[at : at + 16_384])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm), some


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict[str, list[float]]:
    """A prototype for each label. Tasks send one summed vector a label; the driver gets one a label."""
    common.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            vectors, _ = bundled(batch.column("text").to_pylist())
            for label in set(labels):
                sums[label] = sums.get(label, 0) + vectors[[x == label for x in labels]].sum(0, dtype=np.float64)
        yield from common.in_batches(((k, i, float(x)) for k, v in sums.items() for i, x in enumerate(v)), pa.schema([("label", pa.string()), ("i", pa.int32()), ("x", pa.float64())]), 4096)

    rows = docs.where(F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    # components are rounded to 2^-20 and summed as integers, so that the order of tasks doesn't show
    summed = rows.mapInArrow(common.tidy(run), "label string, i int, x double").groupBy("label", "i").agg(F.sum(F.round(F.col("x") * 1048576).cast("long")).alias("x"))
    out: dict[str, np.ndarray] = {}
    for label, i, x in summed.collect():
        out.setdefault(label, np.zeros(DIM))[i] = x
    return {k: (v / (np.linalg.norm(v) or 1)).tolist() for k, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred, score (share of the cosines' spread: 1 at the prototype itself, 0 if unlike any), fit (the plain cosine)."""
    names = sorted(prototypes)
    profiles = np.array([prototypes[k] for k in names]) if names else np.zeros((0, DIM))
    middle = profiles.mean(0) if len(names) > 1 else np.zeros(DIM)
    centred = profiles - middle
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    common.short_batches(docs.sparkSession)
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    if text_col not in keep:
        cols.append(F.col(text_col).alias("text"))
    place = keep.index(text_col) if text_col in keep else len(keep)
    schema = pa.schema([(f"k{i}", common.arrow_type(docs, c)) for i, c in enumerate(keep)] + [("lang_pred", pa.string()), ("score", pa.float64()), ("fit", pa.float64())])
    ddl = ", ".join([f"k{i} {common.ddl_type(docs, c)}" for i, c in enumerate(keep)] + ["lang_pred string, score double, fit double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, some = bundled(batch.column(place).to_pylist())
            if names:
                apart = vectors - middle
                apart /= np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)
                cosines = np.round(apart @ centred.T, 9)
                best = cosines.argmax(1)
                fit = (vectors @ profiles.T)[np.arange(len(best)), best]
                score = np.clip((cosines.max(1) + 1) / 2, 0, 1)
            else:
                some, best, fit, score = some & False, np.zeros(len(some), dtype=int), np.zeros(len(some)), np.zeros(len(some))
            pred = [names[b] if s else "und" for b, s in zip(best, some, strict=True)]
            own = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pred), pa.array(np.where(some, score, 0.0)), pa.array(np.where(some, np.clip(fit, 0, 1), 0.0))], schema=schema)

    rows = docs.select(*cols).mapInArrow(common.tidy(run), ddl)
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "fit")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
