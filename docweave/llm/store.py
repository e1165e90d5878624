"""A content-addressed store of token-id streams.

A gear-style rolling hash over 16 ids cuts each document's ids into chunks that depend on content only, so copies share
chunks wherever they start. A chunk's name is a 128-bit BLAKE2b of its ids' bytes; packs of chunks are dealt by name and each
distinct chunk is written once. The file format is three Parquet tables under one folder:

  chunks/    bucket, names (16 bytes each), lens (ids a chunk, <u4), data (zstd of the ids, <u2 or <u4 as in manifest)
  recipes/   part, doc_id, row_id, n_tokens, start, names (16 bytes each, in order), root (Merkle root over them)
  manifest/  part, first_start, n_docs, n_tokens, root (Merkle root over the part's recipes, in order: id, start, size and root), width

Recipes stand in ascending order of doc_id (nulls first; equal ids in the order of their roots), `part` counts the
pieces of that order. Reading back checks every chunk against its name, every recipe against its Merkle root and every
part against the manifest (its root, and that starts and sizes follow on each other without a gap); a mismatch raises
ValueError, in the task that finds it or on the driver.

Null texts count as empty: they hold the end id only. Repeated rows and repeated or null ids are documents of their
own. Texts of any length are encoded whole. An empty table makes a store without documents. Columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pieces import pack, unpack

LEAST, MEAN_BITS, MOST, NAME = 64, 8, 2048, 16
_tokenizers: dict[tuple, tuple] = {}
# The tokenizer's own splitting pattern, and what its classes hold of Latin-1 in lower case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\\x09-\\x0d\\x20\\x85\\xa0"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
#: Words that a Python worker remembers between tasks; beyond it the memory starts anew.
MOST_WORDS = 800_000


def splits_as_known(spec: bytes) -> bool:
    """Whether the tokenizer composes, lowers and splits texts as SPLIT says."""
    d = json.loads(spec)
    steps = [(n["type"], n.get("content")) for n in (d.get("normalizer") or {}).get("normalizers", [])]
    first = ((d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    last = ((d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[-1]
    level = last.get("type"), last.get("add_prefix_space"), last.get("use_regex")
    return steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and first.get("pattern", {}).get("Regex") == SPLIT and level == ("ByteLevel", False, False)


class Known(dict):
    """Ids' bytes by word part; a part that is asked for first goes to the model, in the letters that stand for its bytes."""

    def __init__(self, of_model, code: str) -> None:
        self.of_model, self.code, self.letters = of_model, code, dict(enumerate(byte_letters()))

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.letters)
        out = self[part] = array(self.code, [t.id for t in self.of_model(shown)]).tobytes()
        return out


def word_ids(spec: bytes, width: str):
    """A function from texts to the bytes (of the given width) of their ids.

    White space never joins the words on its sides under this kind of tokenizer (checked in check_spec), so each
    distinct word is encoded by the library once and remembered. A text of Latin-1 characters, which composition leaves
    alone and which holds no special token, is split into the tokenizer's own parts in lower case, so that fewer
    distinct ones are left; these parts need only the library's model, without its normaliser.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = crc32(spec), width
    if key not in _tokenizers:
        tok = Tokenizer.from_str(spec.decode())
        _tokenizers[key] = (tok, Known(tok.model.tokenize, {2: "H", 4: "I"}[np.dtype(width).itemsize]), splits_as_known(spec), [t.content for t in tok.get_added_tokens_decoder().values()])
    tok, known, fast, special = _tokenizers[key]
    code = known.code

    def learn_words(words: list[str]) -> None:
        for w, e in zip(words, tok.encode_batch_fast(words, add_special_tokens=False), strict=True):
            known[w] = array(code, e.ids).tobytes()

    def parts(text: str) -> list[str] | None:
        if not fast or any(x in text for x in special):
            return None
        low = text.lower()
        try:
            low.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(x in low for x in special) else _PARTS.findall(low)

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > MOST_WORDS:
            known.clear()
        out = []
        for t in texts:
            if (words := parts(t)) is None:
                words = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                learn_words(list(set(words).difference(known)))
            out.append(b"".join(map(known.__getitem__, words)))
        return out

    return encode


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: its own Latin-1 character if that shows, else the next from U+0100 on."""
    shows = lambda b: 33 <= b <= 126 or 161 <= b <= 255 and b != 173
    hidden = iter(range(256, 512))
    return [chr(b) if shows(b) else chr(next(hidden)) for b in range(256)]


def check_spec(spec: bytes) -> None:
    """ValueError unless the tokenizer drops white space and keeps the words on its sides apart."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec.decode())
    for text in ("Ab c", "a, B.\n\nc ", "don't x1y 'S", " é́ ç ́x", "Word word, word. straße."):
        if word_ids(spec, "<u4")([text])[0] != np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes():
            raise ValueError("words aren't independent under this tokenizer")


def gear(ids: np.ndarray) -> np.ndarray:
    """A 64-bit number for each id, from splitmix64's finaliser."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of chunks: after an id where the rolling hash of the last 16 ids has MEAN_BITS zero bits on top; chunks hold LEAST to MOST ids (the last may be shorter)."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    h = gear(ids)
    for shift in (1, 2, 4, 8):
        before = np.zeros_like(h)
        before[shift:] = h[:-shift]
        h = h + (before << np.uint64(shift))
    out, last = [], 0
    for at in (np.flatnonzero((h[15:] << np.uint64(32) >> np.uint64(64 - MEAN_BITS)) == 0) + 16).tolist():
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST:
            last = at
            out.append(at)
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out if last == n else [*out, n]


def name_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=NAME).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is; no leaf: the digest of nothing."""
    level = leaves or [name_of(b"")]
    while len(level) > 1:
        level = [name_of(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, spec_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 4_000_000) -> None:
    """Encodes whole texts, appends end_id and writes the three tables under `path`."""
    spark = docs.sparkSession
    with open(spec_path, "rb") as f:
        spec = f.read()
    check_spec(spec)
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_str(spec.decode()).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    step = np.dtype(width).itemsize
    common.short_batches(spark)
    id_arrow, id_ddl = common.arrow_type(docs, id_col), common.ddl_type(docs, id_col)
    # a bucket's names fit in a task's memory at any size, and a block's pack for a bucket still holds a few chunks
    buckets = min(16384, max(16, common.estimated_bytes(docs) >> 23))
    fields = [("bucket", pa.int32()), ("doc_id", id_arrow), ("row_id", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("lens", pa.binary()), ("data", pa.binary()), ("root", pa.binary())]
    ddl = f"bucket int, doc_id {id_ddl}, row_id long, n_tokens long, names binary, lens binary, data binary, root binary"

    def packs(held: dict[bytes, bytes]) -> Iterator[tuple]:
        by: dict[int, list[bytes]] = {}
        for name in held:
            by.setdefault(int.from_bytes(name[:4], "little") % buckets, []).append(name)
        for bucket, names in sorted(by.items()):
            raw = [held[n] for n in names]
            lens = np.array([len(x) for x in raw], dtype="<u4") // step
            yield bucket, None, None, None, b"".join(names), lens.tobytes(), zstandard.compress(b"".join(raw), 1), None

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            numbers, encode, end = common.task_rows(), word_ids(spec, width), end_id.to_bytes(step, "little")
            held: dict[bytes, bytes] = {}
            size = 0
            pairs = ((i, raw) for b in batches for i, raw in zip(b.column("doc_id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()]), strict=True))
            for doc_id, raw in pairs:
                raw += end
                names, last = [], 0
                for at in cuts(np.frombuffer(raw, dtype=width)):
                    chunk = raw[step * last : step * at]
                    names.append(name := name_of(chunk))
                    if name not in held:
                        held[name] = chunk
                        size += at - last
                    last = at
                yield -1, doc_id, next(numbers), len(raw) // step, b"".join(names), None, None, merkle(names)
                if size >= block_ids:
                    yield from packs(held)
                    held, size = {}, 0
            yield from packs(held)

        return common.in_batches(rows(), pa.schema(fields))

    staged = common.written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.tidy(to_chunks), ddl), "staged")

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("lens", pa.binary()), ("data", pa.binary())])

        def rows() -> Iterator[tuple]:
            last, seen = None, set()
            for bucket, names, lens, data in common.rows_of(batches, "sub", "names", "lens", "data"):
                if bucket != last:
                    last, seen = bucket, set()
                sizes, ids = np.frombuffer(lens, dtype="<u4"), unpack(data, width)
                own = [names[i : i + NAME] for i in range(0, len(names), NAME)]
                new = [i for i, n in enumerate(own) if n not in seen]
                seen.update(own)
                if new:
                    ends = np.cumsum(sizes, dtype=np.int64)
                    yield bucket, b"".join(own[i] for i in new), sizes[new].tobytes(), pack(np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in new]))

        return common.in_batches(rows(), schema, 64)

    dealt = staged.where("bucket >= 0").select(F.col("bucket").alias("sub"), "names", "lens", "data").repartition(buckets, "sub").sortWithinPartitions("sub")
    dealt.mapInArrow(common.tidy(unique), "bucket int, names binary, lens binary, data binary").write.option("compression", "none").parquet(f"{path}/chunks")

    ordered = staged.where("bucket < 0").select("doc_id", "row_id", "n_tokens", "names", "root").repartitionByRange(F.col("doc_id").asc_nulls_first(), "root", "row_id").withColumn("part", F.spark_partition_id())
    ordered = common.written(ordered, "ordered")
    common.drop_written(staged)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # a row for each partition of the order: few, and no more than there were tasks
    parts = parts.withColumn("first_start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    own = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("first_start") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))
    ordered.join(parts.select("part", "first_start"), "part").withColumn("start", starts.cast("long")).select("part", "doc_id", "row_id", "n_tokens", "start", "names", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    common.drop_written(ordered)
    parts_now = described_parts(spark.read.parquet(f"{path}/recipes"))
    parts_now.withColumn("width", F.lit(width)).write.parquet(f"{path}/manifest")


def described_parts(recipes: DataFrame) -> DataFrame:
    """(part, first_start, n_docs, n_tokens, root): what the manifest says of each part, from its recipes, read in their order one at a time. ValueError in a task where a recipe doesn't start at the end of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            part, leaves, first, at = None, [], 0, 0
            for p, start, n, doc_id, root in common.rows_of(batches, "part", "start", "n_tokens", "doc_id", "root"):
                if p != part and leaves:
                    yield part, first, len(leaves), at - first, merkle(leaves)
                if p != part:
                    part, leaves, first, at = p, [], start, start
                if start != at:
                    raise ValueError(f"document {doc_id} starts at {start}, the one before it ends at {at}")
                leaves.append(name_of(f"{doc_id} {start} {n} ".encode() + root))
                at += n
            if leaves:
                yield part, first, len(leaves), at - first, merkle(leaves)

        return common.in_batches(rows(), pa.schema([("part", pa.int32()), ("first_start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]))

    own = recipes.select("part", "start", "n_tokens", F.col("doc_id").cast("string").alias("doc_id"), "root")
    return own.repartition("part").sortWithinPartitions("part", "start").mapInArrow(common.tidy(run), "part int, first_start long, n_docs long, n_tokens long, root binary")


def check_manifest(spark: SparkSession, path: str) -> None:
    """ValueError unless the manifest says of every part what its recipes say, and the parts follow on each other from 0."""
    said, now = spark.read.parquet(f"{path}/manifest"), described_parts(spark.read.parquet(f"{path}/recipes"))
    names = [c for c in now.columns if c != "part"]
    both = said.join(now.select("part", *(F.col(c).alias(f"{c}_now") for c in names)), "part", "full")
    # a row for each part: few
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("due", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    wrong = ~F.col("first_start").eqNullSafe(F.col("due"))
    for c in names:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"{c}_now"))
    if bad := both.where(wrong).count():
        raise ValueError(f"{bad} parts don't match the manifest")


def chunk_rows(spark: SparkSession, path: str, width: str) -> DataFrame:
    """(name, n, crc, data): every chunk of the files, its name, size and CRC-32 recomputed from the ids read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for names, lens, data in common.rows_of(batches, "names", "lens", "data"):
                ids = unpack(data, width)
                last = 0
                for i, n in enumerate(np.frombuffer(lens, dtype="<u4").tolist()):
                    own = ids[last : last + n]
                    last += n
                    raw = own.astype("<u4").tobytes()
                    if (name := name_of(own.tobytes())) != names[i * NAME : (i + 1) * NAME]:
                        raise ValueError(f"chunk {name.hex()} isn't what its name says")
                    yield name, n, crc32(raw), raw

        return common.in_batches(rows(), pa.schema([("name", pa.binary()), ("n", pa.int64()), ("crc", pa.int64()), ("data", pa.binary())]), 4096)

    return spark.read.parquet(f"{path}/chunks").select("names", "lens", "data").mapInArrow(common.tidy(run), "name binary, n long, crc long, data binary")


def steps_of(recipes: DataFrame) -> DataFrame:
    """A row for each chunk that a document uses: row_id, seq, name."""
    cut = F.transform(F.sequence(F.lit(0), (F.length("names") / NAME).cast("int") - 1), lambda i: F.col("names").substr(i * NAME + 1, F.lit(NAME)))
    return recipes.select("row_id", F.posexplode(cut).alias("seq", "name"))


def crc_operators(bits: int) -> list[np.ndarray]:
    """For k < bits, what 2^k zero bytes do to a CRC-32: a 32 x 32 matrix over GF(2), as its columns."""
    op = np.array([0xEDB88320, *(1 << i for i in range(31))], dtype=np.uint32)
    out = []
    for k in range(3 + bits):
        if k >= 3:
            out.append(op)
        op = crc_apply(op, op)
    return out


def crc_apply(op: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where(values >> np.uint32(i) & np.uint32(1), op[i], np.uint32(0))
    return out


def crc_joined(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each document from its chunks': every chunk's CRC moved past the bytes that follow it, all joined by xor.

    crcs, sizes (bytes): of chunks, documents one after another; first: where each document's chunks begin.
    """
    ends = np.cumsum(sizes)
    total = np.append(ends[first[1:] - 1], ends[-1])
    after = np.repeat(total, np.diff(np.append(first, len(crcs)))) - ends
    v = crcs.astype(np.uint32)
    for k, op in enumerate(crc_operators(int(after.max(initial=0)).bit_length())):
        on = np.flatnonzero(after >> k & 1)
        v[on] = crc_apply(op, v[on])
    return np.bitwise_xor.reduceat(v, first)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The manifest is checked first. Chunk bytes stay where they are read: a document's CRC-32 is put together from its chunks', and its Merkle root from their recomputed names."""
    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    width = next((r[0] for r in spark.read.parquet(f"{path}/manifest").select("width").limit(1).collect()), "<u4")
    found = chunk_rows(spark, path, width).select("name", "n", "crc")
    id_ddl, id_arrow = common.ddl_type(recipes, "doc_id"), common.arrow_type(recipes, "doc_id")
    heads = recipes.select("row_id", F.lit(-1).alias("seq"), F.lit(None).cast("binary").alias("name"), "n_tokens", F.lit(None).cast("long").alias("crc"), "doc_id", "start", "root")
    none = {"doc_id": F.lit(None).cast(id_ddl), "start": F.lit(None).cast("long"), "root": F.lit(None).cast("binary")}
    steps = steps_of(recipes).join(found, "name", "left").select("row_id", "seq", "name", F.col("n").alias("n_tokens"), "crc", *(c.alias(k) for k, c in none.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", id_arrow), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

        def ended(held: list[tuple]) -> list[tuple]:
            """Rows of documents: held has (head, names, sizes, crcs)."""
            first = np.cumsum([0, *(len(h[1]) for h in held[:-1])])
            sizes = np.array([n for h in held for n in h[2]], dtype=np.int64)
            crcs = crc_joined(np.array([c for h in held for c in h[3]], dtype=np.int64), 4 * sizes, first)
            for (doc_id, _, expected, root), names, own, _ in held:
                if sum(own) != expected or merkle(names) != root:
                    raise ValueError(f"document {doc_id} doesn't match its recipe")
            return [(h[0][0], h[0][1], sum(h[2]), int(c)) for h, c in zip(held, crcs, strict=True)]

        def rows() -> Iterator[tuple]:
            held, n = [], 0
            for seq, name, size, part_crc, doc_id, start, root in common.rows_of(batches, "seq", "name", "n_tokens", "crc", "doc_id", "start", "root"):
                if seq < 0:
                    if n >= 8192:
                        yield from ended(held)
                        held, n = [], 0
                    held.append(((doc_id, start, size, root), [], [], []))
                    continue
                if part_crc is None:
                    raise ValueError(f"chunk {name.hex()} is missing")
                for own, x in zip(held[-1][1:], (name, size, part_crc), strict=True):
                    own.append(x)
                n += 1
            if held:
                yield from ended(held)

        return common.in_batches(rows(), schema, 4096)

    common.short_batches(spark)
    return heads.unionByName(steps).repartition("row_id").sortWithinPartitions("row_id", "seq").mapInArrow(common.tidy(run), f"doc_id {id_ddl}, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids array<int>: the streams themselves, for those who want them."""
    recipes = spark.read.parquet(f"{path}/recipes")
    width = next((r[0] for r in spark.read.parquet(f"{path}/manifest").select("width").limit(1).collect()), "<u4")
    id_ddl, id_arrow = common.ddl_type(recipes, "doc_id"), common.arrow_type(recipes, "doc_id")
    steps = recipes.select("doc_id", "start", "row_id").join(steps_of(recipes), "row_id").join(chunk_rows(spark, path, width).select("name", "data"), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            head, held = None, []
            for row_id, doc_id, start, data in common.rows_of(batches, "row_id", "doc_id", "start", "data"):
                if head and head[0] != row_id:
                    yield *head[1:], np.frombuffer(b"".join(held), dtype="<u4").tolist()
                    held = []
                head = (row_id, doc_id, start)
                held.append(data)
            if head:
                yield *head[1:], np.frombuffer(b"".join(held), dtype="<u4").tolist()

        return common.in_batches(rows(), pa.schema([("doc_id", id_arrow), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))]), 128)

    return steps.repartition("row_id").sortWithinPartitions("row_id", "seq").mapInArrow(common.tidy(run), f"doc_id {id_ddl}, start long, ids array<int>")


def verify(spark: SparkSession, path: str) -> int:
    """Documents checked; ValueError (or a failed task that says so) where files, recipes and manifest disagree."""
    return read_back(spark, path).count()


def new_store(spark: SparkSession) -> str:
    return f"{common.scratch(spark)}/store-{uuid.uuid4().hex}"
