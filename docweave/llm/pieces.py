"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece holds a whitespace marker after another character, a merge never crosses from one marked word into the
next, so a text's ids are its marked words' ids one after another. A pass over the texts numbers the distinct words of
each block of documents and keeps every document as those numbers. The words, not the documents, are then dealt by
their hash; each distinct word is segmented once, and its ids go back to the blocks that asked for it, where they are
joined by position. A word that every block holds is one entry a block, so frequent words make no hot key.

A block's name is the hash of its list of words. Where the input is a scan, the texts are read twice, once for the words
and once for the documents' numbers, which is less than writing the numbers out and reading them again; where it isn't
(its plan holds an exchange, so that rows may come in another order when it is computed again), both are written first.
A block whose words didn't arrive raises an error.

Null texts count as empty; empty texts give only the end id; repeated rows and repeated or null document ids are
encoded each for itself; a text of any length is encoded whole (one longer than `block_chars` is a block of its own);
an empty table gives an empty result. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
_CHUNK = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_loaded: dict[int, sentencepiece.SentencePieceProcessor] = {}


def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """One model a Python worker; the bytes travel with the task, so executors need no file."""
    key = crc32(model)
    if key not in _loaded:
        _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _loaded[key]


def check_model(model: bytes) -> None:
    """ValueError unless this model's words can be segmented apart from each other."""
    sp = processor(model)
    if any(re.search(f"[^{MARK}]{MARK}|\n", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("pieces cross whitespace markers or line ends")
    probe = "a  b \n c "
    if sp.decode(sp.encode(probe)) != probe or sp.encode("\n\nab") != [*sp.encode("\n"), *segment(sp, "\n"), *segment(sp, "ab")]:
        raise ValueError("the model normalises its input")


def segment(sp: sentencepiece.SentencePieceProcessor, word: str) -> list[int]:
    """A chunk's ids as inside a text: the line end before it takes the leading marker that the library adds."""
    return sp.encode("\n" + word.replace(MARK, " "))[2:]


def chunks(text: str) -> list[str]:
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype=dtype)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(len(words).to_bytes(4, "little") + np.array([len(w) for w in words], dtype="<u4").tobytes() + b"".join(words), 1)


def unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, dtype="<u4", offset=4, count=n), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def pack_places(at: np.ndarray) -> bytes:
    """Ascending numbers, as their steps."""
    return pack(np.diff(at, prepend=0).astype("<u4"))


def unpack_places(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "<u4"), dtype=np.int64)


def pack_seqs(seqs: list[list[int]], fresh: int) -> bytes:
    """Word numbers of documents. `fresh` numbers were given before; a number given just here is written as 0, others plus 1, in planes of bytes."""
    flat = np.array([x for s in seqs for x in s], dtype=np.int64)
    top = np.maximum.accumulate(np.concatenate([[fresh - 1], flat]))
    coded = np.where(flat > top[:-1], 0, flat + 1).astype("<u4")
    head = np.array([len(seqs), fresh, *map(len, seqs)], dtype="<u4").tobytes()
    return zstandard.compress(head + coded.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_seqs(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, fresh = np.frombuffer(raw, dtype="<u4", count=2).tolist()
    lens = np.frombuffer(raw, dtype="<u4", offset=8, count=n).astype(np.int64)
    planes = np.frombuffer(raw, dtype=np.uint8, offset=8 + 4 * n).reshape(4, -1)
    coded = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    flat = np.where(coded == 0, fresh - 1 + np.cumsum(coded == 0), coded - 1)
    return np.split(flat, np.cumsum(lens)[:-1])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """A row a document: doc_id, ids array<int> (the end id last), decoded string (the library's decode of those ids)."""
    with open(model_path, "rb") as f:
        model = f.read()
    check_model(model)
    width = "<u2" if processor(model).get_piece_size() <= 1 << 16 else "<u4"
    common.short_batches(docs.sparkSession)
    id_arrow, id_ddl = common.arrow_type(docs, id_col), common.ddl_type(docs, id_col)
    row_schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_ids", pa.list_(id_arrow)), ("a", pa.binary()), ("b", pa.binary())])
    row_ddl = f"block long, kind int, doc_ids array<{id_ddl}>, a binary, b binary"

    def to_blocks(want: tuple[int, ...]):
        """Blocks' rows of the kinds wanted: 0, the words; 1, documents as numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                known, held, ids, seqs, size, fresh = {}, [], [], [], 0, 0

                def ended() -> Iterator[tuple]:
                    words = [w.encode() for w in known]
                    name = xxhash.xxh3_64_intdigest(b"\0".join(words)) - (1 << 63)
                    if 0 in want and words:
                        yield name, 0, None, pack_words(words), None
                    for x, blob in held:
                        yield name, 1, x, blob, None

                for doc_id, text in common.rows_of(batches, "doc_id", "text"):
                    full = size and size + len(text or "") > block_chars
                    if seqs and (full or len(seqs) == 64):
                        held.append((ids, pack_seqs(seqs, fresh)))
                        ids, seqs, fresh = [], [], len(known)
                    if full:
                        yield from ended()
                        known, held, size, fresh = {}, [], 0, 0
                    found = [known.setdefault(w, len(known)) for w in chunks(text or "")]
                    size += len(text or "")
                    if 1 in want:
                        ids.append(doc_id)
                        seqs.append(found)
                if seqs:
                    held.append((ids, pack_seqs(seqs, fresh)))
                yield from ended()

            return common.in_batches(rows(), row_schema)

        return run

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if "Exchange" in given._jdf.queryExecution().executedPlan().toString():
        both = common.written(given.mapInArrow(common.tidy(to_blocks((0, 1))), row_ddl), "blocks")
        words, numbered = both.where("kind = 0").select("block", "a"), both.where("kind = 1")
    else:
        words, numbered = (given.mapInArrow(common.tidy(to_blocks((k,))), row_ddl) for k in (0, 1))
    buckets = min(4096, max(16, common.estimated_bytes(docs) >> 24))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("words", pa.binary())])

        def rows() -> Iterator[tuple]:
            for block, blob in common.rows_of(batches, "block", "a"):
                known = unpack_words(blob)
                to = np.array([crc32(w) % buckets for w in known])
                order = np.argsort(to, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    yield int(to[at[0]]), block, pack_places(at), pack_words([known[i] for i in at])

        return common.in_batches(rows(), schema)

    def segment_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            sp, last, known = processor(model), None, {}
            for bucket, block, at, blob in common.rows_of(batches, "bucket", "block", "at", "words"):
                if bucket != last:
                    last, known = bucket, {}
                found = []
                for w in unpack_words(blob):
                    if (ids := known.get(w)) is None:
                        ids = known[w] = np.array(segment(sp, w.decode()), dtype=width).tobytes()
                    found.append(ids)
                yield block, 0, None, at, pack_words(found)

        return common.in_batches(rows(), row_schema)

    dealt = words.select("block", "a").mapInArrow(common.tidy(deal), "bucket int, block long, at binary, words binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    asked = dealt.mapInArrow(common.tidy(segment_all), row_ddl)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", id_arrow), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

        def rows() -> Iterator[tuple]:
            sp, last, parts, flat = processor(model), None, [], None
            for block, kind, doc_ids, a, b in common.rows_of(batches, "block", "kind", "doc_ids", "a", "b"):
                if block != last:
                    last, parts, flat = block, [], None
                if kind == 0:
                    parts.append((unpack_places(a), unpack_words(b)))
                    continue
                if flat is None:
                    if not parts and any(map(len, unpack_seqs(a))):
                        raise ValueError("the input's rows came in another order when read again")
                    flat, starts, lens = by_position(parts, width)
                    parts = []
                for doc_id, seq in zip(doc_ids, unpack_seqs(a), strict=True):
                    n = lens[seq]
                    at = np.repeat(starts[seq] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    found = [*flat[at].tolist(), sp.eos_id()]
                    yield doc_id, found, sp.decode(found)

        return common.in_batches(rows(), schema, 128)

    together = numbered.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    return together.mapInArrow(common.tidy(join_up), f"doc_id {id_ddl}, ids array<int>, decoded string")


def by_position(parts: list[tuple[np.ndarray, list[bytes]]], width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's word ids end to end, and where each word's ids start and how many they are, by the block's numbers."""
    at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    blobs = [w for p in parts for w in p[1]]
    flat = np.frombuffer(b"".join(blobs), dtype=width)
    n = np.array([len(w) for w in blobs], dtype=np.int64) // np.dtype(width).itemsize
    starts, lens = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    starts[at], lens[at] = np.cumsum(n) - n, n
    return flat, starts, lens


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of op4's contract from encode()'s rows."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
