"""SimHash near-dedup with BK-trees, one for each shard; shards are dealt to tasks together with their queries, not broadcast.

Fingerprints: A-Z in lower case, words are runs of other bytes than space and 0x09-0x0D, shingles of `words` words with
their repeats, XXH64 (UTF-8, seed 42); a bit is 1 if set in over half the hashes. Texts with fewer words have one
shingle, the whole sequence; texts without words (null, empty, white space) have fingerprint zero and are linked like
any other.

Links: two distinct fingerprints within `radius` bits share two whole quarters of their 64 bits as long as radius is 2
or less, so each fingerprint goes to six shards, one for each pair of quarters and its 32-bit value. A shard holds a
BK-tree (a child's key is its Hamming distance to its parent) and its fingerprints search it along the edges within
the radius. A shard with more fingerprints than `most_in_tree` is dealt again by thirds of its other 32 bits, one of which
linked fingerprints share. So the trees travel to where their queries are instead of every tree to every task: a
broadcast of all shard trees would grow with the corpus, and searching each would cost its square. A shard gives a
spanning forest of its links, fewer than it has fingerprints, so groups of any size stay linear.

Repeated rows and ids, null ids: each row is fingerprinted for itself; component_id is the smallest non-null doc_id
reachable (null if there is none). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Hashes turned into bits at once, so that memory doesn't grow with a text.
SLICE = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    sizes = np.array([len(w) for w in found], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = (starts + sizes)[min(words, len(found)) - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + SLICE)].tolist(), ends[at : at + SLICE].tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    id_ddl = common.ddl_type(docs, id_col)
    schema = {"doc_id": common.arrow_type(docs, id_col), "fp": pa.int64()}

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    return common.per_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lambda: lambda r: (r[0], signed(fingerprint(r[1], words))), ["doc_id", "text"], schema, f"doc_id {id_ddl}, fp long")


class BKTree:
    """Nodes in insertion order; a child hangs under its parent by their Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            if (down := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = down
        return at

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes at `radius` or less, over edges d-radius..d+radius only."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            below = self.children[at]
            todo.extend(below[k] for k in range(d - radius, d + radius + 1) if k in below)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what is reachable over all links among distinct `values`: one for each join, found in the tree."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((v, values[j]))
        tree.add(v)
    return out


def links(fps: DataFrame, radius: int = 2, most_in_tree: int = 20_000) -> DataFrame:
    """(a, b): links among the distinct fingerprints of fps(fp) that connect what all links within `radius` connect."""
    if not 0 <= radius <= 2:
        raise ValueError("two shared quarters are sure up to a radius of 2")
    quarter = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))
    pairs = [(i, j) for i in range(4) for j in range(i)]
    shard = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (quarter(i) * 65536 + quarter(j)).alias("v")) for k, (i, j) in enumerate(pairs))))
    dealt = fps.select("fp").distinct().select("fp", shard.alias("s")).select("fp", "s.k", "s.v")
    sizes = dealt.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    dealt = common.written(dealt.join(sizes, ["k", "v"]), "shards")  # most shards hold one fingerprint and go

    def thirds(k: int) -> F.Column:
        i, j = (x for x in range(4) if x not in pairs[k])
        rest = quarter(i) * 65536 + quarter(j)
        return F.array(*(F.struct(F.lit(t).alias("t"), F.shiftright(rest, low).bitwiseAND(F.lit((1 << n) - 1).cast("long")).alias("w")) for t, (low, n) in enumerate(((0, 11), (11, 11), (22, 10)))))

    again = F.coalesce(*(F.when(F.col("k") == k, thirds(k)) for k in range(6)))
    small = dealt.where(F.col("n") <= most_in_tree).select("k", "v", F.lit(-1).alias("t"), F.lit(0).cast("long").alias("w"), "fp")
    large = dealt.where(F.col("n") > most_in_tree).select("k", "v", F.explode(again).alias("x"), "fp").select("k", "v", "x.t", "x.w", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, held = None, []
            for *own, fp in common.rows_of(batches, "k", "v", "t", "w", "fp"):
                if own != key and held:
                    yield from found(held)
                    held = []
                key = own
                held.append(fp)
            yield from found(held)

        def found(held: list[int]) -> list[tuple]:
            mask = (1 << 64) - 1
            back = lambda x: x - (1 << 64) if x >> 63 else x
            return [(back(a), back(b)) for a, b in forest([x & mask for x in held], radius)]

        return common.in_batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 4096)

    keys = ["k", "v", "t", "w"]
    return small.unionByName(large).repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(common.tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, fp, component_id."""
    common.short_batches(docs.sparkSession)
    own = common.written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = common.written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = common.components(links(classes, radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    """The columns of op7's contract."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
