"""Near copies: SimHash fingerprints of five-word shingles, BK-trees in shards, then the shingles' exact similarity.

A text's set: the XXH64 hashes (seed 42) of its shingles, words and case as in simhash.py, repeats left out; texts with
fewer words have one shingle, texts without words (null, empty, white space) the empty set. Two texts are linked if
the Jaccard similarity of their sets is `least` or more; groups are what links connect.

Fingerprints: every set's SimHash of BITS bits (a shingle's 64 bits, mixed anew for each 64 of them; a bit is 1 if set in over
half the shingles). The radius reaches a similarity of 0.8: two such sets differ in a bit with a probability of 0.1875 at
most (4 shingles and one more; 0.152 for long texts), so in more than RADIUS of 256 bits with one below 1e-6 (1e-13 for
long texts); unrelated sets are within it with one of 1e-9. Links come from BK-trees of these fingerprints alone: what a
tree finds within the radius is checked exactly, nothing passes beside it.

Shards: at such a radius fingerprints share no whole part for sure, as the quarters of simhash.py do up to 2 bits, so shards
are dealt by BANDS band hashes of ROWS MinHashes each. Sets of similarity s share none with probability
(1 - s**ROWS)**BANDS: below 5e-7 at 0.8, less above. No cell is capped: a cell ties its sets to its smallest, and a tie of up
to BLOCK sets is one shard with one tree. A larger tie is dealt to shards of that size, each of which also gets the tie's
smallest set, its hub, so that what is like the hub is one class whatever its shard; each set that isn't in the hub's class
then searches the trees of the other shards in which it shares a cell. So no group is gathered in one task, trees travel to
where their queries are, and classes are still those of all pairs that share a cell.

Equal sets count once. Texts move only for sets that share a cell; a Bloom filter of fixed size picks them, a join settles it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import SEED, BKTree

WORDS, LEAST = 5, 0.8
#: Bits of a fingerprint, and of them how many linked sets may differ in.
BITS, RADIUS = 256, 80
#: Sets of a tie that one tree holds.
BLOCK = 256
ROWS, BANDS = 6, 48
#: Multipliers of the MinHashes, odd, and what is mixed in before; fixed.
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS), dtype=np.uint64)
_ODD, _XOR = _MIX[0] * np.uint64(2) + np.uint64(1), _MIX[1]
#: Shingles mixed at once, so that memory doesn't grow with a text.
SLICE = 1024
#: Bits of the Bloom filter: 4 MB, whatever the corpus holds.
BLOOM_BITS = 1 << 25


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The text's distinct shingle hashes, sorted."""
    found = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words]), SEED) for i in range(max(1, len(found) - words + 1) if found else 0)), dtype=np.uint64))


def cells(found: np.ndarray) -> list[int]:
    """The set's band hashes, one for each band; sets that share one are candidates."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), SLICE):
        x = (found[at : at + SLICE, None] ^ _XOR) * _ODD
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
    return [xxhash.xxh3_64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprint(found: np.ndarray) -> bytes:
    """The set's SimHash: bit b of word k is 1 if set in over half the shingles' hashes, mixed (splitmix64) for the k-th time."""
    counts, nth = np.zeros(BITS, dtype=np.int64), np.arange(1, BITS // 64 + 1, dtype=np.uint64)
    for at in range(0, len(found), SLICE):
        x = found[at : at + SLICE, None] + nth * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)  # SLICE fits
    return np.packbits((counts * 2 > len(found)).astype(np.uint8), bitorder="little").tobytes()


class Shard:
    """Sets under a BK-tree of their fingerprints."""

    def __init__(self, radius: int = RADIUS) -> None:
        self.radius, self.tree = radius, BKTree()
        self.sets: list[np.ndarray] = []
        self.under: list[list[int]] = []  # a node's sets: those of one fingerprint

    def add(self, found: np.ndarray, fp: bytes) -> None:
        node = self.tree.add(int.from_bytes(fp, "little"))
        if node == len(self.under):
            self.under.append([])
        self.under[node].append(len(self.sets))
        self.sets.append(found)

    def near(self, fp: bytes) -> Iterator[int]:
        """Numbers of the sets whose fingerprints are within the radius of fp."""
        for node in self.tree.within(int.from_bytes(fp, "little"), self.radius):
            yield from self.under[node]


def linked(sets: list[np.ndarray], least: float = LEAST, radius: int = RADIUS, prints: list[bytes] | None = None) -> list[tuple[int, int]]:
    """Links (numbers in `sets`) that connect what all pairs within the radius and of similarity `least` or more connect: one for each join."""
    shard, root, out = Shard(radius), list(range(len(sets))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (found, fp) in enumerate(zip(sets, prints or map(fingerprint, sets), strict=True)):
        for j in shard.near(fp):
            if (a := top(i)) != (b := top(j)) and similarity(found, sets[j]) >= least:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
        shard.add(found, fp)
    return out


def bloom_places(h: F.Column) -> list[F.Column]:
    return [F.shiftrightunsigned(h, 13 * i).bitwiseAND(F.lit(BLOOM_BITS - 1).cast("long")) for i in range(4)]


def bloom(hashes: DataFrame) -> np.ndarray:
    """Which bits hashes(h long, evenly spread) set; no more than BLOOM_BITS / 32 rows reach the driver."""
    out = np.zeros(BLOOM_BITS // 32, dtype=np.uint32)
    place = hashes.select(F.explode(F.array(*bloom_places(F.col("h")))).alias("p"))
    found = place.groupBy(F.shiftright("p", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits")).toArrow()
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def perhaps(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows(..., h) whose h the filter may hold."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            h = batch.column("h").to_numpy().astype(np.int64).view(np.uint64)
            places = [(h >> np.uint64(13 * i)) & np.uint64(BLOOM_BITS - 1) for i in range(4)]
            ok = np.logical_and.reduce([(bits[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & 1 == 1 for p in places])
            yield batch.filter(pa.array(ok))

    return rows.mapInArrow(common.tidy(run), rows.schema)


def near_copies(docs: DataFrame, least: float = LEAST, id_col: str = "row_key", text_col: str = "text", block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """A row a document: doc_id (id_col's value), component_id (the smallest id of its group). RADIUS is that of a `least` of 0.8."""
    spark = docs.sparkSession
    common.short_batches(spark)
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    key = common.ddl_type(docs, id_col)
    schema = {"doc_id": common.arrow_type(docs, id_col), "h": pa.int64(), "set_id": pa.int64(), "fp": pa.binary(), "cells": pa.list_(pa.int64())}

    def read(r: tuple) -> tuple:
        found = shingles(r[2])
        return r[0], r[1], xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63), fingerprint(found), cells(found)

    own = common.written(common.per_row(given, lambda: read, ["doc_id", "h", "text"], schema, f"doc_id {key}, h long, set_id long, fp binary, cells array<long>"), "sets")
    classes = common.written(own.groupBy("set_id").agg(F.min(F.struct("doc_id", "h")).alias("x"), F.first("fp").alias("fp"), F.first("cells").alias("cells")).select("set_id", F.col("x.doc_id").alias("first"), F.col("x.h").alias("h"), "fp", "cells"), "classes")
    dealt = classes.select("set_id", F.explode("cells").alias("v"))
    hubs = dealt.groupBy("v").agg(F.min("set_id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("v", "hub")
    tied = common.components(dealt.join(hubs, "v").where("set_id <> hub").select(F.col("set_id").alias("a"), F.col("hub").alias("b")).distinct())
    tied = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    sizes = tied.groupBy(F.col("root").alias("tie")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = classes.join(tied, F.col("set_id") == F.col("node")).join(sizes, F.col("root") == F.col("tie"))
    members = members.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    members = common.written(members.select("set_id", "first", "h", "fp", "tie", "blocks", "block", F.when(F.col("blocks") > 1, F.col("cells")).alias("cells")), "members")

    def texts_of(some: DataFrame) -> DataFrame:
        """some(set_id, first, h, fp, ...) with the text of each set's first document."""
        found = perhaps(given, bloom(some.select("h").distinct())).select("doc_id", "text")
        return found.join(some.drop("h"), F.col("doc_id") == F.col("first")).drop("doc_id", "first")

    everywhere = F.when((F.col("set_id") == F.col("tie")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    placed = texts_of(members.drop("cells")).withColumn("block", F.explode(everywhere)).select("tie", "block", "set_id", "fp", "text")
    links = common.written(placed.repartition("tie", "block").sortWithinPartitions("tie", "block", "set_id").mapInArrow(common.tidy(_within(least, radius)), "a long, b long"), "links")
    roots = common.components(links)
    large = members.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_across(large, roots, texts_of, least, radius))
        roots = common.components(links)
    rooted = classes.select("set_id", "first").join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "first", F.coalesce("root", "set_id").alias("root"))
    group = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.select("doc_id", "set_id").join(rooted.join(group, "root").select("set_id", "component_id"), "set_id").select("doc_id", "component_id")


def _within(least: float, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within each block of rows(tie, block, set_id, fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, held = None, {}
            for *own, set_id, fp, text in common.rows_of(batches, "tie", "block", "set_id", "fp", "text"):
                if own != now and held:
                    yield from found(held)
                    held = {}
                now = own
                if set_id not in held:  # rows with one id may come twice
                    held[set_id] = shingles(text), fp
            yield from found(held)

        def found(held: dict[int, tuple[np.ndarray, bytes]]) -> list[tuple]:
            ids, (sets, prints) = list(held), zip(*held.values(), strict=True) if held else ((), ())
            return [(ids[i], ids[j]) for i, j in linked(sets, least, radius, prints)]

        return common.in_batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 4096)

    return run


def _across(large: DataFrame, roots: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float, radius: int) -> DataFrame:
    """(a, b): links between blocks of one tie. Members of the hub's class are connected already; each of the others searches the trees of the blocks in which it shares a cell."""
    root = roots.select(F.col("node").alias("set_id"), "root")
    known = large.join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    of_hub = known.where("set_id = tie").select("tie", F.col("root").alias("hub_root"))
    known = common.written(known.join(of_hub, "tie"), "known")
    rest = known.where("root <> hub_root")
    where = known.select("tie", "block", F.explode("cells").alias("v")).distinct()
    asks = rest.select("tie", "set_id", F.col("block").alias("own"), F.explode("cells").alias("v")).join(where, ["tie", "v"]).where("own <> block").select("tie", "set_id", "block").distinct()
    asks = common.written(asks, "asks")
    told = texts_of(known.select("set_id", "first", "h", "fp").join(asks.select("set_id").distinct(), "set_id")).select(F.col("set_id").alias("s"), "fp", "text")
    queries = asks.join(known.select("set_id", "root"), "set_id").join(told, F.col("set_id") == F.col("s")).select("tie", "block", F.lit(1).alias("kind"), "set_id", "root", "fp", "text")
    held = texts_of(known.select("tie", "block", "set_id", "first", "h", "fp", "root").join(asks.select("tie", "block").distinct(), ["tie", "block"])).select("tie", "block", F.lit(0).alias("kind"), "set_id", "root", "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, ids, owners, shard = None, [], [], Shard(radius)
            for tie, block, kind, set_id, owner, fp, text in common.rows_of(batches, "tie", "block", "kind", "set_id", "root", "fp", "text"):
                if (tie, block) != now:
                    now, ids, owners, shard = (tie, block), [], [], Shard(radius)
                found = shingles(text)
                if kind == 0:
                    if not ids or ids[-1] != set_id:
                        shard.add(found, fp)
                        ids.append(set_id)
                        owners.append(owner)
                    continue
                seen = {owner}
                for i in shard.near(fp):
                    if owners[i] not in seen and similarity(found, shard.sets[i]) >= least:
                        seen.add(owners[i])  # one link for each class that it joins
                        yield set_id, ids[i]

        return common.in_batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 4096)

    together = held.unionByName(queries).repartition("tie", "block").sortWithinPartitions("tie", "block", "kind", "set_id")
    return together.mapInArrow(common.tidy(run), "a long, b long")
