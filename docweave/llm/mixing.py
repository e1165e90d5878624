"""Mixing sources to target weights by the cube method.

A source's target is its share by weight of `total` times all sizes, at most `most` times its own size, the excess
shared again by weight until no source is above. Each document of a source is wanted target/size times on average: its
whole part is taken outright, its fraction is an inclusion probability. The cube method's flight moves a few units'
probabilities at a time along a direction in which the source's token total and document total stay the same, until
units arrive at 0 or 1; at most two units with fractions are left, and landing rounds them so that the token total ends
nearest the target (where that leaves it further than `slack` of the target away, it also changes up to twelve decided
units). Draws come from a generator seeded by the source, the block and the round, a new number for every step.

Flights run in blocks of at most `block` documents side by side, whatever a source holds; the few units that a block
leaves go on to the next round with those of other blocks of their source, until a source has one block. All choices
come from hashes of ids, so reruns agree.

Sizes are words ([^\\x20\\x09-\\x0D]+), zero for null texts. Sources stand by code point, null is a source of its own and
last. Sources without words have target 0. Repeated rows and ids are documents of their own, null ids too. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame, text_col: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from sizes(source, size). One row a source; windows run over sources, not documents.

    Sources are filled in the order of cap by weight: with the first k at their cap, the rest share what is left by
    weight; k is the least at which none of the rest is above its cap.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("level", (total * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return by.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("w"))).select("source", "source_size", "target")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but at most two (tokens and documents stay as they were).

    Every step draws a number of its own and is 0 on average, so each unit's probability is a martingale: it ends at 1
    as often as its inclusion probability says.
    """
    scale = max(1.0, float(size.max(initial=0)))
    p, size, eps = p.tolist(), (size / scale).tolist(), 1e-9
    live: list[int] = []
    for nxt in range(len(p)):
        if eps < p[nxt] < 1 - eps:
            live.append(nxt)
        while len(live) > 2:
            a, b, c = live[:3]
            # a direction with sum(u) = 0 and sum(u * size) = 0
            x, y, z = size[a], size[b], size[c]
            u = (y - z, z - x, x - y)
            if max(map(abs, u)) <= 1e-15:
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for i, k in zip((a, b, c), u, strict=True):
                if k:
                    to_one, to_zero = (1 - p[i]) / abs(k), p[i] / abs(k)
                    up, down = min(up, to_one if k > 0 else to_zero), min(down, to_zero if k > 0 else to_one)
            step = up if rng.random() * (up + down) < down else -down
            for i, k in zip((a, b, c), u, strict=True):
                q = p[i] + step * k
                p[i] = 0.0 if q < eps else 1.0 if q > 1 - eps else q
            live = [i for i in live if eps < p[i] < 1 - eps]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray, wanted: float, slack: float = 0.0, around: int = 12) -> np.ndarray:
    """Rounds the units with fractions, at most two, so that the sizes taken sum to what is nearest `wanted`.

    Only if that is more than `slack` away, `around` decided units, spread over the sizes, may change too; of what is
    equally near, the change that moves the number of documents least, then the fewest units, is taken.
    """
    is_open = (p > 0) & (p < 1)
    others = np.flatnonzero(~is_open)
    others = others[np.lexsort((others, size[others]))]
    if len(others) > around:
        others = others[np.linspace(0, len(others) - 1, around).astype(int)]
    for at in (np.flatnonzero(is_open), np.concatenate([np.flatnonzero(is_open), others])):
        bits = (np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1).astype(float)
        rest = np.ones(len(p), dtype=bool)
        rest[at] = False
        off = np.abs(bits @ size[at] + p[rest] @ size[rest] - wanted)
        best = np.lexsort((np.abs(bits - p[at]).sum(1), np.abs(bits.sum(1) - p[at].sum()), off.round(6)))[0]
        if off[best] <= slack:
            break
    p = p.copy()
    p[at] = bits[best]
    return p


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, block: int = 4096, slack: float = 0.001, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, row_id (its row in `docs` as written), size, source_size, target, copies (0 to 2), taken (copies * size)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), sized(docs, text_col).alias("size"))
    return mix_sized(own, weights, total, most, block, slack)


def mix_sized(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, block: int = 4096, slack: float = 0.001) -> DataFrame:
    """mix() over sizes(doc_id, source, size); further columns stay."""
    common.short_batches(sizes.sparkSession)
    # how often rows that are alike came before: makes repeated rows differ
    alike = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    own = common.written(sizes.withColumn("nth", F.row_number().over(alike)), "sizes")
    goals = targets(own.select("source", "size"), weights, total, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = common.written(goals.withColumn("ratio", ratio).withColumn("whole", F.least(F.floor(F.col("ratio") + 1e-12), F.lit(int(most))).cast("long")), "goals")
    units = own.join(F.broadcast(goals) if goals.count() <= 100_000 else goals, own.source.eqNullSafe(goals.source)).select(*(own[c] for c in own.columns), "source_size", "target", "ratio", "whole")
    units = units.withColumn("key", F.xxhash64("doc_id", "size", "nth")).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole"))).otherwise(F.lit(0.0)))
    live = common.written(units.select("source", "doc_id", "nth", "size", "key", "p", (F.col("target") - F.col("whole") * F.col("source_size")).alias("wanted")), "live")
    taken_parts, flown = [], live.where("p <= 1e-9 or p >= 1 - 1e-9").select("source", "doc_id", "nth", "size", F.round("p").cast("long").alias("more"))
    taken_parts.append(flown)
    live = live.where("p > 1e-9 and p < 1 - 1e-9")
    taken: DataFrame | None = None
    for round_no in range(1, 64):
        counts = live.groupBy("source").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).select(F.col("source").alias("s"), "blocks")
        dealt = live.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", F.pmod(F.xxhash64("key", F.lit(round_no)), "blocks"))
        out = common.written(_fly(dealt, round_no, slack), "flown")
        last = not out.where("blocks > 1").limit(1).count()
        done = out if last else out.where("p = 0 or p = 1")
        taken_parts.append(done.select("source", "doc_id", "nth", "size", F.col("p").cast("long").alias("more")))
        if last:
            break
        if round_no == 63:
            raise RuntimeError("flights didn't end in 63 rounds")
        fixed = out.where("p = 1").groupBy("source").agg(F.sum("size").alias("gone")).withColumnRenamed("source", "s")
        rest = out.where("p > 0 and p < 1").join(fixed, F.col("source").eqNullSafe(F.col("s")), "left")
        live = common.written(rest.select("source", "doc_id", "nth", "size", "key", "p", (F.col("wanted") - F.coalesce("gone", F.lit(0))).alias("wanted")), "live")
    taken = taken_parts[0]
    for more in taken_parts[1:]:
        taken = taken.unionByName(more)
    taken = taken.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("nth").alias("k"), F.col("size").alias("z"), "more")
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("nth") == F.col("k")) & (F.col("size") == F.col("z"))
    joined = units.join(taken, same).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0)).cast("long"))
    return joined.select(*sizes.columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _fly(dealt: DataFrame, round_no: int, slack: float) -> DataFrame:
    cols = ["source", "doc_id", "nth", "size", "key", "p", "wanted", "blocks", "part"]
    names = ["source", "doc_id", "nth", "size", "key", "p", "wanted", "blocks"]
    schema = pa.schema([(c, common.arrow_type(dealt, c)) for c in names])
    ddl = ", ".join(f"{c} {common.ddl_type(dealt, c)}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, held = None, []
            for r in common.rows_of(batches, *cols):
                if (r[0], r[8]) != key and held:
                    yield from settled(held)
                    held = []
                key = (r[0], r[8])
                held.append(r)
            if held:
                yield from settled(held)

        def settled(held: list[tuple]) -> Iterator[tuple]:
            source, *_, wanted, blocks, part = held[0]
            size = np.array([r[3] for r in held], dtype=float)
            rng = np.random.Generator(np.random.PCG64(crc32(f"{source!r} {part} {round_no}".encode())))
            p = flight(np.array([r[5] for r in held], dtype=float), size, rng)
            if blocks == 1:
                p = landing(p, size, wanted, slack * abs(wanted))
            for r, x in zip(held, p.tolist(), strict=True):
                yield *r[:5], x, *r[6:8]

        return common.in_batches(rows(), schema, 4096)

    return dealt.select(*cols).repartition("source", "part").sortWithinPartitions("source", "part", "key", "doc_id", "nth").mapInArrow(common.tidy(run), ddl)
