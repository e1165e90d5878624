"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver on at most `sample` distinct vectors (those of smallest hash) and has at most a few times
sample / leaf_size leaves. A query walks the tree with a priority queue: the
node under which the nearest leaf may lie (by the angles to its centre and from there to its leaves) is opened next,
whatever branch it is on, and leaves come out in the order of their visit. A vector is held by the leaf it would visit
first.
How many leaves queries visit is calibrated: the exact neighbours of at most `calibrate` queries, from a scan of all
vectors in blocks, show after how many leaves each would have been found; visits widen, separately for queries near to
and far from their first leaf, until `recall` of them would have been.

Leaves are small, so that few vectors beside the near ones are compared, and travel in buckets of leaves that are
neighbours in the tree: a query goes once to each bucket, with the list of its leaves there. Equal vectors are one entry
with their k + 1 rows of smallest ids, as no more of them can be in an answer, so copies make no hot leaf; a bucket with
many different vectors is cut into blocks, each of which sees all queries of the bucket. Queries stream past a block's
vectors, so memory holds one block and one batch.

Scores are the cosine in double precision of the vectors as given; ties go to the smaller id. Null, empty and zero
vectors and those with null or non-finite components take no part, nor do rows without an id, as an answer couldn't name
them. Vectors of different lengths have no cosine; each length is searched by itself. A repeated row is a row of its own,
as query and as candidate. With fewer than k others a query gets them all; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a block, and leaves of a bucket.
BLOCK, BUCKET = 4096, 64


class Tree:
    """Centres of all nodes, their children, and numbers of the leaves among them."""

    def __init__(self, sample: np.ndarray, branch: int = 8, leaf_size: int = 16, rounds: int = 8, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        middle = sample.mean(0) if len(sample) else np.zeros(1)
        self.centres: list[np.ndarray] = [middle / (np.linalg.norm(middle) or 1)]
        self.children: list[list[int]] = [[]]
        todo = [(0, sample)]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf_size:
                continue
            c = own[rng.choice(len(own), branch, replace=False)]
            for _ in range(rounds):
                to = (own @ c.T).argmax(1)
                for i in range(branch):
                    if (to == i).any():
                        m = own[to == i].mean(0)
                        c[i] = m / (np.linalg.norm(m) or 1)
            to = (own @ c.T).argmax(1)
            groups = [g for g in (own[to == i] for i in range(branch)) if len(g)]
            if len(groups) < 2:
                continue
            for g in groups:
                m = g.mean(0)
                self.centres.append(m / (np.linalg.norm(m) or 1))
                self.children.append([])
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, g))
        self.matrix = np.array(self.centres)
        self.leaf: dict[int, int] = {}  # leaves are numbered so that those near in the tree are near in number
        stack = [0]
        while stack:
            node = stack.pop()
            stack += self.children[node]
            if not self.children[node]:
                self.leaf[node] = len(self.leaf)
        self.leaf_nodes = np.array(list(self.leaf))
        self.reach = np.zeros(len(self.matrix))
        self._below(0)

    def _below(self, node: int) -> list[int]:
        """The leaf nodes under a node; sets how far, as an angle, their centres lie from its own."""
        if not self.children[node]:
            return [node]
        out = [x for n in self.children[node] for x in self._below(n)]
        self.reach[node] = np.arccos(np.clip(self.matrix[out] @ self.matrix[node] / (np.linalg.norm(self.matrix[node]) or 1), -1, 1)).max()
        return out

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector would visit first: that of the nearest centre."""
        return (vectors @ self.matrix[self.leaf_nodes].T).argmax(1)

    def visits(self, near: np.ndarray) -> Iterator[int]:
        """The leaves best bin first; near: cosines to all nodes. A node waits in the queue at the most that a leaf centre under it can reach, so leaves come in the order of their centres."""
        far = (-np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - self.reach))).tolist()
        queue = [(far[0], 0)]
        while queue:
            _, at = heapq.heappop(queue)
            if not (below := self.children[at]):
                yield self.leaf[at]
            for n in below:
                heapq.heappush(queue, (far[n], n))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows of doubles; very large and very small ones by a power of two nearer to 1, which no cosine sees."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    most = np.abs(out).max(1, initial=0.0)
    if len(odd := np.flatnonzero((most > 1e100) | (most < 1e-100))):
        out[odd] = np.ldexp(out[odd], -np.frexp(most[odd])[1][:, None])
    return out


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, row_id): rows that take part; row_id is fixed once this is written."""
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & good)
    return own.withColumn("row_id", F.monotonically_increasing_id())


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(rows: DataFrame, k: int = 5, every: int = 50, recall: float = 0.95, sample: int = 20_000, calibrate: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`."""
    common.short_batches(rows.sparkSession)
    own = common.written(usable(rows, id_col, vector_col), "vectors")
    lengths = [r.n for r in own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").collect()]
    found = [_search(own.where(F.size("v") == n) if len(lengths) > 1 else own, k, every, recall, sample, calibrate) for n in lengths or [0]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(own: DataFrame, k: int, every: int, recall: float, sample: int, calibrate: int) -> DataFrame:
    """search() over own(vec_id, v, row_id), vectors of one length."""
    v_ddl, id_ddl = common.ddl_type(own, "v"), common.ddl_type(own, "vec_id")
    first = Window.partitionBy("v").orderBy("vec_id", "row_id")
    member = F.struct(F.col("vec_id").alias("i"), F.col("row_id").alias("r"))
    classes = own.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(member)).alias("ids"))
    classes = common.written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    chosen = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(unit(matrix(chosen)) if len(chosen) else np.zeros((0, 1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaves_of(unit(matrix(b.column("v"))))), *b.columns], names=["leaf", *b.schema.names])

    ids_ddl = f"array<struct<i:{id_ddl},r:bigint>>"
    indexed = common.written(classes.mapInArrow(common.tidy(deal), f"leaf long, v {v_ddl}, ids {ids_ddl}, class long"), "indexed")
    asking = own.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("row_id").alias("query_row"), "v").join(classes.select("v", "class"), "v").select("query_id", "query_row", "class")
    asking = common.written(asking, "asking")
    queries = asking.select("class").distinct().join(classes.select("class", "v"), "class")
    plan = calibrated(indexed, queries, tree, k, recall, calibrate)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and bucket: the leaves there to visit."""
        for b in batches:
            if not b.num_rows:
                continue
            near = unit(matrix(b.column("v"))) @ tree.matrix.T
            at, bucket, leaves = [], [], []
            for r, n in enumerate(near):
                visit = np.sort(np.fromiter(islice(tree.visits(n), visits_for(plan, tree, n)), dtype=np.int64))
                edges = np.flatnonzero(np.diff(visit // BUCKET, prepend=-1))
                at += [r] * len(edges)
                bucket += (visit[edges] // BUCKET).tolist()
                leaves += np.split(visit, edges[1:])
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), b.column("class").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(leaves, pa.list_(pa.int64()))], names=["bucket", "class", "v", "leaves"])

    asked = queries.select("class", "v").mapInArrow(common.tidy(walk), f"bucket long, class long, v {v_ddl}, leaves array<long>")
    in_bucket = F.floor(F.col("leaf") / BUCKET).alias("bucket")
    blocks = indexed.groupBy(in_bucket).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    held = indexed.withColumn("bucket", in_bucket).join(blocks, "bucket").select("bucket", F.pmod(F.xxhash64("class"), "blocks").alias("block"), F.lit(0).alias("kind"), "class", "ids", "v", F.array("leaf").alias("leaves"))
    to = asked.join(blocks, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "class", F.lit(None).cast(ids_ddl).alias("ids"), "v", "leaves")
    together = held.unionByName(to).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "kind")
    most = k + 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ready = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("bucket", "block", "kind")], axis=1) if b.num_rows else np.zeros((0, 3), dtype=np.int64)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part, here = b.slice(lo, hi - lo), tuple(keys[lo, :2].tolist())
                if here != key:
                    key, parts, ready = here, [], None
                if keys[lo, 2] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if ready is None:
                    m = np.concatenate([matrix(p.column("v")) for p in parts])
                    ids = pa.chunked_array([p.column("ids") for p in parts]).combine_chunks()
                    leaf = np.concatenate([p.column("leaves").flatten().to_numpy() for p in parts]) % BUCKET
                    ready = m, np.linalg.norm(m, axis=1), leaf, ids, np.array([x[0]["i"] for x in ids.to_pylist()])
                yield scored(part, *ready)

    def scored(part: pa.RecordBatch, m: np.ndarray, norms: np.ndarray, leaf: np.ndarray, ids: pa.Array, least: np.ndarray) -> pa.RecordBatch:
        q = matrix(part.column("v"))
        q_norms, leaves = np.linalg.norm(q, axis=1), part.column("leaves")
        who, at, scores = [], [], []
        for r in range(len(q)):
            here = np.zeros(BUCKET, dtype=bool)
            here[leaves[r].values.to_numpy() % BUCKET] = True
            seen = np.flatnonzero(here[leaf])
            s = (m[seen] @ q[r]) / (q_norms[r] * norms[seen])
            top = best(s, least[seen], most)
            who.append(np.full(len(top), r))
            at.append(seen[top])
            scores.append(s[top])
        who, at = np.concatenate(who), np.concatenate(at)
        return pa.RecordBatch.from_arrays([part.column("class").take(pa.array(who)), ids.take(pa.array(at)), pa.array(np.concatenate(scores))], names=["class", "ids", "score"])

    near = together.mapInArrow(common.tidy(compare), f"class long, ids {ids_ddl}, score double")
    order = Window.partitionBy("class").orderBy(F.desc("score"), F.col("ids")[0]["i"])
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    pairs = F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("s"), x["i"].alias("i"), x["r"].alias("r")))))
    lists = near.groupBy("class").agg(F.slice(F.array_sort(pairs), 1, k + 1).alias("near"))
    hits = asking.join(lists, "class").select("query_id", F.slice(F.expr("filter(near, x -> x.r <> query_row)"), 1, k).alias("near"))
    out = hits.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def visits_for(plan: list[tuple[float, int]], tree: Tree, near: np.ndarray) -> int:
    """plan: pairs of a similarity to the nearest leaf and the visits up to it, the last for all above."""
    first = near[tree.leaf_nodes].max()
    return next((v for edge, v in plan if first <= edge), plan[-1][1])


def calibrated(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, calibrate: int, bins: int = 4) -> list[tuple[float, int]]:
    """How many leaves to visit, by the similarity to the nearest leaf."""
    chosen = queries.orderBy(F.xxhash64("class")).limit(calibrate).toArrow()
    if not chosen.num_rows:
        return [(1.0, 1)]
    v, names = matrix(chosen.column("v").combine_chunks()), chosen.column("class").to_numpy()
    norms = np.linalg.norm(v, axis=1)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, int, int]]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            m, leaf, cls = matrix(b.column("v")), b.column("leaf").to_numpy(), b.column("class").to_numpy()
            scores = (v @ m.T) / (norms[:, None] * np.linalg.norm(m, axis=1)[None, :])
            for i, s in enumerate(scores):
                top = best(s, cls, k + 1)
                held[i] = sorted([*held.get(i, []), *((-float(s[j]), int(cls[j]), int(leaf[j])) for j in top)])[: k + 1]
        yield from common.in_batches(((int(names[i]), -s, c, leaf) for i, x in held.items() for s, c, leaf in x), pa.schema([("q", pa.int64()), ("score", pa.float64()), ("class", pa.int64()), ("leaf", pa.int64())]), 4096)

    own = Window.partitionBy("q").orderBy(F.desc("score"), "class")
    got = indexed.mapInArrow(common.tidy(exact), "q long, score double, class long, leaf long").where("q <> class").withColumn("n", F.row_number().over(own)).where(F.col("n") <= k).select("q", "leaf").collect()
    near = unit(v) @ tree.matrix.T
    wanted: dict[int, set[int]] = {}
    for r in got:
        wanted.setdefault(r.q, set()).add(r.leaf)
    order: dict[int, dict[int, int]] = {}
    for q, n in zip(names.tolist(), near, strict=True):
        own = order[q] = {}
        missing = set(wanted.get(q, ()))
        for i, leaf in enumerate(tree.visits(n) if missing else (), 1):
            if leaf in missing:
                own[leaf] = i
                missing.discard(leaf)
                if not missing:
                    break
    first = {int(q): n[tree.leaf_nodes].max() for q, n in zip(names, near, strict=True)}
    edges = np.quantile(list(first.values()), np.linspace(0, 1, bins + 1)[1:])
    plan = []
    for i, edge in enumerate(edges):
        low = edges[i - 1] if i else -2.0
        need = sorted(order[r.q][r.leaf] for r in got if low < first[r.q] <= edge)
        plan.append((float(edge), need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] if need else 1))
    return plan


def exact_neighbours(vectors: dict[int, list[float]], k: int = 5, every: int = 50) -> dict[int, list[tuple[int, float]]]:
    """Brute force for tests and for measuring recall."""
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], dtype=np.float64)
    norms = np.linalg.norm(m, axis=1)
    out = {}
    for r in np.flatnonzero(ids % every == 0):
        s = (m @ m[r]) / (norms * norms[r])
        s[r] = -np.inf
        out[int(ids[r])] = [(int(ids[j]), float(s[j])) for j in best(s, ids, k) if s[j] > -np.inf]
    return out
