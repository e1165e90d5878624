"""op6 against brute force: recall, pruning, exact scores, repeated rows, odd vectors."""

from itertools import islice

import numpy as np
import pytest

from docweave.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score double"


def brute(rows: list[tuple], k: int = 5, every: int = 50) -> list[tuple]:
    """(query_id, rank, vec_id, score) with every row as a candidate but the query's own."""
    out = []
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for n, (q, x) in enumerate(good):
        if q % every == 0:
            others = [(-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for m, (i, y) in enumerate(good) if m != n and len(y) == len(x)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df, **how).collect())


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(y)) for y in rng.normal(size=6)]) for i in range(0, 200, 10)]
    rows += [(0, rows[0][1]), (50, rows[5][1]), (3, rows[5][1]), (3, rows[5][1]), (7, [2 * x for x in rows[1][1]])]  # repeated rows, equal and parallel vectors
    rows += [(50, [1.0, 2.0]), (100, [2.0, 1.0]), (4, [1.0, 1.0]), (50, [3.0])]  # other lengths
    odd = [(1000, None), (1050, [0.0] * 6), (1100, [float("nan")] * 6), (1150, [None] * 6), (1200, []), (1250, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    found, wanted = got(spark, rows + odd, recall=1.0), brute(rows + odd)
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert [x[2] for x in found] == [x[2] for x in wanted]
    assert np.allclose([x[3] for x in found], [x[3] for x in wanted], atol=1e-12)


def test_recall_and_share_of_leaves(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    exact = neighbours.exact_neighbours(dict(rows))
    found: dict = {}
    for r in neighbours.search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(exact)
    assert np.mean([len(found[q] & {i for i, _ in exact[q]}) / 5 for q in exact]) >= 0.92
    m = neighbours.unit(np.array([v for _, v in rows], dtype=np.float64))
    tree = neighbours.Tree(m)
    leaf, share = tree.leaves_of(m), []
    at = {i: n for n, (i, _) in enumerate(rows)}
    need = []
    for q, x in exact.items():
        order = {lf: n for n, lf in enumerate(tree.visits(m[at[q]] @ tree.matrix.T), 1)}
        need += [order[leaf[at[i]]] for i, _ in x]
        share.append(len(order))
    assert share[0] == len(tree.leaf) and np.quantile(need, 0.95) < len(tree.leaf) / 3


def test_copies_and_extremes(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 12)).astype(np.float32)
    v[300:600] = v[0]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    found: dict = {}
    for q, _, i, _ in got(spark, rows):
        found.setdefault(q, []).append(i)
    assert found[300] == [0, 301, 302, 303, 304] and found[0] == [300, 301, 302, 303, 304]
    big = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, pytest.approx(r.score)) for r in neighbours.search(big).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5**0.5)]
    assert neighbours.search(big.limit(0)).count() == 0 and neighbours.search(big.where("vec_id < 1")).count() == 0


def test_visits_come_best_bin_first():
    rng = np.random.default_rng(1)
    tree = neighbours.Tree(neighbours.unit(rng.normal(size=(500, 8))))
    near = neighbours.unit(rng.normal(size=(1, 8)))[0] @ tree.matrix.T
    seen = list(islice(tree.visits(near), 5))
    assert len(set(seen)) == 5 and sorted(tree.visits(near)) == list(range(len(tree.leaf)))
