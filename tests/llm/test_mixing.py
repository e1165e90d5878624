"""op9's targets against a plain iteration, its flight against the inclusion probabilities."""

import numpy as np
import pytest

from docweave.llm import mixing


def filled(sizes: dict, weights=(5, 2, 1), total=1.5, most=2.0) -> dict:
    """Targets by sharing again and again what sources at their cap can't take."""
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    out, rest, budget = {}, list(order), total * sum(sizes.values())
    while rest:
        share = {k: budget * w[k] / sum(w[x] for x in rest) for k in rest}
        full = [k for k in rest if share[k] > most * sizes[k]]
        if not full:
            return out | share
        for k in full:
            out[k] = most * sizes[k]
            budget -= out[k]
        rest = [k for k in rest if k not in full]
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10, "d": 5, None: 70}, {"a": 100, "b": 100, "c": 100}, {"x": 7}, {"a": 0, "b": 0}, {"é": 3, "z": 900, "a": 0, None: 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    wanted = filled(sizes)
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-6 for k in got)


def test_flight_keeps_probabilities_and_totals():
    rng = np.random.default_rng(1)
    n, runs = 30, 4000
    for p in (np.full(n, 0.37), rng.uniform(0.05, 0.95, n)):
        size, seen = rng.integers(1, 900, n).astype(float), np.zeros(n)
        for seed in range(runs):
            flown = mixing.flight(p, size, np.random.default_rng(seed))
            assert ((flown > 0) & (flown < 1)).sum() <= 2
            assert abs(flown.sum() - p.sum()) < 1e-6 and abs(flown @ size - p @ size) < 1e-3
            seen += flown  # what is left open counts by its probability
        assert (np.abs(seen / runs - p) < 4 * np.sqrt(p * (1 - p) / runs)).all()


def test_landing_changes_open_units_only_where_they_suffice():
    size = np.array([5.0, 7, 11, 400, 2, 90])
    p = np.array([1.0, 0, 1, 0.4, 0.5, 0])
    near = mixing.landing(p, size, 18.0, slack=1.0)
    assert near.tolist() == [1, 0, 1, 0, 1, 0]
    assert abs(mixing.landing(p, size, 106.0, slack=1.0) @ size - 106) <= 1


def test_mix_handles_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", "s", 1.0), (1, "a b", "s", 1.0), (None, "x y z", None, 2.0), (None, "x y z", None, 2.0), (2, None, "s", 0.0), (3, "", "s", 0.0), (4, "w " * 50_000, "t", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.mix(df).collect()
    assert sorted(r.size for r in got) == [0, 0, 2, 2, 3, 3, 50_000]
    assert all(r.taken in (0, r.size, 2 * r.size) and r.source_size >= r.size for r in got)
