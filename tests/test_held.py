"""Searches of targets that every task holds, and the rings beyond: the same rows as every pair looked at, no sort of pairs."""

import numpy as np
import pytest

from pointloom.operators import neighbors as N
from pointloom.operators import registration as R


def clouds():
    r = np.random.default_rng(3)
    even = r.integers(-40, 40, (300, 3)) / 8.0
    dense = np.concatenate([np.repeat(even[:5], 20, 0), r.standard_normal((200, 3)) * 1e-4, even, [[1e6, -1e6, 3.0], [-0.0, 0.0, 0.0]]])
    return {"ties": even, "dense": dense, "one": even[:1], "same": np.repeat(even[:1], 30, 0), "far": even + 1e7, "huge": np.concatenate([even, [[1e200, 0, 0], [0, -1e200, 0]]])}


def brute(q, t, k, radius):
    out = []
    with np.errstate(over="ignore"):
        for i, p in enumerate(q):
            d = p - t
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            order = [j for j in np.lexsort((np.arange(len(t)), d2)) if radius == np.inf or d2[j] < radius**2][:k]
            out += [(i, n, int(j), d2[j]) for n, j in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("k", [1, 4, 25])
@pytest.mark.parametrize("radius", [1e-5, 0.5, 1.0, 30.0, np.inf])
def test_held_points_are_searched_exactly(k, radius, monkeypatch):
    monkeypatch.setattr(N.Held, "CANDIDATES", 500)
    for a, q in clouds().items():
        for b, t in clouds().items():
            got = sorted((int(i), int(n), int(j), d) for rows in N.Held(t, k, radius).search(q) for i, n, j, d in zip(*rows, strict=True))
            assert got == brute(q, t, k, radius), (a, b)


def frame(spark, p, key):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], f"{key} long, x double, y double, z double")


@pytest.mark.parametrize("most", [1 << 18, 10])
def test_nearest_and_hybrid_whether_held_or_in_rings(spark, monkeypatch, most):
    monkeypatch.setattr(N, "MOST_HELD", most)
    p = clouds()["dense"][80:340]
    q, t = frame(spark, p, "qid"), frame(spark, p[::2] + 0.25, "pid")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for radius in (0.3, 2.0) if most > 10 else (0.3,):
        assert rows(N.hybrid_join(q, t, radius, 3)) == brute(p, p[::2] + 0.25, 3, radius)
        assert rows(N.nearest_within(q, t, radius)) == [(i, j, d) for i, _, j, d in brute(p, p[::2] + 0.25, 1, radius)]
    assert rows(N.hybrid_join(q, t, 2.0, 0)) == rows(N.nearest_within(q, t.limit(0), 2.0)) == rows(N.nearest_within(q, t, 0.0)) == []


@pytest.mark.parametrize("most", [1 << 18, 10])
def test_no_search_sorts_all_pairs(spark, monkeypatch, most):
    """5,000 points within the radius of each other: 25 million pairs, of which a search may meet a small share."""
    monkeypatch.setattr(N, "MOST_HELD", most)
    p = np.random.default_rng(1).uniform(0, 0.1, (5000, 3))
    met = []
    monkeypatch.setattr(N, "near_pairs", lambda *a, f=N.near_pairs, **b: met.append(f(*a, **b)) or met[-1])
    source, target = frame(spark, p, "pid"), frame(spark, p + 0.001, "pid")
    assert R.evaluation(source, target, 0.5).first().n_inlier == 5000
    assert sum(x.count() for x in met[:1]) < 1_000_000 and len(met) <= 4


def test_a_query_is_sent_to_eight_cells(spark):
    """The ball meets two cells along each axis, wherever it lies in them; no pair is lost or found twice."""
    r = np.random.default_rng(5)
    q, t = np.concatenate([r.integers(-8, 8, (150, 3)) / 2.0, r.uniform(-4, 4, (150, 3)), [[1e17, -1e17, 1e300]]]), r.integers(-8, 8, (300, 3)) / 2.0
    pairs = N.near_pairs(frame(spark, q, "qid"), frame(spark, t, "pid"), 1.0)
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j, d) for i, _, j, d in brute(q, t, 10**9, 1.0))
    sent = [x for x in str(pairs._jdf.queryExecution().optimizedPlan()).split("\n") if "explode" in x]
    assert sent and not any("-1" in x for x in sent)


def test_ids_of_several_columns(spark):
    p = clouds()["ties"][:60]
    q, t = (frame(spark, p, k).selectExpr(f"struct({k} div 7 AS a, {k} AS b) AS {k}", "x", "y", "z") for k in ("qid", "pid"))
    got = sorted((r.qid.b, r.rank, r.nid.b, r.d2) for r in N.knn_join(q, t, 3).collect())
    assert got == brute(p, p, 3, np.inf)


def test_copies_at_few_places_are_held(spark, monkeypatch):
    """More targets than tasks may hold, but at few places: no ring meets every copy."""
    monkeypatch.setattr(N, "MOST_HELD", 40)
    monkeypatch.setattr(N, "rings", None)
    p = clouds()["ties"]
    t = np.concatenate([p[:6]] * 30 + [[[-0.0, 0.0, 0.0], [0.0, 0.0, -0.0]]])
    q = np.concatenate([p[:20], [[0.0, 0.0, 0.0]]])
    rows = lambda df: sorted(map(tuple, df.collect()))
    asked, held = frame(spark, q, "qid"), frame(spark, t, "pid")
    assert rows(N.hybrid_join(asked, held, 5.0, 4)) == brute(q, t, 4, 5.0)
    assert rows(N.nearest_within(asked, held, 5.0)) == [(i, j, d) for i, _, j, d in brute(q, t, 1, 5.0)]
