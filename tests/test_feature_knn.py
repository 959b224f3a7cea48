"""Nearest features whichever side is held, and in blocks: the same rows, ties to the smaller id."""

import numpy as np
import pytest

from pointloom.operators import neighbors as N


@pytest.mark.parametrize(("n_q", "n_t"), [(30, 400), (400, 30), (1, 5), (40, 3)])
@pytest.mark.parametrize("held", [8192, 0])
def test_nearest_features(spark, n_q, n_t, held):
    r = np.random.default_rng(n_q)
    q, t = (r.integers(0, 3, (n, 4)).astype(float) for n in (n_q, n_t))  # many ties
    df = lambda rows, key: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], f"{key} long, feat array<double>").repartition(3)
    found = sorted((x.qid, x.rank, x.nid, x.d2) for x in N.feature_knn(df(q, "qid"), df(t, "pid"), 5, block=16, held=held).collect())
    want = []
    for i, a in enumerate(q):
        near = sorted((float(((a - b) ** 2).sum()), j) for j, b in enumerate(t))[:5]
        want += [(i, k + 1, j, d) for k, (d, j) in enumerate(near)]
    assert found == want


def test_no_plane_of_all_pairs_is_sorted(monkeypatch):
    """Rows that can't be near are ruled out before distances are ordered; ties, copies and near ties stay exact."""
    r = np.random.default_rng(4)
    a, b = (np.concatenate([r.integers(0, 4, (60, 9)).astype(float), r.standard_normal((60, 9)) * s, np.full((9, 9), 1e8) + r.uniform(0, 1e-6, (9, 9))]) for s in (1, 1))
    b = np.concatenate([b, a[:50]])
    ids = r.permutation(len(b))
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(N.np, "lexsort", lambda keys, *x, **y: sizes.append(np.size(keys[0])) or sort(keys, *x, **y))
    for k in (1, 3, 500):
        d2 = np.zeros((len(a), len(b)))
        for d in range(9):
            d2 += (a[:, d, None] - b[None, :, d]) ** 2
        order = sort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :k]
        near, got = N._top(a, b, ids, k)
        assert np.array_equal(near, ids[order]) and np.array_equal(got, np.take_along_axis(d2, order, 1))
    assert sizes[0] < len(a) * len(b) / 5
