"""Hypotheses meet a sample of the source first."""

import numpy as np

from pointloom.functions import rng
from pointloom.geometry import PointCloud
from pointloom.operators import registration as R


def clouds(spark, n=200):
    r = np.random.default_rng(1)
    points = r.uniform(-1, 1, (n, 3))
    shift = np.array([0.5, -0.25, 0.125])
    source, target = (PointCloud.from_numpy(spark, p).df for p in (points, points + shift))
    wrong = r.permutation(n)
    pairs = spark.createDataFrame([(i, int(wrong[i]) if i % 2 else i) for i in range(n)], "source_id long, target_id long")
    return source, target, pairs, shift


def test_sampled_scores_spare_full_ones(spark, monkeypatch):
    source, target, pairs, shift = clouds(spark)
    sizes = []

    def counted(cloud, *args, score=R.score_hypotheses):
        sizes.append((cloud.count(), len(args[2])))
        return score(cloud, *args)

    monkeypatch.setattr(R, "score_hypotheses", counted)
    monkeypatch.setattr(R, "SAMPLES", 20)
    monkeypatch.setattr(R, "every_nth", lambda cloud, n, f=R.every_nth: f(cloud, n, 20))
    rng.seed(3)
    got = R.ransac(source, target, pairs, 0.05, criteria=R.RansacCriteria(60, 0.999), batch=20)
    assert np.allclose(got.transformation[:3, 3], shift) and got.fitness == 1.0
    few, full = (sum(k for n, k in sizes if (n == 200) == whole) for whole in (False, True))
    assert {n for n, _ in sizes} == {20, 200} and 0 < full < few


def test_the_same_answer_with_and_without_a_sample(spark, monkeypatch):
    source, target, pairs, _ = clouds(spark)
    found = []
    for most in (10**6, 20):
        monkeypatch.setattr(R, "SAMPLES", most)
        rng.seed(5)
        got = R.ransac(source, target, pairs, 0.05, criteria=R.RansacCriteria(40, 0.999), batch=16)
        found.append((got.transformation.round(9).tolist(), got.fitness, rng.bounded(1 << 30)))
    assert found[0] == found[1]


def test_a_sample_drops_nothing_that_could_be_best(spark, monkeypatch):
    """The sampled points have no partners in the target; all others do."""
    source, target, pairs, shift = clouds(spark, 100)
    target, pairs = target.where("pid % 10 > 0"), pairs.where("source_id % 10 > 0 AND target_id % 10 > 0")
    monkeypatch.setattr(R, "every_nth", lambda cloud, n, f=R.every_nth: f(cloud, n, 10))
    found = []
    for most in (10**6, 10):
        monkeypatch.setattr(R, "SAMPLES", most)
        rng.seed(5)
        got = R.ransac(source, target, pairs, 0.05, criteria=R.RansacCriteria(40, 0.999), batch=16)
        found.append((got.transformation.round(9).tolist(), got.fitness, rng.bounded(1 << 30)))
    assert found[0] == found[1] and found[1][1] == 0.9 and np.allclose(got.transformation[:3, 3], shift)


def test_drawing_stops_by_all_correspondences(spark, monkeypatch):
    """Every second row of 10,000 is wrong; of the others alone, one sample would be enough."""
    n = 5001
    source, target, _, _ = clouds(spark, n)
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in (i, i + 1) if j < n], "source_id long, target_id long")
    draws = []
    monkeypatch.setattr(R.rng, "bounded", lambda _: draws.append(1) or 2 * (len(draws) % 3))
    got = R.ransac(source, target, pairs, 0.001, criteria=R.RansacCriteria(6, 0.999), batch=1)
    assert got.fitness == 1.0 and len(draws) == 18


def test_every_nth_point(spark):
    by_id = spark.range(100).selectExpr("id AS pid")
    assert [r.pid for r in R.every_nth(by_id, 100, 10).orderBy("pid").collect()] == list(range(0, 100, 10))
    scattered = spark.range(10_000).selectExpr("xxhash64(id) AS pid")
    assert 700 < R.every_nth(scattered, 10_000, 1000).count() < 1300


def test_too_many_pairs_are_refused(spark, monkeypatch):
    source, target, pairs, _ = clouds(spark, 20)
    monkeypatch.setattr(R, "MOST_PAIRS", 10)
    try:
        R.ransac(source, target, pairs, 0.05)
    except ValueError as e:
        assert "20 correspondences" in str(e)
    else:
        raise AssertionError
