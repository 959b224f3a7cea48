"""Rigid registration. Rows are summed by Spark, in one job a step; the small dense solves run on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import rng
from pointloom.functions.formatting import exponent
from pointloom.functions.solve import point_to_plane, symmetric, umeyama
from pointloom.functions.vec import NORMAL, XYZ, Vec, dot, has, lits, mat_vec, norm2, sub, vec
from pointloom.operators.bounds import center_of
from pointloom.operators.neighbors import nearest_within
from pointloom.plans.staging import written


@dataclass(repr=False)
class IcpCriteria:
    relative_fitness: float = 1e-6
    relative_rmse: float = 1e-6
    max_iteration: int = 30

    def __repr__(self) -> str:
        return f"ICPConvergenceCriteria(relative_fitness={exponent(self.relative_fitness)}, relative_rmse={exponent(self.relative_rmse)}, max_iteration={self.max_iteration})"


@dataclass(repr=False)
class RansacCriteria:
    max_iteration: int = 100_000
    confidence: float = 0.999

    def __repr__(self) -> str:
        return f"RANSACConvergenceCriteria(max_iteration={self.max_iteration}, confidence={exponent(self.confidence)})"


@dataclass
class Estimation:
    """Point to point, with or without scaling, or point to plane."""

    plane: bool = False
    with_scaling: bool = False


@dataclass(repr=False)
class Result:
    transformation: np.ndarray = field(default_factory=lambda: np.eye(4))
    fitness: float = 0.0
    inlier_rmse: float = 0.0
    correspondence_set: DataFrame | None = None

    def __repr__(self) -> str:
        n = 0 if self.correspondence_set is None else self.correspondence_set.count()
        return f"RegistrationResult with fitness={exponent(self.fitness)}, inlier_rmse={exponent(self.inlier_rmse)}, and correspondence_set size of {n}\nAccess transformation to get result."


def moved(cloud: DataFrame, m: np.ndarray) -> DataFrame:
    """Rotated, scaled and shifted points; registration never divides by w.

    The matrix is a table of one row, not literals: so the generated code is the same for every matrix, and an iteration
    compiles nothing.
    """
    names = [f"m{i}{j}" for i in range(3) for j in range(4)]
    row = cloud.sparkSession.createDataFrame([tuple(map(float, np.asarray(m, float)[:3].ravel()))], ", ".join(f"{n} double" for n in names))
    p = [f"m{i}0 * x + m{i}1 * y + m{i}2 * z + m{i}3 AS {c}" for i, c in enumerate(XYZ)]
    return cloud.select("pid", *XYZ).crossJoin(F.broadcast(row)).selectExpr("pid", *p)


def inliers(source: DataFrame, target: DataFrame, max_distance: float, m: np.ndarray) -> DataFrame:
    """(source_id, target_id, d2): the nearest target point of each moved source point, if closer than ``max_distance``."""
    near = nearest_within(moved(source, m).withColumnRenamed("pid", "qid"), target, max_distance)
    return near.select(F.col("qid").alias("source_id"), F.col("nid").alias("target_id"), "d2")


def closest(source: DataFrame, target: DataFrame, max_distance: float, m: np.ndarray) -> DataFrame:
    """``inliers`` with both points, as in ``paired``, out of the same join: nothing is looked up by id afterwards."""
    names = XYZ + (NORMAL if has(target, NORMAL) else ())
    found = nearest_within(moved(source, m).withColumnRenamed("pid", "qid"), target, max_distance, names)
    return found.selectExpr("qid AS source_id", "nid AS target_id", "d2", *[f"s_{c} AS s{c}" for c in XYZ], *[f"t_{c} AS t{c}" for c in names])


def _fitness(n: Column, total: int, d2: Column) -> list[Column]:
    return [(n / F.lit(float(max(total, 1)))).alias("fitness"), F.coalesce(F.sqrt(F.try_divide(d2, n)), F.lit(0.0)).alias("inlier_rmse")]


def evaluation(source: DataFrame, target: DataFrame, max_distance: float, m=None) -> DataFrame:
    """One row: n_inlier, fitness, inlier_rmse."""
    m = np.eye(4) if m is None else np.asarray(m, float)
    n = F.count(F.lit(1))
    return inliers(source, target, max_distance, m).agg(n.cast("long").alias("n_inlier"), *_fitness(n, source.count(), F.sum("d2")))


def evaluate(source: DataFrame, target: DataFrame, max_distance: float, m=None) -> Result:
    m = np.eye(4) if m is None else np.asarray(m, float)
    if max_distance <= 0:
        return Result(m)
    found = written(inliers(source, target, max_distance, m), "inliers")
    n, d2 = found.agg(F.count("*"), F.sum("d2")).first()
    return Result(m, n / max(1, source.count()), math.sqrt(d2 / n) if n else 0.0, found.select("source_id", "target_id"))


def paired(source: DataFrame, target: DataFrame, pairs: DataFrame, m: np.ndarray | None = None) -> DataFrame:
    """``pairs`` with the moved source point (sx ..), the target's (tx ..) and its normal where it has one."""
    s = (source if m is None else moved(source, m)).select(F.col("pid").alias("source_id"), *[F.col(c).alias(f"s{c}") for c in XYZ])
    t = target.select(F.col("pid").alias("target_id"), *[F.col(c).alias(f"t{c}") for c in XYZ + (NORMAL if has(target, NORMAL) else ())])
    return pairs.join(s, "source_id").join(t, "target_id")


_S, _T, _N = (lambda: vec(["sx", "sy", "sz"])), (lambda: vec(["tx", "ty", "tz"])), (lambda: vec(["tnx", "tny", "tnz"]))


def point_moments(shift_s: Sequence[float] = (0, 0, 0), shift_t: Sequence[float] = (0, 0, 0)) -> list[Column]:
    """Sums for the point-to-point fit. ``shift``: what is taken off first, so that far-off clouds keep their digits."""
    s, t = ([f"({k}{c} - {float(v)!r}D)" for c, v in zip(XYZ, shift, strict=True)] for k, shift in (("s", shift_s), ("t", shift_t)))
    sums = {f"s{i}": x for i, x in enumerate(s)} | {f"t{i}": x for i, x in enumerate(t)}
    sums |= {f"ts{i}{j}": f"{a} * {b}" for i, a in enumerate(t) for j, b in enumerate(s)} | {"ss": " + ".join(f"{x} * {x}" for x in s)}
    return [F.expr("cast(count(1) as double) AS n"), *[F.expr(f"sum({x}) AS {n}") for n, x in sums.items()]]


def plane_sums() -> list[Column]:
    """Sums for the point-to-plane fit: the upper triangle of JtJ, and Jtr."""
    j = ["(sy * tnz - sz * tny)", "(sz * tnx - sx * tnz)", "(sx * tny - sy * tnx)", "tnx", "tny", "tnz"]
    r = "((sx - tx) * tnx + (sy - ty) * tny + (sz - tz) * tnz)"
    square = [F.expr(f"sum({j[a]} * {j[b]}) AS a{a}{b}") for a in range(6) for b in range(a, 6)]
    return [*square, *[F.expr(f"sum({x} * {r}) AS b{i}") for i, x in enumerate(j)]]


def solve_points(v, with_scaling: bool, shift_s: np.ndarray, shift_t: np.ndarray) -> np.ndarray:
    n = v["n"]
    if not n:
        return np.eye(4)
    ms, mt = np.array([v[f"s{i}"] for i in range(3)]) / n, np.array([v[f"t{i}"] for i in range(3)]) / n
    cov = np.array([[v[f"ts{i}{j}"] for j in range(3)] for i in range(3)]) / n - np.outer(mt, ms)
    return umeyama(cov, v["ss"] / n - ms @ ms, ms + shift_s, mt + shift_t, with_scaling)


def solve_planes(v) -> np.ndarray:
    return point_to_plane(symmetric(v, 6, "a"), np.array([v[f"b{i}"] or 0.0 for i in range(6)]))


def check_pairs(source: DataFrame, target: DataFrame, pairs: DataFrame) -> None:
    """Raises on correspondences that point to no row."""
    for side, cloud in (("source", source), ("target", target)):
        bad = pairs.join(cloud.select(F.col("pid").alias(f"{side}_id")), f"{side}_id", "left_anti").first()
        if bad is not None:
            raise ValueError(f"correspondence {tuple(bad)} has an invalid {side} index")


def transformation(source: DataFrame, target: DataFrame, pairs: DataFrame, estimation: Estimation = Estimation()) -> np.ndarray:
    """The motion that fits given correspondences best; the identity for none, or for planes without target normals."""
    check_pairs(source, target, pairs)
    if estimation.plane:
        if not has(target, NORMAL):
            return np.eye(4)
        row = paired(source, target, pairs).agg(F.count(F.lit(1)).alias("n"), *plane_sums()).first().asDict()
        return solve_planes(row) if row["n"] else np.eye(4)
    cs, ct = center_of(source), center_of(target)
    return solve_points(paired(source, target, pairs).agg(*point_moments(cs, ct)).first().asDict(), estimation.with_scaling, cs, ct)


def rmse(source: DataFrame, target: DataFrame, pairs: DataFrame, estimation: Estimation = Estimation()) -> DataFrame:
    """One row: rmse over given correspondences, to the points or along the target normals; 0 for none."""
    d = sub(_S(), _T())
    square = dot(d, _N()) * dot(d, _N()) if estimation.plane else norm2(d)
    return paired(source, target, pairs).agg(F.coalesce(F.sqrt(F.try_divide(F.sum(square), F.count(F.lit(1)))), F.lit(0.0)).alias("rmse"))


def icp(source: DataFrame, target: DataFrame, max_distance: float, init=None, estimation: Estimation = Estimation(), criteria: IcpCriteria = IcpCriteria()) -> Result:
    """Iterative closest points. Each iteration is one job: nearest points, their count, error and the fit's sums.

    The transformation enters the plan as a table of one row beside fixed tables, so plans don't grow with the iterations.
    A target that tasks can hold is gathered once.
    """
    if max_distance <= 0:
        raise ValueError("max_correspondence_distance must be positive")
    if estimation.plane and not has(target, NORMAL):
        raise RuntimeError("Point-to-plane ICP needs target normals.")
    m = np.eye(4) if init is None else np.asarray(init, float)
    source = written(source.select("pid", *XYZ), "icp-source")
    target = written(target.select("pid", *XYZ, *(NORMAL if has(target, NORMAL) else ())), "icp-target")
    total = source.count()
    n_target = target.count()
    if not total or not n_target:
        return Result(m)
    shift = center_of(target)

    def step(m: np.ndarray) -> tuple[float, float, dict]:
        row = closest(source, target, max_distance, m).agg(F.sum("d2").alias("d2"), F.count(F.lit(1)).alias("count"), *(plane_sums() if estimation.plane else point_moments(shift, shift))).first().asDict()
        n = row["count"]
        return n / total, math.sqrt(row["d2"] / n) if n else 0.0, row

    fitness, error, row = step(m)
    for _ in range(criteria.max_iteration):
        if not row["count"]:
            update = np.eye(4)
        else:
            update = solve_planes(row) if estimation.plane else solve_points(row, estimation.with_scaling, shift, shift)
        if not np.isfinite(update).all():
            break
        m = update @ m
        before = fitness, error
        fitness, error, row = step(m)
        if abs(before[0] - fitness) < criteria.relative_fitness and abs(before[1] - error) < criteria.relative_rmse:
            break
    return Result(m, fitness, error, inliers(source, target, max_distance, m).select("source_id", "target_id"))


def information_sums() -> list[Column]:
    x, y, z = _T()
    return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(v).alias(k) for k, v in {"x": x, "y": y, "z": z, "xx": x * x, "yy": y * y, "zz": z * z, "xy": x * y, "xz": x * z, "yz": y * z}.items()]]


def information_matrix(source: DataFrame, target: DataFrame, max_distance: float, m) -> np.ndarray:
    """6x6, out of ten sums over the corresponding target points."""
    if max_distance <= 0:
        return np.zeros((6, 6))
    pairs = closest(source, target, max_distance, np.asarray(m, float))
    v = {k: x or 0.0 for k, x in pairs.agg(*information_sums()).first().asDict().items()}
    skew = np.array([[0, -v["z"], v["y"]], [v["z"], 0, -v["x"]], [-v["y"], v["x"], 0]])
    turn = np.array([[v["yy"] + v["zz"], -v["xy"], -v["xz"]], [-v["xy"], v["xx"] + v["zz"], -v["yz"]], [-v["xz"], -v["yz"], v["xx"] + v["yy"]]])
    return np.block([[turn, skew], [skew.T, v["n"] * np.eye(3)]])


@dataclass(frozen=True)
class EdgeLength:
    """Every pair of correspondences spans similar lengths in both clouds."""

    similarity_threshold: float = 0.9
    require_pointcloud_alignment: bool = False

    def fits(self, s: np.ndarray, t: np.ndarray, m: np.ndarray, ns=None, nt=None) -> bool:
        i, j = np.triu_indices(len(s), 1)
        ds, dt = (((a[i] - a[j]) ** 2).sum(1) for a in (s, t))
        limit = self.similarity_threshold**2
        return bool(((ds >= dt * limit) & (dt >= ds * limit)).all())


@dataclass(frozen=True)
class Distance:
    """Moved source points come as near as ``distance_threshold``, that included."""

    distance_threshold: float
    require_pointcloud_alignment: bool = True

    def fits(self, s: np.ndarray, t: np.ndarray, m: np.ndarray, ns=None, nt=None) -> bool:
        return bool(~((((s @ m[:3, :3].T + m[:3, 3]) - t) ** 2).sum(1) > self.distance_threshold**2).any())


@dataclass(frozen=True)
class NormalAngle:
    """Turned source normals are within an angle of the targets'; passes where either side has none."""

    normal_angle_threshold: float
    require_pointcloud_alignment: bool = False

    def fits(self, s: np.ndarray, t: np.ndarray, m: np.ndarray, ns=None, nt=None) -> bool:
        if ns is None or nt is None:
            return True
        return bool(~((nt * (ns @ m[:3, :3].T)).sum(1) < math.cos(self.normal_angle_threshold)).any())


#: Correspondences that meet each other at once.
EDGE_BLOCK = 2048


def edge_length_check(source: DataFrame, target: DataFrame, pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row, passed: over every pair of correspondences of different source points.

    Correspondences are dealt by hash over blocks of about ``EDGE_BLOCK``. Pairs within a block come first; only if they all fit
    do pairs of blocks follow. A task ends at the first pair that doesn't fit.
    """
    p = paired(source, target, pairs).select("source_id", "target_id", *[f"{k}{c}" for k in "st" for c in XYZ])
    p = written(p, "correspondences")
    n = max(1, -(-p.count() // EDGE_BLOCK))
    p = p.withColumn("block", F.pmod(F.xxhash64("source_id", "target_id"), F.lit(n)).cast("int"))
    a, b = (p.select(*[F.col(c).alias(f"{k}_{c}") for c in p.columns]) for k in "ab")
    side = lambda k, c: vec([f"{k}_{c}{x}" for x in XYZ])
    ds, dt = (norm2(sub(side("a", c), side("b", c))) for c in "st")
    limit = F.lit(threshold * threshold)
    wrong = ~((ds >= dt * limit) & (dt >= ds * limit))
    row = lambda passed: p.sparkSession.range(1).select(F.lit(passed).alias("passed"))
    within = a.join(b, (F.col("a_block") == F.col("b_block")) & (F.col("a_source_id") < F.col("b_source_id")))
    if not within.where(wrong).isEmpty():
        return row(False)
    if n == 1:
        return row(True)
    a = a.where(F.col("a_block") < n - 1).withColumn("a_other", F.explode(F.sequence(F.col("a_block") + 1, F.lit(n - 1))))
    b = b.where("b_block > 0").withColumn("b_other", F.explode(F.sequence(F.lit(0), F.col("b_block") - 1)))
    across = a.join(b, (F.col("a_block") == F.col("b_other")) & (F.col("a_other") == F.col("b_block")) & (F.col("a_source_id") != F.col("b_source_id")))
    return across.where(wrong).limit(1).agg((F.count("*") == 0).alias("passed"))


def distance_check(source: DataFrame, target: DataFrame, pairs: DataFrame, threshold: float, m=None) -> DataFrame:
    far = norm2(sub(_S(), _T())) > F.lit(threshold * threshold)
    return paired(source, target, pairs, np.eye(4) if m is None else m).agg(F.coalesce(F.bool_and(~far), F.lit(True)).alias("passed"))


def normal_check(source: DataFrame, target: DataFrame, pairs: DataFrame, angle: float, m=None) -> DataFrame:
    m = np.eye(4) if m is None else np.asarray(m, float)
    s = source.select(F.col("pid").alias("source_id"), *[F.col(c).alias(f"s{c}") for c in NORMAL])
    turned: Vec = mat_vec(m, vec(["snx", "sny", "snz"]))
    return paired(source, target, pairs).join(s, "source_id").agg(F.coalesce(F.bool_and(~(dot(_N(), turned) < F.lit(math.cos(angle)))), F.lit(True)).alias("passed"))


#: Source points that a hypothesis may meet first.
SAMPLES = 2048


def every_nth(cloud: DataFrame, n: int, most: int = SAMPLES) -> DataFrame:
    """Every (n // most)-th point by id, where ids are 0 .. n - 1; of other ids, as many by their hash."""
    stride = max(1, n // most)
    if stride == 1:
        return cloud
    low, high = cloud.agg(F.min("pid"), F.max("pid")).first()
    return cloud.where((F.col("pid") if (low, high) == (0, n - 1) else F.xxhash64("pid")) % stride == 0)


def sampled_fitness(source: DataFrame, target: DataFrame, max_distance: float, m=None, most: int = SAMPLES) -> DataFrame:
    """One row as ``evaluation``, over every n-th source point."""
    return evaluation(every_nth(source, source.count(), most), target, max_distance, m)


def inlier_ratio(source: DataFrame, target: DataFrame, pairs: DataFrame, max_distance: float, m=None) -> DataFrame:
    """One row, ratio: the share of correspondences closer than ``max_distance`` once moved."""
    near = norm2(sub(_S(), _T())) < F.lit(float(max_distance) ** 2)
    share = F.try_divide(F.count(F.when(near, 1)), F.count(F.lit(1)))
    return paired(source, target, pairs, np.eye(4) if m is None else m).agg(F.coalesce(share, F.lit(0.0)).alias("ratio"))


def _fit(estimation: Estimation, s: np.ndarray, t: np.ndarray, nt: np.ndarray | None) -> np.ndarray:
    if estimation.plane:
        if nt is None:
            return np.eye(4)
        j, r = np.hstack([np.cross(s, nt), nt]), ((s - t) * nt).sum(1)
        return point_to_plane(j.T @ j, j.T @ r)
    ms, mt = s.mean(0), t.mean(0)
    return umeyama((t - mt).T @ (s - ms) / len(s), float(((s - ms) ** 2).sum(1).mean()), ms, mt, estimation.with_scaling)


#: Correspondences that the driver holds, of at most 14 numbers each.
MOST_PAIRS = 5_000_000


def ransac(source: DataFrame, target: DataFrame, pairs: DataFrame, max_distance: float, estimation: Estimation = Estimation(), ransac_n: int = 3, checkers: Sequence = (), criteria: RansacCriteria = RansacCriteria(), batch: int = 256, chunk: int = 8) -> Result:
    """RANSAC over correspondences, reproducible under ``rng.seed``.

    Samples are drawn on the driver in iteration order. Hypotheses are fitted to ``ransac_n`` rows each, checked
    cheaply there, and those left are scored on all points in iteration order, ``chunk`` of them a job (a whole batch, if the
    points are few), so that a good one spares the later ones: hypotheses times points, joined to the target's grid and
    aggregated. Once the best misses fewer points than a sample of the source has, a batch's hypotheses meet that sample first, and those
    that miss more of it than the best misses of all points are dropped, since they can't be better. So the result is
    that of scoring every hypothesis on every point. Drawing stops at the confidence bound, taken from all correspondences, and the engine
    is put back to where a one-by-one run would have left it. Correspondences, ordered by their ids, are counted before
    they are gathered: more than ``MOST_PAIRS`` are refused.
    """
    check_pairs(source, target, pairs)
    n_pairs = pairs.count()
    if n_pairs > MOST_PAIRS:
        raise ValueError(f"{n_pairs} correspondences; filter them to {MOST_PAIRS} at most")
    joined = paired(source, target, pairs)
    extra = []
    if has(source, NORMAL):
        joined = joined.join(source.select(F.col("pid").alias("source_id"), *[F.col(c).alias(f"s{c}") for c in NORMAL]), "source_id")
        extra = ["snx", "sny", "snz"]
    frame = joined.toPandas().sort_values(["source_id", "target_id"], ignore_index=True)
    if ransac_n < 3 or len(frame) < ransac_n or max_distance <= 0 or source.isEmpty() or target.isEmpty():
        return Result()
    s, t = frame[["sx", "sy", "sz"]].to_numpy(float), frame[["tx", "ty", "tz"]].to_numpy(float)
    nt = frame[["tnx", "tny", "tnz"]].to_numpy(float) if has(target, NORMAL) else None
    ns = frame[extra].to_numpy(float) if extra else None
    keys = list(zip(frame["source_id"], frame["target_id"], strict=True))
    source = written(source.select("pid", *XYZ), "ransac-source")
    target = written(target.select("pid", *XYZ), "ransac-target")
    total = source.count()
    whole = total // SAMPLES <= 1  # the sample is the source itself
    sample = source if whole else written(every_nth(source, total), "ransac-sample")
    n_sample = total if whole else sample.count()
    best, most, budget, done = Result(), 0, criteria.max_iteration, 0  # most: the best one's inliers

    def draw() -> list[int] | None:
        rows: list[int] = []
        for _ in range(max(32 * ransac_n, 128) + 1):
            at = rng.bounded(len(keys))
            if all(keys[at] != keys[r] for r in rows):
                rows.append(at)
            if len(rows) == ransac_n:
                return rows
        return None

    while done < min(budget, criteria.max_iteration):
        states, tried = [], {}
        for itr in range(done, min(budget, criteria.max_iteration, done + batch)):
            states.append(rng.snapshot())
            rows = draw()
            if rows is None:
                continue
            m = _fit(estimation, s[rows], t[rows], None if nt is None else nt[rows])
            if np.isfinite(m).all() and all(c.fits(s[rows], t[rows], m, None if ns is None else ns[rows], None if nt is None else nt[rows]) for c in checkers):
                tried[itr] = m
        scored, met = score_hypotheses(source, target, max_distance, tried) if whole and tried else {}, None
        for itr in range(done, done + len(states)):
            if itr >= budget:
                rng.restore(states[itr - done])
                break
            if itr not in tried:
                continue
            if not whole:
                if met is None and most > total - n_sample:
                    met = score_hypotheses(sample, target, max_distance, {i: m for i, m in tried.items() if i >= itr})
                left = [i for i in tried if i >= itr and (met is None or met.get(i, (0, 0.0))[0] + total - n_sample >= most)]
                if itr not in left:
                    continue
                if itr not in scored:
                    soon = {i: tried[i] for i in left[:chunk]}
                    scored = dict.fromkeys(soon, (0, 0.0)) | score_hypotheses(source, target, max_distance, soon)
            n, d2 = scored.get(itr, (0, 0.0))
            if not n:
                continue
            fitness, error = n / total, math.sqrt(d2 / n)
            if fitness > best.fitness or (fitness == best.fitness and error < best.inlier_rmse):
                m = tried[itr]
                best, most = Result(m, fitness, error), n
                near = (((s @ m[:3, :3].T + m[:3, 3]) - t) ** 2).sum(1) < max_distance**2
                chance = near.mean() ** ransac_n
                if chance >= 1:
                    budget = min(budget, 1)
                elif chance > 0 and (bound := math.log(1 - criteria.confidence) / math.log1p(-chance)) >= 0:
                    budget = min(budget, math.ceil(bound))
        done += len(states)
    return evaluate(source, target, max_distance, best.transformation) if best.fitness > 0 else best


def score_hypotheses(source: DataFrame, target: DataFrame, max_distance: float, tried: dict[int, np.ndarray]) -> dict[int, tuple[int, float]]:
    """(inliers, sum of squared distances) of each hypothesis, in one job; the hypotheses are a table of twelve numbers each."""
    rows = pd.DataFrame([[itr, *m[:3].ravel()] for itr, m in tried.items()], columns=["itr", *[f"m{i}{j}" for i in range(3) for j in range(4)]])
    hypotheses = F.broadcast(source.sparkSession.createDataFrame(rows).withColumn("itr", F.col("itr").cast("long")))  # a batch of them
    p = vec()
    point = [dot(tuple(F.col(f"m{i}{j}") for j in range(3)), p) + F.col(f"m{i}3") for i in range(3)]
    asked = source.crossJoin(hypotheses).select(F.struct("itr", "pid").alias("qid"), *[x.alias(c) for x, c in zip(point, XYZ, strict=True)])
    near = nearest_within(asked, target, max_distance)
    got = near.groupBy(F.col("qid.itr").alias("itr")).agg(F.count("*").alias("n"), F.sum("d2").alias("d2")).collect()
    return {r.itr: (r.n, r.d2) for r in got}
