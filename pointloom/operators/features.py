"""FPFH descriptors and feature matching: two neighbour joins and two aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vec import NORMAL, XYZ, cross, dot, has, lits, norm, over, select_when, sub, times, vec
from pointloom.operators.neighbors import Hybrid, Knn, Radius, feature_knn, self_search
from pointloom.plans.staging import written

BINS = 11
PAIR = ("alpha", "phi", "theta", "d")


def with_pair_features(pairs: DataFrame) -> DataFrame:
    """Adds alpha, phi, theta, d of two points with normals (columns suffixed 1 and 2).

    The point whose normal leans less on the line between them is the source; no distance or no frame: zeros.
    """
    p1, p2 = vec(["x1", "y1", "z1"]), vec(["x2", "y2", "z2"])
    n1, n2 = vec(["nx1", "ny1", "nz1"]), vec(["nx2", "ny2", "nz2"])
    line = sub(p2, p1)
    clamp = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    d = pairs.withColumns({"d": norm(line), "lx": line[0], "ly": line[1], "lz": line[2]})
    line = vec(["lx", "ly", "lz"])
    d = d.withColumns({"a1": clamp(F.try_divide(dot(n1, line), "d")), "a2": clamp(F.try_divide(dot(n2, line), "d"))})
    swap = F.abs("a1") < F.abs("a2")
    src, dst, way = select_when(swap, n2, n1), select_when(swap, n1, n2), select_when(swap, times(line, F.lit(-1.0)), line)
    d = d.withColumn("theta0", F.when(swap, -F.col("a2")).otherwise(F.col("a1")))
    d = d.withColumns({f"{k}{i}": x for k, v in (("s", src), ("t", dst), ("w", way)) for i, x in enumerate(v)})
    src, dst, way = (vec([f"{k}{i}" for i in range(3)]) for k in "stw")
    v = cross(way, src)
    d = d.withColumns({"v0": v[0], "v1": v[1], "v2": v[2]})
    d = d.withColumn("vn", norm(vec(["v0", "v1", "v2"])))
    v = over(vec(["v0", "v1", "v2"]), F.col("vn"))
    d = d.withColumns({"v0": v[0], "v1": v[1], "v2": v[2]})
    v = vec(["v0", "v1", "v2"])
    w = cross(src, v)
    zero = (F.col("d") == 0) | (F.col("vn") == 0)
    values = {"alpha": F.atan2(dot(w, dst), dot(src, dst)), "phi": dot(v, dst), "theta": F.col("theta0"), "d": F.col("d")}
    return d.select(*[c for c in pairs.columns if c not in PAIR], *[F.when(zero, 0.0).otherwise(x).alias(n) for n, x in values.items()])


def neighbour_pairs(found: DataFrame, cloud: DataFrame) -> DataFrame:
    """(qid, nid, d2, k) and both ends' points and normals, of all neighbours but each query's first; k counts them with it."""
    k = found.groupBy("qid").agg(F.count("*").alias("k"))
    end = lambda name, i: cloud.select(F.col("pid").alias(name), *[F.col(c).alias(f"{c}{i}") for c in XYZ + NORMAL])
    return found.where("rank > 1").join(k, "qid").join(end("qid", 1), "qid").join(end("nid", 2), "nid")


def spfh_bins(found: DataFrame, cloud: DataFrame) -> DataFrame:
    """(pid, bin, value): the simplified histograms' occupied bins, 0..32."""
    f = with_pair_features(neighbour_pairs(found, cloud))
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(x).cast("int")))
    a = clamp(F.lit(float(BINS)) * (F.col("alpha") + F.lit(math.pi)) / F.lit(2.0 * math.pi))
    b, c = (clamp(F.lit(float(BINS)) * (F.col(n) + 1.0) * 0.5) for n in ("phi", "theta"))
    each = f.select("qid", "k", F.explode(F.array(a, b + BINS, c + 2 * BINS)).alias("bin"))
    return each.groupBy(F.col("qid").alias("pid"), "bin").agg((F.count("*") * F.lit(100.0) / F.first(F.col("k") - 1)).alias("value"))


def fpfh_bins(cloud: DataFrame, param: Knn | Radius | Hybrid) -> DataFrame:
    """(pid, bin, value): the non-zero bins of each point's fast point feature histogram."""
    if not has(cloud, NORMAL):
        raise RuntimeError("Failed because input point cloud has no normal.")
    found = written(self_search(cloud, param), "neighbours")
    spfh = written(spfh_bins(found, cloud), "spfh")
    near = found.where("rank > 1 AND d2 != 0").select("qid", F.col("nid").alias("pid"), "d2")
    summed = near.join(spfh, "pid").groupBy("qid", "bin").agg(F.sum(F.col("value") / F.col("d2")).alias("v"))
    summed = written(summed.withColumn("part", F.floor(F.col("bin") / BINS).cast("int")), "weighted")
    total = summed.groupBy("qid", "part").agg(F.sum("v").alias("total"))
    scaled = summed.join(total, ["qid", "part"]).select(F.col("qid").alias("pid"), "bin", (F.col("v") * F.coalesce(F.try_divide(F.lit(100.0), "total"), F.lit(0.0))).alias("value"))
    return scaled.unionByName(spfh).groupBy("pid", "bin").agg(F.sum("value").alias("value"))


def fpfh(cloud: DataFrame, param: Knn | Radius | Hybrid) -> DataFrame:
    """(pid, feat): 33 numbers for every point; zeros for a point without neighbours."""
    bins = fpfh_bins(cloud, param).groupBy("pid").agg(*[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("value"))), F.lit(0.0)).alias(f"f{i}") for i in range(3 * BINS)])
    zeros = F.array_repeat(F.lit(0.0), 3 * BINS)
    feat = bins.select("pid", F.array(*[f"f{i}" for i in range(3 * BINS)]).alias("feat"))
    return cloud.select("pid").join(feat, "pid", "left").select("pid", F.coalesce("feat", zeros).alias("feat"))


def match(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source_id, target_id): the nearest target feature of each source feature; both are (pid, feat)."""
    near = feature_knn(source.withColumnRenamed("pid", "qid"), target, 1)
    return near.select(F.col("qid").alias("source_id"), F.col("nid").alias("target_id"))


def correspondences(source: DataFrame, target: DataFrame, mutual_filter: bool = False, mutual_consistency_ratio: float = 0.1) -> DataFrame:
    """Nearest features; with the filter, those that hold both ways, unless too few do."""
    forth = match(source, target)
    if not mutual_filter:
        return forth
    forth = written(forth, "forth")
    back = match(target, source).select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"))
    both = written(forth.join(back, ["source_id", "target_id"], "left_semi"), "mutual")
    least = int(np.float32(mutual_consistency_ratio) * np.float32(source.count()))
    return both if both.count() >= least else forth


__all__ = ["with_pair_features", "spfh_bins", "fpfh_bins", "fpfh", "match", "correspondences", "lits"]
