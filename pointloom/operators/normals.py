"""Surface normals: neighbour join, covariance sums per point, smallest eigenvector, orientation."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vec import NORMAL, XYZ, cross, dot, has, lits, norm2, over, select_when, times, vec, with_vec
from pointloom.operators.neighbors import Hybrid, Knn, Radius, knn_join, self_search
from pointloom.plans.staging import written

COV = ("c00", "c01", "c02", "c11", "c12", "c22")


def covariances(pairs: DataFrame, cloud: DataFrame) -> DataFrame:
    """(qid, n, c00 .. c22): population covariance of each query's neighbours, as E[xy] - E[x]E[y]."""
    points = cloud.select(F.col("pid").alias("nid"), *XYZ)
    n = F.count(F.lit(1))
    products = {"xx": ("x", "x"), "xy": ("x", "y"), "xz": ("x", "z"), "yy": ("y", "y"), "yz": ("y", "z"), "zz": ("z", "z")}
    sums = pairs.join(points, "nid").groupBy("qid").agg(
        n.alias("n"), *[(F.sum(c) / n).alias(f"m{c}") for c in XYZ], *[(F.sum(F.col(a) * F.col(b)) / n).alias(f"m{k}") for k, (a, b) in products.items()]
    )
    cov = [(F.col(f"m{k}") - F.col(f"m{a}") * F.col(f"m{b}")).alias(c) for c, (k, (a, b)) in zip(COV, products.items(), strict=True)]
    return sums.select("qid", F.col("n").cast("long").alias("n"), *cov)


def with_fast_normal(cov: DataFrame) -> DataFrame:
    """Adds nx, ny, nz: the eigenvector of the smallest eigenvalue, in closed form; zero where it is undefined.

    Column expressions alone, in steps that Catalyst keeps apart because each is used several times.
    """
    top = F.greatest(*[F.abs(c) for c in COV])
    d = cov.withColumn("top", top).withColumns({c: F.try_divide(c, "top") for c in COV})
    c00, c01, c02, c11, c12, c22 = (F.col(c) for c in COV)
    d = d.withColumn("off", c01 * c01 + c02 * c02 + c12 * c12).withColumn("q", (c00 + (c11 + c22)) / 3.0)
    d = d.withColumns({"b0": c00 - F.col("q"), "b1": c11 - F.col("q"), "b2": c22 - F.col("q")})
    b0, b1, b2 = F.col("b0"), F.col("b1"), F.col("b2")
    d = d.withColumn("p", F.sqrt((b0 * b0 + b1 * b1 + b2 * b2 + F.col("off") * 2.0) / 6.0))
    det = b0 * (b1 * b2 - c12 * c12) - c01 * (c01 * b2 - c12 * c02) + c02 * (c01 * c12 - b1 * c02)
    half = F.try_divide(det, F.col("p") * F.col("p") * F.col("p")) * 0.5
    d = d.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3.0)
    d = d.withColumns({"e2": F.cos("angle") * 2.0, "e0": F.cos(F.col("angle") + F.lit(2.0 * math.pi / 3.0)) * 2.0})
    d = d.withColumn("low", F.col("q") + F.col("p") * F.least(F.col("e0"), -(F.col("e0") + F.col("e2")), F.col("e2")))
    low = F.col("low")
    rows = ((c00 - low, c01, c02), (c01, c11 - low, c12), (c02, c12, c22 - low))
    crossed = {"u": cross(rows[0], rows[1]), "v": cross(rows[0], rows[2]), "w": cross(rows[1], rows[2])}
    d = d.withColumns({f"{k}{i}": x for k, v in crossed.items() for i, x in enumerate(v)})
    of = {k: vec([f"{k}{i}" for i in range(3)]) for k in crossed}
    d = d.withColumns({f"d{k}": norm2(v) for k, v in of.items()})
    du, dv, dw = F.col("du"), F.col("dv"), F.col("dw")
    unit = {k: over(v, F.sqrt(f"d{k}")) for k, v in of.items()}
    best = select_when((dw > du) & (dw > dv), unit["w"], select_when(dv > du, unit["v"], unit["u"]))
    general = select_when((F.greatest(du, dv, dw) <= 1e-16) | (F.col("p") < 1e-16), lits([0, 0, 0]), best)
    axis = select_when((c00 <= c11) & (c00 <= c22), lits([1, 0, 0]), select_when((c11 <= c00) & (c11 <= c22), lits([0, 1, 0]), lits([0, 0, 1])))
    n = select_when(F.col("top") == 0, lits([0, 0, 0]), select_when(F.col("off") > 1e-16, general, axis))
    return with_vec(d, NORMAL, n).select(*cov.columns, *NORMAL)


def with_slow_normal(cov: DataFrame) -> DataFrame:
    """Adds nx, ny, nz by LAPACK's symmetric solver, many rows at a time; zero where it fails. Their sign is the solver's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in COV}
            m = np.stack([c[k] for k in ("c00", "c01", "c02", "c01", "c11", "c12", "c02", "c12", "c22")], 1).reshape(-1, 3, 3)
            good = np.isfinite(m).all((1, 2))
            out = np.zeros((len(m), 3))
            if good.any():
                out[good] = np.linalg.eigh(m[good])[1][:, :, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out.T)], [*batch.schema.names, *NORMAL])

    return cov.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in cov.dtypes) + ", nx double, ny double, nz double")


def estimate(cloud: DataFrame, param: Knn | Radius | Hybrid = Knn(30), fast: bool = True) -> DataFrame:
    """``cloud`` with nx, ny, nz from its neighbourhoods. Fewer than 3 neighbours, or no direction: (0, 0, 1).

    Normals that the cloud already has decide the sign.
    """
    found = self_search(cloud, param).select("qid", "nid")
    cov = written(covariances(found, cloud).where("n >= 3"), "covariances")
    solved = (with_fast_normal if fast else with_slow_normal)(cov)
    own = solved.select(F.col("qid").alias("pid"), *[F.col(c).alias(f"own_{c}") for c in NORMAL])
    out = cloud.join(own, "pid", "left")
    n = vec([f"own_{c}" for c in NORMAL])
    length = norm2(n)
    none = length.isNull() | F.isnan(length) | (F.sqrt(length) < 1e-9)
    n = select_when(none, lits([0, 0, 1]), n)
    if has(cloud, NORMAL):
        against = dot(n, vec(NORMAL))
        n = select_when((against < 0) & ~F.isnan(against), times(n, F.lit(-1.0)), n)
    names = cloud.columns + [c for c in NORMAL if c not in cloud.columns]
    return with_vec(out, NORMAL, n).select(*names)


class _Sets:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def spanning_tree(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest; equal weights keep their order."""
    sets = _Sets(n)
    return [(int(a[e]), int(b[e])) for e in np.argsort(weight, kind="stable") if sets.join(int(a[e]), int(b[e]))]


def _bridges(points: np.ndarray, tree: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The shortest pairs that connect what the neighbour graph left apart, one component after another."""
    n, out = len(points), []
    sets = _Sets(n)
    for a, b in tree:
        sets.join(a, b)
    while True:
        root = sets.roots()
        outside = np.flatnonzero(root != root[0])
        if not len(outside):
            return out
        mine = np.flatnonzero(root == root[outside[0]])
        others = np.flatnonzero(root != root[outside[0]])
        best = None
        for v in mine:
            d2 = ((points[others] - points[v]) ** 2).sum(1)
            u = int(np.argmin(d2))
            if best is None or (d2[u], v, others[u]) < best:
                best = (d2[u], v, others[u])
        out.append((int(best[1]), int(best[2])))
        sets.join(*out[-1])


def oriented(points: np.ndarray, normals: np.ndarray, edges: np.ndarray, ranks: np.ndarray, k: int, penalty: float, tolerance: float) -> np.ndarray:
    """Signs made consistent along a spanning tree of the neighbour graph. ``edges``: (from, to), ``ranks`` from 1."""
    n, normals = len(points), normals.copy()
    a, b = edges.T
    diff = points[b] - points[a]
    d2 = (diff**2).sum(1)
    along = np.abs((diff * normals[a]).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        keep = (a != b) & ~(along / np.sqrt(d2) > tolerance)
    near = spanning_tree(a[keep], b[keep], (d2 + penalty * along)[keep], n)
    near += _bridges(points, near)
    again = keep & (ranks <= k)
    u = np.concatenate([np.array([e[0] for e in near], int), a[again]])
    v = np.concatenate([np.array([e[1] for e in near], int), b[again]])
    tree = spanning_tree(u, v, 1 - np.abs((normals[u] * normals[v]).sum(1)), n)
    beside: list[list[int]] = [[] for _ in range(n)]
    for p, q in tree:
        beside[p].append(q)
        beside[q].append(p)
    start = int(np.argmin(np.where(np.isnan(points[:, 2]), np.inf, points[:, 2])))
    if normals[start, 2] > 0:
        normals[start] *= -1
    seen, queue = np.zeros(n, bool), deque([start])
    seen[start] = True
    while queue:
        p = queue.popleft()
        for q in beside[p]:
            if not seen[q]:
                seen[q] = True
                if normals[p] @ normals[q] < 0:
                    normals[q] *= -1
                queue.append(q)
    return normals


#: Points of one cloud that a task holds with their neighbours.
MOST_POINTS = 2_000_000


def orient_consistently(cloud: DataFrame, k: int, penalty: float = 0.0, tolerance: float = 1.0) -> DataFrame:
    """Normals with consistent signs: neighbours by a distributed join, then one spanning tree for each cloud.

    Trees are serial by nature. Clouds are told apart by the column cloud_id, where there is one: their neighbours are found
    by one search, and they are oriented in parallel, each in one task; one cloud must fit into a task's memory, so
    clouds of more than ``MOST_POINTS`` points, counted first, are refused.
    """
    if not has(cloud, NORMAL):
        raise RuntimeError("No normals in the PointCloud. Call estimate_normals() first.")
    by = ["cloud_id"] if "cloud_id" in cloud.columns else []
    most = cloud.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if most > MOST_POINTS:
        raise ValueError(f"a cloud of {most} points; orient parts of at most {MOST_POINTS}")
    keyed = cloud.select(F.struct(*by, "pid").alias("pid"), *by, *XYZ)
    found = knn_join(keyed.withColumnRenamed("pid", "qid"), keyed, max(k, 2), by=by)
    lists = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("nid.pid").alias("nid")))).alias("near"))
    joined = cloud.withColumn("_key", F.struct(*by, "pid")).join(lists.withColumnRenamed("qid", "_key"), "_key", "left").drop("_key")
    whole = joined.groupBy(*(by or [F.lit(0).alias("one")]))
    names = cloud.columns

    def run(pdf):
        pdf = pdf.sort_values("pid", ignore_index=True)
        at = {p: i for i, p in enumerate(pdf["pid"])}
        pairs = [(i, at[e["nid"]], e["rank"]) for i, near in enumerate(pdf["near"]) for e in (near if near is not None else ())]
        table = np.array(pairs, int).reshape(-1, 3)
        pdf[list(NORMAL)] = oriented(pdf[list(XYZ)].to_numpy(float), pdf[list(NORMAL)].to_numpy(float), table[:, :2], table[:, 2], k, penalty, tolerance)
        return pdf[names]

    return whole.applyInPandas(run, cloud.schema)
