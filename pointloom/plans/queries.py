"""The registered queries on clouds and, for those that SQL can express, the same in DuckDB's SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import rng
from pointloom.functions.rotation import get_rotation_matrix_from_xyz
from pointloom.functions.vec import NORMAL, XYZ
from pointloom.operators import bounds as B
from pointloom.operators import features as FE
from pointloom.operators import meshes as M
from pointloom.operators import neighbors as N
from pointloom.operators import normals as NO
from pointloom.operators import registration as R
from pointloom.operators import transforms as T
from pointloom.operators import voxels as V
from pointloom.plans import tables as C
from pointloom.plans.staging import new_path, put_bytes, written
from pointloom.sources import ply, xyz

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EMB, TGT = C.sql_embedded(), C.sql_embedded(C.SHIFT)
AFFINE = np.array([[0.5, -1.0, 0.25, 2.0], [1.5, 0.5, -0.75, -1.0], [0.25, 0.125, 2.0, 0.5], [0, 0, 0, 1.0]])
PROJECTIVE = np.array([[1.0, 0, 0, 0.5], [0, 1.0, 0, 0], [0, 0, 1.0, -0.5], [0.5, 0, 0, 0.125]])
QUARTER = np.array([[0, -1.0, 0], [1.0, 0, 0], [0, 0, 1.0]])
CENTER, CAMERA, REF = (0.5, -0.25, 1.0), (1.0, 2.0, -0.5), (1.0, -0.5, 0.25)
VOXEL_LINE, VOXEL_EMB, LINE_LOW = 8.0, 1 / 16, (0.0, 0.0, 0.0)
K, RADIUS, MAX_D = 10, 0.125, 0.2
MOVE = np.array([[1, 0, 0, C.SHIFT[0]], [0, 1, 0, C.SHIFT[1]], [0, 0, 1, C.SHIFT[2]], [0, 0, 0, 1.0]])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def num(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def sql_dot(row, names) -> str:
    return " + ".join(f"{num(v)} * {n}" for v, n in zip(row, names, strict=True))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds, and turns -0 into 0."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def sql_rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


# ---- bounds and boxes

_BOUNDS = "min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z"


@query(f"SELECT {_BOUNDS} FROM {C.SQL_LINES}")
def bounds(spark, sf_dir):
    return B.bounds(C.lines(spark, sf_dir))


@query(f"SELECT sum(x) / count(*) AS x, sum(y) / count(*) AS y, sum(z) / count(*) AS z FROM {C.SQL_LINES}")
def center(spark, sf_dir):
    return B.center(C.lines(spark, sf_dir))


@query(f"""WITH b AS (SELECT {_BOUNDS} FROM {C.SQL_LINES}), e AS (SELECT *, max_x - min_x AS ex, max_y - min_y AS ey, max_z - min_z AS ez FROM b)
SELECT ex AS extent_x, ey AS extent_y, ez AS extent_z, ex * 0.5 AS half_x, ey * 0.5 AS half_y, ez * 0.5 AS half_z, greatest(ex, ey, ez) AS max_extent, ex * ey * ez AS volume,
ex * ey * ez <= 1e-12 AS is_empty, (min_x + max_x) * 0.5 AS center_x, (min_y + max_y) * 0.5 AS center_y, (min_z + max_z) * 0.5 AS center_z FROM e""")
def aabb_props(spark, sf_dir):
    return B.box_properties(C.lines(spark, sf_dir))


@query(f"""WITH b AS (SELECT {_BOUNDS} FROM {EMB}), s(corner, a, b, c) AS (VALUES (0,0,0,0),(1,1,0,0),(2,0,1,0),(3,0,0,1),(4,1,1,0),(5,0,1,1),(6,1,0,1),(7,1,1,1))
SELECT corner, CASE s.a WHEN 1 THEN max_x ELSE min_x END AS x, CASE s.b WHEN 1 THEN max_y ELSE min_y END AS y, CASE s.c WHEN 1 THEN max_z ELSE min_z END AS z FROM b, s""")
def aabb_box_points(spark, sf_dir):
    return B.box_points(C.embedded(spark, sf_dir))


@query(f"SELECT pid, x, y, z FROM {EMB} WHERE x >= -0.1 - 1e-9 AND x <= 0.1 + 1e-9 AND y >= -0.05 - 1e-9 AND y <= 0.2 + 1e-9 AND z >= -0.15 - 1e-9 AND z <= 0.15 + 1e-9")
def aabb_filter(spark, sf_dir):
    return C.embedded(spark, sf_dir).where(B.inside((-0.1, -0.05, -0.15), (0.1, 0.2, 0.15)))


@query(f"SELECT {_BOUNDS} FROM (SELECT x, y, z FROM {EMB} UNION ALL SELECT x, y, z FROM {TGT})")
def aabb_merge(spark, sf_dir):
    return B.bounds(C.embedded(spark, sf_dir).unionByName(C.embedded(spark, sf_dir, C.SHIFT)))


# ---- row-wise maps


@query(f"SELECT pid, x + 0.5 AS x, y + (-0.25) AS y, z + 2.0 AS z FROM {EMB}")
def translate_rel(spark, sf_dir):
    return T.translate(C.embedded(spark, sf_dir), (0.5, -0.25, 2.0))


@query(f"WITH p AS (SELECT * FROM {EMB}), c AS (SELECT sum(x) / count(*) AS cx, sum(y) / count(*) AS cy, sum(z) / count(*) AS cz FROM p) SELECT pid, x + (1.0 - cx) AS x, y + (2.0 - cy) AS y, z + (3.0 - cz) AS z FROM p, c")
def translate_abs(spark, sf_dir):
    return T.translate(C.embedded(spark, sf_dir), (1.0, 2.0, 3.0), relative=False)


@query("SELECT pid, " + ", ".join(f"{num(c)} + ({n} - {num(c)}) * 2.5 AS {n}" for n, c in zip(XYZ, CENTER, strict=True)) + f" FROM {EMB}")
def scale(spark, sf_dir):
    return T.scale(C.embedded(spark, sf_dir), 2.5, CENTER)


_SHIFTED = f"(SELECT *, {', '.join(f'{n} - {num(c)} AS d{n}' for n, c in zip(XYZ, CENTER, strict=True))} FROM {EMB})"


@query(f"SELECT pid, {', '.join(f'{num(c)} + ({sql_dot(row, ("dx", "dy", "dz"))}) AS {n}' for n, c, row in zip(XYZ, CENTER, QUARTER, strict=True))}, {', '.join(f'{sql_dot(row, NORMAL)} AS {n}' for n, row in zip(NORMAL, QUARTER, strict=True))} FROM {_SHIFTED}")
def rotate_z90(spark, sf_dir):
    return T.rotate(C.embedded(spark, sf_dir, normals=True), QUARTER, CENTER)


@query(f"SELECT pid, {', '.join(f'{sql_dot(row[:3], XYZ)} + {num(row[3])} AS {n}' for n, row in zip(XYZ, AFFINE[:3], strict=True))} FROM {EMB}")
def transform_affine(spark, sf_dir):
    return T.transform_points(C.embedded(spark, sf_dir), AFFINE)


_W = f"{sql_dot(PROJECTIVE[3, :3], XYZ)} + {num(PROJECTIVE[3, 3])}"


@query(f"SELECT pid, {', '.join(f'CASE WHEN abs(w) > 1e-9 THEN ({sql_dot(row[:3], XYZ)} + {num(row[3])}) / w ELSE CAST({chr(39)}nan{chr(39)} AS DOUBLE) END AS {n}' for n, row in zip(XYZ, PROJECTIVE[:3], strict=True))} FROM (SELECT *, {_W} AS w FROM {EMB})")
def transform_projective(spark, sf_dir):
    return T.transform_points(C.embedded(spark, sf_dir), PROJECTIVE)


_INV_T = np.linalg.inv(AFFINE[:3, :3]).T
_UNIT = "sqrt(a * a + b * b + c * c)"


@query(f"WITH n AS (SELECT pid, {', '.join(f'{sql_dot(row, NORMAL)} AS {k}' for k, row in zip('abc', _INV_T, strict=True))} FROM {EMB}) SELECT pid, " + ", ".join(f"round(CASE WHEN {_UNIT} > 0 THEN {k} / {_UNIT} ELSE {k} END, 9) + 0.0 AS {n}" for k, n in zip("abc", NORMAL, strict=True)) + " FROM n")
def transform_normals(spark, sf_dir):
    return rounded(T.transform_normals(C.embedded(spark, sf_dir, normals=True), AFFINE), *NORMAL, digits=9).select("pid", *NORMAL)


_LEN = "sqrt(nx * nx + ny * ny + nz * nz)"


@query("SELECT pid, " + ", ".join(f"round(CASE WHEN {_LEN} > 0 THEN {n} / {_LEN} ELSE {n} END, 9) + 0.0 AS {n}" for n in NORMAL) + f" FROM {EMB}")
def normalize_normals(spark, sf_dir):
    return rounded(T.normalize_normals(C.embedded(spark, sf_dir, normals=True)), *NORMAL, digits=9).select("pid", *NORMAL)


@query(f"SELECT pid, CAST(0.25 AS DOUBLE) AS r, CAST(1.0 AS DOUBLE) AS g, CAST(0.0 AS DOUBLE) AS b FROM {EMB}")
def paint_clamped(spark, sf_dir):
    return T.paint_uniform_color(C.embedded(spark, sf_dir), (0.25, 1.5, -3.0)).select("pid", "r", "g", "b")


_AGAINST = sql_dot(REF, NORMAL)


@query(f"SELECT pid, {', '.join(f'CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN {num(v)} WHEN {_AGAINST} < 0 THEN {n} * -1.0 ELSE {n} END + 0.0 AS {n}' for n, v in zip(NORMAL, REF, strict=True))} FROM {EMB}")
def orient_direction(spark, sf_dir):
    out = T.orient_to_direction(C.embedded(spark, sf_dir, normals=True), REF)
    return out.select("pid", *[(F.col(n) + F.lit(0.0)).alias(n) for n in NORMAL])


@query(f"WITH c AS (SELECT *, {', '.join(f'{num(v)} - {n} AS c{n}' for n, v in zip(XYZ, CAMERA, strict=True))} FROM {EMB}), d AS (SELECT *, nx * cx + ny * cy + nz * cz AS along, sqrt(cx * cx + cy * cy + cz * cz) AS far FROM c) SELECT pid, " + ", ".join(f"CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN c{x} / far WHEN along < 0 THEN {n} * -1.0 ELSE {n} END + 0.0 AS {n}" for n, x in zip(NORMAL, XYZ, strict=True)) + " FROM d")
def orient_camera(spark, sf_dir):
    out = T.orient_to_camera(C.embedded(spark, sf_dir, normals=True), CAMERA)
    return out.select("pid", *[(F.col(n) + F.lit(0.0)).alias(n) for n in NORMAL])


_NAN, _INF = "CAST('nan' AS DOUBLE)", "CAST('inf' AS DOUBLE)"


@query(f"WITH d AS (SELECT pid, CASE WHEN pid % 7 = 0 THEN {_NAN} ELSE x END AS x, CASE WHEN pid % 11 = 0 THEN -{_INF} ELSE y END AS y, z FROM {EMB}) SELECT pid, x, y, z FROM d WHERE NOT isnan(x) AND abs(y) <> {_INF}")
def finite_filter(spark, sf_dir):
    return T.remove_non_finite(spoilt(spark, sf_dir))


# ---- voxels


def _sql_cells(table: str, size: float, origin: str | tuple) -> str:
    at = origin if isinstance(origin, tuple) else tuple(f"min_{n}" for n in XYZ)
    return ", ".join(f"CAST(floor(({n} - {o}) / {num(size)}) AS INT) AS v{n}" for n, o in zip(XYZ, at, strict=True))


_DOWN = "WITH p AS (SELECT * FROM {t}), o AS (SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z FROM p), v AS (SELECT *, {c} FROM p, o) "


@query(_DOWN.format(t=C.SQL_LINES, c=_sql_cells("", VOXEL_LINE, "")) + "SELECT sum(x) / count(*) AS x, sum(y) / count(*) AS y, sum(z) / count(*) AS z FROM v GROUP BY vx, vy, vz")
def voxel_downsample(spark, sf_dir):
    return V.down_sample(C.lines(spark, sf_dir), VOXEL_LINE).select(*XYZ)


@query(_DOWN.format(t=EMB, c=_sql_cells("", VOXEL_EMB, "")) + "SELECT sum(x) / count(*) AS x, sum(y) / count(*) AS y, sum(z) / count(*) AS z, sum(r) / count(*) AS r, sum(g) / count(*) AS g, sum(b) / count(*) AS b FROM v GROUP BY vx, vy, vz")
def voxel_color_mean(spark, sf_dir):
    return V.down_sample(C.embedded(spark, sf_dir, colors=True), VOXEL_EMB).select(*XYZ, "r", "g", "b")


_VN = "sqrt(a * a + b * b + c * c)"


@query(_DOWN.format(t=EMB, c=_sql_cells("", VOXEL_EMB, "")) + ", m AS (SELECT sum(x) / count(*) AS x, sum(y) / count(*) AS y, sum(z) / count(*) AS z, sum(nx) / count(*) AS a, sum(ny) / count(*) AS b, sum(nz) / count(*) AS c FROM v GROUP BY vx, vy, vz) SELECT x, y, z, " + ", ".join(f"round(CASE WHEN {_VN} > 0 THEN {k} / {_VN} ELSE {k} END, 9) + 0.0 AS {n}" for k, n in zip("abc", NORMAL, strict=True)) + " FROM m")
def voxel_normal_mean(spark, sf_dir):
    return rounded(V.down_sample(C.embedded(spark, sf_dir, normals=True), VOXEL_EMB).select(*XYZ, *NORMAL), *NORMAL, digits=9)


_LOW, _HIGH = (-0.25, -0.25, -0.25), (0.25, 0.125, 0.25)


@query(f"SELECT DISTINCT {_sql_cells('', VOXEL_EMB, tuple(map(num, _LOW)))} FROM {EMB} WHERE {' AND '.join(f'{n} >= {num(a)} AND {n} < {num(b)}' for n, a, b in zip(XYZ, _LOW, _HIGH, strict=True))}")
def voxel_occupied(spark, sf_dir):
    return V.occupied(C.embedded(spark, sf_dir), VOXEL_EMB, _LOW, _HIGH)


_GRID = f"WITH p AS (SELECT * FROM {EMB}), o AS (SELECT {', '.join(f'min({n}) - {VOXEL_EMB * 0.5} AS min_{n}' for n in XYZ)} FROM p), v AS (SELECT DISTINCT {_sql_cells('', VOXEL_EMB, '')}, min_x, min_y, min_z FROM p, o) "


@query(_GRID + "SELECT " + ", ".join(f"any_value(min_{n}) + min(v{n}) * {num(VOXEL_EMB)} AS min_{n}, any_value(min_{n}) + (max(v{n}) + 1) * {num(VOXEL_EMB)} AS max_{n}" for n in XYZ) + " FROM v")
def voxel_grid_bounds(spark, sf_dir):
    voxels, origin = V.grid_of(C.embedded(spark, sf_dir), VOXEL_EMB)
    return V.grid_bounds(voxels, origin, VOXEL_EMB)


@query(_GRID + "SELECT " + ", ".join(f"sum(min_{n} + (v{n} + CAST(0.5 AS DOUBLE)) * {num(VOXEL_EMB)}) / count(*) AS {n}" for n in XYZ) + " FROM v")
def voxel_grid_center(spark, sf_dir):
    voxels, origin = V.grid_of(C.embedded(spark, sf_dir), VOXEL_EMB)
    return V.grid_center(voxels, origin, VOXEL_EMB)


# ---- neighbour search

_D2 = "(q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) + (q.z - t.z) * (q.z - t.z)"


def sql_pairs(q: str, t: str, where: str = "TRUE") -> str:
    return f"SELECT q.pid AS qid, t.pid AS nid, {_D2} AS d2 FROM {q} q, {t} t WHERE {where}"


def sql_ranked(pairs: str, most: int | None = None) -> str:
    inner = f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, nid) AS rank, nid, d2 FROM ({pairs})"
    return f"SELECT qid, rank, nid, d2 FROM ({inner})" + ("" if most is None else f" WHERE rank <= {most}")


def _q(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("pid", "qid")


@query(sql_ranked(sql_pairs(EMB, TGT), K))
def knn3(spark, sf_dir):
    return N.knn_join(_q(C.embedded(spark, sf_dir)), C.embedded(spark, sf_dir, C.SHIFT), K)


@query(sql_ranked(sql_pairs(EMB, EMB), K))
def knn_self(spark, sf_dir):
    return N.self_search(C.embedded(spark, sf_dir), N.Knn(K))


@query(sql_ranked(sql_pairs(EMB, EMB), 4))
def knn_rings(spark, sf_dir):
    """The growing rings, at any size."""
    cloud = C.embedded(spark, sf_dir)
    return N.knn_join(_q(cloud), cloud, 4, small=0)


_SPOILT = f"(SELECT pid, CASE WHEN pid % 7 = 0 THEN {_NAN} ELSE x END AS x, CASE WHEN pid % 11 = 0 THEN -{_INF} ELSE y END AS y, z FROM {EMB})"
_SOUND = f"(SELECT * FROM {_SPOILT} WHERE NOT isnan(x) AND abs(y) <> {_INF})"


def spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh x is NaN, every eleventh y infinite."""
    return C.embedded(spark, sf_dir).withColumns({"x": F.when(F.col("pid") % 7 == 0, float("nan")).otherwise(F.col("x")), "y": F.when(F.col("pid") % 11 == 0, float("-inf")).otherwise(F.col("y"))})


@query(f"SELECT way, qid, rank, nid, d2 FROM ({sql_ranked(sql_pairs(_SOUND, _SOUND), 7)}), (VALUES ('loop'), ('rings')) AS w(way)")
def knn_odd(spark, sf_dir):
    """Points that aren't finite have no neighbours, whichever way they are searched."""
    cloud = spoilt(spark, sf_dir)
    loop, rings = (N.knn_join(_q(cloud), cloud, 7, small=n).withColumn("way", F.lit(way)) for way, n in (("loop", 10**12), ("rings", 0)))
    return loop.unionByName(rings).select("way", "qid", "rank", "nid", "d2")


@query(sql_ranked(sql_pairs(_SOUND, _SOUND, f"{_D2} < {num(RADIUS)} * {num(RADIUS)}"), 5))
def hybrid_odd(spark, sf_dir):
    return N.self_search(spoilt(spark, sf_dir), N.Hybrid(RADIUS, 5))


@query(sql_ranked(sql_pairs(EMB, EMB, f"{_D2} < {num(RADIUS)} * {num(RADIUS)}")))
def radius(spark, sf_dir):
    return N.self_search(C.embedded(spark, sf_dir), N.Radius(RADIUS))


@query(sql_ranked(sql_pairs(C.SQL_EVENTS, C.SQL_EVENTS, f"q.x > t.x - 3 AND q.x < t.x + 3 AND {_D2} < 9.0")))
def radius_grid(spark, sf_dir):
    return N.self_search(C.events(spark, sf_dir), N.Radius(3.0))


@query(sql_ranked(sql_pairs(EMB, TGT, f"{_D2} < {num(MAX_D)} * {num(MAX_D)}"), 5))
def hybrid(spark, sf_dir):
    return N.hybrid_join(_q(C.embedded(spark, sf_dir)), C.embedded(spark, sf_dir, C.SHIFT), MAX_D, 5)


_NN1 = f"SELECT qid, nid, d2 FROM ({sql_ranked(sql_pairs(EMB, TGT, f'{_D2} < {num(MAX_D)} * {num(MAX_D)}'), 1)})"


@query(_NN1)
def nn1(spark, sf_dir):
    return N.nearest_within(_q(C.embedded(spark, sf_dir)), C.embedded(spark, sf_dir, C.SHIFT), MAX_D)


def sql_feature_pairs(a: int, b: int) -> str:
    d2 = "list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda e: (CAST(e[1] AS DOUBLE) - CAST(e[2] AS DOUBLE)) * (CAST(e[1] AS DOUBLE) - CAST(e[2] AS DOUBLE))))"
    return f"SELECT q.pid AS qid, t.pid AS nid, {d2} AS d2 FROM {C.sql_features(a)} q, {C.sql_features(b)} t"


@query(f"SELECT qid, rank, nid, round(d2, 6) + 0.0 AS d2 FROM ({sql_ranked(sql_feature_pairs(0, 1), 5)})")
def knn64(spark, sf_dir):
    return rounded(N.feature_knn(_q(C.features(spark, sf_dir, 0)), C.features(spark, sf_dir, 1), 5), "d2")


@query(f"SELECT qid, rank, nid, round(d2, 6) + 0.0 AS d2 FROM ({sql_ranked(sql_feature_pairs(0, 1), 5)})")
def knn64_blocks(spark, sf_dir):
    """The same in many blocks."""
    return rounded(N.feature_knn(_q(C.features(spark, sf_dir, 0)), C.features(spark, sf_dir, 1), 5, block=128, held=0), "d2")


# ---- normals

SQL_COV = """SELECT qid, count(*) AS n, sum(t.x * t.x) / count(*) - (sum(t.x) / count(*)) * (sum(t.x) / count(*)) AS c00,
sum(t.x * t.y) / count(*) - (sum(t.x) / count(*)) * (sum(t.y) / count(*)) AS c01, sum(t.x * t.z) / count(*) - (sum(t.x) / count(*)) * (sum(t.z) / count(*)) AS c02,
sum(t.y * t.y) / count(*) - (sum(t.y) / count(*)) * (sum(t.y) / count(*)) AS c11, sum(t.y * t.z) / count(*) - (sum(t.y) / count(*)) * (sum(t.z) / count(*)) AS c12,
sum(t.z * t.z) / count(*) - (sum(t.z) / count(*)) * (sum(t.z) / count(*)) AS c22 FROM ({pairs}) f JOIN {cloud} t ON f.nid = t.pid GROUP BY qid"""


@query("SELECT qid, n, c00, c01, c02, c11, c12, c22 FROM (" + SQL_COV.format(pairs=sql_ranked(sql_pairs(EMB, EMB), 20), cloud=EMB) + ")")
def covariance(spark, sf_dir):
    cloud = C.embedded(spark, sf_dir)
    return NO.covariances(N.self_search(cloud, N.Knn(20)).select("qid", "nid"), cloud)


def sql_normals(pairs: str, cloud: str) -> str:
    """The closed-form smallest eigenvector as a chain of projections: (qid, nx, ny, nz)."""
    return f"""WITH c AS ({SQL_COV.format(pairs=pairs, cloud=cloud)}),
m AS (SELECT *, greatest(abs(c00), abs(c01), abs(c02), abs(c11), abs(c12), abs(c22)) AS top FROM c),
s AS (SELECT qid, n, top, c00 / top AS a, c01 / top AS b, c02 / top AS c, c11 / top AS d, c12 / top AS e, c22 / top AS f FROM m),
q AS (SELECT *, b * b + c * c + e * e AS off, (a + (d + f)) / 3.0 AS q FROM s),
p AS (SELECT *, sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + off * 2.0) / 6.0) AS p FROM q),
h AS (SELECT *, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (p * p * p) * 0.5 AS half FROM p),
g AS (SELECT *, acos(greatest(-1.0, least(1.0, half))) / 3.0 AS angle FROM h),
l AS (SELECT *, q + p * least(cos(angle + {2 * math.pi / 3!r}) * 2.0, -(cos(angle + {2 * math.pi / 3!r}) * 2.0 + cos(angle) * 2.0), cos(angle) * 2.0) AS low FROM g),
x AS (SELECT *, b * e - c * (d - low) AS u0, c * b - (a - low) * e AS u1, (a - low) * (d - low) - b * b AS u2,
b * (f - low) - c * e AS v0, c * c - (a - low) * (f - low) AS v1, (a - low) * e - b * c AS v2,
(d - low) * (f - low) - e * e AS w0, e * c - b * (f - low) AS w1, b * e - (d - low) * c AS w2 FROM l),
k AS (SELECT *, u0 * u0 + u1 * u1 + u2 * u2 AS du, v0 * v0 + v1 * v1 + v2 * v2 AS dv, w0 * w0 + w1 * w1 + w2 * w2 AS dw FROM x)
SELECT qid, {", ".join(f"CASE WHEN n < 3 THEN {z} WHEN dw > du AND dw > dv THEN w{i} / sqrt(dw) WHEN dv > du THEN v{i} / sqrt(dv) ELSE u{i} / sqrt(du) END AS n{k}" for i, (k, z) in enumerate(zip("xyz", ("0.0", "0.0", "1.0"), strict=True)))} FROM k"""


_KNN20 = sql_ranked(sql_pairs(EMB, EMB), 20)
_SQL_FAST = sql_normals(_KNN20, EMB)


@query(f"SELECT qid AS pid, {sql_rounded(*NORMAL)} FROM ({_SQL_FAST})")
def normals_fast(spark, sf_dir):
    return rounded(NO.estimate(C.embedded(spark, sf_dir), N.Knn(20)), *NORMAL).select("pid", *NORMAL)


@query(f"SELECT p.pid, {', '.join(f'round(CASE WHEN s.nx * p.nx + s.ny * p.ny + s.nz * p.nz < 0 THEN -s.{n} ELSE s.{n} END, 6) + 0.0 AS {n}' for n in NORMAL)} FROM ({_SQL_FAST}) s JOIN {EMB} p ON s.qid = p.pid")
def normals_prior(spark, sf_dir):
    return rounded(NO.estimate(C.embedded(spark, sf_dir, normals=True), N.Knn(20)), *NORMAL).select("pid", *NORMAL)


_SQL_HYBRID = sql_normals(sql_ranked(sql_pairs(EMB, EMB, f"{_D2} < {num(0.25)} * {num(0.25)}"), 25), EMB)
_FEW = f"SELECT p.pid, {', '.join(f'round(coalesce(s.{n}, {z}), 6) + 0.0 AS {n}' for n, z in zip(NORMAL, ('0.0', '0.0', '1.0'), strict=True))} FROM {EMB} p LEFT JOIN (SELECT * FROM ({_SQL_HYBRID}) WHERE NOT isnan(nx)) s ON s.qid = p.pid"


@query(_FEW)
def normals_hybrid(spark, sf_dir):
    return rounded(NO.estimate(C.embedded(spark, sf_dir), N.Hybrid(0.25, 25)), *NORMAL).select("pid", *NORMAL)


@query(f"SELECT qid AS pid, {', '.join(f'round(abs({n}), 5) + 0.0 AS {n}' for n in NORMAL)} FROM ({_SQL_FAST})")
def normals_slow(spark, sf_dir):
    """By the iterative solver; compared without the sign, which is the solver's."""
    out = NO.estimate(C.embedded(spark, sf_dir), N.Knn(20), fast=False)
    return out.select("pid", *[(F.round(F.abs(n), 5) + F.lit(0.0)).alias(n) for n in NORMAL])


# ---- features

UNIT = f"(SELECT pid, x, y, z, x / sqrt(x * x + y * y + z * z) AS nx, y / sqrt(x * x + y * y + z * z) AS ny, z / sqrt(x * x + y * y + z * z) AS nz FROM {EMB})"


def _radial(spark, sf_dir) -> DataFrame:
    """Normals that point away from the origin."""
    cloud = C.embedded(spark, sf_dir)
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return cloud.withColumns({n: F.try_divide(F.col(c), far) for n, c in zip(NORMAL, XYZ, strict=True)})


_KNN15 = sql_ranked(sql_pairs(EMB, EMB), 15)
SQL_PAIR = f"""f AS (SELECT qid, rank, nid, d2, count(*) OVER (PARTITION BY qid) AS k FROM ({_KNN15})),
j AS (SELECT qid, nid, k, b.x - a.x AS lx, b.y - a.y AS ly, b.z - a.z AS lz, a.nx AS mx, a.ny AS my, a.nz AS mz, b.nx AS ox, b.ny AS oy, b.nz AS oz FROM f JOIN {UNIT} a ON f.qid = a.pid JOIN {UNIT} b ON f.nid = b.pid WHERE rank > 1),
g AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS d FROM j),
h AS (SELECT *, greatest(-1.0, least(1.0, (mx * lx + my * ly + mz * lz) / d)) AS a1, greatest(-1.0, least(1.0, (ox * lx + oy * ly + oz * lz) / d)) AS a2 FROM g),
o AS (SELECT qid, nid, k, d, CASE WHEN abs(a1) < abs(a2) THEN -a2 ELSE a1 END AS theta, {", ".join(f"CASE WHEN abs(a1) < abs(a2) THEN o{c} ELSE m{c} END AS s{c}, CASE WHEN abs(a1) < abs(a2) THEN m{c} ELSE o{c} END AS t{c}, CASE WHEN abs(a1) < abs(a2) THEN l{c} * -1.0 ELSE l{c} END AS w{c}" for c in "xyz")} FROM h),
v AS (SELECT *, wy * sz - wz * sy AS p0, wz * sx - wx * sz AS p1, wx * sy - wy * sx AS p2 FROM o),
vn AS (SELECT *, sqrt(p0 * p0 + p1 * p1 + p2 * p2) AS vn FROM v),
u AS (SELECT *, p0 / vn AS v0, p1 / vn AS v1, p2 / vn AS v2 FROM vn),
pf AS (SELECT qid, nid, k, CASE WHEN d = 0 OR vn = 0 THEN 0.0 ELSE atan2((sy * v2 - sz * v1) * tx + (sz * v0 - sx * v2) * ty + (sx * v1 - sy * v0) * tz, sx * tx + sy * ty + sz * tz) END AS alpha,
CASE WHEN d = 0 OR vn = 0 THEN 0.0 ELSE v0 * tx + v1 * ty + v2 * tz END AS phi, CASE WHEN d = 0 OR vn = 0 THEN 0.0 ELSE theta END AS theta, CASE WHEN d = 0 OR vn = 0 THEN 0.0 ELSE d END AS d FROM u)"""


def _clamped(x: str, add: int) -> str:
    return f"CAST(greatest(0, least(10, floor({x}))) AS INT) + {add}"


SQL_SPFH = f"""b AS (SELECT qid, k, unnest([{_clamped(f"11.0 * (alpha + {math.pi!r}) / {2 * math.pi!r}", 0)}, {_clamped("11.0 * (phi + 1.0) * 0.5", 11)}, {_clamped("11.0 * (theta + 1.0) * 0.5", 22)}]) AS bin FROM pf),
spfh AS (SELECT qid AS pid, bin, count(*) * 100.0::DOUBLE / any_value(k - 1) AS value FROM b GROUP BY qid, bin)"""


@query(f"WITH {SQL_PAIR} SELECT qid, nid, {sql_rounded('alpha', 'phi', 'theta', 'd')} FROM pf")
def pair_features(spark, sf_dir):
    cloud = _radial(spark, sf_dir)
    pairs = FE.with_pair_features(FE.neighbour_pairs(N.self_search(cloud, N.Knn(15)), cloud))
    return rounded(pairs.select("qid", "nid", *FE.PAIR), *FE.PAIR)


@query(f"WITH {SQL_PAIR}, {SQL_SPFH} SELECT pid, bin, {sql_rounded('value')} FROM spfh")
def spfh(spark, sf_dir):
    cloud = _radial(spark, sf_dir)
    return rounded(FE.spfh_bins(N.self_search(cloud, N.Knn(15)), cloud), "value")


@query(f"""WITH {SQL_PAIR}, {SQL_SPFH}, w AS (SELECT f.qid, s.bin, sum(s.value / f.d2) AS v FROM f JOIN spfh s ON f.nid = s.pid WHERE rank > 1 AND d2 <> 0 GROUP BY f.qid, s.bin),
sc AS (SELECT qid AS pid, bin, v * (100.0 / sum(v) OVER (PARTITION BY qid, bin // 11)) AS value FROM w)
SELECT pid, bin, round(sum(value), 6) + 0.0 AS value FROM (SELECT pid, bin, value FROM sc UNION ALL SELECT pid, bin, value FROM spfh) GROUP BY pid, bin""")
def fpfh(spark, sf_dir):
    return rounded(FE.fpfh_bins(_radial(spark, sf_dir), N.Knn(15)), "value")


_FORTH = f"SELECT qid AS source_id, nid AS target_id FROM ({sql_ranked(sql_feature_pairs(0, 1), 1)})"
_BACK = f"SELECT nid AS source_id, qid AS target_id FROM ({sql_ranked(sql_feature_pairs(1, 0), 1)})"


@query(_FORTH)
def feature_match(spark, sf_dir):
    return FE.match(C.features(spark, sf_dir, 0), C.features(spark, sf_dir, 1))


@query(f"SELECT a.source_id, a.target_id FROM ({_FORTH}) a JOIN ({_BACK}) b USING (source_id, target_id)")
def feature_mutual(spark, sf_dir):
    return FE.correspondences(C.features(spark, sf_dir, 0), C.features(spark, sf_dir, 1), mutual_filter=True)


@query(_FORTH)
def feature_mutual_fallback(spark, sf_dir):
    """A ratio that mutual pairs can't reach gives all pairs."""
    return FE.correspondences(C.features(spark, sf_dir, 0), C.features(spark, sf_dir, 1), mutual_filter=True, mutual_consistency_ratio=1.0)


# ---- registration

_INLIERS = f"SELECT qid AS source_id, nid AS target_id, d2 FROM ({_NN1})"
_PAIRED = f"SELECT c.source_id, c.target_id, s.x AS sx, s.y AS sy, s.z AS sz, t.x AS tx, t.y AS ty, t.z AS tz, s.nx AS snx, s.ny AS sny, s.nz AS snz, t.nx AS tnx, t.ny AS tny, t.nz AS tnz FROM ({_INLIERS}) c JOIN {EMB} s ON c.source_id = s.pid JOIN {TGT} t ON c.target_id = t.pid"


def _pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return C.embedded(spark, sf_dir, normals=True), C.embedded(spark, sf_dir, C.SHIFT, normals=True)


def _pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, t = _pair(spark, sf_dir)
    return s, t, R.inliers(s, t, MAX_D, np.eye(4)).select("source_id", "target_id")


_EVAL = "SELECT count(*) AS n_inlier, count(*) / CAST((SELECT count(*) FROM {all}) AS DOUBLE) AS fitness, round(sqrt(sum(d2) / count(*)), 9) AS inlier_rmse FROM ({pairs})"


@query(_EVAL.format(all="embeddings", pairs=_INLIERS))
def evaluate_registration(spark, sf_dir):
    return R.evaluation(*_pair(spark, sf_dir), MAX_D).withColumn("inlier_rmse", F.round("inlier_rmse", 9))


@query(f"SELECT source_id, target_id FROM ({_INLIERS})")
def evaluate_correspondences(spark, sf_dir):
    return _pairs(spark, sf_dir)[2]


@query(f"SELECT round(sqrt(sum((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty) + (sz - tz) * (sz - tz)) / count(*)), 9) AS rmse FROM ({_PAIRED})")
def rmse_p2p(spark, sf_dir):
    return R.rmse(*_pairs(spark, sf_dir)).select(F.round("rmse", 9).alias("rmse"))


@query(f"SELECT round(sqrt(sum(r * r) / count(*)), 9) AS rmse FROM (SELECT (sx - tx) * tnx + (sy - ty) * tny + (sz - tz) * tnz AS r FROM ({_PAIRED}))")
def rmse_p2l(spark, sf_dir):
    return R.rmse(*_pairs(spark, sf_dir), R.Estimation(plane=True)).select(F.round("rmse", 9).alias("rmse"))


@query("SELECT CAST(count(*) AS DOUBLE) AS n, " + ", ".join(f"sum({k}{c}) AS {k}{i}" for k in "st" for i, c in enumerate("xyz")) + ", " + ", ".join(f"sum(t{a} * s{b}) AS ts{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz")) + f", sum(sx * sx + sy * sy + sz * sz) AS ss FROM ({_PAIRED})")
def umeyama_moments(spark, sf_dir):
    return R.paired(*_pairs(spark, sf_dir)).agg(*R.point_moments())


_J = f"SELECT sy * tnz - sz * tny AS j0, sz * tnx - sx * tnz AS j1, sx * tny - sy * tnx AS j2, tnx AS j3, tny AS j4, tnz AS j5, (sx - tx) * tnx + (sy - ty) * tny + (sz - tz) * tnz AS r FROM ({_PAIRED})"


@query("SELECT " + ", ".join(f"round(sum(j{a} * j{b}), 9) + 0.0 AS a{a}{b}" for a in range(6) for b in range(a, 6)) + ", " + ", ".join(f"round(sum(j{i} * r), 9) + 0.0 AS b{i}" for i in range(6)) + f" FROM ({_J})")
def p2l_normal_equations(spark, sf_dir):
    out = R.paired(*_pairs(spark, sf_dir)).agg(*R.plane_sums())
    return rounded(out, *out.columns, digits=9)


@query("SELECT CAST(count(*) AS DOUBLE) AS n, sum(tx) AS x, sum(ty) AS y, sum(tz) AS z, sum(tx * tx) AS xx, sum(ty * ty) AS yy, sum(tz * tz) AS zz, sum(tx * ty) AS xy, sum(tx * tz) AS xz, sum(ty * tz) AS yz " + f"FROM ({_PAIRED})")
def info_matrix(spark, sf_dir):
    return R.paired(*_pairs(spark, sf_dir)).agg(*R.information_sums())


@query(f"SELECT bool_and(ds >= dt * 0.81 AND dt >= ds * 0.81) AS passed FROM (SELECT {' + '.join(f'(a.s{c} - b.s{c}) * (a.s{c} - b.s{c})' for c in 'xyz')} AS ds, {' + '.join(f'(a.t{c} - b.t{c}) * (a.t{c} - b.t{c})' for c in 'xyz')} AS dt FROM ({_PAIRED}) a JOIN ({_PAIRED}) b ON a.source_id < b.source_id)")
def check_edge_length(spark, sf_dir):
    return R.edge_length_check(*_pairs(spark, sf_dir), 0.9)


@query(f"SELECT bool_and((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty) + (sz - tz) * (sz - tz) <= 0.04) AS passed FROM ({_PAIRED})")
def check_distance(spark, sf_dir):
    return R.distance_check(*_pairs(spark, sf_dir), 0.2)


@query(f"SELECT bool_and(NOT tnx * snx + tny * sny + tnz * snz < {math.cos(1.5)!r}) AS passed FROM ({_PAIRED})")
def check_normal(spark, sf_dir):
    return R.normal_check(*_pairs(spark, sf_dir), 1.5)


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_invalid FROM (SELECT source_id * 3 AS source_id FROM ({_INLIERS})) WHERE source_id NOT IN (SELECT vec_id FROM embeddings)")
def validate_correspondences(spark, sf_dir):
    s, _, p = _pairs(spark, sf_dir)
    spread = p.select((F.col("source_id") * 3).alias("source_id"))
    return spread.join(s.select(F.col("pid").alias("source_id")), "source_id", "left_anti").agg(F.count("*").alias("n_invalid"))


_EVERY = "(SELECT count(*) // 100 FROM embeddings)"


@query(f"SELECT count(*) AS n_inlier, count(*) / CAST((SELECT count(*) FROM embeddings WHERE vec_id % {_EVERY} = 0) AS DOUBLE) AS fitness, round(sqrt(sum(d2) / count(*)), 9) AS inlier_rmse FROM ({_INLIERS}) WHERE source_id % {_EVERY} = 0")
def sampled_fitness(spark, sf_dir):
    return R.sampled_fitness(*_pair(spark, sf_dir), MAX_D, most=100).withColumn("inlier_rmse", F.round("inlier_rmse", 9))


@query(f"SELECT count(*) FILTER ((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty) + (sz - tz) * (sz - tz) < 0.0025) / CAST(count(*) AS DOUBLE) AS ratio FROM ({_PAIRED})")
def inlier_ratio(spark, sf_dir):
    return R.inlier_ratio(*_pairs(spark, sf_dir), 0.05)


def _matrix_rows(spark: SparkSession, m: np.ndarray, digits: int = 7) -> DataFrame:
    rows = [(i, j, float(round(m[i, j], digits) + 0.0)) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, v double")


_KNOWN = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {num(round(MOVE[i, j], 7))})" for i in range(4) for j in range(4)) + ") AS t(i, j, v)"


@query(_KNOWN)
def icp_p2p_transform(spark, sf_dir):
    """Recovers the known shift between the clouds."""
    return _matrix_rows(spark, R.icp(*_pair(spark, sf_dir), MAX_D).transformation)


@query(_KNOWN)
def icp_p2l(spark, sf_dir):
    """Recovers the known shift along the targets' normals."""
    s, t = C.embedded(spark, sf_dir), NO.estimate(C.embedded(spark, sf_dir, C.SHIFT), N.Knn(20))
    return _matrix_rows(spark, R.icp(s, t, MAX_D, estimation=R.Estimation(plane=True)).transformation)


@query(_KNOWN)
def ransac_correspondence(spark, sf_dir):
    """True pairs and, for every third point, a wrong one."""
    rng.seed(7)
    s, t = _pair(spark, sf_dir)
    n = s.count()
    pairs = s.select(F.col("pid").alias("source_id"), F.when(F.col("pid") % 3 == 0, (F.col("pid") * 7 + 1) % n).otherwise(F.col("pid")).alias("target_id"))
    found = R.ransac(s.drop(*NORMAL), t.drop(*NORMAL), pairs, 0.05, checkers=[R.EdgeLength(0.9), R.Distance(0.05)], criteria=R.RansacCriteria(1000, 0.999))
    return _matrix_rows(spark, found.transformation)


@query(_KNOWN)
def ransac_feature(spark, sf_dir):
    """The descriptors don't see the shift: they match each point to its own, and the motion is the known one."""
    rng.seed(11)
    s = NO.estimate(C.embedded(spark, sf_dir), N.Knn(15))
    t = NO.estimate(C.embedded(spark, sf_dir, C.SHIFT), N.Knn(15))
    pairs = FE.correspondences(written(FE.fpfh(s, N.Knn(25)), "fs"), written(FE.fpfh(t, N.Knn(25)), "ft"), mutual_filter=True)
    found = R.ransac(s, t, written(pairs, "pairs"), 0.075, checkers=[R.Distance(0.075)], criteria=R.RansacCriteria(500, 0.999))
    return _matrix_rows(spark, found.transformation)


# ---- meshes and rotations

_CORNERS = f"SELECT t.tid, t.v0, t.v1, t.v2, b.x - a.x AS e0, b.y - a.y AS e1, b.z - a.z AS e2, c.x - a.x AS f0, c.y - a.y AS f1, c.z - a.z AS f2 FROM {C.SQL_TRIANGLES} t LEFT JOIN {EMB} a ON t.v0 = a.pid LEFT JOIN {EMB} b ON t.v1 = b.pid LEFT JOIN {EMB} c ON t.v2 = c.pid"
_FACES = f"SELECT tid, v0, v1, v2, coalesce(e1 * f2 - e2 * f1, 0.0) AS nx, coalesce(e2 * f0 - e0 * f2, 0.0) AS ny, coalesce(e0 * f1 - e1 * f0, 0.0) AS nz FROM ({_CORNERS})"


@query(f"SELECT tid, v0, v1, v2, {', '.join(f'round(CASE WHEN {_LEN} > 0 THEN {n} / {_LEN} ELSE {n} END, 9) + 0.0 AS {n}' for n in NORMAL)} FROM ({_FACES})")
def triangle_normals(spark, sf_dir):
    return rounded(M.triangle_normals(*C.mesh(spark, sf_dir)), *NORMAL, digits=9)


@query(f"SELECT p.pid AS vid, {', '.join(f'coalesce(sum(f.{n}), 0.0) + 0.0 AS {n}' for n in NORMAL)} FROM {EMB} p LEFT JOIN (SELECT unnest([v0, v1, v2]) AS v, nx, ny, nz FROM ({_FACES})) f ON f.v = p.pid GROUP BY p.pid")
def vertex_normals(spark, sf_dir):
    out = M.vertex_normals(*C.mesh(spark, sf_dir), normalized=False)
    return out.select("vid", *[(F.col(n) + F.lit(0.0)).alias(n) for n in NORMAL])


@query(f"SELECT {_BOUNDS} FROM {EMB}")
def mesh_bounds(spark, sf_dir):
    return B.bounds(C.mesh(spark, sf_dir)[0])


_ROT = get_rotation_matrix_from_xyz((0.25, -0.5, 1.0))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, round({e}, 9) + 0.0)" for (i, j), e in {
    (0, 0): "cos(-0.5) * cos(1.0)", (0, 1): "-cos(-0.5) * sin(1.0)", (0, 2): "sin(-0.5)",
    (1, 0): "cos(0.25) * sin(1.0) + sin(0.25) * sin(-0.5) * cos(1.0)", (1, 1): "cos(0.25) * cos(1.0) - sin(0.25) * sin(-0.5) * sin(1.0)", (1, 2): "-sin(0.25) * cos(-0.5)",
    (2, 0): "sin(0.25) * sin(1.0) - cos(0.25) * sin(-0.5) * cos(1.0)", (2, 1): "sin(0.25) * cos(1.0) + cos(0.25) * sin(-0.5) * sin(1.0)", (2, 2): "cos(0.25) * cos(-0.5)",
}.items()) + ") AS t(i, j, v)")
def rotation_xyz(spark, sf_dir):
    return _matrix_rows(spark, _ROT, 9)


# ---- sources

_LINE = "printf('%.10f %.10f %.10f', x, y, z)"


@query(f"SELECT pid, {_LINE} AS line FROM {EMB}")
def xyz_format(spark, sf_dir):
    return xyz.formatted(C.embedded(spark, sf_dir))


@query(f"SELECT pid, CAST(printf('%.10f', x) AS DOUBLE) AS x, CAST(printf('%.10f', y) AS DOUBLE) AS y, CAST(printf('%.10f', z) AS DOUBLE) AS z FROM {EMB} WHERE pid % 5 <> 0")
def xyz_parse(spark, sf_dir):
    """Lines with text behind the numbers, and every fifth with none in front."""
    lines = xyz.formatted(C.embedded(spark, sf_dir))
    return xyz.parse(lines.select("pid", F.when(F.col("pid") % 5 == 0, F.concat(F.lit("# "), "line")).otherwise(F.concat(F.lit("  "), "line", F.lit("abc 7"))).alias("value")))


@query(f"SELECT pid, x, y, z, nx, ny, nz FROM {EMB}")
def ply_roundtrip(spark, sf_dir):
    """Binary PLY written to the shared folder and read back through Spark, vertex for vertex."""
    cloud = C.embedded(spark, sf_dir, normals=True).orderBy("pid").toPandas()
    path = new_path(spark, "cloud") + ".ply"
    put_bytes(spark, path, ply.encode({c: cloud[c].to_numpy() for c in (*XYZ, *NORMAL)}))
    return ply.read(spark, path).select("pid", *XYZ, *NORMAL)


from pointloom.plans import interface  # noqa: E402, F401  # registers its queries beside these
