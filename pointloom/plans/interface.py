"""Registered queries on the interface: files, boxes, grids, trees, rotations, number texts and value classes.

Small answers are tables of texts or numbers; the SQL has them from the same tables, or as fixed values where the input is fixed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import geometry as G
from pointloom import io, utility
from pointloom.functions import formatting, rng, rotation
from pointloom.functions.solve import point_to_plane
from pointloom.functions.vec import NORMAL, XYZ
from pointloom.operators import normals as NO
from pointloom.operators import registration as R
from pointloom.pipelines import registration as P
from pointloom.plans import tables as C
from pointloom.plans.queries import _GRID, EMB, VOXEL_EMB, num, query, rounded, sql_feature_pairs, sql_ranked
from pointloom.plans.staging import new_path, put_bytes
from pointloom.sources import ply


def _texts(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


def _values(rows: Sequence[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows) + ") AS t(name, value)"


def _matrix(spark: SparkSession, name: str, m: np.ndarray) -> DataFrame:
    rows = [(name, i, j, round(float(m[i, j]), 9) + 0.0) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "name string, i int, j int, v double")


def fails(fn: Callable, *errors: type[BaseException]) -> bool:
    try:
        fn()
    except errors:
        return True
    return False


# ---- files

_NAMES = (("a.ply", "auto"), ("b/c.XYZ", "auto"), ("no_extension", "auto"), ("d.tar.ply", "auto"), ("e.ply", "xyz"), ("f.xyz", "mem::xyz"))


@query(_values([("a.ply auto", "ply"), ("b/c.XYZ auto", "xyz"), ("no_extension auto", ""), ("d.tar.ply auto", "ply"), ("e.ply xyz", "xyz"), ("f.xyz mem::xyz", "mem::xyz")]))
def file_formats(spark, sf_dir):
    return _texts(spark, [(f"{name} {kind}", io.format_from_filename(name, kind)) for name, kind in _NAMES])


_G = {c: f"CAST(printf('%g', {c}) AS DOUBLE) AS {c}" for c in (*XYZ, *NORMAL)}


@query(f"SELECT pid, {', '.join(_G.values())} FROM {EMB}")
def ply_ascii(spark, sf_dir):
    """Written as text with six digits, and read back."""
    path = new_path(spark, "cloud") + ".ply"
    assert io.write_point_cloud(path, G.PointCloud(C.embedded(spark, sf_dir, normals=True)), write_ascii=True)
    return io.read_point_cloud(spark, path, strict=True).df.select("pid", *XYZ, *NORMAL)


@query(f"SELECT pid, x, y, z FROM {EMB}")
def ply_big_endian(spark, sf_dir):
    """Binary, most significant byte first, behind an element that is passed over."""
    points = G.PointCloud(C.embedded(spark, sf_dir)).points
    head = f"ply\nformat binary_big_endian 1.0\nelement camera 2\nproperty int a\nproperty list uchar short b\nelement vertex {len(points)}\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
    passed = b"".join(np.array([7], ">i4").tobytes() + bytes([n]) + np.arange(n, dtype=">i2").tobytes() for n in (3, 0))
    path = new_path(spark, "cloud") + ".ply"
    put_bytes(spark, path, head.encode() + passed + points.astype(">f8").tobytes())
    return io.read_point_cloud(spark, path, strict=True).df.select("pid", *XYZ)


_FIXED = ", ".join(f"CAST(printf('%.10f', {c}) AS DOUBLE) AS {c}" for c in XYZ)


@query(f"SELECT way, pid, {_FIXED} FROM {EMB}, (VALUES ('bytes'), ('file')) AS w(way)")
def xyz_files(spark, sf_dir):
    """Through a file and through bytes."""
    cloud, path = G.PointCloud(C.embedded(spark, sf_dir)), new_path(spark, "cloud") + ".xyz"
    assert io.write_point_cloud(path, cloud)
    ways = {"file": io.read_point_cloud(spark, path, strict=True), "bytes": io.read_point_cloud_from_bytes(spark, io.write_point_cloud_to_bytes(cloud, "mem::xyz"), "mem::xyz")}
    both = [x.df.select(F.lit(way).alias("way"), "pid", *XYZ) for way, x in ways.items()]
    return both[0].unionByName(both[1])


_SOUND_FACES = f"(SELECT * FROM {C.SQL_TRIANGLES} WHERE v0 < (SELECT count(*) FROM embeddings) AND v1 < (SELECT count(*) FROM embeddings) AND v2 < (SELECT count(*) FROM embeddings))"


@query(f"SELECT way, CAST(row_number() OVER (PARTITION BY way ORDER BY tid) - 1 AS BIGINT) AS tid, v0, v1, v2 FROM {_SOUND_FACES}, (VALUES ('ascii'), ('binary')) AS w(way)")
def mesh_faces(spark, sf_dir):
    """Triangles written and read in both forms."""
    vertices, triangles = C.mesh(spark, sf_dir)
    n, out = vertices.count(), []
    mesh = G.TriangleMesh(vertices, triangles.where((F.col("v0") < n) & (F.col("v1") < n) & (F.col("v2") < n)))
    for way in ("ascii", "binary"):
        path = new_path(spark, "mesh") + ".ply"
        assert io.write_triangle_mesh(path, mesh, write_ascii=way == "ascii")
        out.append(io.read_triangle_mesh(spark, path, strict=True).triangle_df.select(F.lit(way).alias("way"), "tid", "v0", "v1", "v2"))
    return out[0].unionByName(out[1])


@query(f"SELECT vid, x, y, z FROM (SELECT pid AS vid, x, y, z FROM {EMB})")
def mesh_vertices(spark, sf_dir):
    path = new_path(spark, "mesh") + ".ply"
    vertices, triangles = C.mesh(spark, sf_dir)
    assert io.write_triangle_mesh(path, G.TriangleMesh(vertices, triangles.limit(0)))
    return io.read_triangle_mesh(spark, path, strict=True).df.select("vid", *XYZ)


@query("SELECT p_partkey AS tid, CAST(4 AS BIGINT) AS n, (p_partkey % 7 + 2) * 2.0::DOUBLE + 1.0::DOUBLE * (p_partkey % 5 + 1) AS area FROM part")
def ear_clipping(spark, sf_dir):
    """L-shaped polygons of six corners, as wide and high as the part's number says: four triangles each, of the same area."""
    keys = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").collect())
    out = []
    for key in keys:
        wide, high = key % 7 + 2.0, key % 5 + 1.0
        ring = np.array([(0, 0, 0), (wide, 0, 0), (wide, 2, 0), (1, 2, 0), (1, 2 + high, 0), (0, 2 + high, 0)])
        t = ring[np.array(ply.triangulate(ring, list(range(6))))]
        out.append((key, len(t), float(np.abs(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])[:, 2]).sum() / 2)))
    return spark.createDataFrame(out, "tid long, n long, area double")


@query(_values([("cloud.ply", 1), ("empty.ply", 0), ("mesh.ply", 4), ("missing.ply", 0), ("other.obj", 0), ("points.xyz", 1)]))
def geometry_types(spark, sf_dir):
    folder = new_path(spark, "types")
    vertices, triangles = C.mesh(spark, sf_dir)
    n = vertices.count()
    faces = triangles.where((F.col("v0") < n) & (F.col("v1") < n) & (F.col("v2") < n))
    put_bytes(spark, f"{folder}/empty.ply", b"ply\nformat ascii 1.0\nelement vertex 0\nproperty double x\nend_header\n")
    io.write_point_cloud(f"{folder}/cloud.ply", G.PointCloud(C.embedded(spark, sf_dir)))
    io.write_triangle_mesh(f"{folder}/mesh.ply", G.TriangleMesh(vertices, faces))
    return _texts(spark, [(x, int(io.read_file_geometry_type(f"{folder}/{x}"))) for x in ("cloud.ply", "empty.ply", "mesh.ply", "missing.ply", "other.obj", "points.xyz")])


# ---- what clouds, grids and boxes say of themselves


@query("SELECT count(*) > 0 AS has_points, count(*) > 0 AS has_normals, false AS has_colors, count(*) = 0 AS is_empty, CAST(count(*) AS VARCHAR) AS n, true AS cleared, CAST(1 AS BIGINT) AS kind, CAST(3 AS BIGINT) AS dimension FROM embeddings")
def cloud_predicates(spark, sf_dir):
    cloud = G.PointCloud(C.embedded(spark, sf_dir, normals=True))
    n = repr(cloud).removeprefix("PointCloud with ").removesuffix(" points.")
    row = (cloud.has_points(), cloud.has_normals(), cloud.has_colors(), cloud.is_empty(), n, cloud.clear().is_empty(), int(cloud.get_geometry_type()), cloud.dimension())
    return spark.createDataFrame([row], "has_points boolean, has_normals boolean, has_colors boolean, is_empty boolean, n string, cleared boolean, kind long, dimension long")


def _bounds_rows(spark: SparkSession, named: dict) -> DataFrame:
    rows = [(k, *map(float, low), *map(float, high)) for k, (low, high) in named.items()]
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"{m}_{c} double" for m in ("min", "max") for c in XYZ))


_SIZE = num(VOXEL_EMB)


def _sql_grid(name: str, origin: str, size: str) -> str:
    """``origin`` has {c} for the axis."""
    low = ", ".join(f"{origin.format(c=c)} + l{c} * {size} AS min_{c}" for c in XYZ)
    high = ", ".join(f"{origin.format(c=c)} + (h{c} + 1) * {size} AS max_{c}" for c in XYZ)
    return f"SELECT '{name}' AS name, {low}, {high} FROM g"


@query(f"WITH g AS (SELECT * FROM ({_GRID} SELECT {', '.join(f'any_value(min_{c}) AS o{c}, min(v{c}) AS l{c}, max(v{c}) AS h{c}' for c in XYZ)} FROM v)) "
       + " UNION ALL ".join([_sql_grid("relative", "(o{c} + 0.5)", _SIZE), _sql_grid("absolute", "CAST(0.25 AS DOUBLE)", _SIZE), _sql_grid("scaled", "(1.0 + 2.0 * (o{c} - 1.0))", f"({_SIZE} * 2.0)"), _sql_grid("transformed", "(o{c} - 0.125)", _SIZE), _sql_grid("rotated", "o{c}", _SIZE)]))
def grid_moves(spark, sf_dir):
    """Moving a grid moves its origin; it can be turned by nothing but the identity."""
    grid = G.VoxelGrid.create_from_point_cloud(G.PointCloud(C.embedded(spark, sf_dir)), VOXEL_EMB)
    shift = np.eye(4)
    shift[:3, 3] = -0.125
    named = {"relative": grid.translate((0.5, 0.5, 0.5)), "absolute": grid.translate((0.25, 0.25, 0.25), relative=False), "scaled": grid.scale(2.0, (1.0, 1.0, 1.0)), "transformed": grid.transform(shift), "rotated": grid.rotate(np.eye(3))}
    return _bounds_rows(spark, {k: (g.get_min_bound(), g.get_max_bound()) for k, g in named.items()})


@query("SELECT printf('Voxel(grid_index=%d %d %d, color=0.5 0.5 0.5)', vx, vy, vz) AS voxel FROM (SELECT DISTINCT vx, vy, vz FROM (" + _GRID + "SELECT vx, vy, vz FROM v))")
def voxel_texts(spark, sf_dir):
    grid = G.VoxelGrid.create_from_point_cloud(G.PointCloud(C.embedded(spark, sf_dir)), VOXEL_EMB)
    return spark.createDataFrame([(repr(v),) for v in grid.get_voxels()], "voxel string")


_BOX = f"(SELECT {', '.join(f'min({c}) AS low_{c}, max({c}) AS high_{c}, (min({c}) + max({c})) * 0.5 AS mid_{c}' for c in XYZ)} FROM {EMB})"


def _sql_box(name: str, low: str, high: str) -> str:
    return f"SELECT '{name}' AS name, " + ", ".join(f"{low.format(c=c)} AS min_{c}" for c in XYZ) + ", " + ", ".join(f"{high.format(c=c)} AS max_{c}" for c in XYZ) + f" FROM {_BOX}"


@query(" UNION ALL ".join([_sql_box("points", "low_{c}", "high_{c}"), _sql_box("swapped", "low_{c}", "high_{c}"), _sql_box("relative", "low_{c} + 0.5", "high_{c} + 0.5"), _sql_box("absolute", "low_{c} + (1.0 - mid_{c})", "high_{c} + (1.0 - mid_{c})"), _sql_box("scaled", "0.25 + 2.0 * (low_{c} - 0.25)", "0.25 + 2.0 * (high_{c} - 0.25)")]))
def box_moves(spark, sf_dir):
    """From points, from corners in the wrong order, moved and scaled."""
    points = G.PointCloud(C.embedded(spark, sf_dir)).points
    box = G.AxisAlignedBoundingBox.create_from_points(points)
    named = {"points": box, "swapped": G.AxisAlignedBoundingBox(box.max_bound, box.min_bound), "relative": box.translate((0.5,) * 3), "absolute": box.translate((1.0,) * 3, relative=False), "scaled": box.scale(2.0, (0.25,) * 3)}
    return _bounds_rows(spark, {k: (b.get_min_bound(), b.get_max_bound()) for k, b in named.items()})


@query(f"SELECT 'info' AS name, printf('AxisAlignedBoundingBox: min: (%.4f, %.4f, %.4f), max: (%.4f, %.4f, %.4f)', low_x, low_y, low_z, high_x, high_y, high_z) AS value FROM {_BOX}")
def box_text(spark, sf_dir):
    return _texts(spark, [("info", G.PointCloud(C.embedded(spark, sf_dir)).get_axis_aligned_bounding_box().get_print_info())])


@query(_values([("box rotate", True), ("box transform", True), ("grid rotate", True), ("grid transform", True), ("no normals to orient", True), ("quaternion of zeros", True)]))
def refusals(spark, sf_dir):
    """What isn't defined raises."""
    cloud = G.PointCloud(C.embedded(spark, sf_dir))
    box, grid = cloud.get_axis_aligned_bounding_box(), G.VoxelGrid.create_from_point_cloud(cloud, VOXEL_EMB)
    turn = rotation.get_rotation_matrix_from_xyz((0.1, 0, 0))
    turned = np.eye(4)
    turned[:3, :3] = turn
    tries = {"box rotate": lambda: box.rotate(turn), "box transform": lambda: box.transform(turned), "grid rotate": lambda: grid.rotate(turn), "grid transform": lambda: grid.transform(turned), "no normals to orient": lambda: cloud.orient_normals_consistent_tangent_plane(3), "quaternion of zeros": lambda: rotation.get_rotation_matrix_from_quaternion((0, 0, 0, 0))}
    return _texts(spark, [(k, fails(fn, RuntimeError, ValueError)) for k, fn in tries.items()])


# ---- trees, params, orientation

_XD = f"SELECT CAST(rank AS INT) AS rank, nid, round(d2, 6) AS d2 FROM ({sql_ranked(sql_feature_pairs(0, 1))}) WHERE qid = (SELECT min(vec_id) FROM embeddings WHERE vec_id % 2 = 0) AND d2 < {{r}} * {{r}}"


@query(f"SELECT 'radius' AS way, * FROM ({_XD.format(r=num(1.3))}) UNION ALL SELECT 'hybrid', * FROM ({_XD.format(r=num(1.4))}) WHERE rank <= 3 UNION ALL SELECT 'knn', * FROM ({_XD.format(r=num(1e9))}) WHERE rank <= 4")
def search_xd(spark, sf_dir):
    """Searches of one feature by radius, by both and by number, in a tree over features."""
    tree, asked = G.KDTreeFlann(C.features(spark, sf_dir, 1)), C.features(spark, sf_dir, 0).orderBy("pid").first()["feat"]
    found = {"radius": tree.search_radius_vector_xd(asked, 1.3), "hybrid": tree.search_hybrid_vector_xd(asked, 1.4, 3), "knn": tree.search_knn_vector_xd(asked, 4)}
    rows = [(way, i + 1, nid, round(d2, 6)) for way, (_, ids, far) in found.items() for i, (nid, d2) in enumerate(zip(ids, far, strict=True))]
    return spark.createDataFrame(rows, "way string, rank int, nid long, d2 double")


@query("SELECT vec_id AS nid, CAST(row_number() OVER (ORDER BY d2, vec_id) AS INT) AS rank, d2 FROM (SELECT vec_id, " + " + ".join(f"(floor(CAST(embedding[{i}] AS DOUBLE) * 4096) / 4096.0 - {num(v)}) * (floor(CAST(embedding[{i}] AS DOUBLE) * 4096) / 4096.0 - {num(v)})" for i, v in ((1, 0.25), (2, -0.5), (3, 0.0))) + " AS d2 FROM embeddings) QUALIFY rank <= 5")
def search_matrix(spark, sf_dir):
    """A matrix of one column a point as the tree's data."""
    tree = G.KDTreeFlann()
    tree.set_matrix_data(spark, G.PointCloud(C.embedded(spark, sf_dir)).points.T)
    _, ids, far = tree.search_knn_vector_xd((0.25, -0.5, 0.0), 5)
    return spark.createDataFrame([(int(n), i + 1, float(d)) for i, (n, d) in enumerate(zip(ids, far, strict=True))], "nid long, rank int, d2 double")


_SLOPE = (0.25, 0.5)
_UP = 1 / math.sqrt(1 + _SLOPE[0] ** 2 + _SLOPE[1] ** 2)


@query(f"SELECT pid, round({num(_SLOPE[0] * _UP)}, 9) AS nx, round({num(_SLOPE[1] * _UP)}, 9) AS ny, round({num(-_UP)}, 9) AS nz FROM {EMB}")
def orient_tangent_plane(spark, sf_dir):
    """A sloping plane whose normals point up or down by turns: all come to point down."""
    flat = C.embedded(spark, sf_dir).withColumn("z", F.expr(f"{_SLOPE[0]!r}D * x + {_SLOPE[1]!r}D * y"))
    sign = F.when(F.col("pid") % 2 == 0, 1.0).otherwise(-1.0)
    cloud = flat.select("pid", *XYZ, *[(sign * v).alias(n) for n, v in zip(NORMAL, (-_SLOPE[0] * _UP, -_SLOPE[1] * _UP, _UP), strict=True)])
    return rounded(NO.orient_consistently(cloud, 12), *NORMAL, digits=9).select("pid", *NORMAL)


@query("SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 1 AS BIGINT) AS b FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)")
def spanning_chain(spark, sf_dir):
    """Neighbours in a row are linked cheaply, every second one dearly: the tree is the row."""
    keys = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect())
    edges = [(i, i + 2, 2.5) for i in range(len(keys) - 2)] + [(i, i + 1, 1.0 + i / 100) for i in range(len(keys) - 1)]
    a, b, w = (np.array(x) for x in zip(*edges, strict=True))
    tree = NO.spanning_tree(a, b, w, len(keys))
    return spark.createDataFrame([(int(keys[i]), int(keys[j])) for i, j in tree], "a long, b long")


_PARAMS = [("hybrid", "KDTreeSearchParamHybrid(radius=0.5, max_nn=9)"), ("knn", "KDTreeSearchParamKNN(knn=30)"), ("radius", "KDTreeSearchParamRadius(radius=0.25)")]


@query(_values(_PARAMS))
def search_params(spark, sf_dir):
    return _texts(spark, [("hybrid", repr(G.KDTreeSearchParamHybrid(0.5, 9))), ("knn", repr(G.KDTreeSearchParamKNN())), ("radius", repr(G.KDTreeSearchParamRadius(0.25)))])


# ---- registration


@query(_values([("copied", "[0.0, 0.0, 0.0, 0.0]"), ("dimension", 33), ("negative sizes", True), ("num", 4), ("of a table", 32), ("text", "Feature class with dimension = 33 and num = 4\nAccess its data via data member.")]))
def feature_class(spark, sf_dir):
    f = P.Feature()
    f.resize(33, 4)
    table = P.Feature(spark.createDataFrame([(0, [0.0] * 32)], "pid long, feat array<double>"))
    return _texts(spark, [("copied", f.to_numpy()[0].tolist()), ("dimension", f.dimension()), ("negative sizes", fails(lambda: f.resize(-1, 2), ValueError)), ("num", f.num()), ("of a table", table.dimension()), ("text", repr(f))])


_X = (0.02, -0.03, 0.05, 0.25, -0.5, 1.0)


@query("SELECT 'motion' AS name, i, j, round(v, 9) + 0.0 AS v FROM (VALUES " + ", ".join(f"({i}, {j}, {e})" for (i, j), e in {
    (0, 0): "cos(0.05) * cos(-0.03)", (0, 1): "cos(0.05) * sin(-0.03) * sin(0.02) - sin(0.05) * cos(0.02)", (0, 2): "cos(0.05) * sin(-0.03) * cos(0.02) + sin(0.05) * sin(0.02)", (0, 3): "0.25",
    (1, 0): "sin(0.05) * cos(-0.03)", (1, 1): "sin(0.05) * sin(-0.03) * sin(0.02) + cos(0.05) * cos(0.02)", (1, 2): "sin(0.05) * sin(-0.03) * cos(0.02) - cos(0.05) * sin(0.02)", (1, 3): "-0.5",
    (2, 0): "-sin(-0.03)", (2, 1): "cos(-0.03) * sin(0.02)", (2, 2): "cos(-0.03) * cos(0.02)", (2, 3): "1.0", (3, 0): "0.0", (3, 1): "0.0", (3, 2): "0.0", (3, 3): "1.0",
}.items()) + ") AS t(i, j, v)")
def solve_normal_equations(spark, sf_dir):
    """Sums over the cloud make a system whose answer is known: turns about x, y and z, and a shift."""
    rows = C.embedded(spark, sf_dir, normals=True).select(*[(F.col(b) * F.col(c) - F.col(e) * F.col(d)).alias(f"j{i}") for i, (b, c, d, e) in enumerate((("y", "nz", "ny", "z"), ("z", "nx", "nz", "x"), ("x", "ny", "nx", "y")))], *[F.col(n).alias(f"j{i + 3}") for i, n in enumerate(NORMAL)])
    sums = rows.agg(*[F.sum(F.col(f"j{a}") * F.col(f"j{b}")).alias(f"a{a}{b}") for a in range(6) for b in range(a, 6)]).first().asDict()
    a = np.array([[sums[f"a{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
    return _matrix(spark, "motion", point_to_plane(a, -a @ np.array(_X)))


@query(_values([("1", 3499211612), ("10000", 4123659995)]))
def random_engine(spark, sf_dir):
    """The first and the ten-thousandth number of the standard engine under its usual seed."""
    before = rng.snapshot()
    rng.seed(5489)
    numbers = [int(rng.engine()._bit_generator.random_raw()) for _ in range(10_000)]
    rng.restore(before)
    return _texts(spark, [("1", numbers[0]), ("10000", numbers[-1])])


@query(_values([
    ("alignment", "[False, True, False]"), ("distance", "CorrespondenceCheckerBasedOnDistance with distance_threshold=0.500000"), ("edge", "CorrespondenceCheckerBasedOnEdgeLength with similarity_threshold=0.900000"),
    ("icp", "ICPConvergenceCriteria(relative_fitness=1.000000e-06, relative_rmse=1.000000e-06, max_iteration=30)"), ("normal", "CorrespondenceCheckerBasedOnNormal with normal_threshold=0.100000"),
    ("plane", "TransformationEstimationPointToPlane"), ("point", "TransformationEstimationPointToPoint(with_scaling=True)"), ("ransac", "RANSACConvergenceCriteria(max_iteration=100000, confidence=9.990000e-01)"),
    ("result", "RegistrationResult with fitness=0.000000e+00, inlier_rmse=0.000000e+00, and correspondence_set size of 0\nAccess transformation to get result."),
]))
def value_classes(spark, sf_dir):
    edge, far, turn = P.CorrespondenceCheckerBasedOnEdgeLength(), P.CorrespondenceCheckerBasedOnDistance(0.5), P.CorrespondenceCheckerBasedOnNormal(0.1)
    rows = {"alignment": [c.require_pointcloud_alignment_ for c in (edge, far, turn)], "distance": far, "edge": edge, "icp": P.ICPConvergenceCriteria(), "normal": turn, "plane": P.TransformationEstimationPointToPlane(), "point": P.TransformationEstimationPointToPoint(True), "ransac": P.RANSACConvergenceCriteria(), "result": P.RegistrationResult()}
    return _texts(spark, [(k, v if isinstance(v, list) else repr(v)) for k, v in rows.items()])


@query(f"SELECT n, n_inlier / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS fitness FROM (SELECT 0 AS n, CAST(0 AS BIGINT) AS n_inlier UNION ALL SELECT 1, count(*) FROM {EMB} WHERE TRUE)")
def better_result(spark, sf_dir):
    """Of a motion far away and the true one, scored in one job, the true one has all points."""
    cloud = C.embedded(spark, sf_dir)
    away = np.eye(4)
    away[:3, 3] = 1e4
    met = R.score_hypotheses(cloud, cloud, 0.01, {0: away, 1: np.eye(4)})
    return spark.createDataFrame([(n, met.get(n, (0, 0.0))[0] / cloud.count()) for n in (0, 1)], "n int, fitness double")


# ---- rotations and number texts

_ANGLES = (0.25, -0.5, 1.0)
_AXES = {
    "x": lambda a: {(0, 0): "1.0", (1, 1): f"cos({a})", (1, 2): f"-sin({a})", (2, 1): f"sin({a})", (2, 2): f"cos({a})"},
    "y": lambda a: {(0, 0): f"cos({a})", (0, 2): f"sin({a})", (1, 1): "1.0", (2, 0): f"-sin({a})", (2, 2): f"cos({a})"},
    "z": lambda a: {(0, 0): f"cos({a})", (0, 1): f"-sin({a})", (1, 0): f"sin({a})", (1, 1): f"cos({a})", (2, 2): "1.0"},
}
_ORDERS = ("yzx", "zxy", "xzy", "zyx", "yxz")


def _sql_turns() -> str:
    """Products of axis rotations as joins of (i, j, v) tables."""
    rows = [f"('{order}', {k}, {i}, {j}, {v})" for order in _ORDERS for k, (axis, angle) in enumerate(zip(order, _ANGLES, strict=True)) for (i, j), v in _AXES[axis](angle).items()]
    rows += [f"('{order}', {k}, {i}, {j}, 0.0)" for order in _ORDERS for k, axis in enumerate(order) for i in range(3) for j in range(3) if (i, j) not in _AXES[axis](0)]
    return f"WITH m(name, k, i, j, v) AS (VALUES {', '.join(rows)}) SELECT a.name, a.i, c.j, round(sum(a.v * b.v * c.v), 9) + 0.0 AS v FROM m a JOIN m b ON a.name = b.name AND a.k = 0 AND b.k = 1 AND a.j = b.i JOIN m c ON c.name = b.name AND c.k = 2 AND b.j = c.i GROUP BY a.name, a.i, c.j"


@query(_sql_turns())
def rotation_orders(spark, sf_dir):
    out = [_matrix(spark, order, getattr(G.PointCloud, f"get_rotation_matrix_from_{order}")(_ANGLES)) for order in _ORDERS]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


_AXIS = (0.3, -0.4, 1.2)
_ANGLE = "sqrt(0.3 * 0.3 + 0.4 * 0.4 + 1.2 * 1.2)"


def _sql_axis_angle() -> str:
    u = [f"({v!r} / {_ANGLE})" for v in _AXIS]
    cross = {(0, 1): f"-{u[2]}", (0, 2): u[1], (1, 0): u[2], (1, 2): f"-{u[0]}", (2, 0): f"-{u[1]}", (2, 1): u[0]}
    rows = [f"('turn', {i}, {j}, {f'cos({_ANGLE}) + ' if i == j else ''}(1 - cos({_ANGLE})) * {u[i]} * {u[j]} + sin({_ANGLE}) * ({cross.get((i, j), '0.0')}))" for i in range(3) for j in range(3)]
    rows += [f"('none', {i}, {j}, {float(i == j)!r})" for i in range(3) for j in range(3)]
    return f"SELECT name, i, j, round(CAST(v AS DOUBLE), 9) + 0.0 AS v FROM (VALUES {', '.join(rows)}) AS t(name, i, j, v)"


@query(_sql_axis_angle())
def rotation_axis_angle(spark, sf_dir):
    return _matrix(spark, "turn", rotation.get_rotation_matrix_from_axis_angle(_AXIS)).unionByName(_matrix(spark, "none", rotation.get_rotation_matrix_from_axis_angle((0, 1e-13, 0))))


@query("WITH q AS (SELECT 1.0 / n AS w, 2.0 / n AS x, -3.0 / n AS y, 0.5 / n AS z FROM (SELECT sqrt(1.0 + 4.0 + 9.0 + 0.25) AS n)) SELECT 'turn' AS name, i, j, round(v, 9) + 0.0 AS v FROM ("
       + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {e} AS v FROM q" for (i, j), e in {
           (0, 0): "1 - 2 * (y * y + z * z)", (0, 1): "2 * (x * y - w * z)", (0, 2): "2 * (x * z + w * y)", (1, 0): "2 * (x * y + w * z)", (1, 1): "1 - 2 * (x * x + z * z)", (1, 2): "2 * (y * z - w * x)",
           (2, 0): "2 * (x * z - w * y)", (2, 1): "2 * (y * z + w * x)", (2, 2): "1 - 2 * (x * x + y * y)"}.items()) + ")")
def rotation_quaternion(spark, sf_dir):
    return _matrix(spark, "turn", rotation.get_rotation_matrix_from_quaternion((1.0, 2.0, -3.0, 0.5)))


_SCALES = (1e-8, 1e-3, 1.0, 1e3, 1e7)


@query(f"SELECT o_orderkey, printf('%g', v) AS general, printf('%.10f', v) AS fixed, printf('%e', v) AS exponent FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 7.0::DOUBLE * CAST([{', '.join(map(repr, _SCALES))}] AS DOUBLE[])[o_orderkey % 5 + 1] AS v FROM orders)")
def number_texts(spark, sf_dir):
    """Numbers of many sizes in the three forms of C."""
    value = F.col("o_totalprice").cast("double") / 7.0 * F.get(F.array(*map(F.lit, _SCALES)), (F.col("o_orderkey") % 5).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", value.alias("v"))
    return rows.select("o_orderkey", *[F.udf(f, "string", useArrow=True)("v").alias(n) for n, f in (("general", formatting.general), ("fixed", formatting.fixed), ("exponent", formatting.exponent))])


# ---- utilities


@query(_values([("after", "VerbosityLevel.Info"), ("before", "VerbosityLevel.Info"), ("inside", "VerbosityLevel.Error"), ("set", "VerbosityLevel.Debug")]))
def verbosity(spark, sf_dir):
    start = utility.get_verbosity_level()
    utility.set_verbosity_level(utility.VerbosityLevel.Info)
    rows = [("before", str(utility.VerbosityLevel(utility.get_verbosity_level()).__class__.__name__ + "." + utility.get_verbosity_level().name))]
    with utility.VerbosityContextManager(utility.VerbosityLevel.Error):
        rows.append(("inside", f"VerbosityLevel.{utility.get_verbosity_level().name}"))
    rows.append(("after", f"VerbosityLevel.{utility.get_verbosity_level().name}"))
    utility.set_verbosity_level(utility.VerbosityLevel.Debug)
    rows.append(("set", f"VerbosityLevel.{utility.get_verbosity_level().name}"))
    utility.set_verbosity_level(start)
    return _texts(spark, rows)


@query(_values([
    ("appended", "[[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]"), ("count", 1), ("equal to a copy", True), ("extended and popped", "[[9.0, 9.0, 9.0], [0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]"), ("index error", True), ("integers", "[3, 1]"), ("length", 3),
    ("popped", "[7.0, 7.0, 7.0]"), ("removed", "[[9.0, 9.0, 9.0], [3.0, 4.0, 5.0]]"), ("text", "std::vector<Eigen::Vector3d> with 2 elements.\nUse numpy.asarray() to access data."), ("written through", "[[9.0, 9.0, 9.0], [3.0, 4.0, -1.0]]"), ("wrong size", True),
]))
def vector_containers(spark, sf_dir):
    v = utility.Vector3dVector([[0, 1, 2]])
    rows: dict = {}
    listed = lambda x: np.asarray(x).tolist()
    v.append((3, 4, 5))
    rows["appended"] = listed(v)
    v.insert(-9, (9, 9, 9))
    v.extend([[7, 7, 7]])
    rows["popped"] = listed(v.pop())
    rows["extended and popped"], rows["length"], rows["count"] = listed(v), len(v), v.count((0, 1, 2))
    v.remove((0, 1, 2))
    rows["removed"], rows["text"], rows["equal to a copy"] = listed(v), repr(v), v == utility.Vector3dVector(v)
    np.asarray(v)[1, 2] = -1
    rows["written through"], rows["wrong size"], rows["index error"] = listed(v), fails(lambda: v.append((1, 2)), TypeError), fails(lambda: v[2], IndexError)
    n = utility.IntVector([3, 2, 1])
    n.remove(2)
    rows["integers"] = listed(n)
    return _texts(spark, sorted(rows.items()))
