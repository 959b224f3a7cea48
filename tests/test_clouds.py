"""Interfaces, error contracts and brute-force comparisons on seeded clouds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import geometry as G
from pointloom import io, utility
from pointloom.functions import rng, rotation
from pointloom.operators import neighbors as N
from pointloom.operators import normals as NO
from pointloom.operators import registration as R
from pointloom.pipelines import registration as P
from pointloom.sources import ply, xyz


def points(n, seed, scale=1.0):
    return np.random.default_rng(seed).random((n, 3)) * scale


def brute(q, t, k):
    d2 = ((q[:, None] - t[None]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(np.arange(len(t)), d2.shape), d2), axis=1)[:, :k]
    return [(i, r + 1, int(j)) for i in range(len(q)) for r, j in enumerate(order[i])]


def rows(df):
    return sorted((r.qid, r.rank, r.nid) for r in df.collect())


def queries(spark, q):
    return G.PointCloud.from_numpy(spark, q).df.withColumnRenamed("pid", "qid")


@pytest.mark.parametrize("small", [0, 10**9])
def test_knn_with_duplicates_and_dense_places(spark, small):
    p = np.round(np.vstack([points(300, 1), np.repeat(points(5, 2), 10, 0), points(100, 3) * 0.01]) * 4096) / 4096
    cloud = G.PointCloud.from_numpy(spark, p).df
    assert rows(N.knn_join(queries(spark, p), cloud, 6, small=small)) == brute(p, p, 6)


def test_knn_more_than_there_is_and_none(spark):
    p = np.round(points(7, 4) * 4096) / 4096
    cloud = G.PointCloud.from_numpy(spark, p).df
    assert rows(N.knn_join(queries(spark, p), cloud, 20, small=0)) == brute(p, p, 7)
    assert rows(N.knn_join(queries(spark, p), cloud, 0)) == []


def test_kd_tree_interface(spark):
    p = np.round(points(50, 5) * 4096) / 4096
    tree = G.KDTreeFlann(G.PointCloud.from_numpy(spark, p))
    n, ids, d2 = tree.search_knn_vector_3d(p[3], 5)
    assert n == 5 and ids == [j for _, _, j in brute(p[3:4], p, 5)] and d2[0] == 0
    n, ids, _ = tree.search_radius_vector_3d(p[3], 0.3)
    assert set(ids) == set(np.flatnonzero(((p - p[3]) ** 2).sum(1) < 0.3**2))
    assert tree.search_hybrid_vector_3d(p[3], 0.3, 2)[1] == ids[:2]
    assert tree.search_knn_vector_3d([0, 0], 5)[0] == -1 and tree.search_knn_vector_3d(p[0], -1)[0] == -1
    other = G.KDTreeFlann()
    assert other.set_matrix_data(spark, np.random.default_rng(6).random((8, 40)))
    assert other.search_knn_vector_xd(np.zeros(8), 3)[0] == 3


def test_translation_scale_rotation(spark):
    p = points(20, 7)
    c = G.PointCloud.from_numpy(spark, p, normals=p - 0.5)
    assert np.allclose(c.translate((1, 2, 3), relative=False).get_center(), (1, 2, 3))
    r = rotation.get_rotation_matrix_from_xyz((0.1, 0.2, 0.3))
    turned = c.rotate(r)
    assert np.allclose(turned.points, (p - p.mean(0)) @ r.T + p.mean(0)) and np.allclose(turned.normals, (p - 0.5) @ r.T)
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r * 1.7, (1, 0, -1)
    unit = (p - 0.5) @ r.T / np.linalg.norm(p - 0.5, axis=1)[:, None]
    assert np.allclose(c.transform(m).points, p @ m[:3, :3].T + m[:3, 3]) and np.allclose(c.transform(m).normals, unit)


def test_rotations():
    assert np.allclose(rotation.get_rotation_matrix_from_axis_angle((0, 0, np.pi / 2)), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert np.array_equal(rotation.get_rotation_matrix_from_axis_angle((0, 0, 0)), np.eye(3))
    q = np.array([0.3, -0.4, 0.5, 0.7])
    r = rotation.get_rotation_matrix_from_quaternion(q)
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(r, rotation.get_rotation_matrix_from_quaternion(3 * q)) and np.isclose(np.linalg.det(r), 1)
    with pytest.raises(ValueError):
        rotation.get_rotation_matrix_from_quaternion((0, 0, 0, 0))


def test_normals_odd_cases(spark):
    n = [[0, 0, 0], [np.nan, 1, 0], [0, 0, 1e-200], [3, 0, 4]]
    c = G.PointCloud.from_numpy(spark, np.eye(4)[:, :3], normals=n)
    assert np.allclose(c.normalize_normals().normals, [[0, 0, 0], [0, 0, 1], [0, 0, 1], [0.6, 0, 0.8]])
    out = c.orient_normals_to_align_with_direction((0, 0, -2.0)).normals
    assert np.allclose(out[0], (0, 0, -2)) and np.allclose(out[3], (-3, 0, -4))
    here = G.PointCloud.from_numpy(spark, [[1, 1, 1.0]], normals=[[0, 0, 0]]).orient_normals_towards_camera_location((1, 1, 1)).normals
    assert np.allclose(here, [[0, 0, 1]])
    with pytest.raises(RuntimeError):
        G.PointCloud.from_numpy(spark, np.eye(3)).orient_normals_to_align_with_direction()


@pytest.mark.parametrize("fast", [True, False])
def test_estimated_normals_of_a_plane(spark, fast):
    r = np.random.default_rng(8)
    p = np.column_stack([r.random((200, 2)), r.standard_normal(200) * 1e-4])
    n = G.PointCloud.from_numpy(spark, p).estimate_normals(G.KDTreeSearchParamKNN(12), fast).normals
    assert (np.abs(n[:, 2]) > 0.99).all() and np.allclose(np.linalg.norm(n, axis=1), 1)
    few = G.PointCloud.from_numpy(spark, p[:2]).estimate_normals().normals
    assert np.array_equal(few, [[0, 0, 1], [0, 0, 1]])


def sphere(n, center=(0, 0, 0)):
    i = np.arange(n) + 0.5
    phi, theta = np.arccos(1 - 2 * i / n), np.pi * (1 + 5**0.5) * i
    return np.column_stack([np.cos(theta) * np.sin(phi), np.sin(theta) * np.sin(phi), np.cos(phi)]) + center


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_tangent_plane_orientation(spark, penalty):
    p = sphere(200)
    signs = np.random.default_rng(9).choice([-1.0, 1.0], 200)[:, None]
    out = [G.PointCloud.from_numpy(spark, p, normals=p * s).orient_normals_consistent_tangent_plane(12, penalty).normals for s in (signs, -signs)]
    assert np.allclose(out[0], out[1]) and ((out[0] * p).sum(1) > 0).all()


def test_tangent_plane_of_many_clouds(spark):
    p = sphere(80)
    signs = np.random.default_rng(11).choice([-1.0, 1.0], 80)[:, None]
    one = G.PointCloud.from_numpy(spark, p, normals=p * signs).df
    both = one.withColumn("cloud_id", F.lit("a")).unionByName(one.withColumn("x", F.col("x") + 0.5).withColumn("cloud_id", F.lit("b")))
    out = NO.orient_consistently(both, 10).toPandas().sort_values(["cloud_id", "pid"])
    want = NO.orient_consistently(one, 10).toPandas().sort_values("pid")
    for name in "ab":
        assert np.allclose(out[out["cloud_id"] == name][["nx", "ny", "nz"]], want[["nx", "ny", "nz"]])
    assert out.columns.tolist() == both.columns


def test_tangent_plane_bridges_parts():
    p = np.vstack([sphere(60), sphere(60, (10, 0, 0))])
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    near = np.argsort(d2, axis=1)[:, :6]
    edges = np.array([(i, j, r + 1) for i in range(120) for r, j in enumerate(near[i])])
    center = np.repeat([(0, 0, 0), (10, 0, 0)], 60, 0)
    flips = np.random.default_rng(10).choice([-1.0, 1.0], 120)[:, None]
    out = NO.oriented(p, (p - center) * flips, edges[:, :2], edges[:, 2], 6, 0.0, 1.0)
    for half in (slice(0, 60), slice(60, 120)):
        along = (out[half] * (p - center)[half]).sum(1)
        assert (along > 0).all() or (along < 0).all()


def pair(n=200, seed=80, noise=0.0):
    r = np.random.default_rng(seed)
    src = r.random((n, 3))
    m = np.eye(4)
    m[:3, :3] = rotation.get_rotation_matrix_from_xyz((0.05, -0.04, 0.08))
    m[:3, 3] = (0.05, 0.03, -0.02)
    return src, src @ m[:3, :3].T + m[:3, 3] + r.standard_normal((n, 3)) * noise, m


def test_icp_finds_the_motion(spark):
    s, t, m = pair()
    a, b = G.PointCloud.from_numpy(spark, s), G.PointCloud.from_numpy(spark, t)
    found = P.registration_icp(a, b, 0.2)
    assert np.allclose(found.transformation, m, atol=1e-6) and found.fitness == 1.0
    with_normals = b.estimate_normals(G.KDTreeSearchParamKNN(15))
    flat = P.registration_icp(a, with_normals, 0.2, estimation_method=P.TransformationEstimationPointToPlane())
    assert np.allclose(flat.transformation, m, atol=1e-4)
    with pytest.raises(ValueError):
        P.registration_icp(a, b, 0)
    with pytest.raises(RuntimeError):
        P.registration_icp(a, b, 0.2, estimation_method=P.TransformationEstimationPointToPlane())


def test_given_correspondences(spark):
    s, t, m = pair(50, 82)
    a, b = G.PointCloud.from_numpy(spark, s), G.PointCloud.from_numpy(spark, t * 2)
    same = spark.createDataFrame([(i, i) for i in range(50)], "source_id long, target_id long")
    fit = P.TransformationEstimationPointToPoint(with_scaling=True).compute_transformation(a, b, same)
    assert np.allclose(fit[:3, :3], 2 * m[:3, :3]) and np.allclose(fit[:3, 3], 2 * m[:3, 3])
    wrong = spark.createDataFrame([(0, 99)], "source_id long, target_id long")
    with pytest.raises(ValueError):
        P.TransformationEstimationPointToPoint().compute_rmse(a, b, wrong)
    info = P.get_information_matrix_from_point_clouds(a, G.PointCloud.from_numpy(spark, t), 0.5, m)
    g = np.zeros((6, 6))
    for x, y, z in t:
        for row in ([0, z, -y, 1, 0, 0], [-z, 0, x, 0, 1, 0], [y, -x, 0, 0, 0, 1]):
            g += np.outer(row, row)
    assert np.allclose(info, g)


def test_ransac_is_reproducible(spark):
    s, t, m = pair(150, 83)
    a, b = G.PointCloud.from_numpy(spark, s), G.PointCloud.from_numpy(spark, t)
    r = np.random.default_rng(84)
    target = [i if i >= 50 else int(r.integers(150)) for i in range(150)]
    pairs = spark.createDataFrame(list(zip(range(150), target, strict=True)), "source_id long, target_id long")
    states = []
    for _ in range(2):
        utility.random.seed(7)
        found = P.registration_ransac_based_on_correspondence(a, b, pairs, 0.05, checkers=[R.EdgeLength(0.9), R.Distance(0.05)], criteria=R.RansacCriteria(1000, 0.999))
        assert np.allclose(found.transformation, m, atol=1e-6) and found.fitness == 1.0
        states.append(rng.bounded(10**6))
    assert states[0] == states[1]
    assert P.registration_ransac_based_on_correspondence(a, b, pairs, -1.0).fitness == 0


def test_random_engine():
    rng.seed(5489)
    raw = rng.engine()._bit_generator.random_raw
    first = int(raw())
    rest = [int(raw()) for _ in range(9999)]
    assert first == 3499211612 and rest[-1] == 4123659995


def test_mesh_normals(spark):
    v = [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]]
    mesh = G.TriangleMesh.from_numpy(spark, v, [[0, 2, 1], [0, 1, 3], [0, 3, 2], [1, 2, 3]]).compute_vertex_normals()
    n = mesh.vertex_normals
    assert np.allclose(np.linalg.norm(n, axis=1), 1) and ((n * (np.array(v) - 0.25)).sum(1) > 0).all()
    broken = G.TriangleMesh.from_numpy(spark, v, [[0, 1, 9]]).compute_triangle_normals()
    assert np.array_equal(broken.triangle_normals, [[0, 0, 0]])


def test_voxels(spark):
    c = G.PointCloud.from_numpy(spark, [[0, 0, 0], [0.1, 0, 0], [1, 1, 1.0]], colors=[[0, 0, 0], [1, 1, 1], [0.5, 0, 0]])
    down = c.voxel_down_sample(0.5)
    assert sorted(map(tuple, np.round(down.points, 9))) == [(0.05, 0, 0), (1, 1, 1)] and len(down.colors) == 2
    with pytest.raises(ValueError):
        c.voxel_down_sample(0)
    grid = G.VoxelGrid.create_from_point_cloud(c, 0.5)
    assert np.allclose(grid.get_min_bound(), -0.25) and {v.grid_index for v in grid.get_voxels()} == {(0, 0, 0), (2, 2, 2)}
    assert np.allclose(grid.translate((1, 1, 1), relative=False).origin, 1) and np.allclose(grid.scale(2, (0, 0, 0)).voxel_size, 1)
    with pytest.raises(RuntimeError):
        grid.transform(np.diag([2.0, 1, 1, 1]))
    empty = G.VoxelGrid.create_from_point_cloud(c.clear(), 0.5)
    assert empty.is_empty() and np.array_equal(empty.get_center(), np.zeros(3))


def test_boxes(spark):
    box = G.AxisAlignedBoundingBox((1, 0, 0), (0, 2, 3))
    assert np.array_equal(box.min_bound, [0, 0, 0]) and box.volume() == 6 and np.array_equal(box.get_box_points()[4], [1, 2, 0])
    flat = G.AxisAlignedBoundingBox((1, 1, 1), (2, 2, 1))
    assert flat.is_empty() and np.array_equal(flat.get_center(), np.zeros(3))
    assert np.array_equal((flat + box).max_bound, box.max_bound) and np.array_equal((box + flat).max_bound, box.max_bound)
    assert np.array_equal(box.scale(-1, (0, 0, 0)).min_bound, [-1, -2, -3])
    assert box.get_print_info() == "AxisAlignedBoundingBox: min: (0.0000, 0.0000, 0.0000), max: (1.0000, 2.0000, 3.0000)"
    with pytest.raises(RuntimeError):
        box.rotate(np.eye(3))
    nan = G.PointCloud.from_numpy(spark, [[np.nan, 1, 2], [3, 4, 5.0]])
    assert np.array_equal(nan.get_min_bound(), [3, 1, 2]) and np.isnan(nan.clear().get_max_bound()).all()


@pytest.mark.parametrize("ascii", [True, False])
def test_ply_round_trip(spark, tmp_path, ascii):
    p = points(50, 90)
    c = G.PointCloud.from_numpy(spark, p, normals=p - 0.5, colors=p)
    path = str(tmp_path / "c.ply")
    assert io.write_point_cloud(path, c, write_ascii=ascii)
    back = io.read_point_cloud(spark, path)
    tolerance = 1e-5 if ascii else 0
    assert np.allclose(back.points, p, atol=tolerance, rtol=tolerance) and np.allclose(back.colors, np.round(p * 255) / 255)
    ply.register(spark)
    assert spark.read.format("ply").load(path).count() == 50
    other = ply.read(spark, str(tmp_path)).orderBy("pid").select("x", "y", "z", "nx", "r").toPandas()
    assert np.allclose(other[["x", "y", "z"]], back.points) and np.allclose(other["r"], back.colors[:, 0])
    assert io.read_file_geometry_type(path) == io.CONTAINS_POINTS and not io.write_point_cloud(path, c.clear())


def test_ply_split_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "CHUNK", 16)
    p = points(50, 91)
    path = str(tmp_path / "c.ply")
    io.write_point_cloud(path, G.PointCloud.from_numpy(spark, p))
    parts = ply._Reader(path, False, list("xyz")).partitions()
    got = [b for part in parts for b in ply._Reader(path, False, list("xyz")).read(part)]
    assert len(parts) == 4 and np.array_equal(np.concatenate([b.column(2).to_numpy() for b in got]), p[:, 0])


MESH = "ply\nformat ascii 1.0\nelement vertex 5\nproperty float x\nproperty float y\nproperty float z\nelement face {n}\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n2 0 0\n2 2 0\n0 2 0\n1 0.5 0\n{faces}\n"


def test_meshes_in_ply(spark, tmp_path):
    path = tmp_path / "m.ply"
    path.write_text(MESH.format(n=2, faces="3 0 1 2\n4 0 1 2 3"))
    mesh = io.read_triangle_mesh(spark, str(path))
    assert mesh.triangles.tolist() == [[0, 1, 2], [0, 1, 2], [0, 2, 3]] and io.read_file_geometry_type(str(path)) == io.CONTAINS_TRIANGLES
    ply.register(spark)
    assert spark.read.format("ply_faces").load(str(path)).count() == 3
    path.write_text(MESH.format(n=1, faces="5 0 4 1 2 3"))
    area = 0
    v, t = ply.parse_mesh(path.read_bytes())
    for a, b, c in t:
        q = np.stack([v["x"], v["y"]], 1)[[a, b, c]]
        area += abs((q[1] - q[0])[0] * (q[2] - q[0])[1] - (q[1] - q[0])[1] * (q[2] - q[0])[0]) / 2
    assert len(t) == 3 and np.isclose(area, 3.5)
    for bad in ("3 0 1 7", "3 0 1 -1", "3 0 1 1.5", "2 0 1", "4 0 0 0 0", "3 0 1"):
        path.write_text(MESH.format(n=1, faces=bad))
        assert io.read_triangle_mesh(spark, str(path)).is_empty()
        with pytest.raises(ply.PlyError):
            ply.parse_mesh(path.read_bytes())
    out = str(tmp_path / "o.ply")
    for ascii in (True, False):
        assert io.write_triangle_mesh(out, mesh.compute_vertex_normals(), write_ascii=ascii)
        again = io.read_triangle_mesh(spark, out)
        assert np.array_equal(again.triangles, mesh.triangles) and again.has_vertex_normals()


def test_big_endian_and_truncated():
    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty double x\nproperty float y\nproperty short z\nend_header\n"
    body = b"".join(np.array([v], k).tobytes() for row in ((1.5, 2.5, 3), (4.0, 5.0, -6)) for v, k in zip(row, (">f8", ">f4", ">i2"), strict=True))
    assert np.array_equal(np.stack(list(ply.parse_points(head + body).values()), 1), [[1.5, 2.5, 3], [4, 5, -6]])
    for bad in (head + body[:-1], head[4:], b"", head.replace(b"vertex", b"edge") + body):
        with pytest.raises(ply.PlyError):
            ply.parse_points(bad)


def test_xyz(spark, tmp_path):
    text = "1 2 3 junk\n# no\n 4e0\t-5.5x 6.\n1 2\nnan inf -Infinity\n"
    want = [(1, 2, 3), (4, -5.5, 6)]
    assert xyz.parse_text(text)[:2] == want and np.isnan(xyz.parse_text(text)[2][0]) and len(xyz.parse_text(text)) == 3
    path = tmp_path / "a.xyz"
    path.write_text(text)
    assert sorted((r.x, r.y, r.z) for r in xyz.read(spark, str(path)).where("not isnan(x)").collect()) == want
    assert len(io.read_point_cloud(spark, str(path)).points) == 3
    assert len(io.read_point_cloud(spark, str(path), remove_nan_points=True, remove_infinite_points=True).points) == 2
    assert io.read_point_cloud(spark, str(path), format="XYZ").is_empty() and io.read_point_cloud(spark, "none.xyz").is_empty()
    with pytest.raises(OSError):
        io.read_point_cloud(spark, "none.xyz", strict=True)
    c = G.PointCloud.from_numpy(spark, [[0.5, -1, np.inf]])
    assert io.write_point_cloud_to_bytes(c, "mem::xyz") == b"0.5000000000 -1.0000000000 inf\n"
    assert [r.line for r in xyz.formatted(c.df).collect()] == ["0.5000000000 -1.0000000000 inf"]
    assert len(io.read_point_cloud_from_bytes(spark, b"1 2 3\n", "mem::xyz").points) == 1
    with pytest.raises(ValueError):
        io.write_point_cloud_to_bytes(c)


def test_features(spark):
    p = points(60, 70)
    c = G.PointCloud.from_numpy(spark, p).estimate_normals(G.KDTreeSearchParamKNN(10))
    f = P.compute_fpfh_feature(c, G.KDTreeSearchParamKNN(12)).to_numpy()
    assert f.shape == (33, 60) and np.allclose(f.reshape(3, 11, 60).sum(1), 200)
    feature = P.Feature()
    feature.resize(33, 4)
    assert feature.dimension() == 33 and feature.num() == 4
    with pytest.raises(ValueError):
        feature.resize(-1, 2)
    with pytest.raises(RuntimeError):
        P.compute_fpfh_feature(G.PointCloud.from_numpy(spark, p), G.KDTreeSearchParamKNN(12))


def test_checkers():
    s = np.eye(3)
    assert R.EdgeLength(0.9).fits(s, s * 1.05, np.eye(4)) and not R.EdgeLength(0.9).fits(s, s * 1.2, np.eye(4))
    assert R.Distance(0.5).fits(s, s + [0.5, 0, 0], np.eye(4)) and not R.Distance(0.4).fits(s, s + [0.5, 0, 0], np.eye(4))
    assert R.NormalAngle(0.1).fits(s, s, np.eye(4), s, s) and not R.NormalAngle(0.1).fits(s, s, np.eye(4), s, -s)


def test_checks_over_tables_and_texts(spark):
    s = np.random.default_rng(12).random((6, 3))
    a, b = G.PointCloud.from_numpy(spark, s, normals=s), G.PointCloud.from_numpy(spark, s + [0.5, 0, 0], normals=-s)
    same = spark.createDataFrame([(i, i) for i in range(6)], "source_id long, target_id long")
    assert P.CorrespondenceCheckerBasedOnEdgeLength(0.9).Check(a, b, same, np.eye(4))
    distance, normal = P.CorrespondenceCheckerBasedOnDistance(0.4), P.CorrespondenceCheckerBasedOnNormal(0.1)
    assert not distance.Check(a, b, same, np.eye(4)) and distance.require_pointcloud_alignment_
    assert not normal.Check(a, b, same, np.eye(4)) and normal.Check(G.PointCloud.from_numpy(spark, s), b, same, np.eye(4))
    assert repr(distance) == "CorrespondenceCheckerBasedOnDistance with distance_threshold=0.400000"
    assert repr(P.ICPConvergenceCriteria()) == "ICPConvergenceCriteria(relative_fitness=1.000000e-06, relative_rmse=1.000000e-06, max_iteration=30)"
    assert repr(P.RegistrationResult()).startswith("RegistrationResult with fitness=0.000000e+00") and repr(G.Voxel((1, 2, 3))) == "Voxel(grid_index=1 2 3, color=0 0 0)"


def test_verbosity():
    with utility.VerbosityContextManager(utility.VerbosityLevel.Debug):
        assert utility.get_verbosity_level() == utility.VerbosityLevel.Debug
    assert utility.get_verbosity_level() == utility.VerbosityLevel.Info


def test_stream(spark, tmp_path):
    from pointloom.streaming import voxel_means

    G.PointCloud.from_numpy(spark, [[0, 0, 0], [0.5, 0, 0], [2, 2, 2.0]]).df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pid long, x double, y double, z double").parquet(str(tmp_path / "in"))
    q = voxel_means(stream, 1.0, (0, 0, 0)).writeStream.outputMode("complete").format("memory").queryName("voxels").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.vx, r.n, r.x) for r in spark.table("voxels").collect()) == [(0, 2, 0.25), (2, 1, 2.0)]
