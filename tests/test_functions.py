"""Scalar functions against plain Python."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox.functions import grid as G
from stratavox.functions import linalg as L
from stratavox.functions import text as T


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_cells_round_apart_below_zero(spark):
    x = F.lit(-1)
    assert tuple(one(spark, G.cell_trunc(x, 64), G.cell_floor(x, 64), G.voxel_centre(x, 64))) == (0, -1, -32)


def test_fixed_quarter_turn(spark):
    m = G.fixed_matrix([[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    back = G.fixed_matrix([[0, 1, 0, 0], [-1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    one_zero = (F.lit(1), F.lit(0), F.lit(0))
    assert tuple(one(spark, *G.fixed_transform(*one_zero, m))) == (0, 1, 0)
    assert tuple(one(spark, *G.fixed_transform(*one_zero, back))) == (0, -1, 0)


def test_entry_layout(spark):
    raw = G.pack(F.lit(4), F.lit(6))
    assert tuple(one(spark, raw, G.unpack_value(G.pack(F.lit(-7), F.lit(-9))), G.unpack_weight(G.pack(F.lit(-7), F.lit(-9))))) == (393220, -7, -9)


def test_rounding_and_ranges(spark):
    assert tuple(one(spark, G.round_half_away(F.lit(-2.5)), G.round_half_away(F.lit(2.5)), G.norm_trunc(F.lit(3), F.lit(4), F.lit(5)))) == (-3, 3, 7)
    assert tuple(one(spark, G.odd(F.lit(20)), G.odd(F.lit(5)), G.merge_value(F.lit(100), F.lit(64), F.lit(-50), F.lit(32)))) == (21, 5, 50)


def test_weight_ramp_golden(spark):
    got = [r.w for r in spark.createDataFrame([(v,) for v in (0, -300, -1000, -2000, -3000)], "v bigint").select(G.tsdf_weight("v", 3000).alias("w")).collect()]
    assert got == [64, 64, 47, 23, 0]


def test_colour(spark):
    assert tuple(one(spark, *G.surface_colour(F.lit(300), 600), *G.surface_colour(F.lit(-150), 600))) == (0.5, 0.0, 0.0, 0.25)


def test_matrices(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    lit = lambda m: F.array(*[F.lit(float(v)) for v in np.ravel(m)])
    r = one(spark, L.matmul(lit(a), lit(b), 3), L.inverse3(lit(a)), L.det3(lit(a)), L.transpose(lit(a), 3), L.matvec(lit(a), lit(b[0]), 3), L.outer(lit(a[0]), 3))
    for got, want in zip(r, (a @ b, np.linalg.inv(a), np.linalg.det(a), a.T, a @ b[0], np.outer(a[0], a[0])), strict=True):
        assert np.allclose(np.ravel(got), np.ravel(want))
    assert one(spark, L.inverse3(F.array(*[F.lit(0.0)] * 9)))[0][0] is None
    rigid = np.eye(4)
    rigid[:3, :3], rigid[:3, 3] = L.np_se3_exp(np.array([0.1, -0.2, 0.3, 1, 2, 3]))
    assert np.allclose(np.reshape(one(spark, L.inverse_rigid4(lit(rigid)))[0], (4, 4)), np.linalg.inv(rigid))


def test_vectors(spark):
    v = L.vec(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = one(spark, L.cross(v, v), L.l1norm(v), L.dot(v, v), L.prod(v), L.negate(v), L.scale(v, 2.0), L.add(v, v), L.sub(v, v), L.normalised(v), L.skew(v))
    assert r[0] == [0, 0, 0] and r[1:4] == (6, 14, 6) and r[4] == [-1, -2, -3] and r[5] == [2, 4, 6] == r[6] and r[7] == [0, 0, 0]
    assert np.allclose(np.linalg.norm(r[8]), 1) and np.allclose(np.reshape(r[9], (3, 3)), L.np_skew([1, 2, 3]))


def test_fast_arc_tangent(spark):
    xs = [(float(y), float(x)) for y in (-3, -1, -0.2, 0, 0.4, 2) for x in (-2, -0.5, 0, 0.7, 3)]
    got = spark.createDataFrame(xs, "y double, x double").select("y", "x", L.fast_atan2(F.col("y"), F.col("x")).alias("a")).collect()
    assert all(abs(r.a - math.atan2(r.y, r.x)) < 0.006 for r in got)


def test_quaternions(spark):
    rot, _ = L.np_se3_exp(np.array([0.3, -0.4, 0.5, 0, 0, 0]))
    q = L.np_quat_of(rot)
    p = np.array([1.0, -2.0, 0.5])
    r = one(spark, *L.quat_rotate([F.lit(float(v)) for v in q], [F.lit(float(v)) for v in p]))
    assert np.allclose(r, rot @ p) and np.allclose(L.np_rotation_of(q), rot)
    two = one(spark, *L.quat_mul([F.lit(float(v)) for v in q], [F.lit(float(v)) for v in q]))
    assert np.allclose(L.np_rotation_of(np.array(two)), rot @ rot)


def test_euler_order(spark):
    from stratavox.operators.timeseries import euler_matrix

    w = np.array([0.2, -0.3, 0.4])
    assert np.allclose(np.reshape(one(spark, L.euler_rotation(*[F.lit(float(v)) for v in w]))[0], (3, 3)), euler_matrix(w))


def test_distances_to_line_and_plane(spark):
    p, a, b = ([F.lit(float(v)) for v in t] for t in ((0, 3, 4), (0, 0, 0), (5, 0, 0)))
    assert tuple(one(spark, L.point_to_line(p, a, b), L.point_to_plane(p, [F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.lit(-1.0)))) == (5.0, 3.0)


@given(st.lists(st.floats(-2, 2), min_size=6, max_size=6))
def test_twist_is_rigid(xi):
    t = L.np_twist_to_transform(np.array(xi), np.array([5.0, -3.0, 1.0]))
    assert np.allclose(t[:3, :3] @ t[:3, :3].T, np.eye(3), atol=1e-9)
    rot, v = L.np_se3_exp(np.array(xi))
    assert np.isclose(np.linalg.det(rot), 1) and np.isfinite(v).all()
    assert np.allclose(rot, t[:3, :3], atol=1e-6)


def test_text(spark):
    r = one(spark, T.two_decimals(F.lit(0.6)), T.replace_first(F.lit("a.b.c"), ".", "-"), T.padded_name(F.lit(7), 5, ".pcd"), T.base_name(F.lit("/x/y.bag")), T.with_extension(F.lit("/x/y.bag"), "h5"), G.chunk_tag(F.lit(-1), F.lit(0), F.lit(2)))
    assert tuple(r) == ("0dot60", "a-b.c", "00007.pcd", "y.bag", "/x/y.h5", "-1_0_2")
    assert one(spark, T.clock_folder(F.lit("2024-03-05 10:20:30").cast("timestamp")))[0] == "10-20-30_05-03-2024"


def test_pose_rounding_is_half_away(spark):
    from stratavox.operators.mapstore import store_poses

    p = spark.createDataFrame([(0, 1.2345, -1.2345, 0.0, 0.00049, 0.0, 0.0, -1.0)], "seq bigint, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    r = store_poses(p, 1.0).first()
    assert (r.pose_id, r.tx, r.ty, r.qx, r.qw) == (0, pytest.approx(1.235), pytest.approx(-1.235), 0.0, -1.0)
