"""kd partitioned joins and voxelised GICP against brute force."""

import numpy as np
import pytest

from stratavox.operators import gicp as GI
from stratavox.operators import kdtree as KD

SCHEMA = "id bigint, x bigint, y bigint, z bigint"


def cloud(rng, n, dense=0):
    """Half of the points spread over 20 m, `dense` in one metre, some at one place, some on leaf borders."""
    x = np.concatenate([rng.integers(-10_000, 10_000, (n, 3)), rng.integers(0, 1000, (dense, 3)), np.full((40, 3), 77), rng.integers(-2, 3, (60, 3)) * 1000])
    return [(i, *map(int, p)) for i, p in enumerate(x)]


def nearest(q, p, k, r):
    """(query, point, d2, rank) by comparing all."""
    out = set()
    keys = np.array([i for i, *_ in p])
    x = np.array([c for _, *c in p])
    for i, *c in q:
        d2 = ((x - np.array(c)) ** 2).sum(1)
        order = np.lexsort((keys, d2))
        out |= {(i, int(keys[j]), int(d2[j]), n) for n, j in enumerate(order[:k], 1) if d2[j] <= r * r}
    return out


@pytest.mark.parametrize("leaf", [50, 10_000])
@pytest.mark.parametrize("same", [True, False])
def test_joins_of_a_cloud_with_a_dense_half(spark, leaf, same):
    rng = np.random.default_rng(7)
    rows = cloud(rng, 300, 300)
    asked = rows if same else cloud(rng, 50, 30)
    p = spark.createDataFrame(rows, SCHEMA).repartition(3)
    q = p if same else spark.createDataFrame(asked, SCHEMA)
    x, a = np.array([r[1:] for r in rows]), np.array([r[1:] for r in asked])
    off = a[:, None] - x[None]
    d2 = (off * off).sum(2)
    got = {(r.q_id, r.p_id, r.d2) for r in KD.radius_join(q, p, 900, leaf_points=leaf).collect()}
    assert got == {(int(i), int(j), int(d2[i, j])) for i, j in zip(*np.nonzero(d2 <= 900**2), strict=True)}
    got = {(r.q_id, r.p_id, r.d2) for r in KD.box_join(q, p, 700, leaf_points=leaf, keep=(["id"], ["id"])).collect()}
    assert got == {(int(i), int(j), int(d2[i, j])) for i, j in zip(*np.nonzero((np.abs(off) <= 700).all(2)), strict=True)}
    for k, r in ((5, 3000), (50, 800), (1, 0)):
        found = KD.knn_join(q, p, k, r, ["id"], leaf_points=leaf)
        assert found.columns == ["q_id", "q_x", "q_y", "q_z", "p_id", "p_x", "p_y", "p_z", "d2", "rank"]
        assert {(r.q_id, r.p_id, r.d2, r["rank"]) for r in found.collect()} == nearest(asked, rows, k, r)


def test_leaves_stay_even_where_half_of_the_points_are_in_one_metre(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-50_000, 50_000, (20_000, 3)), rng.integers(0, 1000, (20_000, 3))])
    splits = KD.KdSplits.fit(spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(x)], SCHEMA), 1000, sample=4000)
    row, leaf = splits.route(x, x)
    leaf = leaf[np.argsort(row)]
    sizes = np.unique(leaf, return_counts=True)[1]
    assert len(sizes) >= 40 and sizes.max() <= 2 * np.median(sizes) and sizes.sum() == len(x)
    rows, leaves = splits.route(x - 300, x + 300)
    assert {(int(r), int(k)) for r, k in zip(np.arange(len(x)), leaf, strict=True)} <= set(zip(rows.tolist(), leaves.tolist(), strict=True))
    assert KD.KdSplits.fit(spark.createDataFrame([], SCHEMA), 1000).axis.tolist() == [-1]


def test_a_leaf_of_equal_points_is_dealt_over_tasks(spark):
    rows = [(i, 5, 5, 5) for i in range(500)] + [(1000 + i, 5 + i, 5, 5) for i in range(1, 20)]
    p = spark.createDataFrame(rows, SCHEMA).repartition(4)
    splits = KD.KdSplits.fit(p.select("x", "y", "z", "id"), 50)
    assert splits.parts.max() >= 8
    got = KD.knn_join(p, p, 4, 10, ["id"], leaf_points=50)
    assert {(r.q_id, r.p_id, r.d2, r["rank"]) for r in got.collect()} == nearest(rows, rows, 4, 10)
    assert KD.radius_join(p, p, 0, leaf_points=50).count() == 500 * 500 + 19


def test_what_a_nearest_join_sends_grows_as_the_points_do(spark):
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    rng = np.random.default_rng(9)

    def written(n):
        bus.waitUntilEmpty()
        before = store.executorList(True).head().totalShuffleWrite()
        p = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(rng.integers(0, 2000, (n, 3)))], SCHEMA)
        assert KD.knn_join(p, p, 3, 3000, ["id"], leaf_points=100).count() == 3 * n
        bus.waitUntilEmpty()
        return store.executorList(True).head().totalShuffleWrite() - before

    assert written(8000) < 5 * written(2000)  # all points are within reach of all others, so sending by reach alone grows with the square


def test_empty_sides_null_coordinates_and_other_columns(spark):
    p = spark.createDataFrame([(1, 0, 0, 0, "a"), (2, None, 0, 0, "b"), (3, 1, 1, 1, None)], SCHEMA + ", name string")
    q = spark.createDataFrame([(9, 0, 0, 1, 2.5)], SCHEMA + ", w double")
    got = KD.radius_join(q, p, 5).collect()
    assert sorted((r.q_id, r.q_w, r.p_id, r.p_name, r.d2) for r in got) == [(9, 2.5, 1, "a", 1), (9, 2.5, 3, None, 2)]
    none = p.filter("id > 5")
    assert KD.radius_join(q, none, 5).count() == KD.knn_join(none, p, 2, 5, ["id"]).count() == KD.box_join(none, none, 5).count() == 0


def room(rng, n=2000):
    """Two walls, a floor and the top of a box, away from the borders of metre cells, 2 mm of noise (mm)."""
    a, b = rng.integers(0, 8000, (2, n))
    faces = [np.stack([a, b, np.zeros(n, int)], 1), np.stack([a, np.zeros(n, int), b // 2], 1), np.stack([np.zeros(n, int), a, b // 2], 1), np.stack([2000 + a // 2, 2000 + b // 2, np.full(n, 2100)], 1)]
    return np.concatenate(faces) + np.array([450, 550, 400]) + rng.integers(-2, 3, (4 * n, 3))


def test_gicp_finds_a_known_displacement_to_five_millimetres(spark):
    rng = np.random.default_rng(2)
    target = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(room(rng))], SCHEMA)
    turn = 0.01
    back = np.array([[np.cos(turn), np.sin(turn), 0], [-np.sin(turn), np.cos(turn), 0], [0, 0, 1]])
    move = np.array([120.0, -80.0, 60.0])
    seen = (room(rng) - move) @ back.T  # the pose turns by `turn`, then moves
    source = spark.createDataFrame([(i, *map(int, np.round(c))) for i, c in enumerate(seen)], SCHEMA)
    cells = GI.target_cells(GI.point_covariances(target, ["id"]), 1000).cache()
    points = GI.point_covariances(source, ["id"]).cache()
    assert points.count() == 8000
    pose, fit = GI.match(points, cells, 1000)
    assert np.abs(pose[:3, 3] * 1000 - move).max() < 5 and abs(pose[1, 0] - np.sin(turn)) < 5e-4 and fit < float("inf")
    assert np.allclose(GI.refine(points, cells, 1000, pose, -1.0), np.eye(4))
    assert GI.match(points.filter("id < 0"), cells, 1000)[1] == float("inf")
    pose, _ = GI.match(points, cells, 1000, around=1, broadcast_cells=0)
    assert np.abs(pose[:3, 3] * 1000 - move).max() < 25


def test_gicp_equations_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = room(rng, 60)
    d = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(x)], SCHEMA)
    covs = GI.point_covariances(d, ["id"], k=5, r=5000)
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]), (0.3, 0.1, -0.2)
    got = GI.normal_equations(covs, GI.target_cells(covs, 2000), 2000, pose, 7).first()
    c = {}
    for i, p in enumerate(x):
        d2 = ((x - p) ** 2).sum(1)
        near = [j for j in np.lexsort((np.arange(len(x)), d2))[:5] if d2[j] <= 5000**2]
        if len(near) == 5:
            b = np.cov(x[near].T / 1000.0, bias=True) + 1e-6 * np.eye(3)
            c[i] = b * np.linalg.norm(np.linalg.inv(b))
    cells = {}
    for i in c:
        cells.setdefault(tuple(x[i] // 2000), []).append(i)
    h, g, n = np.zeros((6, 6)), np.zeros(6), 0
    for i in c:
        q = pose[:3, :3] @ (x[i] / 1000.0) + pose[:3, 3]
        at = np.floor(q * 1000 / 2000).astype(int)
        for o in GI.AROUND[7]:
            if mine := cells.get(tuple(at + o)):
                e = x[mine].mean(0) / 1000.0 - q
                w = len(mine) * np.linalg.inv(np.mean([c[m] for m in mine], axis=0) + pose[:3, :3] @ c[i] @ pose[:3, :3].T)
                jac = np.hstack([np.array([[0, -q[2], q[1]], [q[2], 0, -q[0]], [-q[1], q[0], 0]]), -np.eye(3)])
                h, g, n = h + jac.T @ w @ jac, g + jac.T @ w @ e, n + 1
    assert got["c"] == n > 50
    assert np.allclose([got[f"h{i}{k}"] for i, k in GI.UPPER], [h[i, k] for i, k in GI.UPPER]) and np.allclose([got[f"g{i}"] for i in range(6)], g)
