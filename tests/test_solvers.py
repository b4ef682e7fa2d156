"""Registration, feature alignment and distribution matching recover known poses; normal equations and covariances by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions.linalg import np_twist_to_transform
from stratavox.operators import neighbours as NB
from stratavox.operators import registration as RG
from stratavox.operators import solvers as SO
from stratavox.operators import tsdf as TD
from stratavox.params import Params
from stratavox.plans.mapping import Mapping
from stratavox.plans.pipelines import feature_odometry, map_and_register

PTS = "scan_id bigint, idx bigint, x bigint, y bigint, z bigint"


def room(step=90, half=3000):
    """Walls, floor and ceiling around the origin in millimetres, unevenly sized so that poses are determined."""
    a = np.arange(-half, half + 1, step)
    u, v = [m.ravel() for m in np.meshgrid(a, a)]
    o = np.full_like(u, half)
    z = np.clip(v // 2, -1400, 1400)
    return np.concatenate([np.stack([u, o, z], 1), np.stack([u, -o * 4 // 5, z], 1), np.stack([o, u, z], 1), np.stack([-o * 9 // 10, u, z], 1), np.stack([u, v, np.full_like(u, -1400)], 1), np.stack([u, v, np.full_like(u, 1400)], 1)])


def frame(spark, xyz, scan=0):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"scan_id": scan, "idx": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}).astype("int64"), PTS)


@pytest.mark.parametrize("n", [1, 1024, 2000])
def test_normal_equations_by_hand(spark, n):
    df = spark.range(n).select(*[F.lit(i + 1).cast("bigint").alias(f"j{i}") for i in range(6)], F.lit(1).cast("bigint").alias("value"))
    r = RG.normal_equations(df).first()
    assert all(r[f"h{i}{k}"] == n * (i + 1) * (k + 1) for i in range(6) for k in range(i, 6))
    assert [r[f"g{i}"] for i in range(6)] == [n * (i + 1) for i in range(6)] and (r.e, r.c) == (n, n)


def test_uncentred_covariance(spark):
    for rows in ([(1, 2, 3)], [(1, 2, 3), (2, 3, 4)]):
        got = RG.covariance(spark.createDataFrame(rows, "x bigint, y bigint, z bigint"), ("x", "y", "z")).first()
        want = np.mean([np.outer(r, r) for r in rows], axis=0)
        assert np.allclose(np.reshape([got[f"{a}_{b}"] for a in "xyz" for b in "xyz"], (3, 3)), want)


def test_registration_recovers_shift(spark):
    walls = room()
    target = frame(spark, walls)
    voxels = TD.merge_nearest(TD.ray_march(target, 100, 800, window=((0, 0, 0), (91, 91, 51)), dz_per_distance=2500)).cache()
    grads = RG.gradients(voxels).cache()
    source = frame(spark, walls[::3] - [200, 150, 0]).cache()
    residual = lambda t: np.linalg.norm((walls[::3] - [200, 150, 0]) @ t[:3, :3].T + t[:3, 3] - walls[::3], axis=1).mean()
    pose, n, err = RG.register(source, grads, 100, max_iterations=25, weight_gradient=0.0, metric=True)
    assert residual(pose) < 100 and n > 1 and np.isfinite(err)
    pose, _, _ = RG.register(source, grads, 100, max_iterations=4)
    assert residual(pose) < residual(np.eye(4))


def test_distribution_matching_recovers_pose(spark):
    walls = room() / 1000.0
    import pandas as pd

    to = lambda p: spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")))
    rng = np.random.default_rng(2)
    dense = walls + rng.normal(0, 0.004, walls.shape)
    mm = spark.createDataFrame(pd.DataFrame((dense * 1000).astype("int64"), columns=list("xyz")))
    cells = SO.voxel_gaussians(mm, 1000).cache()
    t = np_twist_to_transform(np.array([0, 0, 0.02, 0.08, -0.05, 0.02]), np.zeros(3))
    inv = np.linalg.inv(t)
    source = (walls[::4] @ inv[:3, :3].T + inv[:3, 3]) * 1000
    pose, fit = SO.match_distributions(to(source), cells, 1000)
    assert np.abs(pose[:3, 3] / 1000 - t[:3, 3]).max() < 0.03 and np.abs(pose[:3, :3] - t[:3, :3]).max() < 0.01
    assert np.isfinite(fit)
    assert np.allclose(SO.refine(to(source), cells, 1000, np.eye(4), 0.0), np.eye(4))


def test_feature_alignment_recovers_pose(spark):
    rng = np.random.default_rng(0)
    t = np_twist_to_transform(np.array([0.01, -0.02, 0.05, 0.1, -0.1, 0.05]), np.zeros(3))
    inv = np.linalg.inv(t)
    back = lambda p: p @ inv[:3, :3].T + inv[:3, 3]
    planes, edges = [], []
    for n, d in (((1, 0, 0), -3), ((0, 1, 0), -4), ((0, 0, 1), 1)):
        n = np.array(n, float)
        for _ in range(40):
            q = rng.uniform(-3, 3, 3)
            q = q - n * (n @ q + d)
            planes.append([*map(float, back(q)), *map(float, n), float(d)])
    for a in ((3, 4, 0), (3, -2, 0)):
        for _ in range(20):
            q = np.array([a[0], a[1], rng.uniform(-1, 1)])
            edges.append([*map(float, back(q)), a[0], a[1], -1.0, a[0], a[1], 1.0])
    e = spark.createDataFrame([[float(v) for v in r] for r in edges], ["px", "py", "pz", "ax", "ay", "az", "bx", "by", "bz"])
    p = spark.createDataFrame(planes, ["px", "py", "pz", "nx", "ny", "nz", "d"])
    assert np.allclose(SO.align_features(e, p, outer=4), t, atol=1e-4)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = rng.integers(-3000, 3000, (400, 3))
    p = frame(spark, pts)
    q = p.filter("idx % 10 = 0")
    knn = NB.knn_join(q, p, 5, 1500, ["idx"]).select("q_idx", "p_idx", "d2", "rank").collect()
    d2 = ((pts[:, None].astype(int) - pts[None]) ** 2).sum(2)
    for i in range(0, 400, 10):
        near = sorted((d2[i, j], j) for j in range(400) if d2[i, j] <= 1500**2)[:5]
        assert sorted((r.d2, r.p_idx) for r in knn if r.q_idx == i) == near
    assert NB.radius_join(q, p, 700).count() == int((d2[::10] <= 700**2).sum())


def test_plane_and_line_fits(spark):
    rng = np.random.default_rng(1)
    flat = np.stack([rng.integers(-500, 500, 5), rng.integers(-500, 500, 5), np.full(5, 300)], 1)
    line = np.stack([np.arange(5) * 100, np.arange(5) * 200, np.full(5, 50)], 1)
    rows = [(k, *map(int, r)) for k, m in enumerate((flat, line)) for r in m]
    m = NB.scatter(spark.createDataFrame(rows, "q bigint, p_x bigint, p_y bigint, p_z bigint"), ["q"])
    plane = {r.q: r for r in NB.plane_fit(m).collect()}[0]
    assert np.allclose([abs(plane.c), plane.d * plane.c], [1, -300], atol=1e-6)
    axes = {r.q: r for r in NB.principal_axes(m).collect()}
    assert axes[1].is_line and np.allclose(abs(axes[1].ly / axes[1].lx), 2)


def test_splat_against_a_loop(spark):
    rows = [(0, 0, 2000, 300, 100, -1.0, 0.0, 0.0), (0, 1, 900, 1500, -300, -0.6, -0.8, 0.0), (0, 2, 500, 500, 0, 0.0, 0.0, 1.0)]
    p = spark.createDataFrame(rows, "scan_id bigint, idx bigint, x bigint, y bigint, z bigint, nx double, ny double, nz double")
    res, tau, m = 200, 500, 32768
    trunc = lambda a, b: int(a / b) if abs(a) < 2**50 else (a // b if (a < 0) == (b < 0) else -(-a // b))
    want = {}
    dz = int(np.tan(45.0 / 256 / 180 * np.pi) / 2 * m)
    for _, i, *r in rows:
        xyz, n = r[:3], [int(v * m) for v in r[3:]]
        pt = [trunc(v * m, res) for v in xyz]
        dist = int(np.floor(np.sqrt(float(sum(v * v for v in pt)))))
        acc = trunc(-sum(a * trunc(b * m, dist) for a, b in zip(n, pt, strict=True)), m)
        if acc == 0:
            continue
        if acc < 0:
            n, acc = [-v for v in n], -acc
        cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        a = cross(n, [0, 1, 0])
        if a == [0, 0, 0]:
            a = cross(n, [1, 0, 0])
        b = [trunc(v, m) for v in cross(n, a)]
        a = [trunc(v, m) for v in cross(n, b)]
        reach = trunc(dz * dist * 2, m) + 1
        for la in range(-reach, reach + 1, m // 2):
            for lb in range(-reach, reach + 1, m // 2):
                for ln in range(-tau * m // res, tau * m // res + 1, m // 2):
                    c = [int(np.floor((pt[k] + trunc(a[k] * la, m) + trunc(b[k] * lb, m) + trunc(n[k] * ln, m)) / m)) for k in range(3)]
                    d = [trunc(pt[k] * res, m) - (c[k] * res + res // 2) for k in range(3)]
                    v = int(np.floor(np.sqrt(float(sum(x * x for x in d)))))
                    if v > tau:
                        continue
                    if sum(n[k] * d[k] for k in range(3)) > 0:
                        v = -v
                    w = trunc(64 * (tau + v), tau - tau // 10) if v < -(tau // 10) else 64
                    w = trunc(w * acc, m)
                    if w:
                        want[i, *c] = (v, w)
    got = {(r.idx, r.ix, r.iy, r.iz): (r.value, r.weight) for r in TD.splat(p, res, tau).collect()}
    assert got == want and len(got) == 10
    early = TD.splat(p, res, tau, stop_early=True).count()
    assert 0 <= early <= len(got)


def test_pipelines_run_end_to_end(spark):
    walls = room(step=240)
    params = Params.of({"map": {"resolution": 256, "max_distance": 0.8, "size": {"x": 10, "y": 10, "z": 5}, "update_distance": 0.01}, "registration": {"max_iterations": 4}})
    poses, voxels = map_and_register([frame(spark, walls, 0), frame(spark, walls - [30, 0, 0], 1)], params)
    assert len(poses) == 2 and np.allclose(poses[0], np.eye(4)) and np.isfinite(poses[1]).all() and voxels.count() > 100
    metres = spark.createDataFrame([[float(v) / 1000 for v in r] for r in room(step=150, half=2000)], ["x", "y", "z"])
    empty = metres.limit(0)
    moved = metres.withColumn("x", F.col("x") - 0.05)
    pose = feature_odometry(empty, moved, empty, metres, params, rounds=2)
    assert abs(pose[0, 3] - 0.05) < 0.05 and np.abs(pose[:3, :3] - np.eye(3)).max() < 0.05


def test_mapping_goes_on_while_a_version_is_written(spark, tmp_path):
    """Five scans under a known motion: poses found, and the map, gathered scans and shift included, by plain loops under those poses."""
    walls = room(step=200)
    params = Params.of({"map": {"resolution": 200, "max_distance": 0.8, "size": {"x": 9, "y": 9, "z": 5}, "shift": 0.1}, "registration": {"max_iterations": 5}})
    run = Mapping(spark, str(tmp_path / "map"), params, writing=1, dz_per_distance=2500, snap=60)
    move = np.array([60, 0, 0])
    for k in range(5):
        run.add(k, frame(spark, walls - k * move, k))
    run.finish()
    found = [s.pose[:3, 3] for s in run.steps]
    assert max(np.abs(p - k * move).max() for k, p in enumerate(found)) <= 120  # two ticks
    told, whole, wait, last = [], -1, None, np.zeros(3)
    for p in found:  # a shift's version is under way for one scan more
        if wait == 0:
            whole, wait = whole + 1, None
        elif wait is not None:
            wait -= 1
        shifts = wait is None and np.linalg.norm(p - last) >= 100
        told.append((whole + (1 if wait is None else 2), bool(shifts)))
        last = p if shifts else last
        whole, wait = (whole, wait) if wait is not None else (whole, 1) if shifts else (whole + 1, None)
    assert [(s.version, s.shifted) for s in run.steps] == told and any(shifts for _, shifts in told[:3])
    groups = [[k for k, (v, _) in enumerate(told) if v == version] for version in sorted({v for v, _ in told})]
    assert run.versions.versions() == list(range(len(groups))) and max(map(len, groups)) == 2
    m, want = params.map, None
    for group in groups:
        pts = [(k, i, *map(int, w)) for k in group for i, w in enumerate(walls - k * move + found[k].astype(int)) if not (w - found[k] < 300).all()]
        if len(group) > 1:
            slots, out, runs = {}, [], {}
            for _, _, *c in pts:
                cell = tuple(v // 200 for v in c)
                slot = (cell[0] * 7171 + cell[1] * 3079 + cell[2] * 4231) & 511
                if slot not in slots or slots[slot][0] != cell:
                    runs[slot] = runs.get(slot, 0) + 1
                    slots[slot] = (cell, [])
                    out.append((slot, runs[slot], slots[slot][1]))
                slots[slot][1].append(c)
            pts = [(group[-1], r * 512 + s, *(int(np.mean([c[a] for c in cs])) for a in range(3))) for s, r, cs in out]
        step = run.steps[group[-1]]
        pos = tuple(int(v // 200) for v in found[group[-1]])
        rays = TD.ray_march(spark.createDataFrame(pts, PTS), 200, m.tau, pos=pos, window=(step.centre, m.odd_cells), dz_per_distance=2500)
        cells = {(r.ix, r.iy, r.iz): (r.value, r.weight) for r in TD.merge_nearest(rays, wide=True).collect()}
        if want is None:
            want = cells
            continue
        for c, (v, w) in cells.items():
            old = want.get(c)
            if old is None or w and old[1] <= 0:
                want[c] = (v, w)
            elif old[1] > 0 and w > 0:
                total = old[0] * old[1] + v * w
                want[c] = (int(total / (old[1] + w)), min(m.scaled_max_weight, old[1] + w))
    assert {(r.ix, r.iy, r.iz): (r.value, r.weight) for r in run.versions.read().collect()} == want


def test_marching_and_splatting_tasks_stay_small(spark):
    from stratavox.plans import queries as Q
    from stratavox.sources import adapters as A

    sf = "/root/testdata/sf0.001"
    small = A.points(spark, sf, 500)
    assert small.rdd.getNumPartitions() == -(-small.count() // 500) > 4 and sorted(small.collect()) == sorted(A.points(spark, sf).collect())
    for name in ("normal_splat", "tsdf_upsert"):
        assert "REPARTITION_BY_NUM" in Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_distribution_matching_hands_cells_not_points_to_python(spark, monkeypatch):
    rng = np.random.default_rng(8)
    xyz = rng.integers(-2000, 2000, (500, 3))
    p = spark.createDataFrame([tuple(map(int, r)) for r in xyz], "x bigint, y bigint, z bigint")
    cells, seen, solve = SO.voxel_gaussians(p, 1000).cache(), [], SO._solve_sums
    monkeypatch.setattr(SO, "_solve_sums", lambda rows, *rest: (seen.append(rows.count()), solve(rows, *rest))[1])
    moved = xyz + np.array([150, -40, 20])
    q = spark.createDataFrame([tuple(map(int, r)) for r in moved], "x bigint, y bigint, z bigint")
    pose, _ = SO.match_distributions(q, cells, 1000, iterations=1)
    assert seen and max(seen) <= cells.count()
    by = {(r.ix, r.iy, r.iz): r for r in cells.collect()}
    h, g = np.zeros((6, 6)), np.zeros(6)
    for v in moved.astype(float):
        c = by.get(tuple(int(k) for k in v // 1000))
        if c is not None:
            cov = np.array([[c[f"c{min(i, k)}{max(i, k)}"] for k in range(3)] for i in range(3)])
            a = np.diag([1 / np.sqrt(1e-3), 1, 1]) @ np.linalg.eigh(cov)[1].T
            j = a @ np.concatenate([np.array([[0, v[2], -v[1]], [-v[2], 0, v[0]], [v[1], -v[0], 0]]), np.eye(3)], axis=1)
            h, g = h + j.T @ j, g + j.T @ a @ (v - [c.m0, c.m1, c.m2])
    assert np.allclose(pose, SO._step(np.eye(4), -np.linalg.solve(h + 1e-6 * np.diag(np.diag(h) + 1e-12), g)), rtol=1e-8, atol=1e-8)
