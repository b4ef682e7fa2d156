"""Greedy picking against plain loops and the known cap; occlusion marks."""

import numpy as np
from pyspark.sql import functions as F

from stratavox.operators import features as FE

W = 256


def test_cap_as_coded_refuses_one(spark):
    width = 6 * 300
    curv = np.zeros(width)
    cols = [10 + 12 * k for k in range(22)]
    for k, c in enumerate(cols):
        curv[c] = 100 - k
    got = lambda cap: [c for c, kind in FE.pick_line(curv, np.zeros(width, bool), np.zeros((width, 3)), width, FE.Variant(2.0, -1.0, cap=cap)) if kind == "edge"]
    assert got("as_coded") == cols[:20] + [cols[21]]
    assert got("strict") == cols[:20]


def test_occlusion_both_ways(spark):
    for ranges, marked in (([5.0] * 30 + [5.4] * 34, range(30, 36)), ([5.4] * 30 + [5.0] * 34, range(24, 30))):
        rows = [(0, 0, i, r) for i, r in enumerate(ranges)]
        g = spark.createDataFrame(rows, "scan_id bigint, ring bigint, col bigint, range double")
        got = {r.col for r in FE.occlusion_marks(g, 64, parallel=None).filter("marked").collect()}
        ends = {c for c in got if c < 12 or c > 50}  # unfilled ranges at the ends count as zero
        assert got - ends == set(marked)


def test_curvature_of_a_corner(spark):
    xyz = [(0, 0, i, float(min(i, 32)), float(max(i - 32, 0)), 0.0) for i in range(64)]
    g = spark.createDataFrame(xyz, "scan_id bigint, ring bigint, col bigint, x double, y double, z double")
    c = {r.col: r.curvature for r in FE.curvature(g, 64).collect()}
    assert c[4] is None and c[58] is None and c[20] == 0.0 and max((v, k) for k, v in c.items() if v is not None)[1] == 32


def naive(curv, marked, width, variant):
    """Candidates sorted as wholes, one at a time, with a fixed reach."""
    taken, out = set(np.flatnonzero(marked)), []
    for lo in range(5, width - 6, width // 6):
        cols = range(lo, min(lo + width // 6, width - 6))
        for kind, least in (("edge", True), ("surf", False)):
            n = 0
            for c in sorted(cols, key=lambda c: (-curv[c], c) if least else (curv[c], c)):
                good = curv[c] >= variant.edge_least if least else curv[c] <= variant.surf_most
                if good and c not in taken:
                    n += 1
                    if n == 21:
                        continue
                    out.append((c, kind))
                    taken |= set(range(max(0, c - 5), min(width, c + 6)))
    return out


def test_picking_matches_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    v = FE.VARIANTS["production"]
    for _ in range(20):
        curv, marked = rng.choice([0.0, 0.05, 1.0, 3.0, 9.0], W), rng.random(W) < 0.05
        assert FE.pick_line(curv, marked, np.zeros((W, 3)), W, v) == naive(curv, marked, W, v)


def test_lines_in_step_pick_as_one_by_one():
    rng = np.random.default_rng(8)
    for v in FE.VARIANTS.values():
        n = 40
        curv, taken = rng.choice([-1.0, 0.0, 0.0005, 0.05, 0.5, 1.0, 3.0, 9.0], (n, W)), rng.random((n, W)) < 0.05
        xyz = np.cumsum(rng.choice([0.05, 0.3], (n, W, 3), p=[0.8, 0.2]), axis=1)
        row, col, edge = FE.pick_lines(curv, taken, xyz, v)
        got = {(int(r), int(c), "edge" if e else "surf") for r, c, e in zip(row, col, edge, strict=True)}
        want = {(r, c, k) for r in range(n) for c, k in FE.pick_line(curv[r], taken[r], xyz[r], W, v)}
        assert got == want and len(got) == len(row)


def test_every_variant_runs_on_a_grid(spark):
    rng = np.random.default_rng(5)
    rows = [(s, r, c, float(np.cos(c / 9) * 10 + rng.random()), float(np.sin(c / 9) * 10), float(r), 60.0) for s in range(2) for r in range(3) for c in range(W)]
    g = spark.createDataFrame(rows, "scan_id bigint, ring bigint, col bigint, x double, y double, z double, intensity double")
    g = g.withColumn("range", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    g = FE.occlusion_marks(FE.curvature(g, W), W, least=2.0, most=60.0, parallel=None)
    for name in FE.VARIANTS:
        got = FE.extract_features(g, W, name)
        assert {r.kind for r in got.select("kind").distinct().collect()} <= {"edge", "surf"}
        assert got.count() == got.select("scan_id", "ring", "col").distinct().count()
        assert got.count() == FE.extract_features(g, W, name, lines=1).count()
    broken = g.filter("not (ring = 1 and col = 7)")
    assert {r.ring for r in FE.extract_features(broken, W, "production").select("ring").distinct().collect()} <= {0, 2}


def test_points_held_do_not_grow_with_the_partition(spark, monkeypatch):
    picked, lines, width = FE.pick_lines, 620, 256

    def few(curv, *rest):
        assert curv.size < 150_000, curv.size
        return picked(curv, *rest)

    monkeypatch.setattr(FE, "pick_lines", few)
    g = spark.range(lines * width).select(F.expr("0L").alias("scan_id"), F.expr(f"id div {width}").alias("ring"), F.expr(f"id % {width}").alias("col"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y"), F.lit(1.0).alias("z"))
    g = FE.curvature(g, width).withColumn("marked", F.lit(False))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = FE.extract_features(g, width, "production")
        assert got.select("ring").distinct().count() == lines
        assert got.count() == got.select("ring", "col").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges_of_a_step_image(spark):
    from stratavox.operators import images as IM

    px = spark.createDataFrame([(0, r, c, *[200 * (c >= 8)] * 3) for r in range(8) for c in range(16)], "image_id bigint, row bigint, col bigint, r bigint, g bigint, b bigint")
    e = {(r.row, r.col): r.edge for r in IM.gradient(IM.gaussian(IM.grey(px))).collect()}
    assert max(e, key=e.get)[1] in (7, 8) and e[4, 2] == 0 and e[4, 13] == 0 and e[4, 7] > 50
