"""What gicp_equations sends: every point's moments once, not its neighbours, and no row for each cell that a point meets."""

import numpy as np

from stratavox.operators import gicp as GI
from stratavox.operators import kdtree as KD
from stratavox.plans.queries_math import QUERIES

SCHEMA = "id bigint, x bigint, y bigint, z bigint"


def cloud(spark, seed=5, n=900):
    x = np.random.default_rng(seed).integers(-40, 40, (n, 3)) * 100  # a lattice: many ties, and equal points
    return x, spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(x)], SCHEMA)


def test_moments_of_the_nearest_against_brute_force(spark):
    x, d = cloud(spark)
    k, r, want = 5, 900, {}
    for i, p in enumerate(x):
        off = x - p
        d2 = (off * off).sum(1)
        near = off[[j for j in np.lexsort((np.arange(len(x)), d2))[:k] if d2[j] <= r * r]]
        want[i] = (len(near), *near.sum(0), *[(near[:, a] * near[:, b]).sum() for a, b in GI.SIX])
    for leaf in (60, 8192):
        got = {r[0]: tuple(r[1:]) for r in KD.knn_moments(d, d, k, r, ["id"], leaf_points=leaf, keep=["id"]).collect()}
        assert got == want
    assert {n[0] for n in want.values()} > {5}
    far = spark.createDataFrame([(1, 10**6, 0, 0), (2, None, 0, 0)], SCHEMA)
    assert KD.knn_moments(far, d, k, r, ["id"]).count() == KD.knn_moments(d, d.filter("id < 0"), k, r, ["id"]).count() == 0


def test_gicp_of_few_and_of_many_cells_is_the_same(spark):
    x, d = cloud(spark)
    covs = GI.point_covariances(d, ["id"], k=5, r=3000)
    cells = GI.target_cells(covs, 1000)
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]), (0.3, 0.1, -0.2)
    met = len(np.unique(x // 1000, axis=0))
    assert GI.few_cells(d, 1000) and GI.few_cells(d, 1000, met) and not GI.few_cells(d, 1000, met - 1)
    for around in (7, 27):
        many, few = (GI.normal_equations(covs, cells, 1000, pose, around, f).first() for f in (False, True))
        assert many["c"] == few["c"] > 900
        assert np.allclose(list(many), list(few), rtol=1e-9, atol=1e-6)


def test_gicp_equations_search_once_and_shuffle_no_pairs(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no join is small by its size
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["gicp_equations"](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    moments = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert all("hashpartitioning(scan_id" in line for line in moments)  # equal points do not meet in one task
    assert len(moments) == 2 and sum("ReusedExchange" in line for line in moments) == 1
