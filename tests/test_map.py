"""Map window and chunk store: single-ray golden values, round trips, shifts."""

import pytest

from stratavox.operators.mapstore import LocalMap, dense_chunks, read_map, touched_cells, write_map
from stratavox.operators.tsdf import merge_in_order, merge_nearest, ray_march, upsert
from stratavox.schemas import VOXELS

GOLDEN = {1: (3000, 64), 2: (3000, 64), 3: (2000, 64), 4: (1000, 64), 5: (0, 64), 6: (-1000, 47), 7: (-2000, 23)}


def single_ray(spark):
    p = spark.createDataFrame([(0, 0, 5500, 500, 500)], "scan_id bigint, idx bigint, x bigint, y bigint, z bigint")
    return merge_nearest(ray_march(p, 1000, 3000, window=((0, 0, 0), (21, 21, 21)), dz_per_distance=100))


def as_dict(df):
    return {(r.ix, r.iy, r.iz): (r.value, r.weight) for r in df.collect()}


def test_single_ray_golden(spark):
    assert as_dict(single_ray(spark)) == {(x, 0, 0): e for x, e in GOLDEN.items()}


def test_round_trip_through_chunks(spark, tmp_path):
    v = single_ray(spark)
    write_map(v, str(tmp_path / "map"))
    assert as_dict(read_map(spark, str(tmp_path / "map"))) == as_dict(v)
    dense = dense_chunks(v, 3000)
    assert dense.count() == 1 and len(dense.first()["data"]) == 64**3
    assert dense.first()["data"][8 * 4096] == 3000
    assert as_dict(touched_cells(dense)) == as_dict(v)


def test_window_prunes_chunks(spark, tmp_path):
    v = spark.createDataFrame([(x, 0, 0, x, 64) for x in (-70, -1, 0, 63, 64, 200)], VOXELS)
    write_map(v, str(tmp_path / "map"))
    near = read_map(spark, str(tmp_path / "map"), ((0, 0, 0), (129, 3, 3)))
    assert set(as_dict(near)) == {(-1, 0, 0), (0, 0, 0), (63, 0, 0), (64, 0, 0)}
    assert "PartitionFilters: [isnotnull(cx" in near._jdf.queryExecution().toString()


def test_upsert_rewrites_touched_chunks_only(spark, tmp_path):
    path = str(tmp_path / "map")
    write_map(spark.createDataFrame([(0, 0, 0, 1, 64), (100, 0, 0, 2, 64)], VOXELS), path)
    write_map(spark.createDataFrame([(0, 0, 0, 9, 64), (1, 0, 0, 8, 64)], VOXELS), path, "upsert")
    assert as_dict(read_map(spark, path)) == {(0, 0, 0): (9, 64), (1, 0, 0): (8, 64), (100, 0, 0): (2, 64)}


def test_shift_out_and_back(spark):
    m = LocalMap(spark.createDataFrame([], VOXELS), (5, 5, 5), (4, 6))
    cells = {(-2, 2, 0): (0, 0), (-1, 2, 0): (1, 1), (-2, 1, 0): (2, 1), (-1, 1, 0): (3, 2), (-2, 0, 0): (4, 3), (-1, 0, 0): (5, 5)}
    for c, e in cells.items():
        m.set(*c, *e)
    m.voxels = m.voxels.checkpoint()
    assert m.pos == (0, 0, 0) and m.offset == (2, 2, 2)
    assert m.holds(0, 2, -2) and not m.holds(22, 0, 0) and m.value(0, 0, 0) == (4, 6)
    for x in (5, 10, 15, 20, 24):
        m.shift((x, 0, 0))
    assert m.offset == (26 % 5, 2, 2) and m.holds(22, 0, 0) and not m.holds(0, 2, -2)
    assert m.value(24, 0, 0) == (4, 6)
    for pos in ((24, 0, 0), (24, 5, 0), (19, 5, 0), (19, 0, 0)):
        m.shift(pos)
        m.set(*pos, pos[0], pos[1])
    m.voxels = m.voxels.checkpoint()
    for pos in ((24, 0, 0), (24, 5, 0), (19, 5, 0), (19, 0, 0)):
        m.shift(pos)
        assert m.value(*pos) == pos[:2]
    for x in (19, 14, 9, 4, 0):
        m.shift((x, 0, 0))
    assert m.pos == (0, 0, 0) and m.offset == (2, 2, 2)
    assert m.value(0, 0, 0) == (4, 6) and m.value(-1, 2, 0) == (1, 1)


def test_merge_rules_differ_where_known(spark):
    rows = [(0, 0, 0, 0, 0, 1, 0, 1, 1, 1, v, w) for v, w in ((100, 64),)] + [(0, 1, 0, 0, 0, 1, 0, 1, 1, 1, 50, -64), (0, 2, 0, 0, 0, 1, 0, 1, 1, 1, 200, 64)]
    cells = spark.createDataFrame(rows, "scan_id bigint, idx bigint, x bigint, y bigint, z bigint, len bigint, step bigint, ix bigint, iy bigint, iz bigint, value bigint, weight bigint")
    assert as_dict(merge_in_order(cells)) == {(1, 1, 1): (200, 64)}
    assert as_dict(merge_nearest(cells)) == {(1, 1, 1): (100, 64)}
    assert as_dict(merge_nearest(cells.repartition(4).orderBy("value"))) == {(1, 1, 1): (100, 64)}


def test_weighted_upsert(spark):
    a = spark.createDataFrame([(0, 0, 0, 100, 64), (1, 0, 0, 7, 640), (2, 0, 0, 5, -3), (3, 0, 0, 1, 9)], VOXELS)
    b = spark.createDataFrame([(0, 0, 0, -50, 32), (1, 0, 0, 7, 64), (2, 0, 0, 6, 64), (4, 0, 0, 2, -8)], VOXELS)
    assert as_dict(upsert(a, b, 640)) == {(0, 0, 0): (50, 96), (1, 0, 0): (7, 640), (2, 0, 0): (6, 64), (3, 0, 0): (1, 9), (4, 0, 0): (2, -8)}


def test_merge_order_beyond_the_packed_bits(spark):
    order = ("scan_id", "idx", "x", "y", "z", "len", "step")
    schema = ", ".join(f"{c} bigint" for c in (*order, "ix", "iy", "iz", "value", "weight"))
    far = [(0, 300_001, 0, 0, 0, 1, 20, 0, 0, 0, 50, 32), (0, 300_000, 0, 0, 0, 1, 30, 0, 0, 0, -50, 64), (0, 5, 0, 0, 0, 1, 17, 1, 0, 0, 7, 1), (0, 5, 0, 0, 0, 1, 16, 1, 0, 0, -7, 2), (0, -1, 0, 0, 0, 1, 0, 2, 0, 0, 9, 3)]
    cells = spark.createDataFrame(far, schema)
    assert as_dict(merge_nearest(cells, wide=True)) == as_dict(merge_in_order(cells)) == {(0, 0, 0): (-50, 64), (1, 0, 0): (-7, 2), (2, 0, 0): (9, 3)}
    for at in range(5):
        if at != 2:
            with pytest.raises(Exception, match="out of range"):
                merge_nearest(cells.filter(f"ix = {far[at][7]}")).collect()
    near = spark.createDataFrame([(0, 2**18 - 1, 0, 0, 0, 1, 15, 0, 0, 0, 50, 32), (0, 2**18 - 2, 0, 0, 0, 1, 15, 0, 0, 0, -50, 64)], schema)
    assert as_dict(merge_nearest(near)) == {(0, 0, 0): (-50, 64)}


def test_conditions_on_merged_cells_stay_above_the_merge(spark):
    from stratavox.plans.queries import QUERIES

    plan = QUERIES["map_shift_leaving"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Aggregate", 1)
    assert "_kept" in above and "_kept" not in below and "<= 2" not in below
