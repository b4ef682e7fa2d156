"""Inertial integration, alignment, folds."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import filters as FI
from stratavox.operators import metrics as ME
from stratavox.operators import timeseries as TS

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def turns(spark, wz):
    imu = spark.createDataFrame([(1, START + dt.timedelta(milliseconds=250 * i), 0.0, 0.0, wz) for i in range(7)], "sensor_id bigint, ts timestamp, wx double, wy double, wz double")
    scans = spark.createDataFrame([(1, START + dt.timedelta(milliseconds=250 * k), n) for n, k in ((10, 4), (11, 6))], "sensor_id bigint, ts timestamp, scan_key bigint")
    a = TS.assign_to_next(imu, scans, by=("sensor_id",)).withColumn("stamp", F.col("ts"))
    return {r.scan_key: np.reshape(r.rotation, (3, 3)) for r in TS.integrate_rotation(a).collect()}


@pytest.mark.parametrize("sign", [1, -1])
def test_half_then_quarter_turn(spark, sign):
    rot = turns(spark, sign * np.pi)
    assert np.allclose(rot[10] @ [5, 0, 0], [-5, 0, 0], atol=1e-3)
    pts = np.array([(5, 0, 0), (2, 2, 2), (1, 2, 100), (540, 244, 124), (-3, -2, 2)], float)
    assert np.allclose(pts @ rot[10].T, pts * [-1, -1, 1], atol=1e-3)
    assert np.allclose(rot[11] @ [5, 0, 0], [0, 5 * sign, 0], atol=1e-3)


def test_sliding_mean_and_late_samples(spark):
    v = spark.createDataFrame([(1, i, x) for i, x in enumerate((3, 6, 9, 12))], "k bigint, i bigint, v bigint")
    got = [r.smooth for r in TS.sliding_mean(v, "v", 3, ("k",), ("i",)).orderBy("i").collect()]
    assert got == [3, 6, 9, 9]


def test_distance_gate_is_a_fold(spark):
    p = spark.createDataFrame([(1, i, float(x), 0.0, 0.0) for i, x in enumerate((0, 0.2, 0.4, 0.5, 1.5))] + [(2, 0, 9.0, 0.0, 0.0)], "session bigint, seq bigint, tx double, ty double, tz double")
    got = sorted((r.session, r.seq) for r in FI.distance_gate(p, 0.3).collect())
    assert got == [(1, 0), (1, 2), (1, 4), (2, 0)]


def test_pose_fold_and_prediction(spark):
    c, s = 0.0, 1.0
    rot = [c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0]
    steps = spark.createDataFrame([(1, i, rot, 1.0, 0.0, 0.0) for i in range(3)], "session bigint, seq bigint, rotation array<double>, tx double, ty double, tz double")
    last = TS.accumulate_poses(steps).orderBy("seq").collect()[-1]
    assert last.tx == 3.0 and np.isclose(abs(last.qz), np.sin(3 * np.pi / 4))
    poses = spark.createDataFrame([(1, i, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], float(i * 2), 0.0, 0.0) for i in range(3)], steps.schema)
    assert np.reshape(TS.predict_constant_velocity(poses).orderBy("seq").collect()[-1].next_pose, (4, 4))[0, 3] == 6.0


def test_runtime_statistics(spark):
    t = spark.createDataFrame([("a", i, v) for i, v in enumerate((90_000, 50_000, 10_000))], "task string, seq bigint, micros bigint")
    r = ME.runtime_stats(t).first()
    assert (r.n, r["last"], r.total, r.least, r.most, r.average) == (3, 10_000, 150_000, 10_000, 50_000, 50_000)
    assert ME.runtime_stats(t, skip=2).first().most == 90_000
    h = spark.createDataFrame([("a", int(v * 1000)) for v in (9.9, 10.0, 95, 1000)], "task string, micros bigint")
    assert {(r.bucket, r.n) for r in ME.runtime_histogram(h).collect()} == {(0, 1), (1, 1), (9, 2)}


def test_sheets(spark, tmp_path):
    m = spark.createDataFrame([("kd", 0, 5), ("kd", 1, 6)], "series string, run int, v int")
    sheet = ME.measurement_sheet(m, "series", "run", "v", 2)
    assert sheet.columns == ["series", "0", "1"]
    ME.write_sheet(sheet, str(tmp_path / "s"), "times", ";")
    assert spark.read.csv(str(tmp_path / "s" / "times"), header=True, sep=";").first().asDict() == {"series": "kd", "0": "5", "1": "6"}


def test_synthetic_walk(spark):
    from stratavox.sources.adapters import pose_increments

    last = TS.accumulate_poses(pose_increments(spark, 24)).orderBy("seq").collect()[-1]
    assert np.isclose(last.tx, 12.0) and np.isclose(abs(last.qw), 1.0)  # a full turn; translations only add
