"""Java compiles no method of over 8000 bytes, and runs it slowly; queries stay below that."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratavox.functions import linalg as L
from stratavox.operators.tsdf import ray_march
from stratavox.session import unchecked

SMALL = "/root/testdata/sf0.001"


def largest_method(spark, df):
    plan = df._jdf.queryExecution().executedPlan()
    parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.length()))


@pytest.fixture
def plain(spark):
    """A session whose plans are final before they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["twist_transform", "se3_exponential", "matrix4_algebra"])
def test_methods_are_small_enough_for_java_to_compile(plain, name):
    assert largest_method(plain, entry.queries()[name](plain, SMALL)) < 8000


def test_columns_by_steps_equal_the_array_forms(spark):
    xi = [[0.3, -0.2, 0.1, 1.0, 2.0, -3.0], [0.0, 0.0, 0.0, 1.0, -1.0, 2.0], [1e-8, 0.0, 0.0, 0.5, 0.5, 0.5], [3.0, 1.0, -2.0, 0.0, 0.0, 4.0]]
    names = [f"t{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(x) for x in xi], ", ".join(f"{n} double" for n in names))
    centre = [F.lit(c) for c in (1.5, -2.25, 0.5)]
    for columns, array in ((L.se3_columns(df, names), L.se3_exp([F.col(n) for n in names])), (L.twist_columns(df, names, centre), L.twist_to_transform([F.col(n) for n in names], centre))):
        got = columns[0].select(F.array(*columns[1]).alias("got"), array.alias("want")).collect()
        assert len(got) == 4 and all(r.got == r.want[:12] for r in got)


def test_inverse_by_minors(spark):
    names = [f"m{i}" for i in range(16)]
    ms = [*np.random.default_rng(3).normal(size=(20, 4, 4)), np.zeros((4, 4))]
    df, det, x = L.inverse4_columns(spark.createDataFrame([tuple(map(float, m.ravel())) for m in ms], ", ".join(f"{n} double" for n in names)), names)
    rows = df.select(F.array(*names).alias("m"), det.alias("d"), F.array(*x).alias("x")).collect()
    for r in rows:
        m = np.array(r.m).reshape(4, 4)
        assert np.isclose(r.d, np.linalg.det(m))
        if m.any():
            assert np.allclose(np.array(r.x).reshape(4, 4), np.linalg.inv(m))
        else:
            assert r.x == [None] * 16
    assert len(rows) == 21


def codes_of(spark, df):
    plan = df._jdf.queryExecution().executedPlan()
    parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    return "".join(parts.apply(i)._2() for i in range(parts.length()))


def test_march_in_a_window_does_not_test_for_overflow(plain):
    pts = plain.createDataFrame([(1, i, 5000 + 700 * i, 300 - 41 * i, 900 - 13 * i) for i in range(20)], "scan_id bigint, idx bigint, x bigint, y bigint, z bigint")
    plain.conf.set("spark.sql.ansi.enabled", "true")
    try:
        near = ray_march(pts, 1000, 3000, window=((0, 0, 0), (61, 61, 61)), dz_per_distance=2000)
        wide = ray_march(pts, 1000, 3000, window=((0, 0, 0), (1 << 21,) * 3), dz_per_distance=2000)
        free = ray_march(pts, 1000, 3000, dz_per_distance=2000)
        assert plain.conf.get("spark.sql.ansi.enabled") == "true"
        assert "multiplyExact" not in codes_of(plain, near) and all("multiplyExact" in codes_of(plain, df) for df in (wide, free))
        rows = [sorted(map(tuple, df.collect())) for df in (near, wide, free)]
        assert rows[0] and any(r[near.columns.index("step")] > 0 for r in rows[0]) and rows[0] == rows[1] == rows[2]
        far = plain.createDataFrame([(1, 0, 1 << 40, 1 << 40, 5)], "scan_id bigint, idx bigint, x bigint, y bigint, z bigint")
        with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
            ray_march(far, 1 << 39, 1 << 38).collect()
        with pytest.raises(ValueError), unchecked(plain):
            raise ValueError
        assert plain.conf.get("spark.sql.ansi.enabled") == "true"
    finally:
        plain.conf.unset("spark.sql.ansi.enabled")
