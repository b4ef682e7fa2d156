"""Driver tables as clouds, samples, scans and poses; deterministic, with integers that any SQL engine reproduces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import idiv, lng

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
ORDERS_PER_SCAN = 1000
GRID_WIDTH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, x, y, z (mm), intensity and the ordering columns. A scan has a bounded number of orders, so scans stay small as data grows."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        idiv("l_orderkey", ORDERS_PER_SCAN).alias("scan_id"),
        (F.floor("l_extendedprice") - 52500).cast("bigint").alias("x"),
        ((F.col("l_partkey") * 53) % 40001 - 20000).cast("bigint").alias("y"),
        (F.col("l_quantity").cast("bigint") * 400 - 10000).alias("z"),
        lng("l_suppkey").alias("intensity"),
        *ORDER,
    )


def points(spark: SparkSession, sf_dir: str, per_task: int | None = None) -> DataFrame:
    """scan_id, idx (order in the scan), x, y, z, intensity. `per_task` deals whole scans over as many tasks as leave about so many
    points to each, for steps that make many rows of a point and hold them; Spark would put tasks together by the bytes of the points."""
    w = Window.partitionBy("scan_id").orderBy(*ORDER)
    raw = raw_points(spark, sf_dir)
    if per_task:
        raw = raw.repartition(max(spark.sparkContext.defaultParallelism, -(-raw.count() // per_task)), "scan_id")
    return raw.withColumn("idx", lng(F.row_number().over(w) - 1)).select("scan_id", "idx", "x", "y", "z", "intensity")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points on lines of GRID_WIDTH columns: ring, col, range (truncated mm); only whole lines."""
    p = points(spark, sf_dir).withColumns({"ring": idiv("idx", GRID_WIDTH), "col": F.pmod("idx", F.lit(GRID_WIDTH))})
    whole = p.groupBy("scan_id", "ring").agg(F.count("*").alias("_n")).filter(F.col("_n") == GRID_WIDTH).select("scan_id", "ring")
    p = p.join(whole, ["scan_id", "ring"], "left_semi")
    return p.withColumn("range", F.floor(F.sqrt((F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).cast("double"))).cast("bigint"))


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, sensor_id, ts, w (integer rate)."""
    t = table(spark, sf_dir, "events").filter("event_type <> 'view'")
    return t.select("event_id", F.col("user_id").alias("sensor_id"), "ts", F.floor(F.col("value") * 100).cast("bigint").alias("w"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return t.select(F.col("event_id").alias("scan_key"), F.col("user_id").alias("sensor_id"), "ts")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session (customer), seq (order key) and a millimetre translation."""
    t = table(spark, sf_dir, "orders")
    return t.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").cast("bigint").alias("tx"), (F.col("o_orderkey") * 37 % 5003).cast("bigint").alias("ty"), (F.col("o_custkey") * 11 % 701).cast("bigint").alias("tz"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select(F.col("event_type").alias("task"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 300).cast("bigint").alias("micros"))


def pose_increments(spark: SparkSession, n: int, degrees: float = 15.0, forward: float = 0.5) -> DataFrame:
    """A synthetic walk: session 0, n equal steps of a turn about z and a move along x, for pose folds."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    rot = F.array(*[F.lit(float(v)) for v in (c, -s, 0, s, c, 0, 0, 0, 1)])
    return spark.range(n).select(F.lit(0).cast("bigint").alias("session"), F.col("id").alias("seq"), rot.alias("rotation"), F.lit(forward).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"))
