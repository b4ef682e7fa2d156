"""Run-time statistics (A12), histograms (A13) and measurement sheets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import idiv
from stratavox.operators.timeseries import sliding_mean


def runtime_stats(timings: DataFrame, skip: int = 1, key: str = "task", seq: str = "seq", value: str = "micros") -> DataFrame:
    """Count, last, sum, min, average (truncating) and max without the first (skip 1) or second (skip 2) sample of a task."""
    first = timings.groupBy(key).agg(F.min(seq).alias("s1"))
    t = timings.join(first, key)
    if skip == 2:
        second = t.filter(F.col(seq) > F.col("s1")).groupBy(key).agg(F.min(seq).alias("s2"))
        t = t.join(second, key, "left").withColumn("_skip", F.col("s2"))
    else:
        t = t.withColumn("_skip", F.col("s1"))
    v = F.col(value)
    return t.groupBy(key).agg(F.count("*").alias("n"), F.max_by(value, seq).alias("last"), F.sum(v).alias("total"), F.min(v).alias("least"), F.coalesce(F.max(F.when(F.col(seq) != F.coalesce("_skip", F.lit(-1)), v)), F.lit(0)).alias("most"), idiv(F.sum(v), F.count("*")).alias("average"))


def run_average(timings: DataFrame, n: int = 10, key: str = "task", seq: str = "seq", value: str = "micros") -> DataFrame:
    """A12's run_avg: the sliding mean of a task's samples, as of its last one."""
    return sliding_mean(timings, value, n, (key,), (seq,), "run_avg").groupBy(key).agg(F.max_by("run_avg", seq).alias("run_avg"))


def runtime_histogram(timings: DataFrame, width: int = 10_000, buckets: int = 10, key: str = "task", value: str = "micros") -> DataFrame:
    """Counts in buckets of `width`; the last is open-ended."""
    return timings.groupBy(key, F.least(idiv(value, width), F.lit(buckets - 1).cast("bigint")).alias("bucket")).agg(F.count("*").alias("n"))


def write_sheet(df: DataFrame, folder: str, name: str, sep: str = ",", dated: datetime | None = None) -> str:
    """A named sheet with a header, in a subfolder of the date and time if given; returns its place."""
    path = f"{folder}/{dated:%Y-%m-%d_%H-%M-%S}/{name}" if dated else f"{folder}/{name}"
    df.write.mode("errorifexists").csv(path, header=True, sep=sep)
    return path


def measurement_sheet(measures: DataFrame, series: str, run: str, value: str, runs: int) -> DataFrame:
    """One row per series, its runs as columns named 0 to runs - 1."""
    return measures.groupBy(series).pivot(run, list(range(runs))).agg(F.first(value))


def timed(df: DataFrame, key: str, order: str) -> DataFrame:
    """Sequence numbers of samples within their task, from 0."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
