"""Voxel aggregates (A1*, A10) and box enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import cell_trunc, chunk_of, fdiv, fixed_transform, idiv, in_chunk_index, lng, voxel_centre
from stratavox.operators.filters import first_by

AXES = ("x", "y", "z")


def distinct_voxels(points: DataFrame, res: int, matrix: list[list[int]] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A1: the set of voxel centres, optionally moved by a fixed-point pose; centres are made distinct before they are moved."""
    centres = points.select(*keys, *[voxel_centre(a, res).alias(a) for a in AXES]).distinct()
    if matrix is None:
        return centres
    return centres.select(*keys, *[c.alias(a) for c, a in zip(fixed_transform("x", "y", "z", matrix), AXES, strict=True)]).distinct()


def first_hit(points: DataFrame, res: int, keys: tuple[str, ...] = ("scan_id",), order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """The first raw point of each truncated cell."""
    cells = points.select(*keys, *[cell_trunc(a, res).alias(f"i{a}") for a in AXES], *order, *AXES)
    return first_by(cells, [*keys, "ix", "iy", "iz"], [*order, *AXES])


def voxel_mean(points: DataFrame, res: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Integer mean of each floored cell, truncating."""
    g = points.groupBy(*keys, *[fdiv(a, res).alias(f"i{a}") for a in AXES]).agg(F.count("*").alias("n"), *[F.sum(lng(a)).alias(f"s{a}") for a in AXES])
    return g.select(*keys, "ix", "iy", "iz", "n", *[idiv(f"s{a}", "n").alias(a) for a in AXES])


def voxel_centroid(points: DataFrame, leaf: int, keys: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """A1d-A1f: exact mean of each leaf, of coordinates and extra columns."""
    g = points.groupBy(*keys, *[fdiv(a, leaf).alias(f"i{a}") for a in AXES])
    return g.agg(F.count("*").alias("n"), *[F.avg(F.col(a)).alias(a) for a in (*AXES, *extra)])


def approximate_grid(points: DataFrame, leaf: int, keys: tuple[str, ...] = ("scan_id",), order: tuple[str, ...] = ("idx",), slots: int = 512) -> DataFrame:
    """A1e: the means that a hash table of `slots` (a power of two) gives out when every cell has one slot and a point of another cell in it
    flushes what the slot holds: keys, slot, run, ix, iy, iz, n and the means. A cell can come out several times.

    A slot's points, in order, are runs of one cell, so the table is a window over slots and an aggregate over runs. Keys bound a group.
    """
    cells = points.select(*keys, *order, *[lng(a).alias(a) for a in AXES], *[fdiv(a, leaf).alias(f"i{a}") for a in AXES])
    slot = (F.col("ix") * 7171 + F.col("iy") * 3079 + F.col("iz") * 4231).bitwiseAND(F.lit(slots - 1))
    w = Window.partitionBy(*keys, "slot").orderBy(*order)
    same = [F.col(f"i{a}") == F.lag(f"i{a}").over(w) for a in AXES]
    runs = cells.withColumn("slot", slot).withColumn("_new", F.when(same[0] & same[1] & same[2], 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "slot", "run", "ix", "iy", "iz").agg(F.count("*").alias("n"), *[(F.sum(a).cast("double") / F.count("*")).alias(a) for a in AXES])


def demean(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A10: points minus the truncated centroid of their group; the centroids are aggregated and joined."""
    mean = points.groupBy(*keys).agg(*[idiv(F.sum(lng(a)), F.count("*")).alias(f"m{a}") for a in AXES])
    rest = [c for c in points.columns if c not in AXES]
    return points.join(mean, list(keys)).select(*rest, *[(F.col(a) - F.col(f"m{a}")).alias(a) for a in AXES])


def chunk_histogram(cells: DataFrame) -> DataFrame:
    """Cells, distinct cells and the least in-chunk index of every chunk."""
    c = cells.select(*[chunk_of(f"i{a}").alias(f"c{a}") for a in AXES], in_chunk_index("ix", "iy", "iz").alias("slot"))
    slots = c.groupBy("cx", "cy", "cz", "slot").agg(F.count("*").alias("k"))
    return slots.groupBy("cx", "cy", "cz").agg(F.sum("k").cast("bigint").alias("points"), F.count("*").alias("cells"), F.min("slot").alias("first_slot"))


def dense_box(spark, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Every cell of a closed box with its chunk; generated in parallel along x."""
    df = spark.range(low[0], high[0] + 1).select(F.col("id").alias("ix"))
    df = df.withColumn("iy", F.explode(F.sequence(F.lit(low[1]).cast("bigint"), F.lit(high[1]).cast("bigint")))).withColumn("iz", F.explode(F.sequence(F.lit(low[2]).cast("bigint"), F.lit(high[2]).cast("bigint"))))
    return df.select("ix", "iy", "iz", *[chunk_of(f"i{a}").alias(f"c{a}") for a in AXES])
