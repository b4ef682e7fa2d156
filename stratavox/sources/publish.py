"""What is shown: near-surface voxels as coloured points (S16), the map's edges (S17), paths and odometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import surface_colour
from stratavox.operators.filters import iso_cells


def surface_points(voxels: DataFrame, tau: int, res: int) -> DataFrame:
    """Centres of near-surface cells in millimetres with red and green."""
    red, green = surface_colour("value", tau)
    v = iso_cells(voxels, tau)
    return v.select(*[(F.col(f"i{a}") * res + res // 2).alias(a) for a in "xyz"], red.alias("red"), green.alias("green"))


def coloured(points: DataFrame, red: float, green: float, blue: float) -> DataFrame:
    """One colour for all points."""
    return points.select("*", F.lit(red).alias("red"), F.lit(green).alias("green"), F.lit(blue).alias("blue"))


#: Corner pairs of a box, by bits of x, y and z: the pairs that differ in one bit.
EDGES = [(a, a | bit) for a in range(8) for bit in (1, 2, 4) if not a & bit]


def window_edges(spark: SparkSession, pos: tuple, size: tuple, res: int) -> DataFrame:
    """The twelve edges of a window as segments in millimetres."""
    at = lambda corner, i: (pos[i] + (size[i] // 2 if corner >> i & 1 else -(size[i] // 2))) * res
    rows = [(k, *[at(a, i) for i in range(3)], *[at(b, i) for i in range(3)]) for k, (a, b) in enumerate(EDGES)]
    return spark.createDataFrame(rows, "edge bigint, x0 bigint, y0 bigint, z0 bigint, x1 bigint, y1 bigint, z1 bigint")


def path_of(poses: DataFrame, by: str = "session", order: str = "seq", last: int = 1000) -> DataFrame:
    """Each pose with its path, the up to `last` positions to it; a bounded window."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(last - 1), 0)
    return poses.withColumn("path", F.collect_list(F.struct("tx", "ty", "tz")).over(w))


def publish(df: DataFrame, topic: str, checkpoint: str, fmt: str = "memory", **options):
    """A streaming frame to a sink by name; returns the running query."""
    return df.writeStream.format(fmt).queryName(topic).option("checkpointLocation", checkpoint).options(**options).start()
