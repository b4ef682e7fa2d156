"""Filters and gates (F1-F18) and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import in_bounds, lng


def near_origin(x: str = "x", y: str = "y", z: str = "z", limit=300, mode: str = "signed") -> Column:
    """F1. "signed" (the reference's rule) also holds for the whole negative octant; "ball" compares absolute values."""
    parts = [F.col(c) if mode == "signed" else F.abs(F.col(c)) for c in (x, y, z)]
    return (parts[0] < limit) & (parts[1] < limit) & (parts[2] < limit)


def drop_near_origin(points: DataFrame, limit=300, mode: str = "signed") -> DataFrame:
    return points.filter(~near_origin(limit=limit, mode=mode))


def drop_zero(points: DataFrame) -> DataFrame:
    """the exact origin means no return."""
    return points.filter(~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)))


def box(points: DataFrame, half: tuple, centre: tuple = (0, 0, 0), cols: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Inside the closed box around a centre."""
    for c, h, m in zip(cols, half, centre, strict=True):
        points = points.filter(F.col(c).between(m - h, m + h))
    return points


def squared_distance(centre: tuple, cols: tuple[str, str, str] = ("x", "y", "z")) -> Column:
    """O2."""
    return sum(((F.col(c) - m) * (F.col(c) - m) for c, m in list(zip(cols, centre, strict=True))[1:]), (F.col(cols[0]) - centre[0]) * (F.col(cols[0]) - centre[0]))


def radius(points: DataFrame, r, centre: tuple = (0, 0, 0), planar: bool = False) -> DataFrame:
    """inside the ball (or cylinder); compares squared lengths."""
    cols = ("x", "y") if planar else ("x", "y", "z")
    d2 = sum(((F.col(c) - m) * (F.col(c) - m) for c, m in zip(cols[1:], centre[1:], strict=False)), (F.col("x") - centre[0]) * (F.col("x") - centre[0]))
    return points.filter(d2 <= r * r)


def range_gate(points: DataFrame, least, most) -> DataFrame:
    """F3 as a mark: in_range holds for least <= range <= most, in squared integers."""
    d2 = lng("x") * lng("x") + lng("y") * lng("y") + lng("z") * lng("z")
    return points.withColumn("in_range", (d2 >= least * least) & (d2 <= most * most))


def intensity_gate(points: DataFrame, least=50, col: str = "intensity") -> DataFrame:
    """F4 as a mark: dim holds below the limit."""
    return points.withColumn("dim", F.col(col) < least)


def drop_nan(points: DataFrame, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """F8: rows with a NaN or null coordinate go."""
    for c in cols:
        points = points.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return points


def in_window(cells: DataFrame, pos: tuple, size: tuple, buffer: int = 0, cols: tuple[str, str, str] = ("ix", "iy", "iz")) -> DataFrame:
    """cells of the local map, a box of odd sides around pos, tightened by buffer cells."""
    for c, p, s in zip(cols, pos, size, strict=True):
        cells = cells.filter(in_bounds(c, p, s, buffer))
    return cells


def iso_cells(voxels: DataFrame, tau: int) -> DataFrame:
    """observed cells near the surface."""
    return voxels.filter((F.col("weight") > 0) & (F.abs("value") < tau))


def fitness_gate(transform: Column, score: Column, limit: float) -> Column:
    """the identity (4x4, row-major) where the score is over the limit."""
    return F.when(score > limit, F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])).otherwise(transform)


def plane_holds(residuals: Column, limit: float = 0.2) -> Column:
    """every neighbour's residual is small."""
    return F.forall(residuals, lambda r: F.abs(r) <= limit)


def full_scans(points: DataFrame, least: int, most: int | None = None, key: str = "scan_id") -> DataFrame:
    """rows of scans (or rings) with enough and not too many points; counts are aggregated, then joined."""
    counts = points.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    if most is not None:
        counts = counts.filter(F.col("_n") <= most)
    return points.join(counts.select(key), key, "left_semi")


def ring_in_range(points: DataFrame, channels: int) -> DataFrame:
    return points.filter(F.col("ring").between(0, channels - 1))


def union_clouds(*clouds: DataFrame) -> DataFrame:
    """U1."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c)
    return out


def complement(points: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that were not picked."""
    return points.join(picked.select(*keys).distinct(), keys, "left_anti")


def distance_gate(poses: DataFrame, limit: float, partition: str = "session", order: str = "seq") -> DataFrame:
    """F16: keeps a pose if it is at least `limit` from the last kept one (the first always). A fold per session, in order.

    The state is one pose, so partitions stream through sorted: no session is ever held whole.
    """
    schema = poses.schema

    def run(batches):
        import numpy as np

        last, session = None, object()
        for b in batches:
            keys, xs = b.column(partition), np.stack([np.asarray(b.column(c), float) for c in ("tx", "ty", "tz")], 1)
            keep = []
            for i, s in enumerate(keys.to_pylist()):
                if s != session:
                    session, last = s, None
                if last is None or float(np.linalg.norm(xs[i] - last)) >= limit:
                    last = xs[i]
                    keep.append(i)
            if keep:
                yield b.take(keep)

    return poses.repartition(partition).sortWithinPartitions(partition, order).mapInArrow(run, schema)


def first_by(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order, through a bounded aggregate rather than a sort of each group."""
    rest = [c for c in points.columns if c not in keys]
    picked = points.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def lru_rank(access: DataFrame, group: str, key: list[str], when: str) -> DataFrame:
    """Age rank of chunks in a group, most recent first."""
    last = access.groupBy(group, *key).agg(F.max(when).alias("last"))
    return last.withColumn("age", F.row_number().over(Window.partitionBy(group).orderBy(F.col("last").desc(), *key)) - 1)
