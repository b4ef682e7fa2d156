"""Point-to-map registration: gradients (J2, E17), point lookup (J1), Jacobians (E18), normal equations (A3), the solver loop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import cell_trunc, fixed_matrix, fixed_transform, idiv, lng
from stratavox.functions.linalg import np_twist_to_transform

AXES = ("x", "y", "z")


def gradients(voxels: DataFrame) -> DataFrame:
    """ix, iy, iz, value, weight, gx, gy, gz. Each axis is one window over lines of cells; neighbours must be adjacent and observed.

    Differences across a change of sign are zero, as are those with a missing or unobserved neighbour.
    """
    df = voxels.select("ix", "iy", "iz", "value", "weight")
    for a in AXES:
        w = Window.partitionBy(*[f"i{b}" for b in AXES if b != a]).orderBy(f"i{a}")
        i = F.col(f"i{a}")
        here = F.struct(i.alias("i"), "value", "weight")
        df = df.withColumns({"_n": F.lead(here).over(w), "_l": F.lag(here).over(w)})
        nv, lv = F.col("_n.value"), F.col("_l.value")
        ok = (F.col("_n.i") == i + 1) & (F.col("_l.i") == i - 1) & (F.col("_n.weight") != 0) & (F.col("_l.weight") != 0) & ~(((nv > 0) & (lv < 0)) | ((nv < 0) & (lv > 0)))
        df = df.withColumn(f"g{a}", F.when(ok, idiv(nv - lv, 2)).otherwise(F.lit(0).cast("bigint"))).drop("_n", "_l")
    return df


def match_points(points: DataFrame, gradient_map: DataFrame, res: int, matrix: list[list[int]], keys: tuple[str, ...] = ("scan_id", "idx")) -> DataFrame:
    """Moved points with the observed cell they fall in. Adaptive execution broadcasts the map side if it proves small at run time."""
    moved = points.select(*keys, *[c.alias(a) for c, a in zip(fixed_transform("x", "y", "z", matrix), AXES, strict=True)])
    moved = moved.select("*", *[cell_trunc(a, res).alias(f"i{a}") for a in AXES])
    return moved.join(gradient_map.filter("weight <> 0"), ["ix", "iy", "iz"])


def jacobians(matched: DataFrame, centre: tuple[int, int, int]) -> DataFrame:
    """j0..j5 = (p - centre) x gradient, gradient."""
    p = [lng(a) - int(c) for a, c in zip(AXES, centre, strict=True)]
    g = [F.col(f"g{a}") for a in AXES]
    j = [p[1] * g[2] - p[2] * g[1], p[2] * g[0] - p[0] * g[2], p[0] * g[1] - p[1] * g[0], *g]
    return matched.select("*", *[c.alias(f"j{i}") for i, c in enumerate(j)])


def _exact_sum(product: Column) -> Column:
    """Sum of 64-bit integers as a decimal: their halves are summed apart, as the sum of many need not fit 64 bits."""
    high, low = F.sum(F.shiftright(product, 32)), F.sum(product.bitwiseAND(F.lit(0xFFFFFFFF)))
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + low.cast("decimal(20,0)")).cast("decimal(32,0)")


def normal_equations(jac: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A3: the 21 distinct sums of J J^T, the 6 of J v (decimals), the summed |v| and the count, in one aggregate with partial sums."""
    h = [_exact_sum(F.col(f"j{i}") * F.col(f"j{k}")).alias(f"h{i}{k}") for i in range(6) for k in range(i, 6)]
    g = [_exact_sum(F.col(f"j{i}") * F.col("value")).alias(f"g{i}") for i in range(6)]
    return jac.groupBy(*keys).agg(*h, *g, F.sum(F.abs("value")).alias("e"), F.count("*").alias("c"))


def sums(df: DataFrame, col: str, keys: tuple[str, ...] = (), parts: int = 1, part_of: str | None = None) -> DataFrame:
    """A4: total of a column, and its split into `parts` by part_of modulo parts."""
    split = [F.sum(F.when(F.pmod(F.col(part_of), F.lit(parts)) == k, F.col(col)).otherwise(0)).alias(f"part{k}") for k in range(parts)] if part_of else []
    return df.groupBy(*keys).agg(F.sum(col).alias("total"), *split)


def covariance(df: DataFrame, cols: tuple[str, ...], others: tuple[str, ...] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A5: mean outer product, without subtracting means."""
    others = others or cols
    return df.groupBy(*keys).agg(*[(F.sum(F.col(a) * F.col(b)) / F.count("*")).alias(f"{a}_{b}") for a in cols for b in others])


def gauss_newton_step(row: dict, alpha: float, unit: float = 1.0) -> np.ndarray:
    """The twist -(H + alpha c I)^-1 g, with gradients divided by unit."""
    h = np.zeros((6, 6))
    for i in range(6):
        for k in range(i, 6):
            h[i, k] = h[k, i] = float(row[f"h{i}{k}"])
    g = np.array([float(row[f"g{i}"]) for i in range(6)])
    return -np.linalg.solve(h / unit**2 + alpha * row["c"] * np.eye(6), g / unit)


def register(points: DataFrame, gradient_map: DataFrame, res: int, prior: np.ndarray | None = None, max_iterations: int = 200, weight_gradient: float = 0.1, epsilon: float = 0.03, metric: bool = False, broadcast_cells: int = 500_000) -> tuple[np.ndarray, int, float]:
    """Gauss-Newton on the map's distances; returns the pose (4x4, mm), the iterations and the last mean error.

    Gradients are differences per cell, as the reference codes them, so that steps are short and iterations many; with metric they
    are per millimetre, which converges in a few. Every iteration is one aggregate over the points; the driver holds 29 sums. Points and map should be cached by the caller.
    It ends when the error differs by less than epsilon from those two and four iterations before, or without matches.
    """
    pose = np.eye(4) if prior is None else np.array(prior, float)
    if gradient_map.limit(broadcast_cells + 1).count() <= broadcast_cells:  # counted once for all iterations
        gradient_map = F.broadcast(gradient_map)
    errors, alpha, err, i = [0.0] * 4, 0.0, float("inf"), 0
    for i in range(1, max_iterations + 1):
        centre = tuple(int(v) for v in pose[:3, 3])
        matched = match_points(points, gradient_map, res, fixed_matrix(pose.tolist()))
        row = normal_equations(jacobians(matched, centre)).first().asDict()
        if not row["c"]:
            break
        try:
            xi = gauss_newton_step(row, alpha, res if metric else 1.0)
        except np.linalg.LinAlgError:
            break
        alpha += weight_gradient
        pose = np_twist_to_transform(xi, np.array(centre, float)) @ pose
        err = row["e"] / row["c"]
        if abs(err - errors[2]) < epsilon and abs(err - errors[0]) < epsilon:
            break
        errors = [*errors[1:], err]
    return pose, i, err


def error_stats(errors: DataFrame, cols: tuple[Column, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Least, greatest and mean distance with per-axis means; the median as coded is element n div 2 + 1 of the sorted list (0-based)."""
    dx, dy, dz = cols
    d2 = dx * dx + dy * dy + dz * dz
    e = errors.select(*keys, F.abs(dx).alias("ax"), F.abs(dy).alias("ay"), F.abs(dz).alias("az"), d2.alias("d2"))
    w = Window.partitionBy(*keys).orderBy("d2")
    ranked = e.withColumns({"r": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(*keys))})
    at = F.least(F.floor(F.col("n") / 2) + 1, F.col("n") - 1)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.min("d2").alias("min_d2"), F.max("d2").alias("max_d2"), F.sum("ax").alias("sum_x"), F.sum("ay").alias("sum_y"), F.sum("az").alias("sum_z"), F.max(F.when(F.col("r") == at, F.col("d2"))).alias("median_d2"))
