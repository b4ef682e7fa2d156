"""Signed-distance integration: ray march (G1, G3), nearest-surface merge (A2), weighted upsert (J3), normal splat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import MATRIX_RESOLUTION, cell_trunc, idiv, in_bounds, lng, merge_value, norm_trunc, tsdf_weight
from stratavox.session import unchecked

AXES = ("x", "y", "z")


def beam_spread(vfov: float = 45.0, channels: int = 128) -> int:
    """Vertical half distance between neighbouring beams per unit of range, in fixed point."""
    return int(math.tan(vfov / channels / 180 * math.pi) / 2.0 * MATRIX_RESOLUTION)


def _norm3(v: list[Column]) -> Column:
    return norm_trunc(*v)


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _columns(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns as a projection of its own, so that later steps read them once computed."""
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def _generated(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition holds, by a generator: a filter would be pushed below the projections and repeat their arithmetic."""
    return _columns(df, _hit=F.explode_outer(F.when(condition, F.array(F.lit(1))))).filter("_hit is not null").drop("_hit")


def ray_march(points: DataFrame, res: int, tau: int, pos: tuple[int, int, int] = (0, 0, 0), up: tuple[int, int, int] = (0, 0, MATRIX_RESOLUTION), window: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None, dz_per_distance: int | None = None, keys: tuple[str, ...] = ("scan_id", "idx"), origin: str = "corner") -> DataFrame:
    """Cells each point updates: keys, len, step, ix, iy, iz, value, weight (negative where interpolated). Integers throughout.

    The ray runs from the scanner's cell `pos` (its corner or centre) to the point and tau behind it in steps of half a cell.
    Cells with the previous step's x and y are skipped, the march starting from cell (0, 0). Around each cell a fan along the
    interpolation axis covers the vertical spacing of beams. `window` is (centre, size) of the local map in cells; points are
    tested before rays are generated, cells after. Zero-length rays and rays along `up` give nothing. Where the window bounds all
    products below 2**62, the arithmetic is not tested for overflow; else it is.
    """
    dz = beam_spread() if dz_per_distance is None else dz_per_distance
    start = [p * res + (res // 2 if origin == "centre" else 0) for p in pos]
    m = MATRIX_RESOLUTION

    def inside(cells: list[Column]) -> Column:
        if window is None:
            return F.lit(True)
        return in_bounds(cells[0], window[0][0], window[1][0]) & in_bounds(cells[1], window[0][1], window[1][1]) & in_bounds(cells[2], window[0][2], window[1][2])

    bounded = False
    if window is not None:
        far = [(abs(c) + size // 2 + 2) * res + abs(s) for c, size, s in zip(*window, start, strict=True)]  # of a point from the start
        bounded = 2 * max(far) + tau < 1 << 30 and abs(dz) < 1 << 30 and max(abs(u) for u in up) <= m
    df = points.select(*keys, *[lng(a).alias(a) for a in AXES])
    df = df.filter(inside([cell_trunc(a, res) for a in AXES]))
    with unchecked(df.sparkSession, bounded):
        return _cells_of_rays(df, res, tau, start, up, dz, keys, None if window is None else inside)


def _cells_of_rays(df: DataFrame, res: int, tau: int, start: list[int], up: tuple[int, int, int], dz: int, keys: tuple[str, ...], within) -> DataFrame:
    """The march of ray_march for points in its window; `within` tests cells, if there is a window."""
    m, inside = MATRIX_RESOLUTION, within or (lambda cells: F.lit(True))
    df = _columns(df, **{f"d{a}": F.col(a) - start[i] for i, a in enumerate(AXES)})
    # Zero lengths become nulls and empty outer generators, not filters, which would be pushed below the projections and repeat
    # their arithmetic there (plain generators infer such filters themselves).
    df = _columns(df, dist=_norm3([F.col(f"d{a}") for a in AXES]))
    df = _columns(df, **{f"n{a}": idiv(F.col(f"d{a}") * m, F.nullif("dist", F.lit(0))) for a in AXES})
    n = [F.col(f"n{a}") for a in AXES]
    inner = [idiv(c, m) for c in _cross(n, [lng(u) for u in up])]
    df = _columns(df, **{f"j{a}": c for a, c in zip(AXES, inner, strict=True)})
    df = _columns(df, **{f"v{a}": c for a, c in zip(AXES, _cross(n, [F.col(f"j{a}") for a in AXES]), strict=True)})
    df = _columns(df, vn=F.nullif(_norm3([F.col(f"v{a}") for a in AXES]), F.lit(0)))
    df = df.select(*keys, *AXES, *[f"d{a}" for a in AXES], "dist", *[idiv(F.col(f"v{a}") * m, "vn").alias(f"v{a}") for a in AXES])
    step = max(res // 2, 1)
    df = _columns(df, len=F.explode_outer(F.when(F.col("vx").isNotNull(), F.sequence(F.lit(1).cast("bigint"), F.col("dist") + tau, F.lit(step).cast("bigint"))))).filter("len is not null")
    df = _columns(df, **{f"p{a}": F.lit(start[i]) + idiv(F.col(f"d{a}") * F.col("len"), "dist") for i, a in enumerate(AXES)})
    df = _columns(df, **{f"i{a}": cell_trunc(f"p{a}", res) for a in AXES})
    # The cell of the step before is computed again rather than fetched, which would take a sort.
    before = [cell_trunc(F.lit(start[i]) + idiv(F.col(f"d{a}") * (F.col("len") - step), "dist"), res) for i, a in enumerate(AXES[:2])]
    moved = F.when(F.col("len") > 1, (F.col("ix") != before[0]) | (F.col("iy") != before[1])).otherwise((F.col("ix") != 0) | (F.col("iy") != 0))
    df = _generated(df, moved & inside([F.col(f"i{a}") for a in AXES]))
    centre = [F.col(a) - (F.col(f"i{a}") * res + res // 2) for a in AXES]
    df = _columns(df, near=F.least(_norm3(centre), F.lit(tau)))
    df = _columns(df, value=F.when(F.col("len") > F.col("dist"), -F.col("near")).otherwise(F.col("near")))
    df = _columns(df, weight=tsdf_weight("value", tau))
    df = _columns(df, fan=idiv(F.col("len") * dz, m))
    alone = F.when(F.col("fan") * 2 < res, F.array(F.lit(0).cast("bigint")))  # most fans are, and a sequence would be made for each
    df = _columns(df, mid=idiv("fan", res), step=F.explode_outer(F.when(F.col("weight") != 0, alone.otherwise(F.sequence(F.lit(0).cast("bigint"), idiv(F.col("fan") * 2, res)))))).filter("step is not null")
    lowest = [F.col(f"p{a}") - idiv(F.col("fan") * F.col(f"v{a}"), m) for a in AXES]
    spots = [cell_trunc(lo + idiv(F.col("step") * res * F.col(f"v{a}"), m), res) for lo, a in zip(lowest, AXES, strict=True)]
    df = df.select(*keys, *AXES, "len", "step", *[c.alias(f"i{a}") for c, a in zip(spots, AXES, strict=True)], "value", F.when(F.col("step") == F.col("mid"), F.col("weight")).otherwise(-F.col("weight")).alias("weight"))
    return _generated(df, inside([F.col(f"i{a}") for a in AXES])) if within is not None else df


#: Bits of the packed keys of merge_nearest: distance, weight, and the order's parts.
_BITS = {"value": 15, "weight": 7, "scan_id": 39, "idx": 18, "len": 17, "step": 4}


def merge_nearest(cells: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("scan_id", "idx", "x", "y", "z", "len", "step"), wide: bool = False) -> DataFrame:
    """A2, canonical rule: direct hits before interpolated ones, then least |value|, then first in order.

    Two hash aggregates of one packed long each, within scans and then over scans, that combine before the shuffle; the first
    needs no shuffle where points are dealt by scan. Values are 16-bit as stored, new weights below 128, parts of the order not
    negative and within _BITS (scans of up to 2**18 points); a cell beyond that is an error. Other orders than the ray march's, and
    `wide`, take a sorting aggregate that has no bounds. The result does not depend on partitioning.
    """
    if wide or order[:2] != ("scan_id", "idx") or set(order) - {"scan_id", "idx", *AXES, "len", "step"}:
        by = F.struct((F.col("weight") < 0).cast("int").alias("i"), F.abs("value").alias("a"), *order)
        g = cells.groupBy(*keys, "ix", "iy", "iz").agg(F.min_by(F.struct("value", "weight"), by).alias("e"))
        return g.select(*keys, "ix", "iy", "iz", F.col("e.value").alias("value"), F.col("e.weight").alias("weight"))

    def packed(parts: list[tuple[Column, int]]) -> Column:
        key = parts[0][0]
        for c, n in parts[1:]:
            key = F.shiftleft(key, n).bitwiseOR(c)
        return key

    fits = (F.abs("value") < 1 << _BITS["value"]) & (F.abs("weight") < 1 << _BITS["weight"])
    for c in ("scan_id", "idx", "len", "step"):
        if c in order:
            fits &= F.shiftrightunsigned(lng(c), _BITS[c]) == 0  # of negative numbers the upper bits are set
    entry = [((F.col("value") < 0).cast("bigint"), 1), (F.abs("weight"), _BITS["weight"])]
    first = packed([((F.col("weight") < 0).cast("bigint"), 1), (F.abs("value"), _BITS["value"]), *[(lng(c), _BITS[c]) for c in ("idx", "len", "step") if c in order], *entry])
    rank = sum(_BITS[c] for c in ("idx", "len", "step") if c in order)
    low = 1 + _BITS["weight"]
    g = cells.groupBy(*keys, "scan_id", "ix", "iy", "iz").agg(F.min(F.when(fits, first).otherwise(F.raise_error("a value, weight or part of the order is out of range: use wide").cast("bigint"))).alias("k"))
    over = packed([(F.shiftright("k", rank + low), 1), (lng("scan_id"), _BITS["scan_id"]), (F.col("k").bitwiseAND(F.lit((1 << low) - 1)), low)])
    g = g.groupBy(*keys, "ix", "iy", "iz").agg(F.min(over).alias("k"))
    part = lambda at, n: F.shiftright("k", at).bitwiseAND(F.lit((1 << n) - 1))
    size, weight = part(low + _BITS["scan_id"], _BITS["value"]), part(0, _BITS["weight"])
    top = low + _BITS["scan_id"] + _BITS["value"]
    return g.select(*keys, "ix", "iy", "iz", F.when(part(_BITS["weight"], 1) == 1, -size).otherwise(size).alias("value"), F.when(part(top, 1) == 1, -weight).otherwise(weight).alias("weight"))


def merge_in_order(cells: DataFrame, order: tuple[str, ...] = ("scan_id", "idx", "x", "y", "z", "len", "step")) -> DataFrame:
    """A2 as the sequential fold does it: replaced by a smaller |value| or if the entry so far is interpolated. For parity tests."""
    items = F.array_sort(F.collect_list(F.struct(*order, "value", "weight")))
    entry = F.aggregate(
        F.col("items"),
        F.struct(F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("bigint").alias("weight")),
        lambda e, x: F.when(e["value"].isNull() | (F.abs(x["value"]) < F.abs(e["value"])) | (e["weight"] < 0), F.struct(x["value"].alias("value"), x["weight"].alias("weight"))).otherwise(e),
    )
    g = cells.groupBy("ix", "iy", "iz").agg(items.alias("items")).withColumn("e", entry)
    return g.select("ix", "iy", "iz", F.col("e.value").alias("value"), F.col("e.weight").alias("weight"))


def upsert(current: DataFrame, fresh: DataFrame, max_weight: int) -> DataFrame:
    """Weighted averages of known cells with new direct hits; new cells enter as they are; interpolated ones only fill gaps.

    One full outer join on the cell. A known cell (weight over 0) and a direct hit are averaged, the weight capped; a cell that
    is unknown or interpolated takes the new entry.
    """
    a = current.select("ix", "iy", "iz", F.col("value").alias("v"), F.col("weight").alias("w"))
    b = fresh.select("ix", "iy", "iz", F.col("value").alias("nv"), F.col("weight").alias("nw"))
    known = F.col("w") > 0
    hit = F.col("nw") > 0
    value = F.when(known & hit, merge_value("v", "w", "nv", "nw")).when(F.col("nw").isNotNull() & (F.col("nw") != 0) & ~F.coalesce(known, F.lit(False)), F.col("nv")).otherwise(F.col("v"))
    weight = F.when(known & hit, F.least(F.lit(max_weight).cast("bigint"), F.col("w") + F.col("nw"))).when(F.col("nw").isNotNull() & (F.col("nw") != 0) & ~F.coalesce(known, F.lit(False)), F.col("nw")).otherwise(F.col("w"))
    return a.join(b, ["ix", "iy", "iz"], "full").select("ix", "iy", "iz", F.coalesce(value, "nv").alias("value"), F.coalesce(weight, "nw").alias("weight"))


def splat(points: DataFrame, res: int, tau: int, pos: tuple[int, int, int] = (0, 0, 0), window: tuple | None = None, keys: tuple[str, ...] = ("scan_id", "idx"), stop_early: bool = False) -> DataFrame:
    """Cells around each point along its normal (nx, ny, nz in -1..1) and two tangents; keys, ix, iy, iz, value, weight.

    stop_early ends a column along the normal at its first cell farther than tau, as a sequential loop that starts behind the
    surface does; otherwise such cells are only left out. Normals are turned to the scanner; perpendicular ones give nothing.
    """
    m, half = MATRIX_RESOLUTION, MATRIX_RESOLUTION // 2
    dz = int(math.tan(45.0 / 256 / 180 * math.pi) / 2.0 * m)
    df = points.select(*keys, *[idiv(lng(a) * m, res).alias(a) for a in AXES], *[(F.col(f"n{a}").cast("double") * m).cast("bigint").alias(f"n{a}") for a in AXES], *[cell_trunc(a, res).alias(f"c{a}") for a in AXES])
    if window is not None:
        df = df.filter(in_bounds("cx", window[0][0], window[1][0]) & in_bounds("cy", window[0][1], window[1][1]) & in_bounds("cz", window[0][2], window[1][2]))
    df = _columns(df, **{f"d{a}": F.col(a) - pos[i] * m for i, a in enumerate(AXES)})
    df = _columns(df, dist=F.nullif(_norm3([F.col(f"d{a}") for a in AXES]), F.lit(0)))
    facing = idiv(-sum((F.col(f"n{a}") * idiv(F.col(f"d{a}") * m, "dist") for a in AXES[1:]), F.col("nx") * idiv(F.col("dx") * m, "dist")), m)
    df = _columns(df, acc=F.nullif(facing, F.lit(0)))
    df = df.select(*keys, *AXES, "dist", F.abs("acc").alias("acc"), *[F.when(F.col("acc") < 0, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")).alias(f"n{a}") for a in AXES])
    n = [F.col(f"n{a}") for a in AXES]
    flat = (F.col("nx") == 0) & (F.col("nz") == 0)  # along y, the first cross product vanishes
    first = [F.when(flat, b).otherwise(a) for a, b in zip([-n[2], F.lit(0), n[0]], [F.lit(0), n[2], -n[1]], strict=True)]
    df = _columns(df, **{f"a{a}": lng(c) for a, c in zip(AXES, first, strict=True)})
    df = _columns(df, **{f"b{a}": idiv(c, m) for a, c in zip(AXES, _cross(n, [F.col(f"a{a}") for a in AXES]), strict=True)})
    df = _columns(df, **{f"t{a}": idiv(c, m) for a, c in zip(AXES, _cross(n, [F.col(f"b{a}") for a in AXES]), strict=True)})
    df = _columns(df, reach=idiv(F.col("dist") * (dz * 2), m) + 1)
    span = lambda r: F.sequence(-r, r, F.lit(half).cast("bigint"))
    df = _columns(df, la=F.explode_outer(F.when(F.col("acc").isNotNull(), span(F.col("reach"))))).filter("la is not null")
    df = _columns(df, lb=F.explode_outer(span(F.col("reach")))).filter("lb is not null")
    df = _columns(df, ln=F.explode(span(F.lit(tau * m // res).cast("bigint"))))
    spot = [F.col(a) + idiv(F.col(f"t{a}") * F.col("la"), m) + idiv(F.col(f"b{a}") * F.col("lb"), m) + idiv(F.col(f"n{a}") * F.col("ln"), m) for a in AXES]
    df = _columns(df, **{f"i{a}": F.floor(c / m).cast("bigint") for a, c in zip(AXES, spot, strict=True)})
    delta = [idiv(F.col(a) * res, m) - (F.col(f"i{a}") * res + res // 2) for a in AXES]
    df = _columns(df, near=_norm3(delta), front=sum((F.col(f"n{a}") * d for a, d in zip(AXES[1:], delta[1:], strict=True)), F.col("nx") * delta[0]))
    if stop_early:
        seen = Window.partitionBy(*keys, *AXES, "ix", "iy", "iz").orderBy("la", "lb", "ln")
        df = df.withColumn("_nth", F.row_number().over(seen)).filter("_nth = 1")
        column = Window.partitionBy(*keys, *AXES, "la", "lb").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_past", F.max((F.col("near") > tau).cast("int")).over(column)).filter("_past = 0")
    else:
        inside = F.col("near") <= tau
        if window is not None:
            inside = inside & in_bounds("ix", window[0][0], window[1][0]) & in_bounds("iy", window[0][1], window[1][1]) & in_bounds("iz", window[0][2], window[1][2])
        df = _generated(df, inside).dropDuplicates([*keys, *AXES, "ix", "iy", "iz"])
    df = _columns(df, value=F.when(F.col("front") > 0, -F.col("near")).otherwise(F.col("near")))
    df = df.select(*keys, "ix", "iy", "iz", "value", idiv(tsdf_weight("value", tau) * F.col("acc"), m).alias("weight")).filter("weight <> 0")
    if window is not None and stop_early:
        df = df.filter(in_bounds("ix", window[0][0], window[1][0]) & in_bounds("iy", window[0][1], window[1][1]) & in_bounds("iz", window[0][2], window[1][2]))
    return df
