"""Scan-line features: curvature (W1), occlusion and parallel-beam marks (W2, W3), sectors (W4) and greedy picking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import idiv

LINE = ("scan_id", "ring")
#: Points that a task holds and picks from at once; a worker's memory is that of so many, whatever the size of its partition.
HELD_POINTS = 1 << 17


def _line():
    return Window.partitionBy(*LINE).orderBy("col")


def _full(width: int):
    """Columns that have all eleven taps."""
    return F.col("col").between(5, width - 7)


def curvature(grid: DataFrame, width: int) -> DataFrame:
    """Squared sum of the ten neighbours minus ten times the point, over x, y and z; null at the ends of a line."""
    near = _line().rowsBetween(-5, 5)
    diff = [F.sum(a).over(near) - F.col(a) * 11 for a in ("x", "y", "z")]
    return grid.withColumn("curvature", F.when(_full(width), diff[0] * diff[0] + diff[1] * diff[1] + diff[2] * diff[2]))


def occlusion_marks(grid: DataFrame, width: int, jump=0.3, least=None, most=None, parallel: float | None = 0.02, rng: str = "range") -> DataFrame:
    """Boolean `marked`. Ranges of columns without eleven taps count as zero, as they are never filled.

    A drop to the next column marks this and five columns before; a rise marks the six after; ranges outside least..most mark the
    column; so do two side differences above `parallel` of the range. `parallel` may be a (numerator, denominator) pair.
    """
    w = _line()
    r = F.when(_full(width), F.col(rng)).otherwise(F.lit(0).cast(grid.schema[rng].dataType))
    df = grid.withColumn("_r", r).withColumns({"_next": F.lead("_r").over(w), "_prev": F.lag("_r").over(w)})
    inner = _full(width)
    drop = F.coalesce(inner & (F.col("_r") - F.col("_next") > jump), F.lit(False)).cast("int")
    rise = F.coalesce(inner & (F.col("_next") - F.col("_r") > jump), F.lit(False)).cast("int")
    df = df.withColumns({"_drop": drop, "_rise": rise})
    marked = (F.max("_drop").over(w.rowsBetween(0, 5)) == 1) | F.coalesce(F.max("_rise").over(w.rowsBetween(-6, -1)) == 1, F.lit(False))
    if least is not None:
        marked = marked | (inner & (F.col("_r") < least))
    if most is not None:
        marked = marked | (inner & (F.col("_r") > most))
    if parallel is not None:
        num, den = parallel if isinstance(parallel, tuple) else (parallel, 1)
        side = lambda c: F.abs(F.col(c) - F.col("_r")) * den > F.col("_r") * num
        marked = marked | F.coalesce(inner & side("_prev") & side("_next"), F.lit(False))
    return df.withColumn("marked", marked).drop("_r", "_next", "_prev", "_drop", "_rise")


def parallel_beam(grid: DataFrame, width: int, num: int = 2, den: int = 100, rng: str = "range") -> DataFrame:
    """W3 alone."""
    return occlusion_marks(grid.withColumn("_none", F.lit(0)), width, jump=1 << 60, parallel=(num, den), rng=rng).drop("_none")


def sectors(grid: DataFrame, width: int, parts: int = 6) -> DataFrame:
    """Sector number of every column with eleven taps, null elsewhere."""
    return grid.withColumn("sector", F.when(_full(width), idiv(F.col("col") - 5, width // parts)))


def sector_rank(curved: DataFrame, width: int, parts: int = 6) -> DataFrame:
    """K1, K3: rank by curvature within each sector, greatest first, ties by column; a sector is a bounded group."""
    w = Window.partitionBy(*LINE, "sector").orderBy(F.col("curvature").desc(), "col")
    return sectors(curved, width, parts).filter(F.col("sector").isNotNull()).withColumn("rank", F.row_number().over(w))


@dataclass(frozen=True)
class Variant:
    """How features are picked. gap: suppression stops where neighbours lie farther apart than this (squared); None: fixed reach."""

    edge_least: float
    surf_most: float | None
    edges: int = 20
    surfs: int | None = 20
    reach: int = 5
    gap: float | None = None
    cap: str = "as_coded"
    marks: bool = True
    least_intensity: float | None = None
    strict_edge: bool = False
    surf_is_rest: bool = False


#: The variants of the survey; thresholds are fixed values.
VARIANTS = {
    "production": Variant(2.0, 0.1),
    "original": Variant(0.1, None, edges=20, gap=0.05, marks=False, strict_edge=True, surf_is_rest=True, cap="strict"),
    "custom_lines": Variant(2.0, None, edges=100, gap=0.05, marks=False, strict_edge=True, surf_is_rest=True, cap="strict"),
    "labelled": Variant(2.0, 0.001, surfs=None, strict_edge=True, cap="strict"),
    "labelled_intensity": Variant(2.0, 0.001, surfs=None, strict_edge=True, cap="strict", least_intensity=50),
    "labelled_custom": Variant(2.0, 0.1, surfs=None, cap="strict"),
}


def pick_line(curv: np.ndarray, taken: np.ndarray, xyz: np.ndarray, width: int, v: Variant, parts: int = 6) -> list[tuple[int, str]]:
    """Greedy picking on one line of `width` columns, sector by sector: edges from the greatest curvature, then surfaces from the least.

    Picks suppress neighbours, also across sectors. cap "as_coded" refuses exactly one candidate after the limit and then goes on;
    "strict" stops at the limit. Ties go to the smaller column.
    """
    out: list[tuple[int, str]] = []
    taken = taken.copy()
    used = np.zeros(width, bool)
    span = width // parts

    def spread(c: int) -> None:
        taken[c] = True
        for side in (1, -1):
            for k in range(1, v.reach + 1):
                i = c + side * k
                if not 0 <= i < width:
                    break
                if v.gap is not None and float(((xyz[i] - xyz[i - side]) ** 2).sum()) > v.gap:
                    break
                taken[i] = True

    for lo in range(5, width - 6, span):
        cols = np.arange(lo, min(lo + span, width - 6))
        order = cols[np.lexsort((cols, curv[cols]))]
        room, refused = v.edges, 0
        for c in order[np.lexsort((order, -curv[order]))]:
            if taken[c] or not (curv[c] > v.edge_least if v.strict_edge else curv[c] >= v.edge_least):
                continue
            if room == 0 and (v.cap == "strict" or refused == 0):
                refused = 1
                if v.cap == "strict":
                    break
                continue
            room -= room > 0
            out.append((int(c), "edge"))
            used[c] = True
            spread(c)
        if v.surf_is_rest:
            continue
        room, refused = v.surfs if v.surfs is not None else 1 << 60, 0
        for c in order:
            if taken[c] or curv[c] > v.surf_most:
                continue
            if room == 0 and (v.cap == "strict" or refused == 0):
                refused = 1
                if v.cap == "strict":
                    break
                continue
            room -= room > 0
            out.append((int(c), "surf"))
            spread(c)
    if v.surf_is_rest:
        out += [(int(c), "surf") for c in range(5, width - 6) if not used[c] and not taken[c]]
    return out


def pick_lines(curv: np.ndarray, taken: np.ndarray, xyz: np.ndarray, v: Variant, parts: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pick_line() for many lines at once, a step for all of them together: the line, the column and whether it is an edge, of each pick."""
    n, width = curv.shape
    taken, used = taken.copy(), np.zeros((n, width), bool)
    near = ((xyz[:, 1:] - xyz[:, :-1]) ** 2).sum(2) <= (np.inf if v.gap is None else v.gap)
    span, found = width // parts, []

    def take(rows: np.ndarray, c: np.ndarray, edge: bool) -> None:
        found.append((rows, c, np.full(len(rows), edge)))
        taken[rows, c] = True
        for side in (1, -1):
            r, at = rows, c
            for _ in range(v.reach):
                nxt = at + side
                ok = (nxt >= 0) & (nxt < width)
                r, at, nxt = r[ok], at[ok], nxt[ok]
                ok = near[r, np.minimum(at, nxt)]
                r, at = r[ok], nxt[ok]
                taken[r, at] = True

    def walk(order: np.ndarray, wanted: np.ndarray, room: np.ndarray, edge: bool) -> None:
        refused, done = np.zeros(n, bool), np.zeros(n, bool)
        for k in range(order.shape[1]):
            c = order[:, k]
            rows = np.flatnonzero(wanted[np.arange(n), c] & ~done)
            rows = rows[~taken[rows, c[rows]]]
            if not len(rows):
                continue
            full = room[rows] == 0
            if v.cap == "strict":
                done[rows[full]] = True
            else:
                full &= ~refused[rows]
                refused[rows[full]] = True
            rows = rows[~full]
            room[rows] -= room[rows] > 0
            if edge:
                used[rows, c[rows]] = True
            take(rows, c[rows], edge)

    edge_like = curv > v.edge_least if v.strict_edge else curv >= v.edge_least
    for lo in range(5, width - 6, span):
        part = curv[:, lo : min(lo + span, width - 6)]
        walk(lo + np.argsort(-part, axis=1, kind="stable"), edge_like, np.full(n, v.edges), True)
        if not v.surf_is_rest:
            walk(lo + np.argsort(part, axis=1, kind="stable"), curv <= v.surf_most, np.full(n, v.surfs if v.surfs is not None else 1 << 60), False)
    if v.surf_is_rest:
        rows, c = np.nonzero(~used[:, 5 : width - 6] & ~taken[:, 5 : width - 6])
        found.append((rows, c + 5, np.zeros(len(rows), bool)))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def extract_features(grid: DataFrame, width: int, variant: str | Variant = "production", marked: str = "marked", lines: int = 2000) -> DataFrame:
    """scan_id, ring, col, kind, curvature of picked points. Suppression is sequential in a line; up to `lines` lines, or
    those of HELD_POINTS points if that is less, go in step.

    The grid needs x, y, z, curvature and, if the variant uses them, the marks and intensity. Short or broken lines give nothing.
    Sorted partitions stream through; what is held is bounded by these and one line.
    """
    v = VARIANTS[variant] if isinstance(variant, str) else variant
    cols = [*LINE, "col", "x", "y", "z", "curvature"] + ([marked] if v.marks else []) + (["intensity"] if v.least_intensity is not None else [])

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        get = lambda c: t.column(c).to_numpy()
        scan, ring, col = get("scan_id"), get("ring"), get("col")
        new = np.concatenate([[True], (scan[1:] != scan[:-1]) | (ring[1:] != ring[:-1])])
        first = np.flatnonzero(new)
        whole = first[np.diff(np.append(first, len(scan))) == width]
        at = whole[:, None] + np.arange(width)
        at = at[(col[at] == np.arange(width)).all(1)]
        if not len(at):
            return None
        curv = np.nan_to_num(get("curvature").astype(float), nan=-1.0)[at]
        taken = get(marked).astype(bool)[at] if v.marks else np.zeros(at.shape, bool)
        if v.least_intensity is not None:
            taken = taken | (get("intensity")[at] < v.least_intensity)
        row, c, edge = pick_lines(curv, taken, np.stack([get(a).astype(float)[at] for a in "xyz"], 2), v)
        place = at[row, c]
        return pa.RecordBatch.from_arrays([pa.array(scan[place]), pa.array(ring[place]), pa.array(c.astype(np.int64)), pc.if_else(pa.array(edge), "edge", "surf"), pa.array(get("curvature").astype(float)[place])], names=["scan_id", "ring", "col", "kind", "curvature"])

    most = max(1, min(lines * width, HELD_POINTS))

    def run(batches):
        held, rows = [], 0

        def flush(last: bool):
            """All lines that are known to be whole; the last one, unless nothing follows, waits."""
            t = pa.Table.from_batches(held)
            cut = t.num_rows
            if not last:
                scan, ring = t.column("scan_id").to_numpy(), t.column("ring").to_numpy()
                other = np.flatnonzero((scan != scan[-1]) | (ring != ring[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
            out = solve(t.slice(0, cut)) if cut else None
            return out, t.slice(cut).to_batches()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                out, held = flush(False)
                rows = sum(x.num_rows for x in held)
                if out is not None:
                    yield out
        if held:
            out, _ = flush(True)
            if out is not None:
                yield out

    rows = grid.select(*cols).withColumns({"scan_id": F.col("scan_id").cast("bigint"), "ring": F.col("ring").cast("bigint"), "col": F.col("col").cast("bigint")})
    return rows.repartition(*LINE).sortWithinPartitions(*LINE, "col").mapInArrow(run, "scan_id bigint, ring bigint, col bigint, kind string, curvature double")
