"""Voxelised generalised ICP, after the published method, as column arithmetic.

Every point has the covariance of its nearest neighbours, regularised; a target cell has the number, mean and mean covariance of its points. A
source point meets the Gaussians of the cells it falls into and of those around, and each pair weighs its distance by the inverse of both
covariances together, the source's turned by the pose. An iteration is one join and one aggregate of 28 sums; the driver solves a 6x6 system.
Points are whole millimetres, covariances and poses are in metres.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.grid import fdiv
from stratavox.functions.linalg import np_se3_exp
from stratavox.operators import kdtree as KD

AXES = ("x", "y", "z")
#: Entries of a symmetric 3x3 matrix.
SIX = [(i, k) for i in range(3) for k in range(i, 3)]
UPPER = [(i, k) for i in range(6) for k in range(i, 6)]
#: Cells that a point meets: its own; also those by its faces; all 27 around.
AROUND = {
    1: [(0, 0, 0)],
    7: [(0, 0, 0)] + [tuple(s * (a == k) for k in range(3)) for a in range(3) for s in (-1, 1)],
    27: [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)],
}


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _sym(prefix: str, i: int, k: int) -> Column:
    return F.col(f"{prefix}{min(i, k)}{max(i, k)}")


def inverse_sym(df: DataFrame, m: str, out: str) -> DataFrame:
    """Adds the inverse out00..out22 of the symmetric matrix m00..m22, by cofactors."""
    c = {
        "00": _sym(m, 1, 1) * _sym(m, 2, 2) - _sym(m, 1, 2) * _sym(m, 1, 2), "01": _sym(m, 0, 2) * _sym(m, 1, 2) - _sym(m, 0, 1) * _sym(m, 2, 2), "02": _sym(m, 0, 1) * _sym(m, 1, 2) - _sym(m, 0, 2) * _sym(m, 1, 1),
        "11": _sym(m, 0, 0) * _sym(m, 2, 2) - _sym(m, 0, 2) * _sym(m, 0, 2), "12": _sym(m, 0, 1) * _sym(m, 0, 2) - _sym(m, 0, 0) * _sym(m, 1, 2), "22": _sym(m, 0, 0) * _sym(m, 1, 1) - _sym(m, 0, 1) * _sym(m, 0, 1),
    }
    df = df.select("*", *[v.alias(f"_c{k}") for k, v in c.items()])
    df = df.withColumn("_det", _sym(m, 0, 0) * F.col("_c00") + _sym(m, 0, 1) * F.col("_c01") + _sym(m, 0, 2) * F.col("_c02"))
    return df.select("*", *[(F.col(f"_c{k}") / F.col("_det")).alias(f"{out}{k}") for k in c]).drop("_det", *[f"_c{k}" for k in c])


def point_covariances(points: DataFrame, key: list[str], k: int = 10, r: int = 3000, least: float = 1e-6) -> DataFrame:
    """key, x, y, z and c00..c22: the covariance of the k nearest points within r (the point is one), plus `least` on the diagonal and times
    the Frobenius norm of its inverse, so that it tells directions and not sizes. Points with fewer neighbours are left out."""
    g = KD.knn_moments(points, points, k, r, key, keep=[*key, *AXES]).filter(F.col("n") == k)
    g = g.repartition(*key)  # cells and source read this, so that the search runs once; by key, as many points may be equal
    # n Sxy - Sx Sy is a whole number, so nothing cancels, and the same for offsets from the point
    cov = [((k * F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}")).cast("double") / float(k * k) / 1e6 + (least if i == j else 0.0)).alias(f"b{i}{j}") for i, j in SIX]
    df = inverse_sym(g.select(*key, *AXES, *cov), "b", "i")
    norm = F.sqrt(_total([F.col(f"i{i}{j}") * F.col(f"i{i}{j}") * (1.0 if i == j else 2.0) for i, j in SIX]))
    df = df.withColumn("_f", norm)
    return df.select(*key, *AXES, *[(F.col(f"b{i}{j}") * F.col("_f")).alias(f"c{i}{j}") for i, j in SIX])


def _at_cells(df: DataFrame, cell: list[Column], around: list[tuple]) -> DataFrame:
    """A row for each cell ix, iy, iz around. By a generator, as tests for null that a join infers would else go below the exchange that cells
    and source share, which would then be two."""
    at = [F.struct(*[(c + o).cast("bigint").alias(f"i{a}") for a, c, o in zip(AXES, cell, offset, strict=True)]) for offset in around]
    return df.select(*[c for c in df.columns if c not in ("ix", "iy", "iz")], F.explode(F.array(*at)).alias("_at")).select("*", "_at.*").drop("_at")


def few_cells(points: DataFrame, res: int, broadcast_cells: int = 200_000) -> bool:
    """Whether the points lie in at most so many cells, which bounds their target cells; only coordinates are read."""
    return points.select(*[fdiv(a, res).alias(f"i{a}") for a in AXES]).distinct().limit(broadcast_cells + 1).count() <= broadcast_cells


def target_cells(covariances: DataFrame, res: int) -> DataFrame:
    """ix, iy, iz, n, mean m0..m2 (metres) and mean covariance t00..t22 of the points of every floored cell."""
    g = _at_cells(covariances, [fdiv(a, res) for a in AXES], AROUND[1]).groupBy("ix", "iy", "iz")
    means = [(F.sum(a).cast("double") / F.count("*") / 1000.0).alias(f"m{i}") for i, a in enumerate(AXES)]
    return g.agg(F.count("*").alias("n"), *means, *[F.avg(f"c{i}{j}").alias(f"t{i}{j}") for i, j in SIX])


def normal_equations(source: DataFrame, cells: DataFrame, res: int, pose: np.ndarray, around: int = 7, few: bool = False) -> DataFrame:
    """One row: h00..h55 and g0..g5 of J^T W J and J^T W e, the weighed square error e2 and the number of pairs c, at a pose (4x4, metres).

    e is the cell's mean less the moved point, W = n (C_cell + R C_point R^T)^-1; turns come before moves, and act on the left. Cells that
    are `few` are broadcast and looked up around each point. Others go to the cells they are around of, so that a join shuffles each point once.
    """
    rot = [[float(pose[i, k]) for k in range(3)] for i in range(3)]
    moved = [_total([F.col(a) * (rot[i][k] / 1000.0) for k, a in enumerate(AXES)]) + float(pose[i, 3]) for i in range(3)]
    df = source.select(*[f"c{i}{j}" for i, j in SIX], *[m.alias(f"p{i}") for i, m in enumerate(moved)])
    turned = lambda i, j: _total([_sym("c", a, b) * (rot[i][a] * rot[j][b]) for a in range(3) for b in range(3)])
    cell = [F.floor(F.col(f"p{i}") * 1000.0 / res).cast("bigint") for i in range(3)]
    df = df.select(*[f"p{i}" for i in range(3)], *[turned(i, j).alias(f"r{i}{j}") for i, j in SIX], *[c.alias(f"i{a}") for a, c in zip(AXES, cell, strict=True)])
    # The cells around are the same seen from either side.
    df = _at_cells(df, [F.col(f"i{a}") for a in AXES], AROUND[around if few else 1])
    cells = F.broadcast(cells) if few else _at_cells(cells, [F.col(f"i{a}") for a in AXES], AROUND[around])
    df = df.join(cells, ["ix", "iy", "iz"])
    df = df.select("n", *[f"p{i}" for i in range(3)], *[(F.col(f"m{i}") - F.col(f"p{i}")).alias(f"e{i}") for i in range(3)], *[(F.col(f"t{i}{j}") + F.col(f"r{i}{j}")).alias(f"s{i}{j}") for i, j in SIX])
    df = inverse_sym(df, "s", "v")
    df = df.select(*[f"p{i}" for i in range(3)], *[f"e{i}" for i in range(3)], *[(F.col("n") * F.col(f"v{i}{j}")).alias(f"w{i}{j}") for i, j in SIX])
    p = [F.col(f"p{i}") for i in range(3)]
    jac = [[None, -p[2], p[1], -1.0, None, None], [p[2], None, -p[0], None, -1.0, None], [-p[1], p[0], None, None, None, -1.0]]
    product = lambda i, k: _total([_sym("w", i, r) * jac[r][k] for r in range(3) if jac[r][k] is not None])
    df = df.select("*", *[product(i, k).alias(f"u{i}{k}") for i in range(3) for k in range(6)])
    h = [F.sum(_total([F.col(f"u{r}{k}") * jac[r][i] for r in range(3) if jac[r][i] is not None])).alias(f"h{i}{k}") for i, k in UPPER]
    g = [F.sum(_total([F.col(f"u{r}{i}") * F.col(f"e{r}") for r in range(3)])).alias(f"g{i}") for i in range(6)]
    e2 = F.sum(_total([_sym("w", i, k) * F.col(f"e{i}") * F.col(f"e{k}") for i in range(3) for k in range(3)])).alias("e2")
    return df.agg(*h, *g, e2, F.count("*").alias("c"))


def match(source: DataFrame, cells: DataFrame, res: int, prior: np.ndarray | None = None, around: int = 7, iterations: int = 30, epsilon: float = 1e-5, broadcast_cells: int = 200_000) -> tuple[np.ndarray, float]:
    """Pose (4x4, metres) that lays source points with covariances onto target cells, and its fitness, the weighed square error a pair.

    Cache both before. The cells are broadcast only if they were counted to be few. Without a pair the fitness is infinite.
    """
    pose, fit = np.eye(4) if prior is None else np.array(prior, float), float("inf")
    few = bool(broadcast_cells) and cells.limit(broadcast_cells + 1).count() <= broadcast_cells
    for _ in range(iterations):
        row = normal_equations(source, cells, res, pose, around, few).first()
        if not row["c"]:
            return pose, float("inf")
        h, g = np.zeros((6, 6)), np.array([row[f"g{i}"] for i in range(6)])
        for i, k in UPPER:
            h[i, k] = h[k, i] = row[f"h{i}{k}"]
        xi = -np.linalg.solve(h + 1e-9 * np.trace(h) / 6 * np.eye(6), g)
        turn, move = np_se3_exp(xi)
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = turn, move
        pose, fit = step @ pose, row["e2"] / row["c"]
        if np.linalg.norm(xi) < epsilon:
            break
    return pose, fit


def refine(source: DataFrame, cells: DataFrame, res: int, prior: np.ndarray, limit: float, **options) -> np.ndarray:
    """the refined pose, or the identity where its fitness is over the limit."""
    pose, fit = match(source, cells, res, prior, **options)
    return pose if fit <= limit else np.eye(4)
