"""Iterative pose solvers: feature alignment (I2) and voxelised distribution matching.

Each iteration is one distributed pass that turns rows into partial normal equations, 28 numbers a batch, and sums them; the driver
solves a 6x6 system. Poses are 4x4 matrices in the unit of the points; twists turn first and act on the left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions.grid import fdiv
from stratavox.functions.linalg import np_se3_exp

_UPPER = [(i, k) for i in range(6) for k in range(i, 6)]
_SCHEMA = ", ".join([f"h{i}{k} double" for i, k in _UPPER] + [f"g{i} double" for i in range(6)] + ["e double", "c double"])


def _partial(j: np.ndarray, r: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    """Weighted J^T J, J^T r, squared error and count of residual rows (n, 6), (n,)."""
    jw = j * w[:, None]
    h, g = jw.T @ j, jw.T @ r
    return pd.DataFrame([[*[h[i, k] for i, k in _UPPER], *g, float((w * r * r).sum()), float(len(r))]], columns=[c.split()[0] for c in _SCHEMA.split(", ")])


def _solve(rows: DataFrame, residuals: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]], damping: float) -> tuple[np.ndarray, float, float] | None:
    return _solve_sums(rows, lambda pdf: _partial(*residuals(pdf)), damping)


def _solve_sums(rows: DataFrame, partial: Callable[[pd.DataFrame], pd.DataFrame], damping: float) -> tuple[np.ndarray, float, float] | None:
    def run(it):
        for pdf in it:
            if len(pdf):
                yield partial(pdf)

    sums = rows.mapInPandas(run, _SCHEMA).agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in _SCHEMA.split(", ")]).first()
    if sums is None or not sums["c"]:
        return None
    h = np.zeros((6, 6))
    for i, k in _UPPER:
        h[i, k] = h[k, i] = sums[f"h{i}{k}"]
    g = np.array([sums[f"g{i}"] for i in range(6)])
    return -np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-12), g), sums["e"], sums["c"]


def _step(pose: np.ndarray, xi: np.ndarray) -> np.ndarray:
    rot, t = np_se3_exp(xi)
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = rot @ pose[:3, :3], rot @ pose[:3, 3] + t
    return out


def _moved(pdf: pd.DataFrame, pose: np.ndarray) -> np.ndarray:
    return pdf[["px", "py", "pz"]].to_numpy(float) @ pose[:3, :3].T + pose[:3, 3]


def _huber(r: np.ndarray, delta: float) -> np.ndarray:
    a = np.abs(r)
    return np.where(a <= delta, 1.0, delta / np.maximum(a, 1e-300))


def align_features(edges: DataFrame, planes: DataFrame, prior: np.ndarray | None = None, outer: int = 2, inner: int = 4, huber: float = 0.1, damping: float = 1e-6) -> np.ndarray:
    """The pose that brings points onto lines and planes, with a Huber loss.

    edges has px..pz and two points ax..az, bx..bz of the line; planes has px..pz, the unit normal nx..nz and offset d. Both hold
    correspondences of at most a frame; `outer` rounds of `inner` steps each, as correspondences are the caller's to renew.
    """
    pose = np.eye(4) if prior is None else np.array(prior, float)
    e = edges.select(*[F.col(c).cast("double") for c in ("px", "py", "pz")], *[F.col(c).cast("double").alias(n) for c, n in zip(("ax", "ay", "az", "bx", "by", "bz"), ("u0", "u1", "u2", "u3", "u4", "u5"), strict=True)], F.lit(0).alias("kind"))
    p = planes.select(*[F.col(c).cast("double") for c in ("px", "py", "pz", "nx", "ny", "nz", "d")], F.lit(1).alias("kind")).toDF("px", "py", "pz", "u0", "u1", "u2", "u3", "kind").withColumns({"u4": F.lit(0.0), "u5": F.lit(0.0)})
    rows = e.unionByName(p.select(e.columns))

    def residuals_at(at: np.ndarray):
        def residuals(pdf: pd.DataFrame):
            q, u, kind = _moved(pdf, at), pdf[[f"u{i}" for i in range(6)]].to_numpy(float), pdf["kind"].to_numpy()
            along = u[:, 3:] - u[:, :3]
            along = along / np.maximum(np.linalg.norm(along, axis=1, keepdims=True), 1e-300)
            off = q - u[:, :3]
            off = off - (off * along).sum(1, keepdims=True) * along
            size = np.linalg.norm(off, axis=1)
            line = kind == 0
            grad = np.where(line[:, None], off / np.maximum(size, 1e-12)[:, None], u[:, :3])
            r = np.where(line, size, (u[:, :3] * q).sum(1) + u[:, 3])
            return np.concatenate([np.cross(q, grad), grad], axis=1), r, _huber(r, huber)

        return residuals

    for _ in range(outer * inner):
        got = _solve(rows, residuals_at(pose), damping)
        if got is None:
            break
        pose = _step(pose, got[0])
        if np.linalg.norm(got[0]) < 1e-10:
            break
    return pose


def voxel_gaussians(points: DataFrame, res: int, least: int = 5) -> DataFrame:
    """Mean and covariance of every floored cell with enough points: ix, iy, iz, n, m0..m2, c00..c22 (upper)."""
    axes = ("x", "y", "z")
    g = points.groupBy(*[fdiv(a, res).alias(f"i{a}") for a in axes])
    g = g.agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)], *[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}{k}") for i, a in enumerate(axes) for k, b in enumerate(axes) if k >= i])
    return g.filter(F.col("n") >= least)


def match_distributions(points: DataFrame, gaussians: DataFrame, res: int, prior: np.ndarray | None = None, iterations: int = 30, epsilon: float = 1e-4, broadcast_cells: int = 200_000) -> tuple[np.ndarray, float]:
    """I3, our own design after the published voxelised method: pose and fitness (mean squared distance to the cells' means).

    Points meet the Gaussian of the cell they fall in; distances are weighed by its covariance, planes being stretched along
    themselves (eigenvalues 1, 1, 0.001). An iteration sums the moments of the points of every cell, so Python sees cells and not points.
    The cells are broadcast only if they were counted to be few.
    """
    pose = np.eye(4) if prior is None else np.array(prior, float)
    cells = gaussians
    if broadcast_cells and cells.limit(broadcast_cells + 1).count() <= broadcast_cells:
        cells = F.broadcast(cells)
    source = points.select(*[F.col(a).cast("double").alias(f"p{a}") for a in "xyz"])

    def joined(at: np.ndarray) -> DataFrame:
        """Moments of the moved points of every cell, about the cell's corner so that nothing cancels, beside its Gaussian."""
        q = [sum((F.col(f"p{a}") * float(at[i, k]) for k, a in enumerate("xyz")), F.lit(float(at[i, 3]))) for i in range(3)]
        p = source.select(*[c.alias(f"q{i}") for i, c in enumerate(q)])
        p = p.select("*", *[F.floor(F.col(f"q{i}") / res).cast("bigint").alias(f"i{a}") for i, a in enumerate("xyz")])
        p = p.select("ix", "iy", "iz", *[(F.col(f"q{i}") - F.col(f"i{a}") * res).alias(f"u{i}") for i, a in enumerate("xyz")])
        sums = [F.sum(f"u{i}").alias(f"s{i}") for i in range(3)] + [F.sum(F.col(f"u{i}") * F.col(f"u{k}")).alias(f"s{i}{k}") for i in range(3) for k in range(i, 3)]
        return p.groupBy("ix", "iy", "iz").agg(F.count("*").cast("double").alias("points"), *sums).join(cells, ["ix", "iy", "iz"])

    def sums_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """_partial() of all points of all cells. Residuals are A (q - m), their derivatives A [skew | I], both linear in q, so that their
        products are polynomials of second degree and follow from the moments."""
        n, corner = pdf["points"].to_numpy(float), pdf[["ix", "iy", "iz"]].to_numpy(float) * res
        first, second, cov = pdf[["s0", "s1", "s2"]].to_numpy(float), np.zeros((len(pdf), 3, 3)), np.zeros((len(pdf), 3, 3))
        for i in range(3):
            for k in range(i, 3):
                second[:, i, k] = second[:, k, i] = pdf[f"s{i}{k}"]
                cov[:, i, k] = cov[:, k, i] = pdf[f"c{i}{k}"]
        _, vecs = np.linalg.eigh(cov)
        w = vecs @ (np.array([1 / 1e-3, 1.0, 1.0])[None, :, None] * vecs.transpose(0, 2, 1))  # inverse stretched eigenvalues
        mean = first / n[:, None]
        spread = second - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        q, d = corner + mean, corner + mean - pdf[["m0", "m1", "m2"]].to_numpy(float)
        # [skew(q) | I] = base + sum over axes of (q_a - mean_a) by_axis[a]; the sums of single deviations vanish
        by_axis = np.zeros((3, 3, 6))
        for a, (r, c) in enumerate(((2, 1), (0, 2), (1, 0))):
            by_axis[a, r, c], by_axis[a, c, r] = -1.0, 1.0
        base = np.concatenate([np.einsum("na,arc->nrc", q, by_axis[:, :, :3]), np.tile(np.eye(3), (len(pdf), 1, 1))], axis=2)
        h = np.einsum("n,nri,nrs,nsk->ik", n, base, w, base, optimize=True) + np.einsum("nab,ari,nrs,bsk->ik", spread, by_axis, w, by_axis, optimize=True)
        g = np.einsum("n,nri,nrs,ns->i", n, base, w, d, optimize=True) + np.einsum("nab,ari,nrb->i", spread, by_axis, w, optimize=True)
        e = np.einsum("n,nr,nrs,ns->", n, d, w, d, optimize=True) + np.einsum("nab,nab->", spread, w)
        return pd.DataFrame([[*[h[i, k] for i, k in _UPPER], *g, float(e), float(3 * n.sum())]], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    for _ in range(iterations):
        got = _solve_sums(joined(pose), sums_of, 1e-6)
        if got is None:
            return pose, float("inf")
        pose = _step(pose, got[0])
        if np.linalg.norm(got[0]) < epsilon:
            break
    at = joined(pose)
    off = [F.col(f"i{a}") * res - F.col(f"m{i}") for i, a in enumerate("xyz")]
    d2 = [F.col(f"s{i}{i}") + 2 * F.col(f"s{i}") * off[i] + F.col("points") * off[i] * off[i] for i in range(3)]
    fit = at.agg((F.sum(d2[0] + d2[1] + d2[2]) / F.sum("points")).alias("f")).first()["f"]
    return pose, float("inf") if fit is None else float(fit)


def refine(points: DataFrame, gaussians: DataFrame, res: int, prior: np.ndarray, limit: float) -> np.ndarray:
    """the refined pose, or the identity where its fitness is over the limit."""
    pose, fit = match_distributions(points, gaussians, res, prior)
    return pose if fit <= limit else np.eye(4)
