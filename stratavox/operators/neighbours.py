"""Local geometry from neighbour joins (A8, A9, A11, F12-F14); the joins themselves are those of kdtree.py."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.operators.kdtree import AXES, box_join, knn_join, radius_join

__all__ = ["accepted", "box_join", "knn_join", "plane_fit", "principal_axes", "radius_join", "scatter", "vector_knn"]


def accepted(knn: DataFrame, query_key: list[str], k: int, limit2: int) -> DataFrame:
    """neighbours of queries whose k-th exists and is nearer than the limit (squared). A bounded group per query."""
    ok = knn.groupBy(*query_key).agg(F.count("*").alias("_n"), F.max("d2").alias("_far")).filter((F.col("_n") == k) & (F.col("_far") < limit2))
    return knn.join(ok.select(*query_key), query_key, "left_semi")


def scatter(knn: DataFrame, query_key: list[str], prefix: str = "p_", points: str | None = None) -> DataFrame:
    """Count, coordinate sums and the six product sums of each query's neighbours; `points` names a column for all of them."""
    cols = [F.sum(f"{prefix}{a}").alias(f"s{a}") for a in AXES] + [F.sum(F.col(f"{prefix}{a}") * F.col(f"{prefix}{b}")).alias(f"s{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    held = [F.collect_list(F.array(*[f"{prefix}{a}" for a in AXES])).alias(points)] if points else []
    return knn.groupBy(*query_key).agg(F.count("*").alias("n"), *cols, *held)


def _matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = pdf["n"].to_numpy(float)[:, None]
    mean = pdf[["sx", "sy", "sz"]].to_numpy(float) / n
    m = np.zeros((len(pdf), 3, 3))
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES):
            m[:, i, j] = pdf["s" + min(a, b) + max(a, b)]
    return n[:, 0], mean, m


def principal_axes(moments: DataFrame) -> DataFrame:
    """Adds the mean, ascending eigenvalues of the scatter about it, line direction, surface normal and is_line.

    is_line holds if the greatest eigenvalue exceeds three times the second. Vectorised over Arrow batches of moments.
    """
    extra = "mx double, my double, mz double, e0 double, e1 double, e2 double, lx double, ly double, lz double, nx double, ny double, nz double, is_line boolean"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields) + ", " + extra

    def run(it):
        for pdf in it:
            n, mean, m = _matrices(pdf)
            cov = m - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
            val, vecs = np.linalg.eigh(cov)
            yield pdf.assign(mx=mean[:, 0], my=mean[:, 1], mz=mean[:, 2], e0=val[:, 0], e1=val[:, 1], e2=val[:, 2], lx=vecs[:, 0, 2], ly=vecs[:, 1, 2], lz=vecs[:, 2, 2], nx=vecs[:, 0, 0], ny=vecs[:, 1, 0], nz=vecs[:, 2, 0], is_line=val[:, 2] > 3 * val[:, 1])

    return moments.mapInPandas(run, schema)


def plane_fit(moments: DataFrame) -> DataFrame:
    """Unit normal and offset of the plane n p + d = 0 that least squares fit; null where the points do not span one.

    The 3x3 system of the moments is solved by its cofactors, as columns.
    """
    m = {a + b: F.col(f"s{min(a, b)}{max(a, b)}").cast("double") for a in AXES for b in AXES}
    xx, xy, xz, yy, yz, zz = (m[k] for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    cof = {"xx": yy * zz - yz * yz, "xy": xz * yz - xy * zz, "xz": xy * yz - xz * yy, "yy": xx * zz - xz * xz, "yz": xy * xz - xx * yz, "zz": xx * yy - xy * xy}
    df = moments.select("*", *[c.alias(f"_{k}") for k, c in cof.items()], (xx + yy + zz).alias("_t"))
    det = xx * F.col("_xx") + xy * F.col("_xy") + xz * F.col("_xz")
    df = df.select("*", F.when(F.abs(det) > F.col("_t") * F.col("_t") * F.col("_t") * 1e-9, det).alias("_d"))
    row = lambda a: -sum((F.col(f"_{min(a, b)}{max(a, b)}") * F.col(f"s{b}") for b in AXES[1:]), F.col(f"_{min(a, 'x')}{max(a, 'x')}") * F.col("sx")) / F.col("_d")
    df = df.select("*", *[row(a).alias(f"_n{a}") for a in AXES])
    df = df.select("*", F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz")).alias("_l"))
    return df.select(*moments.columns, *[(F.col(f"_n{a}") / F.col("_l")).alias(n) for a, n in zip(AXES, "abc", strict=True)], (1 / F.col("_l")).alias("d"))


def _whole(lists: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of the first `dim` components of each list, as doubles; what a list does not have is NaN."""
    if not lists.null_count and not lists.values.null_count and (lists.value_lengths().to_numpy() == dim).all():
        return np.floor(lists.flatten().to_numpy().astype(float).reshape(-1, dim) * scale)
    out = np.full((len(lists), dim), np.nan)
    for i, v in enumerate(lists.to_pylist()):
        for j, x in enumerate((v or [])[:dim]):
            if x is not None:
                out[i, j] = math.floor(x * scale)
    return out


def _distances(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Squared distances over the components that both have, and where there is none. Exact: by products of doubles where all of
    them are below 2**53, else by whole numbers."""
    has_q, has_p = ~np.isnan(q), ~np.isnan(p)
    whole = has_q.all() and has_p.all()
    q, p = np.nan_to_num(q), np.nan_to_num(p)
    kind = float if max(np.abs(q).max(initial=0), np.abs(p).max(initial=0)) <= (1 << 22) and q.shape[1] <= 64 else np.int64
    q, p, has_q, has_p = (x.astype(kind) for x in (q, p, has_q, has_p))
    d2 = -2 * q @ p.T
    if whole:
        d2 += (q * q).sum(1)[:, None]
        d2 += (p * p).sum(1)
        return d2, None
    return d2 + (q * q) @ has_p.T + has_q @ (p * p).T, has_q @ has_p.T == 0


def vector_knn(vectors: DataFrame, asked: DataFrame, k: int, dim: int, scale: float, query_block: int = 4096, point_block: int = 4096) -> DataFrame:
    """query_id, vec_id, d2, rank: the k nearest of all vectors (vec_id, embedding) to every asked one, in whole steps of 1 / scale, ties by vec_id.

    All pairs are compared, which is quadratic by nature. Blocks of queries meet blocks of vectors, a tile a group, in products of
    matrices; a tile gives out k rows a query. Distances run over components that both have; where there is none they are null and last.
    """
    rows, cols = (max(1, math.ceil(df.count() / size)) for df, size in ((asked, query_block), (vectors, point_block)))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select("vec_id", "embedding", F.lit(True).alias("asks"), at(rows).alias("row"), every(cols).alias("col"))
    p = vectors.select("vec_id", "embedding", F.lit(False).alias("asks"), every(rows).alias("row"), at(cols).alias("col"))

    def best(t: pa.Table) -> pa.Table:
        asks = t.column("asks")
        # without a common component the greatest number stands for null
        found, none = [], np.iinfo(np.int64).max
        queries, points = t.filter(asks), t.filter(pa.array(~asks.to_numpy())).sort_by("vec_id")
        ids, x = points.column("vec_id").to_numpy(), _whole(points.column("embedding").combine_chunks(), dim, scale)
        for i in range(0, queries.num_rows if len(ids) else 0, 256):
            part = queries.slice(i, 256)
            d2, apart = _distances(_whole(part.column("embedding").combine_chunks(), dim, scale), x)
            if apart is not None:
                d2 = d2.astype(np.int64)
                d2[apart] = none
            last = min(k, len(ids)) - 1
            row, col = np.nonzero(d2 <= np.partition(d2, last, axis=1)[:, last : last + 1])
            d = d2[row, col].astype(np.int64)
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            ok = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((part.column("vec_id").to_numpy()[row[ok]], ids[col[ok]], d[ok]))
        query, vec, d = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "d2": pa.array(d, pa.int64(), mask=d == none)})

    tiles = q.unionAll(p).repartition(rows * cols, "row", "col").groupBy("row", "col").applyInArrow(best, "query_id bigint, vec_id bigint, d2 bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("d2"), "vec_id")).cast("bigint")
    return tiles.withColumn("rank", rank).filter(F.col("rank") <= k)
