"""Embedding whitening: MLlib's RowMatrix over exactly centred rows gives the covariance, whose eigenvectors whiten every row."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StringType, StructField, StructType

#: Eigenvalues up to this share of the greatest are numerically zero: their components have no direction and whiten to 0.
ZERO = 1e-12


def _gramian(rows: DataFrame, col: str) -> np.ndarray:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(col).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, dict]:
    """(rows, facts). rows: id_col, deviation decimal(38,0), whitened array<double> of up to `components`, greatest variance first.

    Entries count as x = floor(scale * c) + shift. n is the number of fitted vectors and S their exact sums per dimension; deviation is
    the exact sum of (n * x - S)**2; rows are centred as (n * x - S) / n from whole numbers before anything is multiplied. facts: n,
    explained (eigenvalue over trace, per component) and identity_error, measured over the whitened rows themselves.

    Null vectors, empty ones and those with null or non-finite entries are dropped; so are vectors of other lengths than the commonest (ties:
    the longest), as they share no dimensions. Every row counts, repeated ones too. Components of zero variance whiten to 0, explain 0
    and are left out of identity_error. No vectors: no rows. Entries whose x leaves 2**40 are refused.
    """
    c = F.col(vec_col).cast("array<double>")
    fine = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), c.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0)).filter(fine)
    spark = rows.sparkSession
    out = StructType([StructField("id", rows.schema["id"].dataType), StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    sizes = rows.groupBy(F.size("c").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col), {"n": 0, "explained": [], "identity_error": 0.0}
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    able = F.forall("c", lambda e: F.abs(e * scale) < float(1 << 40))
    x = F.when(able, F.transform("c", lambda e: F.floor(e * scale) + shift))
    x = F.coalesce(x, F.raise_error(F.lit("an entry times the scale is 2**40 or more")).cast("array<bigint>"))
    rows = rows.filter(F.size("c") == dim).select("id", x.alias("x"))
    total = rows.agg(*(F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dim))).first()
    whole, rest = zip(*(divmod(int(s), n) for s in total), strict=True)  # S = whole * n + rest, so n * x - S = n * (x - whole) - rest
    centred = rows.select("id", F.zip_with("x", F.array(*map(F.lit, whole)), lambda a, b: a - b).alias("d"))
    share = F.array(*(F.lit(float(r)) for r in rest))
    # n * d - rest is a whole number, exact in a double below 2**53; beyond that both terms round by 1 in 2**53 and nothing cancels.
    exact = F.transform("d", lambda d, i: (d * F.lit(float(n)) - F.element_at(share, i + 1)) / F.lit(float(n)))
    values, axes = np.linalg.eigh(_gramian(centred.select(exact.alias("y")), "y") / n)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > ZERO * max(values[0], 0.0)
    use = min(components, dim)
    project = spark.sparkContext.broadcast((axes[:, :use] * np.where(real[:use], 1 / np.sqrt(np.where(real[:use], values[:use], 1.0)), 0.0), np.array(rest, np.int64)))

    def parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        axis, r = project.value
        d = np.stack(pdf["d"].to_numpy()).astype(np.int64)
        return d, ((d * float(n) - r) / n) @ axis

    def deviations(d: np.ndarray) -> list[int]:
        _, r = project.value
        squares = sum(int(t) ** 2 for t in r)
        top = int(np.abs(d).max())
        if top * max(top, int(r.max())) * dim >= 1 << 62:
            d, r = d.astype(object), r.astype(object)
        return [n * n * int(a) - 2 * n * int(b) + squares for a, b in zip((d * d).sum(1), (d * r).sum(1), strict=True)]

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                d, w = parts(pdf)
                yield pd.DataFrame({"id": pdf["id"], "deviation": [Decimal(t) for t in deviations(d)], "whitened": list(w)})

    def moments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, mean, seen = np.zeros((use, use)), np.zeros(use), False
        for pdf in it:
            if len(pdf):
                _, w = parts(pdf)
                gram, mean, seen = gram + w.T @ w, mean + w.sum(0), True
        if seen:
            yield pd.DataFrame({"at": np.arange(use * (use + 1)), "value": np.concatenate([gram.ravel(), mean])})

    got = centred.select("d").mapInPandas(moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(use * (use + 1))
    for r in got:
        flat[r["at"]] = r["value"] / n
    cov = flat[: use * use].reshape(use, use) - np.outer(flat[use * use :], flat[use * use :])
    live = real[:use]
    error = float(np.abs(cov - np.eye(use))[np.ix_(live, live)].max()) if live.any() else 0.0
    trace = float(values.sum())
    explained = [float(v) / trace if ok else 0.0 for v, ok in zip(values[:use], live, strict=True)]
    # Ids cross as text: a null among whole numbers would make them doubles.
    texts = StructType([StructField("id", StringType()), *out.fields[1:]])
    done = centred.select(F.col("id").cast("string").alias("id"), "d").mapInPandas(finish, texts)
    return done.select(F.col("id").cast(out["id"].dataType).alias(id_col), "deviation", "whitened"), {"n": n, "explained": explained, "identity_error": error}
