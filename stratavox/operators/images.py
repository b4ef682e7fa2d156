"""Image stencils (O5): grey levels, 5x5 Gaussian and gradient magnitude, each axis one window over the pixels of a line.

Images are rows image_id, row, col and a level. Bilateral filtering and hysteresis need an image library and are not built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Binomial weights of the 5-tap Gaussian, over 16.
TAPS = (1, 4, 6, 4, 1)


def grey(pixels: DataFrame) -> DataFrame:
    """Rounded luma of r, g, b (0 to 255) in integers."""
    return pixels.withColumn("level", F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114 + 500) / 1000).cast("bigint"))


def _along(pixels: DataFrame, axis: str, taps: tuple[int, ...], src: str, out: str) -> DataFrame:
    other = "row" if axis == "col" else "col"
    w = Window.partitionBy("image_id", other).orderBy(axis)
    half = len(taps) // 2
    terms = [(F.lag(src, half - k).over(w) if k < half else F.lead(src, k - half).over(w) if k > half else F.col(src), t) for k, t in enumerate(taps)]
    total = sum((F.coalesce(c, F.col(src)) * t for c, t in terms[1:]), F.coalesce(terms[0][0], F.col(src)) * terms[0][1])
    return pixels.withColumn(out, total)


def gaussian(pixels: DataFrame, src: str = "level", out: str = "smooth") -> DataFrame:
    """Separable 5x5 binomial blur, truncated to integers; beyond an edge the pixel itself counts."""
    df = _along(_along(pixels, "col", TAPS, src, "_h"), "row", TAPS, "_h", "_v")
    return df.withColumn(out, F.floor(F.col("_v") / 256).cast("bigint")).drop("_h", "_v")


def gradient(pixels: DataFrame, src: str = "smooth") -> DataFrame:
    """Central differences gx and gy and their summed magnitude."""
    df = _along(_along(pixels, "col", (-1, 0, 1), src, "gx"), "row", (-1, 0, 1), src, "gy")
    return df.withColumn("edge", F.abs("gx") + F.abs("gy"))
