"""Chunked voxel maps on Parquet (S6-S8, S10, S11, D6), the sliding window (I4) and the pose table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.functions.grid import CHUNK, chunk_of, in_bounds, in_chunk_index, lng, pack, round_half_away, unpack_value, unpack_weight
from stratavox.schemas import MAP_CHUNKS, MAP_META

AXES = ("x", "y", "z")


def with_chunk(voxels: DataFrame) -> DataFrame:
    return voxels.select(*[chunk_of(f"i{a}").alias(f"c{a}") for a in AXES], *voxels.columns)


def write_map(voxels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cells by chunk directory; mode "upsert" replaces the chunks that occur and leaves the others."""
    spark = voxels.sparkSession
    rows = with_chunk(voxels).repartition("cx", "cy", "cz")
    writer = rows.write.partitionBy("cx", "cy", "cz")
    if mode == "upsert":
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode(mode).parquet(path)
    spark.catalog.refreshByPath(path)


def read_map(spark: SparkSession, path: str, window: tuple | None = None) -> DataFrame:
    """Cells of a map. A window (centre, size) becomes a range of chunk directories, so others are not read, and a cell filter."""
    df = spark.read.schema("ix bigint, iy bigint, iz bigint, value bigint, weight bigint, cx bigint, cy bigint, cz bigint").parquet(path)
    if window is not None:
        for a, p, s in zip(AXES, *window, strict=True):
            df = df.filter(F.col(f"c{a}").between((p - s // 2) // CHUNK, (p + s // 2) // CHUNK) & in_bounds(f"i{a}", p, s))
    return df.select("ix", "iy", "iz", "value", "weight")


def dense_chunks(voxels: DataFrame, default_value: int, default_weight: int = 0) -> DataFrame:
    """One row per touched chunk: all 64^3 packed cells, untouched ones at the default. A chunk is a bounded group."""
    v = with_chunk(voxels).select("cx", "cy", "cz", in_chunk_index("ix", "iy", "iz").alias("slot"), pack("value", "weight").alias("raw"))
    default = ((default_weight & 0xFFFF) << 16) + (default_value & 0xFFFF)

    def run(t: pa.Table) -> pa.Table:
        data = np.full(CHUNK**3, default, np.int64)
        data[t.column("slot").to_numpy()] = t.column("raw").to_numpy()
        return pa.table({**{c: t.column(c).slice(0, 1) for c in ("cx", "cy", "cz")}, "data": pa.array([data], pa.list_(pa.int64()))})

    return v.groupBy("cx", "cy", "cz").applyInArrow(run, MAP_CHUNKS)


def touched_cells(chunks: DataFrame) -> DataFrame:
    """Cells of dense chunks with a positive weight."""
    c = chunks.select("cx", "cy", "cz", F.posexplode("data").alias("slot", "raw"))
    c = c.select(*[(F.col(f"c{a}") * CHUNK + F.pmod(F.floor(F.col("slot") / d), F.lit(CHUNK))).cast("bigint").alias(f"i{a}") for a, d in zip(AXES, (CHUNK * CHUNK, CHUNK, 1), strict=True)], unpack_value("raw").alias("value"), unpack_weight("raw").alias("weight"))
    return c.filter("weight > 0")


def kept(voxels: DataFrame, condition: Column) -> DataFrame:
    """The merged cells for which the condition holds. A filter would go below the merge and repeat the march's arithmetic for every
    comparison, in a method too large for Java to compile; a generator stays above it."""
    return voxels.select("*", F.explode_outer(F.when(condition, F.array(F.lit(1)))).alias("_kept")).filter("_kept is not null").drop("_kept")


def leaving(voxels: DataFrame, old: tuple, new: tuple, size: tuple) -> DataFrame:
    """I4: cells of the old window that the new one does not hold."""
    def inside(pos):
        return in_bounds("ix", pos[0], size[0]) & in_bounds("iy", pos[1], size[1]) & in_bounds("iz", pos[2], size[2])
    return kept(voxels, inside(old) & ~inside(new))


def entering(voxels: DataFrame, old: tuple, new: tuple, size: tuple) -> DataFrame:
    return leaving(voxels, new, old, size)


class MapVersions:
    """A map as numbered folders under a path. A version counts once it is whole, so readers go on with the last one while
    the next is written, and no lock is held; drop() removes versions that no one reads any more."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _child(self, name: str):
        return self._root.suffix(f"/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._child(f"{n}/_SUCCESS")))

    def publish(self, voxels: DataFrame) -> int:
        number = (self.versions() or [-1])[-1] + 1
        write_map(voxels, f"{self.path}/v{number}")
        return number

    def read(self, number: int | None = None, window: tuple | None = None) -> DataFrame:
        """A version, the newest whole one by default."""
        return read_map(self.spark, f"{self.path}/v{self.versions()[-1] if number is None else number}", window)

    def drop(self, before: int) -> None:
        for n in self.versions():
            if n < before:
                self._fs.delete(self._child(f"v{n}"), True)


class LocalMap:
    """A window over an immutable map version. shift() changes a predicate; set() adds a new version of single cells."""

    def __init__(self, voxels: DataFrame, size: tuple[int, int, int], default: tuple[int, int], pos: tuple[int, int, int] = (0, 0, 0)):
        self.voxels, self.default, self.pos = voxels, default, tuple(pos)
        self.size = tuple(s + 1 - s % 2 for s in size)
        self.offset = tuple(s // 2 for s in self.size)
        self.changed: dict[tuple[int, int, int], tuple[int, int]] = {}

    def shift(self, pos: tuple[int, int, int]) -> None:
        self.offset = tuple((o + n - p) % s for o, n, p, s in zip(self.offset, pos, self.pos, self.size, strict=True))
        self.pos = tuple(pos)

    def holds(self, x: int, y: int, z: int, buffer: int = 0) -> bool:
        return all(abs(c - p) <= s // 2 - buffer for c, p, s in zip((x, y, z), self.pos, self.size, strict=True))

    def cells(self) -> DataFrame:
        v = self.flush()
        for c, p, s in zip(("ix", "iy", "iz"), self.pos, self.size, strict=True):
            v = v.filter(in_bounds(c, p, s))
        return v

    def value(self, x: int, y: int, z: int) -> tuple[int, int]:
        if not self.holds(x, y, z):
            raise IndexError(f"cell {(x, y, z)} is outside the window")
        return self.values([(x, y, z)])[0]

    def values(self, cells: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Many cells by one job; what was set last counts."""
        for c in cells:
            if not self.holds(*c):
                raise IndexError(f"cell {c} is outside the window")
        asked = [c for c in cells if c not in self.changed]
        found = {}
        if asked:
            keys = self.voxels.sparkSession.createDataFrame(asked, "ix bigint, iy bigint, iz bigint").distinct()
            found = {(r.ix, r.iy, r.iz): (r.value, r.weight) for r in self.voxels.join(F.broadcast(keys), ["ix", "iy", "iz"]).collect()}
        return [self.changed.get(c) or found.get(c, self.default) for c in cells]

    def set(self, x: int, y: int, z: int, value: int, weight: int) -> None:
        """Cells that were set stay on the driver until flush(), one small table whatever their number of changes."""
        if not self.holds(x, y, z):
            raise IndexError(f"cell {(x, y, z)} is outside the window")
        self.changed[x, y, z] = (value, weight)

    def flush(self) -> DataFrame:
        """The map's new version with all cells that were set."""
        if self.changed:
            new = self.voxels.sparkSession.createDataFrame([(*c, *v) for c, v in self.changed.items()], "ix bigint, iy bigint, iz bigint, value bigint, weight bigint")
            kept = self.voxels.join(F.broadcast(new.select("ix", "iy", "iz")), ["ix", "iy", "iz"], "left_anti")
            self.voxels, self.changed = kept.unionByName(new.select(kept.columns)), {}
        return self.voxels


def store_poses(poses: DataFrame, scale: float = 1000.0, session: str | None = None, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """pose_id by order (within a session, if given), translation scaled down and all parts rounded to three decimals, half away from zero."""
    w = Window.partitionBy(*([session] if session else [])).orderBy(*order)
    three = lambda c, s: round_half_away(F.col(c).cast("double") / s * 1000) / 1000
    cols = [three(f"t{a}", scale).alias(f"t{a}") for a in AXES] + [three(f"q{a}", 1.0).alias(f"q{a}") for a in ("x", "y", "z", "w")]
    return poses.select(*([session] if session else []), lng(F.row_number().over(w) - 1).alias("pose_id"), *cols)


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """S10."""
    spark.createDataFrame([tuple(meta[k.strip().split()[0]] for k in MAP_META.split(","))], MAP_META).write.mode("overwrite").parquet(path)
