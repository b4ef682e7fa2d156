"""Helpers shared by the text operators: table access, shared-folder staging, Arrow batch mapping."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write: spark.checkpoint.dir. Only a local session may leave it unset and gets a
    temporary one; on a cluster that is an error, as executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="stratavox-")
    return shared_dir.own


_staged: list[tuple[SparkSession, str]] = []


def _drop_staged() -> None:
    for spark, path in _staged:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone; the shared folder's owner cleans up
            pass
    _staged.clear()


atexit.register(_drop_staged)


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. `by` is a column of few
    values, each of which gets a folder, so that filters on it skip the others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote for df, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        for item in [x for x in _staged if folder.endswith(x[1].rsplit("/", 1)[1])]:
            spark, path = item
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _staged.remove(item)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n), F.lit(0))


#: Rows of an Arrow batch. Texts are long: a tenth of Spark's default keeps several workers within an executor's overhead.
BATCH_ROWS = 500


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches limited to BATCH_ROWS rows, a setting of the session that stays (README, "Scale")."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow with a function of one batch; the function sees bounded batches, so memory is bounded."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return bounded_batches(df).mapInArrow(run, schema)


# ---------------------------------------------------------------- word hashing over bytes

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _pow_cache:
        _pow_cache.clear()
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, _INV, np.uint64)
        down[0] = 1
        _pow_cache[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _pow_cache[size]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (runs of bytes above 32) of a UTF-8 byte array, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    inside = data > 32
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """64-bit hashes of runs of k words; a text of fewer words has one shingle, all its words."""
    n = len(words)
    if not n:
        return words
    if n < k:
        k = n
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[i : n - k + 1 + i]
    return mix64(h)


def free_names(taken: list[str], *wanted: str) -> tuple[str, ...]:
    """The wanted names, with underscores before them until none of them is taken."""
    low = {t.lower() for t in taken}
    while low & {w.lower() for w in wanted}:
        wanted = tuple("_" + w for w in wanted)
    return wanted


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
