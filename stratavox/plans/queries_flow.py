"""Registered queries of sources, sinks, the map store and streams: what is written is read back, what streams is drained to the end."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.operators import mapstore as MS
from stratavox.operators import metrics as ME
from stratavox.plans import queries as Q
from stratavox.plans import sql as S
from stratavox.schemas import MAP_META, RAW_CLOUD
from stratavox.sources import adapters as A
from stratavox.sources import clouds as C
from stratavox.streaming import flows as FL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_used: list[tuple[SparkSession, str]] = []


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one (spark.checkpoint.dir), removed when the driver ends; local sessions may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratavox-")
    path = f"{base}/flow-{uuid.uuid4().hex}"
    _used.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _used:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone; the shared folder's owner cleans up
            return


# ---------------------------------------------------------------- files and messages


def _cloud(spark, sf) -> DataFrame:
    return A.points(spark, sf).select("scan_id", "idx", *[F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "intensity")])


_CLOUD_SQL = f"WITH {S.PTS} SELECT scan_id, idx, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(intensity AS DOUBLE) AS intensity FROM pts"


def _doubles(df: DataFrame) -> DataFrame:
    return df.select("scan_id", "idx", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity")])


@query(_CLOUD_SQL)
def pcd_files(spark, sf):
    """One PCD file a scan, written by the executors and read back; names are the scan in five digits."""
    folder = _folder(spark)
    C.write_files(C.encode_files(_cloud(spark, sf), "pcd"), folder)
    back = C.read_pcd(spark, f"{folder}/*.pcd")
    return _doubles(back.withColumn("scan_id", F.regexp_extract("path", r"(\d+)\.pcd$", 1).cast("bigint")))


@query(_CLOUD_SQL)
def pcd_compressed_files(spark, sf):
    """The same in compressed form, each field's values together."""
    folder = _folder(spark)
    C.write_files(C.encode_files(_cloud(spark, sf), "pcd_compressed"), folder)
    back = C.read_pcd(spark, f"{folder}/*.pcd")
    return _doubles(back.withColumn("scan_id", F.regexp_extract("path", r"(\d+)\.pcd$", 1).cast("bigint")))


@query(_CLOUD_SQL)
def ply_files(spark, sf):
    """PLY files, decoded again."""
    files = C.encode_files(_cloud(spark, sf), "ply").select("scan_id", "content")

    def run(it):
        for b in it:
            for key, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = C.ply_floats(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(v), pa.int64()), pa.array(np.arange(len(v))), *[pa.array(np.ascontiguousarray(v[:, k], float)) for k in range(4)]], names=["scan_id", "idx", "x", "y", "z", "intensity"])

    return files.mapInArrow(run, "scan_id bigint, idx bigint, x double, y double, z double, intensity double")


@query(_CLOUD_SQL)
def message_decode(spark, sf):
    """S3: self-describing messages, one a scan, with fields out of order and padding between points."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        rec = np.zeros(t.num_rows, [("intensity", "<f8"), ("pad", "<u4"), ("z", "<f4"), ("y", "<f4"), ("x", "<i4")])
        for c in ("x", "y", "z", "intensity"):
            rec[c] = t.column(c).to_numpy()
        return pa.table({"scan_id": t.column("scan_id").slice(0, 1), "n": pa.array([t.num_rows], pa.int32()), "data": pa.array([rec.tobytes()], pa.binary())})

    packed = _cloud(spark, sf).groupBy("scan_id").applyInArrow(pack, "scan_id bigint, n int, data binary")
    fields = [("x", 20, 5, 1), ("y", 16, 7, 1), ("z", 12, 7, 1), ("intensity", 0, 8, 1)]
    shape = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("offset"), F.lit(d).alias("datatype"), F.lit(c).alias("count")) for n, o, d, c in fields])
    m = packed.select(F.lit(None).cast("timestamp").alias("stamp"), F.col("scan_id").cast("string").alias("frame_id"), F.lit(1).alias("height"), F.col("n").alias("width"), F.lit(24).alias("point_step"), (F.col("n") * 24).alias("row_step"), F.lit(True).alias("is_dense"), shape.alias("fields"), "data")
    assert m.columns == [f.split()[0] for f in RAW_CLOUD.split(", ")]
    back = C.decode_messages(m)
    return _doubles(back.withColumns({"scan_id": F.col("frame_id").cast("bigint"), "idx": F.col("col").cast("bigint")}))


@query(f"WITH {S.PTS} SELECT scan_id, count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(intensity) AS DOUBLE) AS si, CAST(sum(intensity % 256 * 65536 + abs(z) % 256 * 256 + abs(y) % 256) AS BIGINT) AS colours FROM pts GROUP BY scan_id")
def scan_tensors(spark, sf):
    """Scans as arrays of positions and of a field; colours packed and unpacked."""
    p = A.points(spark, sf).select("scan_id", "idx", *[F.col(a).cast("double").alias(a) for a in "xyz"], F.col("intensity").cast("double").alias("intensity"), *[(F.abs(c) % 256).cast("int").alias(n) for c, n in (("intensity", "red"), ("z", "green"), ("y", "blue"))])
    p = p.withColumn("rgb", C.pack_rgb("red", "green", "blue"))
    r, g, b = C.unpack_rgb("rgb")
    t = C.to_tensors(p.select("*", r, g, b), "scan_id", "idx", ("intensity", "r", "g", "b"))
    add = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x))
    colours = F.aggregate(F.zip_with("r", F.zip_with("g", "b", lambda g, b: g.cast("bigint") * 256 + b), lambda r, gb: r.cast("bigint") * 65536 + gb), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return t.select("scan_id", F.size("positions").cast("bigint").alias("n"), add("positions", lambda x: x[0]).alias("sx"), add("intensity", lambda x: x).alias("si"), colours.alias("colours"))


@query(Q.ORACLE_SQL["runtime_stats"])
def timing_sheet(spark, sf):
    """The statistics as a named sheet with a header, read back."""
    folder, stats = _folder(spark), ME.runtime_stats(A.timings(spark, sf))
    path = ME.write_sheet(stats, folder, "timings", ";", datetime(2024, 5, 6, 7, 8, 9))
    assert path.endswith("/2024-05-06_07-08-09/timings")
    return spark.read.schema(stats.schema).csv(path, header=True, sep=";")


# ---------------------------------------------------------------- the map store


@query("SELECT 600 AS tau, 312 AS map_size_x, 312 AS map_size_y, 78 AS map_size_z, 64 AS map_resolution, 640 AS max_weight")
def map_metadata_stored(spark, sf):
    """The default map's metadata, written over an older one and read back."""
    from stratavox.params import Map

    folder, meta = _folder(spark), Map().metadata()
    MS.write_metadata(spark, meta | {"tau": 1}, folder)
    MS.write_metadata(spark, meta, folder)
    return spark.read.schema(MAP_META).parquet(folder).drop("max_distance")


_HALF_B = "nb AS (SELECT * FROM b WHERE ix >= 0)"
_REPLACED = f"keep AS (SELECT * FROM a WHERE ({', '.join(S.fdiv(f'i{x}', 64) for x in 'xyz')}) NOT IN (SELECT ({', '.join(S.fdiv(f'i{x}', 64) for x in 'xyz')}) FROM nb))"


@query(f"WITH {Q._TWO}, {_HALF_B}, {_REPLACED} SELECT * FROM (SELECT * FROM keep UNION ALL SELECT * FROM nb) WHERE abs(ix - 2) <= 12 AND abs(iy + 1) <= 10 AND abs(iz) <= 4")
def map_window_read(spark, sf):
    """A map is written, some chunks are replaced, and a window is read."""
    folder = _folder(spark)
    MS.write_map(Q._state(spark, sf, 0), folder)
    MS.write_map(MS.kept(Q._state(spark, sf, 1), F.col("ix") >= 0), folder, "upsert")
    return MS.read_map(spark, folder, ((2, -1, 0), (25, 21, 9)))


@query(f"WITH {Q._TWO} SELECT 0 AS version, * FROM a UNION ALL SELECT 1 AS version, * FROM b")
def map_versions(spark, sf):
    """A reader of the version before goes on while the next is written."""
    maps = MS.MapVersions(spark, _folder(spark))
    first = maps.publish(Q._state(spark, sf, 0))
    before = maps.read()
    second = maps.publish(Q._state(spark, sf, 1))
    assert (first, second) == (0, 1)
    return before.select(F.lit(0).alias("version"), "*").unionByName(maps.read().select(F.lit(1).alias("version"), "*"))


@query("SELECT * FROM (VALUES (0, CAST(7 AS BIGINT), CAST(64 AS BIGINT)), (1, CAST(-3 AS BIGINT), CAST(1 AS BIGINT)), (2, CAST(6000 AS BIGINT), CAST(0 AS BIGINT))) t(cell, value, weight)")
def map_cells(spark, sf):
    """Cells set and read in a window, and the default entry of one that was not."""
    m = MS.LocalMap(Q._voxels(spark, sf).filter("weight > 1000"), (9, 9, 9), (Q.TAU, 0))
    m.set(1, 2, 3, 5, 5)
    m.set(1, 2, 3, 7, 64)
    m.set(0, 0, 0, -3, 1)
    m.flush()
    rows = [(k, *v) for k, v in enumerate(m.values([(1, 2, 3), (0, 0, 0), (4, 4, 4)]))]
    return spark.createDataFrame(rows, "cell int, value bigint, weight bigint")


# ---------------------------------------------------------------- streams


#: Micro-batches that the queries' inputs fall into, besides the one of the closing beat.
BATCHES = 3


def _stream(df: DataFrame, ts: str) -> tuple[DataFrame, str]:
    """df as a stream in BATCHES micro-batches of files, and a folder for what it makes.

    Rows are out of order by up to 1.6 of a batch's span of time, within and across batches; the watermark waits for twice that span.
    """
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    low, high = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    low, high = low or 0, high or 0
    span = (high - low) // BATCHES + 1
    mixed = F.pmod(F.xxhash64(*df.columns), F.lit(1000))
    batch = F.least(F.floor((F.unix_micros(ts) - low) / span + mixed * 0.0006), F.lit(BATCHES - 1))
    for k in range(BATCHES):
        df.filter(batch == k).sortWithinPartitions(mixed).write.mode("append").parquet(f"{folder}/in")
    files = len(spark.read.schema(df.schema).parquet(f"{folder}/in").inputFiles())
    FL.write_beat(spark, f"{folder}/in", df.schema, ts, datetime.fromtimestamp((high + 4 * span) / 1e6 + 1, UTC))
    return FL.read_stream(spark, f"{folder}/in", df.schema, ts, f"{2 * span} microseconds", files_per_trigger=-(-files // BATCHES)), folder


@query(Q.ORACLE_SQL["imu_smooth"].replace("SELECT event_id, sensor_id,", "SELECT sensor_id,").replace("AS smooth", "AS smooth, epoch_us(ts) AS us"))
def stream_smooth(spark, sf):
    """S2, T4."""
    imu = A.imu(spark, sf).select("event_id", "sensor_id", F.col("ts").cast("timestamp").alias("ts"), "w")
    src, folder = _stream(imu, "ts")
    out = FL.drain(FL.smooth_stream(src, order=("event_id",)), f"{folder}/out")
    return out.select("sensor_id", "smooth", F.unix_micros("ts").alias("us"))


def _events(spark, sf) -> DataFrame:
    both = A.imu(spark, sf).select("event_id", "sensor_id", F.col("ts").cast("timestamp").alias("ts"), "w", F.lit(0).alias("kind"))
    return both.unionByName(A.scans(spark, sf).select(F.col("scan_key").alias("event_id"), "sensor_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("w"), F.lit(1).alias("kind")))


@query(Q.ORACLE_SQL["imu_per_scan"])
def stream_assign(spark, sf):
    """Samples summed into the next scan of their sensor; scans without samples left out."""
    src, folder = _stream(_events(spark, sf), "ts")
    out = FL.drain(FL.assign_stream(src), f"{folder}/out")
    return out.filter("samples > 0").select("sensor_id", "scan_key", "samples", "w_sum")


_CLOCKED = Q.ORACLE_SQL["imu_rotation"]


@query(_CLOCKED)
def stream_rotation(spark, sf):
    """The rotation of each scan's samples."""
    e = _events(spark, sf).select("event_id", "sensor_id", "ts", "kind", (F.col("w") / 1e9).alias("wx"), F.lit(0.0).alias("wy"), (F.col("w") / 2e9).alias("wz"))
    src, folder = _stream(e, "ts")
    out = FL.drain(FL.rotation_stream(src), f"{folder}/out")
    some = A.imu(spark, sf).select("sensor_id", F.col("ts").cast("timestamp").alias("ts"))
    from stratavox.operators import timeseries as TS

    assigned = TS.assign_to_next(some, A.scans(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), by=("sensor_id",)).filter("scan_key is not null").select("sensor_id", "scan_key").distinct()
    return Q._entries(out.join(assigned, ["sensor_id", "scan_key"], "left_semi"), "rotation", Q._NINE, "sensor_id", "scan_key")


@query(Q.ORACLE_SQL["distance_gate"])
def stream_gate(spark, sf):
    """T6, F16."""
    src, folder = _stream(_stamped_poses(spark, sf), "ts")
    return FL.drain(FL.gate_stream(src, 60000.0), f"{folder}/out").select("session", "seq", "tx", "ty", "tz")


def _stamped_poses(spark, sf) -> DataFrame:
    return A.poses(spark, sf).withColumn("ts", F.timestamp_seconds("seq"))


@query(
    f"WITH {S.POSES}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS up, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS down FROM poses) "
    "SELECT 'oldest' AS kept, session, seq FROM r WHERE up <= 3 UNION ALL SELECT 'newest', session, seq FROM r WHERE down <= 3 UNION ALL SELECT 'latest', session, seq FROM r WHERE down = 1 "
    "UNION ALL SELECT 'taken', session, seq FROM r"
)
def stream_queues(spark, sf):
    """Queues of each session over all micro-batches, drained at the end: three places that drop the newest or push out the
    oldest, one place for the latest, and one place whose reader takes every pose as it comes."""
    poses = _stamped_poses(spark, sf).select("session", "seq", "ts")
    kinds = {"oldest": (3, False), "newest": (3, True), "latest": (1, True), "taken": (1, False)}
    queues = F.explode(F.array(*[F.struct(F.lit(k).alias("kept"), F.lit(c).alias("capacity"), F.lit(f).alias("force")) for k, (c, f) in kinds.items()]))
    name = F.concat_ws(":", "q.kept", "session").alias("queue")
    pushes = poses.select("session", "seq", "ts", queues.alias("q")).select(name, "ts", F.lit("push").alias("act"), F.col("seq").alias("item"), "q.capacity", "q.force", "q.kept")
    pops = pushes.filter("kept = 'taken'").withColumns({"act": F.lit("pop_all_if"), "ts": F.col("ts") + F.expr("INTERVAL 1 MILLISECOND")})
    ends = pushes.groupBy("queue").agg(F.max("ts").alias("ts")).select("queue", (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.lit("drain").alias("act"), F.lit(0).cast("bigint").alias("item"), F.lit(1).alias("capacity"), F.lit(False).alias("force"))
    src, folder = _stream(pushes.unionByName(pops).drop("kept").unionByName(ends), "ts")
    out = FL.drain(FL.queue_stream(src), f"{folder}/out")
    parts = F.split("queue", ":")
    return out.select(parts[0].alias("kept"), parts[1].cast("bigint").alias("session"), F.col("item").alias("seq"))


@query(Q.ORACLE_SQL["tsdf_upsert"])
def stream_map(spark, sf):
    """Points stream into the map at a path, even scans in the first micro-batch and odd ones in the second."""
    folder, number = _folder(spark), itertools.count()
    points = A.points(spark, sf, Q.PER_TASK)

    def cut(df: DataFrame) -> DataFrame:
        path = f"{folder}/cut-{next(number)}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    write = FL.map_writer(f"{folder}/map", Q.RES, Q.TAU, 640, Q.WINDOW, Q.FAN, stage=cut)
    for k in (0, 1):  # files that come while the stream rests are the next micro-batch, however many they are
        points.filter(F.col("scan_id") % 2 == k).write.mode("append").parquet(f"{folder}/in")
        src = FL.read_stream(spark, f"{folder}/in", points.schema, files_per_trigger=(1 << 31) - 1)
        src.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return MS.read_map(spark, f"{folder}/map")
