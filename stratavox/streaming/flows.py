"""Structured Streaming forms of the engine's operators.

Keyed folds run in event time: rows wait in state until the watermark has passed them, so results do not depend on how rows fall into
files and micro-batches. The voxel map is too large for operator state and is upserted per micro-batch into chunk directories by
foreachBatch. Offsets and triggers replace polling.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from stratavox.operators.mapstore import read_map, write_map
from stratavox.operators.timeseries import euler_matrix
from stratavox.operators.tsdf import merge_nearest, ray_march, upsert


def read_stream(spark: SparkSession, path: str, schema, ts: str | None = None, delay: str = "10 minutes", files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a rate-limited stream; event time is the stamp, with a watermark."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if ts else df


def write_beat(spark: SparkSession, path: str, schema, ts: str, at) -> None:
    """A row without a key, stamped `at`: once it is read, the watermark passes all rows more than the delay before it, and they are released."""
    row = spark.createDataFrame([(None,) * len(schema.fields)], StructType([StructField(f.name, f.dataType) for f in schema.fields]))
    row.withColumn(ts, F.lit(at).cast(schema[ts].dataType)).write.mode("append").parquet(path)


def _to_bytes(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class EventOrder(StatefulProcessor):
    """Rows wait in state until the watermark has passed their stamps (micros), then each key's go through `fold` in event order.

    State is kept per slot, a hash of keys, so that a micro-batch makes a few calls a slot and not some for every key: the waiting rows and the
    carries of the slot's keys. Every batch sets a timer at its first row. `fold(key, carry, rows)`, whose rows are lists by column, gives the
    next carry, a tuple or None, and a list of tuples out; a data frame is made for a slot, not for every key. Rows that come after the watermark has passed them are released at once, after all that went before.
    """

    def __init__(self, fold: Callable, key: str, order: list[str], columns: list[str]):
        self.fold, self.key, self.order, self.columns = fold, key, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "part binary")
        self.carry = handle.getValueState("carry", "by_key binary")

    def _set_timer(self, rows: pd.DataFrame) -> None:
        self.handle.registerTimer(int(rows["stamp_us"].min()) // 1000 + 1)  # the watermark, in whole milliseconds, has then passed the row

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat(list(rows), ignore_index=True)
        come = come[come[self.key].notna()]  # a row without a key is a beat
        if len(come):
            self.waiting.appendValue((_to_bytes(come),))
            self._set_timer(come)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(bytes(part)).read_pandas() for (part,) in self.waiting.get()]
        if not parts:  # another timer of this micro-batch has released them
            return
        rows = pd.concat(parts, ignore_index=True)
        passed = rows["stamp_us"] // 1000 < timerValues.getCurrentWatermarkInMs()
        if not passed.any():
            return
        ready, rest = rows[passed], rows[~passed]
        if len(rest):
            self.waiting.put([(_to_bytes(rest),)])
            self._set_timer(rest)
        else:
            self.waiting.clear()
        held = self.carry.get()
        carries = pickle.loads(bytes(held[0])) if held else {}
        ready = ready.assign(_key=pd.factorize(ready[self.key])[0]).sort_values(["_key", "stamp_us", *self.order], kind="stable")
        number = ready["_key"].to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        columns = {c: ready[c].tolist() for c in ready.columns if c != "_key"}
        out = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            k = columns[self.key][low]
            carries[k], got = self.fold(k, carries.get(k), {c: v[low:high] for c, v in columns.items()})
            out += got
        self.carry.update((pickle.dumps(carries),))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        return


def in_event_order(rows: DataFrame, key: str, ts: str, order: list[str], fold: Callable, out: str, slots: int = 256) -> DataFrame:
    """`fold` over a watermarked stream, each key in order of (ts, *order) whatever order its rows come in.

    The result is that of the whole table read at once, for rows no later than the watermark's delay. Late ones count where they come; rows
    without a key only move the clock. Keys cross as text and stamps as micros (`stamp_us`). State is RocksDB's, which timers need; the session
    keeps that setting. The number of slots may not change while a checkpoint lives; it bounds how many tasks share the keys.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Without the watermarked column Spark's own filter of late rows, which would drop them, has nothing to look at.
    plain = rows.withColumns({"stamp_us": F.unix_micros(ts), key: F.col(key).cast("string"), "slot": F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slots))}).drop(ts)
    wanted = StructType.fromDDL(out)
    texts = StructType([StructField(f.name, StringType() if f.name == key else f.dataType) for f in wanted])
    got = plain.groupBy("slot").transformWithStateInPandas(EventOrder(fold, key, order, wanted.names), texts, "append", "eventTime")
    return got.withColumn(key, F.col(key).cast(wanted[key].dataType))


def smooth_stream(imu: DataFrame, n: int = 10, key: str = "sensor_id", ts: str = "ts", value: str = "w", order: tuple[str, ...] = ()) -> DataFrame:
    """T4: sliding mean per sensor; the carry is the last n values."""

    def fold(k, carry: tuple | None, rows: dict[str, list]):
        held, seen = carry or ([], 0)
        held, out = list(held), []
        for v, us in zip(rows[value], rows["stamp_us"], strict=True):
            held = [*held, float(v)][-n:]
            seen += 1
            out.append((k, us, float(v) if seen <= n else sum(held) / n))
        return (held, seen), out

    kt = imu.schema[key].dataType.simpleString()
    got = in_event_order(imu.select(key, ts, value, *order), key, ts, list(order), fold, f"{key} {kt}, stamp_us bigint, smooth double")
    return got.select(key, F.timestamp_micros("stamp_us").alias(ts), "smooth")


def assign_stream(events: DataFrame, key: str = "sensor_id", ts: str = "ts") -> DataFrame:
    """Samples (kind 0, columns event_id, w) summed into the next scan (kind 1) of their sensor, a row per scan.

    The carry is a sum and a count. A sample that comes after its scan was released goes to the next scan.
    """

    def fold(k, carry: tuple | None, rows: dict[str, list]):
        total, n = carry or (0, 0)
        out = []
        for kind, eid, w in zip(rows["kind"], rows["event_id"], rows["w"], strict=True):
            if kind == 0:
                total, n = total + int(w), n + 1
            else:
                out.append((k, int(eid), total, n))
                total, n = 0, 0
        return (total, n), out

    kt = events.schema[key].dataType.simpleString()
    return in_event_order(events.select(key, ts, "kind", "event_id", "w"), key, ts, ["kind", "event_id"], fold, f"{key} {kt}, scan_key bigint, w_sum bigint, samples bigint")


def rotation_stream(events: DataFrame, key: str = "sensor_id", ts: str = "ts") -> DataFrame:
    """The rotation of a sensor since its last scan, a row per scan (kind 1), from rates wx, wy, wz of samples (kind 0).

    The carry is the clock and the product so far, nine numbers. The first sample only sets the clock; a sample that comes after its
    scan was released counts for the next one. A scan without samples has the identity.
    """

    def fold(k, carry: tuple | None, rows: dict[str, list]):
        clock, rot = carry or (None, None)
        rot = np.eye(3) if rot is None else np.array(rot, float).reshape(3, 3)
        out = []
        for t, kind, eid, w in zip(rows["stamp_us"], rows["kind"], rows["event_id"], zip(rows["wx"], rows["wy"], rows["wz"], strict=True), strict=True):
            if kind == 0:
                if clock is not None:
                    rot = euler_matrix(np.array(w, float) * (abs(t - clock) / 1e6)) @ rot
                clock = int(t)
            else:
                out.append((k, int(eid), rot.ravel().tolist()))
                rot = np.eye(3)
        return (clock, rot.ravel().tolist()), out

    kt = events.schema[key].dataType.simpleString()
    return in_event_order(events.select(key, ts, "kind", "event_id", "wx", "wy", "wz"), key, ts, ["kind", "event_id"], fold, f"{key} {kt}, scan_key bigint, rotation array<double>")


def gate_stream(poses: DataFrame, limit: float, key: str = "session", ts: str = "ts", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Poses at least `limit` from the last kept one of their session; the carry is that pose."""
    kept = [c for c in poses.columns if c != ts]

    def fold(k, carry: tuple | None, rows: dict[str, list]):
        last, keep = carry, []
        for row, us, *p in zip(zip(*[rows[c] for c in kept], strict=True), rows["stamp_us"], rows["tx"], rows["ty"], rows["tz"], strict=True):
            p = tuple(map(float, p))
            if last is None or sum((a - b) ** 2 for a, b in zip(p, last, strict=True)) >= limit * limit:
                last = p
                keep.append((*row, us))
        return last, keep

    types = ", ".join(f"{c} {poses.schema[c].dataType.simpleString()}" for c in kept)
    got = in_event_order(poses, key, ts, list(order), fold, f"{types}, stamp_us bigint")
    return got.select(*kept, F.timestamp_micros("stamp_us").alias(ts))


def queue_stream(events: DataFrame, key: str = "queue", ts: str = "ts", order: tuple[str, ...] = ("item",)) -> DataFrame:
    """Bounded queues in event time, one a key; rows (key, item, at) leave in the order they are taken.

    Columns of events: act, item (bigint), capacity, force. "push" adds item at the end; a full queue drops it, or with force loses its
    oldest instead. "pop" takes the oldest, "pop_if" only if its item is at most the event's, "pop_all_if" all such from the front (a scan
    taking the samples before it), "peek" shows the oldest, "drain" takes all, "clear" drops all. An empty queue gives nothing, as a pop that
    does not wait. The carry is the queue, at most `capacity` items.
    """

    def fold(k, carry: tuple | None, rows: dict[str, list]):
        held, out = list(carry[0]) if carry else [], []
        for us, act, item, capacity, force in zip(rows["stamp_us"], rows["act"], rows["item"], rows["capacity"], rows["force"], strict=True):
            if act == "push":
                if len(held) >= capacity and force:
                    held = held[1 - int(capacity) :] if capacity > 1 else []
                if len(held) < capacity:
                    held.append(int(item))
                continue
            n = {"pop": 1, "peek": 1, "pop_if": int(bool(held) and held[0] <= item), "drain": len(held)}.get(act, 0)
            if act == "pop_all_if":
                n = next((i for i, h in enumerate(held) if h > item), len(held))
            out += [(k, h, us) for h in held[:n]]
            held = [] if act == "clear" else held if act == "peek" else held[n:]
        return (held,), out

    kt = events.schema[key].dataType.simpleString()
    return in_event_order(events.select(key, ts, "act", "item", "capacity", "force"), key, ts, list(order), fold, f"{key} {kt}, item bigint, at bigint")


def latest_per_key(batch: DataFrame, key: str, ts: str) -> DataFrame:
    """What a one-place queue would hold of a micro-batch: the newest row of each key."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def bounded_queue(batch: DataFrame, capacity: int, key: str, order: list[str], force: bool = False) -> DataFrame:
    """What a queue of `capacity` places per key would hold of a micro-batch that nothing drains: the first rows, as newer ones
    are dropped, or with force the last, as they push the oldest out."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() if force else F.col(c) for c in order])
    return batch.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= capacity).drop("_place")


def map_writer(path: str, res: int, tau: int, max_weight: int, window: tuple | None = None, dz_per_distance: int | None = None, stage: Callable[[DataFrame], DataFrame] | None = None, per_task: int = 150_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that integrates a micro-batch of points into the map at path.

    Points are dealt by scan, about `per_task` to a task, before they are marched, so that the merge within scans needs no shuffle of cells. Only the chunks that the batch touches are read and rewritten, by dynamic partition overwrite. `stage` cuts the lineage before
    the overwrite of what was read; by default the merged cells go through a reliable checkpoint.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.repartition(max(spark.sparkContext.defaultParallelism, -(-batch.count() // per_task)), "scan_id")
        cells = merge_nearest(ray_march(batch, res, tau, window=window, dz_per_distance=dz_per_distance))
        cells = stage(cells) if stage else cells.checkpoint()
        if cells.isEmpty():
            return
        jp = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp):
            touched = cells.select(*[F.floor(F.col(f"i{a}") / 64).cast("bigint").alias(f"c{a}") for a in "xyz"]).distinct()
            old = read_map(spark, path).withColumns({f"c{a}": F.floor(F.col(f"i{a}") / 64).cast("bigint") for a in "xyz"})
            old = old.join(touched, ["cx", "cy", "cz"], "left_semi").drop("cx", "cy", "cz")
        else:
            old = spark.createDataFrame([], cells.schema)
        merged = upsert(old, cells, max_weight)
        merged = stage(merged) if stage else merged.checkpoint()
        write_map(merged, path, "upsert")

    return write


def drain(df: DataFrame, folder: str) -> DataFrame:
    """Works off what is available into a new folder of Parquet files, exactly once each, and stops. Rows stay distributed."""
    q = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def run_to_end(df: DataFrame, checkpoint: str, name: str, mode: str = "append") -> DataFrame:
    """Drains what is available into a memory table and stops."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
