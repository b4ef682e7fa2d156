"""Time alignment and folds: interval assignment (J8, J9), smoothing (W6), queues by key (J10), pose folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.linalg import euler_rotation, identity, inverse_rigid4, matmul, np_quat_of, quat_mul


def assign_to_next(samples: DataFrame, scans: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), scan_cols: tuple[str, ...] = ("scan_key",)) -> DataFrame:
    """Each sample with the first scan whose stamp is not before it (null where none follows). One pass over the ordered union per key."""
    s = samples.withColumn("_scan", F.lit(None).cast("struct<" + ",".join(f"{c}:{scans.schema[c].dataType.simpleString()}" for c in (ts, *scan_cols)) + ">")).withColumn("_kind", F.lit(0))
    m = scans.select(*by, ts, *[F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in samples.columns if c not in (*by, ts)], F.struct(ts, *scan_cols).alias("_scan"), F.lit(1).alias("_kind"))
    w = Window.partitionBy(*by).orderBy(ts, "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = s.unionByName(m).withColumn("_to", F.first("_scan", ignorenulls=True).over(w)).filter("_kind = 0")
    return df.select(*samples.columns, F.col(f"_to.{ts}").alias("scan_ts"), *[F.col(f"_to.{c}").alias(c) for c in scan_cols])


def following_sample(scans: DataFrame, samples: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), skip: int = 0, sample_cols: tuple[str, ...] = ("sample_key",)) -> DataFrame:
    """Each scan with a sample after it: the first (skip 0), or the next one after that (skip 1, as one pipeline codes it)."""
    s = samples.select(*by, F.col(ts).alias("_sample_ts"), *sample_cols)
    w = Window.partitionBy(*by).orderBy("_sample_ts", *sample_cols)
    nxt = s.withColumn("_then", F.lead(F.struct("_sample_ts", *sample_cols), skip).over(w)) if skip else s.withColumn("_then", F.struct("_sample_ts", *sample_cols))
    marks = nxt.select(*by, F.col("_sample_ts").alias(ts), "_then", F.lit(1).alias("_kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in scans.schema.fields if f.name not in (*by, ts)])
    mine = scans.withColumn("_then", F.lit(None).cast(marks.schema["_then"].dataType)).withColumn("_kind", F.lit(2))
    over = Window.partitionBy(*by).orderBy(F.col(ts), F.col("_kind")).rowsBetween(1, Window.unboundedFollowing)
    first = F.first(F.when(F.col("_kind") == 1, F.struct(F.col("_then").alias("t"))), ignorenulls=True).over(over)
    df = mine.unionByName(marks).withColumn("_hit", first).filter("_kind = 2")
    return df.select(*scans.columns, F.col("_hit.t._sample_ts").alias("sample_ts"), *[F.col(f"_hit.t.{c}").alias(c) for c in sample_cols])


def sliding_mean(df: DataFrame, col: str, n: int, by: tuple[str, ...], order: tuple[str, ...], out: str = "smooth") -> DataFrame:
    """The raw value for the first n rows, then the mean of the last n."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.when(F.row_number().over(w) <= n, F.col(col).cast("double")).otherwise(F.avg(col).over(w.rowsBetween(-(n - 1), 0))))


def running_mean(df: DataFrame, col: str, by: tuple[str, ...], order: tuple[str, ...], out: str = "mean") -> DataFrame:
    """W10."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({out: F.avg(col).over(w)})


def pair_queues(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """What parallel queues pair by arrival is joined by its key."""
    return left.join(right, key)


def last_scans(scans: DataFrame, k: int, by: tuple[str, ...] = ("session",), seq: str = "seq") -> DataFrame:
    """(by, seq, source): the up to k accepted scans before each scan, whose points are added to it."""
    w = Window.partitionBy(*by).orderBy(seq)
    past = F.array(*[F.lag(seq, i).over(w) for i in range(1, k + 1)])
    return scans.select(*by, seq, past.alias("_past")).select(*by, seq, F.explode(F.filter("_past", lambda x: x.isNotNull())).alias("source"))


def pose_deltas(poses: DataFrame, by: tuple[str, ...] = ("session",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Translation difference to the previous pose of a session, zero for the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return poses.withColumns({f"d{a}": F.col(f"t{a}") - F.coalesce(F.lag(f"t{a}").over(w), F.col(f"t{a}")) for a in "xyz"})


def rotation_deltas(poses: DataFrame, by: tuple[str, ...] = ("session",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Translation difference and rotation difference (unit quaternion dqx..dqw, current times inverse of the last) to the
    previous pose of a session, from qx..qw; nothing and the identity for the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = [F.coalesce(F.lag(f"q{a}").over(w), F.col(f"q{a}")) for a in "xyzw"]
    df = pose_deltas(poses, by, order).select("*", *[c.alias(f"_l{a}") for c, a in zip(last, "xyzw", strict=True)])
    inverse = [*[-F.col(f"_l{a}") for a in "xyz"], F.col("_lw")]
    delta = quat_mul([F.col(f"q{a}") for a in "xyzw"], inverse)
    return df.select(*poses.columns, "dx", "dy", "dz", *[c.alias(f"dq{a}") for c, a in zip(delta, "xyzw", strict=True)])


def moved_pose(pose: Column, turn: Column, shift: Column, before: bool = False) -> Column:
    """A 4x4 pose turned by a 3x3 rotation on its right (its rotation part only), or with before on its left, then shifted on its left."""
    rot = [[turn[3 * i + k] for k in range(3)] for i in range(3)]
    cell = lambda i, k: pose[4 * i + k]
    if before:
        out = [[sum((rot[i][m] * cell(m, k) for m in (1, 2)), rot[i][0] * cell(0, k)) for k in range(4)] for i in range(3)]
    else:
        out = [[*[sum((cell(i, m) * rot[m][k] for m in (1, 2)), cell(i, 0) * rot[0][k]) for k in range(3)], cell(i, 3)] for i in range(3)]
    rows = [c if k < 3 else c + shift[i] for i in range(3) for k, c in enumerate(out[i])]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def euler_matrix(w: np.ndarray) -> np.ndarray:
    """E28 for one sample: Rx Ry Rz."""
    (cx, cy, cz), (sx, sy, sz) = np.cos(w), np.sin(w)
    return np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1.0]])


def _euler_product(left: Column, acc: Column) -> Column:
    """Rx Ry Rz of the angles of `left` times acc, a row-major 3x3 array."""
    return matmul(euler_rotation(left["ax"], left["ay"], left["az"]), acc, 3)


def integrate_rotation(imu: DataFrame, sensor: str = "sensor_id", ts: str = "stamp", scan: str = "scan_key") -> DataFrame:
    """Rotation (row-major 3x3) since the previous scan for every (sensor, scan), from samples assigned to scans.

    Rates times the absolute time step, as rotations about x, y, z, are multiplied on the left; a sensor's first sample only sets
    the clock. Samples without a scan are left out. The samples of one scan, a bounded group, are folded as an array.
    """
    df = imu.filter(F.col(scan).isNotNull()).withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy(sensor).orderBy("_s", scan)
    dt = F.coalesce(F.abs(F.col("_s") - F.lag("_s").over(w)) / 1e6, F.lit(0.0))
    df = df.select(sensor, scan, "_s", "wx", "wy", "wz", dt.alias("_dt"))
    angles = F.struct("_s", *[(F.col(f"w{a}") * F.col("_dt")).alias(f"a{a}") for a in "xyz"])
    g = df.groupBy(sensor, scan).agg(F.array_sort(F.collect_list(angles)).alias("_a"))
    return g.select(sensor, scan, F.aggregate("_a", identity(3), lambda acc, x: _euler_product(x, acc)).alias("rotation"))


def prefix_products(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """m[i] @ m[i-1] @ ... @ m[first[i]] for every i, in log2(n) batched products."""
    out, reach, n = m.copy(), np.arange(len(m)), len(m)
    step = 1
    while step < n:
        back = reach - 1  # what is joined next ends here
        on = np.flatnonzero(back >= first)
        if not len(on):
            break
        out[on], reach[on] = out[on] @ out[back[on]], reach[back[on]]
        step *= 2
    return out


def accumulate_poses(steps: DataFrame, by: str = "session", order: str = "seq") -> DataFrame:
    """Rotations multiply on the left, translations only add; columns rotation array<double>(9), tx, ty, tz in, pose columns out.

    Sorted partitions stream through with one rotation and one translation as state; a batch is one run of batched products.
    """
    types = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    schema = f"{by} {types[by]}, {order} {types[order]}, tx double, ty double, tz double, qx double, qy double, qz double, qw double"

    def run(batches):
        last, rot, t = object(), np.eye(3), np.zeros(3)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(0).to_pylist()
            new = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(n)])
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            m = b.column(2).flatten().to_numpy().reshape(n, 3, 3)
            moves = np.stack([b.column(k).to_numpy() for k in (3, 4, 5)], 1)
            rots, sums = prefix_products(m, first), np.cumsum(moves, 0)
            shift = sums - (sums[first] - moves[first])
            if keys[0] == last:  # goes on from the batch before
                head = first == 0
                rots[head], shift[head] = rots[head] @ rot, shift[head] + t
            last, rot, t = keys[-1], rots[-1], shift[-1]
            q = np.array([np_quat_of(r) for r in rots])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(v)) for v in (*shift.T, *q.T)]], names=[by, order, "tx", "ty", "tz", "qx", "qy", "qz", "qw"])

    rows = steps.select(by, order, F.col("rotation").cast("array<double>"), *[F.col(f"t{a}").cast("double").alias(f"t{a}") for a in "xyz"])
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def predict_constant_velocity(poses: DataFrame, by: str = "session", order: str = "seq") -> DataFrame:
    """The next pose if the last motion repeats: now * (last^-1 * now), from rotation (9) and translation; the first repeats itself."""
    r, t = F.col("rotation"), [F.col(f"t{a}").cast("double") for a in "xyz"]
    now = F.array(*[c for i in range(3) for c in (r[3 * i], r[3 * i + 1], r[3 * i + 2], t[i])], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    w = Window.partitionBy(by).orderBy(order)
    df = poses.select(by, order, now.alias("_now"))
    df = df.select(by, order, "_now", F.coalesce(F.lag("_now").over(w), F.col("_now")).alias("_last"))
    df = df.select(by, order, "_now", matmul(inverse_rigid4(F.col("_last")), F.col("_now"), 4).alias("_step"))
    return df.select(by, order, matmul(F.col("_now"), F.col("_step"), 4).alias("next_pose"))
