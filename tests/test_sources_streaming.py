"""Cloud files and messages, streams against batch results."""

import datetime as dt
import pickle
import random
import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox.operators import filters as FI
from stratavox.operators import timeseries as TS
from stratavox.operators.mapstore import read_map
from stratavox.operators.tsdf import merge_nearest, ray_march
from stratavox.schemas import RAW_CLOUD
from stratavox.sources import clouds as CL
from stratavox.sources import publish as PB
from stratavox.streaming import flows as FL

CLOUD = "scan_id bigint, idx bigint, x float, y float, z float, intensity float"


def test_pcd_and_ply_round_trip(spark, tmp_path):
    rows = [(s, i, float(i) / 4, -float(i), float(s), 1.5) for s in range(2) for i in range(5)]
    c = spark.createDataFrame(rows, CLOUD)
    folder = str(tmp_path / "clouds")
    CL.write_files(CL.encode_files(c), folder)
    with pytest.raises(FileExistsError):
        CL.write_files(CL.encode_files(c), folder)
    back = CL.read_pcd(spark, folder + "/*.pcd").collect()
    assert sorted((r.path[-9:], r.idx, r.x, r.y, r.z, r.intensity) for r in back) == sorted((f"{s:05d}.pcd", i, x, y, z, w) for s, i, x, y, z, w in rows)
    CL.register_sources(spark)
    assert spark.read.format("pcd").option("path", folder + "/*.pcd").load().count() == 10
    ply = CL.encode_files(c, "ply").orderBy("name").first()
    assert ply["name"] == "00000.ply" and CL.ply_header_count(ply["content"]) == 5
    assert np.allclose(CL.ply_floats(ply["content"])[:, 0], np.arange(5) / 4)


def test_ascii_pcd(tmp_path):
    text = "# c\nVERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 2\nDATA ascii\n1 2 3\n4 5 6\n"
    assert CL.parse_pcd(text.encode())["y"].tolist() == [2, 5]
    assert CL.parse_pcd(CL.format_pcd({"x": np.zeros(0)}))["x"].tolist() == []


def test_message_decoding_by_offset(spark):
    grid = np.arange(24, dtype=float).reshape(6, 4)
    row = CL.encode_message(grid, 2, 3, "lidar", dt.datetime(2024, 1, 1))
    shuffled = list(row)
    shuffled[7] = [("z", 8, 7, 1), ("x", 0, 7, 1), ("y", 4, 7, 1)]
    got = CL.decode_messages(spark.createDataFrame([row, tuple(shuffled)], RAW_CLOUD)).collect()
    assert [(r.ring, r.col, r.x, r.y, r.z) for r in got[:6]] == [(i // 3, i % 3, *grid[i, :3]) for i in range(6)]
    assert got[0].intensity == 3.0 and got[6].intensity == 0.0 and got[7].z == 6.0


def test_colours_and_tensors(spark):
    c = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 7.0), (0, 1, 4.0, 5.0, 6.0, 8.0)], CLOUD)
    t = CL.to_tensors(c, "scan_id", "idx", ("intensity",)).first()
    assert t.positions == [[1, 2, 3], [4, 5, 6]] and t.intensity == [7, 8]
    p = spark.createDataFrame([(250, 3, 77)], "r int, g int, b int").select(CL.pack_rgb("r", "g", "b").alias("rgb"))
    assert tuple(p.select(*CL.unpack_rgb("rgb")).first()) == (250, 3, 77)


def test_window_edges_and_path(spark):
    e = PB.window_edges(spark, (0, 0, 0), (3, 5, 7), 10).collect()
    assert len(e) == 12 and all(sum(r[f"{a}0"] != r[f"{a}1"] for a in "xyz") == 1 for r in e)
    p = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(4)], "session bigint, seq bigint, tx double, ty double, tz double")
    assert [len(r.path) for r in PB.path_of(p, last=3).orderBy("seq").collect()] == [1, 2, 3, 3]


def test_compressed_pcd_by_hand_and_back():
    # "abc", six bytes from three before (a copy that runs into itself), "x", twenty from one before
    golden = bytes([2]) + b"abc" + bytes([4 << 5, 2]) + bytes([0]) + b"x" + bytes([7 << 5, 11, 0])
    assert CL.lzf_decode(golden, 30) == b"abcabcabc" + b"x" * 21
    far = bytes(range(32)) * 20
    assert CL.lzf_decode(b"".join(bytes([31]) + far[k : k + 32] for k in range(0, 640, 32)) + bytes([(1 << 5) | (600 >> 8), 600 & 255]), 643) == far + far[640 - 601 : 640 - 598]
    for bad, size in ((bytes([0]) + b"a", 2), (bytes([2 << 5, 5]), 4)):
        with pytest.raises(ValueError):
            CL.lzf_decode(bad, size)
    rng = random.Random(5)
    for n in (0, 1, 7, 33, 300, 5000):
        raw = b"".join(bytes([rng.randrange(256)]) * rng.choice([1, 1, 2, 8, 9, 300, 1000]) for _ in range(n))[: 4 * n]
        assert CL.lzf_decode(CL.lzf_encode(raw), len(raw)) == raw
    head = "VERSION 0.7\nFIELDS x n rgb\nSIZE 4 2 1\nTYPE F U U\nCOUNT 1 1 3\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary_compressed\n"
    raw = np.array([1.5, -2.0], "<f4").tobytes() + np.array([7, 65535], "<u2").tobytes() + bytes([1, 2, 3, 4, 5, 6])
    got = CL.parse_pcd(head.encode() + (len(raw) + 1).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + bytes([len(raw) - 1]) + raw)
    assert got["x"].tolist() == [1.5, -2.0] and got["n"].tolist() == [7, 65535] and got["rgb"].tolist() == [[1, 2, 3], [4, 5, 6]]
    fields = {c: np.arange(50, dtype=np.float32) // 20 for c in ("x", "y", "z")}
    back = CL.parse_pcd(CL.format_pcd(fields, compressed=True))
    assert all((back[c] == v).all() for c, v in fields.items())


def test_scans_of_six_digits_keep_their_files(spark, tmp_path):
    rows = [(s, i, float(i), 0.0, float(s), 1.0) for s in (7, 123456, 123457, 10_000_000) for i in range(5)]
    folder = str(tmp_path / "clouds")
    CL.write_files(CL.encode_files(spark.createDataFrame(rows, CLOUD)), folder)
    back = CL.read_pcd(spark, folder + "/*.pcd").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.idx) for r in back) == sorted((f"{s:05d}.pcd", i) for s, i, *_ in rows)
    twice = spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary")
    with pytest.raises(ValueError, match="repeat"):
        CL.write_files(twice, str(tmp_path / "twice"))


def samples(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(seconds=i), i * 7 % 50, int(i % 5 == 0)) for i in range(60)]
    return spark.createDataFrame(rows, "event_id bigint, sensor_id bigint, ts timestamp, w bigint, kind int")


def live(spark, folder, rows, parts, ts="ts", delay="365 days", last=None, mixed=None):
    """rows in `parts` files, dealt by `mixed` (at random by default), read one a trigger; a beat at the end moves the clock past them."""
    mixed = F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) if mixed is None else mixed
    for k in range(parts):
        rows.filter(mixed == k).coalesce(1).orderBy(F.xxhash64(*rows.columns, F.lit(7))).write.mode("append").parquet(f"{folder}/in")
    FL.write_beat(spark, f"{folder}/in", rows.schema, ts, last or dt.datetime(2099, 1, 1))
    return FL.read_stream(spark, f"{folder}/in", rows.schema, ts, delay)


@pytest.mark.parametrize("parts", [1, 5])
def test_stream_smoothing_of_shuffled_files_equals_batch(spark, tmp_path, parts):
    s = samples(spark)
    got = FL.drain(FL.smooth_stream(live(spark, tmp_path, s, parts), 4), str(tmp_path / "out")).collect()
    want = TS.sliding_mean(s, "w", 4, ("sensor_id",), ("ts",)).collect()
    assert sorted((r.sensor_id, r.ts, round(r.smooth, 9)) for r in got) == sorted((r.sensor_id, r.ts, round(r.smooth, 9)) for r in want)


def test_stream_assignment_of_shuffled_files_equals_batch(spark, tmp_path):
    s = samples(spark)
    got = FL.drain(FL.assign_stream(live(spark, tmp_path, s, 4)), str(tmp_path / "out")).collect()
    imu, scans = s.filter("kind = 0"), s.filter("kind = 1").select(F.col("event_id").alias("scan_key"), "sensor_id", "ts")
    want = TS.assign_to_next(imu, scans, by=("sensor_id",)).filter("scan_key is not null").groupBy("sensor_id", "scan_key").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    assert sorted((r.sensor_id, r.scan_key, r.w_sum, r.samples) for r in got if r.samples) == sorted((r.sensor_id, r.scan_key, r.w, r.n) for r in want.collect())


def test_a_slot_of_many_keys_makes_one_frame():
    held = {"waiting": [], "carry": None}
    parts = SimpleNamespace(appendValue=held["waiting"].append, get=lambda: iter(list(held["waiting"])), put=lambda v: held["waiting"].__setitem__(slice(None), v), clear=held["waiting"].clear)
    carry = SimpleNamespace(get=lambda: held["carry"], update=lambda v: held.update(carry=v))
    handle = SimpleNamespace(getListState=lambda *_: parts, getValueState=lambda *_: carry, registerTimer=lambda at: None)

    def fold(k, had, rows):
        assert all(type(v) is list for v in rows.values())
        return ((had or (0,))[0] + len(rows["n"]),), [(k, n) for n in rows["n"]]

    order = FL.EventOrder(fold, "k", ["n"], ["k", "n"])
    order.init(handle)
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    for shift in (0, 1):
        come = pd.DataFrame({"k": [str(i % 100) for i in range(300)] + [None], "n": [300 - i for i in range(301)], "stamp_us": [5000 + 100_000 * shift] * 301})
        order.handleInputRows(0, iter([come]), clock(0))
    first = list(order.handleExpiredTimer(0, clock(50), None))
    assert len(first) == 1 and first[0].columns.tolist() == ["k", "n"]
    assert all(g["n"].tolist() == sorted(g["n"]) and len(g) == 3 for _, g in first[0].groupby("k"))
    assert sorted(first[0]["n"]) == list(range(1, 301)) and len(list(order.handleExpiredTimer(0, clock(500), None))) == 1
    assert pickle.loads(held["carry"][0]) == {str(k): (6,) for k in range(100)} and not held["waiting"]


def test_a_late_sample_falls_into_the_next_scan(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[(1, 1, at(1), 10, 0), (2, 1, at(5), 0, 1)], [(3, 1, at(30), 7, 0)], [(6, 1, at(31), 1, 0)], [(4, 1, at(4), 100, 0)], [(5, 1, at(60), 0, 1)]]  # event 4 comes when scan 2 is out
    schema = "event_id bigint, sensor_id bigint, ts timestamp, w bigint, kind int, part int"
    rows = spark.createDataFrame([(*r, k) for k, b in enumerate(batches) for r in b], schema)
    stream = live(spark, tmp_path, rows, 5, delay="10 seconds", last=at(1000), mixed=F.col("part"))
    got = FL.drain(FL.assign_stream(stream), str(tmp_path / "out"))
    assert sorted((r.scan_key, r.w_sum, r.samples) for r in got.collect()) == [(2, 10, 1), (5, 108, 3)]


def test_stream_rotation_of_samples_before_each_scan(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, 1, at(0.25 * i), 0, 0.0, 0.0, np.pi) for i in range(1, 8)] + [(90, 1, at(1.25), 1, 0.0, 0.0, 0.0), (91, 1, at(1.75), 1, 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "event_id bigint, sensor_id bigint, ts timestamp, kind int, wx double, wy double, wz double")
    got = {r.scan_key: np.array(r.rotation).reshape(3, 3) for r in FL.drain(FL.rotation_stream(live(spark, tmp_path, d, 3)), str(tmp_path / "out")).collect()}
    half = np.array([[-1, 0, 0], [0, -1, 0], [0, 0, 1]])  # four steps of 45 degrees
    quarter = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert np.allclose(got[90], half, atol=1e-6) and np.allclose(got[91], quarter, atol=1e-6)


def test_stream_gate_of_shuffled_files_equals_batch(spark, tmp_path):
    p = spark.createDataFrame([(i % 2, i, float((i * 13) % 7), 0.0, 0.0) for i in range(40)], "session bigint, seq bigint, tx double, ty double, tz double")
    got = FL.drain(FL.gate_stream(live(spark, tmp_path, p.withColumn("ts", F.timestamp_seconds("seq")), 6), 3.0), str(tmp_path / "out")).collect()
    assert sorted((r.session, r.seq) for r in got) == sorted((r.session, r.seq) for r in FI.distance_gate(p, 3.0).collect())


def test_stream_stops_and_goes_on_from_its_state(spark, tmp_path):
    s = samples(spark)
    first, then = (s.filter(c) for c in ("event_id < 30", "event_id >= 30"))
    for k, part in enumerate((first, then)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k:
            FL.write_beat(spark, str(tmp_path / "in"), s.schema, "ts", dt.datetime(2099, 1, 1))
        out = FL.drain(FL.smooth_stream(FL.read_stream(spark, str(tmp_path / "in"), s.schema, "ts", "5 seconds"), 4), str(tmp_path / "out"))
    want = TS.sliding_mean(s, "w", 4, ("sensor_id",), ("ts",)).collect()
    assert sorted((r.sensor_id, r.ts, round(r.smooth, 9)) for r in out.collect()) == sorted((r.sensor_id, r.ts, round(r.smooth, 9)) for r in want)


def test_stream_queues_against_plain_queues(spark, tmp_path):
    rng = random.Random(4)
    acts = ["push"] * 6 + ["pop", "pop_if", "pop_all_if", "peek", "drain", "clear"]
    kinds = {"a": (3, False), "b": (3, True), "c": (1, True), "d": (1, False)}
    start = dt.datetime(2024, 1, 1)
    rows = [(q, start + dt.timedelta(seconds=i), rng.choice(acts), i if rng.random() < 0.7 else i // 2, *kinds[q]) for i in range(120) for q in kinds]
    d = spark.createDataFrame(rows, "queue string, ts timestamp, act string, item bigint, capacity int, force boolean")
    got = [(r.queue, r.item, r["at"]) for r in FL.drain(FL.queue_stream(live(spark, tmp_path, d, 4)), str(tmp_path / "out")).collect()]
    want, held = [], {q: [] for q in kinds}
    for q, ts, act, item, capacity, force in rows:
        h, us = held[q], int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        if act == "push":
            if len(h) == capacity and force:
                h.pop(0)
            if len(h) < capacity:
                h.append(item)
        elif act == "pop" and h or act == "pop_if" and h and h[0] <= item:
            want.append((q, h.pop(0), us))
        elif act == "peek" and h:
            want.append((q, h[0], us))
        elif act in ("drain", "pop_all_if"):
            while h and (act == "drain" or h[0] <= item):
                want.append((q, h.pop(0), us))
        elif act == "clear":
            h.clear()
    assert sorted(got) == sorted(want) and want


def test_stream_map_upsert(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(s, i, *map(int, rng.integers(-4000, 4000, 3))) for s in range(2) for i in range(30)]
    p = spark.createDataFrame(rows, "scan_id bigint, idx bigint, x bigint, y bigint, z bigint")
    for s in range(2):
        p.filter(F.col("scan_id") == s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = FL.read_stream(spark, str(tmp_path / "in"), p.schema)
    path, win = str(tmp_path / "map"), ((0, 0, 0), (21, 21, 21))
    q = live.writeStream.foreachBatch(FL.map_writer(path, 400, 900, 640, win)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = read_map(spark, path)
    once = merge_nearest(ray_march(p, 400, 900, window=win))
    key = ["ix", "iy", "iz"]
    assert got.select(key).subtract(once.select(key)).isEmpty() and once.select(key).subtract(got.select(key)).isEmpty()
    assert got.count() == got.select(key).distinct().count() and got.agg(F.max("weight")).first()[0] <= 640


def test_stream_map_deals_points_not_cells_by_scan(spark, tmp_path):
    rows = [(s, i, 700 * i - 3000, 300 * s - 500, 100 * i) for s in range(4) for i in range(10)]
    p = spark.createDataFrame(rows, "scan_id bigint, idx bigint, x bigint, y bigint, z bigint").repartition(3)
    plans = []

    def stage(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    FL.map_writer(str(tmp_path / "map"), 400, 900, 640, ((0, 0, 0), (21, 21, 21)), stage=stage)(p, 0)
    by = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plans[0])
    assert any(k.startswith("ix#") for k in by)
    assert not any("scan_id#" in k and "ix#" in k for k in by)  # scans with their cells were shuffled
    once = merge_nearest(ray_march(p, 400, 900, window=((0, 0, 0), (21, 21, 21))))
    assert sorted(map(tuple, read_map(spark, str(tmp_path / "map")).select(once.columns).collect())) == sorted(map(tuple, once.collect()))


def test_latest_of_a_batch(spark):
    assert {(r.sensor_id, r.event_id) for r in FL.latest_per_key(samples(spark), "sensor_id", "ts").collect()} == {(0, 57), (1, 58), (2, 59)}
