"""Point-cloud files and messages: PCD read and write (S4, S5), PLY write, message codec (S1, S3), conversions.

`register_sources(spark)` adds the format "pcd": one partition per file, path and idx columns beside the file's own fields.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.text import padded_name

#: Message datatypes (fixed values of the public point-cloud message): code to NumPy type.
DATATYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
SIZES = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4"}
CLOUD = "x float, y float, z float, intensity float"


def lzf_decode(data: bytes, size: int) -> bytes:
    """What LZF data stands for: runs of up to 32 bytes as they are, and copies of what came up to 8192 bytes before."""
    out, at = bytearray(), 0
    while at < len(data):
        code = data[at]
        at += 1
        if code < 32:
            out += data[at : at + code + 1]
            at += code + 1
            continue
        n = code >> 5
        if n == 7:
            n += data[at]
            at += 1
        n += 2
        start = len(out) - ((code & 31) << 8 | data[at]) - 1
        at += 1
        if start < 0:
            raise ValueError("LZF data refers to what is before its start")
        piece = out[start : start + n]
        out += (piece * (n // len(piece) + 1))[:n]  # a copy may run into itself
    if len(out) != size:
        raise ValueError(f"LZF data stands for {len(out)} bytes, not {size}")
    return bytes(out)


def lzf_encode(data: bytes) -> bytes:
    """LZF data: bytes as they are, but for runs of one byte, which are copies of the byte before."""
    out, at = bytearray(), 0
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(np.concatenate([raw[1:] != raw[:-1], [True]])) + 1 if len(raw) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends

    def plain(to: int) -> None:
        nonlocal at
        while at < to:
            n = min(32, to - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - start < 8:
            continue
        plain(start + 1)
        while end - at >= 3:
            n = min(264, end - at)
            out.extend([(n - 2) << 5, 0] if n < 9 else [7 << 5, n - 9, 0])
            at += n
    plain(len(data))
    return bytes(out)


def parse_pcd(data: bytes) -> dict[str, np.ndarray]:
    """Fields of a PCD file in ascii, binary or binary_compressed form; the last holds each field's values of all points together."""
    head: dict[str, list[str]] = {}
    at = 0
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if line and not line.startswith("#"):
            key, *rest = line.split()
            head[key] = rest
            if key == "DATA":
                break
    names, n = head["FIELDS"], int(head["POINTS"][0])
    kinds = [SIZES[t, int(s)] for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    if head["DATA"][0] == "ascii":
        rows = [r.split() for r in data[at:].decode("ascii").split("\n") if r.strip()][:n]
        place = np.cumsum([0, *counts])
        return {f: np.array([r[p] for r in rows], dtype=float).astype(k) for f, k, p in zip(names, kinds, place, strict=False)}
    if head["DATA"][0] == "binary_compressed":
        packed, size = struct.unpack_from("<II", data, at)
        raw, out, place = lzf_decode(data[at + 8 : at + 8 + packed], size), {}, 0
        for f, k, c in zip(names, kinds, counts, strict=True):
            v = np.frombuffer(raw, k, n * c, place)
            out[f] = v.reshape(n, c) if c > 1 else v
            place += v.nbytes
        return out
    if head["DATA"][0] != "binary":
        raise ValueError(f"PCD data of kind {head['DATA'][0]} is not supported")
    dt = np.dtype([(f"{f}", k, (c,)) if c > 1 else (f, k) for f, k, c in zip(names, kinds, counts, strict=True)])
    rec = np.frombuffer(data, dt, count=n, offset=at)
    return {f: rec[f] for f in names}


def format_pcd(fields: dict[str, np.ndarray], compressed: bool = False) -> bytes:
    """A binary or binary_compressed PCD file of float32 fields."""
    n = len(next(iter(fields.values()))) if fields else 0
    rec = np.zeros(n, [(f, "<f4") for f in fields])
    for f, v in fields.items():
        rec[f] = v
    k = len(fields)
    data = rec.tobytes()
    if compressed:
        raw = b"".join(np.ascontiguousarray(rec[f]).tobytes() for f in fields)
        packed = lzf_encode(raw)
        data = struct.pack("<II", len(packed), len(raw)) + packed
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(fields)}\nSIZE {' '.join(['4'] * k)}\nTYPE {' '.join(['F'] * k)}\nCOUNT {' '.join(['1'] * k)}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary{'_compressed' if compressed else ''}\n"
    return head.encode() + data


def format_ply(fields: dict[str, np.ndarray]) -> bytes:
    """A binary little-endian PLY file of float32 vertex properties."""
    n = len(next(iter(fields.values()))) if fields else 0
    rec = np.zeros(n, [(f, "<f4") for f in fields])
    for f, v in fields.items():
        rec[f] = v
    props = "".join(f"property float {f}\n" for f in fields)
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{props}end_header\n".encode() + rec.tobytes()


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """Rows path, idx, x, y, z, intensity (0 where the file has none) of all PCD files at the path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                f = parse_pcd(b.column(1)[i].as_py())
                n = len(f["x"])
                cols = [pa.array(np.asarray(f.get(c, np.zeros(n)), np.float32)) for c in ("x", "y", "z", "intensity")]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, pa.string()), pa.array(np.arange(n)), *cols], names=["path", "idx", "x", "y", "z", "intensity"])

    return files.mapInArrow(run, f"path string, idx bigint, {CLOUD}")


def encode_files(cloud: DataFrame, kind: str = "pcd", key: str = "scan_id", order: str = "idx") -> DataFrame:
    """One row per scan: name (five digits) and content; a scan is a bounded group. Kinds: pcd, pcd_compressed, ply."""
    make = {"pcd": format_pcd, "pcd_compressed": lambda f: format_pcd(f, True), "ply": format_ply}[kind]
    key_type = cloud.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        fields = {c: t.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in ("x", "y", "z", "intensity")}
        return pa.table({key: t.column(key).slice(0, 1), "content": pa.array([make(fields)], pa.binary())})

    out = cloud.select(key, order, "x", "y", "z", "intensity").groupBy(key).applyInArrow(run, f"{key} {key_type}, content binary")
    return out.select(key, padded_name(F.col(key), 5, f".{kind[:3]}").alias("name"), "content")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes name and content into a new folder; one that exists is an error.

    Executors write, a file per row, through the file system of the folder's address (local or shared paths, HDFS, object stores).
    A file appears under its name once it is whole, so that a task that runs again does no harm. Names that repeat are an error.
    """
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(folder)
    fs.mkdirs(path)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])
        n = 0
        for b in it:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                part = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py())
                store.move(part, f"{base}/{name.as_py()}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows = files.select("name", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
    made = fs.getContentSummary(path).getFileCount()
    if made < rows:  # attempts that were cut off may leave more
        raise ValueError(f"{rows} rows made {made} files: names repeat")


def decode_messages(messages: DataFrame) -> DataFrame:
    """S3: points of self-describing cloud messages (see schemas.RAW_CLOUD), fields by name and offset; row, ring and col from the grid."""
    keep = messages.select("frame_id", "stamp", "height", "width", "point_step", "row_step", "fields", "data")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for m in b.to_pylist():
                of = {f["name"]: f for f in m["fields"]}
                h, w = m["height"], m["width"]
                n = h * w
                cols = []
                for c in ("x", "y", "z", "intensity"):
                    if c not in of:
                        cols.append(np.zeros(n, np.float32))
                        continue
                    dt = np.dtype(DATATYPES[of[c]["datatype"]])
                    raw = np.ndarray((h, w), dt, m["data"], of[c]["offset"], (m["row_step"], m["point_step"])) if n else np.zeros((0, 0), dt)
                    cols.append(raw.astype(np.float32).ravel())
                at = np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array([m["frame_id"]] * n, pa.string()), pa.array([m["stamp"]] * n, b.schema.field("stamp").type), pa.array((at // max(w, 1)).astype(np.int32)), pa.array((at % max(w, 1)).astype(np.int32)), *[pa.array(c) for c in cols]], names=["frame_id", "stamp", "ring", "col", "x", "y", "z", "intensity"])

    return keep.mapInArrow(run, f"frame_id string, stamp timestamp, ring int, col int, {CLOUD}")


def encode_message(xyzi: np.ndarray, height: int, width: int, frame_id: str, stamp) -> tuple:
    """A row of schemas.RAW_CLOUD from an (n, 4) float array."""
    fields = [(c, 4 * i, 7, 1) for i, c in enumerate(("x", "y", "z", "intensity"))]
    return (stamp, frame_id, height, width, 16, 16 * width, True, fields, np.asarray(xyzi, "<f4").tobytes())


def pack_rgb(r, g, b):
    """A colour as the bits of a float-sized integer."""
    return F.shiftleft(F.col(r).cast("int"), 16).bitwiseOR(F.shiftleft(F.col(g).cast("int"), 8)).bitwiseOR(F.col(b).cast("int"))


def unpack_rgb(rgb):
    c = F.col(rgb)
    return [F.shiftright(c, s).bitwiseAND(F.lit(255)).alias(n) for n, s in (("r", 16), ("g", 8), ("b", 0))]


def to_tensors(cloud: DataFrame, key: str, order: str, custom: tuple[str, ...] = ()) -> DataFrame:
    """One row per scan with positions and each named field as arrays in order."""
    items = F.array_sort(F.collect_list(F.struct(order, "x", "y", "z", *custom)))
    g = cloud.groupBy(key).agg(items.alias("_i"))
    return g.select(key, F.transform("_i", lambda p: F.array(p["x"], p["y"], p["z"])).alias("positions"), *[_field(c) for c in custom])


def _field(name: str):
    return F.transform("_i", lambda p: p[name]).alias(name)


def register_sources(spark: SparkSession) -> None:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class PcdReader(DataSourceReader):
        def __init__(self, paths):
            self.paths = paths

        def partitions(self):
            return [InputPartition(p) for p in self.paths]

        def read(self, partition):
            with open(re.sub("^file://", "", partition.value), "rb") as f:
                fields = parse_pcd(f.read())
            n = len(fields["x"])
            cols = [pa.array(np.asarray(fields.get(c, np.zeros(n)), np.float32)) for c in ("x", "y", "z", "intensity")]
            yield pa.RecordBatch.from_arrays([pa.array([partition.value] * n, pa.string()), pa.array(np.arange(n)), *cols], names=["path", "idx", "x", "y", "z", "intensity"])

    class PcdSource(DataSource):
        """Files that every executor can open by path; for other stores use read_pcd()."""

        @classmethod
        def name(cls):
            return "pcd"

        def schema(self):
            return f"path string, idx bigint, {CLOUD}"

        def reader(self, schema):
            import glob

            return PcdReader(sorted(glob.glob(re.sub("^file://", "", self.options["path"]))))

    spark.dataSource.register(PcdSource)


def ply_header_count(data: bytes) -> int:
    return int(re.search(rb"element vertex (\d+)", data)[1])


def ply_floats(data: bytes) -> np.ndarray:
    head = data.index(b"end_header\n") + 11
    k = len(re.findall(rb"property float", data[:head]))
    return np.array(struct.unpack_from(f"<{ply_header_count(data) * k}f", data, head)).reshape(-1, k)
