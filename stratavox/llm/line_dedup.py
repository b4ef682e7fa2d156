"""Line dedup: two Bloom filters, of keys seen once and seen twice, find suspects; only those shuffle, and are counted exactly.

Every task fills its own pair of filters. Pairs merge by bits: what is in the once-filters of two tasks is in the merged
twice-filter, so no repeat is ever missed, and a false suspect costs a row of the exact count and nothing else. The filters grow
with the number of lines up to `max_bits`. Beyond that, the twice-filter is made from counts of 64-bit hashes instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from stratavox.llm.common import bounded_batches, stage

#: Bytes of a filter that travel as one row.
SLICE = 1 << 17
#: A task's counts are handed on when they hold so many keys or bytes of keys.
MOST_KEYS, MOST_BYTES = 500_000, 32 << 20


def line_keys(text: bytes | None) -> list[bytes]:
    """The keys of a text's lines: white space (U+0020, U+0009 to U+000D) stripped at both ends, A-Z lower-cased."""
    return [x.strip().lower() for x in (text or b"").split(b"\n")]


def _distinct_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    found = set(line_keys(text))
    found.discard(b"")
    return found if min_chars <= 1 else {k for k in found if len(k.decode("utf-8", "replace")) >= min_chars}


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


class FilterPair:
    """Bloom filters of 2**n bits, two bits a key, of the keys seen in one document and of those seen in two or more."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h & self.mask, (h >> np.uint64(32)) & self.mask

    def _put(self, into: np.ndarray, h: np.ndarray) -> None:
        if len(h):
            at = np.unique(np.concatenate(self._places(h)))
            byte, first = np.unique(at >> np.uint64(3), return_index=True)
            into[byte] |= np.bitwise_or.reduceat(np.left_shift(1, at & np.uint64(7)).astype(np.uint8), first)

    def _held(self, by: np.ndarray, h: np.ndarray) -> np.ndarray:
        a, b = (by[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 for p in self._places(h))
        return (a & b).astype(bool)

    def add(self, h: np.ndarray) -> None:
        """Hashes of keys, each as often as there are documents that hold it."""
        u, n = np.unique(h, return_counts=True)
        self._put(self.twice, u[(n > 1) | self._held(self.once, u)])
        self._put(self.once, u)

    def suspects(self, h: np.ndarray) -> np.ndarray:
        """Whether a key may be in two documents; true of all that are."""
        return self._held(self.twice, h)

    def slices(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k in range(-(-len(self.once) // SLICE)):
            a, b = self.once[k * SLICE : (k + 1) * SLICE], self.twice[k * SLICE : (k + 1) * SLICE]
            if a.any() or b.any():
                yield k, zlib.compress(a.tobytes(), 1), zlib.compress(b.tobytes(), 1)


def merge_slice(held: list[np.ndarray] | None, once: np.ndarray, twice: np.ndarray) -> list[np.ndarray]:
    """Two tasks' bits of one slice as one; what both saw once is seen twice. Associative and commutative."""
    if held is None:
        return [once.copy(), twice.copy()]
    held[1] |= twice | (held[0] & once)
    held[0] |= once
    return held


_SLICES = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _merged_twice(parts: DataFrame, bits: int) -> np.ndarray:
    """The twice-filter of all tasks: slices merge where they are dealt to, and at most bits / 8 bytes reach the driver."""

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in it:
            for k, once, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[k] = merge_slice(held.get(k), *(np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice)))
        for k, (_, twice) in held.items():
            if twice.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([b""], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], schema=_SLICES)

    out = np.zeros(bits // 8, np.uint8)
    for r in parts.repartition("slice").mapInArrow(merge, "slice int, once binary, twice binary").toLocalIterator():
        got = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(got)] = got
    return out


def _twice_filter(texts: DataFrame, bits: int, bits_needed: int, min_chars: int, min_docs: int) -> np.ndarray:
    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = FilterPair(bits)
        for b in it:
            pair.add(np.concatenate([np.zeros(0, np.uint64), *(_hashes(_distinct_keys(t, min_chars)) for t in b.column(0).to_pylist())]))
        for row in pair.slices():
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _SLICES, strict=True)], schema=_SLICES)

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(_distinct_keys(t, min_chars)) for t in b.column(0).to_pylist())]), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    def often(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = FilterPair(bits)
        for b in it:
            pair._put(pair.twice, np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        for row in pair.slices():
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _SLICES, strict=True)], schema=_SLICES)

    slices = "slice int, once binary, twice binary"
    if bits_needed <= bits:
        return _merged_twice(texts.mapInArrow(pairs, slices), bits)
    many = texts.mapInArrow(counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    return _merged_twice(many.select("hash").mapInArrow(often, slices), bits)


def _suspects(text: bytes | None, pair: FilterPair, min_chars: int) -> dict[bytes, int]:
    """Suspected keys of a text, each with the number of its first line."""
    keys = line_keys(text)
    able = list(_distinct_keys(text, min_chars))
    yes = {k for k, y in zip(able, pair.suspects(_hashes(able)), strict=True) if y}
    first: dict[bytes, int] = {}
    for at, k in enumerate(keys):
        if k in yes:
            first.setdefault(k, at)
    return first


def _place(ident, at: int) -> tuple:
    """Order of places as Spark's: null ids first, then by id and line."""
    return (ident is not None, 0 if ident is None else ident, at)


def _apply(text: bytes | None, gone: list[bool]) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    return len(lines), sum(gone), b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10, keep_first: bool = False,
    bits_per_line: int = 16, max_bits: int = 1 << 29, broadcast_bytes: int = 16 << 20, salts: int = 16,
) -> DataFrame:
    """Per row of docs: id_col, n_lines, n_dropped, kept (the text without its dropped lines).

    Lines are split at \\n; a null or empty text is one empty line. A line is dropped if its key (line_keys) has at least min_chars
    code points and is found in at least min_docs documents. With keep_first, the line at the least place (id, line number) stays.
    Every row is a document, so rows with equal or null ids count separately (null ids come first). Keys are compared as bytes.

    Filters have bits_per_line bits a line, up to max_bits (a power of two), and the twice-filter is broadcast. Repeated keys are
    broadcast if they sum to at most broadcast_bytes; else they are joined, salted, to suspected lines, whose numbers go to the rows.
    """
    text = F.col(text_col).cast("string")
    rows = bounded_batches(docs.select(F.col(id_col).alias("id"), text.alias("text")))
    spark, id_type = rows.sparkSession, rows.schema["id"].dataType
    lines = rows.select(F.sum(1 + F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)))).first()[0] or 0
    needed = 1 << max(16, (lines * bits_per_line - 1).bit_length())
    bits = min(needed, max_bits)
    rows = rows.withColumn("text", F.col("text").cast("binary"))
    twice = spark.sparkContext.broadcast(_twice_filter(rows.select("text"), bits, needed, min_chars, min_docs))

    def pair() -> FilterPair:
        out = FilterPair(8)
        out.mask, out.twice = np.uint64(bits - 1), twice.value
        return out

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, held, size = pair(), {}, 0
        kind = None

        def out() -> pa.RecordBatch:
            n, ids, at = zip(*held.values(), strict=True)
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(at, pa.int64())], names=["key", "n", "id", "line"])

        for b in it:
            kind = b.schema.field(0).type
            for ident, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, at in _suspects(t, probe, min_chars).items():
                    n, i, j = held.get(k, (0, ident, at))
                    size += 0 if n else len(k)
                    first = (ident, at) if keep_first and _place(ident, at) < _place(i, j) else (i, j)
                    held[k] = (n + 1, *first)
                if len(held) >= MOST_KEYS or size >= MOST_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    counted = StructType([StructField("key", BinaryType()), StructField("n", LongType()), StructField("id", id_type), StructField("line", LongType())])
    keys = rows.mapInArrow(count, counted).groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("id", "line")).alias("first"))
    repeated = stage(keys.filter(F.col("n") >= min_docs).select("key", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line")))
    held_bytes = repeated.select(F.sum(F.length("key") + 32)).first()[0] or 0

    def rebuilt(ids: pa.Array, texts: list, gone: list[list[bool]]) -> pa.RecordBatch:
        n, dropped, kept = zip(*(_apply(t, g) for t, g in zip(texts, gone, strict=True)), strict=True)
        return pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_lines", "n_dropped", "kept"])

    result = StructType([StructField("id", id_type), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", BinaryType())])
    if held_bytes <= broadcast_bytes:
        first_of = spark.sparkContext.broadcast({bytes(r["key"]): (r["first_id"], r["first_line"]) if keep_first else None for r in repeated.toLocalIterator()})

        def drop(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = first_of.value
            for b in it:
                if b.num_rows:
                    ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                    gone = [[k in known and known[k] != (i, at) for at, k in enumerate(line_keys(t))] for i, t in zip(ids, texts, strict=True)]
                    yield rebuilt(b.column(0), texts, gone)

        kept = rows.mapInArrow(drop, result)
    else:
        placed = stage(rows.withColumn("row", F.monotonically_increasing_id()))

        def tell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = pair()
            for b in it:
                out: list[tuple] = []
                for i, t, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    able = _suspects(t, probe, min_chars)
                    out += [(k, i, row, at) for at, k in enumerate(line_keys(t)) if k in able]
                k, i, row, at = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.record_batch([pa.array(k, pa.binary()), pa.array(i, b.schema.field(0).type), pa.array(row, pa.int64()), pa.array(at, pa.int64())], names=["key", "id", "row", "line"])

        told = StructType([StructField("key", BinaryType()), StructField("id", id_type), StructField("row", LongType()), StructField("line", LongType())])
        salted = placed.select("id", "text", "row").mapInArrow(tell, told).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
        hits = salted.join(repeated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["key", "salt"])
        if keep_first:
            hits = hits.filter(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))))
        numbers = hits.groupBy("row").agg(F.collect_list("line").alias("gone"))  # at most the lines of one text

        def drop_numbers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    texts = b.column(1).to_pylist()
                    sets = [set(g or ()) for g in b.column(2).to_pylist()]
                    yield rebuilt(b.column(0), texts, [[at in g for at in range((t or b"").count(b"\n") + 1)] for t, g in zip(texts, sets, strict=True)])

        kept = placed.join(numbers, "row", "left").select("id", "text", "gone").mapInArrow(drop_numbers, result)
    return kept.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))
