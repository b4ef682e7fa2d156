"""Best-fit packing of tokenised documents into fixed-length sequences by large-item matching.

Lengths are integers up to the capacity, so their histogram has a bounded size whatever the data. The driver matches on the
histogram: pieces above a third of the capacity pair greedily (at most two per sequence), smaller ones best-fit the gaps,
longest first. The plan, a bounded list of runs, then goes to the pieces by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.llm.common import column, map_batches, stage

# ---------------------------------------------------------------- tokenising

_encoders: dict[tuple[str, bool], object] = {}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file as the `tokenizers` library gives them.

    With `fast`, texts without special-token strings take `tiktoken` on the same vocabulary, which gives the same ids in a quarter
    of the time (85 to 330 CPU seconds a GB of text); the tests compare them.
    """

    #: The published split pattern of this family of vocabularies (fixed value).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, fast: bool = True):
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        if fast and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and not spec.get("normalizer"):
            self.fast = self._fast(spec["model"]["vocab"])

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def _fast(self, vocab: dict[str, int]):
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain}
        of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        return tiktoken.Encoding("byte-bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # very long runs of one kind can exhaust the pattern's stack, which the library reports so
                if type(e).__name__ != "PanicException":
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def _encoder(path: str, fast: bool) -> ByteBpe:
    if (path, fast) not in _encoders:
        _encoders[path, fast] = ByteBpe(path, fast)
    return _encoders[path, fast]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", fast: bool = True) -> DataFrame:
    """Pieces of every row: id, piece, start, length, ids (little-endian unsigned 32-bit). Null and empty texts have the end id only.

    `fast` is ByteBpe's. Repeated rows and null ids are documents of their own; other columns of docs, whatever their names, are
    left out. Documents longer than the capacity are cut so that only the first piece is shorter.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, of, piece, start, length, ids = _encoder(tokenizer_path, fast), [], [], [], [], []
        for row, text in enumerate(column(b, "_text")):
            got = enc.encode(text) if text else []
            got.append(end_id)
            raw, n = np.array(got, "<u4").tobytes(), len(got)
            cuts = [0, *range((n % capacity) or capacity, n, capacity), n]
            for k in range(len(cuts) - 1):
                of.append(row)
                piece.append(k)
                start.append(cuts[k])
                length.append(cuts[k + 1] - cuts[k])
                ids.append(raw[4 * cuts[k] : 4 * cuts[k + 1]])
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["_id", "piece", "start", "length", "ids"])

    return map_batches(rows, f"_id {id_type}, piece int, start bigint, length bigint, ids binary", run).withColumnRenamed("_id", id_col)


# ---------------------------------------------------------------- planning on the histogram


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, per bin, offset): ranks of a length fill bins in order, `per bin` each."""
    left = {n: c for n, c in histogram.items() if c > 0}
    runs: list[tuple[int, int, int, int, int, int]] = []
    ranks = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups of bins (first, number)
    bins = 0

    def put(length: int, first_bin: int, n_bins: int, per: int, offset: int) -> None:
        r = ranks[length]
        runs.append((length, r, r + n_bins * per, first_bin, per, offset))
        ranks[length] += n_bins * per
        left[length] -= n_bins * per

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            mate = large[at] if at >= 0 else None
            if mate == a and left[a] < 2:
                at -= 1
                while at >= 0 and not left[large[at]]:
                    at -= 1
                mate = large[at] if at >= 0 else None
            if mate is None:
                n, gap = left[a], capacity - a
                put(a, bins, n, 1, 0)
            elif mate == a:
                n, gap = left[a] // 2, capacity - 2 * a
                put(a, bins, n, 2, 0)
            else:
                n, gap = min(left[a], left[mate]), capacity - a - mate
                put(a, bins, n, 1, 0)
                put(mate, bins, n, 1, a)
            if gap:
                gaps.setdefault(gap, []).append((bins, n))
            bins += n
    order = sorted(gaps)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                gap, first, n, fresh = capacity, bins, -(-left[s] // (capacity // s)), True
                bins += n
            else:
                gap, fresh = order[at], False
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            per = gap // s
            full = min(n, left[s] // per)
            rest = [(first + full, n - full, gap)]
            if full:
                put(s, first, full, per, capacity - gap)
                rest.append((first, full, gap - per * s))
            if left[s] and full < n:  # one bin takes what is left of this length
                more = left[s]
                put(s, first + full, 1, more, capacity - gap)
                rest[0] = (first + full + 1, n - full - 1, gap)
                rest.append((first + full, 1, gap - more * s))
            for f, k, g in rest:
                if k and g:
                    if g not in gaps:
                        bisect.insort(order, g)
                    gaps.setdefault(g, []).append((f, k))
            assert not fresh or left[s] == 0
    return runs


def assign_sequences(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id", salt_rows: int = 5000) -> DataFrame:
    """The pieces with sequence_id and offset: sequences hold at most `capacity` and are gapless from offset 0.

    Other columns are carried along, but must not be named sequence_id or offset; repeated rows are packed as often as they come. The input is staged once, so that
    ranks do not change if an executor is lost. Ranks are counted per length and salt, of about salt_rows rows, as one length may hold most rows.
    """
    names = [*pieces.columns]
    pieces = stage(pieces.toDF(*[f"c{i}" for i in range(len(names))]))  # whatever the columns are called
    spark: SparkSession = pieces.sparkSession
    key, piece, length = (f"c{names.index(c)}" for c in (id_col, "piece", "length"))
    counts = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count("*")).collect()}  # at most `capacity` rows
    runs = plan_bins(counts, capacity)
    salts = sum(counts.values()) // salt_rows + 1
    keyed = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, piece), F.lit(salts)))
    offsets = keyed.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    offsets = offsets.select(length, "_salt", (F.sum("_n").over(Window.partitionBy(length).orderBy("_salt")) - F.col("_n")).alias("_before"))
    order = [c for c, t in pieces.dtypes if not t.startswith(("map", "variant"))]
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(offsets, [length, "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "_length bigint, _from bigint, _to bigint, _bin bigint, _per bigint, _offset bigint")
    placed = ranked.join(F.broadcast(plan), (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = F.col("_rank") - F.col("_from")
    sequence, offset = (F.col("_bin") + F.floor(at / F.col("_per"))).cast("long"), (F.col("_offset") + F.pmod(at, F.col("_per")) * F.col(length)).cast("long")
    return placed.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], sequence.alias("sequence_id"), offset.alias("offset"))
