"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)), linear in the features present.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.common import column, crc_mod, map_batches, stage

WORD_BITS = 15
BINS = 16
STATS = ("log_bytes", "log_words", "word_length", "distinct", "repeats", "upper", "digit", "symbol", "space", "lines", "top_word", "marked_words", "twin_lines", "meta_chars")
DIM = (1 << WORD_BITS) + BINS * len(STATS)

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 white space
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words by log frequency, scaled to unit length, and one bin of each statistic."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    idx = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts)) & ((1 << WORD_BITS) - 1)
    val = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(val):
        val /= np.sqrt((val * val).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=6) / max(len(raw), 1)
    n, letters = len(words), max(kinds[1] + kinds[2], 1e-9)
    lines = [x for x in text.split("\n") if x]
    stats = (
        np.log2(len(raw) + 1) / 20,
        np.log2(n + 1) / 16,
        (len(text) / max(n, 1)) / 24,
        len(counts) / max(n, 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n - 1, 1),
        kinds[2] / letters,
        kinds[3] * 4,
        kinds[4] * 4,
        kinds[5] * 3,
        np.log2(len(lines) + 1) / 12,
        max(counts.values(), default=0) / max(n, 1),
        sum(c for w, c in counts.items() if not (w[-1].isalnum() or w[-1] in ".,")) / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        np.log2((n_chars if n_chars and n_chars > 0 else 0) + 1) / 20,
    )
    bins = np.clip((np.asarray(stats) * BINS).astype(np.int64), 0, BINS - 1)
    own = (1 << WORD_BITS) + np.arange(len(STATS)) * BINS + bins
    return np.concatenate([idx, own]), np.concatenate([val, np.full(len(STATS), 0.5, np.float32)]).astype(np.float32)


@dataclass
class FactorisationMachine:
    """bias, w[DIM], v[DIM, k]; raw() scores many rows given flat features and row starts."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.v[idx] * val[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        square = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((total * total).sum(axis=1) - square)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 8, rate: float = 0.1, decay: float = 2e-5, seed: int = 17, batch: int = 256) -> FactorisationMachine:
    """AdaGrad on the logistic loss. Without both labels the model is the constant prior."""
    rng = np.random.default_rng(seed)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    fm = FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(DIM, np.float32), rng.normal(0, 0.02, (DIM, rank)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        fm.v[:] = 0
        return fm
    gw, gv, gb = np.full(DIM, 1e-4, np.float32), np.full((DIM, rank), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            idx, val = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            vx = fm.v[idx] * val[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = fm.bias + np.add.reduceat(fm.w[idx] * val, starts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            e = np.repeat(err, sizes).astype(np.float32) * val
            used, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, e, len(used)).astype(np.float32) + decay * fm.w[used]
            per = e[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(inv, per[:, f], len(used)) for f in range(rank)], 1).astype(np.float32) + decay * fm.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += err.sum() ** 2
            fm.w[used] -= rate * dw / np.sqrt(gw[used])
            fm.v[used] -= rate * dv / np.sqrt(gv[used])
            fm.bias -= float(rate * err.sum() / np.sqrt(gb))
    return fm


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 8000, folds: int = 5, held_out: int = 0, max_features: int = 20_000_000, text_col: str = "text", id_col: str = "doc_id", meta_col: str = "n_chars") -> FactorisationMachine:
    """Fit on at most `sample` labelled rows, those of least xxhash64 of the id, outside the held-out fold.

    Of several labels of an id the mean counts (0.5 and more is 1), of several documents one; null ids, null labels and ids without
    a document take no part. Texts of any length count whole: their features come to the driver, at most max_features of them, of
    the rows of least hash if there are more, and those of one row at least.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & (crc_mod(id_col, folds) != held_out))
    picked = usable.groupBy(F.col(id_col).alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(meta_col).cast("long").alias("_n")).join(F.broadcast(picked), "_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fs = [features(t, n) for t, n in zip(column(b, "_text"), column(b, "_n"), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("_y")), pa.array([f[0].astype(np.int32).tobytes() for f in fs], pa.binary()), pa.array([f[1].tobytes() for f in fs], pa.binary())], names=["_id", "_y", "i", "v"])

    id_type = rows.schema["_id"].dataType.simpleString()
    found = map_batches(rows, f"_id {id_type}, _y int, i binary, v binary", run)
    found = stage(found.groupBy("_id").agg(F.min(F.struct("i", "v", "_y")).alias("x")).select("_id", "x.*"))
    sizes = sorted(found.select(F.xxhash64("_id"), F.length("i") / 4).collect())  # at most `sample` pairs
    fits = np.searchsorted(np.cumsum([n for _, n in sizes]), max_features, side="right")
    cut = sizes[max(fits, 1) - 1][0] if sizes else 0
    got = found.filter(F.xxhash64("_id") <= cut).toPandas()
    got = got.sort_values("_id") if len(got) else got
    feats = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32)) for i, v in zip(got["i"], got["v"], strict=True)]
    return train(feats, got["_y"].to_numpy(dtype=np.float32))


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, text_col: str = "text", meta_col: str = "n_chars", out: tuple[str, str] = ("score", "predicted"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of docs (all, by default, but for ones named as the new columns), score in [0, 1] and predicted. Null and empty texts are scored by their statistics.

    The model, a fixed 1.2 MB whatever the data, goes to the workers by a Spark broadcast variable.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_text"), F.col(f"`{meta_col}`").cast("long").alias("_n"))
    fields = rows.schema.fields[:-2]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "score double, predicted int"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fm, texts, metas, scores = shared.value, column(b, "_text"), column(b, "_n"), []
        for at in range(0, len(texts), 200):
            fs = [features(t, n) for t, n in zip(texts[at : at + 200], metas[at : at + 200], strict=True)]
            starts = np.concatenate([[0], np.cumsum([len(f[0]) for f in fs])[:-1]]).astype(np.int64)
            z = fm.raw(np.concatenate([f[0] for f in fs]), np.concatenate([f[1] for f in fs]), starts)
            scores.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        s = np.concatenate(scores)
        return pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(fields))], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*[f.name for f in fields], "score", "predicted"])

    return map_batches(rows, schema, run).toDF(*keep, *out)
