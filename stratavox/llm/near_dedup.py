"""Near-duplicate classes by ProbMinHash.

A text is the set of its five-word shingles, each of weight 1, as links are defined by the similarity of the sets. Every shingle
is a Poisson process whose rate is its weight; each arrival falls on a random register, and a register keeps the shingle of its
first arrival. Once all registers of a text are filled, shingles whose next arrival is later than the latest register stop (early
termination). Equal registers estimate the probability Jaccard similarity of the weights, which for weights of 1 is the Jaccard
similarity of the sets.

Texts of equal shingle sets are one node. Registers are banded into buckets, and members of a bucket are linked by the exact
Jaccard similarity of their shingle sets. Only links that join two components of a bucket are looked for and emitted, never all
pairs; what a task holds of a bucket is a window of bounded size. Members of a large bucket that are still in different components
afterwards are compared exactly, chunk against chunk, so every link between texts that share a bucket counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.common import bounded_batches, column, mix64, shingle_hashes, stage, unstage, word_hashes

BANDS, ROWS = 24, 4


def prob_min_hash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures, a row for each of n_docs: the shingle with the first arrival at each register. doc says whose each shingle is."""
    first = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, np.uint64)
    doc, shingle, rate = doc.astype(np.int64), shingle.astype(np.uint64), 1.0 / weight
    arrival, step = np.zeros(len(doc)), 0
    while len(doc):
        step = (step + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        bits = mix64(shingle + np.uint64(step))
        arrival = arrival - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        at = doc * registers + (mix64(bits + np.uint64(0x632BE59BD9B4E019)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, arrival)
        won = first[at] == arrival
        owner[at[won]] = shingle[won]
        latest = first.reshape(n_docs, registers).max(axis=1)
        on = arrival < latest[doc]
        doc, shingle, rate, arrival = doc[on], shingle[on], rate[on], arrival[on]
    return owner.reshape(n_docs, registers)


def _shingles(text: str | None, k: int) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.unique(shingle_hashes(word_hashes(raw), k))


def _map_signatures(k: int, bands: int, rows: int):
    def solve(texts: list[str | None]) -> tuple[list, list, list, list]:
        found = [_shingles(t, k) for t in texts]
        sizes = np.array([len(f) for f in found])
        node, n, sets, out = [None] * len(texts), sizes.tolist(), [None] * len(texts), [None] * len(texts)
        if not sizes.sum():
            return node, n, sets, out
        flat = np.concatenate(found)
        sig = prob_min_hash(np.repeat(np.arange(len(texts)), sizes), flat, np.ones(len(flat)), len(texts), bands * rows).reshape(len(texts), bands, rows)
        key = np.zeros(sig.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for r in range(rows):
            key = mix64(key + sig[:, :, r])
        for i in np.flatnonzero(sizes):
            h = found[i]
            node[i] = np.array([mix64(h ^ np.uint64(0xA24BAED4963EE407)).sum(), mix64(h + np.uint64(0x9FB21C651E98DF25)).sum()], np.uint64).tobytes()
            sets[i] = np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes()
            out[i] = key[i].view(np.int64)
        return node, n, sets, out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                node, n, sets, keys = solve(column(part, "_text"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_x", "node", "n", "shingles", "bands"])

    return run


def _similar(p: np.ndarray, q: np.ndarray, least: float) -> bool:
    if min(len(p), len(q)) < least * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common) - 1e-9


def _map_links(least: float, window: int):
    """Links (u, v) between the members of each group; rows come sorted by group (g, blk), hubs first.

    A member is compared with those before it, the last to be linked first, but not with members of its own component. Only the
    last `window` members (and the hub) are held, so memory is bounded; groups up to the window are compared in full.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, part = None, [], {}

        def root(x: bytes) -> bytes:
            while part[x] != x:
                part[x] = x = part[part[x]]
            return x

        for b in it:
            us, vs = [], []
            for g, blk, node, raw in zip(column(b, "g"), column(b, "blk"), column(b, "node"), column(b, "shingles"), strict=True):
                if (g, blk) != group:
                    group, held, part = (g, blk), [], {}
                if node in part:
                    continue
                mine = np.frombuffer(raw, np.uint32)
                part[node] = node
                for i in range(len(held) - 1, -1, -1):
                    other, theirs = held[i]
                    if root(other) != root(node) and _similar(mine, theirs, least):
                        part[root(node)] = root(other)
                        us.append(min(node, other))
                        vs.append(max(node, other))
                        held.append(held.pop(i))
                held.append((node, mine))
                if len(held) > window:
                    del held[1 if len(held) > 1 else 0]
                    kept = {n for n, _ in held}
                    tops = {n: root(n) for n in kept}
                    low: dict[bytes, bytes] = {}
                    for n in kept:
                        low.setdefault(tops[n], n)
                    part = {n: low[tops[n]] for n in kept}
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    return run


def _map_cross(least: float):
    """Links (u, v) between labels; rows come sorted by group (g, i, j), and in a group the chunk held (held = 0) comes first.

    A member is compared with the whole chunk at once, by an inverted index of the chunk's shingles; pairs of one component are
    left out, those of components joined on the way too.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part = None, {}
        labels: list[bytes] = []
        sets: list[np.ndarray] = []
        index = None

        def root(x: bytes) -> bytes:
            while part.setdefault(x, x) != x:
                part[x] = x = part[part[x]]
            return x

        for b in it:
            us, vs = [], []
            for g, i, j, held, label, raw in zip(*(column(b, c) for c in ("g", "i", "j", "held", "label", "shingles")), strict=True):
                if (g, i, j) != group:
                    group, part, labels, sets, index = (g, i, j), {}, [], [], None
                mine = np.frombuffer(raw, np.uint32)
                if held == 0:
                    labels.append(label)
                    sets.append(mine)
                    continue
                if not labels:
                    continue
                if index is None:
                    sizes = np.array([len(x) for x in sets])
                    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(flat, kind="stable")
                    index, owner, sets = flat[order], owner[order], []
                lo, hi = np.searchsorted(index, mine, "left"), np.searchsorted(index, mine, "right")
                size = hi - lo
                at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                common = np.bincount(owner[at], minlength=len(labels))
                for k in np.flatnonzero(common >= least * (sizes + len(mine) - common) - 1e-9).tolist():
                    x, y = root(label), root(labels[k])
                    if x != y:
                        part[x] = y
                        us.append(min(label, labels[k]))
                        vs.append(max(label, labels[k]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    return run


def _finish(dealt: DataFrame, labels: DataFrame, known: DataFrame, similarity: float, chunk: int, broadcast_rows: int) -> DataFrame:
    """labels (node, label) with the links that the windows of large buckets (dealt: g, node) left out.

    Of a bucket's components the largest is compared with the others only, by chunks of their members against chunks of all members.
    """
    spark = dealt.sparkSession
    named = dealt.join(labels, "node", "left").select("g", "node", F.coalesce("label", "node").alias("label"))
    counts = named.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("k"))
    counts = counts.filter("k > 1").select("g", F.col("top.label").alias("main"), F.ceil((F.col("c") - F.col("top.c")) / chunk).alias("ni"), F.ceil(F.col("c") / (4 * chunk)).alias("nj"))
    open_ = stage(named.join(counts, "g").withColumn("rest", F.col("label") != F.col("main")))
    if open_.isEmpty():
        unstage(open_)
        return labels
    own = F.pmod(F.xxhash64("node"), F.col("ni"))
    # Chunk i of the others is held against each chunk j of all; a pair of two others meets once, in the smaller of their chunks.
    upto = F.when(F.col("rest"), own).otherwise(F.col("ni") - 1)
    zero = F.lit(0).cast("bigint")
    passing = open_.select("g", F.explode(F.sequence(zero, upto)).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("nj")).alias("j"), F.lit(1).alias("held"), "node", "label")
    held = open_.filter("rest").select("g", own.alias("i"), F.explode(F.sequence(zero, F.col("nj") - 1)).alias("j"), F.lit(0).alias("held"), "node", "label")
    wanted = open_.select("node").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    sets = known.select("node", "shingles").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = held.unionByName(passing).join(sets, "node").repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j", "held")
    more = stage(rows.select("g", "i", "j", "held", "label", "shingles").mapInArrow(_map_cross(similarity), "u binary, v binary"))
    unstage(open_)
    if more.isEmpty():
        return labels
    joined = components(more).select(F.col("node").alias("was"), F.col("label").alias("now"))
    lone = joined.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return labels.join(joined, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")).unionByName(lone)


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (u, v): label is the least node of its component. Neighbour minima with pointer jumping."""
    both = stage(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        near = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = stage(near.join(jump, "via", "left").select("node", "old", F.least("via", "far").alias("label")))
        done = step.filter("old <> label").isEmpty()
        unstage(labels)
        labels = step.select("node", "label")
        if done:
            unstage(both)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, bands: int = BANDS, rows: int = ROWS, window: int = 64, block: int = 2000, chunk: int = 500, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: _id, _x (hash of the text) and label (its class; null for a text without words, a class of its own).

    Classes are the components of all links of Jaccard similarity `similarity` or more between texts that share a bucket; at
    0.8, 24 bands of 4 rows miss a link with probability 3e-6. Buckets up to `window` texts are compared in full; in larger ones
    a text first meets the window of texts that share its next band and the bucket's hub, and then, in chunks of `chunk`, all texts
    of other components. A text under `words` words is one shingle. Copies are one node. Sets are compared by 32-bit hashes.
    Extra columns of any name do no harm.
    """
    source = bounded_batches(docs).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_x"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    signed = stage(source.mapInArrow(_map_signatures(words, bands, rows), f"_id {id_type}, _x bigint, node binary, n int, shingles binary, bands array<bigint>"))
    known = signed.filter(F.col("node").isNotNull())
    nodes = known.select("node", "bands").groupBy("node").agg(F.first("bands").alias("bands"))
    keyed = nodes.select("node", "bands", F.posexplode("bands").alias("i", "key")).select("node", "key", F.col("bands")[F.pmod(F.col("i") + 1, F.lit(bands))].alias("next"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("hub")).filter("c > 1")
    buckets = stage(keyed.join(shared, "key"))
    # Small buckets of equal members are one group; a large one is dealt into blocks by its members' next band, each with the hub.
    small = buckets.filter(F.col("c") <= window).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("ms")).select("ms").distinct()
    small = small.select(F.xxhash64("ms").alias("g"), F.lit(0).cast("bigint").alias("blk"), F.explode("ms").alias("node"), F.lit(0).cast("bigint").alias("next"), F.lit(False).alias("big"))
    dealt = buckets.filter(F.col("c") > window).withColumn("parts", F.floor(F.col("c") / block) + 1)
    large = dealt.select(F.col("key").alias("g"), F.pmod(F.xxhash64("next"), F.col("parts")).alias("blk"), "node", "next", F.lit(True).alias("big"))
    hubs = dealt.select("key", "hub", "parts").distinct().select(F.col("key").alias("g"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("blk"), F.col("hub").alias("node"), F.lit(None).cast("bigint").alias("next"), F.lit(False).alias("big"))
    members = stage(small.unionByName(large).unionByName(hubs))
    unstage(buckets)
    wanted = members.select("node").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    sets = known.select("node", "shingles").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    spark = source.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows_ = members.join(sets, "node").repartition(parts, "g", "blk").sortWithinPartitions("g", "blk", F.col("next").asc_nulls_first(), "node")
    edges = rows_.select("g", "blk", "node", "shingles").mapInArrow(_map_links(similarity, window), "u binary, v binary")
    labels = components(edges)
    labels = _finish(members.filter("big").select("g", "node"), labels, known, similarity, chunk, broadcast_rows)
    return signed.select("_id", "_x", "node").join(labels, "node", "left").select("_id", "_x", F.coalesce("label", "node").alias("label"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, class_id (least id of the class; null only if all its ids are) and class_size (rows)."""
    found = near_duplicates(docs, id_col, text_col, **options)
    found = stage(found)
    classes = found.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("_id").alias("class_id"), F.count("*").alias("class_size"))
    out = found.join(classes, "label", "left")
    alone = F.col("label").isNull()
    return out.select(F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """The rows of docs but one of each class goes: that of least id, then text hash, stays. Rows equal in id and text count as one row."""
    found = stage(near_duplicates(docs, id_col, text_col, **options))
    classes = found.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct("_id", "_x")).alias("kept"), F.count("*").alias("k"))
    gone = found.join(classes.filter("k > 1"), "label").filter(~F.struct("_id", "_x").eqNullSafe(F.col("kept"))).select(F.col("_id").alias("_gid"), F.col("_x").alias("_gx")).distinct()
    twice = found.groupBy("_id", "_x").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("_id").alias("_gid"), F.col("_x").alias("_gx"))
    gone, twice = stage(gone), stage(twice)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the columns are called
    key, x = F.col(f"c{names.index(id_col)}"), F.xxhash64(F.col(f"c{names.index(text_col)}"))

    def sided(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
        return df.join(ids, key.eqNullSafe(F.col("_gid")) & (x == F.col("_gx")), how)

    left = sided(rows, gone, "left_anti")
    if not twice.isEmpty():
        again = sided(left, twice, "left_semi").withColumn("_gx", x).dropDuplicates([f"c{names.index(id_col)}", "_gx"]).drop("_gx")
        left = sided(left, twice, "left_anti").unionByName(again)
    return left.toDF(*names)
