"""Exact removal of repeated byte strings, by suffix sorting in shards.

A string of `width` bytes is repeated if it also starts anywhere else, in the same or another document. To shard the suffixes,
every window of `width` bytes belongs to its anchor: the gram of `gram` bytes of least hash inside it, leftmost of ties. Equal
windows have equal anchors at equal offsets, so all copies meet under one anchor. Consecutive windows of one anchor form a run.

1. Runs of all documents: anchor hash, hash of the run's bytes, place. About one run per 85 bytes.
2. Anchors that occur once are done. Under an anchor whose runs are all equal, every window is repeated.
3. Under the other anchors, one copy of each distinct run is fetched, and the suffixes that start its windows are sorted by
   deep-shallow sorting: multikey quicksort on eight-byte keys to a shallow depth, then blind tries order the groups that still
   share a prefix. Leaves of two or more suffixes, equal over the whole width, are repeated windows.
4. An anchor with more distinct runs than one task should hold is split by the anchors its windows have under another hash, and
   what then are equal runs collapse; its parts are sorted like any anchor. Splitting goes on while parts are too large, and ends
   with single windows, of which equal ones collapse too, so no part can stay large.
5. Repeated windows become byte intervals of their documents.

Copies of a run are told by 128 bits of hashes (of its anchor and of its bytes), everything else by the bytes themselves: over
10^12 runs a false match has a chance of about 10^-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.llm.common import _powers, bounded_batches, column, mix64, stage, unstage

CHUNK = 1 << 16


# ---------------------------------------------------------------- runs


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys."""
    out, span = keys, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(data: bytes, doc_ends: np.ndarray, width: int, gram: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window's start and number of windows of each run; doc_ends are the ends of the texts in data.

    salt chooses the hash that anchors are least by.
    """
    raw = np.frombuffer(data, np.uint8)
    n, none = len(raw), np.zeros(0, np.int64)
    if n < width:
        return none.astype(np.uint64), none, none
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1] + np.uint64(salt * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(keys, width - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.concatenate([[0], doc_ends[:-1]])
    ok = np.zeros(n + 1, np.int32)  # windows inside one document
    long = doc_ends - starts >= width
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, doc_ends[long] - width + 1, -1)
    valid = np.cumsum(ok)[: len(anchor)] > 0
    doc_first = np.zeros(len(anchor), bool)
    doc_first[starts[long]] = True
    first = valid & doc_first
    first[1:] |= valid[1:] & ((anchor[1:] != anchor[:-1]) | ~valid[:-1])
    first[0] |= valid[0]
    at = np.flatnonzero(first)
    if not len(at):
        return none.astype(np.uint64), none, none
    invalid = np.flatnonzero(~valid)
    stop = np.minimum(np.concatenate([at[1:], [len(anchor)]]), np.concatenate([invalid, [len(anchor)]])[np.searchsorted(invalid, at)])
    return grams[anchor[at]], at, stop - at


def _pieces(texts: Iterable[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text's number, offset, bytes) of about CHUNK bytes; longer texts are cut with width - 1 bytes of overlap."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < width:
            continue
        for at in range(0, max(1, len(t) - width + 1), CHUNK):
            part = t[at : at + CHUNK + width - 1] if len(t) > CHUNK else t
            group.append((i, at, part))
            size += len(part)
            if size >= CHUNK:
                yield group
                group, size = [], 0
            if len(t) <= CHUNK:
                break
    if group:
        yield group


def _runs_in(group: list[tuple[int, int, bytes]], width: int, gram: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Anchor, hash of the bytes, text's number, start in it, number of windows and bytes of each run of a group of _pieces()."""
    data = b"".join(g[2] for g in group)
    sizes = np.array([len(g[2]) for g in group])
    ends = np.cumsum(sizes)
    anchors, at, n = runs_of(data, ends, width, gram, salt)
    parts = [data[s : s + k + width - 1] for s, k in zip(at.tolist(), n.tolist(), strict=True)]
    content = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(at))
    g = np.searchsorted(ends, at, side="right")
    rows = np.array([x[0] for x in group], np.int64)[g]
    start = at - (ends - sizes)[g] + np.array([x[1] for x in group], np.int64)[g]
    return anchors, content, rows, start, n, parts


def _map_runs(width: int, gram: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(b.schema.get_field_index("_text"))
            for group in _pieces(((t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts), width):
                anchors, content, rows, start, n, _ = _runs_in(group, width, gram)
                if not len(rows):
                    continue
                # equal runs of one text are one row: its first start, and the others as a list
                order = np.lexsort((start, content, anchors, rows))
                rows, anchors, content, start, n = (v[order] for v in (rows, anchors, content, start, n))
                new = np.ones(len(order), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (anchors[1:] != anchors[:-1]) | (content[1:] != content[:-1])
                first = np.flatnonzero(new)
                again = np.concatenate([[0], np.cumsum(np.diff(np.append(first, len(order))) - 1)]).astype(np.int32)
                ids = pa.array(rows[first])
                more = pa.ListArray.from_arrays(pa.array(again), pa.array(start[~new]))
                yield pa.RecordBatch.from_arrays([pa.array(anchors[first].view(np.int64)), pa.array(content[first].view(np.int64)), b.column(0).take(ids), b.column(1).take(ids), pa.array(start[first]), pa.array(n[first].astype(np.int32)), more], names=["a", "c", "_id", "_x", "start", "n", "more"])

    return run


# ---------------------------------------------------------------- deep-shallow sorting


class _Blind:
    """A blind trie over strings of fixed length: inner nodes hold a branching depth only, leaves the suffixes equal over all of it."""

    def __init__(self, data: bytes, width: int):
        self.data, self.width, self.root = data, width, None

    def add(self, at: int) -> None:
        if self.root is None:
            self.root = [at]
            return
        s = self.data[at : at + self.width]
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.data[node[0] : node[0] + self.width]
        if s == other:
            node.append(at)
            return
        low, high = 0, self.width  # first difference, by halving
        while high - low > 1:
            mid = (low + high) // 2
            if s[:mid] == other[:mid]:
                low = mid
            else:
                high = mid
        depth, parent, node = low, None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [at]
            return
        fork = (depth, {other[depth]: node, s[depth]: [at]})
        if parent is None:
            self.root = fork
        else:
            parent[1][s[parent[0]]] = fork

    def leaves(self) -> Iterator[list[int]]:
        """In order of the strings."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node is not None:
                yield node


def deep_shallow(data: bytes, starts: np.ndarray, width: int, shallow: int = 32) -> list[np.ndarray]:
    """Sorts the suffixes at `starts` over `width` bytes; returns the groups of two or more that are equal over all of it."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    order, group = np.asarray(starts, np.int64), np.zeros(len(starts), np.int64)
    for depth in range(0, min(shallow, width - width % 8), 8):  # multikey quicksort: one eight-byte key at a time within equal prefixes
        if not len(order):
            return []
        key = np.zeros(len(order), np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | raw[order + depth + k].astype(np.uint64)
        by = np.argsort(key, kind="quicksort")
        by = by[np.argsort(group[by], kind="stable")]
        order, group, key = order[by], group[by], key[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        ids = np.cumsum(new) - 1
        many = np.bincount(ids)[ids] > 1  # suffixes alone in their group have their place
        order, group = order[many], ids[many]
    out = []
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else []
    for s, e in zip(cut[:-1], cut[1:], strict=True):  # deep groups
        members = order[s:e].tolist()
        if len(members) == 2:
            a, b = members
            if data[a : a + width] == data[b : b + width]:
                out.append(order[s:e])
            continue
        trie = _Blind(data, width)
        for m in members:
            trie.add(m)
        out += [np.array(leaf, np.int64) for leaf in trie.leaves() if len(leaf) > 1]
    return out


def _map_sort(width: int, max_bytes: int = 1 << 19):
    """Sorts the suffixes of runs that come sorted by anchor and content (a repeated run counts once); flushes whole anchors once max_bytes are held."""

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = b"".join(r[2] for r in rows)
        ends = np.cumsum([len(r[2]) for r in rows])
        begins = ends - np.array([len(r[2]) for r in rows])
        n = ends - begins - width + 1
        starts = np.concatenate([np.arange(s, s + k) for s, k in zip(begins, n, strict=True)])
        flagged = np.zeros(len(data) + 1, bool)
        for g in deep_shallow(data, starts, width):
            flagged[g] = True
        hits: tuple[list, list, list, list] = ([], [], [], [])
        edge = np.diff(np.concatenate(([False], flagged)).astype(np.int8))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            i = int(np.searchsorted(ends, s, side="right"))
            while s < e:  # a stretch of flagged starts may go on in the next run
                stop = min(e, ends[i])
                hits[0].append(rows[i][0])
                hits[1].append(rows[i][1])
                hits[2].append(int(s - begins[i]))
                hits[3].append(int(stop - s))
                s, i = stop, i + 1
        return pa.RecordBatch.from_arrays([pa.array(hits[0], pa.int64()), pa.array(hits[1], pa.int64()), pa.array(hits[2], pa.int32()), pa.array(hits[3], pa.int32())], names=["a", "c", "off", "cnt"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for b in it:
            for a, c, raw in zip(*(b.column(b.schema.get_field_index(x)) for x in ("a", "c", "bytes")), strict=True):
                row = a.as_py(), c.as_py(), raw.as_py()
                if held and held[-1][:2] == row[:2]:
                    continue
                if size >= max_bytes and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield solve(held)

    return run


# ---------------------------------------------------------------- the operator


def _fetch(docs: DataFrame, wanted: DataFrame, width: int, broadcast_rows: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """The bytes of one copy of each wanted run (a, c, rep); twice or more, where rows of docs are repeated. Texts that hold none
    are left out by their 8-byte hash before the shuffle, if the hashes are few enough to broadcast."""
    need = wanted.groupBy(F.col("rep._id").alias("_wid"), F.col("rep._x").alias("_wx")).agg(F.collect_list(F.struct("a", "c", "rep.start", "rep.n")).alias("_list"))
    hashes = wanted.select(F.col("rep._x").alias("_x")).distinct()
    if hashes.count() <= broadcast_rows:
        docs = docs.join(F.broadcast(hashes), "_x", "left_semi")
    rows = docs.join(need.hint("merge"), F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_x") == F.col("_wx"))).select("_text", "_list")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["a", "c", "bytes"])

        for b in it:
            for text, items in zip(b.column(0), b.column(1), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                fields = [items.values.field(i).to_numpy().tolist() for i in range(4)]
                for a, c, start, n in zip(*fields, strict=True):
                    out[0].append(a)
                    out[1].append(c)
                    out[2].append(raw[start : start + n + width - 1])
                    size += n + width
                    if size >= batch_bytes:
                        yield batch()
                        out, size = [[], [], []], 0
        if out[0]:
            yield batch()

    return rows.mapInArrow(run, "a bigint, c bigint, bytes binary")


def _map_split(width: int, gram: int, level: int, last: bool):
    """Parts of runs (a, c, bytes) by the anchors of another hash, or, at last, single windows: pa, pc and the part's offset, size and bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parent = b.column(0).to_numpy().view(np.uint64)
            for group in _pieces((x.as_py() for x in b.column(2)), width):
                if last:
                    spots = [(i, at + o, raw[o : o + width]) for i, at, raw in group for o in range(len(raw) - width + 1)]
                    rows, off, parts = (list(x) for x in zip(*spots, strict=True))
                    rows, n = np.array(rows, np.int64), np.ones(len(rows), np.int32)
                    anchors = np.fromiter((xxhash.xxh3_64_intdigest(x, 1) for x in parts), np.uint64, len(parts))
                    content = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
                else:
                    anchors, content, rows, off, n, parts = _runs_in(group, width, gram, level)
                for s in range(0, len(rows), 4000):
                    e = s + 4000
                    of = pa.array(rows[s:e])
                    own = mix64(anchors[s:e] + mix64(parent[rows[s:e]])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(own), pa.array(content[s:e].view(np.int64)), pa.array(off[s:e], pa.int32()), pa.array(np.asarray(n[s:e], np.int32)), pa.array(parts[s:e], pa.binary())], names=["pa", "pc", "a", "c", "off", "n", "bytes"])

    return run


def _repeats_in(content: DataFrame, width: int, gram: int, hot_runs: int, levels: int, level: int = 1) -> DataFrame:
    """Repeated stretches hs of windows (from s to before e) of distinct runs (a, c, bytes), in one or more rows a run; rows equal in a and
    c are one run."""
    stretch = _stretch(F.col("off"), F.col("cnt"))
    spark = content.sparkSession
    n_parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = stage(content.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > hot_runs).select("a"))
    none_hot = hot.isEmpty() or level > levels + 1
    cold = content if none_hot else content.join(hot, "a", "left_anti")
    hits = cold.repartition(n_parts, "a").sortWithinPartitions("a", "c").mapInArrow(_map_sort(width), "a bigint, c bigint, off int, cnt int").select("a", "c", stretch)
    if none_hot:
        return hits
    large = content.join(hot, "a", "left_semi").dropDuplicates(["a", "c"])
    parts = stage(large.mapInArrow(_map_split(width, gram, level, level > levels), "pa bigint, pc bigint, a bigint, c bigint, off int, n int, bytes binary"))
    distinct = stage(parts.groupBy("a", "c").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.first("bytes").alias("bytes")))
    mixed = distinct.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1").select("a")
    below = _repeats_in(stage(distinct.join(mixed, "a").select("a", "c", "bytes")), width, gram, hot_runs, levels, level + 1)
    below = below.unionByName(distinct.filter("copies > 1").select("a", "c", _stretch(F.lit(0), F.col("n"))))
    below = stage(below.groupBy("a", "c").agg(F.flatten(F.collect_list("hs")).alias("hs")))  # one row meets each of a part's places
    moved = F.transform("hs", lambda h: F.struct((F.col("off") + h["s"]).alias("s"), (F.col("off") + h["e"]).alias("e")))
    found = parts.join(below, ["a", "c"]).select(F.col("pa").alias("a"), F.col("pc").alias("c"), moved.alias("hs"))
    found = found.groupBy("a", "c").agg(F.flatten(F.collect_list("hs")).alias("hs"))  # at most a stretch for each window of a run
    return hits.unionByName(found.mapInArrow(_map_merge, f"a bigint, c bigint, hs {_SPANS}"))


_SPANS = "array<struct<s:bigint,e:bigint>>"


def _stretch(off: Column, n: Column) -> Column:
    return F.array(F.struct(off.cast("bigint").alias("s"), (off + n).cast("bigint").alias("e"))).alias("hs")


def _map_merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts and merges the intervals of each row, the list in its third column."""
    for b in it:
        lists = b.column(2)
        start, end = (lists.flatten().field(i).to_numpy() for i in (0, 1))
        row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        high = int(end.max(initial=0)) + 1
        reach = np.maximum.accumulate(row * high + end) - row * high  # furthest end so far in the row
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
        first = np.flatnonzero(new)
        until = reach[np.append(first[1:], len(row)) - 1] if len(row) else reach
        spans = pa.StructArray.from_arrays([pa.array(start[first], pa.int64()), pa.array(until, pa.int64())], names=["s", "e"])
        cuts = pa.array(np.searchsorted(row[first], np.arange(b.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(cuts, spans)], names=b.schema.names)


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 32, hot_runs: int = 2000, levels: int = 3, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Columns _id, _x (hash of the text) and spans: the repeated byte intervals (start, end) of each text that has any, merged and in order.

    An anchor of over `hot_runs` distinct runs is split by up to `levels` further hashes, then by window.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_x"), F.col(text_col).alias("_text")).filter(F.octet_length("_text") >= width)
    id_type = rows.schema["_id"].dataType.simpleString()
    runs = stage(rows.mapInArrow(_map_runs(width, gram), f"a bigint, c bigint, _id {id_type}, _x bigint, start bigint, n int, more array<bigint>"))
    times = F.sum(1 + F.size("more"))
    # Written first, so that the join reads plain exchanges, of which Spark can split a hot anchor's.
    anchors = runs.groupBy("a").agg(times.alias("tot"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("tot > 1")
    anchors = stage(anchors.select("a", (F.col("lo") != F.col("hi")).alias("mixed")))
    shared = stage(runs.join(anchors, "a"))
    unstage(runs)
    unstage(anchors)
    starts = F.concat(F.array("start"), F.col("more"))
    whole = shared.filter("not mixed").select("_id", "_x", F.transform(starts, lambda s: F.struct(s.alias("s"), (s + F.col("n") + (width - 1)).alias("e"))).alias("se"))

    mixed = shared.filter("mixed")
    distinct = mixed.groupBy("a", "c").agg(times.alias("copies"), F.min(F.struct("_id", "_x", "start", "n")).alias("rep"))
    distinct = stage(distinct)
    content = stage(_fetch(rows, distinct, width, broadcast_rows))
    hits = _repeats_in(content, width, gram, hot_runs, levels)
    hits = hits.unionByName(distinct.filter("copies > 1").select("a", "c", _stretch(F.lit(0), F.col("rep.n"))))
    # One row per run, with all its repeated stretches, meets each of the run's places. Written first, so that Spark can split a hot run's.
    stretches = stage(hits.groupBy("a", "c").agg(F.flatten(F.collect_list("hs")).alias("hs")))
    unstage(content)
    unstage(distinct)
    at = lambda s: F.transform("hs", lambda h: F.struct((s + h["s"]).alias("s"), (s + h["e"] + (width - 1)).alias("e")))
    part = mixed.join(stretches, ["a", "c"]).select("_id", "_x", F.flatten(F.transform(starts, at)).alias("se"))
    spans = whole.unionByName(part).groupBy("_id", "_x").agg(F.flatten(F.collect_list("se")).alias("spans"))
    return spans.mapInArrow(_map_merge, f"_id {id_type}, _x bigint, spans {_SPANS}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 32, hot_runs: int = 2000, levels: int = 3, broadcast_rows: int = 1_000_000, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per input row: id, the kept columns, n_bytes, n_removed, n_spans and kept (the remaining bytes).

    With as_text, kept is a string: bytes of characters that a cut has split are left out.

    Null text counts as empty. Texts under `width` bytes lose nothing. Repeated rows, null ids included, are documents of
    their own: their common strings are removed from each of them. Offsets are bytes of the UTF-8 form.
    """
    spans = stage(repeated_intervals(docs, id_col, text_col, width, gram, hot_runs, levels, broadcast_rows))
    held = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("k")).first()
    if held["n"] + held["k"] <= broadcast_rows:  # of some 30 bytes each
        spans = F.broadcast(spans)
    spans = spans.select(F.col("_id").alias("_sid"), F.col("_x").alias("_sx"), "spans")
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.xxhash64(text_col).alias("_x"), F.col(text_col).alias("_text"))
    rows = rows.join(spans, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_x") == F.col("_sx")), "left").drop("_sid", "_sx", "_x")
    kept_fields = rows.schema.fields[: 1 + len(keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields) + ", n_bytes bigint, n_removed bigint, n_spans bigint, kept " + ("string" if as_text else "binary")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for first in range(0, whole.num_rows, 100):
                b = whole.slice(first, 100)
                size, removed, n_spans, kept = [], [], [], []
                for text, found in zip(column(b, "_text"), column(b, "spans"), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    size.append(len(raw))
                    merged = [(x["s"], x["e"]) for x in found or ()]
                    removed.append(sum(e - s for s, e in merged))
                    n_spans.append(len(merged))
                    cut = [0, *[x for m in merged for x in m], len(raw)]
                    kept.append(b"".join(raw[s:e] for s, e in zip(cut[::2], cut[1::2], strict=True)) if merged else raw)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept_fields))], pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=[*[f.name for f in kept_fields], "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", "kept")


def repeats_by_brute_force(texts: list[str | None], width: int) -> list[tuple[int, int, int, str]]:
    """For tests: n_bytes, n_removed, n_spans and the SHA-256 of what is kept, from a dictionary of all windows."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - width + 1):
            seen[r[i : i + width]] = seen.get(r[i : i + width], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]) if len(r) else b""
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
