"""Centroid clustering by dual-tree Lloyd: cover trees over blocks of vectors, a cover tree over the centroids of each round.

Vectors are whole numbers. Tree distances are doubles and only rule out pairs, with a margin; pairs of leaves are compared by
exact squared distances, so results do not depend on blocks, trees or partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratavox.llm.common import bounded_batches, stage

#: Components beyond this would let a squared distance of many components leave 64 bits.
MOST = 1 << 27
#: Least relative slack of a bound: a pair is ruled out only if it is farther by more than rounding could explain.
SLACK = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows of whole numbers."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 8192):
        d = a[i : i + 8192] - (b if len(b) == 1 else b[i : i + 8192])
        out[i : i + 8192] = np.einsum("ij,ij->i", d, d)
    return out


def _distances_from(x: np.ndarray, rows: np.ndarray, head: int) -> np.ndarray:
    """Distances of rows of x from the row `head`. Doubles hold every product exactly while components stay below 2**21."""
    if x.dtype == np.float64:
        y = x[rows]
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", y, y) - 2 * (y @ x[head]) + x[head] @ x[head], 0.0))
    return np.sqrt(squared(x[rows], x[head : head + 1]).astype(float))


class CoverTree:
    """Simplified cover tree: a node's children cover its points within half its radius bound and lie farther than that apart.

    Points are put into depth-first order, so a node is a range of `order`. Per node: point (its own), low, high (its range), radius
    (to its farthest point), first and last child. Equal points form one leaf, so every leaf has radius 0.
    """

    def __init__(self, x: np.ndarray):
        if x.size and np.abs(x).max() < 1 << 21 and x.shape[1] < 512:
            x = x.astype(np.float64)
        some = min(len(x), 1)
        self.order = np.arange(len(x))
        point, low, high, radius, first, last = [0] * some, [0] * some, [len(x)] * some, [0.0] * some, [0] * some, [0] * some
        todo = [(0, _distances_from(x, self.order, 0))] * some
        while todo:
            node, far = todo.pop()  # far: distances of the node's points, in order, from its own point
            radius[node] = float(far.max())
            if not radius[node]:
                continue
            mine, bound = self.order[low[node] : high[node]], radius[node] / 2
            owner, dist = np.full(len(mine), -1), far.copy()
            owner[far <= bound] = 0
            heads = [point[node]]
            while len(left := np.flatnonzero(owner < 0)):
                head = mine[left[0]]
                d = _distances_from(x, mine[left], head)
                near = d <= bound
                owner[left[near]], dist[left[near]] = len(heads), d[near]
                heads.append(head)
            sort = np.argsort(owner, kind="stable")
            self.order[low[node] : high[node]] = mine[sort]
            ends = np.searchsorted(owner[sort], np.arange(len(heads) + 1)) + low[node]
            first[node], last[node] = len(point), len(point) + len(heads)
            for k, head in enumerate(heads):
                todo.append((len(point), dist[sort][ends[k] - low[node] : ends[k + 1] - low[node]]))
                point.append(int(head)), low.append(int(ends[k])), high.append(int(ends[k + 1]))
                radius.append(0.0), first.append(0), last.append(0)
        self.point, self.low, self.high, self.first, self.last = (np.array(v, np.int64) for v in (point, low, high, first, last))
        self.radius = np.array(radius, float)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of nodes, and for each the position in `nodes` of its parent."""
        n = self.last[nodes] - self.first[nodes]
        parent = np.repeat(np.arange(len(nodes)), n)
        return self.first[nodes][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n), parent


def assign(x: np.ndarray, tree: CoverTree, c: np.ndarray, over: CoverTree, distances: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and exact squared distance of every row of x, and how many distances were computed.

    Pairs of a vector node and a centroid node go down both trees, the wider side first. A pair is dropped if its least possible
    distance exceeds what another pair leaves at most to every vector of the node. Without `distances` (then 0), a vector node that
    has one centroid left goes to it whole.
    """
    best, least = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
    if not len(x):
        return best, least, 0
    # Equal centroids share a leaf; the smallest number of a leaf is the one that counts.
    number = np.array([over.order[a:b].min() for a, b in zip(over.low, over.high, strict=True)])
    v, u = np.zeros(1, np.int64), np.zeros(1, np.int64)
    d = np.sqrt(squared(x[tree.point[v]], c[over.point[u]]).astype(float))
    most, seen = np.full(len(tree.point), np.inf), 1
    leaf_v, leaf_u = [], []
    while len(v):
        np.minimum.at(most, v, d + tree.radius[v])
        keep = d - tree.radius[v] - over.radius[u] <= most[v] * (1 + SLACK) + SLACK
        v, u, d = v[keep], u[keep], d[keep]
        done = (tree.radius[v] == 0) & (over.radius[u] == 0)
        leaf_v.append(v[done]), leaf_u.append(u[done])
        if not distances:
            alone = (np.bincount(v, minlength=len(most))[v] == 1) & (over.radius[u] == 0) & ~done & (tree.radius[v] > 0)
            for a, b, k in zip(tree.low[v[alone]], tree.high[v[alone]], number[u[alone]], strict=True):
                best[tree.order[a:b]] = k
            done |= alone
        v, u, d = v[~done], u[~done], d[~done]
        wide = np.zeros(len(most))
        np.maximum.at(wide, v, over.radius[u])
        down = tree.radius[v] >= wide[v]  # all pairs of a vector node go down on the same side, so that their bounds compare
        stay = ~down & (over.radius[u] == 0)
        kid, of = tree.children(v[down])
        most[kid] = np.minimum(most[kid], most[v[down]][of])
        kid_u, of_u = over.children(u[~down])
        old_v = np.concatenate([v[down][of], v[~down][of_u], v[stay]])
        old_u = np.concatenate([u[down][of], u[~down][of_u], u[stay]])
        d = np.concatenate([d[down][of], d[~down][of_u], d[stay]])
        v, u = np.concatenate([kid, v[~down][of_u], v[stay]]), np.concatenate([u[down][of], kid_u, u[stay]])
        ask = (tree.point[v] != tree.point[old_v]) | (over.point[u] != over.point[old_u])
        seen += int(ask.sum())
        d[ask] = np.sqrt(squared(x[tree.point[v[ask]]], c[over.point[u[ask]]]).astype(float))
    v, u = np.concatenate(leaf_v), np.concatenate(leaf_u)
    if len(v):
        exact = squared(x[tree.point[v]], c[over.point[u]])
        sort = np.lexsort((number[u], exact, v))
        v, u, exact = v[sort], u[sort], exact[sort]
        one = np.flatnonzero(np.diff(v, prepend=-1))
        for a, b, k, e in zip(tree.low[v[one]], tree.high[v[one]], number[u[one]], exact[one], strict=True):
            best[tree.order[a:b]], least[tree.order[a:b]] = k, e
    return best, least, seen + len(v)


_NAMES = ("ids", "vecs", "order", "nodes", "radius")
_BLOCK = "ids binary, vecs binary, order binary, nodes binary, radius binary"


def _pack(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    tree = CoverTree(x)
    nodes = np.stack([tree.point, tree.low, tree.high, tree.first, tree.last])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.record_batch([ids], names=["id"]))
    parts = (sink.getvalue().to_pybytes(), x.astype(np.int32).tobytes(), tree.order.astype(np.int32).tobytes(), nodes.astype(np.int32).tobytes(), tree.radius.tobytes())
    return pa.record_batch([pa.array([p], pa.binary()) for p in parts], names=list(_NAMES))


def _unpack(vecs: bytes, order: bytes, nodes: bytes, radius: bytes, dim: int) -> tuple[np.ndarray, CoverTree]:
    tree = object.__new__(CoverTree)
    tree.order, tree.radius = np.frombuffer(order, np.int32).astype(np.int64), np.frombuffer(radius)
    tree.point, tree.low, tree.high, tree.first, tree.last = np.frombuffer(nodes, np.int32).reshape(5, -1).astype(np.int64)
    return np.frombuffer(vecs, np.int32).reshape(-1, dim).astype(np.int64), tree


def build_blocks(rows: DataFrame, dim: int, block: int) -> DataFrame:
    """Rows (id, x array<long>) as blocks of up to `block` vectors with their cover trees, made where the rows lie, without a shuffle."""

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            return _pack(t.column(0).combine_chunks(), t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim))

        for b in it:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                if n + part.num_rows > block:
                    yield out()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield out()

    return bounded_batches(stage(rows.mapInArrow(build, _BLOCK)))


def _sums(blocks: DataFrame, centroids: list[list[int]], dim: int) -> dict[int, tuple[int, list[int]]]:
    """Per centroid number the count and componentwise sums of the vectors nearest to it; k * (dim + 1) numbers a task."""
    c = np.array(centroids, np.int64)
    k = len(c)

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree(c)
        total, most = np.zeros((k, dim + 1), object), np.zeros((k, dim + 1), np.int64)
        for b in it:
            for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in _NAMES[1:]), strict=True):
                x, tree = _unpack(*row, dim)
                near, _, _ = assign(x, tree, c, over, distances=False)
                most[:] = 0
                np.add.at(most, near, np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
                total = total + most  # whole numbers of any size
        cluster, part = np.nonzero(np.repeat(total[:, :1] > 0, dim + 1, axis=1))
        yield pa.record_batch([pa.array(cluster.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array([str(t) for t in total[cluster, part]])], names=["cluster", "part", "total"])

    got = blocks.select(*_NAMES[1:]).mapInArrow(partial, "cluster int, part int, total string")
    rows = got.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["cluster"], [0] * (dim + 1))[r["part"]] = int(r["total"])
    return {i: (t[0], t[1:]) for i, t in out.items()}


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", block: int = 512
) -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector of dim finite components.

    Components count as floor(scale * x). Centroids start as the k vectors with the least sha256 of "<seed>:<id>" (null ids last,
    ties by the vector), take the exact floored means of their vectors each round, ties go to the smaller number, and empty ones stay.
    Every row is a vector: repeated rows each count and each return. Vectors that are null, of another length or hold null or
    non-finite components take no part. Fewer than k vectors are each a centroid; an empty table gives no rows. Components of 2**27
    or more after scaling are refused, as squared distances would leave 64 bits.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size("x") == dim) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("x")).filter(F.col("x").isNotNull()).filter(fine)
    small = F.when(F.forall("x", lambda e: F.abs(e * scale) < MOST), F.transform("x", lambda e: F.floor(e * scale)))
    rows = rows.withColumn("x", F.coalesce(small, F.raise_error(F.lit("a scaled component is 2**27 or more")).cast("array<bigint>")))
    id_type, spark = rows.schema["id"].dataType, rows.sparkSession
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = [list(r["x"]) for r in rows.withColumn("h", order).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]
    out = StructType([StructField("id", id_type), *(StructField(n, LongType()) for n in ("cluster", "distance"))])
    if not centroids:
        near = spark.createDataFrame([], out)
    else:
        blocks = build_blocks(rows, dim, block)
        for _ in range(rounds):
            moved = [list(c) for c in centroids]
            for i, (n, total) in _sums(blocks, centroids, dim).items():
                moved[i] = [t // n for t in total]
            if moved == centroids:
                break
            centroids = moved
        c = np.array(centroids, np.int64)

        def last(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            over = CoverTree(c)
            for b in it:
                for ids, *row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in _NAMES), strict=True):
                    x, tree = _unpack(*row, dim)
                    number, d, _ = assign(x, tree, c, over)
                    yield pa.record_batch([pa.ipc.open_stream(ids).read_all().column(0).combine_chunks(), pa.array(number), pa.array(d)], names=["id", "cluster", "distance"])

        near = stage(blocks.mapInArrow(last, out))
    inertia = {r["cluster"]: int(r["total"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    facts = [(i, t, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, t in inertia.items()]
    known = spark.createDataFrame(facts, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = near.join(F.broadcast(known), "cluster")  # at most k rows
    return joined.select(F.col("id").alias(id_col), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
