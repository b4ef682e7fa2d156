"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard of vectors.

Points enter in batches: a greedy beam search on the graph so far proposes neighbours, relaxed distance pruning keeps a diverse
few, and reverse edges are pruned alike. Each shard's graph is stored; queries beam-search every shard in blocks, and the
shards' best are merged by exact double-precision distance on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.llm.common import stage


def beam_search(vecs: np.ndarray, norms: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int, entry: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and squared distances of the `beam` nearest found (-1 where fewer), and the points expanded, a row for each query."""
    q, n = len(queries), len(vecs)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    qn = (queries * queries).sum(1)
    dist[:, 0] = norms[entry] - 2 * queries @ vecs[entry] + qn
    walked = []
    while True:
        live = np.flatnonzero(~done.all(axis=1))
        if not len(live):
            break
        at = np.argmin(done[live], axis=1)  # beams are sorted, so the first open one is nearest
        done[live, at] = True
        pick = ids[live, at]
        step = np.full(q, -1, np.int64)
        step[live] = pick
        walked.append(step)
        near = graph[pick]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], near[rows, cols]] = True
        d = np.full(near.shape, np.inf, np.float32)
        v = near[rows, cols]
        d[rows, cols] = norms[v] - 2 * np.einsum("ij,ij->i", vecs[v], queries[live[rows]]) + qn[live[rows]]
        all_d = np.concatenate([dist[live], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), order, 1)
    return ids, dist, np.stack(walked, 1)


def robust_prune(vecs: np.ndarray, p: int, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Nearest first, drops every later candidate that is alpha times nearer to a kept neighbour than to p."""
    pool = np.unique(pool)
    pool = pool[(pool >= 0) & (pool != p)]
    if not len(pool):
        return pool
    x = vecs[pool]
    d = ((x - vecs[p]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")[: 8 * degree]
    pool, x, d = pool[order], x[order], d[order]
    sq = (x * x).sum(1)
    between = sq[:, None] + sq[None, :] - 2 * (x @ x.T)
    limit, kept, open_ = d / (alpha * alpha), [], np.ones(len(pool), bool)
    for i in range(len(pool)):
        if open_[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            open_ &= between[i] > limit
    return pool[kept]


def build_graph(vecs: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, seed: int = 5) -> tuple[np.ndarray, int]:
    """Out-neighbours (rows padded with -1) and the entry point, the one nearest to the mean."""
    n = len(vecs)
    norms = (vecs * vecs).sum(1)
    room = 2 * degree
    graph, size = np.full((n, room), -1, np.int64), np.zeros(n, np.int64)
    entry = int(np.argmin(((vecs - vecs.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, batch = 1, 1
    while at < n:
        points = order[at : at + batch]
        found, _, walked = beam_search(vecs, norms, graph, vecs[points], beam, entry)
        back: dict[int, list[int]] = {}
        for i, p in enumerate(points):
            near = robust_prune(vecs, p, np.concatenate([found[i], walked[i]]), degree, alpha)
            graph[p, : len(near)], size[p] = near, len(near)
            for v in near.tolist():
                back.setdefault(v, []).append(int(p))
        for v, extra in back.items():
            have = graph[v, : size[v]]
            new = np.setdiff1d(np.array(extra), have)
            if size[v] + len(new) <= room:
                graph[v, size[v] : size[v] + len(new)] = new
                size[v] += len(new)
            else:
                near = robust_prune(vecs, v, np.concatenate([have, new]), degree, alpha)
                graph[v] = -1
                graph[v, : len(near)], size[v] = near, len(near)
        at += len(points)
        batch = min(2 * batch, 256, max(16, at // 4))
    return graph, entry


def _clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, vector) rows that can take part: no null id, no null or empty vector, finite components, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.filter(fine).distinct()


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, shard_size: int = 4000, degree: int = 24, beam: int = 100, block: int = 128, blocks_per_group: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row that is_query holds for (a condition on "id").

    Score is the Euclidean distance in double precision; ties go to the smaller id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do null ids; rows equal in id and vector count once. Of rows equal in id only, each
    is a point and each a query; the id is listed once, at the least distance found, and never for itself. Vectors of different
    lengths are never compared. Equal vectors are one point of the graph, with its k + 1 least ids, so copies cost and hide nothing.
    """
    rows = stage(_clean(vectors, id_col, vec_col))
    spark = rows.sparkSession
    salted = Window.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("vec").orderBy("id")
    least = rows.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k + 1)
    points = stage(least.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-points.count() // shard_size))
    points = points.withColumn("shard", F.concat_ws("-", F.size("vec"), F.pmod(F.xxhash64("vec"), F.lit(shards))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        exact = np.stack(pdf["vec"].to_numpy())
        graph, entry = build_graph(exact.astype(np.float32), degree)
        ids = np.full((len(pdf), k + 1), -1, np.int64)
        for i, x in enumerate(pdf["ids"]):
            ids[i, : len(x)] = x
        count = np.array([len(x) for x in pdf["ids"]], np.int64)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [exact.shape[1]], "entry": [entry], "vecs": [exact.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "ids": [ids.tobytes()], "counts": [count.tobytes()]})

    graphs = stage(points.groupBy("shard").applyInPandas(build, "shard string, dim int, entry int, vecs binary, graph binary, ids binary, counts binary"))

    queries = rows.filter(is_query)
    n_queries = max(1, queries.count())
    n_blocks = -(-n_queries // block)
    q = queries.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("blk"), F.size("vec").alias("dim"))
    blocks = q.groupBy("dim", "blk").agg(F.collect_list(F.struct("id", "vec")).alias("qs"))  # about `block` queries
    groups = -(-n_blocks // blocks_per_group)
    # Every block goes to every shard of its length, under a key of shard and group, so that no key holds more than blocks_per_group blocks.
    each = blocks.withColumn("grp", F.pmod("blk", F.lit(groups))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    to = each.select(F.concat_ws("-", "dim", "part").alias("to"), F.col("grp").alias("to_grp"), "qs")
    held = graphs.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("grp", F.col("grp").cast(to.schema["to_grp"].dataType))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            g = left.iloc[0]
            exact = np.frombuffer(g["vecs"]).reshape(-1, g["dim"])
            vecs, graph = exact.astype(np.float32), np.frombuffer(g["graph"], np.int32).reshape(len(exact), -1).astype(np.int64)
            ids, counts = np.frombuffer(g["ids"], np.int64).reshape(len(exact), k + 1), np.frombuffer(g["counts"], np.int64)
            norms = (vecs * vecs).sum(1)
            for qs in right["qs"]:
                qid = np.array([x["id"] for x in qs], np.int64)
                qv = np.stack([x["vec"] for x in qs])
                found, _, _ = beam_search(vecs, norms, graph, qv.astype(np.float32), max(beam, k + 1), int(g["entry"]))
                for i in range(len(qid)):
                    near = found[i][found[i] >= 0]
                    d = np.sqrt(((exact[near] - qv[i]) ** 2).sum(1))
                    hits = [(s, int(x)) for s, v in zip(d.tolist(), near, strict=True) for x in ids[v, : counts[v]] if x != qid[i]]
                    for s, x in sorted(hits)[:k]:
                        out["query_id"].append(int(qid[i]))
                        out["vec_id"].append(x)
                        out["score"].append(s)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    hits = held.groupBy("shard", "grp").cogroup(to.groupBy("to", "to_grp")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
