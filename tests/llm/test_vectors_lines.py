"""Clustering, whitening and line dedup against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from stratavox.llm import line_dedup as LD
from stratavox.llm import queries as Q
from stratavox.llm.dual_tree import CoverTree, assign, cluster_vectors
from stratavox.llm.line_dedup import FilterPair, drop_repeated_lines, merge_slice
from stratavox.llm.whitening import whiten


def lloyd_by_brute_force(rows, k=40, rounds=5, dim=64, scale=256, seed="2"):
    """rows: (id, list). Whole-number Lloyd with every distance computed."""
    kept = [(i, [math.floor(float(c) * scale) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    cent = [list(v) for _, v in start]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min((d2(v, c), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cent = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cent)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in out:
        inertia[n] += d
    return Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cent[n])).encode()).hexdigest()) for i, n, d in out)


def clustered(spark, rows, **options):
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, cluster string, id int")
    got = cluster_vectors(d, **options)
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"block": 7, "k": 5, "rounds": 3}, {"block": 64, "k": 1}], ids=["defaults", "small_blocks", "one_centroid"])
def test_clusters_against_brute_force(spark, options):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 4))
    rows = [(i, (middle[i % 6] + 0.05 * rng.normal(size=4)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(3, rows[3][1])] * 3 + [(3, rows[9][1]), (None, rows[2][1]), (None, rows[4][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0, 3.0]), (2003, [1.0, None, 0.0, 0.0]), (2004, [math.nan, 0.0, 0.0, 0.0]), (2005, [math.inf, 0.0, 0.0, 0.0]), (2006, [0.0] * 4)]
    rows += [(3000 + i, [float(i % 3) / 256, float(i // 3) / 256, 0.0, -0.001]) for i in range(9)]  # many ties
    want = lloyd_by_brute_force(rows, dim=4, **{n: v for n, v in options.items() if n != "block"})
    assert clustered(spark, rows, dim=4, **options) == want


def test_cluster_query_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(120)] + [(500 + i, [0.25] * 64) for i in range(40)]
    monkeypatch.setattr(Q, "table", lambda *_: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in Q.op11_dual_tree_lloyd(spark, "").collect())
    assert got == lloyd_by_brute_force([(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows])


def test_clusters_of_few_rows_empty_tables_and_large_numbers(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.25, 0.0])]
    assert clustered(spark, rows, dim=2) == lloyd_by_brute_force(rows, dim=2)
    assert clustered(spark, [(1, None)], dim=2) == Counter() == clustered(spark, [], dim=2)
    large = [(i, [float((i * 7919) % 400_000), -float(i)]) for i in range(60)]
    assert clustered(spark, large, dim=2, k=4) == lloyd_by_brute_force(large, k=4, dim=2)
    with pytest.raises(Exception, match="2\\*\\*27"):
        clustered(spark, [(1, [1e9, 0.0])], dim=2)


def test_cover_tree_covers_separates_and_prunes():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(20, 3)) * 4000).astype(np.int64).repeat(40, 0) + rng.integers(-30, 30, (800, 3))
    x[5] = x[4]
    tree = CoverTree(x)
    for node in range(len(tree.point)):
        mine = tree.order[tree.low[node] : tree.high[node]]
        d = np.sqrt(((x[mine] - x[tree.point[node]]) ** 2).sum(1).astype(float))
        assert abs(d.max() - tree.radius[node]) < 1e-6 and tree.point[node] in mine
        kids = np.arange(tree.first[node], tree.last[node])
        if len(kids):
            assert sorted(np.concatenate([tree.order[tree.low[k] : tree.high[k]] for k in kids])) == sorted(mine)
            heads = x[tree.point[kids]]
            gaps = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(2).astype(float)) + np.eye(len(kids)) * 1e18
            assert (tree.radius[kids] <= tree.radius[node] / 2 + 1e-6).all() and (len(kids) == 1 or gaps.min() > tree.radius[node] / 2 - 1e-6)
    c = x[::40].copy()
    c[3] = c[2]
    near, least, seen = assign(x, tree, c, CoverTree(c))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (near == full.argmin(1)).all() and (least == full.min(1)).all()
    quick, _, fewer = assign(x, tree, c, CoverTree(c), distances=False)
    assert (quick == near).all() and fewer < seen < full.size / 2  # most pairs are ruled out


def whitened(spark, rows, dtype="float", **options):
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id bigint, embedding array<{dtype}>, d string")
    got, facts = whiten(d, **options)
    return [(r.vec_id, int(r.deviation), np.array(r.whitened)) for r in got.collect()], facts


def test_whitening_against_whole_numbers(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(base)]
    rows += [(7, rows[7][1])] * 2 + [(None, rows[8][1]), (None, rows[9][1]), (9_007_199_254_740_993, rows[1][1])]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] + [0.0] * 5), (903, [1.0, 2.0]), (904, [])]
    got, facts = whitened(spark, rows + odd, components=5)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert Counter((i, d) for i, d, _ in got) == Counter((i, d) for (i, _), d in zip(rows, deviation, strict=True))
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    want = (centred @ axes[:, ::-1] / np.sqrt(values[::-1]))[:, :5]
    mine = {(i, d): w for i, d, w in got}
    for (i, _), d, w in zip(rows, deviation, want, strict=True):
        assert np.allclose(np.abs(mine[i, d]), np.abs(w), rtol=1e-9, atol=1e-9)
    w = np.array([v for _, _, v in got])
    assert np.abs(w.T @ w / n - np.eye(5)).max() < 1e-9 and facts["identity_error"] < 1e-9 and facts["n"] == n
    assert np.allclose(facts["explained"], values[::-1][:5] / values.sum(), rtol=1e-9)


def test_whitening_of_flat_large_and_empty_tables(spark):
    same, facts = whitened(spark, [(i, [0.5, 0.25]) for i in range(5)])
    assert [(d, w.tolist()) for _, d, w in same] == [(0, [0.0, 0.0])] * 5 and facts["explained"] == [0.0, 0.0] and facts["identity_error"] == 0.0
    line, facts = whitened(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)])
    assert facts["identity_error"] < 1e-9 and all(w[1] == w[2] == 0 for _, _, w in line) and facts["explained"][0] == pytest.approx(1)
    wide = [(i, [float(10**9 * i), float(-(10**9) * i * i)]) for i in range(4)]  # deviations beyond 64 bits
    got, _ = whitened(spark, wide, "double")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in wide]
    s = [sum(col) for col in zip(*x, strict=True)]
    assert sorted(d for _, d, _ in got) == sorted(sum((4 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x)
    assert whitened(spark, [])[0] == [] == whitened(spark, [(1, None)])[0]


def test_whitening_query(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(90)]
    monkeypatch.setattr(Q, "table", lambda *_: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = Q.op12_rowmatrix_whitening(spark, "")
    out = got.toPandas()
    assert len(out) == 90 * 32 and sorted(out["component"].unique()) == list(range(1, 33)) and set(out["n"]) == {90}
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / 90 - np.eye(32)).max() < 1e-8 and out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-8
    monkeypatch.setattr(Q, "table", lambda *_: spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert Q.op12_rowmatrix_whitening(spark, "").schema == got.schema and Q.op12_rowmatrix_whitening(spark, "").count() == 0


def kept_by_brute_force(rows, min_docs, min_chars=1, keep_first=False):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    n, first = Counter(), {}
    for i, t in rows:
        seen = set()
        for at, x in enumerate((t or "").split("\n")):
            if len(k := key(x)) >= min_chars:
                seen.add(k)
                place = (i is not None, i or 0, at)
                first[k] = min(first.get(k, place), place)
        n.update(seen)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [n[key(x)] >= min_docs and len(key(x)) >= min_chars and not (keep_first and first[key(x)] == (i is not None, i or 0, at)) for at, x in enumerate(lines)]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return Counter(out)


def line_rows():
    rng = random.Random(3)
    common = ["Hot line", "  hot LINE\t", "ÄRGER", "ärger", "two", "a\x0b", "\x0bA\x0c", " two", "", " ", "\r", "x" * 5000]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.4 else f"own {rng.randint(0, 400)}" for _ in range(rng.randint(1, 30)))) for i in range(300)]
    rows += [(i, "hot line\nhot line\nseldom") for i in range(5)] + [(None, "two\nseldom"), (None, None), (1000, None), (1001, ""), (1002, "\n"), (1003, "\n".join(f"long {k % 5000}" for k in range(40_000)))]
    return rows + [(2000 + i, f"nine {i % 9}\nten times\nÀ") for i in range(10)]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"max_bits": 1 << 10}, {"max_bits": 1 << 12, "broadcast_bytes": 0, "keep_first": True}, {"keep_first": True, "min_chars": 4, "min_docs": 2}], ids=["filters", "joined", "hash_counts", "joined_first", "first_of_long_keys"])
def test_lines_against_brute_force(spark, options):
    rows = line_rows()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, line int, key int").repartition(5)
    options = {"min_docs": 10} | options
    got = Counter(tuple(r) for r in drop_repeated_lines(d, **options).collect())
    assert got == kept_by_brute_force(rows, options["min_docs"], options.get("min_chars", 1), options.get("keep_first", False))


def test_lines_in_many_small_parts(spark, monkeypatch):
    monkeypatch.setattr(LD, "MOST_KEYS", 3)
    rows = [(i, "all\nsome" if i % 2 else f"all\nown {i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(30)
    assert Counter(tuple(r) for r in drop_repeated_lines(d, min_docs=30).collect()) == kept_by_brute_force(rows, 30)


def test_line_query_and_empty_tables(spark, monkeypatch):
    rows = [r for r in line_rows() if r[0] is not None]
    monkeypatch.setattr(Q, "table", lambda *_: spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = Counter(tuple(r) for r in Q.op13_bloom_line_dedup(spark, "").collect())
    assert got == Counter((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for (i, n, g, t), c in kept_by_brute_force(rows, 10).items() for _ in range(c))
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert drop_repeated_lines(empty).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 12, "doc_id bigint, text string")
    assert [tuple(r) for r in drop_repeated_lines(nulls).collect()] == [(None, 1, 0, "")] * 12


def test_filters_never_miss_a_repeat_whichever_way_they_merge():
    rng = np.random.default_rng(4)
    tasks = [rng.integers(0, 3000, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(6)]
    n = Counter(h for t in tasks for h in t.tolist())
    again = np.array([h for h, c in n.items() if c > 1], np.uint64)
    for order in (range(6), (3, 1, 5, 0, 2, 4)):
        held, pairs = None, []
        for t in tasks:
            pair = FilterPair(1 << 16)
            pair.add(t[:200]), pair.add(t[200:])
            pairs.append(pair)
        for k in order:
            held = merge_slice(held, pairs[k].once, pairs[k].twice)
        whole = FilterPair(1 << 16)
        whole.twice = held[1]
        assert whole.suspects(again).all()
    single = np.array([h for h, c in n.items() if c == 1], np.uint64)
    assert whole.suspects(single).mean() < 0.1
