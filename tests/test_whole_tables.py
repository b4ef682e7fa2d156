"""Queries that take their whole table."""

import numpy as np

from stratavox.plans.queries import QUERIES
from stratavox.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_rows_of_whole_tables(spark):
    assert QUERIES["metres_and_ranges"](spark, SF).count() == A.points(spark, SF).count()
    poses = {(r.session, r.seq) for r in A.poses(spark, SF).collect()}
    got = QUERIES["pose_predict"](spark, SF).collect()
    assert {(r.session, r.seq) for r in got} == poses and len(got) == len(poses)


def test_every_20th_vector_is_searched(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.floor(np.array([r.embedding for r in rows], np.float32).astype(float) * 10000).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        d2 = ((v - v[q]) ** 2).sum(1)
        want |= {(int(ids[q]), int(ids[j]), k) for k, j in enumerate(np.lexsort((ids, d2))[:5], 1)}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in QUERIES["knn5_embeddings"](spark, SF).collect()} == want


def test_vectors_in_tiles_with_ties_copies_and_missing_components(spark, tmp_path):
    import duckdb

    from stratavox.operators.neighbours import vector_knn
    from stratavox.plans.queries import ORACLE_SQL

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 64) / 8]) for i in range(300)] + [(1000 + i, [0.25] * 64) for i in range(60)]
    rows += [(2000, [0.5] * 63 + [None]), (2020, [0.5] * 10), (2040, [1000.0] * 64), (2041, None), (2060, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(duck.execute(ORACLE_SQL["knn5_embeddings"]).fetchall())
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    for found in (QUERIES["knn5_embeddings"](spark, str(tmp_path)), vector_knn(v, v.filter("vec_id % 20 = 0"), 5, 64, 10000, 7, 50)):
        assert {(r.query_id, r.vec_id, r.d2, r["rank"]) for r in found.collect()} == want and found.filter("d2 is null").count() == 5
