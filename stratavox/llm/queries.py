"""The registered queries of the text operators: each applies one operator to its whole table and derives its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.ann import nearest_neighbours
from stratavox.llm.bm25 import search_bm25
from stratavox.llm.common import crc_mod, table
from stratavox.llm.dual_tree import cluster_vectors
from stratavox.llm.html_extract import extract_html
from stratavox.llm.language import fit_languages, identify_language
from stratavox.llm.line_dedup import drop_repeated_lines
from stratavox.llm.near_dedup import near_duplicate_classes
from stratavox.llm.packing import assign_sequences, tokenize_pieces
from stratavox.llm.pii import KINDS, find_pii
from stratavox.llm.quality import fit_quality, score_quality
from stratavox.llm.substring_dedup import remove_repeats
from stratavox.llm.subword import encode_documents
from stratavox.llm.whitening import whiten


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, keep=("doc_id",))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search_bm25(docs, docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), query_terms=None)


def op5_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_language(docs, fit_languages(docs))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer_file())
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return assign_sequences(pieces)


def _of_kind(kind: str):
    return lambda span: span.startswith(f"{kind}:")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    # The counts are those of the grammars, as base_sha256; what the method adds is in spans only.
    counts = [F.size(F.filter(F.split("base", ","), _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), check=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "round_trip")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_html(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_rowmatrix_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, facts = whiten(table(spark, sf_dir, "embeddings"))
    long = rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, facts["explained"])), F.col("at") + 1) if facts["n"] else F.lit(0.0)
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(facts["n"]).cast("long").alias("n"), "deviation",
        "whitened", explained.cast("double").alias("explained"), F.lit(facts["identity_error"]).alias("identity_error"),
    )


def op13_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"), min_chars=1, min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_prob_minhash": op3_prob_minhash,
    "op4_bm25_block_max": op4_bm25_block_max,
    "op5_pruned_graph_ann": op5_pruned_graph_ann,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_streaming_viterbi": op9_streaming_viterbi,
    "op10_html_extract": op10_html_extract,
    "op11_dual_tree_lloyd": op11_dual_tree_lloyd,
    "op12_rowmatrix_whitening": op12_rowmatrix_whitening,
    "op13_bloom_line_dedup": op13_bloom_line_dedup,
}


def _lloyd_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2") -> str:
    """Lloyd with every distance computed, one pair of steps a round."""
    nearest = "SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c, list_sum(list_transform(list_zip(kept.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, m{0} AS m) GROUP BY r"
    means = "SELECT m.c, coalesce(g.x, m.x) AS x FROM m{0} AS m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT best.c AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{0} JOIN kept USING (r), range(1, {1}) AS t(i) GROUP BY ALL) GROUP BY c) AS g ON g.c = m.c"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dim})",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM kept QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(n)})")
        if n < rounds:
            steps.append(f"m{n + 1} AS MATERIALIZED ({means.format(n, dim + 1)})")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN m{rounds} ON m{rounds}.c = best.c"
    )


_LINES_SQL = """WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (k) GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {"op11_dual_tree_lloyd": _lloyd_sql(), "op13_bloom_line_dedup": _LINES_SQL}
