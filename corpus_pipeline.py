"""Documents to packed training sequences in five stages, each one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.common import free_names, stage, table
from stratavox.llm.near_dedup import drop_near_duplicates
from stratavox.llm.packing import assign_sequences, tokenize_pieces
from stratavox.llm.pii import redact_pii
from stratavox.llm.quality import fit_quality, score_quality
from stratavox.llm.queries import tokenizer_file
from stratavox.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    score, predicted = free_names(docs.columns, "_score", "_predicted")
    return score_quality(docs, model, out=(score, predicted)).filter(F.col(predicted) == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return drop_near_duplicates(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes go from the texts; null texts become empty, n_chars follows, all rows stay."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = remove_repeats(docs, keep=others, as_text=True)
    return kept.select("doc_id", *others, F.col("kept").alias("text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; n_chars follows."""
    return redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; ids are little-endian unsigned 32-bit integers."""
    return assign_sequences(tokenize_pieces(docs, tokenizer_file()))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", pii), ("packing", packing)]

#: SQL expresses none of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
