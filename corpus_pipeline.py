"""A corpus pipeline: language, near-duplicates, benchmark passages, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns what it kept; ``run`` writes every stage's result as Parquet in the
shared folder and reads it back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import fmindex, langid, pieces, secrets_forest, simhash
from orrery.llm.helpers import short_batches, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a recognisable language."""
    short_batches(spark)
    return langid.recognised(docs, langid.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near-duplicates: fingerprints of three-word shingles, at most 3 bits apart."""
    short_batches(spark)
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages of the benchmark out of the texts."""
    short_batches(spark)
    return fmindex.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in the texts."""
    short_batches(spark)
    return secrets_forest.redact(docs, secrets_forest.train(docs))


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and checksum of the pieces of every document, and whether they decode to its text."""
    short_batches(spark)
    found = pieces.tokenise(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARKER), F.lit(" "))
    return found.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == plain).alias("round_trip"))


STAGES = [
    ("language identification", known_language),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("pieces", in_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
# A kernel classifier, fingerprints, a forest and a Viterbi search are not for SQL; the test runs the stages by brute force.
ORACLE_SQL = None
ORACLES: dict[str, str] = {}
