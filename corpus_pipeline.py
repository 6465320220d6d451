"""The corpus pipeline: STAGES in order, each over all rows that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A table without rows passes through; other columns of ``docs`` don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reckonry.llm.keys import written_keys
from reckonry.llm.op01_pieces import encode_column, public_vocabulary
from reckonry.llm.op02_decontaminate import leaks
from reckonry.llm.op04_quality import kept_rows
from reckonry.llm.op07_neardup import MinHash, near_duplicates
from reckonry.llm.op08_secrets import redacted_rows
from reckonry.plans.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go. Null and empty texts have no words and go too."""
    return kept_rows(docs.select(*COLUMNS))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id.

    Near means a similarity of 0.8, as for all stages on word shingles. Rows that repeat a doc_id give way
    to one of them; rows with a null doc_id stay.
    """
    judged = stage(near_duplicates(docs, MinHash(percent=80)), "judged").where("doc_id is not null").groupBy("doc_id").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone, again = written_keys(judged.where("not kept").select("doc_id"), "gone"), written_keys(judged.where("n > 1").select("doc_id"), "repeated")
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    once = left.join(again, "doc_id", "left_anti")
    repeated = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return once.unionByName(repeated).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(*COLUMNS).join(written_keys(found.select("doc_id").distinct(), "leaking"), "doc_id", "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows the text."""
    return redacted_rows(docs.select(*COLUMNS))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text's pieces, and whether decoding gives the text again."""
    return encode_column(docs.select(*COLUMNS), public_vocabulary())


STAGES = [
    ("quality", quality),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("pieces", pieces),
]
#: Novelty under zstandard and Viterbi over a vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
