"""From raw documents to token ids, in five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import runtime
from millrace.llm import decontaminate, jaccard_join, language_id, secret_scan, sentencepiece_nbest


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the rest goes."""
    return language_id.keep_identified(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity, the one with the smallest doc_id.

    Near-duplicates of the stage have a Jaccard similarity of 0.8 or more on five-word shingles;
    four words and 0.85 are op9's contract only.
    Rows that repeat are one document. A row without a doc_id stays unless its group has an id.
    """
    groups = jaccard_join.links_and_components(docs, shingle=5, percent=80)
    key = F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("_id"), F.col("th").alias("_th")).distinct()
    rows = docs.select("*", key.alias("_id"), F.xxhash64("text").alias("_th"))
    return rows.join(keep, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    rows = sentencepiece_nbest.round_trip(docs)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identified),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", decontaminated),
    ("secret_scan", redacted),
    ("sentencepiece", encoded),
]

#: Trained models and lattices are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    work = runtime.Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
