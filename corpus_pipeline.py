"""From raw documents to packed training sequences: five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import stored
from lintlake.llm.decontaminate import clean_documents
from lintlake.llm.jaccard_join import one_of_each
from lintlake.llm.lines import LineIndex
from lintlake.llm.packing import pack_documents
from lintlake.llm.toxicity import learn, score_documents, training_labels

# Learned scores, filters and packing are beyond SQL; a test holds the stages against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the toxicity model predicts as toxic."""
    model = learn(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    carry = tuple(c for c in docs.columns if c != "doc_id")
    kept = score_documents(docs.withColumnsRenamed({c: f"in_{c}" for c in carry}).withColumn("text", F.col("in_text")), model,
                           tuple(f"in_{c}" for c in carry)).where("predicted = 0")
    return kept.select(*[F.col(c if c == "doc_id" else f"in_{c}").alias(c) for c in docs.columns])


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many documents share out of all but the last; no document goes."""
    rows = LineIndex(spark).insert(docs).dedup(docs)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies."""
    return one_of_each(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that contain a benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences. Null and empty texts are one token; repeated rows are packed each; no rows give none."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_common_lines), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_benchmark_leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs.

    Each stage's rows are written and read again. Rows with a null doc_id and further columns, whatever their names, go through all
    stages; of rows that repeat a doc_id each is judged by its own text, but for near copies, where they stay or go together. Null and
    empty texts count as copies of each other. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
