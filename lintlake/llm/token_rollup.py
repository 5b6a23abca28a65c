"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch of changes is summed by group before it is stored: an insertion adds a document and its tokens, a deletion takes
them off, a revised count adds the difference. A batch is one folder, written under its id and valid once Spark has
committed it; the same id again changes nothing, so a job that was cut off can be run again. Totals are the sum of all
committed deltas. No document is read again to keep them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import shared_folder, sliced
from lintlake.llm.tokens import count_of, vocabulary_path

GROUP = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs long, tokens long"


def token_counts(docs: DataFrame, versions: tuple[str, ...] = ("byte_bpe_50k",), paths: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, version, n_bytes, tokens: one row per document and tokenizer version.

    Whole texts are counted; null and empty texts have no tokens. Null ids, sources and languages are kept as null.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            for version in versions:
                path = (paths or {}).get(version) or vocabulary_path(version)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in ("doc_id", "source", "lang")], pa.array([version] * len(texts), pa.string()),
                     pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([count_of(t, path) for t in texts], pa.int64())],
                    names=["doc_id", "source", "lang", "version", "n_bytes", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, source string, lang string, version string, n_bytes long, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add the counted documents. A repeated row adds once more; null groups stay groups; no rows give no changes."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take the counted documents off, row by row: what ``inserts`` added of the same rows sums to nothing."""
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(counts: DataFrame, was: str = "was") -> DataFrame:
    """Changes of documents whose count was ``was`` and is ``tokens``. A null on either side gives a null, which a total passes over."""
    return counts.select(*GROUP, F.lit(0).cast("long").alias("docs"), (F.col("tokens") - F.col(was)).alias("tokens"))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_folder(spark).rstrip('/')}/tables/token-rollup-{uuid.uuid4().hex}"

    def _folders(self) -> dict[str, str]:
        """Committed batches by id. A folder without Spark's success mark is the rest of a failed run."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return {}
        return {s.getPath().getName().removeprefix("batch="): s.getPath().toString() for s in files.listStatus(root)
                if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes (source, lang, version, docs, tokens); False if the id is committed already.

        Rows of a group are summed, null sources, languages and versions being groups of their own. A batch without rows is
        committed too, and adds nothing.
        """
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id has letters, digits, - and _ only")
        if batch_id in self._folders():
            return False
        delta = changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")  # one row per group
        return True

    def totals(self) -> DataFrame:
        """Current docs and tokens of every group that has any."""
        folders = sorted(self._folders().values())
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*folders).groupBy(*GROUP).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
