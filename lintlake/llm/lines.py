"""Reversible line deduplication: exact reference counts with sharded cuckoo filters in front.

The index is a folder in shared storage. Its exact side are postings (line key, document) and reference counts (key,
number of documents, largest document); both take insertions and document deletions. In front of it stands one cuckoo
filter per shard of the key space that holds the keys which are common enough to be dropped; a cuckoo filter can also
forget, so deletions keep it small. Deduplicating asks the filters first: only lines that they know, true ones and a few
false ones, are shuffled to meet the exact counts, which decide.

Every change writes a new version of the tables and then names it in ``CURRENT``, so a failed run changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import shared_folder, sliced

BLANKS = " \t\n\x0b\x0c\r"
NULL_ID = -(2**63)
SLOTS, KICKS = 4, 500


def line_key(line: str, min_chars: int = 40) -> bytes | None:
    """128-bit key of a line, blank-stripped and with A-Z in lower case; None if it is shorter than ``min_chars``."""
    line = line.strip(BLANKS)
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(line) >= min_chars else None


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets. Supports insertion, deletion and vectorised lookup."""

    def __init__(self, keys: int) -> None:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(keys, 1) / SLOTS / 0.8 + 1))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        prints = (halves[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = halves[:, 1] % np.uint64(len(self.table))
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        spread = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        return (bucket ^ spread) & np.uint64(len(self.table) - 1)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        prints, first, second = self._places(keys)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def insert(self, key: bytes) -> bool:
        """False if the filter is too full; it must then be rebuilt larger from the exact table."""
        prints, first, second = self._places([key])
        value = prints[0]
        for bucket in (int(first[0]), int(second[0])):
            free = np.nonzero(self.table[bucket] == 0)[0]
            if len(free):
                self.table[bucket, free[0]] = value
                return True
        bucket = int(second[0])
        for kick in range(KICKS):
            slot = kick % SLOTS
            value, self.table[bucket, slot] = self.table[bucket, slot], value
            bucket = int(self._other(np.array([bucket], np.uint64), np.array([value], np.uint16))[0])
            free = np.nonzero(self.table[bucket] == 0)[0]
            if len(free):
                self.table[bucket, free[0]] = value
                return True
        return False

    def delete(self, key: bytes) -> None:
        """Forget one insertion of a key that was inserted."""
        prints, first, second = self._places([key])
        for bucket in (int(first[0]), int(second[0])):
            held = np.nonzero(self.table[bucket] == prints[0])[0]
            if len(held):
                self.table[bucket, held[0]] = 0
                return


def shard_of(key: bytes, shards: int) -> int:
    """Spark's ``pmod(xxhash64(key), shards)``."""
    number = xxhash.xxh64_intdigest(key, 42)
    return (number - (1 << 64) if number >> 63 else number) % shards


def known_keys(keys: list[bytes], filters: dict[int, CuckooFilter], shards: int) -> np.ndarray:
    """Which keys their shard's filter knows."""
    where = np.array([shard_of(k, shards) for k in keys], np.int64)
    passed = np.zeros(len(keys), bool)
    for shard in np.unique(where).tolist():
        if shard in filters:
            at = np.nonzero(where == shard)[0]
            passed[at] = filters[shard].contains([keys[i] for i in at.tolist()])
    return passed


def _postings(docs: DataFrame, min_chars: int, shared: Broadcast | None = None, shards: int = 0) -> DataFrame:
    """(key, doc_id) of the documents' long lines, once per row; a null id counts as the smallest.

    With ``shared`` filters only of the lines that these know: asked here, so that a task needs one Python worker.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if shared is None else {s: CuckooFilter.from_bytes(b) for s, b in shared.value.items()}
        for batch in sliced(batches):
            out_keys, out_ids = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = {k for line in (text or "").split("\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                out_keys.extend(found)
                out_ids.extend([doc] * len(found))
            if filters is not None:
                passed = known_keys(out_keys, filters, shards)
                out_keys, out_ids = list(compress(out_keys, passed)), list(compress(out_ids, passed))
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(out_ids, pa.int64())], names=["key", "doc_id"])

    return _plain(docs).mapInArrow(keys, "key binary, doc_id long")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


class LineIndex:
    """Line index in a folder. ``min_docs`` documents make a line of ``min_chars`` characters common."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 5, min_chars: int = 40,
                 shards: int = 64, filter_bytes: int = 64 << 20) -> None:
        self.spark, self.min_docs, self.min_chars, self.shards, self.filter_bytes = spark, min_docs, min_chars, shards, filter_bytes
        self.path = path or f"{shared_folder(spark).rstrip('/')}/tables/line-index-{uuid.uuid4().hex}"

    def _current(self) -> str | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        versions = self.spark.read.text(f"{self.path}/CURRENT").collect()  # one line per committed version
        return max((r[0] for r in versions), default=None)

    def _read(self, version: str | None, name: str) -> DataFrame:
        schema = {"postings": "key binary, doc_id long", "refs": "key binary, n_docs long, keeper long",
                  "filters": "shard int, blob binary"}[name]
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{version}/{name}")

    def _commit(self, before: str | None, postings: DataFrame, touched: DataFrame | None) -> None:
        version = f"{int((before or '0').split('-')[0]) + 1:08d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.path}/{version}"
        postings.write.parquet(f"{folder}/postings")
        kept = self._read(version, "postings")
        counts = (kept if touched is None else kept.join(touched, "key", "left_semi")).groupBy("key").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        if touched is None:
            refs = counts
        else:
            refs = self._read(before, "refs").join(touched, "key", "left_anti").unionByName(counts)
        refs.write.parquet(f"{folder}/refs")
        self._filters(before, version, touched).write.parquet(f"{folder}/filters")
        self.spark.range(1).select(F.lit(version)).coalesce(1).write.mode("append").text(f"{self.path}/CURRENT")

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _common(self, version: str | None) -> DataFrame:
        return self._read(version, "refs").where(F.col("n_docs") >= self.min_docs)

    def _filters(self, before: str | None, version: str, touched: DataFrame | None) -> DataFrame:
        """One filter per shard: the old one with the keys that became common added and those that ceased taken out.

        A task holds one shard's changes. Shards whose filter overflows are rebuilt from the exact counts.
        """
        now = self._common(version).select("key")

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            keys, room = rows["key"].tolist(), len(rows)
            while True:
                made = CuckooFilter(room)
                if all(made.insert(k) for k in keys):
                    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "blob": [made.to_bytes()]})
                room *= 2

        if before is None or touched is None:
            return now.withColumn("shard", self._shard()).groupBy("shard").applyInPandas(build, "shard int, blob binary")
        was = self._common(before).select("key").join(touched, "key", "left_semi")
        still = now.join(touched, "key", "left_semi")
        changes = was.select("key", F.lit(-1).alias("sign")).unionByName(still.select("key", F.lit(1).alias("sign"))).groupBy("key").agg(
            F.sum("sign").alias("sign")).where("sign != 0").withColumn("shard", self._shard())

        def change(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            shard = (old if len(old) else rows)["shard"].iloc[0]
            made = CuckooFilter.from_bytes(old["blob"].iloc[0]) if len(old) else CuckooFilter(0)
            for key in rows.loc[rows["sign"] < 0, "key"]:
                made.delete(key)
            fits = all(made.insert(k) for k in rows.loc[rows["sign"] > 0, "key"])
            return pd.DataFrame({"shard": [shard], "blob": [made.to_bytes() if fits else None]})

        changed = self._read(before, "filters").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, "shard int, blob binary")
        changed = changed.persist()
        full = now.withColumn("shard", self._shard()).join(changed.where("blob is null").select("shard"), "shard", "left_semi")
        return changed.where("blob is not null").unionByName(full.groupBy("shard").applyInPandas(build, "shard int, blob binary"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents. Lines that a document already has in the index are not counted again."""
        before = self._current()
        added = _postings(docs, self.min_chars).distinct()
        if before is None:
            self._commit(None, added, None)
        else:
            both = self._read(before, "postings").unionByName(added).distinct()
            self._commit(before, both, added.select("key").distinct())
        return self

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take the documents with these doc_ids out again, as if they had never been inserted."""
        before = self._current()
        gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
        held = self._read(before, "postings")
        self._commit(before, held.join(gone, "doc_id", "left_anti"), held.join(gone, "doc_id", "left_semi").select("key").distinct())
        return self

    def _known_lines(self, docs: DataFrame, version: str | None) -> DataFrame:
        """(key, doc_id) of the lines that pass the filters. Filters over ``filter_bytes`` in all are not broadcast: then all lines pass."""
        filters = self._read(version, "filters")
        if (filters.agg(F.sum(F.length("blob"))).collect()[0][0] or 0) > self.filter_bytes:
            return _postings(docs, self.min_chars).distinct()
        blobs = {r["shard"]: bytes(r["blob"]) for r in filters.toLocalIterator()}
        shared = self.spark.sparkContext.broadcast(blobs)
        return _postings(docs, self.min_chars, shared, self.shards).distinct()

    def dedup(self, docs: DataFrame) -> DataFrame:
        """The documents with ``text`` rebuilt from the lines that stay, n_lines before and n_dropped.

        A common line stays only in the largest doc_id that holds it in the index. A null or empty text is one empty
        line. All other columns are kept; repeated rows are treated alike, a null id is the smallest.
        """
        version, least = self._current(), self.min_chars
        drop = self._known_lines(docs, version).join(self._common(version), "key").where("doc_id < keeper").groupBy("doc_id").agg(
            F.collect_set("key").alias("drop"))  # at most the lines of one document

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                texts, totals, dropped = [], [], []
                for text, gone in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    kept = lines if not gone else [x for x in lines if len(x) < least or line_key(x, least) not in gone]
                    texts.append("\n".join(kept))
                    totals.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
                    names=["row", "text", "n_lines", "n_dropped"])

        columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        # The other columns travel as one struct, so no name of theirs can clash.
        rows = docs.select(F.struct(*[c for c in columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"),
                           F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"))
        joined = rows.join(drop.withColumnRenamed("doc_id", "id"), "id", "left").select("row", "text", "drop")
        schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                               T.StructField("n_dropped", T.LongType())])
        found = joined.mapInArrow(rebuild, schema)
        return found.select(*["text" if c == "text" else f"row.`{c}`" for c in columns], "n_lines", "n_dropped")
