"""Hard negatives: exact integer products of anchor and candidate tiles by Strassen's recursion, then mergeable heaps.

Vectors become integer vectors once and are stored. Anchors are taken in blocks of bounded size; a block is sent to all tasks, each
task multiplies it with the candidates it reads, tile by tile, and keeps per anchor the best rows only. What tasks keep is merged by
anchor. The first pass finds positives, among rows of the anchor's label alone; the second finds, per anchor and positive, the best
rows of other labels inside the positive's score window. Candidates are never shuffled; what is, are a few rows per anchor and task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import shared_folder, stored

SCALE = 256
#: Integer components lie below this, so that products and their multiples by 20 fit 64 bits up to 65,536 dimensions.
LIMIT = 1 << 20
ANCHORS = 8192
TILE_ANCHORS, TILE_ROWS = 512, 2048
LEAF = 32
EXACT = 1 << 53
LEAST = -np.iinfo(np.int64).max  # its negative exists


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices. Odd sides are padded with zeros; sums and products are exact (modulo 2**64).

    Below ``leaf`` rows, columns or terms the product is taken at once: in doubles where every partial sum stays below 2**53,
    which is exact too, else in integers.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if not (m and k and n):
        return np.zeros((m, n), np.int64)
    if min(m, k, n) <= leaf:
        if int(np.abs(a).max()) * int(np.abs(b).max()) * k < EXACT:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label") -> DataFrame:
    """_row, vec_id, label, vector (little-endian int32): floor(256 x) of every component, stored.

    Rows take no part that have no id, no label, no vector, a null or non-finite component, or one of 4,096 or more in size. Shorter
    vectors are padded with zeros up to the longest; an empty vector is all zeros. Equal rows stay apart.
    """
    label = F.col(label) if isinstance(label, str) else label
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.col(embedding).cast("array<double>").alias("embedding")).where(
        "vec_id is not null and label is not null and embedding is not null")
    longest = given.agg(F.max(F.size("embedding"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            lengths = np.diff(column.offsets.to_numpy())
            values = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are nan
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * x)
                bad = ~(np.abs(x) < LIMIT)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            good = np.ones(len(lengths), bool)
            good[owner[bad]] = False
            vectors = np.zeros((len(lengths), max(longest, 1)), "<i4")
            place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            vectors[owner, place] = np.where(bad, 0, x)
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").filter(kept), batch.column("label").filter(kept),
                pa.array([v.tobytes() for v in vectors[good]], pa.binary())], names=["vec_id", "label", "vector"])

    made = given.mapInArrow(run, "vec_id long, label long, vector binary")
    return stored(made.withColumn("_row", F.monotonically_increasing_id()), "integer-vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1).astype(np.int64)


class Block:
    """Anchors of one block, in order of their labels; with their positives once these are known."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by([("label", "ascending"), ("_row", "ascending")])
        self.row, self.id, self.label = (table.column(c).to_numpy() for c in ("_row", "vec_id", "label"))
        self.vectors = _matrix(table.column("vector"))


class Heaps:
    """Per slot the best rows: highest scores first, of equal scores the smallest ids. Heaps of the same slots can be merged."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.score = np.full((slots, size), LEAST)
        self.id = np.full((slots, size), np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Merges candidates into their slots."""
        if not len(slot):
            return
        touched, slot = np.unique(slot, return_inverse=True)
        slot = np.concatenate([slot, np.repeat(np.arange(len(touched)), self.size)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ident = np.concatenate([ident, self.id[touched].ravel()])
        order = np.lexsort((ident, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, np.arange(len(touched)))
        rank = np.arange(len(slot)) - first[slot]
        keep = rank < self.size
        self.score[touched[slot[keep]], rank[keep]] = score[order][keep]
        self.id[touched[slot[keep]], rank[keep]] = ident[order][keep]

    def rows(self, keys: np.ndarray, names: list[str]) -> pa.RecordBatch:
        slot, rank = np.nonzero(self.score > LEAST)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[slot]), pa.array(self.id[slot, rank]), pa.array(self.score[slot, rank])], names=names)


def _tiles(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for start in range(0, batch.num_rows, TILE_ROWS):
        part = batch.slice(start, TILE_ROWS)
        if part.num_rows:
            yield (*[part.column(c).to_numpy() for c in ("_row", "vec_id", "label")], _matrix(part.column("vector")))


def _positives(block: Block, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = Heaps(len(anchors.row), size)
        for batch in batches:
            for rows, ids, labels, vectors in _tiles(batch):
                for label in np.unique(labels):
                    lo, hi = (int(np.searchsorted(anchors.label, label, side)) for side in ("left", "right"))
                    mine = np.flatnonzero(labels == label)
                    for at in range(lo, hi, TILE_ANCHORS):
                        slots = slice(at, min(hi, at + TILE_ANCHORS))
                        scores = strassen(anchors.vectors[slots], np.ascontiguousarray(vectors[mine].T))
                        scores[anchors.row[slots][:, None] == rows[mine][None, :]] = LEAST
                        floor = best.score[slots, -1]  # equal scores may still win by their id
                        if len(mine) > size:
                            floor = np.maximum(floor, np.partition(scores, len(mine) - size, axis=1)[:, len(mine) - size])
                        a, b = np.nonzero((scores >= floor[:, None]) & (scores > LEAST))
                        best.add(a + at, scores[a, b], ids[mine][b])
        yield best.rows(anchors.row, ["anchor", "positive_id", "positive_score"])

    return run


def _negatives(block: Block, size: int, low: tuple[int, int], high: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, pair, owner, score = block.value  # a pair's owner is the place of its anchor
        # low * positive <= score <= high * positive, in whole numbers
        least = -(-(score * low[0]) // low[1])
        most = score * high[0] // high[1]
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best, seen = Heaps(len(pair), size), LEAST
        for batch in batches:
            for _, ids, labels, vectors in _tiles(batch):
                later, seen = ids.min() > seen, max(seen, ids.max())
                across = np.ascontiguousarray(vectors.T)
                for at in range(0, len(anchors.row), TILE_ANCHORS):
                    slots = slice(at, min(len(anchors.row), at + TILE_ANCHORS))
                    scores = strassen(anchors.vectors[slots], across)
                    scores[anchors.label[slots][:, None] == labels[None, :]] = LEAST
                    lo, hi = np.searchsorted(owner, [slots.start, slots.stop])
                    for turn in range(int(nth[lo:hi].max(initial=-1)) + 1):
                        mine = lo + np.flatnonzero(nth[lo:hi] == turn)
                        # A full heap lets only higher scores in; equal ones only where their ids may be smaller.
                        floor = np.maximum(least[mine], best.score[mine, -1] + (best.score[mine, -1] > LEAST if later else 0))
                        local = scores[owner[mine] - at]
                        a, b = np.nonzero((local >= floor[:, None]) & (local <= most[mine][:, None]) & (local > LEAST))
                        best.add(mine[a], local[a, b], ids[b])
        yield best.rows(pair, ["pair", "negative_id", "negative_score"])

    return run


def _best(df: DataFrame, key: str, score: str, ident: str, size: int) -> DataFrame:
    """Merges what tasks kept: ranks from 1."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), ident)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: tuple[int, int] = (1, 2),
                   high: tuple[int, int] = (19, 20), anchors_per_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``integer_vectors`` and a condition on vec_id.

    An anchor's positives are its first other rows of its label, by score, then smaller id; a pair's negatives the first rows of
    other labels with low x positive_score <= score <= high x positive_score, the factors as fractions. Rows with equal ids count
    apart, and so do equal vectors, of which the smaller ids win. A pair without negatives has no row; an empty table gives none.
    Blocks of anchors are stored one after the other, so what the driver and a task hold at once has a bound.
    """
    spark = vectors.sparkSession
    anchors = vectors.where(is_anchor)
    n_blocks = -(-anchors.count() // anchors_per_block)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_blocks:
        return spark.createDataFrame([], schema)
    folder = f"{shared_folder(spark).rstrip('/')}/tables/negatives-{uuid.uuid4().hex}"
    anchors.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int")).write.partitionBy("block").parquet(f"{folder}/anchors")
    anchors = spark.read.schema("_row long, vec_id long, label long, vector binary, block int").parquet(f"{folder}/anchors")
    for number in range(n_blocks):
        table = anchors.where(F.col("block") == number).drop("block").toArrow()  # about anchors_per_block rows
        if not table.num_rows:
            continue
        block = Block(table)
        sent = spark.sparkContext.broadcast(block)
        found = vectors.mapInArrow(_positives(sent, n_positives), "anchor long, positive_id long, positive_score long")
        pairs = _best(found, "anchor", "positive_score", "positive_id", n_positives).toArrow()  # n_positives rows an anchor at most
        sent.unpersist()
        place = np.argsort(block.row, kind="stable")
        owner = place[np.searchsorted(block.row[place], pairs.column("anchor").to_numpy())]
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        named = spark.createDataFrame(pa.table({
            "pair": np.arange(len(owner)), "anchor_id": block.id[owner], "positive_id": pairs.column("positive_id").to_numpy()[order],
            "positive_score": pairs.column("positive_score").to_numpy()[order]}))
        sent = spark.sparkContext.broadcast((block, np.arange(len(owner)), owner, pairs.column("positive_score").to_numpy()[order]))
        found = vectors.mapInArrow(_negatives(sent, n_negatives, low, high), "pair long, negative_id long, negative_score long")
        _best(found, "pair", "negative_score", "negative_id", n_negatives).join(named, "pair").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score",
        ).write.parquet(f"{folder}/rows/block={number}")
        sent.unpersist()
    rows = spark.read.schema(schema + ", block int").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return rows.drop("block")
