"""Shortest-pack-first packing of documents into fixed-length sequences, planned on the length histogram.

Documents are tokenised once and cut into pieces; a piece is a row of numbers from there on. The driver sees only the
histogram of piece lengths (at most ``capacity`` rows), plans packing patterns on it, and the pieces find their place by
their rank among pieces of equal length. Ranks come from range totals, so a length that a third of all pieces share is
cut over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import offsets, ranged, sliced, stored, texts_of
from lintlake.llm.tokens import END_ID, ids_of

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: whole sequences first, then the rest. Null and empty texts are the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = np.append(ids_of(text, vocabulary), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(count, lengths) of every packing pattern. Lengths are placed longest first, each on the shortest pack that exists.

    A length's whole count moves at once: it takes whole groups of equal packs and splits at most one, so there are at
    most two patterns per distinct length. Lengths over the capacity are not allowed.
    """
    totals: list[int] = []  # ascending pack totals that have groups
    groups: dict[int, list[tuple[int, list[int]]]] = {}

    def keep(count: int, lengths: list[int], total: int) -> None:
        if total not in groups:
            groups[total] = []
            insort(totals, total)
        groups[total].append((count, lengths))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left and totals and totals[0] + length <= capacity:
            total = totals[0]
            count, lengths = groups[total].pop()
            if not groups[total]:
                del groups[total]
                totals.pop(0)
            # Packs of this total stay the shortest until they hold as many of the length as fit below the next total.
            after = totals[0] if totals else capacity
            fits = min(max(1, -(-(after - total) // length)), (capacity - total) // length, max(1, left // count))
            taken = min(count, left // fits) if left >= fits else 0
            if not taken:
                fits, taken = 1, min(count, left)
            keep(taken, lengths + [length] * fits, total + length * fits)
            if count > taken:
                keep(count - taken, lengths, total)
            left -= taken * fits
        if left:
            each = capacity // length
            if left >= each:
                keep(left // each, [length] * each, length * each)
            if left % each:
                keep(1, [length] * (left % each), length * (left % each))
    return [group for total in totals for group in groups[total]]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every piece with the sequence and the offset it is packed at.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Equal documents and repeated or null ids
    are packed one by one. An empty table gives no rows.
    """
    # Stored first: ranges are chosen from a sample, for which the texts would be tokenised a second time.
    cut = stored(document_pieces(docs, capacity, vocabulary), "cut-pieces")
    pieces = ranged(cut, "pieces", "length", "doc_id", "start")
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("rows"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("rows").alias("n")).collect()}  # <= capacity rows
    keys, bases, places, sequence, ranks = [], [], [], 0, dict.fromkeys(histogram, 0)
    for count, lengths in plan_patterns(histogram, capacity):
        at = 0
        for length in lengths:
            keys.append((length, ranks[length]))
            bases.append(sequence - ranks[length])
            places.append(at)
            ranks[length] += count
            at += length
        sequence += count
    order = sorted(range(len(keys)), key=keys.__getitem__)
    table = pieces.sparkSession.sparkContext.broadcast((
        np.array([(keys[i][0] << 48) + keys[i][1] for i in order], np.int64),
        np.array([bases[i] for i in order], np.int64), np.array([places[i] for i in order], np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, spot = table.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, (batch.column("length").to_numpy(zero_copy_only=False) << 48) + rank, side="right") - 1
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(base[at] + rank), pa.array(spot[at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    inside = Window.partitionBy("part", "length").orderBy("doc_id", "start")
    ranked = pieces.withColumn("nth", F.row_number().over(inside)).join(
        F.broadcast(offsets(parts, ["length"], ["rows"])), ["length", "part"])  # ranges + lengths rows at most
    return ranked.withColumn("rank", F.col("rows_before") + F.col("nth") - 1).select(
        *[n.split()[0] for n in PIECES.split(", ")], "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
