"""Benchmark items inside long documents by size-partitioned MinHash containment search.

A short item and a long document share few of the document's shingles, so a signature of the whole document would miss
it. Items are therefore partitioned by size, and for each size class a document is seen as overlapping windows of about
that size: an item's passage lies inside a window, where its Jaccard similarity is high enough for MinHash to find it.
Windows of all classes come from the same block minima. A window and an item are candidates when they agree in any of
the minima; every candidate is verified by the exact containment of the item's shingles in the whole document. Items of
one or two shingles share too little with a window and are looked up by their shingles instead.

Documents are read once per block of items and never shuffled. A block of the benchmark is bounded by its shingles and
broadcast; a larger benchmark takes more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import sliced, stored
from lintlake.llm.shingles import WIDTH, shingle_hashes

PERMUTATIONS = 64
LEAST_BLOCK = 8
FEW = 2  # items of up to so many shingles are found by each of these, not by MinHash
BLOCK_SHINGLES = 2_000_000
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_KEYS = np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32)
PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def permuted(hashes: np.ndarray) -> np.ndarray:
    """Permuted 32-bit values: a row per shingle, a column per permutation."""
    return ((hashes >> np.uint64(32)).astype(np.uint32)[:, None] ^ _MASKS) * _FACTORS


def size_class(shingles: int) -> int:
    """Class c holds items of up to LEAST_BLOCK * 2^c shingles."""
    return max(0, int(np.ceil(np.log2(max(shingles, 1) / LEAST_BLOCK))))


def window_minima(hashes: np.ndarray, classes: list[int]) -> dict[int, np.ndarray]:
    """Per class the minima of windows of two adjacent blocks; blocks of a class join two of the class before."""
    rest = -len(hashes) % LEAST_BLOCK
    padded = np.concatenate([hashes, np.repeat(hashes[-1:], rest)]) if rest else hashes
    blocks = permuted(padded).reshape(-1, LEAST_BLOCK, PERMUTATIONS).min(axis=1)
    found = {}
    for c in range(max(classes) + 1):
        if c and len(blocks) > 1:
            odd = len(blocks) % 2
            joined = np.minimum(blocks[:len(blocks) - odd:2], blocks[1::2])
            blocks = np.concatenate([joined, blocks[-1:]]) if odd else joined
        if c in classes:
            found[c] = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
    return found


class ItemBlock:
    """Lookup tables of a block of items."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]) -> None:
        self.ids = [r[0] for r in rows]
        self.shingles = [np.unique(r[1]) for r in rows]
        self.of_class: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
        by_class: dict[int, list[int]] = {}
        few = [n for n, own in enumerate(self.shingles) if len(own) <= FEW]
        keys = np.concatenate([self.shingles[n] for n in few] or [np.empty(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.few = keys[order], np.repeat(np.array(few, np.int64), [len(self.shingles[n]) for n in few])[order]
        for n, (_, hashes) in enumerate(rows):
            if len(self.shingles[n]) <= FEW:
                continue
            by_class.setdefault(size_class(len(hashes)), []).append(n)
        for c, members in by_class.items():
            signatures = np.stack([permuted(self.shingles[n]).min(axis=0) for n in members]).astype(np.uint64)
            keys = (_KEYS | signatures).ravel()
            order = np.argsort(keys, kind="stable")
            bits = min(20, 8 + int(np.ceil(np.log2(len(members) + 1))))
            seen = np.zeros((PERMUTATIONS, 1 << bits), bool)  # values that may occur, by their leading bits
            seen[np.arange(PERMUTATIONS), (signatures >> np.uint64(32 - bits)).astype(np.int64)] = True
            self.of_class[c] = keys[order], np.repeat(np.array(members), PERMUTATIONS)[order], seen.ravel(), bits

    def candidates(self, hashes: np.ndarray) -> set[int]:
        found: set[int] = set()
        keys, members = self.few
        if len(keys):
            wanted = np.unique(hashes)
            first, last = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            for a, b in zip(first[last > first].tolist(), last[last > first].tolist(), strict=True):
                found.update(members[a:b].tolist())
        if not self.of_class:
            return found
        for c, windows in window_minima(hashes, list(self.of_class)).items():
            keys, members, seen, bits = self.of_class[c]
            row = np.arange(PERMUTATIONS, dtype=np.int64) << bits
            at = np.flatnonzero(seen.take(row + (windows >> np.uint32(32 - bits))))
            wanted = np.unique(_KEYS[at % PERMUTATIONS] | windows.ravel()[at])
            first, last = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            for a, b in zip(first[last > first].tolist(), last[last > first].tolist(), strict=True):
                found.update(members[a:b].tolist())
        return found

    def matches(self, hashes: np.ndarray, least: float) -> list[tuple[int, int, int]]:
        """(item, distinct shingles, shared) with at least ``least`` of the item's shingles in the text."""
        close = self.candidates(hashes) if len(hashes) and self.ids else ()
        if not close:
            return []
        own, out = np.unique(hashes), []
        for n in close:
            mine = self.shingles[n]
            at = np.searchsorted(own, mine)
            shared = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
            if shared >= least * len(mine):
                out.append((self.ids[n], len(mine), shared))
        return out


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every item at least ``least`` contained in a document.

    Whole texts are searched. Null and empty texts match nothing; an item of fewer than ``width`` words matches texts that
    consist of just these words; rows with a null or repeated item_id count as items of their own. Repeated documents
    are reported for every row. Empty tables give no rows.
    """
    spark = docs.sparkSession

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingle_hashes(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], names=["item_id", "shingles"])

    items = stored(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        shingle, "item_id long, shingles array<long>").where("size(shingles) > 0"), "items")
    total = items.agg(F.sum(F.size("shingles"))).collect()[0][0] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for n in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == n) if blocks > 1 else items
        block = spark.sparkContext.broadcast(ItemBlock(
            [(r["item_id"], np.array(r["shingles"], np.int64).view(np.uint64)) for r in chosen.toLocalIterator()]))

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                out = [(doc, *match) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                       for match in block.value.matches(shingle_hashes(text, width), least)]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in columns], pa.array([s / q for _, _, q, s in out], pa.float64())],
                    names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        pairs = rows.mapInArrow(search, PAIRS)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents, with all their columns, that contain no benchmark item.

    Every row is decided by its own text: rows without an id or with an id of several texts go only if their text holds an
    item; equal rows go or stay together. Null and empty texts stay. With an empty benchmark all rows stay.
    """
    # A row is named by id and text, as ids may be null or repeated; equal texts contain the same items.
    name = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hit = contaminated_pairs(docs.select(name.alias("doc_id"), "text"), benchmark, least).select(F.col("doc_id").alias("_hit")).distinct()
    named = docs.withColumn("_name", name)
    return named.join(hit, named["_name"] == hit["_hit"], "left_anti").drop("_name")
