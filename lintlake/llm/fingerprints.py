"""Closed-syncmer fingerprints of documents and their positional likeness.

A k-mer of characters is kept when the smallest of its inner s-mers stands at its first or last place. That depends on
the k-mer alone, so an edit elsewhere in the text changes neither which k-mers are kept nor their hashes: shared passages
keep their anchors at constant distances. A fingerprint holds the anchors with the smallest hashes, each with its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import sliced

K, S, ANCHORS = 8, 4, 64
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """Mixed hash of every n-gram of code points."""
    if len(points) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(points) - n + 1, np.uint64)
    weight = np.uint64(1)
    for at in range(n):
        total += points[at:len(points) - n + 1 + at] * weight
        weight = np.uint64(int(weight) * int(_P) & 0xFFFFFFFFFFFFFFFF)
    return _mix(total)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def closed_syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers, in text order."""
    if len(points) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    inner = _grams(points, s)
    span = k - s + 1  # inner s-mers of a k-mer
    low, width = inner, 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    if width < span:
        low = np.minimum(low[:len(inner) - span + 1], low[span - width:])
    first, last = inner[:len(inner) - span + 1], inner[span - 1:]
    at = np.nonzero((low == first) | (low == last))[0]
    # Only the kept k-mers are hashed: two overlapping s-mer hashes and the middle identify the k-mer.
    total = np.zeros(len(at), np.uint64)
    for step in range(0, span, s):
        total = _mix(total * _P + inner[at + step])
    return at, (_mix(total + inner[at + span - 1]) >> np.uint64(32)).astype(np.uint32)


def sketch(places: np.ndarray, hashes: np.ndarray, whole: np.ndarray, anchors: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """The ``anchors`` smallest distinct hashes with their first places. A text without any gets one for the whole text."""
    if not len(hashes):
        value = hashlib.sha256(whole.astype("<u4").tobytes()).digest()[:4]
        return np.zeros(1, np.int64), np.frombuffer(value, "<u4").astype(np.uint32)
    values, first = np.unique(hashes, return_index=True)  # smallest first; of equal ones the first place
    return places[first[:anchors]], values[:anchors]


def encode(places: np.ndarray, hashes: np.ndarray) -> str:
    """Text form: "hash@place" in hexadecimal, smallest hash first."""
    return " ".join(f"{h:08x}@{p:x}" for p, h in zip(places.tolist(), hashes.tolist(), strict=True))


def decode(text: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [part.split("@") for part in text.split()]
    return np.array([int(p, 16) for _, p in pairs], np.int64), np.array([int(h, 16) for h, _ in pairs], np.uint32)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], anchors: int = ANCHORS) -> float:
    """Share of the smallest anchors of both texts together that both have, at one common shift of places.

    The shift is the one most shared anchors agree on; anchors elsewhere don't count, so chance matches of common
    words at unrelated places stay out.
    """
    union = np.union1d(a[1], b[1])[:anchors]
    shared, in_a, in_b = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
    inside = np.isin(shared, union, assume_unique=True)
    shifts = a[0][in_a[inside]] - b[0][in_b[inside]]
    return float(np.unique(shifts, return_counts=True)[1].max() / len(union)) if len(shifts) else 0.0


def fingerprint(text: str | None, k: int = K, s: int = S, anchors: int = ANCHORS) -> str:
    """Fingerprint of a whole text; null is the empty text."""
    points = code_points(text or "")
    return encode(*sketch(*closed_syncmers(points, k, s), points, anchors))


def fingerprints(docs: DataFrame, k: int = K, s: int = S, anchors: int = ANCHORS) -> DataFrame:
    """doc_id and fingerprint of every row, in one pass without a shuffle. Null texts are empty; rows may repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [fingerprint(t, k, s, anchors) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fingerprint string")


_NULL_ID = np.iinfo(np.int64).min


def edit_probe(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """How fingerprints answer to an edit that puts the head of the next document over the second half of each.

    Next means the next smaller doc_id, after the smallest the largest (null counts as the smallest; equal ids follow
    their texts' checksums). Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. A single row is its own next document. An empty table gives no rows.

    Ids are cut into ranges at approximate percentiles. Every row goes to its range; the first rows of a range also go
    to the range before it, whose last row needs them. Texts are compressed for that single shuffle, and syncmers are
    computed once per text: those of the edited text are the two parts' own and the few across the seam.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    parts = buckets or max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Percentiles are ids that occur: at most one per bucket comes to the driver.
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] + [1.0], 10 * parts)).collect()[0][0]
    heads = np.unique(np.array(sorted(cuts or []), np.int64))  # bucket b ends at heads[b], counted from the smallest
    if len(heads):
        heads[-1] = rows.agg(F.max("id")).collect()[0][0]
    count = max(len(heads), 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            own = np.searchsorted(heads, ids, side="left")
            copies = np.nonzero(heads[own] == ids)[0]  # the first of a bucket, in descending order
            order = np.concatenate([np.arange(len(ids)), copies])
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            packed = [press.compress(t) for t in raw]
            crc = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in raw]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([own, (own[copies] + 1) % count]), pa.int64()), pa.array(ids[order]),
                pa.array([crc[i] for i in order.tolist()], pa.int64()), pa.array([packed[i] for i in order.tolist()], pa.binary()),
                pa.array(np.arange(len(order)) >= len(ids))], names=["bucket", "id", "tie", "packed", "ahead"])

    dealt = rows.mapInArrow(deal, "bucket long, id long, tie long, packed binary, ahead boolean")
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
              ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        out: list[tuple] = []
        before = None  # (bucket, id, text, points, places, hashes, sketch) of the row that waits for its next
        done = None  # bucket whose last row has met the row ahead
        for batch in sliced(batches):
            for bucket, key, ahead, packed in zip(*[batch.column(n).to_pylist() for n in ("bucket", "id", "ahead", "packed")], strict=True):
                if ahead and done == bucket:
                    continue
                text = press.decompress(packed).decode("utf-8", "surrogatepass")
                points = code_points(text)
                at, values = closed_syncmers(points)
                row = (bucket, key, text, points, at, values, sketch(at, values, points))
                if before is not None and before[0] == bucket:
                    out.append(_probe(before, row))
                before = row
                if ahead:
                    done, before = bucket, None
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    found = dealt.repartition(count, "bucket").sortWithinPartitions("bucket", "ahead", F.desc("id"), "tie").mapInArrow(
        walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))


def _probe(row: tuple, following: tuple) -> tuple:
    """The result row of a text and the one after it."""
    _, key, text, points, at, values, own = row
    n, half = len(points), len(points) // 2
    keep, put = n - half, min(half, len(following[3]))
    head, tail = following[2][:put] if put else "", points[:keep]
    edited = text[:keep] + head
    whole = np.concatenate([tail, following[3][:put]])
    # The seam: k-mers that begin in the kept part and end in the new one.
    start = max(0, keep - K + 1)
    seam_at, seam = closed_syncmers(whole[start:min(len(whole), keep + K - 1)])
    left, right = np.searchsorted(at, keep - K + 1), np.searchsorted(following[4], put - K + 1)
    left, right = (left if keep >= K else 0), (right if put >= K else 0)
    places = np.concatenate([at[:left], seam_at + start, following[4][:right] + keep])
    changed = sketch(places, np.concatenate([values[:left], seam, following[5][:right]]), whole)
    return (key, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(*own), encode(*changed),
            likeness(own, changed), likeness(own, following[6]))
