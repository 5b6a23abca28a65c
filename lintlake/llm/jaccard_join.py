"""Similarity join of documents on word shingles by chosen paths.

Equal word sequences are one class from the start; one representative each goes on. A representative carries a MinHash
sketch, which turns its set into a fixed number of tokens. A run starts with all sets in one bucket and splits every bucket
by the values at a few coordinates that a hash of the bucket picks, so similar sets keep meeting in the same children.
Small buckets are compared by brute force on the sketches; buckets that stay large after the last split are dense and are
compared in blocks. Runs repeat until a pair at the threshold is met with the target recall.

Buckets emit no pairs but a spanning forest of the close ones, so a group of n near copies costs n rows. The components
of these forests hold every link that was met. Inside a component all pairs are then verified on the exact shingle sets,
in blocks of bounded size, which gives each document's number of links and the final classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import sliced, stored
from lintlake.llm.components import components
from lintlake.llm.shingles import WIDTH, mix, shingle_hashes, words_of

COORDINATES = 64
SMALL = 4000  # sets in a bucket that is compared at once; a split level costs more than comparing these by sketch
DEPTH = 4
BLOCK = 1000  # sets in a block of a dense bucket or of a component
BLOCK_SHINGLES = 400_000  # shingles in a block of a component
FILTER_BITS = 1 << 26  # of the filter that keeps texts without a candidate out of the shuffle
_RANDOM = np.random.default_rng(20240301)
_FACTORS = _RANDOM.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _RANDOM.integers(0, 2**32, COORDINATES, dtype=np.uint32)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles, one 32-bit number per coordinate."""
    low = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for start in range(0, len(hashes), 4096):
        part = (hashes[start:start + 4096] >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, ((part[None, :] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1))
    return low


def runs_for(recall: float, least: float) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``. A split keeps such a pair together with
    probability ``least`` at least, so one run loses it with at most 1 - least^DEPTH."""
    return max(1, ceil(log(1 - recall) / log(1 - least ** DEPTH)))


def chosen(nodes: np.ndarray) -> np.ndarray:
    """Coordinates at which each bucket is split: one always, a second for a quarter of the buckets (-1: none)."""
    first = mix(nodes) % np.uint64(COORDINATES)
    more = mix(nodes ^ np.uint64(0x5851F42D4C957F2D))
    second = np.where(more % np.uint64(4) == 0, ((first + np.uint64(1) + (more >> np.uint64(8)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)).astype(np.int64), -1)
    return np.stack([first.astype(np.int64), second], axis=1)


def children(nodes: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child bucket) for every coordinate at which the row's bucket is split."""
    picks = chosen(nodes)
    rows, which = np.nonzero(picks >= 0)
    at = picks[rows, which]
    child = mix(mix(nodes[rows] + np.uint64(0x9E3779B97F4A7C15) * (at.astype(np.uint64) + np.uint64(1))) ^ sketches[rows, at].astype(np.uint64))
    return rows, child


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Forest:
    """Union-find over names."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def find(self, a: int) -> int:
        above = self.above
        root = a
        while (up := above.get(root, root)) != root:
            root = up
        while a != root:
            above[a], a = root, above.get(a, a)
        return root

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        self.above[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        """A star per tree: every name with the smallest one it is joined to."""
        return [(a, root) for a in list(self.above) if (root := self.find(a)) != a]


def _close(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs may reach the threshold, by sketch (four standard deviations below it) and by size."""
    agree, columns = np.zeros((len(a), len(b)), np.uint8), np.ascontiguousarray(b.T)
    for at in range(a.shape[1]):
        agree += a[:, at, None] == columns[at]
    floor = COORDINATES * (least - 4 * (least * (1 - least) / COORDINATES) ** 0.5)
    small, large = np.minimum(sizes_a[:, None], sizes_b[None, :]), np.maximum(sizes_a[:, None], sizes_b[None, :])
    return (agree >= floor) & (small >= least * large)


def _is_cross(group: pa.Table) -> bool:
    """Whether a group is a pair of different blocks. One of them may have no rows."""
    return "side" in group.column_names and group.column("i")[0].as_py() != group.column("j")[0].as_py()


def _sides(group: pa.Table, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are compared with each other: of the two blocks of a pair, or all with all."""
    if not cross:
        return (both := np.arange(group.num_rows)), both
    side = group.column("side").to_numpy()
    return np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]


def _by_group(
    rows: DataFrame, keys: list[str], handle: Callable[[pa.Table, Forest], list[tuple]], fields: list[tuple[str, pa.DataType]], ddl: str,
) -> DataFrame:
    """Calls ``handle`` with each group's rows. Groups are of bounded size; a task holds one at a time.

    Links that ``handle`` puts into the task's forest come out as the last columns, one edge per name that is linked.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key, out, forest = None, [], Forest()

        def flush() -> None:
            if held:
                out.extend(handle(pa.Table.from_batches(held), forest))
                held.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
            out.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
            cuts = np.nonzero((values[1:] != values[:-1]).any(axis=1))[0] + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
                key = tuple(values[start].tolist())
                if key != held_key:
                    flush()
                    held_key = key
                held.append(batch.slice(start, end - start))
            if len(out) >= 20_000:
                yield made()
        flush()
        out.extend((*[None] * (len(fields) - 2), a, b) for a, b in forest.edges())
        yield made()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, ddl)


_EDGE = [("a", pa.int64()), ("b", pa.int64())]


def classes_of_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, digest of its words, number of distinct shingles and sketch, per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, sizes, sketches, shorts = [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, width)
                keys.append(hashlib.blake2b(" ".join(words_of(text)).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                sketch = sketch_of(hashes)
                sketches.append(sketch.tobytes())
                shorts.append(sketch.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()),
                 pa.array(shorts, pa.binary())], names=["doc_id", "key", "size", "sketch", "short"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, key binary, size long, sketch binary, short binary")


def candidate_edges(reps: DataFrame, least: float, runs: int) -> DataFrame:
    """Forests (a, b) of the representatives that met in a bucket and look close. ``reps``: rep, size, sketch."""
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches, reps_of = _matrix(batch.column("sketch"), "<u4"), batch.column("rep").to_numpy()
            for root in roots:
                rows, child = children(np.full(len(sketches), root), sketches)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(reps_of[rows])], names=["node", "rep"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches, nodes = _matrix(batch.column("sketch"), "<u4"), batch.column("node").to_numpy().view(np.uint64)
            rows, child = children(nodes, sketches)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(batch.column("rep").to_numpy()[rows])], names=["node", "rep"])

    def compare(group: pa.Table, forest: Forest) -> list[tuple]:
        n = group.num_rows
        names, sizes = group.column("rep").to_numpy(), group.column("size").to_numpy()
        if n < 2:
            return []
        sketches = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(n, -1)
        cross = _is_cross(group)
        at, other = _sides(group, cross)
        for s in range(0, len(at), 256):
            part = at[s:s + 256]
            i, j = np.nonzero(_close(sketches[part], sizes[part], sketches[other], sizes[other], least))
            # A row's close ones are joined to it in one sweep; joined ones among them cost nothing more.
            for a, b in zip(names[part[i]].tolist(), names[other[j]].tolist(), strict=True):
                if cross or a < b:
                    forest.join(a, b)
        return []

    slim = reps.select("rep", "size", "short")  # a byte per coordinate is enough to compare
    full = reps.select("rep", "sketch")
    rows = stored(full.mapInArrow(start, "node long, rep long"), "paths")
    edges = []
    for depth in range(1, DEPTH + 1):
        sized = rows.join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "node")
        small = sized.where(F.col("n") <= SMALL).join(slim, "rep").select("node", "rep", "size", "short")
        edges.append(stored(_by_group(small, ["node"], compare, _EDGE, "a long, b long"), "edges"))
        large = stored(sized.where(F.col("n") > SMALL), "large")
        if large.isEmpty():
            break
        if depth < DEPTH:
            rows = stored(large.join(full, "rep").select("node", "rep", "sketch").mapInArrow(split, "node long, rep long"), "paths")
            continue
        blocked = large.withColumn("k", F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)"))
        edges.append(stored(_by_group(
            in_block_pairs(blocked, "rep").join(slim, "rep").select("node", "i", "j", "side", "rep", "size", "short"),
            ["node", "i", "j"], compare, _EDGE, "a long, b long"), "edges"))
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    return found


def in_block_pairs(rows: DataFrame, member: str) -> DataFrame:
    """Copies each row of a group with ``k`` blocks to the k pairs (i <= j) of blocks that its block is part of; ``side`` tells which."""
    own = F.pmod(F.xxhash64(F.col(member), F.lit("block")), F.col("k")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return dealt.select(
        "*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")).drop("own", "other", "k")


def _links(group: pa.Table, forest: Forest, least: float) -> list[tuple]:
    """(rep, links, class) of each member that has links.

    A component that is one block gets its classes at once; those of a larger one are joined by the forest's edges.
    """
    names, copies = (group.column(c).to_numpy() for c in ("rep", "copies"))
    first, alone = group.column("first").to_numpy(), group.column("alone")[0].as_py()
    n, lists = len(names), group.column("shingles")
    if n < 2:
        return []
    cross = _is_cross(group)
    at, other = _sides(group, cross)
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py():c.offsets[len(c)].as_py()] for c in lists.chunks])
    owner = np.repeat(np.arange(n), lengths)
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(np.concatenate(([0], np.diff(column[order]) > 0))) if len(order) else column
    width = max(256, 4_000_000 // n)
    counts = np.zeros(n, np.int64)
    own = Forest() if alone else forest
    for s in range(0, len(at), BLOCK):  # a slice of rows at a time: no matrix has as many rows and columns as the group
        rows = at[s:s + BLOCK]
        inside = np.zeros((len(rows), len(other)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (start, start + width))
            part = np.zeros((n, width), np.float32)
            part[owner[a:b], column[a:b] - start] = 1
            inside += part[rows] @ part[other].T
        linked = inside >= least * (lengths[rows, None] + lengths[other] - inside)
        linked &= rows[:, None] != other
        counts[rows] += (linked * copies[other]).sum(axis=1)
        if cross:
            counts[other] += (linked * copies[rows, None]).sum(axis=0)
        else:
            linked &= rows[:, None] < other
        i, j = np.nonzero(linked)
        for a, b in zip(names[rows[i]].tolist(), names[other[j]].tolist(), strict=True):
            own.join(a, b)
    classes: dict[int, int] = {}
    if alone:
        for i in range(n):
            root = own.find(int(names[i]))
            classes[root] = min(classes.get(root, int(first[i])), int(first[i]))
    return [(int(names[i]), int(counts[i]), classes[own.find(int(names[i]))] if alone else None, None, None) for i in np.nonzero(counts)[0].tolist()]


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit per hashed id, FILTER_BITS in all however many ids there are: with very many it lets more texts pass."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) % 64 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))  # at most FILTER_BITS / 64 rows
    found = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in rows.toArrow().to_batches():
        found[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return found.view(np.uint64)


def similar_documents(docs: DataFrame, least: float = 0.8, recall: float = 0.999, width: int = WIDTH) -> DataFrame:
    """doc_id, class_id, n_links per document.

    A link joins two documents whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more; class_id
    is the smallest doc_id among the documents that links connect, n_links counts a document's links, copies included.
    Texts of the same words, in whatever case and punctuation, are copies of each other; so are all texts without words. A
    text of fewer than ``width`` words is linked to its copies only. Rows with a null doc_id are left out, for they can't be
    named; of rows that repeat a doc_id each counts as a copy or as a document of its own, and they all get the row's class.
    An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    scanned = stored(classes_of_copies(rows, width), "sketches")
    # The smallest id names a class of copies; of ids that repeat with other texts each text stays a representative.
    groups = scanned.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("size", "sketch", "short")).alias("s"))
    reps = stored(groups.select("key", "first", F.xxhash64("key").alias("rep"), "copies", "s.size", "s.sketch", "s.short"), "representatives")
    # Texts of one shingle are alike only if it is the same one, as in one word repeated more or less often.
    single = reps.where("size = 1")
    same = single.join(single.groupBy("sketch").agg(F.min("rep").alias("b")), "sketch").where("rep <> b").select(F.col("rep").alias("a"), "b")
    near = candidate_edges(reps.where("size > 1"), least, runs_for(recall, least)).unionByName(same)
    parts = stored(components(near).join(reps.select("rep", "first", "copies", "size"), "rep"), "parts")
    sizes = parts.groupBy("component").agg(F.expr(
        f"cast(greatest((sum(size) + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}, (count(1) + {BLOCK - 1}) div {BLOCK}) as int)").alias("k"))
    members = parts.join(sizes, "component")

    passing = rows.sparkSession.sparkContext.broadcast(_filter_of(members.select(F.col("first").alias("doc_id"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        for batch in sliced(batches):
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            found = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "shingles"])

    shingled = rows.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(sets, "doc_id long, shingles array<long>")
    with_sets = shingled.join(members.withColumnRenamed("first", "doc_id"), "doc_id").where("size(shingles) = size").select(
        "component", "k", "rep", "copies", F.col("doc_id").alias("first"), (F.col("k") == 1).alias("alone"), "shingles"
    ).dropDuplicates(["component", "rep"])
    verified = stored(_by_group(
        in_block_pairs(with_sets, "rep"), ["component", "i", "j"], lambda group, forest: _links(group, forest, least),
        [("rep", pa.int64()), ("links", pa.int64()), ("class_id", pa.int64()), *_EDGE], "rep long, links long, class_id long, a long, b long"), "links")
    links = verified.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"), F.min("class_id").alias("own_class"))
    across = verified.where("a is not null").select("a", "b")
    named = reps.select("rep", F.lit(None).cast("long").alias("class_id")).limit(0) if across.isEmpty() else None
    if named is None:
        joined = components(across).join(reps.select("rep", "first"), "rep")
        named = joined.join(joined.groupBy("component").agg(F.min("first").alias("class_id")), "component").select("rep", "class_id")
    labels = reps.select("key", "rep", "first", "copies").join(named, "rep", "left").join(links, "rep", "left").select(
        "key", F.coalesce("own_class", "class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return scanned.select("doc_id", "key").join(labels, "key").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, least: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The documents, with all columns, that carry their class's smallest doc_id. Rows with a null doc_id stay; of repeated ids all rows do."""
    keep = similar_documents(docs, least, recall).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(keep, docs["doc_id"].cast("long") == keep["_gone"], "left_anti")
