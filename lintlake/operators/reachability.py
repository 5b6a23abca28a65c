"""Which sinks a source reaches over an edge table, inside one scope.

Shallow graphs are walked several hops a job. What a deep graph has left after that is contracted first: a node with
one edge in lies as far as its parent plus that edge, so all such nodes are hung on their nearest ancestor of another kind by
pointer doubling, and only the rest is walked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import settle

HOPS = 4  # hops of one job
SHALLOW = 8  # jobs before the rest of the graph is contracted


def _hops(front: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """(scope, node, depth, hop): the least depth by at most ``HOPS`` hops from ``front``, and the fewest hops that give it.

    Rows of hop 0 are ``front`` itself, rows of hop ``HOPS`` have not been expanded yet. Only the nodes of the last hop are
    kept in hash tables, one row a node; edges stream past them unsorted.
    """
    # Said here, or else the optimizer says it in one use of a level and not in the other, and both are computed.
    tail = edges.select(F.col("scope").alias("_scope"), "src", "dst", "w").where("_scope is not null and src is not null and dst is not null")
    levels = [front.select("scope", "node", "depth")]
    for _ in range(HOPS):
        met = tail.join(levels[-1].hint("shuffle_hash"), (F.col("scope") == F.col("_scope")) & (F.col("node") == F.col("src")))
        found = met.select("scope", F.col("dst").alias("node"), (F.col("depth") + F.col("w")).alias("depth"))
        if max_depth is not None:
            found = found.where(F.col("depth") <= max_depth)
        levels.append(found.groupBy("scope", "node").agg(F.min("depth").alias("depth")))
    # One number holds both, so that the least is found by hashing; a struct would be sorted.
    ranks = [rows.select("scope", "node", (F.col("depth").cast("long") * (HOPS + 1) + hop).alias("rank")) for hop, rows in enumerate(levels)]
    best = reduce(DataFrame.unionByName, ranks).groupBy("scope", "node").agg(F.min("rank").alias("rank"))
    hop = F.col("rank") % (HOPS + 1)
    return best.select("scope", "node", ((F.col("rank") - hop) / (HOPS + 1)).cast("int").alias("depth"), hop.cast("int").alias("hop"))


def _levels(
    start: DataFrame, edges: DataFrame, max_depth: int | None
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Walk edges of weight one for ``SHALLOW`` jobs: the nodes reached, those still to be expanded (None: none), the edges left.

    A node that is found later lies no nearer, so edges into nodes that were reached are dropped after each job.
    """
    parts, front = [start], start
    for _ in range(SHALLOW):
        step = settle(_hops(front, edges, max_depth))
        parts.append(step.where("hop > 0").select("scope", "node", "depth"))
        front = step.where(F.col("hop") == HOPS)
        if front.isEmpty():
            return reduce(DataFrame.unionByName, parts), None, edges
        known = step.select("scope", F.col("node").alias("dst")).hint("shuffle_hash")
        edges = settle(edges.join(known, ["scope", "dst"], "left_anti").select("scope", "src", "dst", "w"))
    return reduce(DataFrame.unionByName, parts), front, edges


def _walk(start: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """(scope, node, depth) of all nodes reached over edges of any weight; a node may be there again at a lesser depth."""
    parts, front = [start.select("scope", "node", "depth")], start
    while True:
        before = reduce(DataFrame.unionByName, parts).select(
            F.col("scope").alias("_scope"), F.col("node").alias("_node"), F.col("depth").alias("_depth"))
        known = (F.col("scope") == F.col("_scope")) & (F.col("node") == F.col("_node")) & (F.col("_depth") <= F.col("depth"))
        step = settle(_hops(front, edges, max_depth).join(before.hint("shuffle_hash"), known, "left_anti"))
        parts.append(step.select("scope", "node", "depth"))
        front = step.where(F.col("hop") == HOPS)
        if front.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def _hang(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one edge in, hung on their nearest ancestor of another kind, and the edges between the others.

    Returns (scope, node, up, dist) and (scope, src, dst, w). Nodes on a ring of such nodes, or below one, are reached from
    nowhere and leave with their edges. Pointers double, so a chain of n nodes takes log2(n) jobs.
    """
    single = edges.groupBy("scope", F.col("dst").alias("node")).agg(
        F.count("*").alias("n"), F.first("src").alias("up"), F.first("w").alias("dist")).where("n = 1").drop("n")
    single = settle(single)
    inner = single.select("scope", F.col("node").alias("up"), F.lit(False).alias("free"))
    pointers = settle(single.join(inner, ["scope", "up"], "left").withColumn("free", F.coalesce("free", F.lit(True))))
    waiting = pointers.where("not free").count()
    while waiting:
        above = pointers.select("scope", F.col("node").alias("up"), F.struct("up", "dist", "free").alias("next"))
        jumped = pointers.join(above, ["scope", "up"], "left").select(
            "scope", "node", F.when(F.col("free"), F.col("up")).otherwise(F.col("next.up")).alias("up"),
            (F.col("dist") + F.when(F.col("free"), 0).otherwise(F.col("next.dist"))).alias("dist"),
            (F.col("free") | F.col("next.free")).alias("free"))
        pointers = settle(jumped)
        left = pointers.where("not free").count()
        if left == waiting:  # every chain that ends gets shorter in each job: rings are left
            break
        waiting = left
    place = pointers.select("scope", F.col("node").alias("src"), "up", "dist", "free")
    others = (
        edges.join(pointers.select("scope", F.col("node").alias("dst")), ["scope", "dst"], "left_anti")
        .join(place, ["scope", "src"], "left").where(F.coalesce("free", F.lit(True)))
        .select("scope", F.coalesce("up", "src").alias("src"), "dst", (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w"))
        .where("src <> dst").groupBy("scope", "src", "dst").agg(F.min("w").alias("w"))
    )
    return pointers.where("free").drop("free"), settle(others)


def _deep(front: DataFrame, rest: DataFrame, max_depth: int | None) -> DataFrame:
    """(scope, node, depth) of the nodes beyond ``front`` over ``rest``, the edges into nodes that were not reached so far."""
    hung, size = [], rest.count()
    while size:
        tree, rest = _hang(rest)
        hung.append(tree)
        before, size = size, rest.count()
        if 2 * size > before:
            break
    found = _walk(front, rest, max_depth).groupBy("scope", "node").agg(F.min("depth").alias("depth"))
    for tree in reversed(hung):
        found = settle(found)
        below = tree.join(found.withColumnRenamed("node", "up"), ["scope", "up"])
        found = found.unionByName(below.select("scope", "node", (F.col("depth") + F.col("dist")).alias("depth")))
    found = found.join(front.select("scope", "node"), ["scope", "node"], "left_anti")
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def label_propagation(
    edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int | None = None
) -> DataFrame:
    """(scope, node, rule, depth): sinks that are reached, with the fewest hops, up to ``max_depth`` of them if given.

    ``edges`` is (scope, src, dst), ``sources`` (scope, node), ``sinks`` (scope, node, rule). Null scopes and nodes are
    linked with nothing; repeated rows count once, but repeated sinks are repeated in the result. A job walks ``HOPS`` hops and
    shuffles the edges into nodes not reached so far; chains, trees and rows of diamonds take a number of jobs that grows
    with the logarithm of their length, other graphs one per ``HOPS`` hops. The edges of one node are read by one task a hop,
    as a stream; hash tables hold a partition's nodes, so ``spark.sql.shuffle.partitions`` has to grow with the graph.
    Every job's result is settled: lineage stays short and a lost executor repeats one job.
    """
    edges = settle(edges.select("scope", "src", "dst").dropna().where("src <> dst").distinct().withColumn("w", F.lit(1)))
    start = settle(sources.select("scope", "node").dropna().distinct().withColumn("depth", F.lit(0)))
    reached, front, rest = _levels(start, edges, max_depth)
    if front is not None:
        reached = reached.unionByName(_deep(front, rest, max_depth))
    return sinks.join(reached.hint("shuffle_hash"), ["scope", "node"]).select("scope", "node", "rule", "depth")
