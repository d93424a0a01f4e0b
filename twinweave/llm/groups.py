"""Groups of records linked directly or through others.

Union-find runs inside edge partitions and keeps only a spanning forest of
each; forests are merged level by level, in partitions of a bounded number of
edges, until one partition holds all that is left. Where the spanning forest
of the whole graph is itself larger than one partition, the graph is
contracted: every node is replaced by the neighbour of least hash, which
shrinks the nodes by a constant share in each round, until it fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators.skew import fragment_replicate_join
from twinweave.session import cut

#: Most edges in a merging task.
MAX_EDGES = 500_000
#: Most nodes that a union-find holds before its forest is written out.
MAX_NODES = 500_000
#: Partitions of one level merged into one of the next.
FAN_IN = 8


class UnionFind:
    """Disjoint sets of strings; the root of a set is its least member."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra < rb:
            self.parent[rb] = ra
            self.parent.setdefault(ra, ra)
        elif rb < ra:
            self.parent[ra] = rb
            self.parent.setdefault(rb, rb)


def _emit(sets: UnionFind, roots: bool) -> Iterator[pa.RecordBatch]:
    nodes = list(sets.parent)
    for i in range(0, len(nodes), 50_000):
        chunk = [(x, sets.find(x)) for x in nodes[i : i + 50_000]]
        if not roots:
            chunk = [c for c in chunk if c[0] != c[1]]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in chunk], pa.string()), pa.array([c[1] for c in chunk], pa.string())], ["node", "root"])


def _forest(batches: Iterator[pa.RecordBatch], max_nodes: int, roots: bool = False) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
        if not roots and len(sets.parent) > max_nodes:
            yield from _emit(sets, roots)
            sets = UnionFind()
    yield from _emit(sets, roots)


def spanning_forest(edges: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """Of each partition of edges (two string columns), the rows (node, root) of a spanning forest."""
    return edges.mapInArrow(lambda it: _forest(it, max_nodes), "node string, root string")


def connected_groups(pairs: DataFrame, a: str, b: str, max_edges: int = MAX_EDGES, max_nodes: int = MAX_NODES) -> DataFrame:
    """(node, group): one row per record in a pair; group is the least record, in byte order, that it is linked with.

    Pairs with a null side or with two equal sides are no links; repeated and
    reversed pairs change nothing; an empty table gives no rows. Both columns
    must be strings; other columns aren't read.
    """
    edges = pairs.select(F.col(a).alias("node"), F.col(b).alias("root")).where(F.col("node") != F.col("root"))
    forest = cut(spanning_forest(edges, max_nodes))
    size, parts = forest.count(), forest.rdd.getNumPartitions()
    # merge forests: each level unites FAN_IN partitions, none larger than max_edges, until there are no fewer partitions to go to
    while size > max_edges:
        parts_next = max(-(-size // max_edges), parts // FAN_IN)
        if parts_next >= parts:
            break
        forest = cut(spanning_forest(forest.repartition(parts_next, "node"), max_nodes))
        size, parts = forest.count(), parts_next
    if size <= max_edges:
        return forest.coalesce(1).mapInArrow(lambda it: _forest(it, max_nodes, roots=True), "node string, root string").withColumnRenamed("root", "group")
    return _contracted(forest, max_edges, max_nodes)


def _contracted(forest: DataFrame, max_edges: int, max_nodes: int) -> DataFrame:
    """Contract until the forest fits into one partition; then follow the contractions back.

    No partition can hold the forest of a graph of more nodes than max_edges, whatever is merged with what. So between
    two merges every node gives way to its neighbour of least hash, which is at least a constant share of the nodes on average.
    """
    levels: list[DataFrame] = []
    edges, size = forest, None
    while size is None or size > max_edges:
        both = edges.select("node", F.col("root").alias("other")).unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("other")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(levels))).alias("rank"), F.col(c).alias("to"))  # noqa: B023, E731
        least = both.groupBy("node").agg(F.least(F.min(rank("other")), F.min(rank("node"))).alias("m"))
        to = cut(least.select("node", "m.to"))
        levels.append(to)
        left = cut(fragment_replicate_join(edges, to, ["node"]).select("root", F.col("to").alias("a")))
        ends = to.select(F.col("node").alias("root"), F.col("to").alias("b"))
        moved = fragment_replicate_join(left, ends, ["root"]).where(F.col("a") != F.col("b")).select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = cut(spanning_forest(moved, max_nodes))
        size = edges.count()
    labels = edges.coalesce(1).mapInArrow(lambda it: _forest(it, max_nodes, roots=True), "node string, root string")
    for to in reversed(levels):
        up = labels.select(F.col("node").alias("to"), "root")
        labels = cut(fragment_replicate_join(to, up, ["to"], "left").select("node", F.coalesce("root", "to").alias("root")))
    least = labels.groupBy("root").agg(F.min("node").alias("group"))
    return fragment_replicate_join(labels, least, ["root"]).select("node", "group")


def normal_path(c: str) -> F.Column:
    """A path with ``\\`` read as ``/`` and a leading ``./`` dropped."""
    return F.regexp_replace(F.replace(F.col(c), F.lit("\\"), F.lit("/")), r"^\./", "")


def file_groups(clone_pairs: DataFrame, **bounds: int) -> DataFrame:
    """(file_path, group_path) of every file that a row of clone_pairs with both files and a fragment_hash links to another."""
    links = clone_pairs.where(F.col("fragment_hash").isNotNull()).select(normal_path("file_a").alias("a"), normal_path("file_b").alias("b"))
    return connected_groups(links, "a", "b", **bounds).select(F.col("node").alias("file_path"), F.col("group").alias("group_path"))
