"""Trees and directed graphs: lineages, lowest common ancestors, closures.

taxa: tax_id, name, rank, parent_tax_id (null at a root). edges: child, edge_type, parent.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from .closing import closed_sets

#: Steps of a walk that one plan takes before its rows are written and looked at.
CLIMB_STEPS, CLOSURE_STEPS = 2, 4


def climbs(taxa: DataFrame, ids: DataFrame) -> DataFrame:
    """tax_id, up, least: of each node and asked id, itself and its ancestors in order; least: the least id of a cycle that they end in.

    An id that is not in the tree has only itself; a parent that is not in the tree is still an ancestor; a cycle ends
    where it meets itself. What is known of a node's way up is joined to that of the node where it stops, so ways double in
    length: a tree of depth d takes log2(d) steps.
    """
    node, parent = F.col("tax_id").cast("bigint").alias("tax_id"), F.col("parent_tax_id").cast("bigint").alias("next")
    up = taxa.where("parent_tax_id is not null and parent_tax_id <> tax_id").select(node, parent)
    alone = taxa.select(node).unionByName(ids.select(node)).unionByName(up.select(F.col("next").alias("tax_id"))).where("tax_id is not null")
    rows = alone.withColumn("next", F.lit(None).cast("bigint")).unionByName(up).groupBy("tax_id").agg(F.max("next").alias("next"))
    rows = written(rows.select("tax_id", F.array("tax_id").alias("up"), "next", F.lit(None).cast("bigint").alias("least")))
    while not rows.where("next is not null").isEmpty():
        for _ in range(CLIMB_STEPS):
            rows = _climbed(rows)
        rows = written(rows)
    return rows.select("tax_id", "up", "least")


def _climbed(rows: DataFrame) -> DataFrame:
    there = rows.select(F.col("tax_id").alias("next"), F.col("up").alias("__more"), F.col("next").alias("__next"), F.col("least").alias("__least"))
    both = F.concat("up", F.coalesce("__more", F.array().cast("array<bigint>")))
    rows = rows.join(there, "next", "left").select("tax_id", both.alias("both"), F.array_distinct(both).alias("up"), "__next", F.coalesce("least", "__least").alias("least"))
    # The first id that is met again begins the cycle.
    met = F.get("both", F.size("up"))
    cycle = F.slice("up", F.array_position("up", met).cast("int"), F.size("up"))
    again = F.size("up") < F.size("both")
    return rows.select("tax_id", "up", F.when(~again, F.col("__next")).alias("next"), F.coalesce("least", F.when(again, F.array_min(cycle))).alias("least"))


def lineage(taxa: DataFrame, ids: DataFrame) -> DataFrame:
    """tax_id, ancestor_id, dist of each id: itself at 0, then its parents (see climbs)."""
    asked = ids.select(F.col("tax_id").cast("bigint").alias("tax_id")).distinct()
    rows = climbs(taxa, ids).join(asked, "tax_id", "left_semi")
    return rows.select("tax_id", F.posexplode("up").alias("dist", "ancestor_id")).select("tax_id", "ancestor_id", "dist")


def tree(taxa: DataFrame, ids: DataFrame) -> DataFrame:
    """tax_id, path (from the root down), number: nodes and asked ids, numbered in an order in which every subtree is a range.

    An id that is not in the tree is a root of its own, and so is the least id of a cycle. Numbers have gaps. They follow the
    order of paths, which a range partitioning sorts; no task sees all nodes.
    """
    whole = F.col("least").isNull()
    path = F.reverse(F.when(whole, F.col("up")).otherwise(F.slice("up", F.lit(1), F.array_position("up", F.coalesce("least", F.lit(0).cast("bigint"))).cast("int"))))
    rows = climbs(taxa, ids).select("tax_id", path.alias("path"))
    return written(rows.repartitionByRange("path").sortWithinPartitions("path").select("tax_id", "path", F.monotonically_increasing_id().alias("number")))


def ranges(tree: DataFrame) -> DataFrame:
    """tax_id, first, last: the least and greatest number of each node's subtree."""
    return tree.select(F.explode("path").alias("tax_id"), "number").groupBy("tax_id").agg(F.min("number").alias("first"), F.max("number").alias("last"))


def with_lowest_common(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """The rows (first, last, any others) with lca_tax_id: the lowest common ancestor of all nodes numbered from first to last, null for none.

    Of a set of nodes, it is that of the ones with the least and greatest number.
    """
    at = lambda name, path: tree.select(F.col("number").alias(name), F.col("path").alias(path))
    # Paths that part never meet again, so equal places are those that they share.
    shared = F.size(F.filter(F.zip_with("__a", "__b", lambda a, b: a == b), lambda same: same))
    rows = rows.join(at("first", "__a"), "first", "left").join(at("last", "__b"), "last", "left")
    return rows.withColumn("lca_tax_id", F.when(shared > 0, F.get("__a", shared - 1))).drop("__a", "__b")


def lowest_common_of(sets: DataFrame, tree: DataFrame, key: str = "peptide") -> DataFrame:
    """key, lca_tax_id of sets (key, tax_id): the deepest node that is on the way up of all ids of a key; keys that share none are absent."""
    numbers = sets.join(tree.select("tax_id", "number"), "tax_id")
    ends = numbers.groupBy(key).agg(F.min("number").alias("first"), F.max("number").alias("last"))
    return with_lowest_common(ends, tree).where("lca_tax_id is not null").select(key, "lca_tax_id")


def links(edges: DataFrame, edge_types: Iterable[str]) -> DataFrame:
    """child, parent: the edges of the chosen types, each once."""
    return edges.where(F.col("edge_type").isin(list(edge_types))).select("child", "parent").where("child <> parent").distinct()


def closure(edges: DataFrame, ids: DataFrame, edge_types: Iterable[str] = ("is_a",), include_self: bool = True) -> DataFrame:
    """go_id, ancestor of each id over the chosen edge types. Unknown and obsolete ids have themselves at most.

    Each id is a set of one term that a task closes (see closing), so no pair is shuffled.
    """
    own = written(ids.select("go_id").where("go_id is not null").distinct().withColumn("terms", F.array("go_id")))
    pairs = closed_sets(own, written(links(edges, edge_types)), "go_id").select("go_id", F.explode("terms").alias("ancestor"))
    return pairs if include_self else pairs.where("go_id <> ancestor")


def terms_below(edges: DataFrame, term) -> DataFrame:
    """go_id of one term and of all that have it at or above them. edges: child, parent."""
    chosen = edges.withColumnRenamed("parent", "go_id")
    kind = edges.schema["child"].dataType.simpleString()
    known = new = edges.sparkSession.createDataFrame([(term,)], f"go_id {kind}")
    while True:
        steps = [new]
        for _ in range(CLOSURE_STEPS):
            steps.append(steps[-1].join(chosen, "go_id").select(F.col("child").alias("go_id")).distinct())
        found = steps[1]
        for step in steps[2:]:
            found = found.unionByName(step)
        new = written(found.distinct().join(known, "go_id", "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def ancestors(edges: DataFrame, term, terms: DataFrame | None = None, edge_types: Iterable[str] = ("is_a", "part_of")) -> tuple[DataFrame, DataFrame]:
    """(go_id, ...; child, edge_type, parent): the ancestors of one term, itself included, and the edges between them.

    terms: go_id of the terms to stay inside of, as a filtered view shows them; None for all.
    """
    if terms is not None:
        inside = terms.select("go_id").distinct()
        edges = edges.join(inside.withColumnRenamed("go_id", "child"), "child", "left_semi").join(inside.withColumnRenamed("go_id", "parent"), "parent", "left_semi")
    kind = edges.schema["child"].dataType.simpleString()
    found = closure(edges, edges.sparkSession.createDataFrame([(term,)], f"go_id {kind}"), edge_types).select(F.col("ancestor").alias("go_id"))
    path = edges.where(F.col("edge_type").isin(list(edge_types))).join(found.withColumnRenamed("go_id", "child"), "child", "left_semi")
    return found, path.select("child", "edge_type", "parent")


def descendants(nodes: DataFrame, root: int, spans: DataFrame) -> DataFrame:
    """tax_id of the root (known or not) and of the reported nodes below it. spans: ranges() of a tree of these nodes.

    One range of numbers: the nodes below are those whose own range begins inside the root's.
    """
    own = F.broadcast(spans.where(F.col("tax_id") == root).select(F.col("first").alias("__first"), F.col("last").alias("__last")))  # one row
    below = spans.join(own, F.col("first").between(F.col("__first"), F.col("__last"))).select("tax_id").where(F.col("tax_id") != root)
    below = below.join(nodes.select("tax_id"), "tax_id", "left_semi")
    return below.union(nodes.sparkSession.createDataFrame([(root,)], "tax_id bigint")).distinct()
