"""Reported hierarchies reshaped for display, and drill-down into the mapping.

nodes: tax_id, name, rank, parent_tax_id, quantity, ratio_total, ... as a report has them (any further columns stay).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import written
from .graphs import lineage, ranges, terms_below

# The canonical ranks, from the root down.
RANKS = ("root", "domain", "kingdom", "phylum", "class", "order", "family", "genus", "species")

#: Bytes of a row group of postings.
POSTINGS_BYTES = 4 << 20


def rank_index(rank: Column) -> Column:
    """Place of a canonical rank, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, RANKS)), rank), F.lit(0)) - 1


def min_ratio(nodes: DataFrame, least: float = 0.001) -> DataFrame:
    return nodes.where((F.col("rank") == "root") | (F.col("ratio_total") >= least))


def terms_of_namespace(nodes: DataFrame, namespace: str = "biological_process", least: float = 0.1) -> DataFrame:
    return nodes.where((F.col("namespace") == namespace) & (F.col("ratio_total") >= least))


def max_rank(nodes: DataFrame, rank: str) -> DataFrame:
    """Nodes of the canonical ranks down to this one."""
    return nodes.where(rank_index(F.col("rank")) <= RANKS.index(rank))


def canonical(nodes: DataFrame) -> DataFrame:
    """Nodes of canonical ranks, linked to their nearest canonical ancestor among the nodes (null if there is none).

    The node without a parent becomes `root`, if any node of a canonical rank is there.
    """
    is_root = F.col("parent_tax_id").isNull()
    some = nodes.where(F.col("rank").isin(*RANKS)).limit(1).select(F.lit(1).alias("__some"))
    kept = nodes.join(F.broadcast(some)).drop("__some").where(F.col("rank").isin(*RANKS) | is_root)
    kept = written(kept.withColumn("rank", F.when(is_root, F.lit("root")).otherwise(F.col("rank"))))
    inside = nodes.select("tax_id", "parent_tax_id").join(nodes.select(F.col("tax_id").alias("parent_tax_id")), "parent_tax_id", "left_semi")
    lines = lineage(inside, kept.select("tax_id")).where("dist > 0")
    near = lines.join(kept.select(F.col("tax_id").alias("ancestor_id")), "ancestor_id", "left_semi")
    near = near.groupBy("tax_id").agg(F.min_by("ancestor_id", "dist").alias("__parent"))
    return kept.join(near, "tax_id", "left").withColumn("parent_tax_id", F.col("__parent")).drop("__parent")


def strict_layers(nodes: DataFrame) -> DataFrame:
    """tax_id, name, rank, parent_tax_id (text): placeholders fill the ranks skipped between a node and its parent."""
    rows = nodes.select(F.col("tax_id").cast("string").alias("id"), "name", "rank", F.col("parent_tax_id").cast("string").alias("parent"), rank_index(F.col("rank")).alias("at"))
    parents = rows.select(F.col("id").alias("parent"), F.col("at").alias("parent_at"))
    rows = rows.where("at is not null").join(parents, "parent", "left").withColumn("parent_known", F.col("parent_at").isNotNull())
    rows = rows.withColumn("parent_at", F.coalesce("parent_at", F.lit(-1)))
    place = lambda rank, id_: F.concat(F.lit("__placeholder_"), rank, F.lit("_"), id_)
    ranks = F.array(*map(F.lit, RANKS))
    gap = F.col("at") - F.col("parent_at") > 1
    last = place(F.get(ranks, (F.col("at") - 1).cast("int")), F.col("id"))
    own = rows.select(F.col("id").alias("tax_id"), "name", "rank", F.when(gap, last).otherwise(F.col("parent")).alias("parent_tax_id"))
    filled = rows.where(gap).select("*", F.explode(F.sequence(F.col("parent_at") + 1, F.col("at") - 1)).alias("k"))
    rank = F.get(ranks, F.col("k").cast("int"))
    above = F.when(F.col("k") - 1 > F.col("parent_at"), place(F.get(ranks, (F.col("k") - 1).cast("int")), F.col("id"))).when(F.col("parent_known"), F.col("parent"))
    extra = filled.select(place(rank, F.col("id")).alias("tax_id"), F.lit("").alias("name"), rank.alias("rank"), above.alias("parent_tax_id"))
    return own.unionByName(extra)


def hierarchy_errors(nodes: DataFrame) -> DataFrame:
    """tax_id, problem: nodes other than the root whose parent is missing, unknown, or not of a higher rank."""
    parents = nodes.select(F.col("tax_id").alias("p"), rank_index(F.col("rank")).alias("p_at"))
    rows = nodes.where("rank <> 'root'").join(parents, F.col("parent_tax_id") == F.col("p"), "left")
    problem = F.when(F.col("parent_tax_id").isNull(), "no parent").when(F.col("p").isNull(), "parent not in set").when(F.col("p_at") >= rank_index(F.col("rank")), "parent rank not higher")
    return rows.select("tax_id", problem.alias("problem")).where("problem is not null")


def dangling_parents(child_parent: DataFrame, nodes: DataFrame) -> DataFrame:
    """parent: parents that are no node. child_parent: child, parent. nodes: id."""
    return child_parent.select("parent").where("parent is not null").distinct().join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti")


def ranked_ancestor(nodes: DataFrame, rank: str) -> DataFrame:
    """tax_id, ancestor_id: the nearest ancestor of this rank, itself included."""
    lines = lineage(nodes.select("tax_id", "parent_tax_id"), nodes.select("tax_id"))
    of_rank = nodes.where(F.col("rank") == rank).select(F.col("tax_id").alias("ancestor_id"))
    return lines.join(of_rank, "ancestor_id").groupBy("tax_id").agg(F.min_by("ancestor_id", "dist").alias("ancestor_id"))


def links(nodes: DataFrame) -> DataFrame:
    """source, target, value: edges between nodes that are both reported."""
    known = nodes.select(F.col("tax_id").alias("parent_tax_id"))
    return nodes.join(known, "parent_tax_id", "left_semi").select(F.col("parent_tax_id").alias("source"), F.col("tax_id").alias("target"), F.col("quantity").alias("value"))


def metric_value(nodes: DataFrame, metric: str) -> Column:
    """A report's number by its name, 0 where it is missing, as a report without that column has none."""
    return F.coalesce(F.col(metric).cast("double"), F.lit(0.0)) if metric in nodes.columns else F.lit(0.0)


def normalized(nodes: DataFrame, metric: str, log: bool) -> DataFrame:
    """nodes with `normalized`: the metric (its log1p for counts and quantities) from 0 to 1; 0 if all are equal."""
    value = metric_value(nodes, metric)
    rows = nodes.withColumn("__v", F.log1p(value) if log else value)
    ends = F.broadcast(rows.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))  # one row
    span = F.col("__hi") - F.col("__lo")
    return rows.crossJoin(ends).withColumn("normalized", F.when(span == 0, 0.0).otherwise((F.col("__v") - F.col("__lo")) / span)).drop("__v", "__lo", "__hi")


def search_labels(options: DataFrame, text: str, most: int = 50) -> DataFrame:
    """The first options, in order of their label and then other columns, that contain the text in any case."""
    others = [c for c in options.columns if c != "label"]
    return options.where(F.contains(F.lower("label"), F.lit(text.lower()))).orderBy("label", *others).limit(most)


def combo_slice(combos: DataFrame, tax_id: int | None = None, go_id=None) -> DataFrame:
    """The rows of one organism, or of one function."""
    return combos.where(F.col("tax_id") == tax_id) if tax_id is not None else combos.where(F.col("go_id") == go_id)


def drill_down(mapping: DataFrame, tax_ids: list[int] | DataFrame | None = None, go_id=None) -> DataFrame:
    """Mapping rows of any of the organisms and of the function; nothing is selected by no selection.

    tax_ids: a few ids, or a DataFrame with the column tax_id, however many rows it has.
    """
    many = isinstance(tax_ids, DataFrame)
    if not many and not tax_ids and go_id is None:
        return mapping.limit(0)
    rows = mapping
    if many:
        pairs = mapping.select("peptide", F.explode("peptide_lca_tax_ids").alias("tax_id")).distinct()
        rows = rows.join(pairs.join(tax_ids, "tax_id", "left_semi").select("peptide").distinct(), "peptide", "left_semi")
    elif tax_ids:
        rows = rows.where(F.arrays_overlap("peptide_lca_tax_ids", F.array(*[F.lit(t).cast("bigint") for t in tax_ids])))
    if go_id is not None:
        rows = rows.where(F.array_contains("peptide_go_terms", go_id))
    return rows


def with_organisms(rows: DataFrame, tree: DataFrame, tax_ids: DataFrame) -> DataFrame:
    """Annotated peptides with one of the organisms (tax_id) on the path of their lowest common ancestor."""
    on_path = tree.select(F.col("tax_id").alias("lca_tax_id"), F.explode("path").alias("tax_id")).join(tax_ids, "tax_id", "left_semi")
    return rows.join(on_path.select("lca_tax_id").distinct(), "lca_tax_id", "left_semi")


def postings(mapping: DataFrame, rows: DataFrame, tree: DataFrame) -> DataFrame:
    """The mapping with `number`, that of its peptide's lowest common ancestor, clustered by it and then by peptide (see write_postings).

    A peptide's organisms are the path of that ancestor, so those with an organism of a subtree are those whose number is in its
    range. Peptides without organisms have none.
    """
    numbers = rows.join(tree.select(F.col("tax_id").alias("lca_tax_id"), "number"), "lca_tax_id", "left").select("peptide", "number")
    return mapping.join(numbers, "peptide").repartitionByRange("number", "peptide").sortWithinPartitions("number", "peptide")


def write_postings(mapping: DataFrame, rows: DataFrame, tree: DataFrame, folder: str, subject_go: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    """postings() and the ranges of all organisms below a folder. Row groups are small, so a click reads few of them.

    A mapping without arrays of terms has subject_go (subject_id, go_id) and edges (child, parent) beside it, which find a function's
    peptides by their subjects.
    """
    if subject_go is not None:
        subject_go.write.mode("overwrite").parquet(f"{folder}/subject_go")
        edges.write.mode("overwrite").parquet(f"{folder}/edges")
    postings(mapping, rows, tree).write.option("parquet.block.size", str(POSTINGS_BYTES)).mode("overwrite").parquet(f"{folder}/postings")
    ranges(tree).write.mode("overwrite").parquet(f"{folder}/ranges")


def drill_into(spark: SparkSession, folder: str, tax_id: int | None = None, go_id=None) -> DataFrame:
    """drill_down of the whole mapping that write_postings wrote: the rows with an organism at or below tax_id, and the function.

    The organism becomes a range of numbers that Parquet compares with each row group's statistics. Nothing is selected by no selection.
    """
    rows = spark.read.parquet(f"{folder}/postings")
    if tax_id is None and go_id is None:
        rows = rows.limit(0)
    if tax_id is not None:
        span = spark.read.parquet(f"{folder}/ranges").where(F.col("tax_id") == tax_id).first()
        rows = rows.where(F.col("number").between(span["first"], span["last"])) if span else rows.limit(0)
    if go_id is not None and "peptide_go_terms" in rows.columns:
        rows = rows.where(F.array_contains("peptide_go_terms", go_id))
    elif go_id is not None:
        below = terms_below(spark.read.parquet(f"{folder}/edges"), go_id)
        subjects = spark.read.parquet(f"{folder}/subject_go").join(below, "go_id", "left_semi").select(F.col("subject_id").alias("annotated_protein"))
        rows = rows.join(rows.join(subjects, "annotated_protein", "left_semi").select("peptide").distinct(), "peptide", "left_semi")
    return rows.drop("number")


def nested(mapping: DataFrame) -> DataFrame:
    """peptide, n_proteins, n_subjects: the peptide's proteins and its distinct subjects per protein, summed."""
    per = mapping.groupBy("peptide", "background_protein").agg(F.countDistinct("annotated_protein").alias("n"))
    return per.groupBy("peptide").agg(F.count("*").alias("n_proteins"), F.sum("n").alias("n_subjects"))


def first_in_queue(jobs: DataFrame, by: str, time: str, order: str) -> DataFrame:
    """The earliest row of each group."""
    w = Window.partitionBy(by).orderBy(time, order)
    return jobs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
