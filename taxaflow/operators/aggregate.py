"""Roll-ups of peptide quantities over organisms and functions.

rows: peptide, quantity, is_annotated, lca_tax_id, each peptide once. Its organisms are the path of its lowest common ancestor, its
functions all terms at or above its own ones, so quantities are summed by those two first, and sums expand, not peptides.

by: columns that keep peptide lists apart (list_id); all lists are rolled up in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..plans.tables import written
from .closing import BLOCKS, closed_sums


def merge_peptides(rows: DataFrame) -> DataFrame:
    """list_id, peptide, quantity: quantities of equal sequences of a list are summed."""
    return rows.groupBy("list_id", "peptide").agg(F.sum("quantity").alias("quantity"))


def coverage(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quantities and numbers of peptides, in all and annotated: one row, zeros for no peptides; or a row for each group."""
    q = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    row = rows.groupBy(*by).agg(
        q("quantity").alias("total_quantity"), q(F.when(F.col("is_annotated"), F.col("quantity"))).alias("annotated_quantity"),
        F.count("*").alias("n_peptides"), F.count_if("is_annotated").alias("n_annotated"),
    )
    row = row.withColumn("unannotated_quantity", F.col("total_quantity") - F.col("annotated_quantity"))
    row = row.withColumn("n_unannotated", F.col("n_peptides") - F.col("n_annotated"))
    return row.withColumn("annotation_coverage_ratio", ratio(F.col("annotated_quantity"), F.col("total_quantity")))


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, quantity, n_peptides of the annotated rows in which no key is null."""
    known = rows.where("is_annotated")
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n_peptides"))


def expanded(sums: DataFrame, key: str, members: DataFrame, node: str) -> DataFrame:
    """The sums with the nodes of each key instead of it: members has key and an array of them, `nodes`."""
    rest = [c for c in sums.columns if c not in (key, "quantity", "n_peptides")]
    rows = sums.join(members, key).select(*rest, F.explode("nodes").alias(node), "quantity", "n_peptides")
    return rows.groupBy(*rest, node).agg(F.sum("quantity").alias("quantity"), F.sum("n_peptides").alias("n_peptides"))


def roll_up(sums: DataFrame, cover: DataFrame, node: str, by: Sequence[str] = ()) -> DataFrame:
    """by, node, quantity, ratio_total, ratio_annotated (null if nothing is annotated), n_peptides of sums of nodes."""
    totals = F.broadcast(cover.select(*by, "total_quantity", "annotated_quantity"))  # a row for each list
    rows = sums.join(totals, [*by]) if by else sums.crossJoin(totals)
    return rows.select(
        *by, node, "quantity", ratio(F.col("quantity"), F.col("total_quantity")).alias("ratio_total"),
        ratio(F.col("quantity"), F.col("annotated_quantity"), None).alias("ratio_annotated"), "n_peptides",
    )


def node_sums(rows: DataFrame, paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, tax_id, quantity, n_peptides."""
    return expanded(summed(rows, *by, "lca_tax_id"), "lca_tax_id", paths, "tax_id")


def set_sums(rows: DataFrame, own: DataFrame, *keys: str) -> DataFrame:
    """keys, terms, quantity, n_peptides of the annotated peptides that have own terms (peptide, terms); keys may be null."""
    known = rows.where("is_annotated").join(own, "peptide")
    return known.groupBy(*keys, "terms").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n_peptides"))


def regrouped(sums: DataFrame, *keys: str) -> DataFrame:
    """keys, quantity, n_peptides of sums by these keys and others."""
    return sums.groupBy(*keys).agg(F.sum("quantity").alias("quantity"), F.sum("n_peptides").alias("n_peptides"))


def term_sums(sets: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, go_id, quantity, n_peptides. sets: set_sums() by these. edges: child, parent."""
    return closed_sums(written(sets), edges, "go_id", list(by), F.xxhash64("terms"))


def pair_sums(sets: DataFrame, nodes: DataFrame, paths: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, tax_id, go_id, quantity, n_peptides. sets: set_sums() by these and lca_tax_id, written. nodes: node_sums(), written.

    Peptides of one lowest common ancestor and one set of own terms are summed before either expands. An organism's sums stay in
    one task, which adds them up; those of an organism with more than its share of peptides in several.
    """
    sums = expanded(sets.where("lca_tax_id is not null"), "lca_tax_id", paths, "tax_id")
    total = nodes.agg(F.coalesce(F.max("n_peptides"), F.lit(0))).first()[0]
    counts = nodes.groupBy("tax_id").agg(F.max("n_peptides").alias("n_peptides"))
    crowded = counts.where(F.col("n_peptides") > F.lit(total / (BLOCKS / 2))).select("tax_id", F.ceil(F.col("n_peptides") * BLOCKS / max(total, 1)).alias("parts"))
    salt = F.pmod(F.xxhash64("terms"), F.coalesce("parts", F.lit(1)))
    sums = sums.join(F.broadcast(crowded), "tax_id", "left")  # as many rows as a path has places for each block, at most
    sums = written(sums.select(*by, "tax_id", "terms", "quantity", "n_peptides", salt.alias("salt")))
    return closed_sums(sums, edges, "go_id", [*by, "tax_id"], F.xxhash64(*by, "tax_id", "salt"))


def combos(sums: DataFrame, nodes: DataFrame, terms: DataFrame, cover: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, tax_id, go_id, quantity, fractions of either marginal and its ratio to the total, n_peptides of pair_sums, node_sums and term_sums."""
    taxa, go = roll_up(nodes, cover, "tax_id", by), roll_up(terms, cover, "go_id", by)
    taxa = taxa.select(*by, "tax_id", F.col("quantity").alias("taxon_quantity"), F.col("ratio_total").alias("ratio_total_taxon"))
    go = go.select(*by, "go_id", F.col("quantity").alias("go_quantity"), F.col("ratio_total").alias("ratio_total_go"))
    both = sums.join(taxa, [*by, "tax_id"]).join(go, [*by, "go_id"])
    return both.select(
        *by, "tax_id", "go_id", "quantity", ratio(F.col("quantity"), F.col("taxon_quantity")).alias("fraction_of_taxon"),
        ratio(F.col("quantity"), F.col("go_quantity")).alias("fraction_of_go"), "ratio_total_taxon", "ratio_total_go", "n_peptides",
    )


def violations(nodes: DataFrame, cover: DataFrame, node: str, tolerance: float = 1e-9) -> DataFrame:
    """node, problem: rows of a roll-up that break an invariant. Empty if all hold."""
    rows = nodes.crossJoin(F.broadcast(cover.drop("n_peptides")))
    quantity, slack = F.col("quantity"), tolerance * F.greatest(F.col("total_quantity"), F.lit(1.0))
    checks: list[tuple[str, Column]] = [
        ("negative quantity", quantity < 0),
        ("quantity above annotated quantity", quantity > F.col("annotated_quantity") + slack),
        ("ratio_total outside 0 to 1", ~F.col("ratio_total").between(-tolerance, 1 + tolerance)),
        ("ratio_annotated outside 0 to 1", ~F.col("ratio_annotated").between(-tolerance, 1 + tolerance)),
        ("ratio_total above ratio_annotated", F.col("ratio_total") > F.col("ratio_annotated") + tolerance),
        ("more peptides than annotated", F.col("n_peptides") > F.col("n_annotated") if "n_annotated" in cover.columns else F.lit(False)),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks]))
    return rows.select(node, F.explode(problems).alias("problem"))
