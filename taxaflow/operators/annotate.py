"""Peptides with organisms and functions.

Long tables throughout: matches (peptide, protein_id), accepted (query_id, subject_id), subject_tax (subject_id, tax_id),
subject_go (subject_id, go_id). A missing lookup is an empty set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from . import graphs
from .closing import closed_sets


def implied_subjects(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """peptide, subject_id over the proteins that hold the peptide."""
    return found.join(accepted.withColumnRenamed("query_id", "protein_id"), "protein_id").select("peptide", "subject_id").distinct()


def subject_ends(subject_tax: DataFrame, tree: DataFrame) -> DataFrame:
    """subject_id, first, last: the least and greatest tree number of each subject's organisms."""
    return subject_tax.join(tree.select("tax_id", "number"), "tax_id").groupBy("subject_id").agg(F.min("number").alias("first"), F.max("number").alias("last"))


def protein_summaries(accepted: DataFrame, ends: DataFrame, *further: str) -> DataFrame:
    """protein_id, first, last of each protein with an accepted subject; both null if none of those has organisms.

    further: columns of accepted of which the greatest value stays.
    """
    rows = accepted.join(ends, "subject_id", "left")
    return rows.groupBy(F.col("query_id").alias("protein_id")).agg(F.min("first").alias("first"), F.max("last").alias("last"), *[F.max(c).alias(c) for c in further])


def peptide_summaries(found: DataFrame, proteins: DataFrame, *further: str) -> DataFrame:
    """peptide, first, last over the proteins that hold the peptide; peptides without an accepted subject are absent.

    Ends of ends are those of all, so no pair of a peptide and a subject is made.
    """
    return found.join(proteins, "protein_id").groupBy("peptide").agg(F.min("first").alias("first"), F.max("last").alias("last"), *[F.max(c).alias(c) for c in further])


def own_terms(found: DataFrame, accepted: DataFrame, subject_go: DataFrame) -> DataFrame:
    """peptide, terms: those of the subjects that the peptide's proteins have, sorted, before any closure; peptides without are absent."""
    known = subject_go.where("go_id is not null").select("subject_id", "go_id").distinct()
    proteins = accepted.join(known, "subject_id").groupBy(F.col("query_id").alias("protein_id")).agg(F.collect_set("go_id").alias("terms"))
    return found.join(proteins, "protein_id").groupBy("peptide").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))


def peptides_holding(found: DataFrame, accepted: DataFrame, holders: DataFrame) -> DataFrame:
    """peptide: those with one of the subjects (subject_id) that are holders."""
    proteins = accepted.join(holders, "subject_id", "left_semi").select(F.col("query_id").alias("protein_id")).distinct()
    return found.join(proteins, "protein_id").select("peptide").distinct()


def annotated_peptides(peptides: DataFrame, summaries: DataFrame, tree: DataFrame) -> DataFrame:
    """The rows of peptides with is_annotated, lca_tax_id: annotated ones imply a subject, whether or not it has organisms or functions.

    summaries: distributed by peptide, as are then the peptides, so their join moves nothing; nodes join last.
    """
    known = peptides.join(summaries.withColumn("is_annotated", F.lit(True)), "peptide", "left").withColumn("is_annotated", F.coalesce("is_annotated", F.lit(False)))
    return graphs.with_lowest_common(known, tree).drop("first", "last")


def lookup_subjects(ids: DataFrame, taxonomy: DataFrame, go_annotations: DataFrame) -> DataFrame:
    """subject_id, accession, tax_id, go_id of every asked id; null where nothing is known. One row for each term.

    Of tables that read_by_accession gives, neither is shuffled: the asked ids go to their buckets, once for both.
    """
    from ..functions.text import accession

    asked = ids.select("subject_id").distinct().withColumn("accession", accession(F.col("subject_id")))
    return asked.join(taxonomy, "accession", "left").join(go_annotations.select("accession", "go_id"), "accession", "left")


def found_pairs(found: DataFrame, accepted: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row for each match and subject of its protein: columns of found but protein_id, background_protein, annotated_protein, evalue, pident.

    values: query_id, subject_id, evalue, pident of all accepted pairs; without them both are null. Pairs stay where their protein is.
    """
    if values is None:
        subjects = accepted.withColumn("evalue", F.lit(None).cast("double")).withColumn("pident", F.lit(None).cast("double"))
    else:
        subjects = values
    subjects = subjects.select(F.col("query_id").alias("protein_id"), "subject_id", "evalue", "pident")
    further = [c for c in found.columns if c != "protein_id"]
    return found.join(subjects, "protein_id").select(*further, F.col("protein_id").alias("background_protein"), F.col("subject_id").alias("annotated_protein"), "evalue", "pident")


def pairs(rows: DataFrame, found: DataFrame, accepted: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row for each annotated peptide, protein and subject: peptide, other columns of rows, background_protein, annotated_protein, evalue, pident.

    rows: annotated_peptides. values: as in found_pairs.
    """
    return rows.where("is_annotated").drop("quantity", "is_annotated").join(found_pairs(found, accepted, values), "peptide")


def with_organisms(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """annotated_peptides with peptide_lca_tax_ids, the sorted path of lca_tax_id (empty if it is null), instead of it."""
    paths = tree.select(F.col("tax_id").alias("lca_tax_id"), F.array_sort("path").alias("path"))
    none = F.array().cast("array<bigint>")
    return rows.join(paths, "lca_tax_id", "left").withColumn("peptide_lca_tax_ids", F.coalesce("path", none)).drop("lca_tax_id", "path")


def mapping(pairs: DataFrame, own: DataFrame, edges: DataFrame, shown: Callable[[Column], Column] = lambda array: array) -> DataFrame:
    """pairs() with sorted arrays of organisms and terms (those at or above the peptide's own), or what `shown` makes of them.

    pairs: of rows with_organisms(). A peptide's pairs stay together as one row until its terms are closed and shown, so they are the
    last thing that is shuffled and `shown` is asked once for each peptide; closed terms meet nothing more, however large the tree.
    """
    entry = ["background_protein", "annotated_protein", "evalue", "pident"]
    key = [c for c in pairs.columns if c not in (*entry, "peptide_lca_tax_ids")]
    further = [c for c in key if c != "peptide"]
    grouped = pairs.groupBy("peptide", *further).agg(F.first("peptide_lca_tax_ids").alias("peptide_lca_tax_ids"), F.collect_list(F.struct(*entry)).alias("entries"))
    closed = closed_sets(written(grouped.join(own, "peptide", "left")), edges, *key)
    out = closed.select(*further, "peptide", shown(F.col("peptide_lca_tax_ids")).alias("peptide_lca_tax_ids"), shown(F.col("terms")).alias("peptide_go_terms"), "entries")
    return out.select(*further, "peptide", "peptide_lca_tax_ids", "peptide_go_terms", F.inline("entries"))
