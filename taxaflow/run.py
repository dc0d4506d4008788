"""One run from files to reports, over any number of peptide lists, which are matched, annotated and rolled up together.

Paths may be remote: all is read by Spark and written through Hadoop's file systems.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import annotate, matching
from .operators import hits as hit_ops
from .params import FilterPolicy, GoOptions
from .plans.pipeline import Annotated
from .plans.tables import scratch, written
from .sinks import files, reports
from .sources import peptides, proteins, references
from .sources.annotations import read_by_accession


@dataclass(frozen=True)
class Inputs:
    """Paths. Hits: tabular aligner output, or mock hits (.json). Annotations: tables of build_annotations, or mock ones (.json)."""

    lists: tuple[str, ...]
    background: str
    hits: str
    annotations: str
    ontology: str
    taxonomy: str


def matched_lists(lists: DataFrame, background: DataFrame, strategy: str = "auto") -> DataFrame:
    """list_id, peptide, protein_id: every distinct peptide of any list is looked for once, then given back to its lists."""
    found = matching.matches(lists.select("peptide").distinct(), background, strategy)
    return lists.select("list_id", "peptide").join(found, "peptide").select("list_id", "peptide", "protein_id")


def build_annotations(spark: SparkSession, fasta: str, gaf: str, folder: str) -> None:
    """Annotation tables from protein headers and gene associations."""
    reports.write_annotation_tables(*proteins.annotation_tables(proteins.read_fasta_taxa(spark, fasta), proteins.read_gaf(spark, gaf)), folder)


def _annotations(spark: SparkSession, path: str, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subject_id, tax_id), (subject_id, go_id) of the subjects."""
    if path.endswith(".json"):
        tax, go = references.read_mock_annotations(spark, path)
        return tax.join(subjects, "subject_id", "left_semi"), go.join(subjects, "subject_id", "left_semi")
    known = [read_by_accession(spark, f"{path}/{name}") for name in ("taxonomy", "go_annotations")]
    found = written(annotate.lookup_subjects(subjects, *known))
    return found.select("subject_id", "tax_id").distinct(), found.select("subject_id", "go_id").where("go_id is not null").distinct()


def run(spark: SparkSession, inputs: Inputs, out: str, policy: FilterPolicy | None = None, go: GoOptions | None = None, alphabet: str | None = None) -> list[str]:
    """Write each list's reports below out/list_000, list_001, ..., the proteins that peptides hit, and the manifest; the names of the lists.

    All lists are one job: their number changes rows, not jobs, but for reading them and joining each one's parts.
    """
    with scratch():
        return _run(spark, inputs, out.rstrip("/"), policy or FilterPolicy(), go or GoOptions(), alphabet)


def _run(spark: SparkSession, inputs: Inputs, out: str, policy: FilterPolicy, go: GoOptions, alphabet: str | None) -> list[str]:
    names = {f"list_{k:03d}": f"list_{k:03d}" for k in range(len(inputs.lists))}
    rows: DataFrame | None = None
    for name, path in zip(names, inputs.lists):
        one = peptides.read_peptides(spark, path, name, alphabet)
        rows = one if rows is None else rows.unionByName(one)
    rows = written(rows)
    background = proteins.last_records(proteins.read_fasta(spark, inputs.background))
    found = written(matching.matches(rows.select("peptide").distinct(), background))
    hit = found.select("protein_id").distinct()
    reports.write_fasta(reports.subset_fasta(background, hit), f"{out}/hit_proteins.fasta")
    asked = hit.withColumnRenamed("protein_id", "query_id")
    if inputs.hits.endswith(".json"):
        source = {"given": references.read_mock_hits(spark, inputs.hits).join(asked, "query_id", "left_semi")}
        accepted = source["given"]
    else:
        source = {"hits": references.read_hits(spark, inputs.hits).join(asked, "query_id", "left_semi"), "policy": policy}
        accepted = hit_ops.accepted(source["hits"], policy)
    subject_tax, subject_go = _annotations(spark, inputs.annotations, accepted.select("subject_id").distinct())
    taxa = references.read_taxonomy(spark, inputs.taxonomy)
    terms, edges = references.read_go(spark, inputs.ontology)
    by = ("list_id",)
    all_ = Annotated(rows, found, subject_tax, subject_go, taxa, edges, go=go, by=by, **source)
    mapping = written(all_.mapping())
    reports.write_csv(reports.taxonomy_report(all_.taxonomy_nodes(), taxa, by), f"{out}/{{}}/taxonomy_nodes.csv", names)
    reports.write_csv(reports.terms_report(all_.go_terms(), terms, edges, go.edge_types, by=by), f"{out}/{{}}/go_terms.csv", names)
    reports.write_csv(all_.coverage().orderBy("list_id"), f"{out}/{{}}/coverage.csv", names)
    reports.write_csv(reports.combo_report(all_.combos(), taxa, terms, edges, go.edge_types, by), f"{out}/{{}}/go_taxonomy_combo.csv", names)
    reports.write_mappings(mapping, f"{out}/{{}}/peptide_mapping.parquet", names)
    reports.write_details(mapping, f"{out}/{{}}/peptide_details.csv", names)
    sources = {f"list {n}": p for n, p in zip(names, inputs.lists)} | {k: getattr(inputs, k) for k in ("background", "hits", "annotations", "ontology", "taxonomy")}
    files.write_text(spark, f"{out}/manifest.json", reports.manifest(spark, {"policy": vars(policy), "go": vars(go)}, sources))
    return [*names]
