"""FASTA files, their headers, and gene-association files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import ordered_lines, place


def check_fasta(spark: SparkSession, path: str) -> None:
    """A ValueError unless the first line that is not blank is a header and the next one is sequence. Reads the first lines only."""
    lines = [r.value for r in spark.read.text(path).where(F.trim("value") != "").limit(2).collect()]
    if not lines:
        raise ValueError("FASTA: empty")
    if not lines[0].startswith(">"):
        raise ValueError("FASTA: the first line is no header")
    if len(lines) < 2 or lines[1].startswith(">"):
        raise ValueError("FASTA: a header without sequence")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, description, sequence, rec_no (orders records by file, then by place in it).

    A sequence before the first header of any file, or an empty header, is an error. Files are split at any place: a record
    belongs to the split that it begins in.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select("value", place().alias("rec_no"))
    # Only a file's first record still has its mark; it may be line ends alone.
    kind = F.when(F.col("value").rlike(r"^[\r\n]*>"), "record").when(F.col("value").rlike(r"^[\r\n]*$"), "blank").otherwise("wrong")
    firsts = records.where("rec_no.block = 0").groupBy("rec_no.file").agg(F.min("rec_no").alias("rec_no"), F.min_by(kind, "rec_no").alias("kind"))
    odd = {r.kind: r.file for r in firsts.groupBy("kind").agg(F.min("file").alias("file")).collect()}
    if "wrong" in odd:
        raise ValueError(f"FASTA: sequence before the first header in {odd['wrong']}")
    if "blank" in odd:  # a row for each such file
        records = records.join(F.broadcast(firsts.where("kind = 'blank'").select("rec_no")), "rec_no", "left_anti")
    lines = F.split(F.regexp_replace("value", r"^[\r\n]*>", ""), r"\r?\n")
    records = records.withColumn("lines", lines)
    header = F.regexp_replace(F.get("lines", F.lit(0)), r"^\s+|\s+$", "")
    body = F.array_join(F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "")
    bad = F.when(header == "", F.raise_error(F.lit("FASTA: empty header")))
    return records.select(
        F.coalesce(bad.cast("string"), F.regexp_extract(header, r"^(\S+)\s*(.*)$", 1)).alias("protein_id"),
        F.regexp_extract(header, r"^(\S+)\s*(.*)$", 2).alias("description"), body.alias("sequence"), "rec_no",
    )


def last_records(records: DataFrame) -> DataFrame:
    """protein_id, sequence: the last record of each id."""
    return records.groupBy("protein_id").agg(F.max_by("sequence", "rec_no").alias("sequence"))


def read_fasta_taxa(spark: SparkSession, path: str) -> DataFrame:
    """accession, tax_id, line of the headers that have both."""
    rows = ordered_lines(spark, path).where(F.col("value").startswith(">"))
    acc = F.regexp_extract("value", r"^>\w+\|([^|]+)\|", 1)
    tax = F.regexp_extract("value", r"\bOX=(\d+)", 1)
    return rows.where((acc != "") & (tax != "")).select(acc.alias("accession"), tax.cast("bigint").alias("tax_id"), "line")


def parse_gaf(lines: DataFrame, exclude_not: bool = True, exclude_nd: bool = True) -> DataFrame:
    """accession, go_id, aspect, evidence_code, line of gene-association lines (value, line).

    Comments and lines of fewer than nine columns are skipped; `not` anywhere in the qualifier counts as NOT.
    """
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("!")).withColumn("p", parts).where(F.size("p") >= 9)
    at = lambda k: F.get("p", F.lit(k))
    if exclude_not:
        rows = rows.where(~F.contains(F.upper(at(3)), F.lit("NOT")))
    if exclude_nd:
        rows = rows.where(at(6) != "ND")
    return rows.select(at(1).alias("accession"), at(4).alias("go_id"), at(8).alias("aspect"), at(6).alias("evidence_code"), "line")


def read_gaf(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    return parse_gaf(ordered_lines(spark, path), **options)


def annotation_tables(taxa: DataFrame, gaf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """taxonomy (accession, tax_id: the last line wins) and go_annotations (accession, go_id, aspect: the first wins)."""
    taxonomy = taxa.groupBy("accession").agg(F.max_by("tax_id", "line").alias("tax_id"))
    known = gaf.join(taxonomy.select("accession"), "accession", "left_semi")
    return taxonomy, known.groupBy("accession", "go_id").agg(F.min_by("aspect", "line").alias("aspect"))
