"""Peptide lists: two columns, tab or comma, with or without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_numeric, normalize_sequence, outside_alphabet, parse_quantity, stripped
from .lines import numbered_lines


def read_peptides(spark: SparkSession, path: str, list_id: str = "list_000", alphabet: str | None = None) -> DataFrame:
    """list_id, peptide, quantity: equal sequences are summed. The first broken rule, by line, is a ValueError.

    A file of any size, or a folder whose files follow each other by name: lines are numbered split by split.
    """
    lines = numbered_lines(spark, path).select("value", F.col("number").alias("n"))
    first = lines.where("n = 1").first()
    if first is None or not first.value.strip():
        raise ValueError("line 1: empty")
    sep = "\t" if "\t" in first.value else ","
    # A separator inside quotes (one that an odd number of quotes follows) is part of its cell; a doubled quote is one.
    cell = lambda x: F.regexp_replace(F.regexp_replace(x, r'^\s*"(.*)"\s*$', "$1"), '""', '"')
    cells = lines.select("n", F.transform(F.split("value", sep + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: stripped(cell(x))).alias("c"))
    head = cells.where("n = 1").select(F.size("c").alias("k"), is_numeric(F.get("c", F.lit(1))).alias("numeric")).first()
    if head.k < 2:
        raise ValueError("line 1: two columns are needed")
    rows = cells.where(F.array_join("c", "") != "").where(F.lit(head.numeric) | (F.col("n") > 1))
    rows = rows.select("n", F.size("c").alias("k"), F.get("c", F.lit(0)).alias("raw"), F.get("c", F.lit(1)).alias("q"))
    rows = rows.withColumn("peptide", normalize_sequence(F.col("raw"))).withColumn("quantity", parse_quantity(F.col("q")))
    again = rows.groupBy("raw").agg(F.min("n").alias("first_n"))
    odd = F.size(outside_alphabet(F.col("peptide"), alphabet)) > 0 if alphabet else F.lit(False)
    problem = (
        F.when(F.col("k") < 2, "two columns are needed").when(F.col("peptide") == "", "no letters in the sequence").when(odd, "letters outside the alphabet")
        .when(F.col("quantity").isNull(), "not a quantity").when(F.col("n") > F.col("first_n"), F.concat(F.lit("duplicate of line "), F.col("first_n")))
    )
    wrong = rows.join(again, "raw").select("n", problem.alias("problem")).where("problem is not null").orderBy("n").first()
    if wrong:
        raise ValueError(f"line {wrong.n}: {wrong.problem}")
    return rows.groupBy("peptide").agg(F.sum("quantity").alias("quantity")).select(F.lit(list_id).alias("list_id"), "peptide", "quantity")
