"""Text files as rows that know their place: no file is read by one task, and no window spans one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def place() -> Column:
    """A struct that orders a file scan's rows: file, place of the split, and a number that grows inside it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line: the file's lines with a struct that orders them (see place)."""
    return spark.read.text(path).select("value", place().alias("line"))


def _before(counts: DataFrame) -> DataFrame:
    """file, block, before: the sum of c over the splits before each one. A row is a split of some 100 MB, so one task has them all."""
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(counts.select("file", "block", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("before"), *[c for c in counts.columns if c == "low"]))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line, number: lines numbered from 1, over all files in order of their paths.

    Each split counts its own lines; the sum over earlier splits and the place inside its own number a line. Splits and the
    order inside them are the same in both scans.
    """
    lines = ordered_lines(spark, path).select("value", "line", "line.file", "line.block", "line.n")
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("c"), F.min("n").alias("low"))
    return lines.join(_before(counts), ["file", "block"]).select("value", "line", (F.col("before") + F.col("n") - F.col("low") + 1).alias("number"))


def running(lines: DataFrame, what: Column) -> DataFrame:
    """lines with `running`: the rows up to and including this one, in order, that `what` holds for.

    Counted inside each split and shifted by the counts of the splits before it.
    """
    rows = lines.withColumns({"__what": what.cast("bigint"), "file": F.col("line.file"), "block": F.col("line.block")})
    counts = rows.groupBy("file", "block").agg(F.sum("__what").alias("c"))
    inside = F.sum("__what").over(Window.partitionBy("file", "block").orderBy("line"))
    return rows.withColumn("__inside", inside).join(_before(counts), ["file", "block"]).withColumn("running", F.col("before") + F.col("__inside")).select(*lines.columns, "running")


def field(parts, k: int):
    """The k-th field of a split line, without white space around it."""
    return F.regexp_replace(F.get(parts, F.lit(k)), r"^\s+|\s+$", "")
