"""Annotation tables laid out by accession, so that asking for subjects moves the question and never the tables.

Each table is bucketed and sorted by accession. The number of buckets stands in the metadata of the accession column, in
the files themselves, so any later session finds the layout without a catalog that outlives it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import files

#: Rows that a bucket of the larger table gets, and the fewest buckets.
ROWS_A_BUCKET, LEAST_BUCKETS = 2_000_000, 8
LAYOUT = "accession_buckets"


def buckets_for(rows: int) -> int:
    """A power of two, so that tables that grow still have buckets which are parts of the earlier ones."""
    return max(LEAST_BUCKETS, 1 << (max(rows, 1) // ROWS_A_BUCKET).bit_length())


def _name(path: str) -> str:
    return f"by_accession_{hashlib.md5(path.encode()).hexdigest()}"


def write_by_accession(df: DataFrame, path: str, buckets: int) -> None:
    """The rows of df, bucketed and sorted by accession, one file a bucket, in place of what is there. An empty table has no buckets."""
    spark, path = df.sparkSession, files.qualified(df.sparkSession, path)
    files.delete(spark, path)
    rows = df.withColumn("accession", F.col("accession").alias("accession", metadata={LAYOUT: buckets}))
    spark.sql(f"drop table if exists {_name(path)}")
    # Rows go to the task that writes their bucket, so no task writes a file for each bucket.
    rows.repartition(buckets, "accession").write.bucketBy(buckets, "accession").sortBy("accession").option("path", path).format("parquet").saveAsTable(_name(path))
    spark.sql(f"drop table {_name(path)}")  # its files stay
    if not any(f.endswith(".parquet") for f in files.files_below(spark, path)):
        df.write.mode("overwrite").parquet(path)


def read_by_accession(spark: SparkSession, path: str) -> DataFrame:
    """The table, known to Spark as bucketed if it was written so; any other Parquet table with an accession is read as it is."""
    path = files.qualified(spark, path)
    plain = spark.read.parquet(path)
    buckets = plain.schema["accession"].metadata.get(LAYOUT)
    if not buckets:
        return plain
    name = _name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"drop table if exists {name}")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (accession) sorted by (accession) into {int(buckets)} buckets location '{where}'")
    return spark.table(name)
