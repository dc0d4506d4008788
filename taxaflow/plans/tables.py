"""Tables in the folder that a cluster's executors share; reading one back cuts a long lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="taxaflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_OPEN: list[dict[str, DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written now. It goes with the scratch() it was written in, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1][path] = out
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at its end, but for those that were given to keep()."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _OPEN.append({})
    try:
        yield keep
    finally:
        for path, df in _OPEN.pop().items():
            if not any(df is k for k in kept):
                _delete(df.sparkSession, path)
            elif _OPEN:
                _OPEN[-1][path] = df


def dropped(*tables: DataFrame) -> None:
    """Delete written tables."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("table-"):
                _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
