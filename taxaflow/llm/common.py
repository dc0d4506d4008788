"""What the text operators share: tables written in the cluster's shared folder, and Arrow maps over rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, in one Arrow batch that goes to Python: a batch ends with the row that reaches either. Texts average
#: a few KB; a batch of the longest ones holds few of them. The same values serve every operator.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may lack it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="taxaflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches. Plans are lazy, so the limits have to stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_CACHE: dict = {}


def worker_cache(key, make: Callable[[], object]):
    """What a Python worker keeps from batch to batch. Workers serve one operator after another, so it keeps one thing only."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = make()
    return _CACHE[key]


class Workspace:
    """Tables that cut the lineage of an iterative job; they survive the loss of any executor.

    Tables that a result no longer reads go with drop_all_but, the rest when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.live: set[str] = set()
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        self.live.add(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Delete the tables that no result still reads."""
        files = [f for df in kept for f in df.inputFiles()]
        for path in sorted(self.live):
            if not any(f"{path}/".split("://")[-1].split(":", 1)[-1].lstrip("/") in f for f in files):
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
                self.live.discard(path)


def map_texts(df: DataFrame, columns: list[str], text: str, schema: str, fn: Callable[[Iterable[bytes]], Iterable[tuple]], empty: bytes | None = b"") -> DataFrame:
    """columns of df, then what fn yields for each text (UTF-8 bytes; null counts as `empty`).

    fn sees the texts of one batch and yields one tuple for each, in order.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    bound_batches(df.sparkSession)
    made = _parse_datatype_string(schema)
    out = StructType([df.schema[c] for c in columns] + made.fields)
    kinds = [_arrow(f.dataType.simpleString()) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [empty if t is None else t for t in batch.column(len(columns)).to_pylist()]
            rows = list(zip(*fn(texts))) or [[] for _ in kinds]
            arrays = [pa.array(list(v), k) for v, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))] + arrays, names=out.names)

    return df.select(*columns, F.col(text).cast("binary").alias("__text")).mapInArrow(run, out)


def _arrow(kind: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return plain[kind] if kind in plain else pa.list_(_arrow(kind[6:-1]))


def crc_fold(column: str, folds: int):
    """crc32 of the id written as text, modulo folds."""
    return F.crc32(F.col(column).cast("string")) % folds
