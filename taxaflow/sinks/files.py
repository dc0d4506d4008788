"""Files through Hadoop's file systems, so a path may be remote. Streams pass the driver's JVM in blocks; no row does."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _path(spark: SparkSession, path: str):
    """(file system, path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that it means the same to every session."""
    system, at = _path(spark, path)
    return system.makeQualified(at).toString()


def files_below(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder and its folders, by name; a file itself; nothing where nothing is. Those that begin with . or _ are left out."""
    system, at = _path(spark, path)
    if not system.exists(at):
        return []
    out = []
    for status in system.listStatus(at) if system.getFileStatus(at).isDirectory() else [system.getFileStatus(at)]:
        if status.isDirectory():
            out += files_below(spark, status.getPath().toString())
        elif status.getPath().getName()[0] not in "._":
            out.append(status.getPath().toString())
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in place of what is there."""
    system, at = _path(spark, path)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def join_parts(spark: SparkSession, folder: str, path: str, header: str = "", footer: str = "") -> None:
    """One file of the header, the folder's files in order of name, and the footer, in place of what is there."""
    system, at = _path(spark, path)
    out = system.create(at, True)
    out.write(bytearray(header.encode()))
    for part in files_below(spark, folder):
        source = _path(spark, part)[1]
        stream = system.open(source)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, BLOCK, False)
        stream.close()
    out.write(bytearray(footer.encode()))
    out.close()


def sha256(spark: SparkSession, path: str) -> str:
    """Hex digest of one file."""
    system, at = _path(spark, path)
    digest = spark._jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = spark._jvm.java.security.DigestInputStream(system.open(at), digest)
    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, spark._jvm.java.io.OutputStream.nullOutputStream(), BLOCK, False)
    stream.close()
    return bytes(digest.digest()).hex()


def move(spark: SparkSession, source: str, target: str) -> None:
    """The file or folder under another name, in place of what is there."""
    system, at = _path(spark, target)
    system.delete(at, True)
    system.mkdirs(at.getParent())
    system.rename(_path(spark, source)[1], at)


def delete(spark: SparkSession, path: str) -> None:
    system, at = _path(spark, path)
    system.delete(at, True)


def write_lines(lines: DataFrame, path: str, header: str = "", by: str | None = None, names: dict[str, str] | None = None, footer: str = "") -> None:
    """The column `value` of ordered rows as one text file: tasks write parts, ranges of the order, that are joined by name.

    by: a column, the first of the order, with a file for each of its values: path is then a pattern with {}. names: the
    values that get a file even without rows, with what stands for {}.
    """
    spark = lines.sparkSession
    parts = f"{path.split('{}')[0].rstrip('/')}-parts-{uuid.uuid4().hex}"
    try:
        if by is None:
            lines.select("value").write.text(parts)
            join_parts(spark, parts, path, header, footer)
        else:
            lines.select("value", by).write.partitionBy(by).text(parts)
            for value, name in (names or {}).items():
                join_parts(spark, f"{parts}/{by}={value}", path.replace("{}", name), header, footer)
    finally:
        delete(spark, parts)


def csv_line(df: DataFrame, columns: list[str]) -> Column:
    """The columns as a CSV line: doubles with ten decimals of their exact value, nulls empty, texts quoted where they must be."""
    cells = []
    for name in columns:
        c, kind = F.col(name), df.schema[name].dataType.simpleString()
        if kind in ("double", "float"):
            # format_number rounds the exact binary value, half to even
            number = F.regexp_replace(F.format_number(c, 10), ",", "")
            text = F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(number)
        else:
            plain = c.cast("string")
            text = F.when(plain.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(plain, '"', '""'), F.lit('"'))).otherwise(plain)
        cells.append(F.coalesce(text, F.lit("")))
    return F.concat_ws(",", *cells).alias("value")
