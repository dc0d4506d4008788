"""Reference graphs (ontology, taxonomy), homology hits and annotations from their usual formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import files
from .lines import field, ordered_lines, running


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_hits(spark: SparkSession, path: str, columns: str = "query_id subject_id pident alnlen mismatch gapopen qstart qend sstart send evalue bitscore") -> DataFrame:
    """Tabular aligner output: query_id, subject_id, evalue, bitscore, pident, qcov, alnlen, line.

    qcov comes from its column, else from alnlen / qlen, else it is 0. Blank lines and comments are skipped.
    """
    names = columns.split()
    missing = {"query_id", "subject_id", "evalue", "bitscore", "pident", "alnlen"} - {*names}
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    parts = F.split("value", "\t")
    if not exists(spark, path):  # no hits were written
        return spark.createDataFrame([], "query_id string, subject_id string, evalue double, bitscore double, pident double, qcov double, alnlen int, line struct<file:string,block:bigint,n:bigint>")
    rows = ordered_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("p", parts)
    at = {name: field(F.col("p"), k) for k, name in enumerate(names)}
    number = lambda name: at[name].cast("double")
    if "qcov" in at:
        qcov = number("qcov")
    elif "qlen" in at:
        qcov = F.when(number("qlen") > 0, number("alnlen") / number("qlen") * 100).otherwise(0.0)
    else:
        qcov = F.lit(0.0)
    numbers = [number(c).alias(c) for c in ("evalue", "bitscore", "pident")]
    return rows.select(at["query_id"].alias("query_id"), at["subject_id"].alias("subject_id"), *numbers, qcov.alias("qcov"), at["alnlen"].cast("int").alias("alnlen"), "line")


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms: go_id, name, namespace, is_obsolete; edges: child, edge_type, parent) of an ontology's [Term] stanzas.

    A value ends at the first `!`. Stanzas are numbered split by split.
    """
    rows = ordered_lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", r"\s*!.*$", "")))
    rows = running(rows, F.col("value").startswith("[")).withColumnRenamed("running", "stanza").where("stanza > 0")
    kinds = rows.where("value = '[Term]'").select("stanza")
    tags = rows.join(kinds, "stanza", "left_semi").where(F.contains("value", F.lit(":")))
    tags = tags.select("stanza", "line", F.regexp_extract("value", r"^([^:]+):\s*(.*)$", 1).alias("tag"), F.regexp_extract("value", r"^([^:]+):\s*(.*)$", 2).alias("v"))
    one = lambda tag: F.min_by(F.when(F.col("tag") == tag, F.col("v")), F.when(F.col("tag") == tag, F.col("line")))
    terms = tags.groupBy("stanza").agg(one("id").alias("go_id"), F.coalesce(one("name"), F.lit("")).alias("name"), F.coalesce(one("namespace"), F.lit("")).alias("namespace"), F.coalesce(F.lower(one("is_obsolete")) == "true", F.lit(False)).alias("is_obsolete"))
    terms = terms.where("go_id is not null")
    # The last stanza of an id wins.
    terms = terms.groupBy("go_id").agg(F.max(F.struct("stanza", "name", "namespace", "is_obsolete")).alias("t")).select("go_id", "t.*")
    words = F.split("v", r"\s+")
    edges = tags.where("tag in ('is_a', 'relationship')").join(terms.where("not is_obsolete").select("stanza", "go_id"), "stanza")
    kind = F.when(F.col("tag") == "is_a", "is_a").otherwise(F.get(words, F.lit(0)))
    parent = F.when(F.col("tag") == "is_a", F.get(words, F.lit(0))).otherwise(F.get(words, F.lit(1)))
    edges = edges.select(F.col("go_id").alias("child"), kind.alias("edge_type"), parent.alias("parent")).where("parent is not null and parent <> ''").distinct()
    return terms.select("go_id", "name", "namespace", "is_obsolete"), edges


def read_go_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same tables from {terms, edges, obsolete_terms}. Edges of unknown children are dropped, unknown parents stay."""
    text = spark.read.text(path, wholetext=True)
    term = "map<string,struct<name:string,namespace:string>>"
    doc = text.select(F.from_json("value", f"struct<terms:{term},edges:map<string,array<array<string>>>,obsolete_terms:{term}>").alias("d"))
    terms = doc.select(F.explode("d.terms").alias("go_id", "t")).select("go_id", "t.name", "t.namespace", F.lit(False).alias("is_obsolete"))
    old = doc.where("d.obsolete_terms is not null").select(F.explode("d.obsolete_terms").alias("go_id", "t")).select("go_id", "t.name", "t.namespace", F.lit(True).alias("is_obsolete"))
    edges = doc.select(F.explode("d.edges").alias("edge_type", "e")).select("edge_type", F.explode("e").alias("e"))
    edges = edges.select(F.get("e", F.lit(0)).alias("child"), "edge_type", F.get("e", F.lit(1)).alias("parent"))
    edges = edges.join(terms.select(F.col("go_id").alias("child")), "child", "left_semi").distinct()
    return terms.unionByName(old), edges


def go_json(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """value: the normal form {terms, edges, obsolete_terms} that read_go_json reads, as one row: an ontology is one small file."""
    entry = F.struct("go_id", F.struct("name", "namespace"))
    named = terms.agg(*[F.map_from_entries(F.collect_list(F.when(F.col("is_obsolete") == old, entry))).alias(name) for name, old in (("terms", False), ("obsolete_terms", True))])
    kinds = edges.groupBy("edge_type").agg(F.array_sort(F.collect_list(F.array("child", "parent"))).alias("pairs")).agg(F.map_from_entries(F.collect_list(F.struct("edge_type", "pairs"))).alias("edges"))
    return named.crossJoin(kinds).select(F.to_json(F.struct("terms", "edges", "obsolete_terms")).alias("value"))


def taxonomy_json(taxa: DataFrame) -> DataFrame:
    """value: one line for each node, `{"tax_id", "name", "rank", "parent_tax_id"}`, null parents left out; any number of nodes."""
    return taxa.select(F.to_json(F.struct("tax_id", "name", "rank", "parent_tax_id")).alias("value"))


def write_taxonomy_json(taxa: DataFrame, path: str) -> None:
    """The normal form {nodes} as one file with a line for each node, in order of id."""
    node = F.to_json(F.struct("name", "rank", "parent_tax_id"), {"ignoreNullFields": "false"})
    line = F.concat(F.lit('"'), F.col("tax_id").cast("string"), F.lit('": '), node)
    first = taxa.agg(F.min("tax_id").alias("m"))
    mark = F.when(F.col("tax_id") == F.col("m"), "").otherwise(",")
    rows = taxa.crossJoin(F.broadcast(first)).orderBy("tax_id").select(F.concat(mark, line).alias("value"))  # one row
    files.write_lines(rows, path, '{"nodes": {\n', footer="}}\n")


def read_go(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    if path.endswith(".obo"):
        return read_obo(spark, path)
    if path.endswith(".json"):
        return read_go_json(spark, path)
    raise ValueError(f"an ontology is an .obo or a .json file: {path}")


def read_ncbi(spark: SparkSession, folder: str) -> DataFrame:
    """tax_id, name, rank, parent_tax_id from nodes.dmp and names.dmp; the last line of an id wins."""
    def parts(name: str) -> DataFrame:
        return ordered_lines(spark, f"{folder}/{name}").withColumn("p", F.split("value", r"\|"))

    at = lambda k: field(F.col("p"), k)
    nodes = parts("nodes.dmp").where(F.size("p") >= 3).groupBy(at(0).cast("bigint").alias("tax_id"))
    nodes = nodes.agg(F.max_by(F.struct(at(1).cast("bigint").alias("parent"), at(2).alias("rank")), "line").alias("v"))
    names = parts("names.dmp").where((F.size("p") >= 4) & (at(3) == "scientific name")).groupBy(at(0).cast("bigint").alias("tax_id")).agg(F.max_by(at(1), "line").alias("name"))
    name = F.coalesce("name", F.concat(F.lit("taxid_"), F.col("tax_id").cast("string")))
    return nodes.join(names, "tax_id", "left").select("tax_id", name.alias("name"), "v.rank", F.nullif(F.col("v.parent"), F.col("tax_id")).alias("parent_tax_id"))


def read_taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """tax_id, name, rank, parent_tax_id of {nodes}, or of a .jsonl folder or file of taxonomy_json's lines.

    {nodes} with a line for each node, as write_taxonomy_json has it, is read line by line; any other layout as one text.
    """
    if path.endswith(".jsonl"):
        return spark.read.schema("tax_id bigint, name string, rank string, parent_tax_id bigint").json(path)
    node = "struct<name:string,rank:string,parent_tax_id:bigint>"
    lines = spark.read.text(path).where(~F.col("value").rlike(r'^\s*(\{"nodes": \{|\}\})?\s*$'))
    parts = lambda k: F.regexp_extract("value", r'^,?"(-?\d+)": (\{.*\})$', k)
    if lines.where(parts(1) == "").isEmpty():
        rows = lines.select(parts(1).cast("bigint").alias("tax_id"), F.from_json(parts(2), node).alias("t"))
        return rows.select("tax_id", "t.name", "t.rank", "t.parent_tax_id")
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", f"struct<nodes:map<string,{node}>>").alias("d"))
    return doc.select(F.explode("d.nodes").alias("tax_id", "t")).select(F.col("tax_id").cast("bigint"), "t.name", "t.rank", "t.parent_tax_id")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return read_taxonomy_json(spark, path) if path.endswith((".json", ".jsonl")) else read_ncbi(spark, path)


def read_mock_hits(spark: SparkSession, path: str) -> DataFrame:
    """query_id, subject_id of {background_to_subjects}."""
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", "struct<background_to_subjects:map<string,array<string>>>").alias("d"))
    return doc.select(F.explode("d.background_to_subjects").alias("query_id", "s")).select("query_id", F.explode("s").alias("subject_id")).distinct()


def read_mock_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(subject_id, tax_id), (subject_id, go_id) of {subjects}."""
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", "struct<subjects:map<string,struct<tax_id:bigint,go_terms:array<string>>>>").alias("d"))
    rows = doc.select(F.explode("d.subjects").alias("subject_id", "t"))
    return rows.select("subject_id", "t.tax_id"), rows.select("subject_id", F.explode("t.go_terms").alias("go_id"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report file; numbers that do not parse are 0, rows that are too short are dropped."""
    names = [x.split()[0] for x in schema.split(",")]
    raw = spark.read.csv(path, header=True, escape='"', mode="DROPMALFORMED", schema=", ".join(f"{n} string" for n in names))
    kinds = [x.split()[1] for x in schema.split(",")]
    cast = [F.col(n) if k == "string" else F.coalesce(F.expr(f"try_cast({n} as {k})"), F.lit(0).cast(k)).alias(n) for n, k in zip(names, kinds)]
    return raw.select(*cast)
