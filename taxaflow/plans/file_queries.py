"""Registered queries of the readers: the driver's tables are written as files of a format, and the reader's rows are compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_sequence, upper_letters
from ..operators import annotate, graphs
from ..run import matched_lists
from ..sinks import reports
from ..sources import peptides, proteins, references
from ..sources.annotations import read_by_accession
from ..sources.lines import numbered_lines, ordered_lines, running
from .queries import _gaf_lines, query
from .tables import shared_folder


def _folder(spark: SparkSession) -> str:
    """A new folder's name; the folder goes when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def _file(lines: DataFrame, name: str = "lines.txt", folder: str | None = None, one: bool = False) -> str:
    """Where the rows of the one column of lines now stand as text files; the folder goes when the driver's JVM ends."""
    spark = lines.sparkSession
    folder = folder or _folder(spark)
    (lines.coalesce(1) if one else lines).write.text(f"{folder}/{name}")
    return f"{folder}/{name}"


def _text(*parts) -> DataFrame:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


@query("select cast(p_partkey as varchar) as protein_id, p_name as description, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') as sequence from part")
def fasta_reader(v):
    sequence = normalize_sequence(F.col("p_name"))
    lines = v.table("part").select(_text(">", F.col("p_partkey"), " ", F.col("p_name"), "\n", F.substring(sequence, 1, 7), "\n", F.expr("substring(regexp_replace(upper(p_name), '[^A-Z]', ''), 8)")))
    return proteins.read_fasta(v.spark, _file(lines.repartition(2))).select("protein_id", "description", "sequence")


@query("select cast(p_partkey % 500 as varchar) as protein_id, upper(arg_max(p_name, p_partkey)) as sequence from part group by p_partkey % 500")
def fasta_last_wins(v):
    """Records that repeat ids within and between three files: the last one by file and place counts."""
    lines = v.table("part").repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").select(_text(">", F.col("p_partkey") % 500, "\n", F.upper("p_name")))
    return proteins.last_records(proteins.read_fasta(v.spark, _file(lines)))


@query("select row_number() over (order by p_partkey) as number, p_name as value from part")
def line_numbers(v):
    """Lines of three files, numbered without a window over any."""
    lines = v.table("part").repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").select(F.col("p_name").alias("value"))
    return numbered_lines(v.spark, _file(lines)).select("number", "value")


@query("select 'O' || cast(10000 + s_suppkey as varchar) as accession, s_suppkey as tax_id from supplier where s_suppkey % 3 <> 0")
def fasta_taxa_reader(v):
    ox = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" OX="), F.col("s_suppkey"))).otherwise("")
    lines = v.table("supplier").select(_text(">sp|O", 10000 + F.col("s_suppkey"), "|NAME some protein", ox, " GN=x\nMK"))
    return proteins.read_fasta_taxa(v.spark, _file(lines)).select("accession", "tax_id")


@query("select cast(l_orderkey as varchar) as query_id, cast(l_suppkey as varchar) as subject_id, l_discount as evalue, l_extendedprice as bitscore, l_quantity as pident, l_linenumber as alnlen, cast(0 as double) as qcov from lineitem")
def hits_reader(v):
    cells = [F.col(c).cast("string") for c in ("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")] + [F.lit("0")] * 6 + [F.col(c).cast("string") for c in ("l_discount", "l_extendedprice")]
    lines = v.lineitem.select(F.concat_ws("\t", *cells).alias("value"))
    return references.read_hits(v.spark, _file(lines)).select("query_id", "subject_id", "evalue", "bitscore", "pident", "alnlen", "qcov")


@query("select cast(l_orderkey as varchar) as accession, cast(l_partkey as varchar) as go_id from lineitem where l_returnflag <> 'N' and l_linestatus <> 'O'")
def gaf_reader(v):
    return proteins.read_gaf(v.spark, _file(_gaf_lines(v).select("value"))).select("accession", "go_id")


@query("select 'list_000' as list_id, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') as peptide, cast(sum(p_size) as double) as quantity from part group by all")
def peptide_reader(v):
    lines = v.table("part").select(_text('"', F.col("p_name"), "[", F.col("p_partkey"), ']"\t', F.col("p_size")))
    return peptides.read_peptides(v.spark, _file(lines.repartition(3)))


@query("select tax_id, name, rank, parent_tax_id from taxon", "taxon")
def ncbi_reader(v):
    sep = "\t|\t"
    nodes = v.taxa.select(_text(F.col("tax_id"), sep, F.coalesce("parent_tax_id", "tax_id"), sep, F.col("rank"), "\t|"))
    names = v.taxa.select(_text(F.col("tax_id"), sep, F.col("name"), sep, sep, "scientific name\t|\n", F.col("tax_id"), sep, "other", sep, sep, "synonym\t|"))
    folder = f"{shared_folder(v.spark)}/files-{uuid.uuid4().hex}"
    _file(nodes, "nodes.dmp", folder)
    _file(names, "names.dmp", folder)
    return references.read_ncbi(v.spark, folder)


@query("select tax_id, name, rank, parent_tax_id from taxon", "taxon")
def taxonomy_json_reader(v):
    return references.read_taxonomy(v.spark, _file(references.taxonomy_json(v.taxa), "taxonomy.jsonl"))


@query("select tax_id, name, rank, parent_tax_id from taxon", "taxon")
def taxonomy_nodes_json_reader(v):
    """The normal form with one object of all nodes."""
    path = f"{shared_folder(v.spark)}/files-{uuid.uuid4().hex}/taxonomy.json"
    references.write_taxonomy_json(v.taxa, path)
    return references.read_taxonomy(v.spark, path)


@query("select n.tax_id, n.name, n.rank, coalesce(n.parent_tax_id, 0) as parent_tax_id, n.quantity, n.n_peptides from reported n", "reported", branch=True)
def report_csv(v):
    """The report's file read back; a missing parent reads as 0."""
    path = _free_path(v, "report.csv")
    reports.write_csv(reports.taxonomy_report(v.annotated.taxonomy_nodes(), v.taxa), path)
    schema = "tax_id bigint, name string, rank string, parent_tax_id bigint, quantity double, ratio_total double, ratio_annotated double, n_peptides bigint"
    return references.read_report(v.spark, path, schema).select("tax_id", "name", "rank", "parent_tax_id", "quantity", "n_peptides")


@query(
    "select row_number() over (order by cast(peptide as varchar), cast(background_protein as varchar), cast(annotated_protein as varchar)) as place, peptide, background_protein, annotated_protein, evalue from"
    " (select distinct peptide, background_protein, annotated_protein, evalue, pident from mapping)",
    "mapping", branch=True,
)
def details_csv(v):
    """The details' file read back, with the place of each row in it."""
    path = _free_path(v, "details.csv")
    ids = {c: F.col(c).cast("string") for c in ("peptide", "background_protein", "annotated_protein")}
    reports.write_details(v.annotated.found_pairs().withColumns(ids), path)
    cells = F.split(F.regexp_replace("value", '"', ""), ",")
    at = lambda k, kind: F.get(cells, F.lit(k)).cast(kind)
    rows = numbered_lines(v.spark, path).where("number > 1")
    return rows.select((F.col("number") - 1).alias("place"), at(0, "bigint").alias("peptide"), at(1, "bigint").alias("background_protein"), at(2, "bigint").alias("annotated_protein"), at(3, "double").alias("evalue"))


@query("select row_number() over (order by cast(p_partkey as varchar)) as place, '>' || p_partkey || '|' || rtrim(regexp_replace(p_name, '(.{5})', '\\1|', 'g'), '|') as record from part where p_partkey in (select peptide from match_)", "match_")
def hit_fasta(v):
    """The FASTA file of hit proteins, wrapped every five letters, with the place of each record."""
    path = _free_path(v, "hits.fasta")
    proteins_ = v.table("part").select(F.col("p_partkey").cast("string").alias("protein_id"), F.col("p_name").alias("sequence"))
    reports.write_fasta(reports.subset_fasta(proteins_, v.matches.select(F.col("peptide").cast("string").alias("protein_id")), 5), path)
    lines = running(ordered_lines(v.spark, path), F.col("value").startswith(">"))
    return lines.groupBy(F.col("running").alias("place")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x.value), "|").alias("record"))


def _free_path(v, name: str) -> str:
    """A path in a folder that goes when the driver's JVM ends."""
    folder = f"{shared_folder(v.spark)}/files-{uuid.uuid4().hex}"
    path = v.spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(v.spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{folder}/{name}"


def _obo(v) -> str:
    tags = v.edges.select("child", F.when(F.col("edge_type") == "is_a", F.concat(F.lit("is_a: "), "parent")).otherwise(F.concat(F.lit("relationship: part_of "), "parent")).alias("tag"))
    tags = tags.groupBy(F.col("child").alias("go_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("tag", F.lit(" ! a comment\n")))), "").alias("tags"))
    old = F.when(F.col("is_obsolete"), "is_obsolete: true\n").otherwise("")
    stanzas = v.terms.join(tags, "go_id", "left").select(_text("[Term]\nid: ", F.col("go_id"), "\nname: ", F.col("name"), "\nnamespace: ", F.col("namespace"), "\n", F.coalesce("tags", F.lit("")), old))
    return _file(stanzas.repartition(2), "terms.obo")


@query("select cast(go_id as varchar) as go_id, name, namespace, is_obsolete from go_term", "go_term")
def obo_terms_reader(v):
    return references.read_go(v.spark, _obo(v))[0]


@query("select cast(child as varchar) as child, edge_type, cast(parent as varchar) as parent from go_edge where child not in (select go_id from go_term where is_obsolete)", "go_edge", "go_term")
def obo_edges_reader(v):
    return references.read_go(v.spark, _obo(v))[1]


@query("select cast(go_id as varchar) as go_id, name, namespace, is_obsolete from go_term", "go_term")
def go_json_reader(v):
    as_text = [v.edges.select(F.col("child").cast("string"), "edge_type", F.col("parent").cast("string")), v.terms.withColumn("go_id", F.col("go_id").cast("string"))]
    return references.read_go(v.spark, _file(references.go_json(as_text[1], as_text[0]), "go.json", one=True))[0]


@query("select ancestor as go_id from closure_ where go_id = 35", "closure_")
def go_ancestors(v):
    return graphs.ancestors(v.edges, 35)[0]


@query(
    "select distinct 'list_' || cast(i.k as varchar) as list_id, b.item_id, d.doc_id from benchmark b join (values (0), (1), (2)) i(k) on i.k <= b.item_id % 3 join documents d on contains(upper(d.text), upper(b.text)) where b.text <> ''"
)
def matches_by_list(v):
    """Lists that share peptides: they are looked for once."""
    items = v.table("benchmark").select("item_id", upper_letters(F.col("text")).alias("peptide"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("item_id") % 3)).alias("k"))
    items = items.withColumn("list_id", F.concat(F.lit("list_"), F.col("k")))
    texts = v.table("documents").select(F.col("doc_id").alias("protein_id"), F.col("text").alias("sequence"))
    found = matched_lists(items.select("list_id", "peptide").distinct(), texts)
    return found.join(items, ["list_id", "peptide"]).select("list_id", "item_id", F.col("protein_id").alias("doc_id")).distinct()


@query(
    "select c.tax_id, t.name as tax_name, t.rank as tax_rank, t.parent_tax_id, c.go_id, case when g.is_obsolete then 'OBSOLETE: ' || g.name else g.name end as go_name, g.namespace as go_namespace,"
    " coalesce((select string_agg(cast(p as varchar), ';' order by cast(p as varchar)) from (select distinct parent as p from go_edge e where e.child = c.go_id)), '') as parent_go_ids,"
    " c.quantity, c.fraction_of_taxon, c.fraction_of_go, c.ratio_total_taxon, c.ratio_total_go, c.n_peptides from combos c join taxon t on t.tax_id = c.tax_id join go_term g on g.go_id = c.go_id",
    "combos", "taxon", "go_term", "go_edge", branch=True,
)
def combo_report(v):
    return reports.combo_report(v.annotated.combos(), v.taxa, v.terms, v.edges)


@query(
    "select 'db|' || cast(a.k as varchar) || '|' || cast(a.n as varchar) as subject_id, cast(a.k as varchar) as accession, t.p_size as tax_id, g.go_id"
    " from (select distinct l_partkey as k, l_linenumber as n from lineitem) a left join (select p_partkey, p_size from part where p_partkey % 10 <> 9) t on t.p_partkey = a.k"
    " left join (select distinct l_partkey, l_suppkey as go_id from lineitem where l_linenumber <= 2) g on g.l_partkey = a.k"
)
def lookup_by_accession(v):
    """Asked ids share accessions; a tenth of those has no organism, others no functions. The tables are written by accession, then asked."""
    lines = v.table("lineitem")
    taxonomy = v.table("part").where("p_partkey % 10 <> 9").select(F.col("p_partkey").cast("string").alias("accession"), F.col("p_size").alias("tax_id"))
    functions = lines.where("l_linenumber <= 2").select(F.col("l_partkey").cast("string").alias("accession"), F.col("l_suppkey").alias("go_id")).distinct()
    folder = _folder(v.spark)
    reports.write_annotation_tables(taxonomy, functions, folder)
    ids = lines.select(F.concat_ws("|", F.lit("db"), "l_partkey", "l_linenumber").alias("subject_id"))
    return annotate.lookup_subjects(ids, *(read_by_accession(v.spark, f"{folder}/{name}") for name in ("taxonomy", "go_annotations")))
