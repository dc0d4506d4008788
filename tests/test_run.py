"""A run from files to reports over two lists, and the files it writes."""

import csv
import hashlib
import json

import pytest
from taxaflow import run
from taxaflow.operators import annotate, graphs
from taxaflow.params import FilterPolicy
from taxaflow.sinks import reports
from taxaflow.sources import annotations, references


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    (d / "a.tsv").write_text("seq\tq\nCATNIP\t6\nSTREAM\t2\n")
    (d / "b.csv").write_text("CATNIP,1\nWANDER,3\n")
    (d / "bg.fasta").write_text(">X1\nKCATNIPK\n>X2\nWANDERCATNIP\n>X3\nSTREA\n")
    line = lambda q, s, e, b: f"{q}\t{s}\t91.5\t50\t1\t0\t1\t50\t1\t50\t{e}\t{b}\n"
    (d / "hits.tsv").write_text(line("X1", "sp|O11111|A", 1e-30, 90) + line("X2", "sp|O22222|B", 1e-30, 80) + line("X2", "sp|O33333|C", 1e-2, 99))
    (d / "subjects.fasta").write_text(">sp|O11111|A one OX=31\nM\n>sp|O22222|B two OX=33\nM\n>sp|O33333|C no\nM\n")
    gaf = lambda acc, go: "\t".join(["U", acc, "s", "enables", go, "r", "IDA", "w", "F"]) + "\n"
    (d / "a.gaf").write_text("!gaf\n" + gaf("O11111", "GO:0000110") + gaf("O22222", "GO:0000111"))
    nodes = {2: None, 5: 2, 12: 5, 13: 5, 31: 12, 33: 13}
    (d / "tax.json").write_text(json.dumps({"nodes": {i: {"name": f"n{i}", "rank": "clade", "parent_tax_id": p} for i, p in nodes.items()}}))
    stanza = lambda i, *up: f"[Term]\nid: GO:0000{i}\nname: t{i}\nnamespace: molecular_function\n" + "".join(f"is_a: GO:0000{u}\n" for u in up) + "\n"
    (d / "go.obo").write_text("format-version: 1.2\n\n" + stanza(101) + stanza(110, 101) + stanza(111, 101))
    return d


def rows_of(path):
    with open(path, newline="") as file:
        return list(csv.DictReader(file))


def test_run_over_two_lists(spark, files, tmp_path):
    d = files
    run.build_annotations(spark, f"{d}/subjects.fasta", f"{d}/a.gaf", f"{tmp_path}/ann")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/ann/metadata").collect()} == {("taxonomy_count", "2"), ("go_annotations_count", "2")}
    inputs = run.Inputs((f"{d}/a.tsv", f"{d}/b.csv"), f"{d}/bg.fasta", f"{d}/hits.tsv", f"{tmp_path}/ann", f"{d}/go.obo", f"{d}/tax.json")
    assert run.run(spark, inputs, f"{tmp_path}/out", FilterPolicy(max_evalue=1e-10, top_k=1)) == ["list_000", "list_001"]
    first, second = tmp_path / "out/list_000", tmp_path / "out/list_001"
    # CATNIP is in X1 and X2, so its organisms 31 and 33 meet in 5; WANDER is in X2 only.
    assert {(r["tax_id"], float(r["quantity"])) for r in rows_of(first / "taxonomy_nodes.csv")} == {("2", 6.0), ("5", 6.0)}
    assert {(r["tax_id"], float(r["quantity"])) for r in rows_of(second / "taxonomy_nodes.csv")} == {("2", 4.0), ("5", 4.0), ("13", 3.0), ("33", 3.0)}
    assert {(r["go_id"], r["parent_go_ids"], float(r["quantity"])) for r in rows_of(second / "go_terms.csv")} == {("GO:0000101", "", 4.0), ("GO:0000110", "GO:0000101", 1.0), ("GO:0000111", "GO:0000101", 4.0)}
    (cover,) = rows_of(first / "coverage.csv")
    assert (float(cover["total_quantity"]), float(cover["annotated_quantity"]), cover["n_peptides"]) == (8.0, 6.0, "2")
    combos = rows_of(first / "go_taxonomy_combo.csv")
    assert len(combos) == 6 and list(combos[0]) == reports.COMBO_COLUMNS and combos[0]["parent_tax_id"] == ""
    details = (first / "peptide_details.csv").read_text().splitlines()
    assert details[1:] == ['"CATNIP","X1","sp|O11111|A",1.0E-30,91.5', '"CATNIP","X2","sp|O22222|B",1.0E-30,91.5']
    reports.mapping_view(spark, f"{second}/peptide_mapping.parquet")
    assert spark.sql("select count(*) from mappings where array_contains(peptide_lca_tax_ids, 33)").first()[0] == 1
    assert (tmp_path / "out/hit_proteins.fasta").read_text() == ">X1\nKCATNIPK\n>X2\nWANDERCATNIP\n"
    told = json.loads((tmp_path / "out/manifest.json").read_text())["inputs"]
    assert len(told) == 7 and told["background"] == hashlib.sha256((d / "bg.fasta").read_bytes()).hexdigest()
    assert {k.split("/")[0] for k in told["annotations"]} == {"taxonomy", "go_annotations", "metadata"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["hit_proteins.fasta", "list_000", "list_001", "manifest.json"]


def test_run_with_mock_sources_and_a_list_without_annotations(spark, files, tmp_path):
    """Mock hits name a protein that no peptide is in; one list has no match, one only peptides without organisms."""
    d = files
    (tmp_path / "c.tsv").write_text("NOWHERE\t2\n")
    (tmp_path / "hits.json").write_text(json.dumps({"background_to_subjects": {"X1": ["S1"], "X2": ["S2", "S3"], "X3": ["S4"]}}))
    (tmp_path / "subjects.json").write_text(json.dumps({"subjects": {"S1": {"tax_id": 31, "go_terms": ["GO:0000110"]}, "S2": {"tax_id": 12, "go_terms": []}, "S4": {"tax_id": 2, "go_terms": ["GO:0000111"]}}}))
    uri = f"file://{tmp_path}/out"
    inputs = run.Inputs((f"{d}/a.tsv", f"{tmp_path}/c.tsv"), f"{d}/bg.fasta", f"{tmp_path}/hits.json", f"{tmp_path}/subjects.json", f"{d}/go.obo", f"{d}/tax.json")
    run.run(spark, inputs, uri)
    first, second = tmp_path / "out/list_000", tmp_path / "out/list_001"
    assert [(r["tax_id"], r["quantity"], r["n_peptides"]) for r in rows_of(first / "taxonomy_nodes.csv")] == [(t, "6.0000000000", "1") for t in ("2", "5", "12")]
    assert [r["go_id"] for r in rows_of(first / "go_terms.csv")] == ["GO:0000101", "GO:0000110"]
    assert rows_of(second / "taxonomy_nodes.csv") == [] and (second / "go_terms.csv").read_text().startswith("go_id,name")
    assert rows_of(second / "coverage.csv")[0]["annotation_coverage_ratio"] == "0.0000000000"
    assert spark.read.parquet(f"{second}/peptide_mapping.parquet").count() == 0 and len(spark.read.parquet(f"{second}/peptide_mapping.parquet").columns) == 7
    assert len((first / "peptide_details.csv").read_text().splitlines()) == 1 + 3


def test_csv_cells(spark, tmp_path):
    """Many parts, in order, as a plain writer would have them."""
    rows = [(i, f'te"x,t\n{i}' if i % 3 else "plain", i / 7 * 10.0 ** (i % 9 - 7), None if i % 4 else "") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d string").repartition(9).orderBy("a")
    reports.write_csv(df, f"{tmp_path}/x.csv")
    with open(tmp_path / "y.csv", "w", newline="") as file:
        out = csv.writer(file, lineterminator="\n")
        out.writerows([["a", "b", "c", "d"], *[[a, b, f"{c:.10f}", d or ""] for a, b, c, d in rows]])
    assert (tmp_path / "x.csv").read_text() == (tmp_path / "y.csv").read_text()


def test_missing_hits_and_an_empty_mapping(spark, files, tmp_path):
    assert references.read_hits(spark, f"{files}/none.tsv").count() == 0
    reports.write_mapping(spark.createDataFrame([], "peptide string, evalue double"), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").columns == ["peptide", "evalue"]


def test_normal_forms_read_back(spark, files, tmp_path):
    terms, edges = references.read_go(spark, f"{files}/go.obo")
    references.go_json(terms, edges).write.text(f"{tmp_path}/go.json")
    again = references.read_go_json(spark, f"{tmp_path}/go.json")
    assert {tuple(r) for r in again[0].collect()} == {tuple(r) for r in terms.collect()}
    assert {(r.child, r.edge_type, r.parent) for r in again[1].collect()} == {(r.child, r.edge_type, r.parent) for r in edges.collect()}
    taxa = references.read_taxonomy(spark, f"{files}/tax.json")
    references.taxonomy_json(taxa).write.text(f"{tmp_path}/tax.jsonl")
    assert {tuple(r) for r in references.read_taxonomy(spark, f"{tmp_path}/tax.jsonl").collect()} == {tuple(r) for r in taxa.collect()}


def test_ancestors_inside_a_view(spark, files):
    _, edges = references.read_go(spark, f"{files}/go.obo")
    found, path = graphs.ancestors(edges, "GO:0000110")
    assert {r.go_id for r in found.collect()} == {"GO:0000110", "GO:0000101"} and path.count() == 1
    inside = spark.createDataFrame([("GO:0000110",)], "go_id string")
    assert graphs.ancestors(edges, "GO:0000110", inside)[0].count() == 1


@pytest.mark.parametrize("join", ["shuffle", "broadcast"])
def test_lookup_in_tables_by_accession(spark, tmp_path, join):
    """Only the asked ids are shuffled. Ids share accessions; some have no organism, some no terms, some neither; null finds nothing."""
    taxonomy = spark.createDataFrame([(f"A{i}", i % 17) for i in range(300) if i % 3], "accession string, tax_id int")
    terms = spark.createDataFrame([(f"A{i}", f"GO:{k}", "P") for i in range(300) if i % 2 for k in range(i % 4)], "accession string, go_id string, aspect string")
    asked = [f"db|A{i}|n{k}" for i in range(0, 400, 7) for k in range(2)] + ["A11", "A11", "odd|id", None]
    ids = spark.createDataFrame([(a,) for a in asked], "subject_id string")
    folder = f"{tmp_path}/it's here"
    for buckets in (3, 16):  # written again, with another layout
        reports.write_annotation_tables(taxonomy, terms, folder, buckets)
    stored = [annotations.read_by_accession(spark, f"{folder}/{name}") for name in ("taxonomy", "go_annotations")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if join == "shuffle" else "10m")
    try:
        found = annotate.lookup_subjects(ids, *stored).select("subject_id", "accession", "tax_id", "go_id")
        got, plan = found.collect(), found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    of = dict(taxonomy.collect())
    goes = {}
    for a, g, _ in terms.collect():
        goes.setdefault(a, []).append(g)
    want = []
    for s in set(asked):
        a = s and (s.split("|")[1] if s.startswith("db|") else s)
        want += [(s, a, of.get(a), g) for g in goes.get(a, [None])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    if join == "shuffle":
        final = plan.split("== Initial Plan ==")[0]
        # One for distinct ids, one to the buckets.
        assert final.count("Exchange hashpartitioning") == 2 and "hashpartitioning(accession" in final and "16)" in final


def test_empty_and_plain_annotation_tables(spark, tmp_path):
    taxonomy = spark.createDataFrame([], "accession string, tax_id int")
    reports.write_annotation_tables(taxonomy, taxonomy.selectExpr("accession", "accession as go_id"), f"{tmp_path}/none")
    assert [annotations.read_by_accession(spark, f"{tmp_path}/none/{t}").count() for t in ("taxonomy", "go_annotations")] == [0, 0]
    spark.createDataFrame([("A1", 3)], taxonomy.schema).write.parquet(f"{tmp_path}/plain")
    assert annotations.read_by_accession(spark, f"{tmp_path}/plain").collect() == [("A1", 3)]
    assert annotations.buckets_for(0) == annotations.LEAST_BUCKETS and annotations.buckets_for(10**9) == 512
