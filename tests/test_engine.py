"""The annotation engine on a hand-made scenario, on odd rows, and against plain models."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from taxaflow import params
from taxaflow.functions import text as fn
from taxaflow.operators import aggregate, closing, graphs, hierarchy, hits, matching
from taxaflow.params import FilterPolicy, GoOptions
from taxaflow.plans import tables
from taxaflow.plans.pipeline import Annotated
from taxaflow.plans.views import Views
from taxaflow.sinks import reports
from taxaflow.sources import lines, peptides, proteins, references

#: A small tree (id: parent) and graph of our own: 12 and 13 below 5, 41 in another branch.
CHAIN = {2: None, 5: 2, 6: 2, 12: 5, 13: 5, 31: 12, 32: 12, 33: 13, 41: 6}
EDGES = [("is_a", c, p) for c, p in ((102, 101), (103, 101), (110, 102), (111, 103))] + [("part_of", 111, 102)]


def go(n):
    return f"GO:{n:07d}"


@pytest.fixture(scope="module")
def scenario(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("scenario")
    (d / "bg.fasta").write_text(">P10 first\nMKWAND\nERSK\n\n>P11\nGGWANDERQQ\n>P12\nllstreamll\n>P13\nVVVV\n")
    (d / "list.tsv").write_text("peptide_sequence\tquantity\nWANDER\t12\nSTREAM\t4\nLOST\t8\n")
    (d / "hits.json").write_text(json.dumps({"background_to_subjects": {"P10": ["S7"], "P11": ["S8", "S9"], "P12": []}}))
    subjects = {"S6": (41, [go(110)]), "S7": (31, [go(110)]), "S8": (32, [go(111)]), "S9": (33, [go(103)])}
    (d / "subjects.json").write_text(json.dumps({"subjects": {k: {"tax_id": t, "go_terms": g} for k, (t, g) in subjects.items()}}))
    (d / "tax.json").write_text(json.dumps({"nodes": {str(i): {"name": f"n{i}", "rank": "r", "parent_tax_id": p} for i, p in CHAIN.items()}}))
    edges = {k: [[go(c), go(p)] for kind, c, p in EDGES if kind == k] for k in ("is_a", "part_of")}
    (d / "go.json").write_text(json.dumps({"terms": {go(n): {"name": f"t{n}", "namespace": "biological_process"} for n in (101, 102, 103, 110, 111)}, "edges": edges}))
    own = peptides.read_peptides(spark, f"{d}/list.tsv")
    found = matching.matches(own, proteins.last_records(proteins.read_fasta(spark, f"{d}/bg.fasta")))
    tax, terms_of = references.read_mock_annotations(spark, f"{d}/subjects.json")
    terms, go_edges = references.read_go(spark, f"{d}/go.json")
    taxa = references.read_taxonomy(spark, f"{d}/tax.json")
    return Annotated(own, found, tax, terms_of, taxa, go_edges, given=references.read_mock_hits(spark, f"{d}/hits.json")), terms, go_edges, taxa


def test_scenario(scenario):
    run, terms, edges, taxa = scenario
    assert {tuple(r) for r in run.matches.collect()} == {("WANDER", "P10"), ("WANDER", "P11"), ("STREAM", "P12")}
    c = run.coverage().first()
    assert (c.total_quantity, c.annotated_quantity, c.unannotated_quantity, c.n_peptides, c.n_annotated, c.n_unannotated, c.annotation_coverage_ratio) == (24, 12, 12, 3, 1, 2, 0.5)
    assert [tuple(r) for r in run.lcas.collect()] == [("WANDER", 5)]
    nodes = reports.taxonomy_report(run.taxonomy_nodes(), taxa).collect()
    assert [(r.tax_id, r.parent_tax_id, r.quantity, r.ratio_total, r.ratio_annotated, r.n_peptides) for r in nodes] == [(2, None, 12, 0.5, 1, 1), (5, 2, 12, 0.5, 1, 1)]
    rows = reports.terms_report(run.go_terms(), terms, edges, ("is_a", "part_of")).collect()
    assert [(r.go_id, r.parent_go_ids) for r in rows] == [(go(101), ""), (go(102), go(101)), (go(103), go(101)), (go(110), go(102)), (go(111), f"{go(102)};{go(103)}")]
    pairs = run.combos().collect()
    assert len(pairs) == 10 and all((r.quantity, r.fraction_of_taxon, r.fraction_of_go) == (12, 1, 1) for r in pairs)
    report = reports.combo_report(run.combos(), taxa, terms, edges).collect()
    assert (report[4].tax_id, report[4].go_id, report[4].parent_tax_id, report[4].parent_go_ids) == (2, go(111), None, f"{go(102)};{go(103)}") and len(report[0]) == 14
    mapped = run.mapping().orderBy("background_protein", "annotated_protein").collect()
    assert [(r.peptide, r.background_protein, r.annotated_protein) for r in mapped] == [("WANDER", "P10", "S7"), ("WANDER", "P11", "S8"), ("WANDER", "P11", "S9")]
    assert all(r.peptide_lca_tax_ids == [2, 5] and len(r.peptide_go_terms) == 5 and r.evalue is None for r in mapped)
    assert aggregate.violations(run.go_terms(), run.coverage(), "go_id").count() == 0
    assert aggregate.violations(run.taxonomy_nodes(), run.coverage(), "tax_id").count() == 0


def test_lists_in_one_job_and_no_table_left(spark, scenario):
    """Each list's rows are those of a run of its own; close() deletes what a run has written."""
    one, _, edges, taxa = scenario
    lists = {"x": [("WANDER", 12.0), ("LOST", 1.0)], "y": [("STREAM", 4.0), ("WANDER", 5.0)], "z": [("LOST", 2.0)]}
    given = {"subject_tax": one.subject_tax, "subject_go": one.subject_go, "taxa": taxa, "edges": edges, "given": one.given}
    before = tables_in(spark)
    together = Annotated(spark.createDataFrame([(k, *r) for k, rows in lists.items() for r in rows], "list_id string, peptide string, quantity double"), one.all_matches, by=("list_id",), **given)
    for made in (Annotated.coverage, Annotated.taxonomy_nodes, Annotated.go_terms, Annotated.combos, Annotated.mapping):
        found = made(together).collect()
        for name, rows in lists.items():
            alone = made(Annotated(spark.createDataFrame(rows, "peptide string, quantity double"), one.all_matches, **given)).collect()
            assert sorted(tuple(r)[1:] for r in found if r.list_id == name) == sorted(tuple(r) for r in alone if r[0] or made is not Annotated.coverage)
    kept = tables_in(spark)
    together.close()
    assert len(kept - tables_in(spark)) == 4 and before <= tables_in(spark)


def tables_in(spark):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("table-*")}


def test_report_files(scenario, tmp_path):
    run, _, _, taxa = scenario
    reports.write_csv(reports.taxonomy_report(run.taxonomy_nodes(), taxa), f"{tmp_path}/t.csv")
    rows = (tmp_path / "t.csv").read_text().splitlines()
    assert rows[1] == "2,n2,r,,12.0000000000,0.5000000000,1.0000000000,1" and len(rows) == 3


def frame_of_hits(spark, rows):
    rows = [(q, s, e, float(b), 90.0, 95.0, 100, n) for n, (q, s, e, b) in enumerate(rows)]
    return spark.createDataFrame(rows, "query_id string, subject_id string, evalue double, bitscore double, pident double, qcov double, alnlen int, line int")


@pytest.mark.parametrize("k, scores, want", [(2, (8, 5, 5, 1), 3), (1, (9, 9, 9, 2), 3), (3, (7, 6, 5, 4), 3), (None, (3, 2, 1, 0), 4)])
def test_top_k_keeps_ties(spark, k, scores, want):
    df = frame_of_hits(spark, [("Q", f"S{i}", 1e-10, s) for i, s in enumerate(scores)])
    assert hits.accepted(df, FilterPolicy(top_k=k)).count() == want


def test_values_come_from_the_last_line_even_if_it_failed(spark):
    df = frame_of_hits(spark, [("Q", "S", 1e-20, 100), ("Q", "S", 5.0, 10), ("Q", "T", float("nan"), 100), ("R", "S", 5.0, 1)])
    policy = FilterPolicy(max_evalue=1e-10, top_k=1)
    got = {(r.query_id, r.subject_id): r.evalue for r in hits.accepted_with_values(df, policy, F.col("line")).collect()}
    assert got[("Q", "S")] == 5.0 and ("Q", "T") in got and len(got) == 2
    assert {tuple(r) for r in hits.counters(df, policy).collect()} == {("Q", 3, 2, 2), ("R", 1, 0, 0)}


def test_policy_rejects_bad_values():
    for bad in ({"top_k": 0}, {"max_evalue": 0}, {"min_qcov": 101}, {"min_alnlen": 0}):
        with pytest.raises(ValueError):
            FilterPolicy(**bad)
    assert GoOptions.from_text("").edge_types == ("is_a", "part_of")


def test_lineage_and_lca_edge_cases(spark):
    taxa = spark.createDataFrame([(i, "n", "r", p) for i, p in CHAIN.items()] + [(80, "n", "r", 999), (90, "n", "r", 91), (91, "n", "r", 90)], "tax_id bigint, name string, rank string, parent_tax_id bigint")
    sets = {"a": {31, 32}, "b": {31, 33}, "c": {31, 41}, "d": {31}, "e": {777}, "f": {777, 31}, "g": {12, 31}, "h": {80}}
    rows = spark.createDataFrame([(k, t) for k, ts in sets.items() for t in ts] + [("n", None)], "peptide string, tax_id bigint")
    ways = graphs.lineage(taxa, rows.union(spark.createDataFrame([("x", 90)], rows.schema)))
    got = dict(map(tuple, graphs.lowest_common_of(rows, graphs.tree(taxa, rows)).collect()))
    assert got == {"a": 12, "b": 5, "c": 2, "d": 31, "e": 777, "g": 12, "h": 80}
    assert {r.ancestor_id for r in ways.where("tax_id = 80").collect()} == {80, 999}
    assert {r.ancestor_id for r in ways.where("tax_id = 90").collect()} == {90, 91}


def test_cycles_and_unknown_parents(spark):
    """Ways into cycles of several lengths end where they meet themselves; in a tree the least id of a cycle is its root."""
    up = {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 6, 8: 9, 9: 8, 10: 8, 11: 55, 12: None}
    taxa = spark.createDataFrame([(i, "n", "r", p) for i, p in up.items()], "tax_id bigint, name string, rank string, parent_tax_id bigint")
    want = {}
    for i in [*up, 55, 70]:
        way = [i]
        while (p := up.get(way[-1])) is not None and p not in way:
            way.append(p)
        want[i] = way
    ids = taxa.select("tax_id").union(spark.createDataFrame([(70,)], "tax_id bigint"))
    ways = {}
    for r in graphs.lineage(taxa, ids).orderBy("dist").collect():
        ways.setdefault(r.tax_id, []).append(r.ancestor_id)
    assert ways == {i: way for i, way in want.items() if i != 55}
    paths = {r.tax_id: r.path for r in graphs.tree(taxa, ids).collect()}
    assert paths[3] == [1, 3] and paths[2] == [1, 3, 2] and paths[5] == [1, 4, 5] and paths[10] == [8, 10] and paths[9] == [8, 9] and paths[11] == [55, 11] and paths[70] == [70] and paths[6] == [6]


def test_lowest_common_ancestors_and_ranges_of_random_trees(spark):
    rng = random.Random(3)
    parents = {0: None} | {i: rng.randrange(max(0, i - rng.choice([2, 40])), i) for i in range(1, 300)}
    taxa = spark.createDataFrame([(i, "n", "r", p) for i, p in parents.items()], "tax_id bigint, name string, rank string, parent_tax_id bigint")

    def way(i):
        return [i] + (way(parents[i]) if parents[i] is not None else [])

    sets = {k: {rng.randrange(max(1, 300 - rng.choice([10, 300])), 300) for _ in range(rng.randint(1, 5))} for k in range(150)}
    want = {k: next(a for a in way(min(s)) if all(a in way(x) for x in s)) for k, s in sets.items()}
    tree = graphs.tree(taxa, taxa)
    rows = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "peptide int, tax_id bigint")
    assert dict(map(tuple, graphs.lowest_common_of(rows, tree).collect())) == want
    for root in (0, 7, 299):
        assert {r.tax_id for r in graphs.descendants(taxa, root, graphs.ranges(tree)).collect()} == {i for i in parents if root in way(i)}


def test_lineage_of_a_deep_tree(spark):
    parent = F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_tax_id")
    taxa = spark.range(601).select(F.col("id").alias("tax_id"), F.lit("n").alias("name"), F.lit("r").alias("rank"), parent)
    ends = spark.createDataFrame([("p", 600), ("p", 411), ("q", 600)], "peptide string, tax_id bigint")
    assert dict(map(tuple, graphs.lowest_common_of(ends, graphs.tree(taxa, ends)).collect())) == {"p": 411, "q": 600}
    got = graphs.lineage(taxa, taxa.where("tax_id = 600")).collect()
    assert {(r.ancestor_id, r.dist) for r in got} == {(600 - d, d) for d in range(601)} and len(got) == 601


def test_closure_shuffles_no_pairs(spark):
    """However deep the graph, two tables are written, and pairs leave the tasks that make them as they are."""
    before = tables_in(spark)
    edges = spark.createDataFrame([(k, "is_a", k - 1) for k in range(1, 60)] + [(k, "is_a", k - 2) for k in range(2, 60)], "child bigint, edge_type string, parent bigint")
    pairs = graphs.closure(edges, spark.range(30, 62).withColumnRenamed("id", "go_id"))
    assert {tuple(r) for r in pairs.collect()} == {(i, a) for i in range(30, 60) for a in range(i + 1)} | {(60, 60), (61, 61)}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert len(tables_in(spark) - before) == 2 and "Join" not in plan and "Exchange" not in plan.split("MapInArrow")[0]


def test_closure(spark):
    edges = spark.createDataFrame([(c, k, p) for k, c, p in EDGES] + [(20, "is_a", 21), (21, "is_a", 20)], "child bigint, edge_type string, parent bigint")
    ids = spark.createDataFrame([(111,), (110,), (20,), (99,)], "go_id bigint")
    def closed(**options):
        out = {}
        for r in graphs.closure(edges, ids, **options).collect():
            out.setdefault(r.go_id, set()).add(r.ancestor)
        return out
    assert closed() == {111: {111, 103, 101}, 110: {110, 102, 101}, 20: {20, 21}, 99: {99}}
    assert closed(edge_types=("is_a", "part_of"), include_self=False) == {111: {103, 102, 101}, 110: {102, 101}, 20: {21}}


words = st.text("ABC", min_size=0, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(words, min_size=1, max_size=8), st.lists(words, min_size=1, max_size=8))
def test_matching_strategies_agree(spark, patterns, texts):
    p = spark.createDataFrame([(x,) for x in patterns], "peptide string")
    t = spark.createDataFrame(list(enumerate(texts)), "protein_id bigint, sequence string")
    want = {(x, i) for x in patterns if x for i, y in enumerate(texts) if x in y}
    for strategy in ("contains", "seed"):
        assert {tuple(r) for r in matching.matches(p, t, strategy).collect()} == want


def test_seeds_of_long_patterns_and_hot_ones(spark, monkeypatch):
    """Patterns longer than what travels with a seed, at a text's ends and over borders of pieces; one seed that is in all texts and patterns."""
    monkeypatch.setattr(matching, "CELL", 50)
    rng = random.Random(7)
    texts = ["".join(rng.choice("ABCD") for _ in range(n)) for n in (5, 6, 70, 255, 256, 257, 600, 1500)] + ["QQQQQQQ" * k for k in (1, 40, 90)]
    patterns = {t[a : a + n] for t in texts for n in (1, 3, 6, 7, 60, 70, 71, 135, 300, 1500) for a in {0, 1, 190, 250, len(t) // 2, max(0, len(t) - n)}} - {""}
    patterns |= {p[:-1] + "Z" for p in patterns} | {"Z" + p for p in patterns}
    p = spark.createDataFrame([(x,) for x in sorted(patterns)], "peptide string")
    t = spark.createDataFrame([*enumerate(texts), (99, None), (98, "")], "protein_id bigint, sequence string")
    want = {(x, i) for x in patterns for i, y in enumerate(texts) if x in y}
    assert {tuple(r) for r in matching.matches(p, t, "seed").collect()} == want
    monkeypatch.setattr(matching, "BROADCAST_SEEDS", 0)
    for shortest in (7, 9, 70):  # other strides
        some = {x for x in patterns if len(x) >= shortest}
        got = matching.matches(p.where(F.length("peptide") >= shortest), t, "seed").collect()
        assert {tuple(r) for r in got} == {(x, i) for x, i in want if x in some}


def test_peptide_lists(spark, tmp_path):
    def read(text):
        (tmp_path / "p.txt").write_text(text)
        return {r.peptide: r.quantity for r in peptides.read_peptides(spark, f"{tmp_path}/p.txt").collect()}

    assert read("WANDER\t3\nWAN[+16]DER\t4\n\nlost\tinf\n") == {"WANDER": 7.0, "LOST": float("inf")}
    assert read("seq,q\nWAN[Acetyl]DER,2_0\n\"LO,ST\",1\n") == {"WANACETYLDER": 20.0, "LOST": 1.0}
    for text, message in (("seq\tq\nA\t1\nA\t2\n", "line 3: duplicate of line 2"), ("A\t1\n12\t1\n", "line 2"), ("A\t-1\n", "line 1"), ("A\tnan\n", "line 1"), ("A\n", "line 1")):
        with pytest.raises(ValueError, match=message):
            read(text)


def test_fasta_files(spark, tmp_path):
    """A file that begins without a header is an error wherever it lies among others; the last record of an id counts, by file and place."""
    def read(**texts):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for name, text in texts.items():
            (folder / f"{name}.fasta").write_text(text)
        return proteins.last_records(proteins.read_fasta(spark, str(folder)))

    got = read(a="\n\r\n>P1 x y\r\nM K\r\n W\n>P2\n\nAA\n", b=">P1\nLAST\n>P3 no sequence\n", c="", d="\n")
    assert {tuple(r) for r in got.collect()} == {("P1", "LAST"), ("P2", "AA"), ("P3", "")}
    for texts in ({"a": ">P1\nM\n", "b": "JUNK\n>X\nM\n"}, {"a": "JUNK\n", "b": ">P1\nM\n"}, {"a": " \n>P1\nM\n"}):
        with pytest.raises(ValueError, match="before the first header"):
            read(**texts)
    with pytest.raises(Exception, match="empty header"):
        read(a=">P1\nM\n>\nM\n").collect()
    with pytest.raises(Exception, match="empty header"):
        read(a="\n>P1\nM\n>\n>P2\nM\n").collect()
    for text, message in (("", "empty"), ("MK\n", "no header"), (">a\n", "without sequence"), ("\n>a\n>b\nM\n", "without sequence")):
        (tmp_path / "c.fasta").write_text(text)
        with pytest.raises(ValueError, match=message):
            proteins.check_fasta(spark, f"{tmp_path}/c.fasta")
    (tmp_path / "c.fasta").write_text("\n>a\nM\n")
    proteins.check_fasta(spark, f"{tmp_path}/c.fasta")


def test_line_numbers_over_splits(spark, tmp_path):
    """Splits of 64 bytes, several of them in a task, over two files."""
    texts = {"a.txt": [f"line {i} " + "x" * (i % 40) for i in range(300)], "b.txt": ["[s]" if i % 7 == 0 else "" for i in range(200)]}
    for name, lines_ in texts.items():
        (tmp_path / name).write_text("\n".join(lines_) + "\n")
    want = [*texts["a.txt"], *texts["b.txt"]]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = lines.numbered_lines(spark, str(tmp_path)).collect()
        counted = lines.running(lines.ordered_lines(spark, str(tmp_path)), F.col("value").startswith("[")).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.number, r.value) for r in got) == list(enumerate(want, 1))
    assert [r.running for r in counted] == [sum(w.startswith("[") for w in want[: k + 1]) for k in range(500)]


def test_parameters():
    assert params.plain_name("db.dmnd") == "db.dmnd" and params.email(" a@b.org ") == "a@b.org" and params.email(" ") == params.plain_name("") == ""
    for check, bad in ((params.plain_name, "../x"), (params.plain_name, "a\\b"), (params.email, "a@b"), (params.email, "a b@c.d")):
        with pytest.raises(ValueError):
            check(bad)
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            FilterPolicy(max_evalue=bad)


def test_taxonomy_normal_form(spark, tmp_path):
    """One line for each node or any other layout of the same object."""
    taxa = spark.createDataFrame([(7, 'a "b", {c}', "r", 2), (2, "n", "no rank", None), (-1, "é", "r", 2)], "tax_id bigint, name string, rank string, parent_tax_id bigint")
    references.write_taxonomy_json(taxa, f"{tmp_path}/t.json")
    told = json.loads((tmp_path / "t.json").read_text())
    assert told["nodes"]["2"] == {"name": "n", "rank": "no rank", "parent_tax_id": None} and len(told["nodes"]) == 3
    (tmp_path / "u.json").write_text(json.dumps(told, indent=3))
    for name in ("t.json", "u.json"):
        assert {tuple(r) for r in references.read_taxonomy(spark, f"{tmp_path}/{name}").collect()} == {tuple(r) for r in taxa.collect()}


def test_formats(spark, tmp_path):
    (tmp_path / "f.fasta").write_text(">sp|O43210|ABC_X Some OX=4242 GN=a\nMA\n>sp|P00001|NONE no taxon\nMK\n")
    taxa = proteins.read_fasta_taxa(spark, f"{tmp_path}/f.fasta")
    assert [(r.accession, r.tax_id) for r in taxa.collect()] == [("O43210", 4242)]
    cells = lambda q, e: "\t".join(["U", "O43210", "s", q, go(1), "r", e, "w", "F"])
    (tmp_path / "g.gaf").write_text("!c\n" + "\n".join([cells("enables", "IEA"), cells("NOT|enables", "IEA"), cells("enables", "ND"), "short\tline"]) + "\n")
    gaf = proteins.read_gaf(spark, f"{tmp_path}/g.gaf")
    assert gaf.count() == 1 and proteins.read_gaf(spark, f"{tmp_path}/g.gaf", exclude_not=False, exclude_nd=False).count() == 3
    taxonomy, annotations = proteins.annotation_tables(taxa, gaf)
    assert taxonomy.count() == 1 and [tuple(r) for r in annotations.collect()] == [("O43210", go(1), "F")]
    (tmp_path / "o.obo").write_text("format-version: 1\n\n[Term]\nid: GO:1\nname: root\nnamespace: bp\n\n[Term]\nid: GO:2\nname: child ! odd\nnamespace: bp\nis_a: GO:1 ! root\nrelationship: part_of GO:3 ! x\n[Term]\nid: GO:4\nname: old\nis_obsolete: True\n[Term]\nid: GO:2\nname: child again\nnamespace: bp\nis_a: GO:4\n[Typedef]\nid: part_of\n")
    terms, edges = references.read_go(spark, f"{tmp_path}/o.obo")
    assert {(r.go_id, r.name, r.is_obsolete) for r in terms.collect()} == {("GO:1", "root", False), ("GO:2", "child again", False), ("GO:4", "old", True)}
    assert {tuple(r) for r in edges.collect()} == {("GO:2", "is_a", "GO:4")}
    (tmp_path / "nodes.dmp").write_text("3\t|\t3\t|\tno rank\t|\n7\t|\t3\t|\trealm\t|\n21\t|\t7\t|\tclan\t|\n")
    (tmp_path / "names.dmp").write_text("3\t|\tall\t|\t\t|\tscientific name\t|\n7\t|\tMosses\t|\t\t|\tscientific name\t|\n7\t|\tx\t|\t\t|\tsynonym\t|\n")
    assert {tuple(r) for r in references.read_taxonomy(spark, str(tmp_path)).collect()} == {(3, "all", "no rank", None), (7, "Mosses", "realm", 3), (21, "taxid_21", "clan", 7)}
    (tmp_path / "b.tsv").write_text("# c\n\nprot4\tsubj9\t81.25\t64\t12\t0\t3\t66\t5\t68\t2e-17\t143\n")
    assert references.read_hits(spark, f"{tmp_path}/b.tsv").drop("line").first() == ("prot4", "subj9", 2e-17, 143.0, 81.25, 0.0, 64)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("sp|Q7Z3K5-3|X",), ("C4K2D7",), ("zz|Q1|n",), ("plain",)], "s string")
    got = df.select(fn.accession(F.col("s")), fn.uniprot_accession(F.col("s")), fn.uniprot_url(F.col("s"))).collect()
    assert [r[0] for r in got] == ["Q7Z3K5-3", "C4K2D7", "Q1", "plain"] and [r[1] for r in got] == ["Q7Z3K5-3", "C4K2D7", None, None]
    out = spark.range(1).select(fn.wrapped(F.lit("A" * 5), 2), fn.short_label(F.lit("x" * 41)), fn.term_label(F.lit("n"), F.lit(True))).first()
    assert tuple(out) == ("AA\nAA\nA", "x" * 37 + "...", "OBSOLETE: n")


def test_hierarchy(spark):
    rows = [(1, "r", "no rank", None, 1.0), (2, "b", "domain", 1, 1.0), (3, "c", "clade", 2, 0.5), (4, "g", "genus", 3, 0.5), (5, "s", "species", 77, 0.1)]
    nodes = spark.createDataFrame(rows, "tax_id bigint, name string, rank string, parent_tax_id bigint, ratio_total double")
    linked = hierarchy.canonical(nodes)
    assert {(r.tax_id, r["rank"], r.parent_tax_id) for r in linked.collect()} == {(1, "root", None), (2, "domain", 1), (4, "genus", 2), (5, "species", None)}
    layered = {r.tax_id: r.parent_tax_id for r in hierarchy.strict_layers(linked.where("tax_id < 5")).collect()}
    assert layered["4"] == "__placeholder_family_4" and layered["__placeholder_kingdom_4"] == "2" and len(layered) == 3 + 5
    assert {tuple(r) for r in hierarchy.hierarchy_errors(linked).collect()} == {(5, "no parent")}


def test_drill_down_of_nothing_is_empty(spark):
    m = spark.createDataFrame([("P", [1, 2], ["g"])], "peptide string, peptide_lca_tax_ids array<bigint>, peptide_go_terms array<string>")
    assert hierarchy.drill_down(m).count() == 0 and hierarchy.drill_down(m, [2, 9], "g").count() == 1 and hierarchy.drill_down(m, [9]).count() == 0


def test_drill_down_by_a_table_of_ids(spark):
    m = spark.createDataFrame([("P", [1, 2], ["g"]), ("P", [1, 2], ["g"]), ("Q", [1], ["g"]), ("R", [5], ["h"])], "peptide string, peptide_lca_tax_ids array<bigint>, peptide_go_terms array<string>")
    ids = spark.range(2, 5000).withColumnRenamed("id", "tax_id")
    assert sorted(r.peptide for r in hierarchy.drill_down(m, ids).collect()) == ["P", "P", "R"]
    assert hierarchy.drill_down(m, ids, "h").count() == 1 and hierarchy.drill_down(m, ids.limit(0)).count() == 0


def test_postings(spark, tmp_path):
    """A click on each node gives what the whole mapping gives, from a few row groups."""
    up = {1: None, 2: 1, 3: 1, 4: 2, 5: 4}
    taxa = spark.createDataFrame([(i, "n", "r", p) for i, p in up.items()], "tax_id bigint, name string, rank string, parent_tax_id bigint")
    tree = graphs.tree(taxa, taxa)
    lcas = {f"P{k:04d}": [1, 2, 3, 4, 5, None][k % 6] for k in range(600)}
    way = lambda i: [] if i is None else way(up[i]) + [i]
    rows = spark.createDataFrame([*lcas.items()], "peptide string, lca_tax_id bigint")
    mapping = spark.createDataFrame([(p, way(i), [f"g{k}"] if k else []) for p, i in lcas.items() for k in range(3)], "peptide string, peptide_lca_tax_ids array<bigint>, peptide_go_terms array<string>")
    hierarchy.write_postings(mapping, rows, tree, f"{tmp_path}/x")
    for node in (1, 2, 3, 4, 5, 9):
        below = [i for i in up if node in way(i)]
        got = sorted(map(str, hierarchy.drill_into(spark, f"{tmp_path}/x", node).collect()))
        assert got == sorted(map(str, hierarchy.drill_down(mapping, below or [9]).collect())) and len(got) == 300 * len(below)
    assert hierarchy.drill_into(spark, f"{tmp_path}/x", 4, "g1").count() == 200 and hierarchy.drill_into(spark, f"{tmp_path}/x").count() == 0
    assert hierarchy.drill_into(spark, f"{tmp_path}/x", go_id="g2").count() == 600
    plan = hierarchy.drill_into(spark, f"{tmp_path}/x", 3)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(number" in plan and "LessThanOrEqual(number" in plan


def test_inbox(spark, tmp_path):
    from taxaflow.streaming.inbox import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("seq\tq\nAB\t1\na-b\t2\n")
    (tmp_path / "in" / "b.csv").write_text("CD,1\nEF,-1\n")
    seen, gone = [], []
    watch(spark, f"{tmp_path}/in", f"{tmp_path}/ck", lambda df, n: seen.extend(map(tuple, df.collect())), lambda df, n: gone.extend(map(tuple, df.collect())), once=True).awaitTermination(60)
    assert seen == [("a.tsv", "AB", 3.0)] and gone == [("b.csv", "line 2: not a quantity")]


def test_inbox_that_annotates(spark, scenario, tmp_path):
    """Two rounds of new files; a batch that comes again gives the same rows."""
    from taxaflow.streaming import inbox

    run, _, edges, taxa = scenario
    background = spark.createDataFrame([("P10", "MKWANDERSK"), ("P11", "GGWANDERQQ"), ("P12", "LLSTREAMLL")], "protein_id string, sequence string")
    handle = inbox.reporting(f"{tmp_path}/out", background, subject_tax=run.subject_tax, subject_go=run.subject_go, taxa=taxa, edges=edges, given=run.given)
    (tmp_path / "in").mkdir()
    for name, text in (("a.tsv", "WANDER\t12\nSTREAM\t4\nLOST\t8\n"), ("b.tsv", "WANDER\t1\n"), ("c.tsv", "WANDER\n")):
        (tmp_path / "in" / name).write_text(text)
        inbox.watch(spark, f"{tmp_path}/in", f"{tmp_path}/ck", handle, inbox.rejected_into(f"{tmp_path}/out"), once=True).awaitTermination(120)
    handle(spark.createDataFrame([("b.tsv", "WANDER", 1.0)], "list_id string, peptide string, quantity double"), 1)
    nodes = spark.read.parquet(f"{tmp_path}/out/taxonomy_nodes").collect()
    assert {(r.batch, r.list_id, r.tax_id, r.quantity, r.ratio_total) for r in nodes} == {(0, "a.tsv", 2, 12, 0.5), (0, "a.tsv", 5, 12, 0.5), (1, "b.tsv", 2, 1, 1), (1, "b.tsv", 5, 1, 1)} and len(nodes) == 4
    assert spark.read.parquet(f"{tmp_path}/out/mapping").count() == 6
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/out/rejected").select("list_id", "problem").collect()] == [("c.tsv", "line 1: two columns are needed")]


def test_sets_are_closed_where_they_are(spark, monkeypatch):
    """Sets of texts, with terms that no edge has, cycles, and none; sums of them, over several tasks and parts."""
    up = {"b": ["a"], "c": ["a", "b"], "d": ["c"], "x": ["y"], "y": ["x"]}
    edges = tables.written(spark.createDataFrame([(c, p) for c, ps in up.items() for p in ps], "child string, parent string"))
    own = [(k, [["d"], ["x"], ["A", "c", "zz"], None, ["b", "d"]][k % 5]) for k in range(100)]
    closed = {0: "abcd", 1: "xy", 2: ["A", "a", "b", "c", "zz"], 3: "", 4: "abcd"}
    for name, value in (("ROWS", 7), ("TERMS_AT_ONCE", 3), ("HELD", 2)):
        monkeypatch.setattr(closing, name, value)
    sets = tables.written(spark.createDataFrame(own, "k bigint, terms array<string>"))
    got = closing.closed_sets(sets, edges, "k").collect()
    assert len(got) == 100 and all(r.terms == list(closed[r.k % 5]) for r in got)
    sums = tables.written(sets.where("terms is not null").selectExpr("k % 2 as odd", "terms", "cast(k as double) as quantity", "1L as n_peptides"))
    want = {}
    for k, _ in own:
        for t in closed[k % 5]:
            q, n = want.get((k % 2, t), (0, 0))
            want[k % 2, t] = (q + k, n + 1)
    got = closing.closed_sums(sums, edges, "go_id", ["odd"], F.xxhash64("odd")).collect()
    assert {(r.odd, r.go_id): (r.quantity, r.n_peptides) for r in got} == want and len(got) == len(want)


def test_reports_make_only_what_they_read(spark, scenario):
    """Organisms need no terms, and pairs need no arrays; terms without themselves are those of a walk from each."""
    one, _, edges, taxa = scenario
    given = {"subject_tax": one.subject_tax, "subject_go": one.subject_go, "taxa": taxa, "edges": edges, "given": one.given}
    run = Annotated(one.peptides, one.all_matches, **given)
    run.taxonomy_nodes().collect()
    assert {(r.peptide, r.background_protein, r.annotated_protein) for r in run.pairs().collect()} == {("WANDER", "P10", "S7"), ("WANDER", "P11", "S8"), ("WANDER", "P11", "S9")}
    assert "own" not in run.__dict__ and "links" not in run.__dict__
    ids = spark.createDataFrame([(12,)], "tax_id bigint")
    assert run.drilled(ids).count() == 0 and run.drilled(go_id=go(102)).count() == 3 and run.drilled(go_id=go(99)).count() == 0
    above = Annotated(one.peptides, one.all_matches, **given, go=GoOptions(include_self=False)).terms_of
    assert {r.go_id for r in above.collect()} == {go(101), go(102), go(103)}


def test_only_stretches_that_may_be_seeds_become_rows(spark, monkeypatch):
    """Texts of two letters have every short stretch everywhere; those as long as a pattern are few. Over borders of pieces and of bytes."""
    monkeypatch.setattr(matching, "PIECE", 100)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ABABABAB\u00c9\u6f22") for _ in range(n)) for n in (11, 12, 99, 100, 101, 450, 900)]
    patterns = {t[a : a + n] for t in texts for n in (12, 24, 36) for a in (0, 80, 90, 190, 400) if a + n <= len(t)}
    p = spark.createDataFrame([(x,) for x in patterns | {x[:-1] + "Q" for x in patterns}], "peptide string")
    t = spark.createDataFrame([*enumerate(texts)], "protein_id bigint, sequence string")
    want = {(x, i) for x in patterns for i, y in enumerate(texts) if x in y}
    assert {tuple(r) for r in matching.matches(p, t, "seed").collect()} == want
    sizes = sorted({len(x.encode()) for x in patterns})
    those = matching.seed_filter(p.select(F.col("peptide").cast("binary").alias("seed")))
    rows = matching.text_stretches(t, sizes, those).select("seed", F.explode("ids")).distinct()
    assert len(want) <= rows.count() <= len(want) + 200  # of some 38,000


def test_a_sharp_s_is_one_letter(spark):
    """As in the queries' SQL, whose upper case of it is no SS."""
    patterns = spark.createDataFrame([("Maße",), ("masse",)], "text string").select(fn.upper_letters(F.col("text")).alias("peptide"))
    texts = spark.createDataFrame([(1, "MASSE"), (2, "die maße"), (3, "MA\u1e9eE")], "protein_id int, sequence string")
    want = {("MA\u1e9eE", 2), ("MA\u1e9eE", 3), ("MASSE", 1)}
    assert {tuple(r) for r in matching.matches(patterns, texts, "contains").collect()} == want
    assert {tuple(r) for r in matching.matches(patterns, texts, "seed").collect()} == want


def test_line_items_stay_where_they_are(spark):
    """Suppliers' places have a known size, so a threshold that they are under broadcasts them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = Views(spark, "/root/testdata/sf0.001", branch=True).lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning(l_suppkey" not in plan


def test_closing_as_bits(spark, monkeypatch):
    """Random graphs, some with cycles, large and small groups, against a walk; edges are dealt to few tasks however many sets there are."""
    rng = random.Random(5)
    monkeypatch.setattr(closing, "ROWS", 1)
    monkeypatch.setattr(closing, "WORDS_BYTES", 4000)
    for cycles in (0, 10):
        links = {(c, rng.randrange(c)) for c in range(1, 300) for _ in range(2)} | {(rng.randrange(300), rng.randrange(300)) for _ in range(cycles)}
        above = {}
        for c, p in links:
            above.setdefault(c, set()).add(p)

        def closed(own):
            out, new = set(own), list(own)
            while new:
                more = above.get(new.pop(), set()) - out
                out |= more
                new += more
            return out

        sets = [[rng.randrange(320) for _ in range(rng.randint(1, 4))] for _ in range(300)]
        graph = closing.Graph(*(np.array(x) for x in zip(*links)))
        row, own = np.repeat(np.arange(300), [len(s) for s in sets]), graph.numbers(np.array([t for s in sets for t in s]))
        got = [list(graph.values[nodes][places]) for nodes, first, words in graph.closed(row, own, 300) for places in closing._members(words, 300 - 64 * first)]
        assert got == [sorted(closed(s)) for s in sets]
        edges = spark.createDataFrame(list(links), "child bigint, parent bigint")
        sums = tables.written(spark.createDataFrame([(k if k < 40 else k % 2, s, float(k), 2) for k, s in enumerate(sets)], "g bigint, terms array<bigint>, quantity double, n_peptides bigint"))
        want = {}
        for k, s in enumerate(sets):
            for t in closed(s):
                q, n = want.get((k if k < 40 else k % 2, t), (0, 0))
                want[k if k < 40 else k % 2, t] = (q + k, n + 2)
        for share in (F.xxhash64("g"), F.lit(1)):  # small groups, and with the large ones together
            rows = closing.closed_sums(sums, edges, "go_id", ["g"], share).collect()
            assert {(r.g, r.go_id): (r.quantity, r.n_peptides) for r in rows} == want and len(rows) == len(want)
        dealt = closing._dealt(sums, edges, F.xxhash64("g"), "g")
        assert dealt.rdd.getNumPartitions() <= max(8, 2 * spark.sparkContext.defaultParallelism)


def test_sums_of_short_lists(spark, monkeypatch):
    """Sets with few terms in a large graph take pairs, not bits: against a walk, with cycles, terms without edges, wide and narrow groups."""
    rng = random.Random(6)
    up = {n: {n // 2, n // 3} - {n} for n in range(1, 3000)} | {5001: {5002}, 5002: {5001, 7}}

    def closed(own):
        out, new = set(own), list(own)
        while new:
            more = up.get(new.pop(), set()) - out
            out |= more
            new += more
        return out

    sets = [[rng.choice([rng.randrange(3000), rng.randrange(3000), 5001, 6000 + rng.randrange(3)]) for _ in range(rng.randint(1, 3))] for _ in range(600)]
    of = lambda k: k // 2 if k < 200 else 200 + k % 3
    edges = tables.written(spark.createDataFrame([(c, p) for c, ps in up.items() for p in ps], "child bigint, parent bigint"))
    sums = tables.written(spark.createDataFrame([(of(k), s, float(k), 2) for k, s in enumerate(sets)], "g bigint, terms array<bigint>, quantity double, n_peptides bigint"))
    want = {}
    for k, s in enumerate(sets):
        for t in closed(s):
            q, n = want.get((of(k), t), (0, 0))
            want[of(k), t] = (q + k, n + 2)
    graph = closing.Graph(*(np.array(x) for x in zip(*((c, p) for c, ps in up.items() for p in ps))))
    own = graph.numbers(np.array([2999, 2998, 6000, 5001]))
    begin, length, lists = graph.listed(own)
    assert [set(graph.values[lists[b : b + n]]) for b, n in zip(begin, length)] == [closed([t]) for t in (2999, 2998, 6000, 5001)]
    row, own = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), graph.numbers(np.array([t for x in sets for t in x]))
    group, weights = np.array([of(k) for k in range(len(sets))]), np.array([np.arange(len(sets)), np.full(len(sets), 2)], dtype=float)
    order = np.argsort(group, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    by_row = np.argsort(place[row], kind="stable")
    for limits in ({}, {"LISTED": 50, "PAIRS": 30, "LISTED_AT_ONCE": 7}, {"LONG": 3}, {"LONG_WAY": 2}, {"SPARSE": 1 << 40}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(closing, name, value)
            graph.long = False
            found = closing._summed_by_list(graph, place[row][by_row], own[by_row], group[order], weights[:, order])
        assert (found is None) == bool({"LONG", "LONG_WAY", "SPARSE"} & set(limits))
        got = {}
        for keys, quantity, n in found or ():
            for k, q, c in zip(keys.tolist(), quantity, n):
                at = k >> closing.BITS, graph.values[k & ((1 << closing.BITS) - 1)]
                got[at] = tuple(np.add(got.get(at, (0, 0)), (q, c)))
        assert got == (want if found else {})
        graph.list_begin[:] = -1  # made anew
    # In tasks, and so that sums leave them in parts; with wide groups and without.
    for limits in ({}, {"HELD": 500}, {"WIDE": 1 << 40}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(closing, name, value)
            rows = closing.closed_sums(sums, edges, "go_id", ["g"], F.lit(1)).collect()
        assert {(r.g, r.go_id): (r.quantity, r.n_peptides) for r in rows} == want and len(rows) == len(want)


def test_arrays_are_shown_once_for_each_peptide(spark, scenario):
    one, _, _, _ = scenario
    shown = one.mapping(lambda array: F.array_join(F.transform(array, lambda x: x.cast("string")), ";"))
    assert {(r.peptide, r.peptide_lca_tax_ids) for r in shown.collect()} == {("WANDER", "2;5")}
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline(") < plan.index("array_join(")


def test_closed_terms_meet_nothing(spark, scenario):
    """Also where no table is broadcast: what is shuffled has a peptide's own terms only."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mapped = scenario[0].mapping()
        plan = mapped._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan[: plan.index("MapInArrow")] and {tuple(r.peptide_lca_tax_ids) for r in mapped.collect()} == {(2, 5)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_slice_closes_no_more_than_it_shows(spark, scenario, monkeypatch):
    """Those of one function close nothing, and those of one organism only the sets below it."""
    one, _, edges, taxa = scenario
    lists = one.peptides.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("list_id"), "peptide", "quantity")
    given = {"subject_tax": one.subject_tax, "subject_go": one.subject_go, "taxa": taxa, "edges": edges, "given": one.given}
    run = Annotated(lists, one.all_matches, by=("list_id",), **given)
    whole = run.combos().collect()
    closed, plain = [], closing.closed_sums
    monkeypatch.setattr(aggregate, "closed_sums", lambda sums, *a: closed.append(sums) or plain(sums, *a))
    for term, n in ((go(102), 4), (go(99), 0)):
        got = run.combo_slice(go_id=term).collect()
        assert sorted(got) == sorted(r for r in whole if r.go_id == term) and len(got) == n
    assert not closed
    for node, n in ((2, 10), (5, 10), (41, 0)):
        got = run.combo_slice(tax_id=node).collect()
        assert sorted(got) == sorted(r for r in whole if r.tax_id == node) and len(got) == n
        assert {r.tax_id for r in closed[-1].collect()} == ({node} if n else set())


def test_details_are_distinct_and_ordered(spark, tmp_path):
    rows = [(f"P{k % 7}", f"B{k % 5}", f"S{k % 3}", k % 2 / 4, None) for k in range(420)] * 2
    reports.write_details(spark.createDataFrame(rows, "peptide string, background_protein string, annotated_protein string, evalue double, pident double").repartition(5), f"{tmp_path}/d.csv")
    got = Path(f"{tmp_path}/d.csv").read_text().splitlines()[1:]
    assert len(got) == 210 == len(set(got)) and [g.rsplit(",", 2)[0] for g in got] == sorted(g.rsplit(",", 2)[0] for g in got)


def test_pairs_and_clicks_make_neither_rows_nor_own_terms(spark, scenario):
    """Matches of a peptide that no list has, and of none, give no pairs; a peptide of two lists has its pairs in both."""
    one, _, edges, taxa = scenario
    given = {"subject_tax": one.subject_tax, "subject_go": one.subject_go, "taxa": taxa, "edges": edges, "given": one.given}
    more = one.all_matches.unionByName(spark.createDataFrame([("OTHER", "P10"), (None, "P10")], "peptide string, protein_id string"))
    run = Annotated(one.peptides, more, **given)
    want = {("WANDER", "P10", "S7"), ("WANDER", "P11", "S8"), ("WANDER", "P11", "S9")}
    shown = ["peptide", "background_protein", "annotated_protein"]
    for values in (True, False):
        assert sorted(tuple(r) for r in run.found_pairs(values).select(*shown).collect()) == sorted(want)
    assert not {"rows", "own", "links", "tree"} & set(run.__dict__)
    assert sorted(tuple(r) for r in run.drilled(go_id=go(103)).select(*shown).collect()) == sorted(want)
    assert not {"rows", "own", "tree"} & set(run.__dict__)
    ids = lambda *n: spark.createDataFrame([(k,) for k in n], "tax_id bigint")
    for tax_ids, term, n in ((ids(5, 12), None, 3), (ids(12), None, 0), (ids(2), go(102), 3), (ids(2), go(99), 0), (ids(12), go(102), 0), (None, None, 3)):
        assert run.drilled(tax_ids, term).count() == n
    assert not {"rows", "own"} & set(run.__dict__)
    lists = one.peptides.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("list_id"), "peptide", "quantity")
    both = Annotated(lists, more, by=("list_id",), **given)
    assert sorted(tuple(r) for r in both.drilled(ids(5)).select("list_id", *shown).collect()) == sorted((k, *w) for k in "ab" for w in want)
    # Only known to be of the lists' peptides: nothing is joined with them.
    known = Annotated(one.peptides, one.all_matches, only_asked=True, **given)
    assert sorted(tuple(r) for r in known.found_pairs().select(*shown).collect()) == sorted(want)


def test_a_function_is_found_in_postings_by_subjects(spark, scenario, tmp_path):
    one = scenario[0]
    hierarchy.write_postings(one.found_pairs(), one.rows, one.tree, f"{tmp_path}/x", one.known_terms, one.links)
    for tax_id, term, n in ((None, go(102), 3), (None, go(111), 3), (None, go(99), 0), (5, go(110), 3), (12, go(110), 0)):
        assert hierarchy.drill_into(spark, f"{tmp_path}/x", tax_id, term).count() == n


def test_counting_pairs_writes_no_table(spark):
    from taxaflow.plans.queries import QUERIES

    folder = Path(tables.shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("table-*")}
    assert QUERIES["hierarchy_counts"](spark, "/root/testdata/sf0.001").count() > 0
    assert {p.name for p in folder.glob("table-*")} == before
