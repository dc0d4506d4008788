"""The driver's tables seen as peptides, proteins, hits, organisms and functions; in DataFrames and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import FilterPolicy, GoOptions
from .pipeline import Annotated
from .tables import written

POLICY = FilterPolicy(max_evalue=0.08, top_k=1)
#: Line items with their order and part told apart by a branch of the tree: those of one branch have suppliers of one species
#: (line 7), of one nation, of one region, or any. Peptides then have organisms that meet at every level, over all hits.
BRANCH = 100_000


class Views:
    """branch: proteins and peptides are orders and parts within a branch of the tree (see BRANCH), else orders and parts."""

    def __init__(self, spark: SparkSession, sf_dir: str, branch: bool = False):
        self.spark, self.sf_dir, self.branch = spark, sf_dir, branch

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def lines(self) -> DataFrame:
        if not self.branch:
            return self.lineitem
        nations = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        # Written, so that its size is known, not guessed from a product: a small one is broadcast, and line items stay where they are.
        places = written(self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(F.broadcast(nations), "s_nationkey"))
        n = F.col("l_linenumber")
        branch = F.when(n == 7, 100 + F.col("l_suppkey")).when(n % 3 == 0, 31).when(n % 3 == 1, 25 + F.col("n_regionkey")).otherwise(F.col("s_nationkey"))
        rows = self.lineitem.join(places, "l_suppkey")
        return rows.withColumns({c: F.col(c) * BRANCH + branch for c in ("l_orderkey", "l_partkey")})

    @property
    def peptide_rows(self) -> DataFrame:
        return self.lines.select(F.col("l_returnflag").alias("list_id"), F.col("l_partkey").alias("peptide"), F.col("l_quantity").alias("quantity"))

    @property
    def peptides(self) -> DataFrame:
        return self.peptide_rows.groupBy("peptide").agg(F.sum("quantity").alias("quantity"))

    @property
    def matches(self) -> DataFrame:
        return self.lines.select(F.col("l_partkey").alias("peptide"), F.col("l_orderkey").alias("protein_id")).repartition("protein_id").distinct()  # as it is joined

    @property
    def hits(self) -> DataFrame:
        return self.lines.select(
            F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("subject_id"), F.col("l_discount").alias("evalue"), F.col("l_quantity").alias("bitscore"),
            (100 * (1 - F.col("l_tax"))).alias("pident"), F.lit(0.0).alias("qcov"), F.col("l_quantity").cast("int").alias("alnlen"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("line"),
        )

    @property
    def subject_tax(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("subject_id"), (F.col("s_suppkey") + 1000).alias("tax_id"))

    @property
    def taxa(self) -> DataFrame:
        def level(df: DataFrame, id_, name, rank: str, parent) -> DataFrame:
            return df.select(id_.cast("bigint").alias("tax_id"), name.alias("name"), F.lit(rank).alias("rank"), parent.cast("bigint").alias("parent_tax_id"))

        root = level(self.spark.range(1), F.lit(1), F.lit("root"), "no rank", F.lit(None))
        regions = level(self.table("region"), F.col("r_regionkey") + 10, F.col("r_name"), "kingdom", F.lit(1))
        nations = level(self.table("nation"), F.col("n_nationkey") + 100, F.col("n_name"), "phylum", F.col("n_regionkey") + 10)
        species = level(self.table("supplier"), F.col("s_suppkey") + 1000, F.col("s_name"), "species", F.col("s_nationkey") + 100)
        return root.unionByName(regions).unionByName(nations).unionByName(species)

    @property
    def terms(self) -> DataFrame:
        """Parts as terms: a part's parents are those of half and of a third its number."""
        kinds = F.element_at(F.array(*map(F.lit, ("biological_process", "molecular_function", "cellular_component"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("namespace")
        return self.table("part").select(F.col("p_partkey").alias("go_id"), F.col("p_name").alias("name"), kinds, (F.col("p_partkey") % 10 == 9).alias("is_obsolete"))

    @property
    def edges(self) -> DataFrame:
        ids = self.table("part").where("p_partkey >= 1").select(F.col("p_partkey").alias("child"))
        is_a = ids.select("child", F.lit("is_a").alias("edge_type"), F.floor(F.col("child") / 2).alias("parent"))
        return is_a.unionByName(ids.where("child >= 3").select("child", F.lit("part_of").alias("edge_type"), F.floor(F.col("child") / 3).alias("parent")))

    @property
    def subject_go(self) -> DataFrame:
        return self.lineitem.where("l_linenumber = 7 and l_quantity >= 49").select(F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("go_id")).distinct()

    @cached_property
    def annotated(self) -> Annotated:
        return Annotated(self.peptides, self.matches, self.subject_tax, self.subject_go, self.taxa, self.edges, self.hits, POLICY, go=GoOptions(), only_asked=True)

    @cached_property
    def annotated_lists(self) -> Annotated:
        """All lists (return flags) as one job."""
        peptides = self.peptide_rows.repartition("peptide").groupBy("list_id", "peptide").agg(F.sum("quantity").alias("quantity"))
        return Annotated(peptides, self.matches, self.subject_tax, self.subject_go, self.taxa, self.edges, self.hits, POLICY, go=GoOptions(), by=("list_id",), only_asked=True)


#: The same views for the oracle, each with the views it needs.
SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "peptide": ("select l_partkey as peptide, sum(l_quantity) as quantity from {lines} group by l_partkey", ()),
    "list_peptide": ("select l_returnflag as list_id, l_partkey as peptide, sum(l_quantity) as quantity from {lines} group by l_returnflag, l_partkey", ()),
    "list_flags": ("select p.*, p.peptide in (select peptide from implied) as is_annotated from list_peptide p", ("list_peptide", "implied")),
    "list_cover": (
        "select list_id, sum(quantity) as total_quantity, sum(case when is_annotated then quantity else 0 end) as annotated_quantity, count(*) as n_peptides, count(*) filter (where is_annotated) as n_annotated from list_flags group by list_id",
        ("list_flags",),
    ),
    "match_": ("select distinct l_partkey as peptide, l_orderkey as protein_id from {lines}", ()),
    "hits": (
        "select l_orderkey as query_id, l_suppkey as subject_id, l_discount as evalue, l_quantity as bitscore, 100 * (1 - l_tax) as pident, l_linenumber, l_partkey, l_suppkey, l_extendedprice from {lines}",
        (),
    ),
    "top_": ("select * from (select *, rank() over (partition by query_id order by bitscore desc) as r from hits where evalue <= 0.08) t where r <= 1", ("hits",)),
    "accepted": ("select distinct query_id, subject_id from top_", ("top_",)),
    "subject_tax": ("select s_suppkey as subject_id, s_suppkey + 1000 as tax_id from supplier", ()),
    "taxon": (
        "select cast(1 as bigint) as tax_id, 'root' as name, 'no rank' as rank, cast(null as bigint) as parent_tax_id"
        " union all select cast(r_regionkey + 10 as bigint), r_name, 'kingdom', cast(1 as bigint) from region"
        " union all select cast(n_nationkey + 100 as bigint), n_name, 'phylum', cast(n_regionkey + 10 as bigint) from nation"
        " union all select cast(s_suppkey + 1000 as bigint), s_name, 'species', cast(s_nationkey + 100 as bigint) from supplier",
        (),
    ),
    "lineage": (
        "select tax_id, tax_id as ancestor_id, 0 as dist from taxon union all select l.tax_id, t.parent_tax_id, l.dist + 1 from lineage l join taxon t on t.tax_id = l.ancestor_id where t.parent_tax_id is not null",
        ("taxon",),
    ),
    "go_term": (
        "select p_partkey as go_id, p_name as name, case p_partkey % 3 when 0 then 'biological_process' when 1 then 'molecular_function' else 'cellular_component' end as namespace, p_partkey % 10 = 9 as is_obsolete from part",
        (),
    ),
    "go_edge": (
        "select p_partkey as child, 'is_a' as edge_type, p_partkey // 2 as parent from part where p_partkey >= 1 union all select p_partkey, 'part_of', p_partkey // 3 from part where p_partkey >= 3",
        (),
    ),
    "closure_": ("select go_id, go_id as ancestor from go_term union select c.go_id, e.parent from closure_ c join go_edge e on e.child = c.ancestor", ("go_term", "go_edge")),
    "closure_is_a": ("select go_id, go_id as ancestor from go_term union select c.go_id, e.parent from closure_is_a c join go_edge e on e.child = c.ancestor and e.edge_type = 'is_a'", ("go_term", "go_edge")),
    "subject_go": ("select distinct l_suppkey as subject_id, l_partkey as go_id from lineitem where l_linenumber = 7 and l_quantity >= 49", ()),
    "implied": ("select distinct m.peptide, a.subject_id from match_ m join accepted a on a.query_id = m.protein_id", ("match_", "accepted")),
    "flags": ("select p.*, p.peptide in (select peptide from implied) as is_annotated from peptide p", ("peptide", "implied")),
    "pep_tax": ("select distinct i.peptide, s.tax_id from implied i join subject_tax s on s.subject_id = i.subject_id", ("implied", "subject_tax")),
    "lca": (
        "select peptide, ancestor_id as lca_tax_id from (select *, row_number() over (partition by peptide order by dist) as r from"
        " (select p.peptide, l.ancestor_id, min(l.dist) as dist from pep_tax p join lineage l on l.tax_id = p.tax_id group by p.peptide, l.ancestor_id"
        " having count(*) = (select count(*) from pep_tax q where q.peptide = p.peptide)) c) d where r = 1",
        ("pep_tax", "lineage"),
    ),
    "nodes_of": ("select c.peptide, l.ancestor_id as tax_id from lca c join lineage l on l.tax_id = c.lca_tax_id", ("lca", "lineage")),
    "terms_of": ("select distinct i.peptide, c.ancestor as go_id from implied i join subject_go s on s.subject_id = i.subject_id join closure_ c on c.go_id = s.go_id", ("implied", "subject_go", "closure_")),
    "cover": (
        "select sum(quantity) as total_quantity, sum(case when is_annotated then quantity else 0 end) as annotated_quantity, count(*) as n_peptides, count(*) filter (where is_annotated) as n_annotated from flags",
        ("flags",),
    ),
    "tax_nodes": (
        "select n.tax_id, sum(f.quantity) as quantity, sum(f.quantity) / any_value(c.total_quantity) as ratio_total, sum(f.quantity) / any_value(c.annotated_quantity) as ratio_annotated, count(*) as n_peptides"
        " from nodes_of n join flags f on f.peptide = n.peptide cross join cover c group by n.tax_id",
        ("nodes_of", "flags", "cover"),
    ),
    "go_nodes": (
        "select n.go_id, sum(f.quantity) as quantity, sum(f.quantity) / any_value(c.total_quantity) as ratio_total, sum(f.quantity) / any_value(c.annotated_quantity) as ratio_annotated, count(*) as n_peptides"
        " from terms_of n join flags f on f.peptide = n.peptide cross join cover c group by n.go_id",
        ("terms_of", "flags", "cover"),
    ),
    "combos": (
        "select s.tax_id, s.go_id, s.quantity, s.quantity / t.quantity as fraction_of_taxon, s.quantity / g.quantity as fraction_of_go, t.ratio_total as ratio_total_taxon, g.ratio_total as ratio_total_go, s.n_peptides from"
        " (select n.tax_id, o.go_id, sum(f.quantity) as quantity, count(*) as n_peptides from nodes_of n join terms_of o on o.peptide = n.peptide join flags f on f.peptide = n.peptide group by n.tax_id, o.go_id) s"
        " join tax_nodes t on t.tax_id = s.tax_id join go_nodes g on g.go_id = s.go_id",
        ("nodes_of", "terms_of", "flags", "tax_nodes", "go_nodes"),
    ),
    "values_": (
        "select query_id, subject_id, evalue, pident from (select h.*, row_number() over (partition by h.query_id, h.subject_id order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as r"
        " from hits h join accepted a on a.query_id = h.query_id and a.subject_id = h.subject_id) t where r = 1",
        ("hits", "accepted"),
    ),
    "mapping": (
        "select f.peptide, m.protein_id as background_protein, a.subject_id as annotated_protein, v.evalue, v.pident from flags f join match_ m on m.peptide = f.peptide join accepted a on a.query_id = m.protein_id"
        " left join values_ v on v.query_id = a.query_id and v.subject_id = a.subject_id where f.is_annotated",
        ("flags", "match_", "accepted", "values_"),
    ),
    "reported": ("select n.*, t.name, t.rank, t.parent_tax_id from tax_nodes n join taxon t on t.tax_id = n.tax_id", ("tax_nodes", "taxon")),
}


#: Views.lines in SQL.
LINES = (
    f"(select l_suppkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey * {BRANCH} + b as l_orderkey, l_partkey * {BRANCH} + b as l_partkey from"
    " (select l.*, case when l_linenumber = 7 then 100 + l_suppkey when l_linenumber % 3 = 0 then 31 when l_linenumber % 3 = 1 then 25 + n_regionkey else s_nationkey end as b"
    " from lineitem l join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey))"
)


def sql(select: str, *views: str, branch: bool = False) -> str:
    """The select with the views that it needs before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL_VIEWS[name][1]:
            need(other)
        if name not in order:
            order.append(name)

    for name in views:
        need(name)
    return "with recursive " + ", ".join(f"{n} as ({SQL_VIEWS[n][0]})" for n in order).replace("{lines}", LINES if branch else "lineitem") + " " + select
