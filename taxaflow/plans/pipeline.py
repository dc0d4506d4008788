"""The whole run as one plan: peptides, matches, hits, annotations, roll-ups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, annotate, graphs, hierarchy, hits as hit_ops
from ..operators.closing import closed_sets
from ..params import FilterPolicy, GoOptions
from .tables import dropped, scratch, written


@dataclass
class Annotated:
    """What reports need, as long tables, each made when it is first asked for.

    What all reports read is written once, at that time: the numbered tree, a row for each peptide with its lowest common ancestor,
    its own terms, and the edges that close them. close() deletes it.

    peptides: peptide, quantity, and the columns of `by` (list_id, say), each peptide once in each group; all groups are
    annotated and rolled up together. Either hits with a policy, or accepted pairs (query_id, subject_id). only_asked: all matches
    are known to be of these peptides, as they are where these were looked for.
    """

    peptides: DataFrame
    all_matches: DataFrame
    subject_tax: DataFrame
    subject_go: DataFrame
    taxa: DataFrame
    edges: DataFrame
    hits: DataFrame | None = None
    policy: FilterPolicy = field(default_factory=FilterPolicy)
    line: Column | None = None
    given: DataFrame | None = None
    go: GoOptions = field(default_factory=GoOptions)
    by: tuple[str, ...] = ()
    only_asked: bool = False

    @cached_property
    def matches(self) -> DataFrame:
        return self.all_matches.join(self.peptides.select("peptide"), "peptide", "left_semi")

    @property
    def asked_matches(self) -> DataFrame:
        """The matches of the peptides, in each group that has the peptide, with the columns of `by`."""
        known = self.all_matches.where("peptide is not null")
        return known if self.only_asked and not self.by else known.join(self.peptides.select(*self.by, "peptide"), "peptide")

    @cached_property
    def accepted(self) -> DataFrame:
        return self.given if self.hits is None else hit_ops.accepted(self.hits, self.policy)

    @cached_property
    def values(self) -> DataFrame | None:
        if self.hits is None:
            return None
        return hit_ops.accepted_with_values(self.hits, self.policy, F.col("line") if self.line is None else self.line)

    @cached_property
    def tree(self) -> DataFrame:
        with scratch() as keep:
            return keep(graphs.tree(self.taxa, self.subject_tax.select("tax_id")))

    @cached_property
    def rows(self) -> DataFrame:
        """peptide, quantity, is_annotated, lca_tax_id, and the columns of `by`."""
        tree = self.tree
        with scratch() as keep:
            # Written, so that its size is known: a small one is broadcast.
            ends = written(annotate.subject_ends(self.subject_tax, tree))
            summaries = annotate.peptide_summaries(self.all_matches, annotate.protein_summaries(self.accepted, ends))
            return keep(written(annotate.annotated_peptides(self.peptides, summaries, tree)))

    @property
    def known_terms(self) -> DataFrame:
        """subject_id, go_id: the terms that links close; all of a subject's terms if terms are not in their own closure."""
        known = self.subject_go.where("go_id is not null").select("subject_id", "go_id").distinct()
        if self.go.include_self:
            return known
        above = graphs.closure(self.edges, known, self.go.edge_types, include_self=False)
        return known.join(above, "go_id").select("subject_id", F.col("ancestor").alias("go_id")).distinct()

    @cached_property
    def own(self) -> DataFrame:
        """peptide, terms: a peptide's own terms."""
        with scratch() as keep:
            return keep(written(annotate.own_terms(self.all_matches, self.accepted, written(self.known_terms))))

    @cached_property
    def links(self) -> DataFrame:
        """child, parent: the edges that closures follow; none if terms are not in their own closure, as own() then has all that are."""
        chosen = graphs.links(self.edges, self.go.edge_types)
        return written(chosen if self.go.include_self else chosen.where(F.lit(False)))

    @property
    def paths(self) -> DataFrame:
        return self.tree.select(F.col("tax_id").alias("lca_tax_id"), F.col("path").alias("nodes"))

    @property
    def lcas(self) -> DataFrame:
        return self.rows.where("lca_tax_id is not null").select("peptide", "lca_tax_id").distinct()

    @property
    def nodes_of(self) -> DataFrame:
        """peptide, tax_id: the lineage of each peptide's lowest common ancestor."""
        return self.lcas.join(self.paths, "lca_tax_id").select("peptide", F.explode("nodes").alias("tax_id"))

    @property
    def terms_of(self) -> DataFrame:
        """peptide, go_id: closure over the terms of the implied subjects."""
        asked = written(self.own.join(self.peptides.select("peptide"), "peptide", "left_semi"))
        return closed_sets(asked, self.links, "peptide").select("peptide", F.explode("terms").alias("go_id"))

    def coverage(self) -> DataFrame:
        return aggregate.coverage(self.rows, self.by)

    def taxonomy_nodes(self) -> DataFrame:
        return aggregate.roll_up(aggregate.node_sums(self.rows, self.paths, self.by), self.coverage(), "tax_id", self.by)

    def go_terms(self) -> DataFrame:
        sets = aggregate.set_sums(self.rows, self.own, *self.by)
        return aggregate.roll_up(aggregate.term_sums(sets, self.links, self.by), self.coverage(), "go_id", self.by)

    def combos(self) -> DataFrame:
        # Both marginals and the pairs are made of these, so peptides meet their terms once.
        sets = written(aggregate.set_sums(self.rows, self.own, *self.by, "lca_tax_id"))
        nodes = written(aggregate.node_sums(self.rows, self.paths, self.by))
        terms = aggregate.term_sums(aggregate.regrouped(sets, *self.by, "terms"), self.links, self.by)
        sums = aggregate.pair_sums(sets, nodes, self.paths, self.links, self.by)
        return aggregate.combos(sums, nodes, terms, self.coverage(), self.by)

    def combo_slice(self, tax_id: int | None = None, go_id=None) -> DataFrame:
        """The rows of combos() of one organism, or of one function, made of nothing else.

        A function's pairs are the organisms of the peptides that have it, so no set is closed. An organism's are closed from the
        peptides below it alone.
        """
        nodes = written(aggregate.node_sums(self.rows, self.paths, self.by))
        if tax_id is None:
            holding = annotate.peptides_holding(self.all_matches, self.accepted, self._holders(go_id))
            rows = written(self.rows.where("is_annotated").join(holding, "peptide", "left_semi"))
            term = F.lit(go_id).cast(self.subject_go.schema["go_id"].dataType).alias("go_id")
            sums = aggregate.node_sums(rows, self.paths, self.by).withColumn("go_id", term)
            terms = aggregate.summed(rows, *self.by).withColumn("go_id", term)
        else:
            sets = written(aggregate.set_sums(self.rows, self.own, *self.by, "lca_tax_id"))
            nodes = nodes.where(F.col("tax_id") == tax_id)
            terms = aggregate.term_sums(aggregate.regrouped(sets, *self.by, "terms"), self.links, self.by)
            below = self.paths.where(F.array_contains("nodes", tax_id)).withColumn("nodes", F.array(F.lit(tax_id).cast("bigint")))
            sums = aggregate.pair_sums(sets, nodes, below, self.links, self.by)
        return aggregate.combos(sums, nodes, terms, self.coverage(), self.by)

    def _holders(self, go_id) -> DataFrame:
        """subject_id, holds (true) of the subjects with the function."""
        links = self.links
        with scratch() as keep:
            below = graphs.terms_below(links, go_id)
            return keep(written(self.known_terms.join(below, "go_id", "left_semi").select("subject_id", F.lit(True).alias("holds")).distinct()))

    def pairs(self, rows: DataFrame | None = None) -> DataFrame:
        """The mapping without its arrays, of all peptides or of some rows."""
        return annotate.pairs(self.rows if rows is None else rows, self.all_matches, self.accepted, self.values)

    def found_pairs(self, values: bool = True) -> DataFrame:
        """pairs() without lca_tax_id, for which neither rows nor a tree are made. values: else evalue and pident are null."""
        return annotate.found_pairs(self.asked_matches, self.accepted, self.values if values else None)

    def drilled(self, tax_ids: DataFrame | None = None, go_id=None, values: bool = True) -> DataFrame:
        """found_pairs() of the peptides with one of the organisms and with the function; of all annotated ones by no selection.

        Proteins and peptides are summarised by what their subjects have, from the same exchanges that pairs are made of, so a click
        makes neither rows nor own terms.
        """
        tree = None if tax_ids is None else self.tree
        ends = None if tax_ids is None else written(annotate.subject_ends(self.subject_tax, tree))
        holders = None if go_id is None else self._holders(go_id)
        pairs = self.found_pairs(values)
        if tax_ids is None and go_id is None:
            return pairs
        if ends is None:
            chosen = annotate.peptides_holding(self.all_matches, self.accepted, holders)
        else:
            further = () if go_id is None else ("holds",)
            subjects = self.accepted.join(holders, "subject_id", "left") if further else self.accepted
            chosen = annotate.peptide_summaries(self.all_matches, annotate.protein_summaries(subjects, ends, *further), *further)
            chosen = hierarchy.with_organisms(graphs.with_lowest_common(chosen.where("holds") if further else chosen, tree), tree, tax_ids)
        return pairs.join(chosen.select("peptide"), "peptide", "left_semi")

    def mapping(self, shown: Callable[[Column], Column] = lambda array: array) -> DataFrame:
        return annotate.mapping(self.pairs(annotate.with_organisms(self.rows, self.tree)), self.own, self.links, shown)

    def close(self) -> None:
        """Delete what was written; no frame of this object can be read afterwards."""
        dropped(*[self.__dict__[k] for k in ("tree", "rows", "own", "links") if k in self.__dict__])
