"""Homology hits: thresholds, tie-aware top-k, what is accepted and which values are reported for it.

Hits: query_id, subject_id, evalue, bitscore, pident, qcov, alnlen, and a column (or struct) that orders their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import FilterPolicy


def passes(policy: FilterPolicy) -> Column:
    """The thresholds that are on. A metric that is not a number passes, as no comparison rejects it."""
    rules = [F.lit(True)]
    if policy.max_evalue is not None:
        rules.append(F.isnan("evalue") | (F.col("evalue") <= policy.max_evalue))
    for name, least in (("pident", policy.min_pident), ("qcov", policy.min_qcov), ("alnlen", policy.min_alnlen)):
        if least is not None:
            rules.append(F.col(name) >= least)  # NaN is above every number
    out = rules[0]
    for rule in rules[1:]:
        out = out & rule
    return out


def top_hits(hits: DataFrame, policy: FilterPolicy) -> DataFrame:
    """Hit rows that pass and are among the top_k by bitscore of their query; ties at the k-th row all stay."""
    kept = hits.where(passes(policy))
    if policy.top_k is None:
        return kept
    rank = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("bitscore")))
    return kept.withColumn("__rank", rank).where(F.col("__rank") <= policy.top_k).drop("__rank")


def accepted(hits: DataFrame, policy: FilterPolicy) -> DataFrame:
    """query_id, subject_id: each accepted pair once."""
    return top_hits(hits, policy).select("query_id", "subject_id").distinct()


def accepted_with_values(hits: DataFrame, policy: FilterPolicy, line: Column) -> DataFrame:
    """Each accepted pair with evalue and pident of its last line, which need not be a line that passed."""
    rows = hits.where("query_id is not null and subject_id is not null").withColumn("__passes", F.coalesce(passes(policy), F.lit(False)))
    rows = rows.withColumn("__line", line).repartition("query_id")  # for all that follows
    if policy.top_k is not None:
        rank = F.rank().over(Window.partitionBy("query_id", "__passes").orderBy(F.desc("bitscore")))
        rows = rows.withColumn("__passes", F.col("__passes") & (rank <= policy.top_k))
    last = F.max_by(F.struct("evalue", "pident"), "__line").alias("v")
    pairs = rows.groupBy("query_id", "subject_id").agg(last, F.bool_or("__passes").alias("accepted"))
    return pairs.where("accepted").select("query_id", "subject_id", "v.evalue", "v.pident")


def counters(hits: DataFrame, policy: FilterPolicy) -> DataFrame:
    """query_id, total_hits, passed_threshold_hits, n_accepted."""
    totals = hits.groupBy("query_id").agg(F.count("*").alias("total_hits"), F.count_if(passes(policy)).alias("passed_threshold_hits"))
    chosen = accepted(hits, policy).groupBy("query_id").agg(F.count("*").alias("n_accepted"))
    return totals.join(chosen, "query_id", "left").withColumn("n_accepted", F.coalesce("n_accepted", F.lit(0).cast("bigint")))
