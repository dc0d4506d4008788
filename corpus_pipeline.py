"""A corpus pipeline: language ID, quality rules, near-duplicates, packing. Each stage works on what the last one kept.

Every stage takes any row: a null or empty text has no language and goes in the first stage; rows that repeat an id, and
rows without one, are documents of their own; texts are read whole, however long; further columns pass through,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.llm import langid, near_dedup, packing, quality_rules
from taxaflow.llm.common import Workspace

#: A document goes if no language reaches this share of its words.
LEAST_LANGUAGE = 0.3
#: A document with fewer words is no text.
LEAST_WORDS = 5


def whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside its text, so that no column of the table can clash with an operator's."""
    return docs.select(F.struct("*").alias("row"), F.col("text").alias("body"))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language."""
    field = langid.fit_on(docs, F.lit(True))
    labelled = langid.predict(whole(docs), field, ["row"], "body")
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(whole(docs), ["row"], "body", min_words=LEAST_WORDS, keep_table=False).where("kept").select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Rows are told apart by a key of their own, so rows that repeat a doc_id are judged by their texts. Nulls go first.
    """
    ws = Workspace(spark, "deduplicated")
    # Written once, so the keys stay as they are.
    keyed = ws.write(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")))
    classes = near_dedup.near_duplicates(keyed.select("key", F.col("row.text").alias("text")), id_column="key").select("key", "component_id")
    named = classes.join(keyed.select("key", F.col("row.doc_id").alias("doc_id")), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.key")
    gone = ws.write(classes.select("key").join(first, "key", "left_anti"))
    if gone.count() <= near_dedup.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return keyed.join(gone, "key", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("language ID", identified), ("quality rules", good), ("near-duplicates", deduplicated), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written, then read by the next stage."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir))
        ws.drop_all_but(docs)
    return docs


#: Models and tokenizers have no form in SQL; tests hold the stages to brute force.
ORACLE_SQL = None
