"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and calls one operator on all of docs.

All but the last return the columns of docs. Rows are judged one by one, by their id and text, so that a null doc_id or a
doc_id that several texts share makes no difference; rows that a stage keeps are passed on as they are. Rows that are
alike in id and text are one document: the near-duplicate stage leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small, table
from .op1_ordinal_toxicity import fit, score
from .op2_rans_tokens import digest
from .op3_simhash_decontam import leaks
from .op8_ngram_jaccard import link
from .op10_entropy_mixing import mix


def row() -> Column:
    return F.xxhash64("doc_id", "text")


def rows(docs: DataFrame) -> DataFrame:
    """docs as an operator reads them, known by their rows."""
    return docs.select(row().alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows in gone (doc_id: what rows() gives)."""
    gone = materialise(gone.select(F.col("doc_id").alias("_row")).distinct(), "stage-gone")
    return docs.withColumn("_row", row()).join(small(gone, gone.count()), "_row", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal model rejects; it is fitted on the labelled documents of the input."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return without(docs, score(rows(docs), model).where("toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of documents that five-word shingles link at 0.8 or more (a null one only if there is no other)."""
    linked = materialise(link(rows(docs), 5, 80, 100).where("n_shingles > 0").select("doc_id", "component_id"), "stage-linked")
    groups = linked.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    met = materialise(linked.join(groups, "component_id"), "stage-groups")
    ids = docs.select(row().alias("row"), F.col("doc_id").alias("id")).join(small(met.select(F.col("doc_id").alias("row")).distinct(), met.count()), "row", "left_semi").distinct()
    met = met.distinct().join(ids.withColumnRenamed("row", "doc_id"), "doc_id")
    stays = met.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("least")).select(F.col("least.doc_id").alias("doc_id"))
    kept = without(docs, met.select("doc_id").join(stays, "doc_id", "left_anti"))
    # rows that are alike have one name: one of them stays
    alike = materialise(kept.groupBy(row().alias("_row")).agg(F.count("*").alias("n")).where("n > 1").select("_row"), "stage-alike")
    n = alike.count()
    named = kept.withColumn("_row", row())
    once = named.join(small(alike, n), "_row", "left_semi").dropDuplicates(["_row"])
    return named.join(small(alike, n), "_row", "left_anti").unionByName(once).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return without(docs, leaks(rows(docs), table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it takes no copy of go. Rows that are alike get the nearest whole number to their mean."""
    copies = mix(rows(docs)).groupBy("doc_id").agg(F.round(F.avg("copies")).cast("int").alias("copies")).where("copies <> 1")
    copies = materialise(copies.withColumnRenamed("doc_id", "_row"), "stage-copies")
    at = docs.withColumn("_row", row()).join(small(copies, copies.count()), "_row", "left").withColumn("_copies", F.coalesce("copies", F.lit(1)))
    return at.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' token files and returns what reading them back gives."""
    return digest(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, f"stage-{name}")
    return docs
