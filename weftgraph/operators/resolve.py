"""Cross-file references: call sites, mentions, unknown targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import before_last_dot, make_id, namespace

DOCUMENTS = ("document", "paper", "image")


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge a call site: to the method if there is one, else to the class, known or not."""
    ids = nodes.select("id").distinct()
    want = calls.withColumn("_m", make_id(F.lit("method"), "callee_class", "callee_method")).withColumn("_c", make_id(F.lit("apex"), "callee_class"))
    got = want.join(ids.withColumnRenamed("id", "_mid"), F.col("_m") == F.col("_mid"), "left").join(ids.withColumnRenamed("id", "_cid"), F.col("_c") == F.col("_cid"), "left")
    exact, known = F.col("_mid").isNotNull(), F.col("_cid").isNotNull()
    return got.select(
        F.col("caller_id").alias("source"),
        F.coalesce("_mid", "_c").alias("target"),
        F.lit("calls").alias("relation"),
        F.when(exact, "EXTRACTED").otherwise("INFERRED").alias("confidence"),
        F.when(exact, 1.0).when(known, 0.75).otherwise(0.5).alias("confidence_score"),
        "source_file",
        "ord",
    )


def resolve_calls_by_label(calls: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("ApexClass", "ApexInterface", "ApexEnum")) -> DataFrame:
    """Callees by label, whatever its case; one edge a caller and target; no calls of oneself."""
    by = nodes.where(F.col("sf_type").isin(*kinds)).groupBy(F.lower("label").alias("_label")).agg(F.max("id").alias("target"))
    hits = calls.withColumn("_label", F.lower("callee_class")).join(by, "_label").where("caller_id <> target")
    return hits.select(F.col("caller_id").alias("source"), "target").distinct().select("*", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score"))


def label_index(nodes: DataFrame) -> DataFrame:
    """(name, id, is_doc) by whole label and by label up to its last dot."""
    base = nodes.where("label is not null and label <> ''").select("id", "label", F.col("file_type").isin(*DOCUMENTS).alias("is_doc"))
    return base.select(F.col("label").alias("name"), "id", "is_doc").union(base.select(before_last_dot("label").alias("name"), "id", "is_doc")).where("name <> ''").distinct()


def resolve_mentions(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names in documents to nodes so labelled: none drops it, of several those that aren't documents, of several still all at two thirds of the score."""
    hits = mentions.join(label_index(nodes), "name").where("doc_id <> id")
    per = Window.partitionBy("doc_id", "name")
    hits = hits.withColumn("_solid", F.max((~F.col("is_doc")).cast("int")).over(per)).where("_solid = 0 or not is_doc").withColumn("candidates", F.count("*").over(per))
    return hits.select(
        F.col("doc_id").alias("source"),
        F.col("id").alias("target"),
        F.lit("references").alias("relation"),
        F.lit("INFERRED").alias("confidence"),
        F.when(F.col("candidates") > 1, F.round(F.col("score") * 0.67, 2)).otherwise(F.col("score")).alias("confidence_score"),
        "name",
        "candidates",
    )


def downgrade(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What was extracted but points at no known node is inferred, at 0.7 unless scored."""
    known = nodes.select(F.col("id").alias("_known")).distinct()
    lost = F.col("_known").isNull() & (F.col("confidence") == "EXTRACTED")
    return (
        edges.join(known, F.col("target") == F.col("_known"), "left")
        .withColumn("confidence_score", F.when(lost, F.coalesce("confidence_score", F.lit(0.7))).otherwise(F.col("confidence_score")))
        .withColumn("confidence", F.when(lost, "INFERRED").otherwise(F.col("confidence")))
        .drop("_known")
    )


def tag_namespaces(nodes: DataFrame, compatible: bool = False) -> DataFrame:
    return nodes.withColumn("namespace", namespace("label", compatible))
