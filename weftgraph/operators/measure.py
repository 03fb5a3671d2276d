"""Degrees, distributions, audits, cohesion, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import CONFIDENCES, FILE_TYPES


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out, parallels each, a loop twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degrees_of(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``degrees`` of a few nodes (``id``) without counting the ends of all others."""
    ids = ids.select("id").distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    return ids.join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def distribution(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def audit(edges: DataFrame) -> DataFrame:
    """Share of each confidence class, in whole percent, and the mean score of its edges."""
    by = edges.groupBy(F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("confidence_score", F.when(F.col("confidence") == "INFERRED", 0.5))), 2).alias("mean_score"))
    return by.withColumn("percent", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 0))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density of the directed graph, average and greatest degree, isolated nodes."""
    deg = degrees(nodes, edges).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    n, e = F.col("nodes"), (F.col("ends") / 2).cast("bigint")
    return deg.select("nodes", e.alias("edges"), F.round(F.when(n > 1, e * 2.0 / (n * (n - 1).cast("double"))).otherwise(0.0), 6).alias("density"), F.round(F.when(n > 0, F.col("ends") / n).otherwise(0.0), 2).alias("avg_degree"), "max_degree", "isolated")


def in_community(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with the community of either end; ``members(id, community)``."""
    s = members.select(F.col("id").alias("source"), F.col("community").alias("source_community"))
    t = members.select(F.col("id").alias("target"), F.col("community").alias("target_community"))
    return edges.join(s, "source").join(t, "target")


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct unordered pairs inside a community over the pairs there could be; 1 for a single node."""
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    inside = in_community(edges, members).where("source_community = target_community").select(F.col("source_community").alias("community"), F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().groupBy("community").agg(F.count("*").alias("pairs"))
    n = F.col("size")
    return size.join(inside, "community", "left").select("community", "size", F.when(n <= 1, F.lit(1.0)).otherwise(F.round(F.coalesce("pairs", F.lit(0)) / (n * (n - 1) / 2), 2)).alias("cohesion"))


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between communities, whichever way."""
    between = in_community(edges, members).where("source_community <> target_community")
    return between.groupBy(F.least("source_community", "target_community").alias("a"), F.greatest("source_community", "target_community").alias("b")).agg(F.count("*").alias("n"))


def community_labels(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """The label of each community's node of highest degree, the least id among equals."""
    named = nodes.select("id", "label", "sf_type")
    ranked = named.join(degrees(nodes, edges), "id").join(members.select("id", "community"), "id").where(~noise())
    return ranked.groupBy("community").agg(F.min_by("label", F.struct(-F.col("degree"), "id")).alias("label"))


def noise():
    """Methods with at most one edge say nothing about structure."""
    return F.col("sf_type").isin("ApexMethod", "LWCMethod", "AuraMethod") & (F.col("degree") <= 1)


def concept():
    """Nodes without a file."""
    return F.col("source_file").isNull() | (F.col("source_file") == "") | ~F.element_at(F.split("source_file", "/"), -1).contains(".")


def dominant_confidence(edges: DataFrame) -> DataFrame:
    """Of each source, its commonest confidence, the first seen among equals."""
    by = edges.groupBy("source", "confidence").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return by.groupBy("source").agg(F.max_by("confidence", F.struct("n", -F.col("first"), "confidence")).alias("confidence"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, ref, error) of everything wrong with a fragment."""
    ids = nodes.select(F.col("id").alias("_id"))

    def bad(df: DataFrame, condition, kind: str, ref, error: str) -> DataFrame:
        return df.where(condition).select(F.lit(kind).alias("kind"), F.coalesce(ref, F.lit("")).alias("ref"), F.lit(error).alias("error"))

    pair = F.concat_ws("->", "source", "target")
    out = bad(nodes, "id is null or id = ''", "node", F.col("label"), "no id")
    out = out.unionAll(bad(nodes, "label is null or label = ''", "node", F.col("id"), "no label"))
    out = out.unionAll(bad(nodes, ~F.col("file_type").isin(*FILE_TYPES), "node", F.col("id"), "unknown file_type"))
    out = out.unionAll(bad(edges, ~F.col("confidence").isin(*CONFIDENCES), "edge", pair, "unknown confidence"))
    for end in ("source", "target"):
        out = out.unionAll(bad(edges, f"{end} is null or {end} = ''", "edge", pair, f"no {end}"))
        out = out.unionAll(bad(edges.where(f"{end} <> ''").join(ids, F.col(end) == F.col("_id"), "left_anti"), F.lit(True), "edge", pair, f"unknown {end}"))
    return out
