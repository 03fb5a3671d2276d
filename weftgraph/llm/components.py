"""Connected components of links between integers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """``(id, comp)`` for every id of ``links(src, dst)``; ``comp`` is the lowest id of the component.

    Each round is written and reread. A neighbourhood is never held whole: its minimum is aggregated and joined back.
    """
    edges = materialise(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    known = _print(edges)
    while True:
        # large star: every higher neighbour takes the lowest of the neighbourhood
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        # small star: lower neighbours and the node itself take the lowest
        low = _lowest(large)
        new = materialise(low.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        discard(edges)
        discard(large)
        edges, before = new, known
        known = _print(edges)
        if known == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _lowest(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with ``m``, the least ``v`` of each ``u``."""
    return edges.join(edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")), F.col("u") == F.col("_u")).select("u", "v", "m")


def _print(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
