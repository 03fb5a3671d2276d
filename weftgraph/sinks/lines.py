"""Exports that are one line a node or an edge: Cypher, GraphML, Mermaid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import cypher_name, cypher_string, mermaid_label


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MERGE statements for nodes, then for edges."""
    n = nodes.select(_cat("MERGE (n:", cypher_name("sf_type", "Node"), " {id: '", cypher_string("id"), "'}) SET n.label = '", cypher_string(F.coalesce("label", "id")), "';").alias("line"))
    e = edges.select(_cat("MATCH (a {id: '", cypher_string("source"), "'}), (b {id: '", cypher_string("target"), "'}) MERGE (a)-[:", F.upper(cypher_name("relation", "RELATED_TO")), "]->(b);").alias("line"))
    return n.unionAll(e)


def xml_text(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): elements of a GraphML document; nulls are left out."""
    def data(key: str) -> Column:
        return F.coalesce(_cat(f'<data key="{key}">', xml_text(F.col(key).cast("string")), "</data>"), F.lit(""))

    n = nodes.select(F.lit(1).alias("part"), _cat('<node id="', xml_text("id"), '">', *[data(c) for c in ("label", "sf_type", "file_type", "source_file") if c in nodes.columns], "</node>").alias("line"))
    e = edges.select(F.lit(2).alias("part"), _cat('<edge source="', xml_text("source"), '" target="', xml_text("target"), '">', *[data(c) for c in ("relation", "confidence") if c in edges.columns], "</edge>").alias("line"))
    return n.unionAll(e)


def mermaid_id(x: str) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "_")


def mermaid_edges(edges: DataFrame) -> DataFrame:
    arrow = F.when(F.col("confidence") == "EXTRACTED", " -->|").otherwise(" -.->|")
    return edges.select(_cat(mermaid_id("source"), arrow, F.col("relation"), "| ", mermaid_id("target")).alias("line"))


def mermaid_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(_cat(mermaid_id("id"), '["', mermaid_label(F.coalesce("label", "id")), '"]').alias("line"))
