"""Graphs as node-link JSON: one document for other tools, read back with ``links`` or ``edges``."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import score_of, strip_accents
from weftgraph.plans.pipeline import Graph
from weftgraph.schema import EDGE, NODE, conform, empty


def node_rows(graph: Graph) -> DataFrame:
    """Nodes with community and plain lower-case label."""
    return graph.nodes.drop("community", "norm_label").join(graph.members, "id", "left").withColumn("norm_label", F.lower(strip_accents("label")))


def edge_rows(graph: Graph) -> DataFrame:
    return graph.edges.withColumn("confidence_score", score_of("confidence", "confidence_score"))


def write(graph: Graph, path: str, commit: str | None = None, force: bool = False) -> bool:
    """Write the document, unless it would replace one of more nodes and ``force`` isn't set. Rows are streamed, not held."""
    target, count = Path(path), graph.nodes.count()
    if target.exists() and not force:
        try:
            with open(target, encoding="utf-8") as f:
                said = re.match(r'{"directed": true, "multigraph": true, "graph": {"node_count": (\d+)}', f.read(200))
            # a document of other tools doesn't say its number of nodes first
            before = int(said[1]) if said else len(json.loads(target.read_text())["nodes"])
            if before > count:
                return False
        except (ValueError, KeyError, TypeError):
            pass
    aside = f"{path}.new"
    with open(aside, "w", encoding="utf-8") as f:
        f.write(f'{{"directed": true, "multigraph": true, "graph": {{"node_count": {count}}}, ')
        for name, df, order in (("nodes", node_rows(graph), ["id"]), ("links", edge_rows(graph), ["source", "target", "key"])):
            f.write(f'"{name}": [')
            text = df.orderBy(*order).select(F.to_json(F.struct("*")).alias("j"))
            for k, row in enumerate(text.toLocalIterator()):
                f.write((",\n" if k else "\n") + row.j)
            f.write("], ")
        f.write('"hyperedges": []' + (f', "built_at_commit": {json.dumps(commit)}' if commit else "") + "}\n")
    os.replace(aside, path)
    return True


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document; a missing or malformed one is an empty graph."""
    links = f"array<struct<{', '.join(f'{c.strip().split(' ')[0]}:{c.strip().split(' ')[1]}' for c in EDGE.split(','))}>>"
    if not os.path.exists(path):
        return empty(spark, NODE), empty(spark, EDGE)
    nodes = "array<struct<id:string,label:string,sf_type:string,file_type:string,source_file:string,line:int,stub:boolean,attrs:map<string,string>,community:int>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes {nodes}, links {links}, edges {links}").alias("d"))
    return conform(doc.selectExpr("inline(d.nodes)"), NODE + ", community int"), conform(doc.selectExpr("inline(coalesce(d.links, d.edges))"), EDGE)
