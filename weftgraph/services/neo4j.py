"""Pushing a graph to a property-graph database in batches of parameters."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager

import pandas as pd
from pyspark.sql import functions as F

from weftgraph.functions.text import cypher_name
from weftgraph.plans.pipeline import Graph

#: What runs a statement with rows; opened once a task.
Opener = Callable[[], AbstractContextManager[Callable[[str, list[dict]], object]]]


def push(graph: Graph, opener: Opener, batch: int = 500) -> tuple[int, int]:
    """Merge nodes, then edges, by id; returns how many of either were sent. Sending again changes nothing."""
    nodes = graph.nodes.select("id", "label", F.coalesce(cypher_name("sf_type", "Entity"), F.lit("Entity")).alias("kind"))
    edges = graph.edges.select("source", "target", "confidence", F.upper(cypher_name("relation", "RELATES_TO")).alias("kind"))
    to_node = "UNWIND $rows AS r MERGE (n:{kind} {{id: r.id}}) SET n.label = r.label"
    to_edge = "UNWIND $rows AS r MATCH (a {{id: r.source}}), (b {{id: r.target}}) MERGE (a)-[e:{kind}]->(b) SET e.confidence = r.confidence"

    def sender(statement: str):
        def run(batches):
            n = 0
            with opener() as send:
                for pdf in batches:
                    for kind, own in pdf.groupby("kind"):
                        rows = own.drop(columns="kind").to_dict("records")
                        for i in range(0, len(rows), batch):
                            send(statement.format(kind=kind), rows[i : i + batch])
                            n += len(rows[i : i + batch])
            yield pd.DataFrame({"n": [n]})

        return run

    return tuple(df.mapInPandas(sender(s), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df, s in ((nodes, to_node), (edges, to_edge)))
