"""What an extractor yields of a file: nodes, edges, calls and mentions, and helpers to state them as Catalyst expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import make_id
from weftgraph.schema import EDGE, MENTION, NODE, RAW_CALL, conform, empty

NODE_STRUCT = "array<struct<id:string,label:string,sf_type:string,file_type:string,line:int,attrs:map<string,string>>>"
EDGE_STRUCT = "array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,weight:double,operation:string,line:int>>"


@dataclass
class Fragments:
    """The four outputs, conforming to their schemas."""

    nodes: DataFrame
    edges: DataFrame
    calls: DataFrame
    mentions: DataFrame

    @staticmethod
    def of(spark, nodes=None, edges=None, calls=None, mentions=None) -> Fragments:
        def one(df, schema):
            return empty(spark, schema) if df is None else conform(df, schema)

        return Fragments(one(nodes, NODE), one(edges, EDGE), one(calls, RAW_CALL), one(mentions, MENTION))

    def __add__(self, other: Fragments) -> Fragments:
        return Fragments(*(a.unionByName(b) for a, b in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.nodes, self.edges, self.calls, self.mentions


def ident(prefix: str, *parts: Column) -> Column:
    """An id, or null where its last part is null or empty."""
    last = parts[-1]
    return F.when(last.isNotNull() & (F.btrim(last) != ""), make_id(F.lit(prefix), *parts))


def attrs(**given: Column | str | None) -> Column:
    """A map of those attributes that aren't null or empty."""
    if not given:
        return F.lit(None).cast("map<string,string>")
    rows = F.array(*[F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).cast("string").alias("value")) for k, v in given.items()])
    kept = F.filter(rows, lambda r: r["value"].isNotNull() & (r["value"] != ""))
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


def node(id_: Column, label: Column, sf_type: str | Column, file_type: str, line: Column | None = None, **more) -> Column:
    kind = F.lit(sf_type) if isinstance(sf_type, str) else sf_type
    return F.struct(id_.alias("id"), label.alias("label"), kind.alias("sf_type"), F.lit(file_type).alias("file_type"), (F.lit(None) if line is None else line).cast("int").alias("line"), attrs(**more).alias("attrs"))


def edge(source: Column, target: Column, relation: str | Column, confidence: str | Column = "EXTRACTED", weight: float = 1.0, score: float | None = None, operation: Column | str | None = None) -> Column:
    def c(x):
        return F.lit(x) if isinstance(x, str) else x

    return F.struct(
        source.alias("source"),
        target.alias("target"),
        c(relation).alias("relation"),
        c(confidence).alias("confidence"),
        F.lit(score).cast("double").alias("confidence_score"),
        F.lit(float(weight)).alias("weight"),
        (F.lit(None) if operation is None else c(operation)).cast("string").alias("operation"),
        F.lit(None).cast("int").alias("line"),
    )


def each(items: Column, fn) -> Column:
    """``fn`` of every element; an array even where ``items`` is null."""
    return F.coalesce(F.transform(items, lambda e: fn(e)), F.array())  # only the element: defaults of fn aren't the lambda's


def both(*arrays: Column) -> Column:
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def explode_nodes(df: DataFrame) -> DataFrame:
    """Rows of ``nodes`` arrays with their file."""
    return df.select("source_file", F.explode("nodes").alias("n")).where("n.id is not null").select("n.*", "source_file")


def explode_edges(df: DataFrame) -> DataFrame:
    """Rows of ``edges`` arrays with their file; the position in the file is their order. Repeats within a file count once."""
    rows = df.select("source_file", F.posexplode(F.array_distinct("edges")).alias("ord", "e")).where("e.source is not null and e.target is not null")
    return rows.select("e.*", "source_file", F.col("ord").cast("long").alias("ord"))
