"""Files to fragments: what each kind's extractor is, and the pass that runs them all.

Small files are read once and written, packed and partitioned by kind, to the shared folder; each extractor then reads
its own kinds' partitions alone. Extractors never fail on a file: what can't be read gives less, or nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract import apex, bundles, documents
from weftgraph.extract.fragments import EDGE_STRUCT, NODE_STRUCT, Fragments, explode_edges, explode_nodes
from weftgraph.extract.xml_kinds import KINDS, File, Kind
from weftgraph.session import shared_dir

#: Files that one task reads, about.
TASK_FILES = 50_000
Extractor = Callable[[DataFrame], Fragments]
#: Kinds whose extractors are functions of files(path, kind, content, text).
EXTRACTORS: dict[str, Extractor] = {"apex_class": apex.extract, "apex_trigger": apex.extract, "lwc": bundles.lwc, "aura": bundles.aura, "vf_page": bundles.visualforce, "vf_component": bundles.visualforce, "document": documents.extract, "paper": documents.extract, "image": documents.extract}


def register_extractor(kind: str, suffixes: tuple[str, ...], extractor: Extractor) -> None:
    """Add a kind of file: paths that end in one of ``suffixes`` go to ``extractor``."""
    from weftgraph.sources import files

    files.SUFFIXES = (*files.SUFFIXES, *((s, kind) for s in suffixes))
    EXTRACTORS[kind] = extractor


def xml_arrays(files: DataFrame, name: str, kind: Kind) -> DataFrame:
    """(source_file, nodes, edges) of the files of one kind of metadata."""
    suffix = "|".join(s.replace(".", "\\.") for s in sorted(kind.suffixes, key=len, reverse=True))
    base = F.element_at(F.split("path", "/"), -1)
    up = lambda k: F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-1 - k)), F.lit(""))
    fields = f"{kind.schema}{', ' if kind.schema else ''}_bad string"
    df = files.where(F.col("kind") == name).select("path", "text", base.alias("base"), F.regexp_replace(base, f"({suffix})$", "").alias("name"), up(1).alias("parent"), up(2).alias("grand"))
    # one element of a struct at least, or from_xml has nothing to fill
    df = df.withColumn("x", F.from_xml("text", F.lit(fields if kind.schema else "_any string, _bad string"), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    df = df.withColumn("text", F.when(F.col("x._bad").isNull(), F.col("text")).otherwise("<none/>"))
    if kind.strict:
        df = df.where("x is not null and x._bad is null")
    nodes, edges = kind.build(File(F.col("x"), F.col("text"), F.col("name"), F.col("base"), F.col("parent"), F.col("grand")))
    return df.select(F.col("path").alias("source_file"), nodes.cast(NODE_STRUCT).alias("nodes"), edges.cast(EDGE_STRUCT).alias("edges"))


def extract(files: DataFrame) -> Fragments:
    """Fragments of ``files(path, kind, content)``."""
    spark = files.sparkSession
    at = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    # a small table of many files is one task's input, and packed files shrink: rows are dealt to tasks by number, not by bytes
    packed = files.select("path", "kind", "content")
    parts = max(spark.sparkContext.defaultParallelism, -(-packed.count() // TASK_FILES))
    packed.withColumn("_task", F.pmod(F.xxhash64("path"), F.lit(parts))).repartition(parts, "_task").drop("_task").write.partitionBy("kind").parquet(at)
    held = spark.read.schema("path string, content binary, kind string").parquet(at).withColumn("text", F.decode(F.when(~F.lower("path").rlike("\\.(docx|xlsx|pdf|png|jpe?g|gif|webp)$"), F.col("content")), "UTF-8"))
    there = {r.kind for r in held.select("kind").distinct().collect()}
    out = Fragments.of(spark)
    arrays = [xml_arrays(held, name, kind) for name, kind in sorted(KINDS.items()) if name in there]
    if arrays:
        every = reduce(DataFrame.unionByName, arrays)
        kept = f"{at}-fragments"
        every.write.parquet(kept)
        every = spark.read.schema(every.schema).parquet(kept)
        out += Fragments.of(spark, explode_nodes(every), explode_edges(every))
    by: dict[Extractor, list[str]] = {}
    for name, extractor in EXTRACTORS.items():
        if name in there:
            by.setdefault(extractor, []).append(name)
    for extractor, names in by.items():
        out += extractor(held.where(F.col("kind").isin(*names)))
    return out
