"""Prose, papers, images and workbooks as nodes, with headings, tables and the names they mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract import markdown, office
from weftgraph.extract.fragments import Fragments


def slug(c) -> F.Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "_")


def doc_id(path) -> F.Column:
    """``doc_<stem>_<start of the path's hash>``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.lit("doc_"), slug(F.regexp_replace(name, "\\.[^.]*$", "")), F.lit("_"), F.substring(F.sha2(path, 256), 1, 8))


def own_nodes(files: DataFrame) -> DataFrame:
    return files.select(doc_id("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("Document").alias("sf_type"), F.col("kind").alias("file_type"), F.col("path").alias("source_file"))


def extract(files: DataFrame) -> Fragments:
    """Fragments of ``files(path, kind, content)`` whose kind is document, paper or image."""
    own = own_nodes(files)
    read = files.where("kind <> 'image'").select("path", "kind", doc_id("path").alias("doc_id"), office.as_text(F.col("content"), F.col("path")).alias("text"))
    heads = markdown.headings(read.where("kind = 'document'").select(F.struct("doc_id", "path").alias("at"), "text"), "at").select("at.*", "line", "level", "heading")
    hid = F.concat("doc_id", F.lit("_h_"), F.btrim(F.substring(slug("heading"), 1, 40), F.lit("_")), F.lit("_"), "line")
    sections = heads.select(hid.alias("id"), F.col("heading").alias("label"), F.lit("DocumentSection").alias("sf_type"), F.lit("document").alias("file_type"), F.col("path").alias("source_file"), "line", F.create_map(F.lit("heading_level"), F.col("level").cast("string")).alias("attrs"))
    held = heads.select(F.col("doc_id").alias("source"), hid.alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit(0.5).alias("weight"), F.col("path").alias("source_file"), "line", F.col("line").cast("long").alias("ord"))
    named = markdown.mentions(read.select(F.struct("doc_id", "path").alias("at"), "text"), "at").select("at.doc_id", "name", "score", F.col("at.path").alias("source_file"))
    got = Fragments.of(files.sparkSession, own.unionByName(sections, allowMissingColumns=True), held, None, named)
    return got + sheets(files.where(F.lower("path").endswith(".xlsx")))


def sheets(files: DataFrame) -> Fragments:
    """Sheets, named tables and columns of workbooks, each in what holds it."""
    rows = files.select("path", doc_id("path").alias("doc"), slug(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")).alias("stem"), F.posexplode(office.structure(F.col("content"))).alias("ord", "s")).select("path", "doc", "stem", "ord", "s.*")
    key = lambda *c: F.concat(F.lit("xlsx_"), slug(F.concat_ws("_", *c)))
    me = F.when(F.col("col").isNotNull(), key("stem", "sheet", "tbl", "col")).when(F.col("tbl").isNotNull(), key("stem", "sheet", "tbl")).otherwise(key("stem", "sheet"))
    holder = F.when(F.col("col").isNotNull(), key("stem", "sheet", "tbl")).when(F.col("tbl").isNotNull(), key("stem", "sheet")).otherwise(F.col("doc"))
    nodes = rows.select(me.alias("id"), F.coalesce("col", "tbl", F.concat("sheet", F.lit(" (sheet)"))).alias("label"), F.lit("DocumentSection").alias("sf_type"), F.lit("document").alias("file_type"), F.col("path").alias("source_file"))
    edges = rows.select(holder.alias("source"), me.alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit(0.5).alias("weight"), F.col("path").alias("source_file"), F.col("ord").cast("long").alias("ord"))
    return Fragments.of(files.sparkSession, nodes, edges)
