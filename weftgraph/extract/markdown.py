"""Documents: lines, headings, code spans, names they mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Capitalised words of prose that name nothing.
DENY = ("The", "That", "This", "And", "For", "With", "From", "Are", "Was")
MORE_DENY = ("API", "URL", "JSON", "XML", "HTML", "HTTP", "README", "TODO", "NOTE", "See", "When", "Where", "What", "Which", "Then", "There", "These", "Those", "Each", "Use", "Using", "Used", "New", "Old", "All", "Any", "Not", "You", "Your", "Our", "How", "Why", "Who", "Yes", "True", "False", "Null", "None", "Example", "Table", "Figure", "Section")
NAME = "(?:^|[^A-Za-z0-9_\\x{80}-\\x{10FFFF}])([A-Z][a-z]+[A-Za-z0-9_]*)"
CUSTOM = "(?:^|[^A-Za-z0-9_])([A-Za-z][A-Za-z0-9_]*__(?:c|e|x|mdt|r))(?![A-Za-z0-9_])"
FENCED = "(?s)```.*?(?:```|$)"
INLINE = "`[^`\\n]+`"


def lines(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, line, text), lines from 1."""
    return docs.select(doc, F.posexplode(F.split("text", "\\r?\\n")).alias("_p", "text")).select(doc, (F.col("_p") + 1).alias("line"), "text")


def headings(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, line, level, heading) of levels 1 to 3."""
    hit = lines(docs, doc).where(F.col("text").rlike("^#{1,3}[ \\t]+[^ \\t]"))
    return hit.select(doc, "line", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.btrim(F.regexp_extract("text", "^#{1,3}[ \\t]+(.+)$", 1), F.lit(" ")).alias("heading"))


def names(docs: DataFrame, least: int = 3, doc: str = "doc_id") -> DataFrame:
    """(doc, name): distinct capitalised names that aren't denied."""
    found = docs.select(doc, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), 1))).alias("name"))
    return found.where((F.length("name") >= least) & ~F.col("name").isin(*DENY))


def mentions(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, name, score): each name once, at .75 if it stands in code, .6 otherwise; custom names are never denied."""
    fenced = F.regexp_extract_all("text", F.lit(FENCED), 0)
    inline = F.regexp_extract_all(F.regexp_replace("text", FENCED, " "), F.lit(INLINE), 0)
    prose = F.regexp_replace(F.regexp_replace("text", FENCED, " "), INLINE, " ")
    parts = docs.select(doc, F.explode(F.array(F.struct(F.array_join(F.concat(fenced, inline), " ").alias("t"), F.lit(0.75).alias("score")), F.struct(prose.alias("t"), F.lit(0.6).alias("score")))).alias("p")).select(doc, "p.t", "p.score")
    plain = parts.select(doc, "score", F.explode(F.regexp_extract_all("t", F.lit(NAME), 1)).alias("name")).where(~F.col("name").isin(*DENY, *MORE_DENY) | F.col("name").rlike("__(c|e|x|mdt|r)$"))
    custom = parts.select(doc, "score", F.explode(F.regexp_extract_all("t", F.lit(CUSTOM), 1)).alias("name"))
    return plain.unionAll(custom).where(F.length("name") >= 3).groupBy(doc, "name").agg(F.max("score").alias("score"))
