"""Links, tags and call sites of raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = "([A-Za-z_][A-Za-z0-9_]*)\\.([A-Za-z_][A-Za-z0-9_]*)\\("


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("href=[\"']([^\"'#]+)"), 1))).alias("target"))


def tags(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9:-]*)"), 1)).alias("t")).groupBy("page_id", F.lower("t").alias("tag")).agg(F.count("*").alias("n"))


def calls(pages: DataFrame) -> DataFrame:
    pair = F.arrays_zip(F.regexp_extract_all("html", F.lit(CALL), 1).alias("receiver"), F.regexp_extract_all("html", F.lit(CALL), 2).alias("method"))
    return pages.select("page_id", F.inline(F.array_distinct(pair)))
