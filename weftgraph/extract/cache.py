"""Fragments kept by what a file holds and where it lies, so that a file seen before isn't extracted again.

A Parquet table for each of the four outputs, partitioned by version and appended to; keys are listed last, so a run that
ends halfway leaves rows that no key names and that readers therefore pass over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.extract import extract
from weftgraph.extract.fragments import Fragments
from weftgraph.session import cut

#: Part of the path: another version of the extractors finds nothing of an earlier one's.
VERSION = "1"
PARTS = ("nodes", "edges", "calls", "mentions")


def keyed(files: DataFrame) -> DataFrame:
    """Files with ``key``, a hash of content and path."""
    return files.withColumn("key", F.sha2(F.concat(F.col("content"), F.lit("\0").cast("binary"), F.col("path").cast("binary")), 256))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key, run, path) of all files whose fragments are kept."""
    at = f"{folder}/v{VERSION}/keys"
    return spark.read.parquet(at) if _there(spark, at) else spark.createDataFrame([], "key string, run string, path string")


def extract_cached(files: DataFrame, folder: str) -> Fragments:
    """``extract(files)``, of which files seen before are read from the cache and the others are added to it."""
    spark = files.sparkSession
    every, known = cut(keyed(files)), keys(spark, folder)
    first = known.groupBy("key").agg(F.min("run").alias("run"))  # two runs may both have met a file
    hits = cut(every.join(first, "key").select("path", "run"))
    misses = every.join(known.select("key"), "key", "left_anti").drop("key")
    at, run = f"{folder}/v{VERSION}", uuid.uuid4().hex
    got = Fragments(*(cut(p) for p in extract(misses).parts()))
    for name, part in zip(PARTS, got.parts(), strict=True):
        part.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{at}/{name}")
    every.join(known.select("key"), "key", "left_anti").select("key", F.lit(run).alias("run"), "path").write.mode("append").parquet(f"{at}/keys")
    if hits.isEmpty():
        return got
    held = []
    for name, part in zip(PARTS, got.parts(), strict=True):
        stored = spark.read.schema(part.withColumn("run", F.lit("")).schema).parquet(f"{at}/{name}")
        held.append(stored.join(hits.withColumnRenamed("path", "source_file"), ["source_file", "run"], "left_semi").select(*part.columns))
    return got + Fragments(*held)


def clear(spark: SparkSession, folder: str) -> int:
    """Delete what is kept; how many files it was of."""
    n = keys(spark, folder).count()
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n
