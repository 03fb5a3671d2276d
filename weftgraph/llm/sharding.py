"""Shards by longest-processing-time scheduling of groups that must stay together.

Documents with the same text are one group, so that no copy is in another shard; its size is its characters, and one
more for each document. Groups, largest first (ties by key), each go to the least-loaded shard (ties to the lowest
number), kept in a heap.

The order is a range partitioning written to the shared folder. The heap's state where each range begins follows from
counts by (range, size) alone: groups of one size fill shards up level by level. So the driver sees one row for each
distinct size of a range, never a group, and every range then runs its own heap from its state, all at once.

Defined cases: a null text is a group with the empty one; a very long text counts whole; a null doc_id is assigned as any other; repeated rows count
and are assigned each; an empty table gives no rows; other columns are ignored; with fewer groups than shards some
shards stay empty.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialise
from weftgraph.session import ship

SHARDS = 64
RANGE_GROUPS = 100_000


def fill(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """Loads after ``count`` groups of one size went each to the least-loaded shard, the lowest number first."""
    if count <= 4 * len(loads):
        heap = [(int(x), k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            x, k = heap[0]
            heapq.heapreplace(heap, (x + size, k))
        out = loads.copy()
        for x, k in heap:
            out[k] = x
        return out
    # the highest level below which no more than count starts lie
    low, high = int(loads.min()), int(loads.max()) + size * (count // len(loads) + 2)
    while low < high:
        mid = (low + high + 1) // 2
        if int(np.maximum(0, -((loads - mid) // size)).sum()) <= count:
            low = mid
        else:
            high = mid - 1
    got = np.maximum(0, -((loads - low) // size))
    at_level = np.flatnonzero((loads + got * size) == low)
    got[at_level[: count - int(got.sum())]] += 1
    return loads + got * size


def assign(sizes: list[int], loads: np.ndarray) -> list[int]:
    heap = [(int(x), k) for k, x in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        x, k = heap[0]
        heapq.heapreplace(heap, (x + size, k))
        out.append(k)
    return out


def schedule(groups: DataFrame, shards: int = SHARDS, range_groups: int = RANGE_GROUPS) -> DataFrame:
    """(key, size, shard) of ``groups(key, size)``, sizes positive integers and keys distinct."""
    spark = ship(groups.sparkSession)
    groups = materialise(groups.select("key", F.col("size").cast("long").alias("size")))
    parts = max(1, math.ceil(groups.count() / range_groups))
    ordered = materialise(groups.repartitionByRange(parts, F.desc("size"), F.asc("key")).withColumn("part", F.spark_partition_id()))
    seen = ordered.groupBy("part", "size").count().collect()
    loads, state = np.zeros(shards, np.int64), {}
    for r in sorted(seen, key=lambda r: (r.part, -r.size)):
        state.setdefault(r.part, loads)
        loads = fill(loads, r.size, r["count"])
    held = spark.sparkContext.broadcast(state)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        pdf["shard"] = np.array(assign(pdf["size"].tolist(), held.value[int(pdf["part"].iloc[0])]), np.int32)
        return pdf[["key", "size", "shard"]]

    return ordered.groupBy("part").applyInPandas(run, "key string, size long, shard int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, range_groups: int = RANGE_GROUPS) -> DataFrame:
    """(doc_id, group_key, group_size, shard) for every document."""
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long").alias("size")))
    placed = schedule(rows.groupBy("key").agg(F.sum("size").alias("size")), shards, range_groups)
    return rows.select("doc_id", F.col("key").alias("group_key")).join(placed.select("key", F.col("size").alias("group_size"), "shard"), F.col("group_key") == F.col("key")).drop("key")


def sql(shards: int = SHARDS) -> str:
    """DuckDB's form of ``shard_documents`` over ``documents``: a group a step, with all loads in a list."""
    least = "list_position(r.loads, list_min(r.loads))"
    return f"""
WITH RECURSIVE g AS (SELECT md5(coalesce(text, '')) AS key, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS size FROM documents GROUP BY 1),
o AS MATERIALIZED (SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS rn FROM g),
r AS (SELECT CAST(0 AS BIGINT) AS rn, '' AS key, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS shard, list_transform(range({shards}), lambda x: CAST(0 AS BIGINT)) AS loads
      UNION ALL SELECT o.rn, o.key, o.size, {least} - 1, list_concat(list_concat(r.loads[:{least} - 1], [list_min(r.loads) + o.size]), r.loads[{least} + 1:]) FROM r JOIN o ON o.rn = r.rn + 1)
SELECT d.doc_id, r.key AS group_key, r.size AS group_size, CAST(r.shard AS INTEGER) AS shard FROM documents d JOIN r ON md5(coalesce(d.text, '')) = r.key AND r.rn > 0"""
