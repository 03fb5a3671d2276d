"""Exact top-k by dot product with the threshold algorithm over sorted per-dimension lists.

Vectors are cut into blocks. Each block keeps, for every dimension, its rows sorted by that coordinate. A query walks
the lists at once from the end that its own coordinate's sign prefers (sorted access, the depth doubling), scores each
new row in full (random access), and bounds every unseen row by the sum over dimensions of its coordinate times the
last value seen. Lists that together can move scores by less than ``IDLE`` of all aren't read: their first value stands in
the bound, and rows that only they would bring first aren't scored for nothing. It stops once the bound is below its
k-th best, or when no row is unseen (one list read to its end brings all). New rows are scored
together in single precision; those that may be among the best are scored again, each by itself, in double precision.

Every row stands in a block; queries are the rows that ``queries`` says, all without it; a query's own vec_id is no
result of it. The grid of blocks and batches of queries is the plan: a row travels once for each batch, a query once for each block.

Scores are rounded to nine digits and equal ones ordered by vec_id. Defined cases: rows with a null vec_id or vector,
or a null or non-finite coordinate, are neither queries nor results; zero vectors score 0 with all; equal vectors tie; rows
that repeat a vec_id count as one (the first by coordinates); fewer than k others give all; vectors of
another length than the most common (the shorter on a tie) are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import materialise, tidied
from weftgraph.session import ship

K = 10
#: Rows and queries of one task at most, about; with few rows, blocks are as many as cores, of ``LEAST_ROWS`` at least.
BLOCK_ROWS = 65_536
QUERY_ROWS = 65_536
LEAST_ROWS = 4_096
#: Every so manieth row is a query of the registered query.
EVERY = 20
#: The share of the spread of scores whose lists, the least first, aren't read.
IDLE = 0.05
#: Depth of the first sorted access; each further one doubles it.
START = 32
DIGITS = 9


class Lists:
    """A block's vectors and its sorted list of every dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order], float)
        self.single = self.x.astype(np.float32)
        self.longest = float(np.sqrt((self.x * self.x).sum(1).max())) if len(ids) else 0.0
        self.order = np.ascontiguousarray(np.argsort(self.x, 0, kind="stable").T)
        self.spread, self.top, self.bottom = (f(self.x, 0) for f in (np.std, np.max, np.min)) if len(ids) else (np.zeros(self.x.shape[1]),) * 3

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Rounded dot products, each row summed by itself, so equal rows tie exactly."""
        return np.round((self.x[rows] * q).sum(1), DIGITS)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Row numbers and scores of the best k for ``q``, how deep its lists were read, and how many rows were scored."""
        n = len(self.ids)
        live = np.flatnonzero(q)
        weight = np.abs(q[live]) * self.spread[live]
        by = np.argsort(weight)
        few = int((np.cumsum(weight[by]) < IDLE * weight.sum()).sum())
        idle, live = live[by[:few]], live[by[few:]]
        fixed = float(np.maximum(q[idle] * self.top[idle], q[idle] * self.bottom[idle]).sum())
        high, low = live[q[live] > 0], live[q[live] < 0]
        single, slack = q.astype(np.float32), 1e-5 * (1 + self.longest * float(np.sqrt((q * q).sum())))
        seen, done = np.zeros(n, bool), np.zeros(n, bool)
        mine = np.searchsorted(self.ids, own)
        left = n
        if mine < n and self.ids[mine] == own:
            seen[mine] = done[mine] = True
            left -= 1
        if not len(live):  # all score alike
            seen[:] = True
        rows, score = np.zeros(0, np.int64), np.zeros(0)
        depth, scored = 0, 0
        while depth < n and left:
            to = min(n, max(START, 2 * depth))
            seen[self.order[high, n - to : n - depth]] = True
            seen[self.order[low, depth:to]] = True
            depth = to
            new = np.flatnonzero(seen > done)
            done[new] = True
            left -= len(new)
            scored += len(new)
            rough = self.single[new] @ single
            least = score[-1] if len(score) == k else np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -math.inf
            new = new[rough >= least - slack]
            rows, score = self._best(np.append(rows, new), np.append(score, self.scores(new, q)), k)
            bound = fixed + float((q[high] * self.x[self.order[high, n - to], high]).sum() + (q[low] * self.x[self.order[low, to - 1], low]).sum())
            if len(score) == k and bound + 2e-9 < score[-1]:
                break
        return rows, score, depth, scored

    def _best(self, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): one row an id, vectors of the commonest length whose coordinates are all finite, as doubles or, if they are such, floats."""
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    ok = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    length = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return ok.where(F.size("v") == (length.n if length else 0)).groupBy("id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, k: int = K, queries: Column | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, rank, neighbour_id, score): the k largest dot products of every vector, or those that ``queries`` (over ``vec_id``) says, with others."""
    spark = ship(vectors.sparkSession)
    rows = materialise(usable(vectors).withColumnRenamed("id", "vec_id"))
    asked = rows if queries is None else rows.where(queries)
    n, m = rows.count(), asked.count()
    nb = max(math.ceil(n / block_rows), min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS)), 1)
    nq = max(math.ceil(m / query_rows), 1)
    left = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select((F.pmod(F.xxhash64("vec_id"), F.lit(nb)) * nq + F.col("batch")).cast("int").alias("at"), F.lit(False).alias("asks"), "vec_id", "v")
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select((F.col("block") * nq + F.pmod(F.xxhash64("vec_id"), F.lit(nq))).cast("int").alias("at"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        asks, ids = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in ("asks", "vec_id"))
        x = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False) for b in got]).reshape(len(ids), -1)
        del got
        if asks.all() or not asks.any():
            return
        lists, mine = Lists(ids[~asks], x[~asks]), np.flatnonzero(asks)
        for i in range(0, len(mine), 1000):
            out = [(at, *lists.search(x[at].astype(float), ids[at], k)[:2]) for at in mine[i : i + 1000]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[[o[0] for o in out]], [len(o[1]) for o in out])), pa.array(lists.ids[np.concatenate([o[1] for o in out])]), pa.array(np.concatenate([o[2] for o in out]))], names=["vec_id", "neighbour_id", "score"])

    found = left.unionAll(right).repartitionById(nb * nq, "at").mapInArrow(tidied(run), "vec_id long, neighbour_id long, score double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "score")


def sql(k: int = K, every: int = EVERY) -> str:
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.e, b.e), {DIGITS}) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM s)
SELECT vec_id, rank, neighbour_id, score FROM r WHERE rank <= {k}"""
