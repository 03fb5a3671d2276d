"""Mixing sources to target weights by weighted fair queueing.

Within a source, documents are put in the order of ``md5(doc_id || seed)``. A document's virtual finish time is its
source's cumulative tokens, its own included, divided by the source's target weight. All documents are then sorted by
(finish time, shuffle key, doc_id), and the prefix whose tokens stay within the budget is the mixture.

A token is a run of characters other than space, tab, line feed, form feed and carriage return.

Cumulative sums take two levels, so no source, however hot, is one task's work: sums by (source, leading digits of the
shuffle key) give each such bucket its offset, and only a bucket's own rows are summed in order. The global prefix is
found in the same way over ranges of the global order, which hold about as many rows each whatever the weights. Texts don't
travel in either step. Digits and ranges follow the number of rows and change the layout alone.

Defined cases: a null source is a source of its own, of default weight; a source of weight 0 or less has no place in
the mixture; a null or empty text has 0 tokens and takes its place at its source's time; rows with a null doc_id
are left out, having no place in the shuffled order; rows that repeat a doc_id all count and are ordered by
their tokens, then the hash of their text; a very long text counts whole; an empty table gives no rows; columns other than
doc_id, source and text are ignored (``mixed_documents`` keeps them, and returns exactly the rows in the mixture; of rows
with equal doc_id, source and text of which the budget takes some, it returns as many).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import fresh, materialise, small

SEED = "weft-mix-1"
#: Rows in one bucket of a source, or one range of the global order, about.
TASK_ROWS = 200_000
#: Production targets; sources not named here weigh ``DEFAULT_WEIGHT``.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 2.0, "src4": 2.0}
DEFAULT_WEIGHT = 1.0
#: The mixture's tokens as a share of all tokens.
BUDGET_SHARE = 0.8
TOKEN = r"[^ \t\n\f\r]+"


def _queue(docs: DataFrame, weights: dict[str, float], default: float, seed: str, task_rows: int) -> DataFrame:
    """(doc_id, source, shuffle_key, tokens, hash, finish)."""
    weight = F.lit(default)
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    rows = (
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("tokens"), F.xxhash64("text").alias("hash"))
        .withColumn("weight", weight)
        .where("weight > 0")
        .withColumn("shuffle_key", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(seed)).cast("binary")))
    )
    rows = materialise(rows)
    digits = max(1, math.ceil(math.log(max(1, rows.count() / task_rows), 16)))
    rows = rows.withColumn("bucket", F.substring("shuffle_key", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("source", "bucket").orderBy("shuffle_key", "doc_id", "tokens", "hash").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("own", F.sum("tokens").over(within))
        .join(small(offsets, 160), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .select("doc_id", "source", "shuffle_key", "tokens", "hash", ((F.col("offset") + F.col("own")) / F.col("weight")).alias("finish"))
    )


ORDER = ["finish", "shuffle_key", "doc_id", "tokens", "hash"]


def _taken(docs: DataFrame, weights: dict[str, float] | None, default: float, budget_share: float, budget: int | None, seed: str, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """The whole queue by ranges of its order, and the rows of it within the budget, with ``cumulative`` tokens."""
    queue = _queue(docs, WEIGHTS if weights is None else weights, default, seed, task_rows)
    parts = max(1, math.ceil(queue.count() / task_rows))
    ranged = materialise(queue.repartitionByRange(parts, *ORDER).withColumn("range", F.spark_partition_id()))
    total = ranged.agg(F.sum("tokens")).first()[0] or 0
    most = int(total * budget_share) if budget is None else budget
    sums = ranged.groupBy("range").agg(F.sum("tokens").alias("sum")).select("range", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")).where(F.col("before") <= most)
    within = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.select(F.col("range").alias("_r"), "before")
    taken = ranged.join(small(materialise(offsets), 32), F.col("range") == F.col("_r")).withColumn("cumulative", F.col("before") + F.sum("tokens").over(within)).where(F.col("cumulative") <= most)
    return ranged, taken


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, budget: int | None = None, seed: str = SEED, task_rows: int = TASK_ROWS) -> DataFrame:
    """The chosen documents in mixed order: doc_id, source, tokens, finish and the mixture's tokens up to each.

    ``budget`` is the number of tokens to take; without it, ``budget_share`` of all tokens (rounded down).
    """
    return _taken(docs, weights, default, budget_share, budget, seed, task_rows)[1].orderBy(*ORDER).select("doc_id", "source", "tokens", "finish", "cumulative")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, budget: int | None = None, seed: str = SEED, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of ``docs`` in the mixture, with all their columns, range-sorted by finish time."""
    key = {c: fresh(docs, f"__{c}") for c in ("doc_id", "source", "hash")}
    at, taken, there, place = (fresh(docs, f"__{c}") for c in ("finish", "taken", "there", "place"))
    queue, chosen = _taken(docs, weights, default, budget_share, budget, seed, task_rows)
    chosen = materialise(chosen.groupBy(*[F.col(c).alias(k) for c, k in key.items()]).agg(F.min("finish").alias(at), F.count("*").alias(taken)))
    # a row's like stand together in their source's queue, so the budget parts those of one key a source at most
    often = queue.groupBy(*[F.col(c).alias(k) for c, k in key.items()]).agg(F.count("*").alias(there)).where(F.col(there) > 1)
    often = often.select(*[F.col(k).alias(f"{k}_") for k in key.values()], there)
    same = (F.col(key["doc_id"]) == F.col(f"{key['doc_id']}_")) & F.col(key["source"]).eqNullSafe(F.col(f"{key['source']}_")) & (F.col(key["hash"]) == F.col(f"{key['hash']}_"))
    chosen = materialise(chosen.join(often, same, "left").select(*key.values(), at, taken, F.coalesce(there, F.lit(1)).alias(there)))
    mine = (F.col("doc_id").cast("long") == F.col(key["doc_id"])) & F.col("source").cast("string").eqNullSafe(F.col(key["source"])) & (F.xxhash64("text") == F.col(key["hash"]))
    whole = docs.join(small(chosen.where(F.col(taken) >= F.col(there)), 96), mine).select(*docs.columns, at, key["hash"])
    parted = chosen.where(F.col(taken) < F.col(there))
    if not parted.isEmpty():
        some = docs.join(small(parted, 96), mine).withColumn(place, F.row_number().over(Window.partitionBy(*key.values()).orderBy(at))).where(F.col(place) <= F.col(taken))
        whole = whole.unionAll(some.select(*docs.columns, at, key["hash"]))
    return whole.orderBy(at, "doc_id", key["hash"]).select(*docs.columns)


def sql(weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, seed: str = SEED) -> str:
    """DuckDB's form of ``mixture`` over ``documents``."""
    case = " ".join(f"WHEN source = '{k}' THEN {float(v)}" for k, v in sorted((WEIGHTS if weights is None else weights).items()))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS BIGINT) AS tokens,
             CAST(CASE {case} ELSE {default} END AS DOUBLE) AS weight, md5(CAST(doc_id AS VARCHAR) || '{seed}') AS k
           FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS DOUBLE) / weight AS finish FROM d WHERE weight > 0),
c AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY finish, k, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM q)
SELECT doc_id, source, tokens, finish, cumulative FROM c
WHERE cumulative <= (SELECT CAST(floor(sum(tokens) * CAST({budget_share} AS DOUBLE)) AS BIGINT) FROM q)"""
