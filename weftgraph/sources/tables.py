"""A property graph over the star schema's tables: every row a node, every key an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = (
    ("region", "r_regionkey", "r_name", "Region", "object"),
    ("nation", "n_nationkey", "n_name", "Nation", "object"),
    ("customer", "c_custkey", "c_name", "Customer", "profile"),
    ("supplier", "s_suppkey", "s_name", "Supplier", "profile"),
    ("part", "p_partkey", "p_name", "Part", "field"),
    ("orders", "o_orderkey", None, "Order", "flow"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, sf_type, file_type, source_file) of the tables named, or of all."""
    out = None
    for name, key, label, sf_type, file_type in KINDS:
        if kinds and name not in kinds:
            continue
        df = read(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}_"), F.col(key).cast("string")).alias("id"),
            (F.col(label) if label else F.concat(F.lit("Order "), F.col(key).cast("string"))).alias("label"),
            F.lit(sf_type).alias("sf_type"),
            F.lit(file_type).alias("file_type"),
            F.lit(f"{name}.parquet").alias("source_file"),
        )
        out = df if out is None else out.unionByName(df)
    return out


def _edge(df: DataFrame, src: str, src_key: str, dst: str, dst_key: str, relation: str, confidence: str, score: float, file: str, ord_: str = "0") -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{src}_"), F.col(src_key).cast("string")).alias("source"),
        F.concat(F.lit(f"{dst}_"), F.col(dst_key).cast("string")).alias("target"),
        F.lit(relation).alias("relation"),
        F.lit(confidence).alias("confidence"),
        F.lit(score).alias("confidence_score"),
        F.lit(1.0).alias("weight"),
        F.lit(f"{file}.parquet").alias("source_file"),
        F.expr(f"cast({ord_} as bigint)").alias("ord"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by key, ``contains`` from an order to the part of each line item (parallel edges), inferred ``supplies``."""
    t = lambda n: read(spark, sf_dir, n)
    out = [
        _edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "references", "EXTRACTED", 1.0, "nation"),
        _edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "references", "EXTRACTED", 1.0, "customer"),
        _edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "references", "EXTRACTED", 1.0, "supplier"),
        _edge(t("orders"), "orders", "o_orderkey", "customer", "o_custkey", "references", "EXTRACTED", 1.0, "orders"),
    ]
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    out.append(_edge(items, "orders", "l_orderkey", "part", "l_partkey", "contains", "EXTRACTED", 1.0, "lineitem", "l_linenumber"))
    pairs = items.select("l_suppkey", "l_partkey").distinct()
    out.append(_edge(pairs, "supplier", "l_suppkey", "part", "l_partkey", "supplies", "INFERRED", 0.75, "lineitem"))
    got = out[0]
    for df in out[1:]:
        got = got.unionByName(df)
    return got


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from users to event types, one an event; purchases and sign-ups write, other events read."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source"),
        F.concat(F.lit("event_type_"), F.col("event_type")).alias("target"),
        F.when(F.col("event_type").isin("purchase", "signup"), "dml").otherwise("queries").alias("relation"),
        F.lit("EXTRACTED").alias("confidence"),
        F.lit("events.parquet").alias("source_file"),
        F.col("event_id").alias("ord"),
    )


NODES_SQL = "\nUNION ALL ".join(
    f"SELECT '{n}_' || {k} AS id, {label if label else f'''{chr(39)}Order {chr(39)} || {k}'''} AS label, '{t}' AS sf_type, '{f}' AS file_type, '{n}.parquet' AS source_file FROM {n}" for n, k, label, t, f in KINDS
)
_E = "SELECT '{s}_' || {sk} AS source, '{d}_' || {dk} AS target, '{r}' AS relation, '{c}' AS confidence, CAST({w} AS DOUBLE) AS confidence_score, CAST(1 AS DOUBLE) AS weight, '{f}.parquet' AS source_file, CAST({o} AS BIGINT) AS ord FROM {t}"
KEYS_SQL = "\nUNION ALL ".join(
    [
        _E.format(s="nation", sk="n_nationkey", d="region", dk="n_regionkey", r="references", c="EXTRACTED", w=1, f="nation", o=0, t="nation"),
        _E.format(s="customer", sk="c_custkey", d="nation", dk="c_nationkey", r="references", c="EXTRACTED", w=1, f="customer", o=0, t="customer"),
        _E.format(s="supplier", sk="s_suppkey", d="nation", dk="s_nationkey", r="references", c="EXTRACTED", w=1, f="supplier", o=0, t="supplier"),
        _E.format(s="orders", sk="o_orderkey", d="customer", dk="o_custkey", r="references", c="EXTRACTED", w=1, f="orders", o=0, t="orders"),
    ]
)
EDGES_SQL = "\nUNION ALL ".join(
    [
        KEYS_SQL,
        _E.format(s="orders", sk="l_orderkey", d="part", dk="l_partkey", r="contains", c="EXTRACTED", w=1, f="lineitem", o="l_linenumber", t="lineitem"),
        _E.format(s="supplier", sk="l_suppkey", d="part", dk="l_partkey", r="supplies", c="INFERRED", w=0.75, f="lineitem", o=0, t="(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"),
    ]
)
ACTIVITY_SQL = "SELECT 'user_' || user_id AS source, 'event_type_' || event_type AS target, CASE WHEN event_type IN ('purchase', 'signup') THEN 'dml' ELSE 'queries' END AS relation, 'EXTRACTED' AS confidence, 'events.parquet' AS source_file, event_id AS ord FROM events"
