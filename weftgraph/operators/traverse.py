"""Neighbourhoods, impact, shortest paths: frontier joins, level by level.

A step joins the frontier with the edges, drops what has been visited, and is written to the shared folder, so lineage
doesn't grow with depth and lost executors cost one step at most. The planner knows each step's true size, so a small
frontier is broadcast and a large one shuffled. Walks of no fixed depth scan the edges for their first few hops and
then write them once, narrow and distinct; those of a few hops scan the columns that they need at each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.measure import degrees_of
from weftgraph.session import cut

CAP_DEPTH = 10
#: Of a walk of no fixed depth, so many hops, from so many nodes at most, scan the edges before these are written once.
SCANS, SCANNED = 4, 100_000


def oriented(edges: DataFrame, direction: str = "forward") -> DataFrame:
    """(source, target, relation, confidence) to be walked forward, in reverse, or both ways."""
    ahead = edges.select("source", "target", "relation", "confidence")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "confidence")
    if direction not in ("forward", "reverse", "both"):
        raise ValueError(f"no such direction: {direction}")
    return ahead if direction == "forward" else back if direction == "reverse" else ahead.unionAll(back)


def impact(edges: DataFrame, start: DataFrame, direction: str = "forward", depth: int = 3, relation: str | None = None, inferred: bool = True) -> DataFrame:
    """(id, depth, relations): every node within ``depth`` hops of ``start(id)``, at its shallowest, with the relations that reach it there."""
    depth = max(0, min(depth, CAP_DEPTH))
    walk = oriented(edges, direction)
    if relation:
        walk = walk.where(F.lower("relation") == relation.lower())
    if not inferred:
        walk = walk.where(F.coalesce("confidence", F.lit("EXTRACTED")) == "EXTRACTED")
    walk = walk.select("source", "target", "relation")
    frontier = start.select("id").distinct()
    visited = frontier
    found = start.select("id", F.lit(0).alias("depth"), F.lit("").alias("relations")).where(F.lit(False))
    for d in range(1, depth + 1):
        step = walk.join(frontier, F.col("source") == F.col("id"), "left_semi").join(visited, F.col("target") == F.col("id"), "left_anti")
        level = cut(step.groupBy(F.col("target").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations")).select("id", F.lit(d).alias("depth"), "relations"))
        found, frontier = found.unionAll(level), level.select("id")
        visited = visited.unionAll(frontier)
    return found


def levels(edges: DataFrame, start: DataFrame, depth: int | None = None, direction: str = "forward", target: str | None = None) -> list[DataFrame]:
    """Of each hop from ``start(id)`` on, (id, hops, parent): what it reaches first, with the least node that reaches it.

    The walk ends where it reaches nothing new, after ``depth`` hops, or at ``target``.
    """
    walk, held = oriented(edges, direction).select("source", "target"), False
    out = [cut(start.select("id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")).distinct())]
    seen = out[0].select("id")
    hit = F.coalesce(F.max(F.col("id") == target) if target is not None else F.lit(False), F.lit(False))
    while depth is None or len(out) <= depth:
        if not held and (len(out) > SCANS or out[-1].limit(SCANNED + 1).count() > SCANNED):
            walk, held = cut(walk.distinct()), True
        step = walk.join(out[-1].select(F.col("id").alias("source")), "source", "left_semi").join(seen.select(F.col("id").alias("target")), "target", "left_anti")
        level = cut(step.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent")).select("id", F.lit(len(out)).alias("hops"), "parent"))
        new, there = level.agg(F.count("*"), hit).first()
        if not new:
            break
        out.append(level)
        if there:
            break
        seen = seen.unionAll(level.select("id"))
        if len(out) % 8 == 0:  # plans stay small on long walks
            seen = cut(seen)
    return out


def shortest_paths(edges: DataFrame, start: DataFrame, depth: int | None = None, direction: str = "forward") -> DataFrame:
    """(id, hops, parent): a shortest path from ``start(id)`` to each node it reaches, as its last node but one."""
    return reduce(DataFrame.unionAll, levels(edges, start, depth, direction))


def shortest_path(edges: DataFrame, source: str, target: str, direction: str = "forward") -> list[str] | None:
    """The ids on a shortest path, however long, the least parent among equals; None where there is none."""
    start = edges.sparkSession.createDataFrame([(source,)], "id string")
    path = [target]
    if source == target:
        return path
    found = levels(edges, start, None, direction, target)
    if found[-1].where(F.col("id") == target).isEmpty():
        return None
    for level in reversed(found[1:]):  # a row a hop
        path.append(level.where(F.col("id") == path[-1]).first().parent)
    return path[::-1]


def path_edges(edges: DataFrame, path: list[str]) -> DataFrame:
    """Every parallel edge of each hop of a path."""
    spark = edges.sparkSession
    hops = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(path, path[1:], strict=False))], "hop int, source string, target string")
    return edges.join(hops, ["source", "target"]).select("hop", "source", "target", "relation", "confidence").orderBy("hop", "relation")


def neighbours(edges: DataFrame, start: DataFrame, relation: str | None = None, direction: str = "forward") -> DataFrame:
    """(id, neighbour, relation, confidence), a row each parallel edge."""
    walk = oriented(edges, direction)
    if relation:
        walk = walk.where(F.lower("relation") == relation.lower())
    return walk.join(start.select("id"), F.col("source") == F.col("id")).select("id", F.col("target").alias("neighbour"), "relation", "confidence")


def top_neighbours(edges: DataFrame, degree: DataFrame, most: int = 5) -> DataFrame:
    """Of each node, its ``most`` successors of highest degree."""
    pairs = edges.select("source", "target").distinct().join(degree.select(F.col("id").alias("target"), "degree"), "target")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("degree"), "target"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select("source", "target", "degree", "rank")


def find_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label or id holds ``text``, the best first: exact, then the shortest label, then the least id."""
    low = text.lower()
    hit = F.lower("label").contains(low) | F.lower("id").contains(low)
    return nodes.where(hit).orderBy(F.desc(F.lower("label") == low), F.length("label"), "id")


def score_nodes(nodes: DataFrame, question: str) -> DataFrame:
    """(id, label, score): words of the question in the label, and 100 for a label that is one of them or all."""
    words = [w for w in question.lower().split() if w]
    label = F.lower(F.coalesce("label", F.lit("")))
    score = sum([F.when(label.contains(w), 1).otherwise(0) for w in words], F.lit(0))
    exact = F.when(label.isin(*words, question.lower()) if words else F.lit(False), 100).otherwise(0)
    return nodes.select("id", "label", (score + exact).alias("score")).where("score > 0")


def fan_out(walk: DataFrame, level: DataFrame, most: int) -> DataFrame:
    """``top_neighbours`` of the nodes of ``level(id)`` alone: degrees are counted of what these point at, no others."""
    near = walk.join(level.select(F.col("id").alias("source")), "source", "left_semi").distinct()
    degree = degrees_of(near.select(F.col("target").alias("id")), walk).withColumnRenamed("id", "target")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("degree"), "target"))
    return near.join(degree, "target").withColumn("rank", rank).where(F.col("rank") <= most).select("source", "target", "degree", "rank")


def ask(nodes: DataFrame, edges: DataFrame, question: str, hops: int = 2, fan: int = 5, budget: int = 2000) -> DataFrame:
    """Rows around the node that matches a question best, by depth, within the budget (four characters a token)."""
    level = cut(score_nodes(nodes, question).orderBy(F.desc("score"), F.desc("id")).limit(1).select("id", F.lit(0).alias("depth")))
    walk = cut(edges.select("source", "target"))
    found = level
    for d in range(1, hops + 1):
        level = cut(fan_out(walk, level, fan).select(F.col("target").alias("id")).distinct().join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        found = found.unionAll(level)
    rows = found.join(nodes.select("id", "label", "sf_type"), "id")
    return within_budget(rows, F.length(F.concat_ws(" ", "id", "label", "sf_type")), ["depth", "id"], budget * 4)


def ask_deep(nodes: DataFrame, edges: DataFrame, question: str, hops: int = 2, fan: int = 5, budget: int = 2000) -> DataFrame:
    """As ``ask``, in depth-first order: each node where the walk that takes successors of highest degree first meets it."""
    level = cut(score_nodes(nodes, question).orderBy(F.desc("score"), F.desc("id")).limit(1).select("id", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("visit")))
    walk = cut(edges.select("source", "target"))
    found = level
    for d in range(1, hops + 1):
        level = cut(fan_out(walk, level.select("id").distinct(), fan).join(level.select(F.col("id").alias("source"), "visit"), "source").select(F.col("target").alias("id"), F.lit(d).alias("depth"), F.concat("visit", F.array("rank")).alias("visit")))
        found = found.unionAll(level)
    met = found.groupBy("id").agg(F.min_by("depth", "visit").alias("depth"), F.min("visit").alias("visit"))
    rows = met.join(nodes.select("id", "label", "sf_type"), "id")
    return within_budget(rows, F.length(F.concat_ws(" ", "id", "label", "sf_type")), ["visit", "id"], budget * 4)


def within_budget(rows: DataFrame, cost, order: list, budget: int) -> DataFrame:
    """Rows in order while what came before stays under the budget. Sums run over ranges of the order first (see ``running``)."""
    return running(rows.withColumn("cost", cost.cast("bigint")), "cost", order).where(F.col("before") < budget).drop("before")


def running(rows: DataFrame, value: str, order: list) -> DataFrame:
    """``before``: the sum of ``value`` over the rows ahead in a total order, by range partitions and their totals."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ahead = ranged.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    # ahead has a row a partition, in one small window
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_own", own).join(F.broadcast(ahead), "_part").withColumn("before", F.col("_ahead") + F.col("_own")).drop("_part", "_own", "_ahead")  # ahead: a row a partition


def diff(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(change, kind, a, b, relation): nodes and edges that came or went."""
    def node(df: DataFrame, other: DataFrame, change: str) -> DataFrame:
        return df.select("id").distinct().join(other.select("id"), "id", "left_anti").select(F.lit(change).alias("change"), F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("relation"))

    def edge(df: DataFrame, other: DataFrame, change: str) -> DataFrame:
        keys = ["source", "target", "relation"]
        return df.select(*keys).distinct().join(other.select(*keys), keys, "left_anti").select(F.lit(change).alias("change"), F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "relation")

    return node(new[0], old[0], "added").unionAll(node(old[0], new[0], "removed")).unionAll(edge(new[1], old[1], "added")).unionAll(edge(old[1], new[1], "removed"))
