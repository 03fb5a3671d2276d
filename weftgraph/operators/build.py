"""From extracted fragments to a graph: stubs, endpoint matching, dedup, collisions, unions, merges, derived edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import norm_label, normalise_id, title_words
from weftgraph.schema import PRIORITY

STUB_TYPES = {"object_": "CustomObject", "flow_": "Flow", "apex_": "ApexClass", "trigger_": "ApexTrigger"}


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def normal_nodes(nodes: DataFrame) -> DataFrame:
    """A missing file type is a concept; paths use slashes."""
    return nodes.withColumn("file_type", F.coalesce(F.nullif("file_type", F.lit("")), F.lit("concept"))).withColumn("source_file", F.replace("source_file", F.lit("\\"), F.lit("/")))


def normal_edges(edges: DataFrame) -> DataFrame:
    """``from``/``to`` stand in for missing endpoints; edges without both go."""
    for name, other in (("source", "from"), ("target", "to")):
        if other in edges.columns:
            edges = edges.withColumn(name, F.coalesce(F.col(name), F.col(other)) if name in edges.columns else F.col(other)).drop(other)
    return edges.where("source is not null and target is not null")


def stub_nodes(nodes: DataFrame, edges: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Nodes for endpoints that no file defines, if their prefix tells what they are."""
    types = STUB_TYPES if types is None else types
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    kind = reduce(lambda c, kv: F.when(F.col("id").startswith(kv[0]), kv[1]).otherwise(c), sorted(types.items(), key=lambda kv: len(kv[0])), F.lit(None).cast("string"))
    body = F.regexp_replace("id", "^[^_]*_", "")
    label = F.regexp_replace(title_words(F.replace(body, F.lit("_"), F.lit(" "))), " C$", "")
    return ends.join(nodes.select("id"), "id", "left_anti").withColumn("sf_type", kind).where("sf_type is not null").select("id", label.alias("label"), "sf_type", F.lit(True).alias("stub"))


def head(x: Column | str) -> Column:
    """What stands before the first ``_``."""
    return F.substring_index(x, "_", 1)


def heads_of(heads: DataFrame, most: int = 200) -> list[str] | None:
    """The values of a column, if there are no more than ``most``."""
    got = [r[0] for r in heads.where(F.col(heads.columns[0]).isNotNull()).distinct().limit(most + 1).collect()]
    return got if len(got) <= most else None


def match_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints by exact id, else by normalised id (the least of those that collide), else the edge goes."""
    exact = nodes.select("id").distinct()
    loose = nodes.groupBy(normalise_id("id").alias("_norm")).agg(F.min("id").alias("_loose"))
    for end in ("source", "target"):
        edges = (
            edges.join(exact.withColumnRenamed("id", "_exact"), F.col(end) == F.col("_exact"), "left")
            .join(loose, normalise_id(end) == F.col("_norm"), "left")
            .withColumn(end, F.coalesce("_exact", "_loose"))
            .drop("_exact", "_loose", "_norm")
        )
    return edges.where("source is not null and target is not null")


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select(F.col("id").alias("_id"))
    # an end that starts as no id does needs no join
    if (heads := heads_of(ids.select(head("_id")))) is not None:
        edges = edges.where(head("source").isin(heads) & head("target").isin(heads))
    return edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids, F.col("target") == F.col("_id"), "left_semi")


def number_parallels(edges: DataFrame) -> DataFrame:
    """``key``: 0, 1, ... among the edges of a pair."""
    return edges.withColumn("key", F.row_number().over(Window.partitionBy("source", "target").orderBy("ord", "relation")) - 1)


def priority(relation: Column | str = "relation") -> Column:
    col = F.col(relation) if isinstance(relation, str) else relation
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), col), F.lit(10))


def simple_graph(edges: DataFrame, directed: bool = True) -> DataFrame:
    """One edge a pair: that of the relation of highest priority, the first among equals."""
    keys = ["source", "target"] if directed else [F.least("source", "target"), F.greatest("source", "target")]
    return keep_first(edges, keys, [F.desc(priority()), "ord", "relation"])


def duplicates(nodes: DataFrame) -> DataFrame:
    """(id, winner): nodes of equal type and normalised label, to the one without chunk suffix, then of shorter, then lesser id. Labels that normalise to nothing are never merged."""
    named = nodes.select("id", "sf_type", norm_label("label").alias("_norm")).where("_norm <> ''")
    # the winner is aggregated and joined back: no label, however common, is one task's window
    best = named.groupBy("sf_type", "_norm").agg(F.min(F.struct(F.col("id").rlike("_c[0-9]+$").alias("chunk"), F.length("id").alias("n"), "id")).alias("best"), F.count("*").alias("many")).where("many > 1")
    return named.join(best, ["sf_type", "_norm"]).select("id", F.col("best.id").alias("winner")).where("id <> winner")


def deduplicate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge duplicates, rewrite edges to the winners, and drop loops this makes."""
    lost = duplicates(nodes)
    kept = nodes.join(lost.select("id"), "id", "left_anti")
    moved = edges
    for end in ("source", "target"):
        other = lost.select(F.col("id").alias(f"_{end}"), F.col("winner").alias(f"_w_{end}"))
        moved = moved.join(other, F.col(end) == F.col(f"_{end}"), "left")
    changed = F.col("_w_source").isNotNull() | F.col("_w_target").isNotNull()
    moved = moved.withColumn("_changed", changed).withColumn("source", F.coalesce("_w_source", "source")).withColumn("target", F.coalesce("_w_target", "target"))
    return kept, moved.where(~(F.col("_changed") & (F.col("source") == F.col("target")))).drop("_source", "_target", "_w_source", "_w_target", "_changed")


def merge_nodes(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of one id become one: for each attribute the last value that isn't null."""
    rest = [c for c in nodes.columns if c not in ("id", order)]
    return nodes.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalise, add stubs, match endpoints, number parallel edges."""
    nodes, edges = normal_nodes(nodes), normal_edges(edges)
    stubs = stub_nodes(nodes, edges)
    every = nodes.unionByName(stubs, allowMissingColumns=True)
    return every, number_parallels(match_endpoints(every, edges))


def edge_identity(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c not in ("key", "source_file", "ord")]


def union_graphs(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes by id, the first graph's winning; edges distinct in all but key, file and order."""
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [n.withColumn("_g", F.lit(k)) for k, (n, _) in enumerate(graphs)])
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [e.withColumn("_g", F.lit(k)) for k, (_, e) in enumerate(graphs)])
    same = [c for c in edge_identity(edges) if c != "_g"]
    tail = [c for c in ("ord", "source_file") if c in edges.columns]
    return keep_first(nodes, ["id"], ["_g"]).drop("_g"), keep_first(edges, same, ["_g", *tail]).drop("_g", "key")


def merge_incremental(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace what changed files gave and drop what deleted ones (``gone(path)``) gave; running it again changes nothing."""
    files = new[0].select("source_file").union(new[1].select("source_file")).union(gone.select("path")).where("source_file is not null").distinct()
    kept = [df.join(files, "source_file", "left_anti") for df in old]
    return union_graphs([(new[0], new[1]), (kept[0], kept[1])])


def derive_object_edges(nodes: DataFrame, edges: DataFrame, field_type: str = "CustomField", object_type: str = "CustomObject") -> DataFrame:
    """From a field of one object that refers to another: object to object, unless there is such an edge or it is the same object."""
    objects = nodes.where(F.col("sf_type") == object_type).select("id")
    fields = nodes.where(F.col("sf_type") == field_type).select("id")
    refs = edges.where(F.col("relation").isin("references", "master_detail")).join(fields, F.col("source") == F.col("id"), "left_semi").join(objects, F.col("target") == F.col("id"), "left_semi")
    owner = edges.where("relation = 'contains'").join(objects, F.col("source") == F.col("id"), "left_semi").join(fields, F.col("target") == F.col("id"), "left_semi").select(F.col("source").alias("owner"), F.col("target").alias("field"))
    pairs = refs.join(owner, F.col("source") == F.col("field")).where("owner <> target").select(F.col("owner").alias("source"), "target", "relation", "confidence", "source_file", "ord")
    return keep_first(pairs.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti"), ["source", "target"], ["ord", "relation", "source_file"])
