"""Graph operators over the graph of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators import analyse, build, communities, measure, resolve, traverse
from weftgraph.session import cut
from weftgraph.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return T.nodes(spark, d), T.edges(spark, d)


N, E, K = f"nodes AS ({T.NODES_SQL})", f"edges AS ({T.EDGES_SQL})", f"edges AS ({T.KEYS_SQL})"
DEG = "deg AS (SELECT n.id, CAST(count(e.id) AS BIGINT) AS degree FROM nodes n LEFT JOIN (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) e ON n.id = e.id GROUP BY n.id)"
#: The nation of each customer, supplier and nation is its community.
MEM = "mem AS (SELECT 'customer_' || c_custkey AS id, c_nationkey AS community FROM customer UNION ALL SELECT 'supplier_' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'nation_' || n_nationkey, n_nationkey FROM nation)"


def by_nation(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "customer").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    s = T.read(spark, d, "supplier").select(F.concat(F.lit("supplier_"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    n = T.read(spark, d, "nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("community"))
    return c.unionAll(s).unionAll(n)


@query(f"WITH {N} SELECT * FROM nodes")
def graph_nodes(spark, d):
    return T.nodes(spark, d)


@query(f"WITH {E} SELECT * FROM edges")
def graph_edges(spark, d):
    return T.edges(spark, d)


@query(f"WITH {N}, {E}, {DEG} SELECT * FROM deg")
def degree(spark, d):
    return measure.degrees(*graph(spark, d))


@query(f"WITH {N}, {E}, {DEG} SELECT n.id, label, sf_type, degree FROM nodes n JOIN deg USING (id) ORDER BY degree DESC, id LIMIT 10")
def god_nodes(spark, d):
    return analyse.hubs(*graph(spark, d))


@query(f"WITH {N} SELECT sf_type, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY 1")
def type_distribution(spark, d):
    return measure.distribution(T.nodes(spark, d), "sf_type")


@query(f"WITH {N} SELECT file_type, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY 1")
def file_type_coverage(spark, d):
    return measure.distribution(T.nodes(spark, d), "file_type")


@query(f"WITH {E} SELECT relation, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY 1")
def relation_distribution(spark, d):
    return measure.distribution(T.edges(spark, d), "relation")


@query(f"WITH {E}, g AS (SELECT confidence, count(*) AS n, round(avg(confidence_score), 2) AS mean_score FROM edges GROUP BY 1) SELECT confidence, CAST(n AS BIGINT) AS n, mean_score, round_even(n * 100.0 / (SELECT sum(n) FROM g), 0)::DOUBLE AS percent FROM g")
def confidence_audit(spark, d):
    return measure.audit(T.edges(spark, d)).withColumn("percent", F.col("percent").cast("double"))


@query(
    f"WITH {N}, {E}, {DEG} SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(CAST(sum(degree) AS DOUBLE) / (count(*) * CAST(count(*) - 1 AS DOUBLE)), 6) AS density, round(CAST(sum(degree) AS DOUBLE) / count(*), 2) AS avg_degree, max(degree) AS max_degree, CAST(count(*) FILTER (degree = 0) AS BIGINT) AS isolated FROM deg"
)
def graph_stats(spark, d):
    return measure.stats(*graph(spark, d))


@query(f"WITH {E} SELECT source AS id, target AS neighbour, relation, confidence FROM edges WHERE source = 'orders_1'")
def neighbors(spark, d):
    return traverse.neighbours(T.edges(spark, d), spark.createDataFrame([("orders_1",)], "id string"))


@query(f"WITH {E} SELECT source AS id, target AS neighbour, relation, confidence FROM edges WHERE source = 'orders_1' AND relation = 'contains'")
def neighbors_by_relation(spark, d):
    return traverse.neighbours(T.edges(spark, d), spark.createDataFrame([("orders_1",)], "id string"), "CONTAINS")


@query(
    f"WITH {N}, {E.replace(' AS (', ' AS MATERIALIZED (', 1)}, near AS MATERIALIZED (SELECT * FROM edges WHERE source = 'customer_1' OR source = 'orders_1'), deg AS MATERIALIZED (SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id IN (SELECT target FROM near) GROUP BY id) SELECT e.target AS id, n.label, n.sf_type, e.relation, e.confidence, degree FROM near e JOIN nodes n ON n.id = e.target JOIN deg ON deg.id = e.target"
)
def explain_node(spark, d):
    nodes, edges = graph(spark, d)
    start = spark.createDataFrame([("customer_1",), ("orders_1",)], "id string")
    near = traverse.neighbours(edges, start).select(F.col("neighbour").alias("id"), "relation", "confidence")
    near = cut(near)
    return near.join(nodes.select("id", "label", "sf_type"), "id").join(measure.degrees_of(near, edges), "id").select("id", "label", "sf_type", "relation", "confidence", "degree")


@query(
    f"WITH {N}, {E}, {DEG}, p AS (SELECT DISTINCT source, target FROM edges), r AS (SELECT source, target, degree, CAST(row_number() OVER (PARTITION BY source ORDER BY degree DESC, target) AS INTEGER) AS rank FROM p JOIN deg ON deg.id = p.target) SELECT * FROM r WHERE rank <= 5"
)
def top_neighbors_per_node(spark, d):
    nodes, edges = graph(spark, d)
    return traverse.top_neighbours(edges, measure.degrees(nodes, edges))


def _impact_sql(walk: str, start: str, depth: int = 3, graph: str = E) -> str:
    steps, seen = [], f"SELECT id FROM l0"
    steps.append(f"l0 AS (SELECT id FROM ({start}))")
    for k in range(1, depth + 1):
        steps.append(f"l{k} AS (SELECT w.target AS id, string_agg(DISTINCT w.relation, ',' ORDER BY w.relation) AS relations FROM walk w WHERE w.source IN (SELECT id FROM l{k - 1}) AND w.target NOT IN ({seen}) GROUP BY 1)")
        seen += f" UNION ALL SELECT id FROM l{k}"
    rows = " UNION ALL ".join(f"SELECT id, {k} AS depth, relations FROM l{k}" for k in range(1, depth + 1))
    return f"WITH {graph}, walk AS ({walk}), {', '.join(steps)} {rows}"


FWD = "SELECT source, target, relation, confidence FROM edges"
REV = "SELECT target AS source, source AS target, relation, confidence FROM edges"
REGION = "SELECT 'region_0' AS id"


@query(_impact_sql(REV, REGION))
def impact_reverse(spark, d):
    return traverse.impact(T.edges(spark, d), spark.createDataFrame([("region_0",)], "id string"), "reverse", 3)


@query(_impact_sql(FWD, "SELECT 'orders_1' AS id UNION ALL SELECT 'supplier_1'"))
def impact_forward(spark, d):
    return traverse.impact(T.edges(spark, d), spark.createDataFrame([("orders_1",), ("supplier_1",)], "id string"), "forward", 3)


@query(_impact_sql(f"{FWD} UNION ALL {REV}", "SELECT 'supplier_1' AS id", 2))
def impact_both(spark, d):
    return traverse.impact(T.edges(spark, d), spark.createDataFrame([("supplier_1",)], "id string"), "both", 2)


@query(_impact_sql(f"SELECT * FROM ({FWD}) WHERE confidence = 'EXTRACTED'", "SELECT 'supplier_1' AS id UNION ALL SELECT 'orders_1'"))
def impact_extracted_only(spark, d):
    return traverse.impact(T.edges(spark, d), spark.createDataFrame([("supplier_1",), ("orders_1",)], "id string"), "forward", 3, inferred=False)


@query(f"WITH i AS ({_impact_sql(REV, REGION)}), {N} SELECT sf_type, depth, CAST(count(*) AS BIGINT) AS n FROM i JOIN nodes USING (id) GROUP BY ALL")
def impact_by_type(spark, d):
    return impact_reverse(spark, d).join(T.nodes(spark, d).select("id", "sf_type"), "id").groupBy("sf_type", "depth").agg(F.count("*").alias("n"))


@query(
    f"WITH i AS ({_impact_sql(FWD, 'SELECT 4 AS x, ' + chr(39) + 'orders_1' + chr(39) + ' AS id', 4)}) SELECT id, depth AS hops FROM i UNION ALL SELECT 'orders_1', 0"
)
def shortest_path_len(spark, d):
    return traverse.shortest_paths(T.edges(spark, d), spark.createDataFrame([("orders_1",)], "id string"), 4).select("id", "hops")


@query(
    "SELECT CAST(0 AS INTEGER) AS hop, 'orders_1' AS source, 'customer_' || o_custkey AS target, 'references' AS relation, 'EXTRACTED' AS confidence FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 1, 'customer_' || c_custkey, 'nation_' || c_nationkey, 'references', 'EXTRACTED' FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey = 1 UNION ALL SELECT 2, 'nation_' || n_nationkey, 'region_' || n_regionkey, 'references', 'EXTRACTED' FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey AND o_orderkey = 1"
)
def shortest_path(spark, d):
    """Every edge of a shortest path from an order to the region its customer is in."""
    region = T.read(spark, d, "orders").where("o_orderkey = 1").join(T.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(T.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()
    edges = T.edges(spark, d)
    return traverse.path_edges(edges, traverse.shortest_path(edges, "orders_1", f"region_{region.n_regionkey if region else None}") or [])


CHAIN_SQL = "SELECT 'event_' || event_id AS source, 'event_' || lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events"


@query(f"WITH c AS ({CHAIN_SQL}), f AS (SELECT event_id, user_id, ts FROM events WHERE user_id = (SELECT min(user_id) FROM events)), r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM f) SELECT CAST(n - 1 AS INTEGER) AS hop, 'event_' || event_id AS id FROM r WHERE n <= 25")
def shortest_path_long(spark, d):
    """From the first user's first event to the 25th: more hops than the limit of other walks."""
    user = T.read(spark, d, "events")
    user = user.join(F.broadcast(user.agg(F.min("user_id").alias("user_id"))), "user_id")  # one row
    ends = [r.event_id for r in user.orderBy("ts", "event_id").select("event_id").limit(25).collect()]
    path = traverse.shortest_path(event_chain(spark, d), f"event_{ends[0]}", f"event_{ends[-1]}") if ends else []
    return spark.createDataFrame(list(enumerate(path)), "hop int, id string")


def event_chain(spark, d):
    """An edge from each event to its user's next one."""
    ahead = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = T.read(spark, d, "events").select(F.concat(F.lit("event_"), "event_id").alias("source"), F.concat(F.lit("event_"), ahead).alias("target"))
    return e.where("target is not null").select("*", F.lit("follows").alias("relation"), F.lit("EXTRACTED").alias("confidence"))


@query(
    f"""WITH {N}, {E}, {DEG}, s AS (SELECT id FROM nodes WHERE contains(lower(label), 'middle') OR contains(lower(label), 'nation_7') ORDER BY contains(lower(label), 'middle')::INT + contains(lower(label), 'nation_7')::INT + CASE WHEN lower(label) IN ('middle', 'nation_7', 'middle nation_7') THEN 100 ELSE 0 END DESC, id DESC LIMIT 1),
p AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY degree DESC, target) AS r FROM (SELECT DISTINCT source, target FROM edges) JOIN deg ON deg.id = target) WHERE r <= 5),
l1 AS (SELECT DISTINCT target AS id FROM p WHERE source IN (SELECT id FROM s) AND target NOT IN (SELECT id FROM s)),
l2 AS (SELECT DISTINCT target AS id FROM p WHERE source IN (SELECT id FROM l1) AND target NOT IN (SELECT id FROM s UNION ALL SELECT id FROM l1)),
a AS (SELECT id, 0 AS depth FROM s UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2)
SELECT id, depth, label, sf_type, CAST(length(id || ' ' || label || ' ' || sf_type) AS BIGINT) AS cost FROM a JOIN nodes USING (id)"""
)
def query_bfs(spark, d):
    return traverse.ask(*graph(spark, d), "middle nation_7")


@query(f"WITH {MEM}, {E}, z AS (SELECT community, CAST(count(*) AS BIGINT) AS size FROM mem GROUP BY 1), i AS (SELECT a.community, count(DISTINCT (least(source, target), greatest(source, target))) AS pairs FROM edges JOIN mem a ON a.id = source JOIN mem b ON b.id = target WHERE a.community = b.community GROUP BY 1) SELECT community, size, CASE WHEN size <= 1 THEN 1.0 ELSE round(coalesce(pairs, 0) / (size * (size - 1) / 2), 2) END::DOUBLE AS cohesion FROM z LEFT JOIN i USING (community)")
def community_cohesion(spark, d):
    return measure.cohesion(T.edges(spark, d), by_nation(spark, d))


REGIONS = "mem AS (SELECT 'customer_' || c_custkey AS id, n_regionkey AS community FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier_' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'nation_' || n_nationkey, n_nationkey FROM nation UNION ALL SELECT 'part_' || p_partkey, p_size FROM part)"


def mixed_members(spark, d):
    nation = T.read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = T.read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer_"), "c_custkey").alias("id"), F.col("n_regionkey").alias("community"))
    s = T.read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier_"), "s_suppkey").alias("id"), F.col("n_regionkey").alias("community"))
    n = nation.select(F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("community"))
    p = T.read(spark, d, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("id"), F.col("p_size").alias("community"))
    return c.unionAll(s).unionAll(n).unionAll(p)


@query(f"WITH {REGIONS}, {E} SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, CAST(count(*) AS BIGINT) AS n FROM edges JOIN mem a ON a.id = source JOIN mem b ON b.id = target WHERE a.community <> b.community GROUP BY 1, 2")
def inter_community_edges(spark, d):
    return measure.community_edges(T.edges(spark, d), mixed_members(spark, d))


@query(f"WITH {N}, {E}, {DEG}, {REGIONS} SELECT community, arg_min(label, (-degree, id)) AS label FROM nodes JOIN deg USING (id) JOIN mem USING (id) GROUP BY 1")
def community_label(spark, d):
    nodes, edges = graph(spark, d)
    return measure.community_labels(nodes, edges, mixed_members(spark, d))


@query(f"WITH {REGIONS} SELECT community, CAST(count(*) AS BIGINT) AS n FROM mem GROUP BY 1")
def community_sizes(spark, d):
    return mixed_members(spark, d).groupBy("community").agg(F.count("*").alias("n"))


@query(
    "WITH n AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), r AS (SELECT *, sum(CASE WHEN before = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n) SELECT 'event_' || event_id AS id, min('event_' || event_id) OVER (PARTITION BY user_id, run) AS component FROM r"
)
def components(spark, d):
    """Events, each linked with its user's next one if it is of the same type: components are runs of a type."""
    events = T.read(spark, d, "events")
    typed = events.select(F.concat(F.lit("event_"), "event_id").alias("id"), "event_type")
    chain = event_chain(spark, d).join(typed.toDF("source", "st"), "source").join(typed.toDF("target", "tt"), "target").where("st = tt")
    return communities.components(typed, chain)


@query("WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_shipdate >= '1998-09-01' UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_shipdate >= '1998-09-01'), n AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part), r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT n.id, coalesce(min(r.c), n.id) AS component FROM n LEFT JOIN r USING (id) GROUP BY n.id")
def components_of_late_supplies(spark, d):
    """Suppliers and parts, linked by what shipped last."""
    e = T.read(spark, d, "lineitem").where("l_shipdate >= '1998-09-01'").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    nodes = T.read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionAll(T.read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    return communities.components(nodes, e)


@query()
def louvain_communities(spark, d):
    return communities.communities(*graph(spark, d))


@query(
    f"WITH {N} SELECT 'nodes' AS fact, CAST(count(*) AS BIGINT) AS n FROM nodes UNION ALL SELECT 'nodes in two', 0 UNION ALL SELECT 'alone without an edge', CAST(count(*) AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'numbers out of order', 0 UNION ALL SELECT 'nodes without a neighbour inside', 0"
)
def louvain_invariants(spark, d):
    """What holds of communities whatever they are: a partition, numbered by size, of nodes that have a neighbour inside or are alone."""
    nodes, edges = graph(spark, d)
    found = cut(communities.communities(nodes, edges))
    sizes = cut(found.groupBy("community").agg(F.count("*").alias("size")))
    inside = edges.where("source <> target").join(found.toDF("source", "s"), "source").join(found.toDF("target", "t"), "target").where("s = t")
    near = inside.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    single = found.join(sizes.where("size = 1"), "community")
    touched = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    fact = lambda name, df: df.agg(F.lit(name).alias("fact"), F.count("*").alias("n"))
    parts = [
        fact("nodes", found),
        fact("nodes in two", found.groupBy("id").count().where("count > 1")),
        fact("alone without an edge", single.join(touched, "id", "left_anti").where("id like 'part%'")),
        fact("numbers out of order", sizes.alias("a").join(sizes.alias("b"), F.col("a.community") + 1 == F.col("b.community")).where("a.size < b.size")),
        fact("nodes without a neighbour inside", found.join(sizes.where("size > 1"), "community").join(near, "id", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


TREE = "n AS (SELECT 'supplier_' || s_suppkey AS id, 0 AS below FROM supplier WHERE s_suppkey < 400 UNION ALL SELECT 'nation_' || n_nationkey, CAST(count(s_suppkey) AS INTEGER) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey < 400 GROUP BY 1 UNION ALL SELECT 'region_' || r_regionkey, 0 FROM region)"


@query(f"WITH {TREE}, t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM n) SELECT id, round(below * 1.0 * (1.0 / ((t.n - 1) * (t.n - 2))), 9)::DOUBLE AS betweenness FROM n, t")
def betweenness_of_tree(spark, d):
    """Suppliers point at nations and these at regions: only nations lie between, once for each supplier."""
    few = T.nodes(spark, d, ("supplier", "nation", "region")).where("not (id like 'supplier%') or cast(substr(id, 10) as int) < 400")
    ids = few.select("id")
    e = T.edges(spark, d).where("relation = 'references'").join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    return communities.betweenness(few, e)


@query()
def betweenness(spark, d):
    return communities.betweenness(*graph(spark, d))


@query(
    "WITH s AS (SELECT s_nationkey AS k, CAST(count(*) AS DOUBLE) AS below FROM supplier WHERE s_suppkey < 400 GROUP BY 1), t AS (SELECT CAST((SELECT count(*) FROM supplier WHERE s_suppkey < 400) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS DOUBLE) AS n) SELECT 'supplier_' || s_suppkey AS source, 'nation_' || s_nationkey AS target, round(2.0 * (1.0 / (n * (n - 1))), 9)::DOUBLE AS betweenness FROM supplier, t WHERE s_suppkey < 400 UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, round((coalesce(below, 0) + 1) * (1.0 / (n * (n - 1))), 9)::DOUBLE FROM nation LEFT JOIN s ON k = n_nationkey, t"
)
def edge_betweenness_of_tree(spark, d):
    """On the same tree: a supplier's edge lies on its paths to nation and region, a nation's on those of all its suppliers and its own."""
    few = T.nodes(spark, d, ("supplier", "nation", "region")).where("not (id like 'supplier%') or cast(substr(id, 10) as int) < 400")
    ids = few.select("id")
    e = T.edges(spark, d).where("relation = 'references'").join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    return communities.edge_betweenness(few, e)


END = "e AS (SELECT ed.source, ed.target, ed.relation, ed.confidence, ed.ord, s.file_type AS sk, t.file_type AS tk, s.source_file AS sf, t.source_file AS tf, sd.degree AS sdeg, td.degree AS tdeg, sm.community AS sc, tm.community AS tc FROM edges ed JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target JOIN deg sd ON sd.id = source JOIN deg td ON td.id = target LEFT JOIN mem sm ON sm.id = source LEFT JOIN mem tm ON tm.id = target WHERE relation NOT IN ('contains', 'method'))"
CAT = "CASE {0} WHEN 'object' THEN 'data' WHEN 'field' THEN 'data' WHEN 'profile' THEN 'security' WHEN 'flow' THEN 'automation' ELSE 'other' END"


@query(
    f"WITH {N}, {E}, {DEG}, {REGIONS}, {END}, x AS (SELECT *, {CAT.format('sk')} <> {CAT.format('tk')} AS kinds, coalesce(sc <> tc, false) AS apart, least(sdeg, tdeg) <= 2 AND greatest(sdeg, tdeg) >= 5 AS reach FROM e WHERE sf <> tf) SELECT source, target, relation, confidence, CAST((CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END) + CASE WHEN kinds THEN 2 ELSE 0 END + apart::INT + reach::INT AS INTEGER) AS score, concat_ws('; ', CASE WHEN confidence <> 'EXTRACTED' THEN lower(confidence) || ' connection' END, CASE WHEN kinds THEN 'crosses kinds' END, CASE WHEN apart THEN 'bridges communities' END, CASE WHEN reach THEN 'periphery reaches hub' END) AS why, ord FROM x"
)
def surprise_score(spark, d):
    nodes, edges = graph(spark, d)
    return analyse.surprises(nodes, edges, mixed_members(spark, d), None)


@query(
    f"WITH {N}, {E}, {DEG}, {REGIONS}, {END}, x AS (SELECT least(sc, tc) AS a, greatest(sc, tc) AS b, source, target, relation, confidence, row_number() OVER (PARTITION BY least(sc, tc), greatest(sc, tc) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, source, target, relation, ord) AS n FROM e WHERE sc <> tc) SELECT a, b, source, target, relation, confidence FROM x WHERE n = 1"
)
def cross_community_pairs(spark, d):
    nodes, edges = graph(spark, d)
    return analyse.bridges(nodes, edges, mixed_members(spark, d), None)


@query(f"WITH {N}, {E}, {DEG} SELECT n.id, label, degree FROM nodes n JOIN deg USING (id) WHERE degree <= 1")
def isolated_nodes(spark, d):
    return analyse.isolated(*graph(spark, d))


@query(f"WITH c AS ({SQL['community_cohesion']}) SELECT * FROM c WHERE cohesion < 0.15 AND size >= 5")
def low_cohesion(spark, d):
    return community_cohesion(spark, d).where("cohesion < 0.15 and size >= 5")


@query()
def suggested_questions(spark, d):
    nodes, edges = graph(spark, d)
    return analyse.questions(nodes, edges, by_nation(spark, d), communities.betweenness(nodes, edges))


@query(f"WITH {E}, f AS (SELECT source, confidence, count(*) AS n, min(ord) AS o FROM edges GROUP BY 1, 2) SELECT source, arg_max(confidence, (n, -o, confidence)) AS confidence FROM f GROUP BY 1")
def dominant_confidence(spark, d):
    return measure.dominant_confidence(T.edges(spark, d))


# --- joins, dedup, set operations


@query(f"WITH {E}, k AS (SELECT id FROM ({T.NODES_SQL}) WHERE id NOT IN (SELECT 'customer_' || c_custkey FROM customer WHERE c_acctbal <= 0)), s AS (SELECT DISTINCT id FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM k)) SELECT id, 'Customer ' || id[10:] AS label, 'Customer' AS sf_type, true AS stub FROM s WHERE starts_with(id, 'customer_')")
def stub_nodes(spark, d):
    """Stubs for the ends of all edges where customers in debt have no node."""
    nodes, edges = graph(spark, d)
    known = nodes.join(T.read(spark, d, "customer").where("c_acctbal <= 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("id")), "id", "left_anti")
    got = build.stub_nodes(known, edges, {"customer_": "Customer"})
    return got.withColumn("label", F.concat(F.lit("Customer "), "label"))


@query(f"WITH {E}, k AS (SELECT id FROM ({T.NODES_SQL}) WHERE sf_type <> 'Part') SELECT source, target, relation, ord FROM edges WHERE EXISTS (SELECT 1 FROM k WHERE k.id = source) AND EXISTS (SELECT 1 FROM k WHERE k.id = target)")
def dangling_prune(spark, d):
    """What is left of all edges where no table gave the parts."""
    return build.prune_dangling(T.nodes(spark, d, ("region", "nation", "customer", "supplier", "orders")), T.edges(spark, d)).select("source", "target", "relation", "ord")


@query("WITH e AS (SELECT 'CUSTOMER-' || o_custkey AS source, CASE WHEN o_orderstatus = 'F' THEN 'orders__' || o_orderkey ELSE 'nowhere' END AS target, o_orderkey AS ord FROM orders) SELECT lower(replace(source, '-', '_')) AS source, replace(target, '__', '_') AS target, ord FROM e WHERE target <> 'nowhere'")
def endpoint_fallback(spark, d):
    edges = T.read(spark, d, "orders").select(F.concat(F.lit("CUSTOMER-"), "o_custkey").alias("source"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("orders__"), "o_orderkey")).otherwise("nowhere").alias("target"), F.col("o_orderkey").alias("ord"))
    return build.match_endpoints(T.nodes(spark, d, ("customer", "orders")), edges)


@query(f"WITH {E} SELECT source, target, relation, CASE WHEN target LIKE 'customer%' AND target NOT IN (SELECT 'customer_' || c_custkey FROM customer WHERE c_acctbal > 0) THEN 'INFERRED' ELSE confidence END AS confidence, confidence_score FROM edges")
def confidence_downgrade(spark, d):
    known = T.nodes(spark, d).join(T.read(spark, d, "customer").where("c_acctbal <= 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("id")), "id", "left_anti")
    return resolve.downgrade(T.edges(spark, d), known).select("source", "target", "relation", "confidence", "confidence_score")


@query(
    "WITH n AS (SELECT 'part_' || p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), ' ') AS norm FROM part), w AS (SELECT id, first_value(id) OVER (PARTITION BY norm ORDER BY length(id), id) AS winner FROM n WHERE norm <> '') SELECT * FROM w WHERE id <> winner"
)
def dedup_by_label(spark, d):
    return build.duplicates(T.nodes(spark, d, ("part",)))


@query(
    f"WITH {E}, w AS (SELECT 'customer_' || c_custkey AS id, first_value('customer_' || c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY length('customer_' || c_custkey), c_custkey) AS winner FROM customer) SELECT coalesce(a.winner, source) AS source, coalesce(b.winner, target) AS target FROM edges LEFT JOIN w a ON a.id = source LEFT JOIN w b ON b.id = target"
)
def dedup_rewrites_edges(spark, d):
    nodes = T.read(spark, d, "customer").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("label"), F.lit("Segment").alias("sf_type"))
    return build.deduplicate(nodes, T.edges(spark, d).select("source", "target"))[1]


@query("SELECT DISTINCT 'orders_' || o_orderkey AS source, 'customer_' || o_custkey AS target, 'references' AS relation FROM orders")
def edge_union_identity(spark, d):
    orders = T.read(spark, d, "orders")
    make = lambda df: df.select(F.concat(F.lit("orders_"), "o_orderkey").alias("source"), F.concat(F.lit("customer_"), "o_custkey").alias("target"), F.lit("references").alias("relation"), F.lit("x").alias("source_file"))
    nodes = T.nodes(spark, d, ("customer",))
    early, late = make(orders.where("o_orderdate < '1997-01-01'")), make(orders.where("o_orderdate >= '1995-01-01' or o_orderdate is null"))
    return build.union_graphs([(nodes, early), (nodes, late)])[1].select("source", "target", "relation")


@query(f"WITH a AS ({T.ACTIVITY_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY CASE relation WHEN 'dml' THEN 75 ELSE 70 END DESC, ord, relation) AS n FROM a) SELECT source, target, relation, ord FROM r WHERE n = 1")
def simple_graph_collision(spark, d):
    return build.simple_graph(T.activity(spark, d)).select("source", "target", "relation", "ord")


@query(f"WITH {E} SELECT source, target, relation, CAST(row_number() OVER (PARTITION BY source, target ORDER BY ord, relation) - 1 AS INTEGER) AS key FROM edges")
def parallel_edge_keys(spark, d):
    return build.number_parallels(T.edges(spark, d)).select("source", "target", "relation", "key")


@query(
    "WITH o AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < '1996-01-01'), n AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= '1996-01-01') SELECT 'added' AS change, 'edge' AS kind, 'supplier_' || l_suppkey AS a, 'part_' || l_partkey AS b, 'supplies' AS relation FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', 'edge', 'supplier_' || l_suppkey, 'part_' || l_partkey, 'supplies' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"
)
def graph_diff(spark, d):
    def slice_(when):
        e = T.read(spark, d, "lineitem").where(when).select(F.concat(F.lit("supplier_"), "l_suppkey").alias("source"), F.concat(F.lit("part_"), "l_partkey").alias("target"), F.lit("supplies").alias("relation"))
        return T.nodes(spark, d, ("part", "supplier")), e

    return traverse.diff(slice_("l_shipdate < '1996-01-01'"), slice_("l_shipdate >= '1996-01-01'"))


@query(
    "WITH f AS (SELECT 'part_' || p_partkey AS id, 'brand_' || lower(replace(p_brand, '#', '')) AS owner, 'type_' || lower(replace(p_type, ' ', '_')) AS target, p_partkey FROM part) SELECT source, target, relation FROM (SELECT owner AS source, target, 'references' AS relation, row_number() OVER (PARTITION BY owner, target ORDER BY p_partkey) AS n FROM f) WHERE n = 1"
)
def derived_object_edges(spark, d):
    part = T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("part_"), "p_partkey").alias("id"), F.concat(F.lit("brand_"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("owner"), F.concat(F.lit("type_"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("kind"))
    objects = part.select(F.explode(F.array("owner", "kind")).alias("id")).distinct().withColumn("sf_type", F.lit("CustomObject"))
    nodes = objects.unionByName(part.select("id", F.lit("CustomField").alias("sf_type")))
    base = [F.lit("EXTRACTED").alias("confidence"), F.lit("part").alias("source_file"), F.col("p_partkey").alias("ord")]
    edges = part.select(F.col("owner").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"), *base).unionByName(part.select(F.col("id").alias("source"), F.col("kind").alias("target"), F.lit("references").alias("relation"), *base))
    return build.derive_object_edges(nodes, edges).select("source", "target", "relation")


@query(
    f"WITH {E}, ids AS ({T.NODES_SQL}) SELECT 'node' AS kind, id AS ref, 'no label' AS error FROM ids WHERE sf_type = 'Order' UNION ALL SELECT 'edge', source || '->' || target, 'unknown target' FROM edges WHERE target LIKE 'nation%' UNION ALL SELECT 'edge', source || '->' || target, 'unknown source' FROM edges WHERE source LIKE 'nation%' UNION ALL SELECT 'edge', source || '->' || target, 'unknown confidence' FROM edges WHERE relation = 'supplies'"
)
def validate_fragment(spark, d):
    """All faults of the graph without its nations, its orders' labels and a proper confidence of what is inferred."""
    nodes, edges = graph(spark, d)
    nodes = nodes.where("sf_type <> 'Nation'").withColumn("label", F.when(F.col("sf_type") != "Order", F.col("label")))
    return measure.validate(nodes, edges.withColumn("confidence", F.when(F.col("relation") == "supplies", "GUESSED").otherwise(F.col("confidence"))))


@query(
    "WITH e AS (SELECT event_id, user_id, ts FROM events), s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s) SELECT user_id, min(ts) AS started, max(ts) AS ended, CAST(count(*) AS BIGINT) AS events FROM g GROUP BY user_id, n"
)
def debounce_sessions(spark, d):
    from weftgraph.streaming.watch import sessions

    return sessions(T.read(spark, d, "events"), "user_id", "ts", "event_id", 30 * 60).select("user_id", "started", "ended", "events")


@query(
    "WITH s AS (SELECT o_orderkey AS span, o_orderkey * 40 AS lo, o_orderkey * 40 + CAST(floor(o_totalprice) AS BIGINT) % 100 + 1 AS hi FROM orders), p AS (SELECT event_id, event_id * 7 AS pos FROM events) SELECT event_id, arg_min(span, (hi - lo, span)) AS span FROM p JOIN s ON pos >= lo AND pos < hi GROUP BY 1"
)
def interval_join(spark, d):
    from weftgraph.operators.intervals import innermost

    spans = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("span"), (F.col("o_orderkey") * 40).alias("lo"), (F.col("o_orderkey") * 40 + F.col("o_totalprice").cast("bigint") % 100 + 1).alias("hi"))
    points = T.read(spark, d, "events").select("event_id", (F.col("event_id") * 7).alias("pos"))
    return innermost(points, spans, "event_id").select("event_id", "span")


@query(f"WITH {N}, {E} SELECT 'MERGE (n:' || sf_type || ' {{id: ''' || id || '''}}) SET n.label = ''' || replace(label, '''', chr(92) || '''') || ''';' AS line FROM nodes UNION ALL SELECT 'MATCH (a {{id: ''' || source || '''}}), (b {{id: ''' || target || '''}}) MERGE (a)-[:' || upper(relation) || ']->(b);' FROM edges")
def cypher_export(spark, d):
    from weftgraph.sinks.lines import cypher

    return cypher(*graph(spark, d))


@query(f"WITH {E} SELECT replace(source, ':', '_') || CASE confidence WHEN 'EXTRACTED' THEN ' -->|' ELSE ' -.->|' END || relation || '| ' || target AS line FROM edges")
def mermaid_export(spark, d):
    from weftgraph.sinks.lines import mermaid_edges

    return mermaid_edges(T.edges(spark, d))
