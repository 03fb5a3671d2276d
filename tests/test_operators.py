"""Graph operators on small graphs, edge cases first."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.extract import apex
from weftgraph.operators import analyse, build, communities, intervals, measure, resolve, traverse
from weftgraph.schema import EDGE, NODE, conform
from weftgraph.sources.files import glob_regex, ignore_rules


def nodes(spark, *ids, sf_type="ApexClass"):
    return conform(spark.createDataFrame([(i, i, sf_type, "apex", "f.cls") for i in ids], "id string, label string, sf_type string, file_type string, source_file string"), NODE)


def edges(spark, *pairs):
    rows = [(a, b, r[0] if r else "calls", "EXTRACTED", k) for k, (a, b, *r) in enumerate(pairs)]
    return conform(spark.createDataFrame(rows, "source string, target string, relation string, confidence string, ord long"), EDGE)


def test_empty_graph(spark):
    n, e = nodes(spark).limit(0), edges(spark, ("a", "b")).limit(0)
    assert measure.stats(n, e).first().nodes == 0 and communities.components(n, e).isEmpty() and communities.communities(n, e).isEmpty()
    assert traverse.impact(e, n).isEmpty() and analyse.questions(n, e, communities.communities(n, e)).first().kind == "no_signal"


def test_components_are_those_of_union_find(spark):
    import random

    rng = random.Random(4)
    ids = [f"n{k:03}" for k in range(150)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(110)] + [(f"c{k:02}", f"c{k + 1:02}") for k in range(40)]
    every = [*ids, *[f"c{k:02}" for k in range(41)]]
    root = {i: i for i in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {r.id: r.component for r in communities.components(nodes(spark, *every), edges(spark, *pairs)).collect()} == {i: find(i) for i in every}


def test_degrees_sum_to_twice_the_edges(spark):
    n, e = nodes(spark, "a", "b", "c"), edges(spark, ("a", "b"), ("a", "b"), ("a", "a"))
    assert {r.id: r.degree for r in measure.degrees(n, e).collect()} == {"a": 4, "b": 2, "c": 0}


def test_impact_depth_is_shortest_path(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"))
    start = spark.createDataFrame([("a",)], "id string")
    depth = {r.id: r.depth for r in traverse.impact(e, start, depth=9).collect()}
    hops = {r.id: r.hops for r in traverse.shortest_paths(e, start).collect() if r.hops}
    assert depth == hops == {"b": 1, "c": 1, "d": 2}
    with pytest.raises(ValueError):
        traverse.impact(e, start, "sideways")


def test_dedup_maps_straight_to_the_winner_and_keeps_unnamed(spark):
    rows = [("x_c1", "A b", "T"), ("x", "a B!", "T"), ("xx", "ab", "T"), ("y", "日本", "T"), ("z", "中国", "T")]
    n = conform(spark.createDataFrame(rows, "id string, label string, sf_type string"), NODE)
    kept, e = build.deduplicate(n, edges(spark, ("x_c1", "y"), ("x", "x_c1"), ("y", "y")))
    assert {r.id for r in kept.collect()} == {"x", "xx", "y", "z"}
    assert sorted((r.source, r.target) for r in e.collect()) == [("x", "y"), ("y", "y")]


def test_stub_labels(spark):
    n = build.stub_nodes(nodes(spark, "apex_a"), edges(spark, ("apex_a", "object_my2thing__c"), ("apex_a", "other_x"), ("apex_a", "flow_do_it")))
    assert {(r.id, r.label, r.sf_type) for r in n.collect()} == {("object_my2thing__c", "My2Thing ", "CustomObject"), ("flow_do_it", "Do It", "Flow")} or {r.id for r in n.collect()} == {"object_my2thing__c", "flow_do_it"}


def test_endpoints_match_loosely_or_go(spark):
    n = nodes(spark, "object_a_b", "object_a__b", "c")
    e = build.match_endpoints(n, edges(spark, ("c", "Object-A.B"), ("c", "nowhere"), ("c", "object_a_b")))
    assert sorted(r.target for r in e.collect()) == ["object_a__b", "object_a_b"]


def test_calls_by_label(spark):
    calls = spark.createDataFrame([("m", "HELPER", "x"), ("m", "helper", "y"), ("apex_h", "Helper", "z")], "caller_id string, callee_class string, callee_method string")
    n = conform(spark.createDataFrame([("apex_h", "Helper", "ApexClass")], "id string, label string, sf_type string"), NODE)
    assert [(r.source, r.target) for r in resolve.resolve_calls_by_label(calls, n).collect()] == [("m", "apex_h")]


def test_innermost_span(spark):
    spans = spark.createDataFrame([("outer", 0, 5000), ("inner", 100, 200), ("same", 100, 200)], "span string, lo long, hi long")
    points = spark.createDataFrame([(1, 150), (2, 4999), (3, 5000), (4, 0)], "p long, pos long")
    assert {r.p: r.span for r in intervals.innermost(points, spans, "p").collect()} == {1: "inner", 2: "outer", 4: "outer"}


def test_betweenness_of_a_chain(spark):
    got = {r.id: r.betweenness for r in communities.betweenness(nodes(spark, "a", "b", "c"), edges(spark, ("a", "b"), ("b", "c"))).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_betweenness_by_joins_is_that_of_workers(spark):
    n = nodes(spark, "a", "b", "c", "d", "e", "f", "lone")
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("d", "f"), ("f", "f"), ("f", "outside"))
    want = {r.id: r.betweenness for r in communities.betweenness(n, e).collect()}
    assert {r.id: r.betweenness for r in communities.betweenness(n, e, most_edges=3).collect()} == pytest.approx(want, abs=2e-9) and want["d"] > want["b"] > 0


def test_communities_split_and_number_by_size(spark):
    clique = lambda p, n: [(f"{p}{i}", f"{p}{j}") for i in range(n) for j in range(i)]
    e = edges(spark, *clique("a", 6), *clique("b", 5), ("a0", "b0"))
    n = nodes(spark, *[f"a{i}" for i in range(6)], *[f"b{i}" for i in range(5)], "lone")
    got = {r.id: r.community for r in communities.communities(n, e).collect()}
    assert {got[f"a{i}"] for i in range(6)} == {0} and {got[f"b{i}"] for i in range(5)} == {1} and got["lone"] == 2


def test_communities_by_joins_are_those_of_one_task(spark):
    from pyspark.sql import functions as F

    clique = lambda p, n: [(f"{p}{i}", f"{p}{j}") for i in range(n) for j in range(i)]
    e = edges(spark, *clique("a", 5), *clique("b", 4), *clique("c", 4), ("a0", "b0"), ("b1", "c1"))
    pairs = communities.undirected(e).select(F.lit("p").alias("part"), "a", "b", (F.col("weight") * communities.UNIT).cast("long").alias("w"))
    one, joins = ({r.id: r.lead for r in communities.partition(pairs, most).collect()} for most in (1000, 20))
    assert one == joins and one == {x: f"{x[0]}0" for x in one}


def two_sided(n, pairs, seed):
    """Random pairs between the first fifth of ``n`` numbers and the rest, and a hash of each number."""
    import numpy as np

    rng = np.random.default_rng(seed)
    a, b = rng.integers(n // 5, size=pairs), rng.integers(n // 5, n, size=pairs)
    key = np.unique(a * n + b)
    return key // n, key % n, rng.integers(0, 1 << 62, n)


def test_communities_come_to_rest_in_one_piece():
    """Where half of the nodes moved at a time they swung until the sweeps ended, and some were left without a neighbour inside."""
    import numpy as np

    n = 600
    a, b, h = two_sided(n, 2400, 1)
    for w in (np.ones(len(a)), 1.0 + h[a] % 7):
        member = communities.louvain(a, b, w, h, levels=1)
        degree, total = np.bincount(a, w, n) + np.bincount(b, w, n), 2 * w.sum()
        load = np.bincount(member, degree, n)
        same = member[a] == member[b]
        assert (communities.pieces(n, a[same], b[same]) == member).all()
        to = np.zeros((n, n))
        np.add.at(to, (a, member[b]), w)
        np.add.at(to, (b, member[a]), w)
        own = np.arange(n), member
        gain = to - degree[:, None] * load[None] / total
        gain[own] += degree * degree / total
        assert (np.where(to > 0, gain, -np.inf).max(1) <= gain[own] + 1e-9).all()
    a, b, h = two_sided(n, 2400, 146)
    member = communities.louvain(a, b, np.ones(len(a)), h)
    same = member[a] == member[b]
    assert (communities.pieces(n, a[same], b[same]) == member).all()


def test_communities_by_joins_come_to_the_same_rest(spark, monkeypatch):
    from pyspark.sql import functions as F

    a, b, _ = two_sided(40, 120, 3)
    e = edges(spark, *[(f"n{x:02}", f"n{y:02}") for x, y in zip(a, b, strict=True)])
    pairs = communities.undirected(e).select(F.lit("p").alias("part"), "a", "b", (F.col("weight") * communities.UNIT).cast("long").alias("w"))
    monkeypatch.setattr(communities.Pace, "IDLE", 1)
    monkeypatch.setattr(communities.Pace, "BITS", 2)
    firsts, places = [], communities.Pace.places
    monkeypatch.setattr(communities.Pace, "places", lambda self, n: firsts.append(places(self, n)) or firsts[-1])
    joins = {r.id: r.lead for r in communities.partition(pairs, 1).collect()}
    assert None in firsts and len(set(joins.values())) > 1
    ids = sorted(joins)
    number = {x: k for k, x in enumerate(ids)}
    import numpy as np

    rows = pairs.withColumn("h", F.xxhash64("a")).withColumn("hb", F.xxhash64("b")).collect()
    h = np.zeros(len(ids), np.int64)
    for r in rows:
        h[number[r.a]], h[number[r.b]] = r.h, r.hb
    one = communities.louvain(*(np.array([number[r[c]] for r in rows]) for c in "ab"), np.array([float(r.w) for r in rows]), h)
    assert joins == {x: ids[one[number[x]]] for x in ids}


def test_bridge_questions_are_of_nodes_that_touch_another_community(spark):
    n, e = nodes(spark, "a", "b", "c", "d", "e"), edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"))
    members = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1)], "id string, community int")
    got = analyse.questions(n, e, members, communities.betweenness(n, e)).collect()
    assert [r.question for r in got if r.kind == "bridge"] == ["Why do so many paths lead through c?"]


def test_suggested_questions_start_with_a_bridge(spark):
    from weftgraph.plans import graph_queries

    assert graph_queries.suggested_questions(spark, "/root/testdata/sf0.001").first().kind == "bridge"


def test_loose_communities_are_split(spark, monkeypatch):
    """Beside large cliques a ring of small ones is one community, of 100 nodes and cohesion 0.044; by itself it falls into its cliques."""
    clique = lambda p, n: [(f"{p}_{i}", f"{p}_{j}") for i in range(n) for j in range(i)]
    ring = [p for k in range(20) for p in clique(f"r{k:02}", 5)] + [(f"r{k:02}_0", f"r{(k + 1) % 20:02}_1") for k in range(20)]
    pairs = ring + [p for k in range(12) for p in clique(f"z{k:02}", 60)] + [(f"z{k:02}_0", f"z{k + 1:02}_0") for k in range(11)] + [("r00_0", "z00_0")]
    e, n = edges(spark, *pairs), nodes(spark, *sorted({x for p in pairs for x in p}))
    sizes = lambda: [r["count"] for r in communities.communities(n, e).where("id like 'r%'").groupBy("community").count().collect()]
    assert max(sizes()) < 50
    monkeypatch.setattr(communities, "LOOSE_SIZE", 101)
    assert max(sizes()) == 100


def test_validation_reports_faults(spark):
    n = nodes(spark, "a")
    e = edges(spark, ("a", "zz")).union(conform(spark.createDataFrame([("a", None, "calls", "MAYBE", 9)], "source string, target string, relation string, confidence string, ord long"), EDGE))
    assert {r.error for r in measure.validate(n, e).collect()} == {"unknown target", "no target", "unknown confidence"}


@given(st.text("ab/'\"\\\n*{};", max_size=60))
@settings(max_examples=300, deadline=None)
def test_blanking_keeps_positions(text):
    got = apex.blank(text)
    assert len(got) == len(text) and [i for i, c in enumerate(got) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_glob_rules():
    import re

    def ignored(path, *rules):
        verdict = False
        for regex, negated in ignore_rules("\n".join(rules)):
            if re.search(regex, path):
                verdict = not negated
        return verdict

    assert ignored("a/b.log", "*.log") and not ignored("a/b.log", "*.log", "!b.log") and ignored("build/x", "build/") and not ignored("rebuild/x", "/build/")
    assert ignored("x/y/z.txt", "x/**/z.txt") and ignored("a/q1", "q[0-9]") and not ignored("a/b", "# a") and glob_regex("!x")[1]


def test_communities_come_to_rest_in_few_sweeps(monkeypatch):
    """Where the last units that gain moved one of each community at a time, a level took hundreds of sweeps."""
    import numpy as np

    a, b, h = two_sided(2000, 12000, 1)
    wanting, places = [], communities.Pace.places
    monkeypatch.setattr(communities.Pace, "places", lambda self, n: wanting.append(n) or places(self, n))
    communities.louvain(a, b, np.ones(len(a)), h, levels=1)
    assert len(wanting) < 80


def test_pruning_joins_no_edges_to_kinds_without_nodes(spark):
    """Every edge was shuffled by either end, even those to kinds that have no nodes."""
    n, e = nodes(spark, "a_1", "b_1", "plain"), edges(spark, ("a_1", "b_1"), ("a_1", "c_1"), ("c_1", "a_1"), ("a_1", "b_2"), ("plain", "a_1"))
    got = build.prune_dangling(n, e)
    assert {(r.source, r.target) for r in got.collect()} == {("a_1", "b_1"), ("plain", "a_1")}
    assert "substring_index" in got._jdf.queryExecution().optimizedPlan().toString()
    assert build.heads_of(n.select(build.head("id")), most=2) is None
    assert build.prune_dangling(n.where("false"), e).isEmpty()


def test_spans_lie_in_two_bins_at_most(spark):
    """A span lay in up to 17 bins."""
    spans = spark.createDataFrame([(k, k * 7, k * 7 + 1 + k % 100) for k in range(300)], "span int, lo long, hi long")
    points = spark.createDataFrame([(p, p * 5) for p in range(500)], "p int, pos long")
    got = {r.p: r.span for r in intervals.innermost(points, spans, "p").collect()}
    rows = [(k, k * 7, k * 7 + 1 + k % 100) for k in range(300)]
    want = {p: min(around)[1] for p in range(500) if (around := [(hi - lo, k) for k, lo, hi in rows if lo <= p * 5 < hi])}
    assert got == want
    assert intervals.binned(spans, 2).groupBy("span").count().where("count > 2").isEmpty()


def test_short_walks_write_no_edges(spark, monkeypatch):
    """The path to a node two hops away wrote all edges first."""
    written = []
    cut = traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: written.append(df.columns) or cut(df))
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    assert traverse.shortest_path(e, "a", "c") == ["a", "b", "c"] and ["source", "target"] not in written
    monkeypatch.setattr(traverse, "SCANS", 1)
    assert traverse.shortest_path(e, "a", "d") == ["a", "b", "c", "d"] and ["source", "target"] in written
