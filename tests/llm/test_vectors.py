"""Exact top-k and near-duplicate embeddings against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import lattice, stars, topk
from weftgraph.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, key string, id long, v string, block string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 7, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = set()
    for q in range(len(ids)):
        s = np.round((x * x[q]).sum(1), 9)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out |= {(int(ids[q]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)}
    return out


def found(df, **how):
    return {(r.vec_id, r.rank, r.neighbour_id, r.score) for r in topk.top_k(df, **how).collect()}


def test_top_k_equals_brute_force_over_blocks_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(130, 6)))]
    rows += [(200 + k, rows[k][1]) for k in range(20)] + [(300, np.zeros(6)), (301, np.zeros(6))]
    want = brute(rows, 4)
    assert found(frame(spark, rows), k=4) == want == found(frame(spark, rows), k=4, block_rows=40, query_rows=50)


def test_top_k_of_hard_rows(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [0, 1]), (None, [1, 1]), (3, None), (4, [1, None]), (5, [float("nan"), 1]), (6, [1, 2, 3]), (7, []), (8, [float("inf"), 1])]
    assert found(frame(spark, rows), k=3) == {(1, 1, 2, 0.0), (2, 1, 1, 0.0)}
    assert found(frame(spark, rows).limit(0)) == set()


def test_stated_queries_against_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = list(enumerate(rng.normal(size=(90, 5))))
    want = {r for r in brute(rows, 3) if r[0] % 20 == 0}
    df = frame(spark, rows)
    assert found(df, k=3, queries=F.col("vec_id") % 20 == 0) == want == found(df, k=3, queries=F.col("vec_id") % 20 == 0, block_rows=20, query_rows=2)
    assert found(df, k=3, queries=F.col("vec_id") < 0) == set()


def test_lists_stop_before_their_ends():
    rng = np.random.default_rng(4)
    base = np.zeros((5000, 4))
    base[:, 0] = rng.random(5000) * 0.01
    base[7] = [9, 0, 0, 0]
    lists = topk.Lists(np.arange(5000), base)
    rows, score, depth, scored = lists.search(np.array([1.0, 0, 0, 0]), -1, 1)
    assert rows[0] == 7 and score[0] == 9 and depth < 100 and scored < 100


def test_share_of_rows_scored(capsys):
    """The bound closes early where few dimensions carry the vectors; on vectors without structure all rows are seen before it can."""
    rng = np.random.default_rng(6)
    share = {}
    for name, decay in (("few dimensions", 0.5), ("without structure", 1.0)):
        x = rng.normal(size=(4000, 64)) * decay ** np.arange(64)
        lists = topk.Lists(np.arange(4000), x)
        got = [lists.search(x[k], k, 10) for k in range(0, 4000, 40)]
        for (rows, score, *_), k in zip(got, range(0, 4000, 40), strict=True):
            s = np.round((x * x[k]).sum(1), topk.DIGITS)
            s[k] = -np.inf
            assert list(rows) == list(np.lexsort((np.arange(4000), -s))[:10]) and (score == s[rows]).all()
        share[name] = np.mean([g[3] for g in got]) / 4000
    with capsys.disabled():
        print(f"\nshare of rows scored by the threshold algorithm: {share}")
    assert share["few dimensions"] < 0.2 < 0.9 < share["without structure"]


def test_lattice_points_are_nearest():
    near = lattice.roots()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(1), 2) and len({tuple(r) for r in near}) == 240
    y = np.random.default_rng(1).normal(size=(500, 8)) * 3
    c = lattice.nearest_e8(y)
    whole = np.isclose(c, np.rint(c)).all(1)
    half = np.isclose(c - 0.5, np.rint(c - 0.5)).all(1)
    assert (whole | half).all() and (np.rint(c.sum(1)) % 2 == 0).all()
    own = ((y - c) ** 2).sum(1)
    assert all((own <= ((y - c - r) ** 2).sum(1) + 1e-9).all() for r in near)


@given(st.lists(st.floats(-9, 9), min_size=8, max_size=8))
@settings(max_examples=100, deadline=None)
def test_shifting_by_a_lattice_vector_shifts_the_point(v):
    y, r = np.array([v]), lattice.roots()[0]
    d = ((y - lattice.nearest_e8(y)) ** 2).sum()
    e = ((y + r - lattice.nearest_e8(y + r)) ** 2).sum()
    assert np.isclose(d, e)


def links_of(rows, t):
    """vec_id -> (class_id, links, best_cosine) by brute force, of (id, unit vector)."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x = x / np.sqrt((x**2).sum(1))[:, None]
    cos = x @ x.T
    np.fill_diagonal(cos, -1)
    label = np.arange(len(ids))
    a, b = np.nonzero(cos >= t)
    label = stars.merge(label, a, b)
    low = {}
    for i, at in zip(ids, label, strict=True):
        low[at] = min(low.get(at, i), i)
    return {int(i): (int(low[at]), int(n), float(m) if n else None) for i, at, n, m in zip(ids, label, (cos >= t).sum(1), cos.max(1), strict=True)}


def linked(df, **how):
    return {r.vec_id: (r.class_id, r.links, r.best_cosine) for r in lattice.linked(df, **how).collect()}


def agrees(got, want, exact=False):
    assert got.keys() == want.keys()
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(g[1] for g in got.values()) >= (1 if exact else 0.9) * sum(w[1] for w in want.values()) > 0
    assert all(abs(got[k][2] - want[k][2]) < 1e-9 for k in want if got[k][1] == want[k][1] > 0)
    if exact:
        assert {k: g[:2] for k, g in got.items()} == {k: w[:2] for k, w in want.items()}


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_links_recall_and_exact_cosines(spark, threshold):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 32))
    near = x[:400] + rng.normal(size=(400, 32)) * rng.uniform(0.02, 0.9, size=(400, 1))
    every = list(enumerate(np.vstack([x, near]).astype(np.float32).astype(float)))
    agrees(linked(frame(spark, every), threshold=threshold), links_of(every, threshold))


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_links_recall_at_the_scale_of_millions(spark, monkeypatch, threshold):
    scale = lattice.scale_for(3_000_000)
    monkeypatch.setattr(lattice, "scale_for", lambda n: scale)
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(2, 500, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y /= np.sqrt((y * y).sum(1))[:, None]
    cos = rng.uniform(threshold, threshold + 0.005, (500, 1))
    every = list(enumerate(np.vstack([x, cos * x + np.sqrt(1 - cos**2) * y]).astype(np.float32).astype(float)))
    agrees(linked(frame(spark, every), threshold=threshold), links_of(every, threshold))


def test_crowds_blocks_and_copies_count_every_link_once(spark):
    """A crowd of near copies in one cell, cells beyond ``hot``, stars cut into blocks, equal vectors: the same links."""
    rng = np.random.default_rng(12)
    crowd = np.ones(16) + rng.normal(size=(150, 16)) * 0.25
    every = np.vstack([crowd, crowd[:40], crowd[:40], rng.normal(size=(60, 16))])
    rows = list(enumerate(every.astype(np.float32).astype(float)))
    want = links_of(rows, 0.9)
    assert sum(w[1] for w in want.values()) > 10_000
    for how in ({"block_members": 20}, {"hot": 30, "block_members": 20}):
        agrees(linked(frame(spark, rows), count=6, probes=24, **how), want, exact=True)


def test_tables_follow_the_scale():
    counts = [lattice.tables_for(lattice.scale_for(n), 64, lattice.THRESHOLD, lattice.PROBES) for n in (2_000, 3_000_000, 100_000_000)]
    assert counts[0] == lattice.TABLES and counts == sorted(counts) and counts[2] > counts[1] > lattice.TABLES
    assert lattice.signs_apart(0.5) > lattice.signs_apart(0.9) > 20


def test_links_of_the_given_table(spark):
    """The given vectors have no pair at 0.9; at 0.4 some have."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    agrees(linked(df, threshold=0.4, count=12, probes=64), links_of(rows, 0.4))


def test_links_of_hard_rows(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [2, 0]), (3, [0, 0]), (None, [1, 0]), (4, None), (5, [None, 1]), (6, [1, 0, 0]), (7, [1, 0])]
    got = linked(frame(spark, rows))
    assert got == {1: (1, 2, 1.0), 2: (1, 2, 1.0), 7: (1, 2, 1.0), **{k: (k, 0, None) for k in (3, 4, 5, 6)}}
    assert lattice.linked(frame(spark, rows).limit(0)).isEmpty()


def test_components_of_a_hub_and_a_chain(spark):
    links = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (2000, 1999)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(300)}, **{k: 1000 for k in range(1000, 1041)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "src long, dst long")).isEmpty()
