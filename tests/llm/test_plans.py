"""Mixing, sharding, tokens, and the pipeline."""

import functools
import hashlib
import heapq
import math
import re

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm import bpe, entry, jaccard, mixing, pii, sharding, topk

from .conftest import DOCS, HARD


def queue(rows, weights, default, budget):
    """Documents of a mixture, by its definition."""
    total, out, by = 0, [], {}
    for d, t, _, s, _ in rows:
        if d is not None and weights.get(s, default) > 0:
            by.setdefault(s, []).append((hashlib.md5(f"{d}{mixing.SEED}".encode()).hexdigest(), d, len(re.findall(mixing.TOKEN, t or ""))))
    for s, own in by.items():
        sum_ = 0
        for k, d, n in sorted(own):
            sum_ += n
            total += n
            out.append((sum_ / weights.get(s, default), k, d, n))
    got, sum_ = [], 0
    for f, _, d, n in sorted(out):
        sum_ += n
        if sum_ > (budget if budget is not None else int(total * mixing.BUDGET_SHARE)):
            break
        got.append((d, n, round(f, 6), sum_))
    return got


@pytest.mark.parametrize("budget", [None, 0, 11, 10**9])
def test_mixture_is_the_queue(table_of, budget):
    rows = [*HARD, *[(100 + k, "w " * (k % 7), "en", f"s{k % 4}", 0) for k in range(60)]]
    weights = {"s0": 3.0, "s2": 0.5, "s3": 0.0}
    got = [(r.doc_id, r.tokens, round(r.finish, 6), r.cumulative) for r in mixing.mixture(table_of(rows), weights, 1.0, budget=budget).collect()]
    assert got == queue(rows, weights, 1.0, budget)


@given(
    st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.sampled_from(["s0", "s1", "s2", None])), min_size=1, max_size=25),
    st.integers(0, 30),
)
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
def test_mixed_documents_are_the_mixtures_rows(table_of, rows, budget):
    """With repeated doc_ids, a source of weight 0 and one of weight 0.001: the same rows as the mixture, within budget."""
    weights = {"s0": 3.0, "s1": 0.0, "s2": 0.001}
    df = table_of([(d, "w " * n, "en", s, 2 * n) for d, n, s in rows])
    want = sorted(((r.doc_id, r.source, r.tokens) for r in mixing.mixture(df, weights, 1.0, budget=budget).collect()), key=str)
    got = sorted(((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed_documents(df, weights, 1.0, budget=budget, task_rows=4).collect()), key=str)
    assert got == want and sum(g[2] for g in got) <= budget and all(g[1] != "s1" for g in got)


def test_ranges_are_even_whatever_the_weights(spark):
    rows = [(k, "a b c", "en", "s0" if k % 100 else "s1", 5) for k in range(4000)]
    ranged, taken = mixing._taken(spark.createDataFrame(rows, DOCS), {"s1": 0.0001}, 1.0, 0.8, None, "x", 500)
    sizes = [r["count"] for r in ranged.groupBy("range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000 and taken.count() == 3200


def test_mixture_of_documents_keeps_columns_and_targets(table_of, spark, docs):
    df = table_of(HARD)
    assert mixing.mixed_documents(df).columns == df.columns and mixing.mixture(spark.createDataFrame([], DOCS)).isEmpty()
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = {tuple(r) for r in c.sql(f"SELECT doc_id, source, tokens, round(finish, 6), cumulative FROM ({mixing.sql()})").fetchall()}
    assert {(r.doc_id, r.source, r.tokens, round(r.finish, 6), r.cumulative) for r in mixing.mixture(docs).collect()} == want


def lpt(sizes, shards):
    heap, out = [(0, k) for k in range(shards)], {}
    for size, key in sorted(((s, k) for k, s in sizes.items()), key=lambda x: (-x[0], x[1])):
        load, k = heapq.heappop(heap)
        out[key] = k
        heapq.heappush(heap, (load + size, k))
    return out


@pytest.mark.parametrize("ranges", [3, 1000])
def test_shards_are_the_heaps(spark, ranges):
    rng = np.random.default_rng(2)
    sizes = {f"k{k:04}": int(s) for k, s in enumerate([*rng.integers(1, 9, 300), *rng.integers(100, 5000, 20), *[7] * 200])}
    df = spark.createDataFrame([(k, s, "x") for k, s in sizes.items()], "key string, size long, shard string")
    assert {r.key: r.shard for r in sharding.schedule(df, 6, ranges).collect()} == lpt(sizes, 6)


@given(st.lists(st.integers(0, 60), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 200))
@settings(max_examples=200, deadline=None)
def test_filling_by_levels_is_filling_one_by_one(loads, size, count):
    heap = [(x, k) for k, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        x, k = heapq.heappop(heap)
        heapq.heappush(heap, (x + size, k))
    assert list(sharding.fill(np.array(loads), size, count)) == [x for x, _ in sorted(heap, key=lambda h: h[1])]


def test_copies_stay_together(table_of, spark):
    got = sharding.shard_documents(table_of(HARD), 4).collect()
    assert len(got) == len(HARD)
    by = {}
    for r in got:
        by.setdefault(r.group_key, set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values()) and len({r.shard for r in got if r.doc_id in (1, 2)}) == 1
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).isEmpty()


PIECES = ["Hello, world!", "", " ", "  two  spaces ", "tabs\tand\nlines\r\n", "don't we'll", "naïve café 日本語 🙂👩‍👩‍👧", "a b c", "<|endoftext|>", "x" * 3000, "1234 5,6", "…—“q”", "\u0000﻿"]


@functools.cache
def library():
    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return t


def reference(text):
    return library().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", PIECES)
def test_tokens_are_the_library_s(text):
    import pyarrow as pa

    c = bpe.codec(bpe.TOKENIZER)
    bounds, ids = c.encode(pa.array(["before it", text, None], pa.large_string()).fill_null(""))
    assert ids[bounds[1] : bounds[2]].tolist() == reference(text)
    assert c.decode(bounds, ids).to_pylist() == ["before it", text, ""]
    starts = c.starts(bounds, ids, c.raw(ids))[bounds[1] : bounds[2]]
    raw, at = text.encode(), 0
    for i, s in zip(ids[bounds[1] : bounds[2]], starts, strict=True):
        assert s == len(raw[:at].decode(errors="ignore"))
        at += len(c.bytes[i])


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text_comes_back(texts):
    import pyarrow as pa

    c = bpe.codec(bpe.TOKENIZER)
    bounds, ids = c.encode(pa.array(texts, pa.large_string()))
    assert c.decode(bounds, ids).to_pylist() == texts
    assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [reference(t) for t in texts]


def test_other_pre_tokenisers_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec("/opt/tokenizers/word_bpe_49k.json")


def test_tokens_of_hard_rows(table_of, spark):
    df = table_of(HARD)
    got = bpe.encode(df)
    rows = got.collect()
    assert len(rows) == len(HARD) and all(r.round_trip == 1 and r.n_tokens == len(r.token_ids) == len(r.token_starts) for r in rows)
    back = {r.doc_id: r.text for r in bpe.decode(got).collect()}
    assert back[8] == HARD[-1][1] and back[1] == "" and bpe.encode(spark.createDataFrame([], DOCS)).isEmpty()
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")).first().text == ""
    assert bpe.decode(spark.createDataFrame([(1, [[i for i, b in enumerate(bpe.codec(bpe.TOKENIZER).bytes) if b == b"\xff"][0]])], "doc_id long, token_ids array<int>")).first().text == "�"


def test_sql_of_top_k(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    c = duckdb.connect()
    p = df.inputFiles()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet({[x.removeprefix('file://') for x in p]})")
    want = {(a, r, b, round(s, 6)) for a, r, b, s in c.execute(topk.sql()).fetchall()}
    assert {(r.vec_id, r.rank, r.neighbour_id, round(r.score, 6)) for r in topk.top_k(df, queries=F.col('vec_id') % topk.EVERY == 0).collect()} == want


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    toxic = {r.doc_id for r in entry.op2_toxicity_ordinal(spark, d).where("toxic = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in toxic]
    # groups by brute force
    from .test_jaccard import brute

    first = {d for d, c, _, _ in brute([(r.doc_id, r.text) for r in rows]) if c == d}
    rows = [(r.doc_id, pii.masked(r.text), r.lang, r.source, 0) for r in rows if r.doc_id in first]
    want = [x[0] for x in queue(rows, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, None)]
    text = {r[0]: r[1] for r in rows}
    got = cp.run(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    back = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame([(r.doc_id, r.token_ids) for r in got], "doc_id long, token_ids array<int>")).collect()}
    assert back == {k: text[k] for k in want}


def test_pipeline_stages_take_hard_rows(spark, table_of, tmp_path):
    import corpus_pipeline as cp

    table_of(HARD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert set(docs_columns()) <= set(out.columns)
            out.write.parquet(str(tmp_path / f"s{k}"))
            df = spark.read.parquet(str(tmp_path / f"s{k}"))
    assert out.where("doc_id = 4").isEmpty() and math.isfinite(out.count())
    assert jaccard.keep_one(df.limit(0)).isEmpty()


def docs_columns():
    return [c.split()[0] for c in DOCS.split(", ")]
