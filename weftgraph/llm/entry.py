"""The operators as queries over their whole tables, with production parameters, and DuckDB's SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, jaccard, langid, lattice, markov, mixing, pii, sharding, topk, toxicity
from weftgraph.llm.common import table


def op1_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.label(docs, langid.train(docs))


def op2_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % topk.EVERY == 0)


def op4_mix_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_near_embeddings_e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.linked(table(spark, sf_dir, "embeddings"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op7_shards_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_secrets_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return markov.scan(docs, markov.train(docs))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op10_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_langid_crf,
        op2_toxicity_ordinal,
        op3_topk_threshold,
        op4_mix_fair_queue,
        op5_near_embeddings_e8,
        op6_bpe_round_trip,
        op7_shards_lpt,
        op8_secrets_markov,
        op9_ngram_jaccard_join,
        op10_pii_anchors,
        pipeline,
    ]
    return {f.__name__: f for f in found}


WORDS = r"list_filter([regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') FOR w IN regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+')], lambda w: w <> '')"

JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL THEN {WORDS} ELSE [] END AS ws FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) >= {jaccard.N} THEN [array_to_string(ws[i:i+{jaccard.N - 1}], ' ') FOR i IN range(1, len(ws) - {jaccard.N - 2})]
                                 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || chr(10)] ELSE [] END) AS gs FROM w),
p AS MATERIALIZED (SELECT r, len(gs) AS n, unnest(gs) AS gram FROM g),
c AS (SELECT a.r AS ra, b.r AS rb, a.n AS na, b.n AS nb, count(*) AS common_grams
      FROM p a JOIN p b ON a.gram = b.gram AND a.r <> b.r GROUP BY ALL),
e AS MATERIALIZED (SELECT ra, rb, CAST(common_grams AS DOUBLE) / (na + nb - common_grams) AS jaccard FROM c WHERE common_grams >= {jaccard.THRESHOLD} * (na + nb - common_grams)),
reach AS (SELECT r, doc_id AS c FROM g UNION SELECT e.rb, reach.c FROM reach JOIN e ON e.ra = reach.r),
low AS (SELECT r, min(c) AS class_id FROM reach GROUP BY r),
sums AS (SELECT ra, count(*) AS links, max(jaccard) AS best FROM e GROUP BY ra)
SELECT g.doc_id, low.class_id, coalesce(sums.links, 0) AS links, sums.best AS best_jaccard
FROM g JOIN low USING (r) LEFT JOIN sums ON sums.ra = g.r"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_threshold": topk.sql(), "op4_mix_fair_queue": mixing.sql(), "op7_shards_lpt": sharding.sql(), "op9_ngram_jaccard_join": JACCARD_SQL}
