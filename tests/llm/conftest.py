import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def table_of(spark):
    """Documents from (doc_id, text) pairs, or longer tuples, with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        rows = [(*r, "en", "s0", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            for name in ("key", "size", "comp", "comps", "grams", "finish", "tokens", "weight", "_id", "__id", "shard", "kind", "start", "token_ids", "toxic", "bucket", "rank", "block", "batch"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


#: Nulls in every column, empty and repeated rows, ties, a very long text.
HARD = [
    (None, "alpha beta gamma delta", "en", "s0", 22),
    (1, None, None, None, None),
    (2, "", "", "", 0),
    (3, "alpha beta gamma delta", "en", "s0", 22),
    (3, "alpha beta gamma delta", "en", "s0", 22),
    (4, "alpha beta gamma delta", "en", None, 22),
    (5, "word " * 60_000, "de", "s1", 300_000),
    (6, "x" * 400_000, "fr", "s1", 400_000),
    (7, " \n\t ", "en", "s1", 4),
    (8, "é 日本 🙂 ümlaut   ﻿", "fr", "s0", 17),
]
