import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import jaccard
from weftgraph.llm.common import strip_word

from .conftest import DOCS, HARD


def grams(text, n=jaccard.N):
    words = [w for w in (strip_word(x) for x in (text or "").split()) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({(*words, None)} if words else set())


def brute(rows, n=jaccard.N, t=jaccard.THRESHOLD):
    """(doc_id, class_id, links, best_jaccard) of each row."""
    sets = [grams(r[1], n) if r[0] is not None and r[1] is not None else set() for r in rows]
    links, best, root = [0] * len(rows), [None] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for k in range(i + 1, len(sets)):
            if x and sets[k] and (j := len(x & sets[k]) / len(x | sets[k])) >= t:
                for m in (i, k):
                    links[m] += 1
                    best[m] = max(best[m] or 0, j)
                root[find(k)] = find(i)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return sorted(((r[0], low.get(find(k)), links[k], best[k] and round(best[k], 9)) for k, r in enumerate(rows)), key=str)


def got(df, **how):
    return sorted(((r.doc_id, r.class_id, r.links, r.best_jaccard and round(r.best_jaccard, 9)) for r in jaccard.linked(df, **how).collect()), key=str)


def sample(seed=5, n=90):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 8, 40, 150]))]
        if k % 5 == 0:
            words = words[: rng.randrange(60)] + passage
        if rows and k % 3 == 0:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, max(1, len(words) // 6) + 1)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((k, " ".join(words)))
    return rows


def test_every_link_of_a_mixed_corpus(table_of):
    rows = sample()
    want = brute(rows)
    assert sum(r[2] for r in want) > 100 and got(table_of(rows)) == want


def test_any_boundary_and_any_blocks_and_hot_lists_give_the_same(table_of, monkeypatch):
    rows = sample(8, 60)
    want = brute(rows)
    df = table_of(rows)
    assert got(df, block_grams=50, range_grams=100, hot=2) == want
    for light in (0, 10**9):
        monkeypatch.setattr(jaccard, "boundary", lambda prefix, light=light: light)
        assert got(df, hot=3 if light else jaccard.HOT) == want
    assert got(df, threshold=0.8) == brute(rows, t=0.8)


def test_copies_count_and_are_not_compared(table_of, monkeypatch):
    a, b = "a b c d e f g h i j", "a b c d e f g h i k"
    rows = [*[(k, a) for k in range(30, 60)], *[(k, b.upper() + " ,") for k in range(5)], (70, "z y x w")]
    seen = []
    monkeypatch.setattr(jaccard.stars, "verified", lambda blocks, *rest, real=jaccard.stars.verified: seen.append(blocks.count()) or real(blocks, *rest))
    assert got(table_of(rows)) == brute(rows) and seen == [2]
    assert {r[1:3] for r in brute(rows)} == {(0, 34), (70, 0)}


def test_hard_rows(table_of, spark):
    df = table_of(HARD)
    assert got(df) == brute([r[:2] for r in HARD])
    assert [r for r in got(df) if r[2]] == [(3, 3, 2, 1.0), (3, 3, 2, 1.0), (4, 3, 2, 1.0)]
    assert jaccard.linked(spark.createDataFrame([], DOCS)).isEmpty()
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in HARD if r[0] != 4)


def test_rows_of_one_doc_id_are_documents_of_their_own(table_of):
    rows = [(1, "a b c d e f g h"), (1, "s t u v w x y z"), (2, "s t u v w x y z"), (1, "a b c d e f g h"), (0, "a b c d e f g i"), (3, "s t u v w x y k")]
    df = table_of(rows)
    assert got(df) == brute(rows)
    # 1 is the first of the class of its second text, so its rows stay
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == [0, 1, 1, 1]


def test_keep_one_of_each_group(table_of):
    text = "a b c d e f g h i j k l m n o p".split()
    rows = [(k, " ".join([*text[:k], f"z{k}", *text[k:]])) for k in range(6)] + [(50, "entirely different words here now")]
    assert sorted(r.doc_id for r in jaccard.keep_one(table_of(rows)).collect()) == [0, 50]


def test_real_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows)


def test_both_kinds_of_sets_occur(spark, monkeypatch):
    """On the tables of sf0.1 the boundary leaves light and heavy sets, and light ones make subsets."""
    kept = []
    monkeypatch.setattr(jaccard, "candidates", lambda prefix, *rest, real=jaccard.candidates: kept.append((b := jaccard.boundary(prefix), prefix.where(f"size <= {b} and two = 1 and size(grams) > 1").count(), prefix.where(f"size > {b}").count())) or real(prefix, *rest))
    jaccard.linked(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    (light_to, light, heavy), *_ = kept
    assert light_to > 0 and light > 0 and heavy > 0, kept


@given(st.lists(st.sets(st.integers(0, 12)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_needed_overlap_bounds_the_prefix(sets):
    import numpy as np

    for x in sets:
        for y in sets:
            if x and y and len(x & y) / len(x | y) >= 0.5:
                assert len(x & y) >= max(int(jaccard.needed(np.array([len(s)]), 0.5)[0]) for s in (x, y))
