"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets, light and heavy sets apart.

A word is a run of non-white-space characters, lower-cased and without outer punctuation; a document's set holds
the distinct n-grams of its words (a shorter document has one gram, all its words). Two documents are linked when
``|A & B| / |A | B| >= t``. Sets are ordered by (number of documents with the gram, hash), rarest first.

1. Inverted index. Grams go, packed, to ``P`` ranges of the hash; each range counts its grams' documents. Grams of
   one document never join anything: only their number is used, as they come first in the order.
2. Documents with one and the same set are copies: one of them stands for all from here on, so copies are never compared.
3. A pair with the needed overlap shares ``l`` grams within the ``|x| - ceil(t|x|) + l`` rarest of both sides.
   *Light* (small) sets enumerate the 2-subsets of that prefix for ``l = 2`` and meet on equal subsets; *heavy*
   (large) sets scan the inverted lists of the prefix for ``l = 1``, against all sets that may be similar to a heavy one
   by their size. The boundary between them is the size at which the subsets and entries that light sets write plus the
   lengths of the lists that heavy sets scan are least, among the sizes at which light sets write no more subsets than
   there are entries in all lists (so what is written stays linear in the grams), from sums by size over the whole table.
4. Sets that meet are linked to the first of their list, which takes as many links as the list is long: every pair to
   be found lies within the star of one such first set. The list of a gram of more than ``HOT`` documents is never
   brought together; its first set is aggregated and joined back.
5. ``stars`` compares every pair within a star exactly, in blocks, and counts links, a row a set and block.

Nothing is sampled or capped. The result has one row a row of the table: its doc_id, ``class_id`` (the lowest doc_id of the
documents that links connect it with, its own without any), ``links`` (the number of other rows that it is linked
with, copies among them) and ``best_jaccard`` (the highest similarity among these, null without any).

Defined cases: a row without words, or with a null text or doc_id, has no links and its own doc_id as its class; rows
that repeat a doc_id are documents of their own, linked like others; identical texts have similarity 1; very long
texts are whole sets as any other; an empty table gives no rows; other columns are ignored. Sets are told apart by
64-bit hashes, as grams are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import stars
from weftgraph.llm.common import arrow_map, discard, fresh, hash_words, list_array, materialise, mix, normal_words, shuffle_cleanup, slices, small, tidied
from weftgraph.session import ship

N = 3
THRESHOLD = 0.5
#: Grams in one range of the inverted index, and in one block of a star, about.
RANGE_GRAMS = 1_000_000
BLOCK_GRAMS = 2_000_000
#: Documents of a gram beyond which its list isn't brought together in one task.
HOT = 100_000


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds by text, and each text's distinct gram hashes in ascending order."""
    bounds, codes, words = normal_words(column)
    length = np.diff(bounds)
    if not len(codes):
        return np.zeros(len(bounds), np.int64), np.zeros(0, np.uint64)
    h = hash_words(words)[codes]
    count = np.where(length >= n, length - n + 1, np.minimum(length, 1))
    doc = np.repeat(np.arange(len(length)), count)
    start = bounds[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    gram = np.zeros(len(doc), np.uint64)
    short = length[doc] < n
    for k in range(n):
        at = start + k
        inside = at < bounds[doc + 1]
        gram = np.where(inside, mix(gram * np.uint64(0x100000001B3) + h[np.where(inside, at, 0)] + np.uint64(k + 1)), gram)
    gram = np.where(short, mix(gram + np.uint64(77)), gram)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[new], gram[new]
    return np.searchsorted(doc, np.arange(len(length) + 1)), gram


def set_hash(bounds: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, the same in any order."""
    upto = np.append(np.uint64(0), np.cumsum(mix(gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51))))
    return mix(upto[bounds[1:]] - upto[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def needed(size: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(np.round(t * size, 9)).astype(np.int64)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _five(h: np.ndarray) -> np.ndarray:
    """The low 40 bits of hashes as bytes."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5]


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _ranges(gram: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash's top 24 bits; the low 40 name it within its range."""
    return ((gram >> np.uint64(40)).astype(np.int64) * ranges) >> 24


def _index_rows(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """Packed grams by range (``bucket >= 0``), and a header by batch (``bucket = -1``) with its doc_ids, set sizes and set hashes."""
    schema = "bucket int, uid long, a binary, b binary, c binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                uid, k = (part << 32) + k, k + 1
                bounds, gram = gram_sets(batch.column("text"), n)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(ids), dtype=np.uint16), np.diff(bounds))
                to = _ranges(gram, ranges)
                order = np.argsort(to, kind="stable")
                to, low, doc = to[order], _five(gram[order]), doc[order]
                cut = np.flatnonzero(np.diff(to, prepend=-1))
                ends = np.append(cut[1:], len(to))[: len(cut)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(to[cut], -1).astype(np.int32)),
                        pa.array(np.full(len(cut) + 1, uid, np.int64)),
                        pa.array([_bytes(doc[i:j]) for i, j in zip(cut, ends, strict=True)] + [_bytes(ids.astype(np.int64))], pa.binary()),
                        pa.array([_bytes(low[i:j]) for i, j in zip(cut, ends, strict=True)] + [_bytes(np.diff(bounds).astype(np.int32))], pa.binary()),
                        pa.array([b""] * len(cut) + [_bytes(set_hash(bounds, gram))], pa.binary()),
                    ],
                    names=["bucket", "uid", "a", "b", "c"],
                )

    return docs.mapInArrow(tidied(run), schema)


def _count_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: document counts of its grams; back to each batch go those of two documents or more."""
    uids, docs, grams, headers = [], [], [], []
    bucket = -1
    for batch in batches:
        for b, uid, a, h, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b < 0:
                headers.append((uid, -1, a, h, c))
                continue
            bucket = b
            docs.append(np.frombuffer(a, np.uint16))
            grams.append(_wide(h))
            uids.append((uid, len(docs[-1])))
    names = ["uid", "bucket", "a", "b", "c"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    if headers:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*headers, strict=True), kinds, strict=True)], names=names)
    if not docs:
        return
    gram, doc = np.concatenate(grams), np.concatenate(docs)
    del grams, docs
    owner = np.repeat(np.arange(len(uids), dtype=np.int32), [k for _, k in uids])
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    df = np.diff(np.append(cut, len(ordered)))
    many = np.zeros(len(gram), np.int32)
    many[order] = np.repeat(df, df)
    keep = np.flatnonzero(many > 1)
    ends = np.searchsorted(owner[keep], np.arange(len(uids) + 1))
    rows = [(uids[k][0], bucket, _bytes(doc[at]), _bytes(_five(gram[at])), _bytes(many[at])) for k in range(len(uids)) if len(at := keep[ends[k] : ends[k + 1]])]
    for i in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 512], strict=True), kinds, strict=True)], names=names)


def _prefixes(batches: Iterator[pa.RecordBatch], t: float, hot: int) -> Iterator[pa.RecordBatch]:
    """One batch of documents after another: a row each, with the shared grams of its prefix, rarest first."""
    held: dict[int, list] = {}
    for batch in batches:
        for uid, bucket, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            held.setdefault(uid, []).append((bucket, a, b, c))
    for uid in list(held):
        rows = held.pop(uid)
        head = next(r for r in rows if r[0] < 0)
        ids, size, node = np.frombuffer(head[1], np.int64), np.frombuffer(head[2], np.int32).astype(np.int64), np.frombuffer(head[3], np.int64)
        rows = [r for r in rows if r[0] >= 0]
        doc = np.concatenate([np.frombuffer(r[1], np.uint16) for r in rows] or [np.zeros(0, np.uint16)]).astype(np.int64)
        low = np.concatenate([_wide(r[2]) for r in rows] or [np.zeros(0, np.uint64)])
        gram = mix(low + np.repeat(np.array([r[0] for r in rows], np.uint64), [len(r[1]) // 2 for r in rows]) * np.uint64(1 << 40))
        df = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows] or [np.zeros(0, np.int32)]).astype(np.int64)
        shared = np.bincount(doc, minlength=len(ids))
        # l = 2 wherever every partner must share two grams; the grams of one document come first in the order
        need = needed(size, t)
        room = size - need + np.where(need > 1, 2, 1) - (size - shared)
        alive = room[doc] > 0
        doc, gram, df = doc[alive], gram[alive], df[alive]
        order = np.lexsort((gram, df, doc))
        doc, gram, df = doc[order], gram[order], df[order]
        keep = np.arange(len(doc)) - np.searchsorted(doc, doc, "left") < room[doc]
        doc, gram, df = doc[keep], gram[keep], df[keep]
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        k = np.diff(bounds)
        # what one more shared gram (l = 1) leaves
        one = np.where(need > 1, np.minimum(k, np.maximum(room - 1, 0)), k)
        scans = np.append(0, np.cumsum(df))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids),
                pa.array(node, mask=k == 0),
                pa.array(size.astype(np.int32)),
                pa.array((need > 1).astype(np.int32)),
                pa.array(one.astype(np.int32)),
                pa.array(np.bincount(doc[df > hot], minlength=len(ids)).astype(np.int32)),
                pa.array(k * (k - 1) / 2.0),
                pa.array((scans[bounds[:-1] + one] - scans[bounds[:-1]]).astype(np.float64)),
                list_array(bounds, pa.array(gram.view(np.int64))),
            ],
            names=["doc_id", "node", "size", "two", "one", "hot", "subsets", "scanned", "grams"],
        )


#: ``one`` grams stand in lists, and ``hot``, the last, are of more than ``HOT`` documents; ``subsets`` is what a light set writes, ``scanned`` the lists' lengths.
PREFIX = "doc_id long, node long, size int, two int, one int, hot int, subsets double, scanned double, grams array<long>"


def boundary(prefix: DataFrame) -> int:
    """The largest size of a light set: what light sets write and the lists that heavy sets scan are least, and subsets no more than entries."""
    sums = {c: F.sum(c).alias(c) for c in ("one", "subsets", "scanned")}
    entries = prefix.agg(F.sum("one")).first()[0] or 0
    rows = prefix.where("two = 1").groupBy("size").agg(*sums.values()).groupBy(F.expr("cast(log2(size) * 8 as int)").alias("bin")).agg(F.max("size").alias("size"), *sums.values()).orderBy("bin").collect()
    best = cost = sum(r.scanned for r in rows)
    at, written = 0, 0.0
    for r in rows:
        cost += r.subsets + r.one - r.scanned
        written += r.subsets
        if written > entries:
            break
        if cost < best:
            best, at = cost, r.size
    return at


def _keys(prefix: DataFrame, light: int, t: float) -> DataFrame:
    """``key``, ``node``, whether it may start a list, and whether the list is hot: subsets of light sets, single grams of others and of what may be similar to them."""

    def run(batch: pa.RecordBatch):
        ids = batch.column("node").to_numpy()
        size, two, one, hot = (batch.column(c).to_numpy() for c in ("size", "two", "one", "hot"))
        bounds = batch.column("grams").offsets.to_numpy()
        gram = batch.column("grams").values.to_numpy().view(np.uint64)
        small_set = (size <= light) & (two == 1)
        # others are larger than ``light``, or so small that one common gram may do
        met = ~small_set | (size >= t * (light + 1) - 1e-9) | (size <= 1 / t**2 + 1e-9)
        key, doc, lead, warm = [], [], [], []
        for k in range(len(ids)):
            own = gram[bounds[k] : bounds[k + 1]]
            cool = len(own) - hot[k]
            single = own[: one[k] if met[k] else 0]
            key.append(single)
            lead.append(np.full(len(single), not small_set[k]))
            doc.append(np.full(len(single), ids[k]))
            warm.append(np.arange(len(single)) >= cool)
            if small_set[k] and len(own) > 1:
                i, j = np.triu_indices(len(own), 1)
                lo, hi = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
                key.append(mix(lo * np.uint64(0x9E3779B97F4A7C15) ^ mix(hi)))
                lead.append(np.ones(len(i), bool))
                doc.append(np.full(len(i), ids[k]))
                warm.append(i >= cool)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(lead)), pa.array(np.concatenate(warm))], names=["key", "node", "lead", "hot"])

    return arrow_map(prefix, run, "key long, node long, lead boolean, hot boolean", by=None)


def _links(keys: DataFrame, parts: int) -> DataFrame:
    """Of each list with a set that may start it (a heavy set, or any of a subset): links from its first set to the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        key, doc, lead = (np.concatenate([g[k] for g in got]) for k in range(3))
        del got
        order = np.lexsort((doc, key))
        key, doc, lead = key[order], doc[order], lead[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(cut, len(key)))
        led = np.repeat(np.logical_or.reduceat(lead, cut), times)
        first = np.repeat(doc[cut], times)
        keep = led & (first != doc)
        pair = np.unique(np.stack([first[keep], doc[keep]], 1), axis=0)
        for i in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 100_000, 0]), pa.array(pair[i : i + 100_000, 1])], names=["src", "dst"])

    return keys.repartition(parts, "key").mapInArrow(tidied(run), "src long, dst long")


def _hot_links(keys: DataFrame) -> DataFrame:
    """The same of lists that are too long for one task: their first sets are aggregated, and joined back."""
    first = keys.groupBy("key").agg(F.min("node").alias("src"), F.max("lead").alias("led")).where("led").select(F.col("key").alias("_key"), "src")
    return keys.join(small(materialise(first), 32), F.col("key") == F.col("_key")).select("src", F.col("node").alias("dst")).where("src <> dst")


def candidates(prefix: DataFrame, parts: int, t: float) -> DataFrame:
    """Stars ``(src, dst)`` of the sets of ``prefix``, one row a set."""
    keys = _keys(prefix, boundary(prefix), t)
    found = _links(keys.where("not hot").drop("hot"), parts)
    if not prefix.where("hot > 0").isEmpty():
        found = found.unionAll(_hot_links(keys.where("hot").drop("hot")))
    return found.distinct()


def compare(block: stars.Block, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links, best similarity and root of each member of a block of sets."""
    order = np.lexsort((block.ids, [len(p) for p in block.payload]))
    size = np.array([len(block.payload[k]) for k in order])
    _, code = np.unique(np.concatenate([block.payload[k] for k in order]), return_inverse=True)
    bounds = np.append(0, np.cumsum(size))
    mark = np.zeros(code.max() + 1 if len(code) else 0, np.int32)
    side, copies = block.first[order], block.copies
    links, best, label = np.zeros(len(order), np.int64), np.zeros(len(order)), np.arange(len(order))
    for k in range(len(order) - 1):
        upto = int(np.searchsorted(size, size[k] / t + 1e-9, "right"))
        if upto <= k + 1:
            continue
        own = code[bounds[k] : bounds[k + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[code[bounds[k + 1] : bounds[upto]]], bounds[k + 1 : upto] - bounds[k + 1])
        mark[own] = 0
        sim = both / (size[k] + size[k + 1 : upto] - both)
        ok = sim >= t - 1e-12
        if block.cross:
            ok &= side[k + 1 : upto] != side[k]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        me, others, sim = order[k], order[k + 1 + at], sim[at]
        best[me] = max(best[me], sim.max())
        best[others] = np.maximum(best[others], sim)
        label = stars.merge(label, np.full(len(others), me), others)
        others = others[~block.counted_before(me, others)]
        links[me] += copies[others].sum()
        links[others] += copies[me]
    return links, best, np.where(best > 0, label, -1)


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_grams: int = BLOCK_GRAMS, range_grams: int = RANGE_GRAMS, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, links, best_jaccard), a row a row of ``docs``; links are pairs of similarity ``threshold`` or above."""
    t = threshold
    spark = ship(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    src = every.where("doc_id is not null and text is not null")
    letters = src.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(letters / 6 / range_grams))
    parts = max(4, math.ceil(letters / 6 / 4 / range_grams))
    with shuffle_cleanup(spark):
        index = _index_rows(src, n, ranges)
        counted = materialise(index.repartitionById(ranges, F.expr(f"if(bucket < 0, cast(pmod(uid, {ranges}) as int), bucket)")).mapInArrow(tidied(_count_range), "uid long, bucket int, a binary, b binary, c binary"))
        prefix = materialise(counted.repartition(max(4, ranges), "uid").mapInArrow(tidied(lambda it: _prefixes(it, t, hot)), PREFIX))
        discard(counted)
        rows = materialise(prefix.select("doc_id", "node"))
        nodes = materialise(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
        others = rows.join(small(nodes.where("copies > 1").select(F.col("node").alias("_n"), "least"), 32), F.col("node") == F.col("_n")).where("doc_id <> least").select(F.col("node").alias("_n"), F.col("doc_id").alias("_d")).distinct()
        sets = prefix.where("node is not null").join(small(materialise(others), 32), (F.col("node") == F.col("_n")) & (F.col("doc_id") == F.col("_d")), "left_anti")
        links = materialise(candidates(sets, parts, t))
        discard(prefix)
        outer = stars.outer_stars(links)
        held = materialise(outer.join(nodes, F.col("id") == F.col("node")).select("id", "comps", "copies", F.col("least").alias("_least")))
        discard(links)
        sums, comp = stars.classes(_compared(src, held, n, t, block_grams, parts))
    node = nodes.withColumnRenamed("node", "_n").join(comp, F.col("_n") == F.col("id"), "left").select("_n", "least", "copies", F.coalesce("comp", "_n").alias("comp"))
    lowest = node.groupBy("comp").agg(F.min("least").alias("class_id"))
    facts = node.join(lowest, "comp").join(sums, F.col("_n") == F.col("id"), "left")
    facts = facts.where("copies > 1 or id is not null").select("_n", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("best_jaccard"))
    joined = rows.join(small(materialise(facts), 48), F.col("node") == F.col("_n"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "best_jaccard")
    alone = every.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("double").alias("best_jaccard"))
    return joined.unionAll(alone)


def _compared(src: DataFrame, held: DataFrame, n: int, t: float, block_grams: int, parts: int) -> DataFrame:
    """The texts of nodes in stars, as sets, compared within the stars."""
    members = src.join(stars.sized(held), F.col("doc_id") == F.col("_least")).select("id", "comps", "copies", "text")

    def sets(batch: pa.RecordBatch):
        bounds, gram = gram_sets(batch.column("text"), n)
        # of rows that repeat a doc_id, those with the set that is meant
        keep = pa.array(set_hash(bounds, gram) == batch.column("id").to_numpy())
        payload = pa.array([_bytes(gram[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("comps"), batch.column("copies"), payload], names=["id", "comps", "copies", "payload"]).filter(keep)

    owned = arrow_map(members, sets, "id long, comps array<long>, copies long, payload binary")
    # text lengths bound the sets' sizes without another pass over the texts
    weight = members.select(F.explode("comps").alias("comp"), F.length("text").cast("long").alias("weight"))
    blocks = stars.placed(owned, weight, 4 * block_grams)
    return stars.verified(blocks, lambda block: compare(block, t), lambda raw: np.frombuffer(raw.as_py(), np.uint64), parts)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document, the lowest doc_id, of each class; rows without a doc_id stay, as does every row of a doc_id of which any row is the first of its class."""
    name = fresh(docs, "__gone")
    with shuffle_cleanup(docs.sparkSession):
        gone = materialise(linked(docs, **how).where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.min(F.col("class_id") < F.col("doc_id")).alias("all")).where("all").select(name))
    return docs.join(small(gone, 24), F.col("doc_id") == F.col(name), "left_anti")
