"""Near-duplicate embeddings by lattice hashing with E8.

Each of several tables projects unit vectors on eight random orthonormal directions, scales them, and decodes the
result to the nearest point of the lattice E8 (the nearer of its two cosets of D8). A vector is stored under its own
cell, and looks into the ``PROBES`` nearest of that cell and its 240 neighbours, by distance from its own projection.

The scale follows the number of vectors, so that the strangers stored in a cell don't grow with it; a pair then shares
a table less often, and the number of tables follows: ``tables_for`` draws pairs at the threshold, counts how many
meet in one table, and takes as many tables (``TABLES`` at least) as find ``RECALL`` of them. More than ``TOGETHER`` are
worked through that many at a time, so hashes on disk don't grow with their number.

Vectors that meet in a cell are compared by ``SIGNS`` signs of random projections: those that differ in no more than
``signs_apart`` (3.5 deviations above what pairs at the threshold differ in) are joined, and each component of a cell is a
star of its lowest id. A cell in which more than ``HOT`` look is never brought together: it is one star, whose lowest id is
aggregated and joined back. ``stars`` then compares all pairs within a star by their exact cosine, block by block, and
counts links, a row a vector and block. Equal vectors are copies: one stands for all of them and they aren't compared.

All rows are stored and all probe; nothing is capped. Search is approximate: recall against brute force is tested to be 0.9
at least, at several thresholds, at the scale of few vectors and of millions.

The result has one row a vec_id: ``class_id`` (the lowest vec_id of those that links connect it with, its own without
any), ``links`` (the number of vectors at ``threshold`` or above that were found, copies among them) and ``best_cosine``
(the highest of these, null without any). Defined cases: a vec_id whose vector is null, has a null or non-finite
coordinate, is zero or of an uncommon length has no links; rows with a null vec_id are left out; rows that repeat a vec_id
count as one (the least usable vector); equal vectors have cosine 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import stars
from weftgraph.llm.common import arrow_map, discard, list_array, materialise, mix, shuffle_cleanup, small, tidied
from weftgraph.llm.topk import usable

THRESHOLD = 0.9
#: Tables at least, and tables hashed at a time.
TABLES = 3
TOGETHER = 8
PROBES = 8
#: Signs of random projections that vectors in a cell are compared by, two words of them.
SIGNS = 128
#: Strangers stored in a cell, about.
STRANGERS = 512.0
#: Vectors looking into a cell beyond which it isn't brought together in one task.
HOT = 50_000
#: Rows of cells in one task, and members of a star in one block, about.
PART_ROWS = 2_000_000
BLOCK_MEMBERS = 8_192
#: Pairs at the threshold that the tables together find; above the promised 0.9 by what drawing may be off.
RECALL = 0.95
SEED = 8


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sums."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    off = y[odd] - r[odd]
    worst = np.abs(off).argmax(1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def cell_keys(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of lattice points (..., 8) in one table."""
    h = np.full(points.shape[:-1], (salt + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k in range(8):
        h = mix(h * np.uint64(0x100000001B3) + np.rint(2 * points[..., k]).astype(np.int64).view(np.uint64))
    return h


def scale_for(n: int) -> float:
    """Projections' scale at which a cell of n random unit vectors holds about ``STRANGERS``; never below 1.2."""
    return max(1.2, float(np.sqrt(8 * (max(n, 1) / STRANGERS) ** 0.25 / (4 * np.pi))))


def tables(dim: int, count: int = TABLES, seed: int = SEED) -> tuple[list[np.ndarray], np.ndarray]:
    """Projections (dim, 8) of each table, and directions for signs."""
    rng = np.random.default_rng(seed)
    wide = max(dim, 8)
    return [np.linalg.qr(rng.normal(size=(wide, 8)))[0][:dim] * np.sqrt(dim / 8) for _ in range(count)], rng.normal(size=(dim, SIGNS))


def tables_for(scale: float, dim: int, threshold: float, probes: int, least: int = TABLES, enough: int = 1000, batch: int = 500) -> int:
    """Tables, ``least`` or more, that find ``RECALL`` of pairs at ``threshold``.

    Directions are random, so a table finds each such pair with the same probability, whatever the others found. It is
    counted over drawn pairs until ``enough`` have met, each batch in a table of its own.
    """
    rng = np.random.default_rng(SEED)
    near = min(max(threshold, 0.0), 1.0)
    met = drawn = 0
    while met < enough:
        x, y = rng.normal(size=(2, batch, dim))
        x /= np.sqrt((x * x).sum(1))[:, None]
        if dim > 1:
            y -= (x * y).sum(1)[:, None] * x
            y /= np.sqrt((y * y).sum(1))[:, None]
            y = near * x + np.sqrt(1 - near * near) * y
        else:
            y = x
        projection = tables(dim, 1, SEED + 1 + drawn)[0]
        (a, to_a), (b, to_b) = (keys(v, projection, scale, probes) for v in (x, y))
        met += int(((a[:, :, None] == to_b).any((1, 2)) | (b[:, :, None] == to_a).any((1, 2))).sum())
        drawn += batch
    if met == drawn:
        return least
    return max(least, int(np.ceil(np.log(1 - RECALL) / np.log(1 - met / drawn))))


def keys(x: np.ndarray, projections: list[np.ndarray], scale: float, probes: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Own key (n, tables) and probed keys (n, tables, probes) of unit vectors; ``first`` is the number of the first table."""
    near = roots()
    own = np.zeros((len(x), len(projections)), np.uint64)
    probed = np.zeros((len(x), len(projections), probes), np.uint64)
    for t, p in enumerate(projections):
        y = scale * (x @ p)
        c = nearest_e8(y)
        own[:, t] = cell_keys(c, first + t)
        # |y - (c + r)|^2 = |y - c|^2 - 2 (y - c).r + 2: the largest products are the nearest neighbours
        best = np.argsort(-((y - c) @ near.T), 1, kind="stable")[:, : probes - 1]
        probed[:, t, 0] = own[:, t]
        probed[:, t, 1:] = cell_keys(c[:, None, :] + near[best], first + t)
    return own, probed


def signs_apart(threshold: float) -> int:
    """Signs in which a pair at the threshold differs at most, but for one in some thousands."""
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    return int(np.ceil(SIGNS * p + 3.5 * np.sqrt(SIGNS * p * (1 - p))))


def linked(vectors: DataFrame, threshold: float = THRESHOLD, count: int = TABLES, probes: int = PROBES, hot: int = HOT, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(vec_id, class_id, links, best_cosine), a row a vec_id; ``count`` tables or more."""
    with shuffle_cleanup(vectors.sparkSession):
        rows = materialise(usable(vectors).where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x) > 0))
        hashed = rows.select("id", F.xxhash64("v").alias("h"), F.hash("v").alias("g"))
        equal = hashed.groupBy("h", "g").agg(F.min("id").alias("node"), F.count("*").alias("copies")).where("copies > 1").select(F.col("h").alias("_h"), F.col("g").alias("_g"), "node", "copies")
        copies = materialise(hashed.join(small(materialise(equal), 40), (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).select(F.col("id").alias("_id"), "node", "copies"))
        nodes = rows.join(small(copies.where("_id <> node"), 24), F.col("id") == F.col("_id"), "left_anti")
        top = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        dim, scale = top.d or 8, scale_for(top.n)
        links = candidates(nodes, dim, tables_for(scale, dim, threshold, probes, count), scale, probes, signs_apart(threshold), hot, top.n)
        outer = stars.outer_stars(links).join(small(copies.where("_id = node"), 24), F.col("id") == F.col("_id"), "left").select("id", "comps", F.coalesce("copies", F.lit(1)).alias("copies"))
        held = materialise(outer)
        discard(links)
        members = nodes.select(F.col("id").alias("_id"), F.col("v").alias("payload")).join(stars.sized(held), F.col("id") == F.col("_id")).select("id", "comps", "copies", "payload")
        weight = held.select(F.explode("comps").alias("comp"), F.lit(1).alias("weight"))
        blocks = stars.placed(members, weight, block_members)
        sums, comp = stars.classes(stars.verified(blocks, lambda block: compare(block, threshold), lambda v: v.values.to_numpy(), max(8, -(-top.n // 20_000))))
        facts = copies.select("_id", "node", "copies").join(sums.withColumnRenamed("id", "_s"), F.col("node") == F.col("_s"), "full")
        facts = facts.select(F.coalesce("_id", "_s").alias("_id"), F.coalesce("node", "_s").alias("node"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("best_cosine"))
        facts = materialise(facts.join(comp.withColumnRenamed("id", "_c"), F.col("node") == F.col("_c"), "left").select("_id", F.coalesce("comp", "node").alias("class_id"), "links", "best_cosine"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    return ids.join(small(facts, 48), F.col("vec_id") == F.col("_id"), "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "best_cosine")


def compare(block: stars.Block, t: float, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links, best cosine and root of each member of a block of vectors."""
    x = np.stack(block.payload).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    m, before, copies = len(x), block.table(), block.copies
    links, best, label = np.zeros(m, np.int64), np.full(m, -np.inf), np.arange(m)
    for i in range(0, m, step):
        sim = x[i : i + step] @ x[i:].T
        ok = (sim >= t) & (np.arange(m - i) > np.arange(len(sim))[:, None])
        if block.cross:
            ok &= block.first[i : i + step, None] != block.first[None, i:]
        a, b = np.nonzero(ok)
        if not len(a):
            continue
        sim[~ok] = -np.inf
        best[i : i + step] = np.maximum(best[i : i + step], sim.max(1))
        best[i:] = np.maximum(best[i:], sim.max(0))
        label = stars.merge(label, a + i, b + i)
        if before is not None:
            ok &= before[i : i + step] @ before[i:].T == 0
        links[i : i + step] += ok @ copies[i:]
        links[i:] += copies[i : i + step] @ ok
    return links, np.minimum(best, 1.0), np.where(best > -np.inf, label, -1)


def candidates(nodes: DataFrame, dim: int, count: int, scale: float, probes: int, apart: int, hot: int, n: int) -> DataFrame:
    """Stars ``(src, dst)``, materialised, of vectors that meet in one of ``count`` tables and have similar signs."""
    projections, signs = tables(dim, count)
    found = []
    for first in range(0, count, TOGETHER):
        some = projections[first : first + TOGETHER]
        hashed = materialise(_hashed(nodes, some, signs, scale, probes, first))
        cells = hashed.select("id", "sa", "sb", F.posexplode("probed").alias("pos", "cell")).select("id", "sa", "sb", "cell", (F.col("pos") % probes == 0).alias("stored"))
        parts = max(8, -(-n * len(some) * probes // PART_ROWS))
        # those that look into a cell are stored in it or in one of its 240 neighbours
        if cells.where("stored").groupBy("cell").count().where(F.col("count") > hot // 241).isEmpty():
            met = _met(cells, parts, apart)
        else:
            crowded = materialise(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("src")).where(F.col("n") > hot).select(F.col("cell").alias("_cell"), "src"))
            inside = F.col("cell") == F.col("_cell")
            met = _met(cells.join(small(crowded, 24), inside, "left_anti"), parts, apart).unionAll(cells.join(small(crowded, 24), inside).select("src", F.col("id").alias("dst")).where("src <> dst"))
        found.append(materialise(met.distinct()))
        discard(hashed)
    if len(found) == 1:
        return found[0]
    every = materialise(reduce(DataFrame.unionAll, found).distinct())
    for df in found:
        discard(df)
    return every


def _hashed(nodes: DataFrame, projections: list[np.ndarray], signs: np.ndarray, scale: float, probes: int, first: int) -> DataFrame:
    """(id, sa, sb, probed): signs, and of each table the vector's own cell and its nearest neighbours."""
    held = nodes.sparkSession.sparkContext.broadcast((projections, signs))

    def run(batch: pa.RecordBatch):
        projections, signs = held.value
        ids = batch.column("id").to_numpy()
        if not len(ids):
            return
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(float)
        x /= np.sqrt((x * x).sum(1))[:, None]
        _, probed = keys(x, projections, scale, probes, first)
        sketch = np.packbits(x @ signs > 0, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), list_array(np.arange(len(ids) + 1) * probed[0].size, pa.array(probed.ravel().view(np.int64)))], names=["id", "sa", "sb", "probed"])

    return arrow_map(nodes, run, "id long, sa long, sb long, probed array<long>", by=None)


def _met(cells: DataFrame, parts: int, apart: int) -> DataFrame:
    """Stars of the cells: in each, the components of vectors with similar signs, one of which is stored there."""

    def run(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        ids, sa, sb, cell, stored = (np.concatenate([g[k] for g in got]) for k in range(5))
        del got
        order = np.lexsort((ids, cell))
        ids, sa, sb, cell, stored = ids[order], sa[order].view(np.uint64), sb[order].view(np.uint64), cell[order], stored[order]
        cut = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        held = np.add.reduceat(stored.astype(np.int64), cut)
        ends = np.append(cut[1:], len(cell))
        out: list[np.ndarray] = []
        for k in np.flatnonzero((held > 0) & (ends - cut > 1)):
            at = slice(cut[k], ends[k])
            mine, first, second = ids[at], sa[at], sb[at]
            there = np.flatnonzero(stored[at])
            label = np.arange(len(mine))
            step = max(1, (1 << 20) // len(there))
            for i in range(0, len(mine), step):
                apart_by = np.bitwise_count(first[i : i + step, None] ^ first[there]) + np.bitwise_count(second[i : i + step, None] ^ second[there])
                a, b = np.nonzero(apart_by <= apart)
                label = stars.merge(label, a + i, there[b])
            some = np.flatnonzero(label != np.arange(len(mine)))
            if len(some):
                out.append(np.stack([mine[label[some]], mine[some]], 1))
        for i in range(0, len(out), 1000):
            pair = np.unique(np.concatenate(out[i : i + 1000]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["src", "dst"])

    return cells.repartition(parts, "cell").mapInArrow(tidied(run), "src long, dst long")
