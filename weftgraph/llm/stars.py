"""Similarity links counted within stars: how candidates become verified links, one row a node, without a row a pair.

A candidate search gives stars: rows ``(src, dst)`` saying that ``dst`` lies in the star of ``src``, such that every pair
that may be similar lies in some star together. Here stars within others are left out, each star's members are brought
together in blocks, and a kernel compares all pairs of a block with exact similarities. A pair that lies in several stars
counts in the least of them alone, so every link counts once; a block returns a row for each member that has a link (its
number of links, the best similarity, and the least member that it is connected with), never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import BROADCAST_BYTES, discard, materialise, small, tidied
from weftgraph.llm.components import components

#: What a kernel gives for the members of a block: number of links, best similarity, root (a position), each by position.
Kernel = Callable[["Block"], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Block:
    """Members of a star brought together: ids, copies, payloads, their own half (of two), and the star's predecessors."""

    def __init__(self, rows: list[tuple], star: int, cross: bool, first: int) -> None:
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.copies = np.array([r[1] for r in rows], np.int64)
        self.payload = [r[3] for r in rows]
        self.first = np.array([r[4] == first for r in rows])
        self.cross = cross
        earlier = [r[2][r[2] < star] for r in rows]
        size = np.array([len(e) for e in earlier], np.int64)
        every = np.concatenate(earlier) if rows else np.zeros(0, np.int64)
        names, code, times = np.unique(every, return_inverse=True, return_counts=True)
        # a predecessor matters where it has two of these members
        keep = times[code] > 1 if len(every) else np.zeros(0, bool)
        owner = np.repeat(np.arange(len(rows)), size)[keep]
        self.earlier = np.searchsorted(owner, np.arange(len(rows) + 1)), (np.cumsum(times > 1) - 1)[code[keep]] if len(every) else code, int((times > 1).sum())

    def counted_before(self, k: int, others: np.ndarray) -> np.ndarray:
        """Whether the pairs of member ``k`` with ``others`` lie in an earlier star too."""
        bounds, code, many = self.earlier
        own = code[bounds[k] : bounds[k + 1]]
        out = np.zeros(len(others), bool)
        if not len(own):
            return out
        mark = np.zeros(many, bool)
        mark[own] = True
        width = bounds[others + 1] - bounds[others]
        at = np.repeat(bounds[others] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        hit = np.repeat(np.arange(len(others)), width)[mark[code[at]]]
        out[hit] = True
        return out

    def table(self) -> np.ndarray | None:
        """Members by earlier stars, as zeros and ones; None where no two members have one in common."""
        bounds, code, many = self.earlier
        if not many:
            return None
        out = np.zeros((len(self.ids), many), np.float32)
        out[np.repeat(np.arange(len(self.ids)), np.diff(bounds)), code] = 1
        return out


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least position of its component) after linking positions ``a`` with ``b``."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def outer_stars(links: DataFrame) -> DataFrame:
    """``(id, comps)``: the stars that every node lies in, without those that lie within the star of the least node that their centre is linked to."""
    star = links.select(F.col("src").alias("comp"), F.col("dst").alias("id"))
    star = star.unionAll(star.select("comp", F.col("comp").alias("id")).distinct())
    above = links.groupBy(F.col("dst").alias("comp")).agg(F.min("src").alias("above")).join(links.select(F.col("src").alias("comp")).distinct(), "comp", "left_semi")
    there = star.select(F.col("comp").alias("above"), "id", F.lit(1).alias("there"))
    inside = star.join(above, "comp").join(there, ["above", "id"], "left").groupBy("comp").agg(F.count(F.when(F.col("there").isNull(), 1)).alias("outside")).where("outside = 0").select("comp")
    return star.join(inside, "comp", "left_anti").groupBy("id").agg(F.sort_array(F.collect_list("comp")).alias("comps"))


def sized(stars: DataFrame) -> DataFrame:
    """Materialised ``(id, comps, ...)`` marked for broadcast if all its arrays fit the limit."""
    held = stars.agg(F.sum(F.size("comps") * 8 + 64)).first()[0] or 0
    return F.broadcast(stars) if held <= BROADCAST_BYTES else stars


def placed(members: DataFrame, weight: DataFrame, per_block: int) -> DataFrame:
    """Members ``(comps, id, copies, payload)`` by star and pair of blocks; ``weight(comp, weight)`` says the load of each star."""
    heavy = materialise(weight.groupBy("comp").agg(F.sum("weight").alias("weight")).where(F.col("weight") > per_block).select(F.col("comp").alias("_comp"), F.ceil(F.col("weight") / per_block).cast("int").alias("blocks")))
    cut = (
        members.withColumn("comp", F.explode("comps"))
        .join(small(heavy, 40), F.col("comp") == F.col("_comp"), "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    )
    return (
        cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("bi", F.least("block", "other"))
        .withColumn("bj", F.greatest("block", "other"))
        .select("comp", "bi", "bj", "block", "id", "copies", "comps", "payload")
    )


def verified(blocks: DataFrame, kernel: Kernel, read: Callable[[pa.Scalar], np.ndarray], parts: int) -> DataFrame:
    """``(id, links, best, root)``, one row a block and member with links, of ``placed`` members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # a node repeated is one
        now = None
        out: list[tuple] = []

        def flush() -> None:
            if len(held) < 2:
                return
            block = Block(list(held.values()), now[0], now[1] != now[2], now[1])
            links, best, root = kernel(block)
            some = np.flatnonzero(root >= 0)
            out.append((block.ids[some], links[some], best[some], block.ids[root[some]]))

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(4)], names=["id", "links", "best", "root"])

        for batch in batches:
            comp, bi, bj, block, ids, copies = (batch.column(c).to_pylist() for c in ("comp", "bi", "bj", "block", "id", "copies"))
            comps = batch.column("comps")
            bounds, flat = comps.offsets.to_numpy(), comps.values.to_numpy()
            payload = batch.column("payload")
            for k in range(batch.num_rows):
                at = (comp[k], bi[k], bj[k])
                if at != now:
                    flush()
                    if sum(len(o[0]) for o in out) > 50_000:
                        yield give()
                        out = []
                    held, now = {}, at
                held[ids[k]] = ids[k], copies[k], flat[bounds[k] : bounds[k + 1]], read(payload[k]), block[k]
        flush()
        if out:
            yield give()

    return blocks.repartition(parts, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj").mapInArrow(tidied(run), "id long, links long, best double, root long")


def classes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``verified`` rows: ``(id, links, best)`` and ``(id, comp)``, a row a node, both materialised."""
    found = materialise(found)
    sums = materialise(found.groupBy("id").agg(F.sum("links").alias("links"), F.max("best").alias("best")))
    comp = materialise(components(found.select(F.col("id").alias("src"), F.col("root").alias("dst"))))
    discard(found)
    return sums, comp
