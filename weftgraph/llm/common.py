"""Shared plumbing: Arrow batches, word codes, hashing, materialisation, checked broadcast."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import ship

#: Text handled at a time inside one Python worker.
SLICE_BYTES = 4 << 20
#: A side of a join is broadcast up to this size and shuffled beyond it.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    with shuffle_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialised frame that nothing will read again."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if "/weft-" in path:
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class shuffle_cleanup:
    """Drop the shuffle files of statements that run inside, once each has ended."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit the limit, unmarked (a shuffle join) otherwise."""
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and beside the executor's heap it counts."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidied(fn: Callable) -> Callable:
    """``fn`` over a partition's batches, tidied up after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            tidy()

    return run


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | pa.Table]], schema, by: str | None = "text", most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of at most ``most`` bytes of column ``by`` (a longer row is a slice of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, most):
                for out in fn(part):
                    yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    ship(df.sparkSession)
    return df.mapInArrow(tidied(run), schema)


def slices(batch: pa.RecordBatch, by: str | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if by is None or batch.num_rows < 2:
        yield batch
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def texts(column: pa.Array) -> pa.Array:
    """Strings with null as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "").cast(pa.large_string())


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per text the bounds of its words, every word's code, and the distinct words. ASCII white space parts words."""
    parts = pc.ascii_split_whitespace(texts(column))
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).dictionary_encode()
    return bounds - bounds[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def strip_word(word: str) -> str:
    """Lower case, without characters at either end that are neither letters nor digits."""
    word = word.lower()
    if word.isalnum():
        return word
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end]


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``split_words`` after ``strip_word``; words that become empty are dropped."""
    bounds, codes, words = split_words(column)
    seen: dict[str, int] = {}
    to = np.fromiter((seen.setdefault(strip_word(w), len(seen)) for w in words), np.int64, len(words))
    codes = to[codes] if len(codes) else codes
    if (empty := seen.get("")) is not None and len(codes):
        keep = codes != empty
        ahead = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=ahead[1:])
        bounds, codes = ahead[bounds], codes[keep]
    return bounds, codes, list(seen)


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes, equal on every machine."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def list_array(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
