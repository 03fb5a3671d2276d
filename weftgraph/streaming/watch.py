"""Watching a tree: snapshot differences, debounced rebuilds, sessions of events."""

from __future__ import annotations

import fcntl
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.sources import files
from weftgraph.streaming.events import Events


def sessions(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's events with no gap above ``gap_seconds``: started, ended and their number."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    late = (F.col(ts) - F.lag(ts).over(w)) > F.make_dt_interval(secs=F.lit(gap_seconds))
    marked = events.withColumn("_new", F.when(late | F.lag(ts).over(w).isNull(), 1).otherwise(0)).withColumn("_n", F.sum("_new").over(w))
    return marked.groupBy(key, "_n").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events")).drop("_n")


def session_counts(stream: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The streaming form: session windows under a watermark."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def window_counts(stream: DataFrame, key: str, ts: str = "ts", size: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding counts under a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), key, "n")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, mtime): new, changed, deleted."""
    b, a = before.select("path", F.col("mtime").alias("_b")), after.select("path", F.col("mtime").alias("_a"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "changed")
    return b.join(a, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


@contextmanager
def single_writer(lock: str) -> Iterator[bool]:
    """Whether this process holds the lock; it doesn't wait for another."""
    with open(lock, "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            yield False
            return
        try:
            yield True
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class Debounce:
    """Fires once nothing has happened for ``gap`` seconds."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.gap, self.clock, self.last = gap, clock, None

    def event(self) -> None:
        self.last = self.clock()

    def due(self) -> bool:
        if self.last is None or self.clock() - self.last < self.gap:
            return False
        self.last = None
        return True


def changes(root: str, poll: float, events: bool = True) -> Iterator[set[str]]:
    """Sets of paths that changed, one each ``poll`` seconds or as the system tells; where it doesn't, times are compared."""
    told = None
    if events:
        try:
            told = Events(root, files.watched, files.SKIP)
        except (OSError, AttributeError):  # another system, or no watches left
            pass
    if told is not None:
        try:
            while True:
                yield told.changed(poll)
        finally:
            told.close()
    seen = files.snapshot(root)
    while True:
        time.sleep(poll)
        now = files.snapshot(root)
        changed = {p for p in now.keys() | seen.keys() if now.get(p) != seen.get(p)}
        seen = now
        yield changed


def watch(spark: SparkSession, root: str, rebuild: Callable[[list[str]], None], debounce: float = 3.0, poll: float = 5.0, rounds: int | None = None, lock: str | None = None, events: bool = True) -> int:
    """Watch a tree and rebuild, debounced, with the paths that changed; returns how often. ``rounds`` bounds the loop."""
    timer, pending, built = Debounce(debounce), set(), 0
    lock = lock or str(Path(root) / ".weftgraph.lock")
    for done, changed in enumerate(changes(root, poll, events), 1):
        if changed:
            pending |= changed
            timer.event()
        if timer.due():
            with single_writer(lock) as mine:
                if mine:
                    rebuild(sorted(pending))
                    built += 1
                    pending = set()
                else:
                    timer.event()
        if rounds is not None and done >= rounds:
            break
    return built


def stream_files(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*"):
    """New files of a tree as a stream of batches, each handled once."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
