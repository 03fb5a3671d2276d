"""Sessions, and how Python workers find this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

ROOT = str(Path(__file__).resolve().parent.parent)


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package: from where the driver has it on one machine, from an archive that is sent to them on a cluster."""
    if not spark.sparkContext.master.startswith("local"):
        if not getattr(spark.sparkContext, "_weftgraph_sent", False):
            spark.sparkContext.addPyFile(_archive())
            spark.sparkContext._weftgraph_sent = True
        return spark
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


def _archive() -> str:
    """The package as a zip file on the driver; Spark serves it to executors."""
    at = f"{tempfile.mkdtemp(prefix='weftgraph-')}/weftgraph.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    return at


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one in local mode only, where none is set."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: no lineage left, nothing lost with an executor, its true size known to the planner."""
    spark = df.sparkSession
    void = [f.name for f in df.schema if isinstance(f.dataType, NullType)]
    df = df.withColumns({c: F.lit(None).cast("string") for c in void}) if void else df
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Move a folder into the place of another, which is deleted."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (new, old))
    files = a.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(b, True)
    if not files.rename(a, b):
        raise OSError(f"{new} can't be moved to {old}")


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete the tables of ``cut`` frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if "/cut-" in path:
                drop(spark, path)
