"""Points in spans: an interval join on fixed-width bins instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, point: str, by: list[str] | None = None, step: int = 2) -> DataFrame:
    """The shortest span (``span, lo, hi``) around each point's ``pos``, the least among equals; ``by`` are columns that must agree.

    Bins are powers of ``2 ** step`` wide, each span's the least that is no narrower than itself, so it touches two of them
    at most, however wide; a point is listed under its bin of each power that spans have. The join is an equi-join.
    """
    by = by or []
    spans = binned(spans, step)
    powers = sorted(r[0] for r in spans.select("_power").distinct().collect())  # 64 / step at most
    listed = points.withColumn("_power", F.explode(F.array(*[F.lit(k) for k in powers]) if powers else F.array().cast("array<int>")))
    met = listed.withColumn("_bin", F.expr("shiftright(cast(pos as bigint), _power)")).join(spans, [*by, "_power", "_bin"]).where("pos >= lo and pos < hi")
    return met.groupBy(*by, point).agg(F.min_by("span", F.struct(F.col("hi") - F.col("lo"), "span")).alias("span"))


def binned(spans: DataFrame, step: int) -> DataFrame:
    """A row a span and ``_bin`` of its ``_power``."""
    power = F.ceil(F.log2((F.col("hi") - F.col("lo")).cast("double")) / step) * step
    sized = spans.where("hi > lo").withColumn("_power", F.least(power, F.lit(62)).cast("int"))
    return sized.withColumn("_bin", F.explode(F.expr("sequence(shiftright(cast(lo as bigint), _power), shiftright(cast(hi - 1 as bigint), _power))")))
