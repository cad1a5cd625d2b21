"""Energy and processor usage from periodic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def integral(samples: DataFrame, keys: Sequence[str], time_ms: str, rails: Sequence[str]) -> DataFrame:
    """Joules of each rail, their sum and the average power; a sample's power holds since the one before, the first one's for no time."""
    w = Window.partitionBy(*keys).orderBy(time_ms)
    dt = F.coalesce((F.col(time_ms) - F.lag(time_ms).over(w)) / 1000.0, F.lit(0.0))
    sums = samples.withColumn("_dt", dt).groupBy(*keys).agg(*[F.sum(F.col(r) * F.col("_dt")).alias(f"{r}_j") for r in rails], F.sum("_dt").alias("seconds"))
    whole = sum((F.col(f"{r}_j") for r in rails), F.lit(0.0))
    return sums.withColumn("energy_j", whole).withColumn("power_w", F.when(F.col("seconds") > 0, F.col("energy_j") / F.col("seconds")).otherwise(0.0))


def since_reset(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The last minus the first value of a counter that rises."""
    return samples.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("delta"))


def cpu_usage(samples: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """A10: percent of user time in the user, system and idle ticks since the sample before, cut to whole numbers; 0 without ticks."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = {c: F.col(c) - F.lag(c).over(w) for c in ("user", "system", "idle")}
    moved = samples.withColumns({f"_{c}": x for c, x in d.items()}).withColumn("_all", F.expr("_user + _system + _idle"))
    return moved.withColumn("usage", F.expr("case when _all is null then null when _all = 0 then 0 else (100 * _user) div _all end")).drop("_user", "_system", "_idle", "_all")
