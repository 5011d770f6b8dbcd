"""Streams of samples: fixed-rate windows, latest values, missed updates and duplicates. All bound their state by a watermark, but for `latest`, which keeps one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_rate(samples: DataFrame, time: str, keys: list[str], value: str, period: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Count, mean and latest value of each key and period, once the watermark has passed it."""
    rows = samples.withWatermark(time, late).groupBy(F.window(time, period), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max_by(value, time).alias("latest"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "latest")


def latest(samples: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """The newest values of each key (update mode): a snapshot store."""
    newest = samples.groupBy(*keys).agg(F.max_by(F.struct(time, *values), F.col(time)).alias("m"))
    return newest.select(*keys, *(F.col(f"m.{c}").alias(c) for c in (time, *values)))


def deduplicated(commands: DataFrame, keys: list[str], time: str, within: str = "60 seconds") -> DataFrame:
    """Commands but for those that equal one seen within the watermark."""
    return commands.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def sessions(samples: DataFrame, time: str, keys: list[str], gap: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Runs of samples without a longer gap."""
    rows = samples.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
