"""Lines of the operating system's own counters: uptime, memory and cores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilune.functions.text import first_group


def uptime(line: Column) -> Column:
    """Whole seconds since the start, from a line of uptime and idle seconds; null if it begins with no number."""
    return F.floor(F.substring_index(F.trim(line), " ", 1).try_cast("double")).cast("long")


def memory_used(lines: DataFrame, host: str, value: str = "value") -> DataFrame:
    """Per host, from 'Name: kB' lines: percent of memory and of swap in use, truncated; 0 swap counts as 0, and without a total there is null."""
    name, kb = first_group(F.col(value), r"^(\w+):"), first_group(F.col(value), r":\s*(\d+)").try_cast("long")
    rows = lines.select(host, name.alias("n"), kb.alias("kb"))
    pick = lambda n: F.max(F.when(F.col("n") == n, F.col("kb"))).alias(n)
    rows = rows.groupBy(host).agg(*map(pick, ("MemTotal", "MemAvailable", "SwapTotal", "SwapFree")))
    used = lambda total, free: F.floor((F.col(total) - F.col(free)) * 100 / F.col(total)).cast("int")
    return rows.select(host, F.when(F.col("MemTotal") > 0, used("MemTotal", "MemAvailable")).alias("ram_pct"), F.when(F.col("SwapTotal") > 0, used("SwapTotal", "SwapFree")).when(F.col("SwapTotal") == 0, 0).alias("swap_pct"))


def core_counters(lines: DataFrame, value: str = "value") -> DataFrame:
    """core, idle and total of lines 'cpuN user nice system idle iowait ...': idle is the fourth and fifth number, the total their sum; other lines are dropped. Further columns are kept."""
    numbers = F.transform(F.filter(F.split(F.trim(F.col(value)), r"\s+"), lambda x: ~x.startswith("cpu")), lambda x: x.try_cast("bigint"))
    core = first_group(F.col(value), r"^cpu(\d+)\s").try_cast("int")
    kept = [c for c in lines.columns if c != value]
    rows = lines.select(*kept, core.alias("core"), numbers.alias("_p")).where("core is not null and size(_p) >= 5")
    return rows.select(*kept, "core", (F.col("_p")[3] + F.col("_p")[4]).alias("idle"), F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
