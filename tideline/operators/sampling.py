"""Seeded draws that depend on the data only, never on partitioning."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import scan


def draw(x: Column, seed: int, salt: int = 12345) -> Column:
    """Integer in [0, 2^31) from a non-negative integer column; plain arithmetic, so any engine
    gives the same draw."""
    return (x.cast("long") * 1103515245 + F.lit(seed * salt)) % 2147483648


def hash01(seed: int, *cols: str | Column) -> Column:
    """Uniform in [0, 1) from a 64-bit hash of the seed and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / float(1 << 52)


def window_starts(dates: DataFrame, h: int, target: int, seed: int) -> DataFrame:
    """`target` seeded starts at least h days apart, or as many as fit: from a drawn offset under h days on, each next start
    is the first date h days or more behind the last one; of these the ones with the smallest draws are taken."""
    day = F.datediff(F.to_date("ts"), F.lit("1990-01-01")).cast("long")
    d = dates.select(F.lit(0).alias("_g"), day.alias("n"), "ts").distinct()
    first = d.groupBy("_g").agg((F.min("n") + draw(F.lit(seed), seed) % h).alias("_first"))
    d = d.join(F.broadcast(first), "_g").where("n >= _first").withColumn("_then", F.col("n") + h)  # one row
    starts = scan.chain(d, "n", "_then", ["_g"], ["n", "ts"], chunk=366)
    return starts.orderBy(draw(F.col("n"), seed), "ts").limit(target).select("ts")
