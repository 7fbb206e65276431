"""Decision stamps and leakage-free partitions of dates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import cross, joins, sampling, scan


def stamps(df: DataFrame, every_days: int = 1, weekday: int | None = None) -> DataFrame:
    """Decision stamps over the union span of all series."""
    span = df.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("a"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("b"))
    s = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {every_days} days"))).alias("ts"))
    return s if weekday is None else s.where(F.weekday("ts") == weekday)


def partition_dates(df: DataFrame, held_out: float = 0.15) -> DataFrame:
    """Distinct dates with ``part`` = iteration, or confirmation for the last share of them."""
    d = cross.numbered_dates(df, "_k").withColumn("_g", F.lit(0))
    d = scan.with_group(d, ["_g"], _n=F.count(F.lit(1)))
    cut = F.floor(F.col("_n") * (1 - held_out))
    return d.select("ts", F.when(F.col("_k") < cut, "iteration").otherwise("confirmation").alias("part"))


def iteration_only(panel: DataFrame, held_out: float = 0.15) -> DataFrame:
    keep = partition_dates(panel, held_out).where("part = 'iteration'").select("ts")
    return panel.join(keep, "ts", "left_semi")


def hybrid(df: DataFrame, seed: int = 42, draws: int = 5, share: float = 0.2, purge: int = 1, embargo: int = 5,
           horizon: int = 1) -> DataFrame:
    """(split, ts, role): several seeded draws of whole months as validation plus a chronological
    tail, with training dates near any validation block removed."""
    purge, embargo = max(purge, horizon), max(embargo, horizon)
    dates = df.select("ts").distinct().withColumn("month", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    months = dates.select("month").distinct().withColumn("_m", F.months_between("month", F.lit("1990-01-01").cast("timestamp_ntz")).cast("long"))
    drawn = months.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("_h", sampling.draw(F.col("_m") * 7919 + F.col("k") * 104729, seed))
    # a few hundred months per draw: the order of the draws picks the smallest ones
    drawn = scan.number_by_value(drawn.withColumn("_t", F.col("month").cast("string")), ["k"], "_h", "_t", "_r")
    drawn = scan.with_group(drawn, ["k"], _n=F.count(F.lit(1)))
    val_months = drawn.where(F.col("_r") < F.greatest(F.lit(1), F.round(F.col("_n") * share))).select(
        F.concat(F.lit("block_draw_"), F.col("k").cast("string")).alias("split"), "month")
    names = F.explode(F.array(*[F.lit(f"block_draw_{i}") for i in range(draws)])).alias("split")
    every = dates.select(names, "ts", "month")
    val = every.join(val_months, ["split", "month"], "left_semi").select("split", "ts")
    blocks = val_months.select("split", F.col("month").alias("start"), F.last_day("month").alias("end"))

    numbered = cross.numbered_dates(df, "_k").withColumn("_g", F.lit(0))
    numbered = scan.with_group(numbered, ["_g"], _n=F.count(F.lit(1)))
    late = F.col("_k") >= F.floor(F.col("_n") * (1 - share))
    tail = numbered.select(F.lit("temporal_holdout").alias("split"), "ts", late.alias("_v"))
    tail_val = tail.where("_v").select("split", "ts")
    tail_block = tail_val.groupBy("split").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))

    val = val.unionByName(tail_val)
    rest = every.select("split", "ts").unionByName(tail.select("split", "ts")).join(val, ["split", "ts"], "left_anti")
    train = joins.outside_blocks(rest, blocks.unionByName(tail_block), purge, embargo, ["split"])
    return train.withColumn("role", F.lit("train")).unionByName(val.withColumn("role", F.lit("val")))
