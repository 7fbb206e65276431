"""Per-date (cross-sectional) operators. Statistics are map-side aggregates joined back; ranks
use bucketed numbering, so a date that holds most of the rows is still many tasks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import scan
from tideline.operators import timeseries as ts
from tideline.session import cut_lineage


def ranks(df: DataFrame, keys: Sequence[str], value: str, tie: str = "symbol") -> DataFrame:
    """rank_asc by (value, tie), rank_desc as its mirror, n_group rows with a value; all 1-based
    and exact. A row without a value stays, with null ranks."""
    d = scan.number_by_value(df, keys, value, tie)
    n = df.groupBy(*keys).agg(F.count(value).alias("n_group"))
    d = scan.attach(d, n, keys)
    return d.withColumns({"rank_asc": F.col("_pos") + 1, "rank_desc": F.col("n_group") - F.col("_pos")}).drop("_pos")


def buckets(df: DataFrame, keys: Sequence[str], value: str, k: int, name: str, tie: str = "symbol") -> DataFrame:
    """1..k equal-count groups: floor(k * position / n) + 1. The ranks read their rows several times, and a sum of
    doubles may come out with another last bit each time, so the rows are fixed first."""
    d = ranks(cut_lineage(df), keys, value, tie)
    return d.withColumn(name, (F.floor((F.col("rank_asc") - 1) * float(k) / F.col("n_group")) + 1).cast("long")).drop(
        "rank_asc", "rank_desc")


def terciles(df: DataFrame, value: str, name: str = "tercile") -> DataFrame:
    """low / mid / high by mid-rank share over the whole table, so equal values stay together."""
    d = df.where(F.col(value).isNotNull()).withColumn("_g", F.lit(0))
    d = scan.mid_ranks(d, ["_g"], value, "_mr")
    d = scan.with_group(d, ["_g"], _n=F.count(F.lit(1)))
    s = F.col("_mr") / F.col("_n")
    return d.withColumn(name, F.when(s <= 1.0 / 3, "low").when(s <= 2.0 / 3, "mid").otherwise("high")).drop("_g", "_mr", "_n")


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return scan.quantiles(df, keys, value, [0.5], [name])


def minus_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """value minus its group's median on every row (rows of groups without values kept, null)."""
    m = medians(df, keys, value, "_med")
    return df.join(m, list(keys), "left").withColumn(name, F.col(value) - F.col("_med")).drop("_med")


def top_k(df: DataFrame, keys: Sequence[str], value: str, k: int, tie: str = "symbol", largest: bool = True,
          name: str = "rank") -> DataFrame:
    """k best rows per key; each task keeps only its own best k before the exchange."""
    o = [F.desc(value), F.col(tie)] if largest else [F.asc(value), F.col(tie)]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*o))
    return df.where(F.col(value).isNotNull()).withColumn(name, rn).where(F.col(name) <= k)


def liquidity_strata(panel: DataFrame, rows: int = 30, k: int = 5, min_symbols: int = 5, chunk: str = "month") -> DataFrame:
    """Quintile of month m from the rolling median volume known at the end of month m-1."""
    d = scan.over_series(panel, lambda d, w: d.withColumn("liq", ts.rolling_median("quote_volume", rows, w)), back=rows, chunk=chunk)
    nxt = F.add_months(F.date_trunc("month", "ts").cast("date"), 1).cast("timestamp_ntz")
    m = d.where("liq IS NOT NULL").groupBy("symbol", nxt.alias("month")).agg(F.max_by("liq", "ts").alias("liq"))
    return buckets(m, ["month"], "liq", k, "quintile").where(F.col("n_group") >= min_symbols).drop("n_group")


def numbered_dates(df: DataFrame, name: str = "k") -> DataFrame:
    """Distinct dates with their 0-based index. One row per calendar step, so this stays small
    however large the panel is."""
    return scan.number_rows(df.select("ts").distinct().withColumn("_g", F.lit(0)), ["_g"], ["ts"], "year", name).drop("_g")


def grid_dates(df: DataFrame, step: int, offset: int = 0) -> DataFrame:
    """Every step-th distinct date from the given offset on."""
    return numbered_dates(df, "k").where((F.col("k") >= offset) & ((F.col("k") - offset) % step == 0)).select("ts")


def precision_at_k(df: DataFrame, score: str, outcome: str, k: int) -> DataFrame:
    """Share of the k best-scored symbols of a date that are among its k best outcomes."""
    a = top_k(df, ["ts"], score, k).select("symbol", "ts")
    b = top_k(df, ["ts"], outcome, k).select("symbol", "ts", F.lit(1).alias("_hit"))
    return a.join(b, ["symbol", "ts"], "left").groupBy("ts").agg((F.count("_hit") / float(k)).alias("precision"))
