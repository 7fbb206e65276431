"""Validation and coverage reports: one grouped aggregate each."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import scan
from tideline.operators import timeseries as ts

# Candle length in minutes by timeframe name.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}
REGIMES = ("trending", "mean_reverting", "random_walk")


def candles(df: DataFrame, timeframe: str, chunk: str = "month") -> DataFrame:
    """Nulls, inverted ranges, closes outside the range and gaps beyond three intervals."""
    step = MINUTES[timeframe] * 60

    def build(d, w):
        return d.withColumn("_gap", F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)))

    d = scan.over_series(df, build, back=1, chunk=chunk)
    fields = ["open", "high", "low", "close", "volume"]
    null = F.lit(False)
    for f in fields:
        null = null | F.col(f).isNull()
    g = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(null).alias("n_null"), F.count_if(F.col("high") < F.col("low")).alias("n_inverted"),
        F.count_if((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("n_outside"),
        F.count_if(F.col("_gap") > 3 * step).alias("n_gaps"))
    return g.withColumn("valid", (F.col("n") > 0) & (F.col("n_null") + F.col("n_inverted") + F.col("n_outside") == 0))


def features(df: DataFrame) -> DataFrame:
    """Hurst inside [0, 1], volatility not negative, known regimes, not empty."""
    g = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("hurst") < 0) | (F.col("hurst") > 1)).alias("bad_hurst"),
        F.count_if(F.col("vol") < 0).alias("bad_vol"), F.count_if(~F.col("regime").isin(*REGIMES)).alias("bad_regime"))
    return g.withColumn("valid", (F.col("n") > 0) & (F.col("bad_hurst") + F.col("bad_vol") + F.col("bad_regime") == 0))


def month_holes(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    m = F.date_trunc("month", "ts").cast("date")
    span = F.months_between(F.max(m), F.min(m)).cast("long") + 1
    return df.groupBy(*keys).agg(F.count_distinct(m).alias("months"), (span - F.count_distinct(m)).alias("holes"))


def duplicates_and_gaps(df: DataFrame, chunk: str = "month") -> DataFrame:
    """Duplicate stamps, missing hours and span per symbol."""
    per = df.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("_c"))
    hours = ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 3600).cast("long") + 1
    return per.groupBy("symbol").agg(F.sum("_c").alias("n"), F.sum(F.col("_c") - 1).alias("duplicates"), (hours - F.count(F.lit(1))).alias("missing_hours"),
                                     F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def volume_audit(df: DataFrame, last_rows: int = 720) -> DataFrame:
    """Coverage, completeness and traded value of the newest rows of each symbol."""
    hours = ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 3600).cast("long") + 1
    a = df.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / hours).alias("completeness"))
    pos = scan.number_rows(df).join(a.select("symbol", F.col("n").alias("_n")), "symbol").where(F.col("_pos") >= F.col("_n") - last_rows)
    return a.join(pos.groupBy("symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("traded")), "symbol")


def bridge(pairs: DataFrame, a: str, b: str, keys: Sequence[str], min_days: int = 60, bps: float = 30.0, corr: float = 0.95) -> DataFrame:
    """Do two venues quote the same thing? Median absolute return difference, tracking error,
    correlation and the verdict."""
    d = pairs.withColumn("_d", F.abs(F.col(a) - F.col(b)) * 1e4)
    med = scan.quantiles(d, keys, "_d", [0.5], ["median_bps"])
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp(F.col(a) - F.col(b)) * 1e4).alias("tracking_bps"), F.corr(a, b).alias("corr")).join(med, list(keys))
    return g.withColumn("same", (F.col("n") >= min_days) & (F.col("median_bps") <= bps) & (F.col("corr") >= corr))


def corpus_report(df: DataFrame, keep, end_days: int = 45) -> DataFrame:
    """Universe size, exclusions, symbols that stopped trading, and suspects of a reused name
    (a hole longer than the limit)."""
    last = df.agg(F.max("ts").alias("_last"))
    g = scan.over_series(df, lambda d, w: d.withColumn("_gap", F.datediff("ts", F.lag("ts").over(w))), back=1, chunk="year")
    s = g.groupBy("symbol").agg(F.max("ts").alias("_end"), F.max("_gap").alias("_hole")).withColumn("_keep", keep)
    s = s.crossJoin(F.broadcast(last))  # one-row side
    dead = F.datediff("_last", "_end") > end_days
    return s.agg(F.count_if(F.col("_keep")).alias("universe"), F.count_if(~F.col("_keep")).alias("excluded"),
                 F.count_if(F.col("_keep") & dead).alias("dead"), F.count_if(F.col("_keep") & (F.col("_hole") > end_days)).alias("reuse_suspects"))


__all__ = ["candles", "features", "month_holes", "duplicates_and_gaps", "volume_audit", "bridge", "corpus_report", "ts"]
