"""Candle building: ticks or finer candles to one row per (symbol, bucket)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(ts: str | Column, unit: str) -> Column:
    """Calendar bucket anchored at 00:00 UTC, kept time-zone free."""
    return F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def resample(
    ticks: DataFrame, unit: str, tie: Sequence[str] = (), price: str = "price", size: str | None = None
) -> DataFrame:
    """First/max/min/last/sum per bucket from single-price ticks. Every aggregate combines on
    the map side, so a symbol holding a third of the ticks costs one partial row per task."""
    at = F.struct("ts", *tie)
    px = F.col(price)
    units = F.col(size) if size else F.lit(1.0)
    return ticks.groupBy("symbol", bucket("ts", unit).alias("bar")).agg(
        F.min_by(px, at).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, at).alias("close"),
        F.sum(units).alias("volume"),
        F.sum(px * units).alias("quote_volume"),
        F.count(F.lit(1)).alias("n"),
    ).withColumnRenamed("bar", "ts")


def roll_up(candles: DataFrame, unit: str, min_rows: int = 1) -> DataFrame:
    """Candles to coarser candles; buckets made of fewer than ``min_rows`` candles are dropped."""
    return (
        candles.groupBy("symbol", bucket("ts", unit).alias("bar"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_candles"),
        )
        .where(F.col("n_candles") >= min_rows)
        .withColumnRenamed("bar", "ts")
    )


def last_close(candles: DataFrame, unit: str) -> DataFrame:
    return candles.groupBy("symbol", bucket("ts", unit).alias("bar")).agg(
        F.max_by("close", "ts").alias("close")
    ).withColumnRenamed("bar", "ts")
