"""From candles to the gold signal row of every symbol, for the latest bar or many stamps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import hurst, joins, scan
from tideline.operators import timeseries as ts


def silver(candles: DataFrame, hurst_window: int = 200, garch_window: int = 500, refit: int = 24, chunk: str = "month") -> DataFrame:
    """Returns, range ratio, rolling Hurst with its regime, and conditional volatility, for all
    symbols in one job."""
    d = ts.returns(candles, chunk=chunk).withColumnRenamed("ret_1", "ret")
    d = d.withColumn("spread", rules.range_ratio(F.col("high"), F.col("low"), F.col("close")))
    d = hurst.rolling_hurst(d, hurst_window, chunk=chunk)
    d = hurst.rolling_garch(d, window=garch_window, refit=refit, chunk=chunk)
    r = rules.regime(F.col("hurst"))
    return d.withColumns({"regime": r["label"], "regime_conf": F.when(F.col("hurst").isNotNull(), r["confidence"])})


def silver_tail(candles: DataFrame, tail_hours: int = 48, context_hours: int = 550, **kw) -> DataFrame:
    """Recomputes only the newest hours of each symbol from enough context before them."""
    d = scan.with_group(candles, ["symbol"], _max=F.max("ts"))
    d = d.withColumn("_cut", F.col("_max") - F.expr(f"interval {tail_hours} hours"))
    part = d.where(F.col("ts") > F.col("_cut") - F.expr(f"interval {context_hours} hours"))
    cuts = part.select("symbol", "_cut").distinct()
    return silver(part.drop("_max", "_cut"), **kw).join(cuts, "symbol").where(F.col("ts") > F.col("_cut")).drop("_cut")


def gold_columns(candles: DataFrame, n: int = 24, chunk: str = "month") -> DataFrame:
    """Per-bar gold inputs that need no rolling fit: 1h return, summed return and range ratio."""
    d = ts.sum_of_returns(candles, n, chunk=chunk)
    return d.withColumn("spread", rules.range_ratio(F.col("high"), F.col("low"), F.col("close")))


def gold_row(d: DataFrame, strength: Column, at: str = "ts") -> DataFrame:
    """Named regime, confidence and rounded features of a bar."""
    r = rules.regime(strength)
    return d.select(
        "symbol", at, rules.lookup(r["label"], rules.REGIME_NAMES).alias("regime"), (r["confidence"] + 0.0).alias("regime_conf"),
        (F.round("ret", 6) + 0.0).alias("returns_1h"), (F.round("ret_sum", 6) + 0.0).alias("returns_24h"), (F.round("spread", 6) + 0.0).alias("spread"))


def gold_latest(candles: DataFrame, strength: Column, n: int = 24, chunk: str = "month") -> DataFrame:
    return gold_row(ts.latest(gold_columns(candles, n, chunk)), strength)


def gold_as_of(candles: DataFrame, stamps: DataFrame, strength: Column, n: int = 24, chunk: str = "month") -> DataFrame:
    """Gold rows for every (symbol, stamp): an as-of join against the stamp table, not a loop."""
    g = gold_columns(candles, n, chunk)
    probe = symbol_stamps(candles, stamps)
    hit = joins.as_of(probe, g, ["symbol"], ["ret", "ret_sum", "spread"], chunk=chunk).where("asof_ts IS NOT NULL")
    return gold_row(hit, strength)


def symbol_stamps(candles: DataFrame, stamps: DataFrame) -> DataFrame:
    """Every symbol at every stamp; the stamps travel as one array value (one per calendar step)."""
    arr = stamps.agg(F.array_sort(F.collect_set("ts")).alias("_s"))
    u = candles.select("symbol").distinct().withColumn("_g", F.lit(0))
    return u.join(F.broadcast(arr.withColumn("_g", F.lit(0))), "_g").select("symbol", F.explode("_s").alias("ts"))


def multiscale(candles: DataFrame, probe: DataFrame, hours: Sequence[int] = (168, 336, 720, 2160), chunk: str = "month") -> DataFrame:
    """Sign vote of calendar look-back returns at each probe (symbol, ts)."""
    past = [f"_p{h}" for h in hours]
    d = joins.as_of_many(probe, candles, "close", [0, *[-h for h in hours]], ["_now", *past], chunk)
    d = d.withColumns({f"ret_{h}h": ts.ratio(F.col("_now"), F.col(f"_p{h}")) - 1 for h in hours}).drop(*past)
    v = rules.multiscale_vote([F.col(f"ret_{h}h") for h in hours])
    return d.withColumn("_v", v).select(*[c for c in d.columns if c != "_now"], "_v.*")


def point_matrix(candles: DataFrame, probe: DataFrame, moms: Sequence[int], horizon: int, sigma: DataFrame, vol_floor: float = 1e-4,
                 chunk: str = "month") -> DataFrame:
    """Research points: momenta at several calendar scales, as-of volatility, target in units of
    sigma*sqrt(h), and one dummy per symbol but the first. Points with a missing part are dropped."""
    past = [f"_p{h}" for h in moms]
    d = joins.as_of_many(probe, candles, "close", [0, horizon, *[-h for h in moms]], ["_now", "px", *past], chunk)
    d = d.withColumns({f"mom_{h}h": ts.ratio(F.col("_now"), F.col(f"_p{h}")) - 1 for h in moms}).drop(*past)
    d = joins.as_of(d, sigma, ["symbol"], ["sigma"], chunk=chunk).drop("asof_ts")
    d = d.withColumn("fwd", ts.ratio(F.col("px"), F.col("_now")) - 1)
    d = d.withColumn("y", F.col("fwd") / F.greatest(F.col("sigma") * (horizon ** 0.5), F.lit(vol_floor)))
    return d.drop("px", "_now").dropna()


def dummies(df: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Drop-first one-hot of a configured universe."""
    return df.withColumns({f"dum_{s}": (F.col("symbol") == s).cast("double") for s in sorted(symbols)[1:]})


def carry_features(series: DataFrame, rate: str, hours: int = 168, window: int = 2160, per_year: float = 1.0,
                   chunk: str = "month") -> DataFrame:
    """Level, calendar-window z-score and change over ``hours`` of a rate series."""
    d = ts.calendar_moments(series, rate, [window])
    d = joins.as_of_offset(d, rate, f"{hours} hours", "_old", chunk=chunk)
    m, s = F.col(f"mean_{window}h"), F.col(f"std_{window}h")
    return d.withColumns({
        "level": F.col(rate) * per_year,
        "z": F.when(s > 1e-12, (F.col(rate) - m) / F.nullif(s, F.lit(0.0))),
        "change": (F.col(rate) - F.col("_old")) * per_year}).drop("_old", f"mean_{window}h", f"std_{window}h")
