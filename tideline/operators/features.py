"""Catalogue of causal features. A feature is a Column builder over one shared window, so a
whole matrix costs one exchange by symbol; cross-sectional members add one by date."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import cross, scan
from tideline.operators import timeseries as ts


@dataclass(frozen=True)
class Candidate:
    """``build(w)`` gives the column from base columns; ``across(df, name)`` post-processes per date."""

    name: str
    group: str
    rationale: str
    lookback: int
    build: Callable[[object], Column] | None = None
    across: Callable[[DataFrame, str], DataFrame] | None = field(default=None)


# Columns several features share, built first on the same window.
BASE: Mapping[str, Callable[[object], Column]] = {
    "_r1": lambda w: ts.lag_return("close", 1, w),
    "_r5": lambda w: ts.lag_return("close", 5, w),
    "_hl": lambda w: rules.range_ratio(F.col("high"), F.col("low"), F.col("close")),
    "_ma20": lambda w: ts.roll(F.avg, "close", 20, w, 20),
}


def _trailing(k: int) -> Candidate:
    return Candidate(f"ret_{k}d", "momentum", f"return over the last {k} bars", k, lambda w: ts.lag_return("close", k, w))


def _above_average(df: DataFrame, name: str) -> DataFrame:
    above = F.when(F.col("_ma20").isNotNull(), (F.col("close") > F.col("_ma20")).cast("double"))
    return df.join(df.groupBy("ts").agg(F.avg(above).alias(name)), "ts")


def catalogue(market_symbol: str) -> list[Candidate]:
    def market(df: DataFrame, name: str) -> DataFrame:
        m = df.where(F.col("symbol") == market_symbol).select("ts", F.col("_r1").alias(name))
        return df.join(m, "ts", "left")

    def relative(df: DataFrame, name: str) -> DataFrame:
        return cross.minus_median(df, ["ts"], "_r5", name)

    return [
        *[_trailing(k) for k in (1, 2, 3, 5, 10, 21, 63)],
        Candidate("abs_ret_1d", "momentum", "size of the last move", 1, lambda w: F.abs("_r1")),
        Candidate("ret_5d_z60", "momentum", "5-bar return against its own history", 66, lambda w: ts.zscore("_r5", 60, w, 60)),
        Candidate("hl_range", "volatility", "bar range relative to close", 0, lambda w: F.col("_hl")),
        Candidate("hl_range_z30", "volatility", "range against its own history", 31, lambda w: ts.zscore("_hl", 30, w, 30)),
        Candidate("vol_z30", "activity", "volume against its own history", 31, lambda w: ts.zscore("volume", 30, w, 30)),
        Candidate("rv_20d", "volatility", "realised volatility", 21, lambda w: ts.roll(F.stddev_samp, "_r1", 20, w, 10)),
        Candidate("rel_ret_5d", "cross-section", "return against the date's median", 5, across=relative),
        Candidate("market_ret_1d", "cross-section", "move of the market symbol", 1, across=market),
        Candidate("breadth_20d", "cross-section", "share of symbols above their 20-bar mean", 20, across=_above_average),
        Candidate("vol_rel", "activity", "log volume against its 20-bar mean", 20,
                  lambda w: F.log(F.greatest(ts.ratio(F.col("volume"), ts.roll(F.avg, "volume", 20, w, 5)), F.lit(1e-3)))),
        Candidate("dow", "calendar", "weekday, Monday 0", 0, lambda w: rules.weekday(F.col("ts")).cast("double")),
        Candidate("quincena", "calendar", "pay-day flag", 0, lambda w: rules.pay_day(F.col("ts")).cast("double")),
        Candidate("ewma_vol_20", "volatility", "exponentially weighted volatility", ts.ewma_rows(0.06) + 1, lambda w: ts.ewma_std("_r1", 0.06, w)),
        Candidate("usdmxn_ret_5d", "reference rate", "move of the reference rate", 5,
                  lambda w: ts.lag_return("fx", 5, w)),
    ]


def pick(items: Sequence[Candidate], names: Sequence[str]) -> list[Candidate]:
    return [c for c in items if c.name in set(names)]


def matrix(panel: DataFrame, items: Sequence[Candidate], keys: Sequence[str] = ("symbol",), chunk: str = "month",
           keep_base: bool = False) -> DataFrame:
    """Panel plus one column per candidate."""
    series = [c for c in items if c.build is not None]
    back = max([c.lookback for c in items] + [20]) + 1

    def build(d, w):
        d = d.withColumns({n: b(w) for n, b in BASE.items()})
        return d.withColumns({c.name: c.build(w) for c in series}) if series else d

    d = scan.over_series(panel, build, keys=keys, back=back, chunk=chunk)
    for c in items:
        if c.across is not None:
            d = c.across(d, c.name)
    return d if keep_base else d.drop(*BASE)


def canary(panel: DataFrame, items: Sequence[Candidate], every: int = 9, rtol: float = 1e-4, chunk: str = "month") -> DataFrame:
    """Look-ahead test: each feature at sampled dates must not change when everything after the
    date is removed. All cut-off dates run in one job, as an extra key of the series."""
    items = [c for c in items if c.across is None]
    depth = max(2 * c.lookback for c in items) + 40
    dates = cross.numbered_dates(panel, "_k")
    cuts = dates.where((F.col("_k") % every == every - 1)).select(F.col("ts").alias("cut"), F.col("_k").alias("_ck"))
    reach = cuts.select("cut", F.explode(F.sequence(F.greatest(F.col("_ck") - depth, F.lit(0)), F.col("_ck"))).alias("_k"))
    part = panel.join(dates.join(reach, "_k").drop("_k"), "ts")
    names = [c.name for c in items]
    cut = matrix(part, items, keys=("cut", "symbol"), chunk=chunk).where("ts = cut").select("symbol", "ts", *[F.col(n).alias(f"t_{n}") for n in names])
    full = matrix(panel, items, chunk=chunk).select("symbol", "ts", *names)
    j = full.join(cut, ["symbol", "ts"])

    def bad(n: str) -> Column:
        a, b = F.col(n), F.col(f"t_{n}")
        return F.count_if(~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= rtol * F.abs(b) + 1e-12, F.lit(False))))

    wide = j.agg(F.count(F.lit(1)).alias("_n"), *[bad(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col("_n").alias("n_compared"), F.col(n).alias("n_different")) for n in names])
    return wide.select(F.explode(pairs).alias("r")).select("r.*", (F.col("r.n_different") == 0).alias("causal"))
