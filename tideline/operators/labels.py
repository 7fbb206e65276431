"""Forward-looking labels. They only use rows after t, and are null where those are missing."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import cross, joins, scan
from tideline.operators import timeseries as ts


def forward_panel(panel: DataFrame, h: int, **kw) -> DataFrame:
    """fwd_ret over h rows compounded with the reference rate's move (missing rate counts as
    flat), and the next bar's high and low excursions."""
    has_fx = "fx" in panel.columns

    def build(d, w):
        move = ts.lead_return("fx", h, w) if has_fx else F.lit(None).cast("double")
        fx1 = ts.lead_return("fx", 1, w) if has_fx else F.lit(None).cast("double")
        hi = ts.ratio(F.lead("high", 1).over(w), F.col("close")) - 1
        lo = ts.ratio(F.lead("low", 1).over(w), F.col("close")) - 1
        return d.withColumns({
            "fwd_ret": rules.compound_fx(ts.lead_return("close", h, w), move),
            "fwd_high": rules.compound_fx(hi, fx1), "fwd_low": rules.compound_fx(lo, fx1)})

    return scan.over_series(panel, build, ahead=h, **kw)


def absolute(df: DataFrame, threshold: float = 0.01, ret: str = "fwd_ret") -> DataFrame:
    return df.where(F.col(ret).isNotNull()).withColumn("y", (F.col(ret) > threshold).cast("int"))


def relative(df: DataFrame, min_basket: int = 5, ret: str = "fwd_ret") -> DataFrame:
    """1 when the row beats its date's median; null for baskets below the minimum."""
    d = scan.with_group(df, ["ts"], _n=F.count(ret))
    d = cross.minus_median(d, ["ts"], ret, "_x")
    return d.withColumn("y", F.when(F.col("_n") >= min_basket, (F.col("_x") > 0).cast("int"))).drop("_n", "_x")


def extremes(df: DataFrame, k: int = 5, ret: str = "fwd_ret") -> DataFrame:
    """Top k of a date 1, bottom k 0, the middle null; small baskets all null."""
    d = cross.ranks(df.where(F.col(ret).isNotNull()), ["ts"], ret)
    y = F.when(F.col("rank_desc") <= k, 1).when(F.col("rank_asc") <= k, 0)
    return d.withColumn("y", F.when(F.col("n_group") >= 2 * k + 1, y)).drop("rank_asc", "rank_desc", "n_group")


def upper_half(df: DataFrame, ret: str = "fwd_ret") -> DataFrame:
    d = cross.ranks(df.where(F.col(ret).isNotNull()), ["ts"], ret)
    return d.withColumn("y", (F.col("rank_desc") <= F.col("n_group") / 2).cast("int")).drop("rank_asc", "rank_desc", "n_group")


def vol_normalised(panel: DataFrame, hours: int, sigma: str, vol_floor: float = 1e-4, chunk: str = "month") -> DataFrame:
    """Calendar forward return over the horizon in units of sigma*sqrt(h)."""
    ahead = panel.withColumn("_at", F.col("ts") + F.expr(f"interval {hours} hours"))
    d = joins.as_of(ahead, panel.select("symbol", "ts", F.col("close").alias("_fc")), ["symbol"], ["_fc"], at="_at", chunk=chunk)
    end = scan.with_group(panel, ["symbol"], _end=F.max("ts")).select("symbol", "_end").distinct()
    d = d.join(end, "symbol")
    fwd = F.when(F.col("_at") <= F.col("_end"), ts.ratio(F.col("_fc"), F.col("close")) - 1)
    y = fwd / F.greatest(F.col(sigma) * (hours ** 0.5), F.lit(vol_floor))
    return d.withColumns({"fwd_ret": fwd, "y": y}).drop("_at", "_fc", "_end", "asof_ts")
