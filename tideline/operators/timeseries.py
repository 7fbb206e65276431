"""Per-series operators on candles keyed (symbol, ts). Bounded frames run on pieces of a
series (see ``scan``), so every function here holds for a symbol of any length."""
from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import scan


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def ieee_ratio(num: Column, den: Column) -> Column:
    """num / den as floating-point numbers have it: infinite over zero, NaN for zero over zero, null only for nulls."""
    return F.when(den == 0, num * F.pow(den, F.lit(-1.0))).otherwise(ratio(num, den))


# ---- column builders used inside scan.over_series ---------------------------------------------
def lag_return(x: str | Column, k: int, w) -> Column:
    """Simple return over the last k rows."""
    return ratio(c(x), F.lag(c(x), k).over(w)) - 1


def log_return(x: str | Column, w) -> Column:
    q = ratio(c(x), F.lag(c(x), 1).over(w))
    return F.when(q > 0, F.log(q))


def frame(w, back: int):
    return w.rowsBetween(-(back - 1), 0)


def roll(fn, x: str | Column, n: int, w, min_rows: int | None = None) -> Column:
    """Rolling aggregate over the last n rows, null until min_rows non-null values are there."""
    v = c(x)
    need = n if min_rows is None else min_rows
    return F.when(F.count(v).over(frame(w, n)) >= need, fn(v).over(frame(w, n)))


def zscore(x: str | Column, n: int, w, min_rows: int | None = None) -> Column:
    """(x - rolling mean) / rolling sample std, null when the window is constant."""
    v = c(x)
    sd = roll(F.stddev_samp, v, n, w, min_rows)
    return F.when(sd > 0, (v - roll(F.avg, v, n, w, min_rows)) / F.nullif(sd, F.lit(0.0)))


def rolling_median(x: str | Column, n: int, w, min_rows: int | None = None) -> Column:
    return roll(lambda v: F.percentile(v, 0.5), x, n, w, min_rows)


def lead_return(x: str | Column, h: int, w) -> Column:
    """Positional forward return: the h-th later row."""
    return ratio(F.lead(c(x), h).over(w), c(x)) - 1


# ---- whole operators ---------------------------------------------------------------------------
def returns(candles: DataFrame, lags: Sequence[int] = (1,), **kw) -> DataFrame:
    def build(d, w):
        return d.withColumns(
            {"log_ret": log_return("close", w), **{f"ret_{k}": lag_return("close", k, w) for k in lags}}
        )

    return scan.over_series(candles, build, back=max(lags), **kw)


def sum_of_returns(candles: DataFrame, n: int = 24, **kw) -> DataFrame:
    """Sum of the simple returns of the last n rows (not compounded)."""

    def build(d, w):
        d = d.withColumn("ret", lag_return("close", 1, w))
        return d.withColumn("ret_sum", F.sum("ret").over(frame(w, n)))

    return scan.over_series(candles, build, back=n + 1, **kw)


def latest(df: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """Newest row per key as one map-side aggregate."""
    rest = [x for x in df.columns if x not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    ).select(*df.columns)


def ewma_rows(alpha: float) -> int:
    """Rows until the weight of an exponential average is below the last bit of a double."""
    return ceil(-53 * log(2) / log(1 - alpha))


def ewma_std_series(df: DataFrame, x: str, alpha: float, name: str, min_rows: int = 10, rows: int | None = None, chunk: str = "month") -> DataFrame:
    """Exponentially weighted, bias-corrected standard deviation over all rows up to each one, from decayed sums;
    a null row ages the weights and adds nothing."""
    known, v, a = F.col(x).isNotNull().cast("double"), F.coalesce(F.col(x), F.lit(0.0)), 1 - alpha
    d = scan.decayed_sums(df, {"_s0": (a, known), "_s1": (a, v), "_s2": (a, v * v), "_q0": (a * a, known), "_k": (1.0, known)}, rows=rows, chunk=chunk)
    mean = F.col("_s1") / F.nullif("_s0", F.lit(0.0))
    var = F.col("_s2") / F.nullif("_s0", F.lit(0.0)) - mean * mean
    room = F.nullif(F.col("_s0") * F.col("_s0") - F.col("_q0"), F.lit(0.0))
    std = F.sqrt(F.greatest(F.lit(0.0), var * F.col("_s0") * F.col("_s0") / room))
    return d.withColumn(name, F.when(F.col("_k") >= min_rows, std)).drop("_s0", "_s1", "_s2", "_q0", "_k")


def ewma_std(x: str | Column, alpha: float, w, n: int | None = None, min_rows: int = 10) -> Column:
    """Exponentially weighted, bias-corrected standard deviation as a column of a bounded frame: the rows whose weight
    a double can still show (or the last n)."""
    n = n or ewma_rows(alpha)
    past = F.reverse(F.filter(F.collect_list(F.struct(c(x).alias("v"))).over(frame(w, n)), lambda s: s["v"].isNotNull()))
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("s0", "s1", "s2", "q0")], F.lit(1.0).alias("g"))

    def step(a, e):
        g, v = a["g"], e["v"]
        return F.struct(
            (a["s0"] + g).alias("s0"), (a["s1"] + g * v).alias("s1"), (a["s2"] + g * v * v).alias("s2"),
            (a["q0"] + g * g).alias("q0"), (g * (1 - alpha)).alias("g"),
        )

    def finish(a):
        mean = a["s1"] / F.nullif(a["s0"], F.lit(0.0))
        var = a["s2"] / F.nullif(a["s0"], F.lit(0.0)) - mean * mean
        denom = a["s0"] * a["s0"] - a["q0"]
        return F.sqrt(F.greatest(F.lit(0.0), var * a["s0"] * a["s0"] / F.nullif(denom, F.lit(0.0))))

    return F.when(F.size(past) >= min_rows, F.aggregate(past, start, step, finish))


def ewma_variance(returns: DataFrame, ret: str, lam: float = 0.94, seed_rows: int = 20, **kw) -> DataFrame:
    """v[t] = lam*v[t-1] + (1-lam)*r[t]^2 from the last of the ``seed_rows`` rows on, seeded by the
    population variance of those rows. Adds ``ewma_var`` (null before)."""
    d = scan.number_rows(returns, name="_i", chunk=kw.get("chunk", "month"))
    head = d.where(F.col("_i") < seed_rows).groupBy("symbol").agg(F.var_pop(ret).alias("_v0"))
    d = scan.attach(d, head, ["symbol"])
    a = F.when(F.col("_i") < seed_rows - 1, 0.0).otherwise(lam)
    b = F.when(F.col("_i") < seed_rows - 1, F.col("_v0")).otherwise((1 - lam) * F.col(ret) * F.col(ret))
    out = scan.affine_scan(d, a, b, "ewma_var", **kw)
    return out.withColumn("ewma_var", F.when(F.col("_i") >= seed_rows - 1, F.col("ewma_var"))).drop("_i", "_v0")


def exposure(var: Column, target: float = 0.25, per_year: int = 365) -> Column:
    """Volatility-target multiplier min(1, target / annualised sigma)."""
    sigma = F.sqrt(var * per_year)
    return F.when(sigma > 0, F.least(F.lit(1.0), target / F.nullif(sigma, F.lit(0.0)))).when(var.isNotNull(), F.lit(1.0))


def drawdown(curve: DataFrame, value: str = "equity", **kw) -> DataFrame:
    """Adds the running peak and value/peak - 1."""
    d = scan.running(curve, [("max", F.col(value), "peak")], **kw)
    return d.withColumn("drawdown", ratio(F.col(value), F.col("peak")) - 1)


def compound(returns: DataFrame, ret: str, name: str = "equity", **kw) -> DataFrame:
    """Running product of 1+r in log space; r <= -1 is a total loss from there on."""
    safe = F.when(F.col(ret) > -1, F.log1p(F.col(ret)))
    lost = F.when(F.col(ret) <= -1, 1).otherwise(0)
    d = scan.running(returns, [("sum", safe, "_lg"), ("max", lost, "_dead")], **kw)
    return d.withColumn(name, F.when(F.col("_dead") == 1, 0.0).otherwise(F.exp("_lg"))).drop("_lg", "_dead")


def calendar_fill(series: DataFrame, value: str, unit: str = "day", keys: Sequence[str] = (), chunk: str = "month") -> DataFrame:
    """One row per calendar step between first and last observation, values carried forward."""
    keys = list(keys)
    span = series.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    step = F.expr(f"interval 1 {unit}")
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias("ts"))
    joined = grid.join(series.select(*keys, "ts", value), [*keys, "ts"], "left")
    return scan.running(joined, [("last", F.col(value), "_v")], keys, ["ts"], chunk).select(
        *keys, "ts", F.col("_v").alias(value)
    )


def gaps(candles: DataFrame, step_seconds: int, factor: float = 3.0, **kw) -> DataFrame:
    """Rows whose distance to the previous row exceeds factor steps."""

    def build(d, w):
        secs = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts", 1).over(w))
        return d.withColumn("gap_seconds", secs)

    return scan.over_series(candles, build, back=1, **kw).where(F.col("gap_seconds") > factor * step_seconds)


def last_per_day(curve: DataFrame, keys: Sequence[str] = ("symbol",), tie: Sequence[str] = ()) -> DataFrame:
    rest = [x for x in curve.columns if x not in keys]
    day = F.to_date("ts").alias("day")
    return curve.groupBy(*keys, day).agg(F.max_by(F.struct(*rest), F.struct("ts", *tie)).alias("_r")).select(
        *keys, "day", "_r.*"
    )


def calendar_moments(df: DataFrame, value: str, hours: Sequence[int], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean, population std and count over the last h hours (calendar frame) for each h. A piece is a stretch of time
    as long as the longest frame, with a copy of the stretch before it, so a frame is whole however many rows it holds."""
    from pyspark.sql import Window

    at, width = F.unix_timestamp("ts"), max(hours) * 3600
    own = F.floor(at / width)
    d = df.withColumn("_own", own).withColumn("_blk", F.explode(F.array(own, own + 1)))
    by_time = Window.partitionBy(*keys, "_blk").orderBy(at)
    for h in hours:
        f = by_time.rangeBetween(-h * 3600, 0)
        d = d.withColumns({f"mean_{h}h": F.avg(value).over(f), f"std_{h}h": F.stddev_pop(value).over(f), f"n_{h}h": F.count(value).over(f)})
    return d.where(F.col("_own") == F.col("_blk")).drop("_own", "_blk")


def sequences(df: DataFrame, channels: Sequence[str], n: int, name: str = "seq", **kw) -> DataFrame:
    """Sliding [n, channels] array ending at each row; null unless n rows without a null."""

    def build(d, w):
        item = F.array(*[F.col(x).cast("float") for x in channels])
        return d.withColumn(name, F.collect_list(item).over(frame(w, n)))

    out = scan.over_series(df, build, back=n, **kw)
    whole = (F.size(name) == n) & ~F.exists(name, lambda r: F.exists(r, lambda v: v.isNull()))
    return out.withColumn(name, F.when(whole, F.col(name)))


def context_and_future(df: DataFrame, value: str, past: int, future: int, **kw) -> DataFrame:
    """Two arrays per row: the last ``past`` values and the next ``future`` values."""

    def build(d, w):
        v = F.col(value).cast("float")
        return d.withColumns({
            "context": F.collect_list(v).over(w.rowsBetween(-(past - 1), 0)),
            "future": F.collect_list(v).over(w.rowsBetween(1, future)),
        })

    out = scan.over_series(df, build, back=past, ahead=future, **kw)
    return out.where((F.size("context") == past) & (F.size("future") == future))


def future_overlaps(df: DataFrame, flag: str, h: int, **kw) -> DataFrame:
    """True when any of the next h rows carries the flag, or when fewer than h rows follow."""

    def build(d, w):
        nxt = w.rowsBetween(1, h)
        return d.withColumn(
            "overlaps", (F.count(F.lit(1)).over(nxt) < h) | F.coalesce(F.max(F.col(flag)).over(nxt), F.lit(True))
        )

    return scan.over_series(df, build, ahead=h, **kw)


def forward_path(df: DataFrame, h: int, **kw) -> DataFrame:
    """One row per (symbol, ts, day 1..h): cumulative return from the anchor close, with the
    reference rate's move compounded in when the panel has an ``fx`` column."""

    has_fx = "fx" in df.columns
    item = F.struct(F.col("close").alias("c"), (F.col("fx") if has_fx else F.lit(None).cast("double")).alias("f"))

    def build(d, w):
        return d.withColumn("_p", F.collect_list(item).over(w.rowsBetween(1, h)))

    d = scan.over_series(df, build, ahead=h, **kw)
    d = d.select("*", F.posexplode("_p").alias("_d", "_e"))
    r = ratio(F.col("_e.c"), F.col("close"))
    if has_fx:
        r = r * F.coalesce(ratio(F.col("_e.f"), F.col("fx")), F.lit(1.0))
    return d.withColumns({"day": F.col("_d") + 1, "path_ret": r - 1}).drop("_p", "_d", "_e")


def leg_exit(paths: DataFrame, k: float, side: str = "side", sigma: str = "sigma") -> DataFrame:
    """First day whose signed path leaves +-k*sigma, else the last day; null sigma never exits."""
    signed = F.col("path_ret") * F.col(side)
    hit = F.col(sigma).isNotNull() & (F.abs(signed) >= k * F.col(sigma))
    row = F.struct("day", "path_ret", hit.alias("early"))
    return paths.groupBy("symbol", "ts").agg(
        F.coalesce(F.min_by(row, F.when(hit, F.col("day"))), F.max_by(row, "day")).alias("_r")
    ).select(
        "symbol", "ts", F.col("_r.day").alias("exit_day"), F.col("_r.path_ret").alias("exit_ret"),
        F.coalesce(F.col("_r.early"), F.lit(False)).alias("early"),
    )
