"""Signals to weights, orders and period economics. A date's sums are map-side aggregates joined
back; weights are sparse rows, so a symbol that is not held costs nothing."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import rules
from tideline.operators import cross, scan, stats
from tideline.operators import timeseries as ts
from tideline.operators.timeseries import ratio

# Cost model of the evaluations.
FEE, SLIPPAGE = 0.0036, 0.0010
ROUND_TRIP = 2 * 0.0005
FUNDING_BUFFER, FUNDING_28D = 0.001, 0.0084
VOL_FLOOR = 1e-4
MIN_WEIGHT = 0.005
SLICE_BARS = {"excess": 0.0, "drop_best": 0.0, "auc": 0.52}
SPREAD_BARS = {"mean": 0.0, "positive": 0.55}
BARS = {"mean": 1.0, "worst_year": -1.5, "crash_2021": -3.0, "when_down": 0.0}


# ---- weights -------------------------------------------------------------------------------------
def long_only(day: DataFrame, keys: Sequence[str], k: int, threshold: float, p: str = "p", vol: str = "rv") -> DataFrame:
    """p over the threshold, k best, weight proportional to p / vol, summing to one per key."""
    sel = cross.top_k(day.where(F.col(p) > threshold), keys, p, k)
    sel = sel.withColumn("_raw", F.col(p) / F.greatest(F.col(vol), F.lit(VOL_FLOOR)))
    d = scan.with_group(sel, keys, _s=F.sum("_raw"))
    return d.withColumn("w", F.col("_raw") / F.col("_s")).drop("_raw", "_s", "rank")


def target_weights(sig: DataFrame, keys: Sequence[str], short_cap: float = 0.10) -> DataFrame:
    """confidence / vol shares, SELL negative; shorts alone are scaled down to the cap."""
    d = sig.where(F.col("direction").isin("BUY", "SELL") & (F.col("confidence") > 0))
    d = d.withColumn("_raw", F.col("confidence") / F.greatest(F.coalesce("vol", F.lit(0.0)), F.lit(VOL_FLOOR)))
    short = F.col("direction") == "SELL"
    d = scan.with_group(d, keys, _s=F.sum("_raw"), _sh=F.sum(F.when(short, F.col("_raw")).otherwise(0.0)))
    w, gross = F.col("_raw") / F.col("_s"), F.col("_sh") / F.col("_s")
    cut = F.when(gross > short_cap, short_cap / F.nullif(gross, F.lit(0.0))).otherwise(1.0)
    return d.withColumn("w", F.when(short, -w * cut).otherwise(w)).drop("_raw", "_s", "_sh")


def legs(day: DataFrame, keys: Sequence[str], k: int, mode: str = "ew", p: str = "p", vol: str = "sigma") -> DataFrame:
    """k best long and k worst short, half the gross each, equal or inverse-vol inside a leg."""
    top = cross.top_k(day, keys, p, k).withColumn("side", F.lit(1))
    bot = cross.top_k(day, keys, p, k, largest=False).withColumn("side", F.lit(-1))
    both = top.unionByName(bot).drop("rank")
    raw = F.lit(1.0) if mode == "ew" else 1 / F.greatest(F.col(vol), F.lit(1e-6))
    d = scan.with_group(both.withColumn("_raw", raw), [*keys, "side"], _s=F.sum("_raw"))
    return d.withColumn("w", 0.5 * F.col("side") * F.col("_raw") / F.col("_s")).drop("_raw", "_s")


def vol_scaled(day: DataFrame, keys: Sequence[str], sign: str = "sign", sigma: str = "sigma", target: float = 0.25,
               cap: float = 1.0) -> DataFrame:
    """sign x target/sigma spread over the active names, gross scaled down to the cap."""
    ok = day.where((F.col(sign) != 0) & (F.col(sigma) > 0))
    ok = ok.withColumn("_raw", F.col(sign) * (target / 365 ** 0.5) / F.col(sigma))
    d = scan.with_group(ok, keys, _n=F.count(F.lit(1)), _g=F.sum(F.abs("_raw")))
    gross = F.col("_g") / F.col("_n")
    scale = F.when(gross > cap, cap / gross).otherwise(1.0)
    return d.withColumn("w", F.col("_raw") / F.col("_n") * scale).drop("_raw", "_n", "_g")


# ---- orders --------------------------------------------------------------------------------------
def brake(approved: Column, verdict: Column, conviction: Column) -> Column:
    """Struct (freeze, mult): a veto or HOLD freezes the book, else conviction clamped to [0, 1]."""
    stop = ~approved | (verdict == "HOLD")
    return F.struct(stop.alias("freeze"), F.when(stop, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), conviction))).alias("mult"))


def rebalance(targets: DataFrame, book: DataFrame, keys: Sequence[str], budget: Column, mult: Column | float = 1.0,
              band: float = 0.05, reserve: float = 0.0, freeze: Column | None = None) -> DataFrame:
    """Orders that move the book (signed ``current_usd``) to the target weights; changes inside the
    band are HOLD, a frozen book trades nothing."""
    j = targets.select(*keys, "symbol", "w").join(book.select(*keys, "symbol", "current_usd"), [*keys, "symbol"], "full")
    m = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mult if isinstance(mult, Column) else F.lit(mult)))
    free = freeze if freeze is not None else F.lit(False)
    cur = F.round(F.coalesce("current_usd", F.lit(0.0)), 4)
    tgt = F.when(free, cur).otherwise(F.round(F.greatest(budget, F.lit(0.0)) * m * (1 - reserve) * F.coalesce("w", F.lit(0.0)), 4))
    d = j.withColumns({"current_usd": cur, "target_usd": tgt}).withColumn("_d", F.round(F.col("target_usd") - F.col("current_usd"), 4))
    act = F.when(free | (F.abs("_d") < budget * band), "HOLD").when(F.col("_d") > 0, "BUY").otherwise("SELL")
    return d.withColumns({"action": act, "size_usd": F.when(free, 0.0).otherwise(F.abs("_d"))}).drop("_d", "w")


def pocket_cap(orders: DataFrame, keys: Sequence[str], cash: DataFrame, min_trade: Column | float, reserve: float = 0.0) -> DataFrame:
    """Buys of a funding pocket scaled to its cash plus what its own sells free."""
    sells = F.sum(F.when(F.col("action") == "SELL", F.col("size_usd")).otherwise(0.0)) * (1 - reserve)
    need = F.sum(F.when(F.col("action") == "BUY", F.col("size_usd")).otherwise(0.0))
    d = scan.with_group(orders, [*keys, "pocket"], _sells=sells, _need=need).join(cash, [*keys, "pocket"], "left")
    have = F.greatest(F.lit(0.0), F.coalesce("cash", F.lit(0.0))) + F.col("_sells")
    scale = F.when(F.col("_need") > have, have / F.nullif(F.col("_need"), F.lit(0.0))).otherwise(1.0)
    buy = F.col("action") == "BUY"
    sized = F.when(buy, F.when(scale < 1, F.round(F.col("size_usd") * scale, 4)).otherwise(F.col("size_usd"))).otherwise(F.col("size_usd"))
    drop = buy & (scale < 1) & ((sized < min_trade) | (have <= 0))
    return d.withColumns({"size_usd": F.when(drop, 0.0).otherwise(sized), "action": F.when(drop, "HOLD").otherwise(F.col("action"))}).drop(
        "_sells", "_need", "cash")


# ---- window economics -----------------------------------------------------------------------
def benchmark(day: DataFrame, keys: Sequence[str], ret: str = "fwd", cost: float = ROUND_TRIP) -> DataFrame:
    return day.groupBy(*keys).agg((F.avg(ret) - cost).alias("bench"), F.count(F.lit(1)).alias("n_universe"))


def book_economics(weights: DataFrame, day: DataFrame, keys: Sequence[str], style: str, ret: str = "fwd", cost: float = ROUND_TRIP) -> DataFrame:
    """Net result per key of a held book. ``style``: neutral (round trip on gross plus a funding
    buffer), tsmom (round trip on gross plus funding on net exposure), long (entry and exit)."""
    pnl, gross, net = F.sum(F.col("w") * F.col(ret)), F.sum(F.abs("w")), F.sum("w")
    charge = {"neutral": cost * gross + FUNDING_BUFFER, "tsmom": cost * gross + FUNDING_28D * F.abs(net), "long": cost * gross}[style]
    g = weights.groupBy(*keys).agg(
        (pnl - charge).alias("net"), gross.alias("gross"), net.alias("net_exposure"),
        F.sum(F.when(F.col("w") > 0, F.col("w") * F.col(ret)).otherwise(0.0)).alias("long_leg"),
        F.sum(F.when(F.col("w") < 0, F.col("w") * F.col(ret)).otherwise(0.0)).alias("short_leg"),
        F.count_if(F.col("w") > 0).alias("n_long"), F.count_if(F.col("w") < 0).alias("n_short"))
    return benchmark(day, keys, ret, cost).join(g, list(keys), "left")


def price_exit_economics(weights: DataFrame, paths: DataFrame, exits: DataFrame, day: DataFrame, keys: Sequence[str], h: int,
                         cost: float = ROUND_TRIP) -> DataFrame:
    """As the neutral book, with each leg closed at its own exit day and funding prorated."""
    d = weights.join(exits, ["symbol", *keys])
    fund = F.sum(F.abs("w") * FUNDING_BUFFER * F.col("exit_day") / h)
    g = d.groupBy(*keys).agg(
        (F.sum(F.col("w") * F.col("exit_ret")) - cost * F.sum(F.abs("w")) - fund).alias("net"),
        F.count_if(F.col("early") & (F.col("w") * F.col("exit_ret") > 0)).alias("n_take_profit"),
        F.count_if(F.col("early") & (F.col("w") * F.col("exit_ret") <= 0)).alias("n_stop"), F.avg("exit_day").alias("mean_exit_day"))
    return g.join(benchmark(day, keys, cost=cost), list(keys))


# ---- rebalanced series ------------------------------------------------------------------------
def indexed_dates(day: DataFrame, keys: Sequence[str], chunk: str) -> DataFrame:
    return scan.number_rows(day.select(*keys, "ts").distinct(), list(keys) or ["_g"], ["ts"], chunk, "_k")


def turnover(weights: DataFrame, dates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of absolute weight changes against the previous date. Each weight is also booked with
    the opposite sign one date later, so no dense date x symbol grid is ever built."""
    w = weights.select(*keys, "ts", "symbol", "w").join(dates, [*keys, "ts"]).select(*keys, "_k", "symbol", "w")
    moved = w.unionByName(w.select(*keys, (F.col("_k") + 1).alias("_k"), "symbol", (-F.col("w")).alias("w")))
    t = moved.groupBy(*keys, "_k", "symbol").agg(F.sum("w").alias("_d")).groupBy(*keys, "_k").agg(F.sum(F.abs("_d")).alias("turnover"))
    return dates.join(t, [*keys, "_k"], "left").select(*keys, "ts", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def clipped(day: DataFrame, stop: float | None, take: float | None, ret: str = "fwd") -> DataFrame:
    """Return after a stop (checked first) or a target inside the bar, and whether one fired."""
    lo = (F.col("fwd_low") <= -stop) if stop is not None else F.lit(False)
    hi = (F.col("fwd_high") >= take) if take is not None else F.lit(False)
    lo, hi = F.coalesce(lo, F.lit(False)), F.coalesce(hi, F.lit(False))
    r = F.when(lo, -(stop or 0.0)).when(hi, take or 0.0).otherwise(F.col(ret))
    return day.withColumns({"realised": r, "early": lo | hi})


def rebalanced(weights: DataFrame, day: DataFrame, keys: Sequence[str], chunk: str = "month", cost: float = FEE + SLIPPAGE,
               ret: str = "fwd") -> DataFrame:
    """Net return per date of rebalancing to ``weights``; dates without positions count too. An
    ``early`` flag on the day's rows charges one more exit for the triggered weight."""
    keys = list(keys)
    dates = indexed_dates(day, keys, chunk)
    extra = F.sum(F.when(F.col("early"), F.col("w")).otherwise(0.0)) if "early" in day.columns else F.lit(0.0)
    cols = [*keys, "ts", "symbol", F.coalesce(F.col(ret), F.lit(0.0)).alias("_r"), *(["early"] if "early" in day.columns else [])]
    g = weights.select(*keys, "ts", "symbol", "w").join(day.select(*cols), [*keys, "ts", "symbol"], "left").groupBy(*keys, "ts").agg(
        F.sum(F.col("w") * F.coalesce("_r", F.lit(0.0))).alias("_gross"), extra.alias("_extra"))
    b = day.groupBy(*keys, "ts").agg(F.avg(ret).alias("bench"))
    d = turnover(weights, dates, keys).join(g, [*keys, "ts"], "left").join(b, [*keys, "ts"], "left")
    net = F.coalesce("_gross", F.lit(0.0)) - cost * (F.col("turnover") + F.coalesce("_extra", F.lit(0.0)))
    return d.withColumn("net", net).drop("_gross", "_extra")


def smooth(weights: DataFrame, dates: DataFrame, keys: Sequence[str], alpha: float, floor: float = MIN_WEIGHT) -> DataFrame:
    """w = alpha*target + (1-alpha)*previous, dust dropped each step. Path-dependent per (key,
    symbol); only the steps where a target exists are rows, decay in between is closed form."""
    keys = list(keys)
    w = weights.select(*keys, "ts", "symbol", F.col("w").alias("_t")).join(dates, [*keys, "ts"])
    top = dates.groupBy(*keys).agg(F.max("_k").alias("_end")) if keys else None
    w = w.join(top, keys)
    schema = T.StructType([*[weights.schema[k] for k in keys], T.StructField("_k", T.LongType()), weights.schema["symbol"], T.StructField("w", T.DoubleType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        target = dict(zip(pdf["_k"].tolist(), pdf["_t"].tolist(), strict=True))
        end, k, cur, rows = int(pdf["_end"].iloc[0]), int(pdf["_k"].iloc[0]), 0.0, []
        marks = sorted(target)
        nxt = 0
        while k <= end:
            cur = alpha * target.get(k, 0.0) + (1 - alpha) * cur
            if cur < floor:
                cur = 0.0
            else:
                rows.append((k, cur))
            while nxt < len(marks) and marks[nxt] <= k:
                nxt += 1
            if cur == 0.0:
                if nxt >= len(marks):
                    break
                k = marks[nxt]
            else:
                k += 1
        head = [pdf[c].iloc[0] for c in keys]
        sym = pdf["symbol"].iloc[0]
        return pd.DataFrame([[*head, kk, sym, v] for kk, v in rows], columns=[f.name for f in schema.fields])

    out = w.groupBy(*keys, "symbol").applyInPandas(fold, schema)
    return out.join(dates, [*keys, "_k"]).select(*keys, "ts", "symbol", "w")


def performance(series: DataFrame, keys: Sequence[str], per_year: float, cost: float = FEE + SLIPPAGE, chunk: str = "month",
                min_obs: int = 10, trials: int = 1) -> DataFrame:
    """Report per key from (ts, net, bench, turnover): mean, total, Sharpe, its probability against 0 and against the
    best of ``trials`` tries, drawdown, hit rate, profit factor, benchmark with one entry cost, excess."""
    keys = list(keys)
    eq = ts.drawdown(ts.compound(series, "net", keys=keys, chunk=chunk), "equity", keys=keys, chunk=chunk)
    dd = eq.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    r = F.col("net")
    wins, losses = F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))
    g = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), (F.product(1 + r) - 1).alias("total"),
        (ratio(F.avg(r), F.stddev_samp(r)) * per_year ** 0.5).alias("sharpe"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        ratio(wins, losses).alias("profit_factor"), (F.avg("bench") - cost / F.count(F.lit(1))).alias("bench_mean"), F.avg("turnover").alias("turnover"))
    likely = stats.psr(series, keys, "net").select(*keys, "psr").join(stats.deflated(series, keys, "net", trials).select(*keys, "dsr"), keys)
    return g.where(F.col("n") >= min_obs).join(dd, keys).join(likely, keys).withColumn("excess", F.col("mean") - F.col("bench_mean"))


def evaluate_signals(sig: DataFrame, keys: Sequence[str], fee: float, ret: str = "fwd", short_cap: float = 0.10) -> DataFrame:
    """Per-date result of a signal table: allocate, realise, charge a round trip on the gross."""
    w = target_weights(sig, keys, short_cap).where(F.col(ret).isNotNull())
    return w.groupBy(*keys).agg(
        (F.sum(F.col("w") * F.col(ret)) - 2 * fee * F.sum(F.abs("w"))).alias("net"), F.sum(F.abs("w")).alias("gross"), F.count(F.lit(1)).alias("n"))


def momentum_signals(df: DataFrame, past: str, full: float = 0.20) -> DataFrame:
    side = F.when(F.col(past) > 0, "BUY").when(F.col(past) < 0, "SELL").otherwise("HOLD")
    return df.withColumns({"direction": side, "confidence": F.least(F.abs(past) / full, F.lit(0.95))})


# ---- path-dependent book ---------------------------------------------------------------------
ROLL_SCHEMA = "portfolio string, ts timestamp_ntz, equity double, net double, traded double, fee double"


def roll_forward(rows: DataFrame, fee: float, band: float = 0.05, short_cap: float = 0.10) -> DataFrame:
    """Stateful book per portfolio over rows (portfolio, ts, symbol, direction, confidence, vol, ret, mult).

    Target weights are those of ``target_weights``, one distributed pass for all dates. Only what depends on the path is
    folded, one row per date with the date's assets as arrays: holdings move to their targets where the gap reaches
    the band (a share of equity), trades cost ``fee``, and what is held earns the date's return."""
    keys = ["portfolio", "ts"]
    weights = target_weights(rows, keys, short_cap).select(*keys, "symbol", "w")
    asset = F.struct("symbol", F.coalesce("w", F.lit(0.0)).alias("w"), "ret")
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.first("mult"), F.lit(1.0))))
    days = rows.join(weights, [*keys, "symbol"], "left").groupBy(*keys).agg(scale.alias("scale"), F.array_sort(F.collect_list(asset)).alias("assets"))
    days = days.select(*keys, "scale", "assets.symbol", "assets.w", "assets.ret")

    def fold(batches):
        owner, slots, held, equity = None, {}, np.zeros(0), 1.0
        for pdf in batches:
            out = []
            for portfolio, ts, size, symbols, w, ret in pdf.itertuples(index=False, name=None):
                if portfolio != owner:
                    owner, slots, held, equity = portfolio, {}, np.zeros(0), 1.0
                at = np.array([slots.setdefault(s, len(slots)) for s in symbols])
                held = np.concatenate([held, np.zeros(len(slots) - len(held))])
                target, earned = np.zeros((2, len(slots)))
                target[at] = equity * size * np.asarray(w, float)
                earned[at] = np.nan_to_num(np.asarray(ret, float))
                gap = np.round(target, 4) - np.round(held, 4)
                trade = np.where(np.abs(gap) >= band * equity, gap, 0.0)
                traded = float(np.abs(trade).sum())
                held = held + trade
                held[np.abs(held) < 1e-12] = 0.0
                gain = held * earned
                before, equity = equity, equity - fee * traded + float(gain.sum())
                held = held + gain
                out.append((portfolio, ts, equity, equity / before - 1 if before else 0.0, traded, fee * traded))
            yield pd.DataFrame(out, columns=["portfolio", "ts", "equity", "net", "traded", "fee"])

    return scan.streamed(days, ["portfolio"], ["ts"], fold, ROLL_SCHEMA)


# ---- verdicts --------------------------------------------------------------------------------
def window_bars(windows: DataFrame, keys: Sequence[str], from_year: int = 2022) -> DataFrame:
    """Acceptance bars per key over (t0, net_pct, bench_pct): median and mean, every year, the
    crash year, and the median when the benchmark fell."""
    keys = list(keys)
    late = windows.where(F.year("t0") >= from_year)
    med = scan.quantiles(late, keys, "net_pct", [0.5], ["median"])
    down = scan.quantiles(late.where("bench_pct < 0"), keys, "net_pct", [0.5], ["median_down"])
    mean = late.groupBy(*keys).agg(F.avg("net_pct").alias("mean"))
    year = late.groupBy(*keys, F.year("t0").alias("_y")).agg(F.avg("net_pct").alias("_m")).groupBy(*keys).agg(F.min("_m").alias("worst_year"))
    crash = windows.where(F.year("t0") == from_year - 1).groupBy(*keys).agg(F.avg("net_pct").alias("crash"))
    d = med.join(mean, keys).join(year, keys).join(crash, keys, "left").join(down, keys, "left")
    w1 = (F.col("median") > 0) & (F.col("mean") >= BARS["mean"])
    w2 = F.col("worst_year") >= BARS["worst_year"]
    w3 = F.coalesce(F.col("crash") >= BARS["crash_2021"], F.lit(True))
    w4 = F.coalesce(F.col("median_down") >= BARS["when_down"], F.lit(False))
    return d.withColumns({"w1": w1, "w2": w2, "w3": w3, "w4": w4, "verdict": w1 & w2 & w3 & w4})


def slice_long(series: DataFrame, keys: Sequence[str], min_obs: int = 8, cost: float = FEE + SLIPPAGE) -> DataFrame:
    """Per phase of a slice from (ts, net, bench): mean excess over a benchmark that pays one entry, the same without its
    best period, profit factor. Phases under ``min_obs`` periods are left out."""
    keys = list(keys)
    d = scan.with_group(series, keys, _t0=F.min("ts"))
    r = F.col("net")
    d = d.withColumn("_e", r - F.col("bench") + F.when(F.col("ts") == F.col("_t0"), cost).otherwise(0.0))
    wins, losses = F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("excess"), drop_best_mean("_e").alias("drop_best"), ratio(wins, losses).alias("profit_factor"))
    return g.where(F.col("n") >= min_obs)


def drop_best_mean(x: str) -> Column:
    """Mean without the single best period."""
    return ratio(F.sum(x) - F.max(x), (F.count(x) - 1).cast("double"))


def consensus(opinions: DataFrame, keys: Sequence[str], vote: str = "vote") -> DataFrame:
    """More bullish than bearish opinions buy, fewer sell, a tie holds."""
    g = opinions.groupBy(*keys).agg(F.count_if(F.col(vote) == "BULLISH").alias("bullish"), F.count_if(F.col(vote) == "BEARISH").alias("bearish"))
    b, s = F.col("bullish"), F.col("bearish")
    return g.withColumn("consensus", F.when(b > s, "BUY").when(s > b, "SELL").otherwise("HOLD"))


def guardrail_points(sig: DataFrame, capital: float, kelly: Column, limit: Column, hours: int = 168) -> DataFrame:
    """Action, modulated size, VaR approval and signed forward result of each signal row; HOLD
    rows make no point."""
    d = sig.where("action <> 'HOLD'")
    d = d.withColumn("mod_conf", rules.news_modulate(F.col("confidence"), F.col("action"), F.col("label"), F.col("trust")))
    d = d.withColumn("size", rules.kelly_size(F.col("mod_conf"), capital, kelly, F.lit(0.0)))
    d = d.withColumn("approved", (F.col("size") > 0) & rules.var_ok(F.col("vol"), F.col("size"), capital, limit, hours))
    signed = F.when(F.col("action") == "BUY", F.col("fwd")).otherwise(-F.col("fwd"))
    return d.withColumns({"result": signed, "profitable": signed > 0})
