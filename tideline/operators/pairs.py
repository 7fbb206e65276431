"""Pair spreads from rolling moments: the regression, its residual z-score, half-life and unit-root
statistic are all sums over one window, so no window is ever collected."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import scan
from tideline.operators.timeseries import ratio

# Fixed value: 5 % critical value of the two-variable residual unit-root test with a constant.
CRITICAL_5 = -3.34


def spread_statistics(series: DataFrame, n: int = 90, chunk: str = "month") -> DataFrame:
    """Rows (a, b, ts, value_a, value_b) of log prices, plus beta, z, half_life and df_stat of the
    last n+1 rows."""

    def build(d, w):
        full, prev = w.rowsBetween(-n, 0), w.rowsBetween(-n, -1)
        x, y = F.col("value_b"), F.col("value_a")
        d = d.withColumns({"_da": y - F.lag(y).over(w), "_db": x - F.lag(x).over(w), "_la": F.lag(y).over(w), "_lb": F.lag(x).over(w)})
        beta = ratio(F.covar_pop(y, x).over(full), F.var_pop(x).over(full))
        d = d.withColumns({"_n": F.count(y).over(full), "beta": beta})
        b = F.col("beta")
        var_prev = F.var_pop(y).over(prev) - 2 * b * F.covar_pop(y, x).over(prev) + b * b * F.var_pop(x).over(prev)
        mean_prev = F.avg(y).over(prev) - b * F.avg(x).over(prev)
        # increments inside the window: the first of them starts at its second row
        inc, names = w.rowsBetween(-(n - 1), 0), ("_da", "_db", "_la", "_lb")
        d = d.withColumns({f"_c{p}{q}": F.covar_pop(p, q).over(inc) for i, p in enumerate(names) for q in names[i:]})

        def quad(p: str, q: str, r: str, s: str) -> Column:
            """Covariance over the window of (p - beta*q) with (r - beta*s)."""
            cv = lambda u, v: F.col(f"_c{min(u, v, key=names.index)}{max(u, v, key=names.index)}")
            return cv(p, r) - b * cv(p, s) - b * cv(q, r) + b * b * cv(q, s)

        cross, lag, inc2 = quad("_da", "_db", "_la", "_lb"), quad("_la", "_lb", "_la", "_lb"), quad("_da", "_db", "_da", "_db")
        d = d.withColumns({"_x": cross, "_v": lag, "_w": inc2})
        slope = ratio(F.col("_x"), F.col("_v"))
        rss = F.col("_w") - slope * slope * F.col("_v")
        se = F.sqrt(ratio(F.greatest(rss, F.lit(0.0)), F.col("_v")) / (n - 2))
        return d.withColumns({
            "z": ratio(y - b * x - mean_prev, F.sqrt(F.greatest(var_prev, F.lit(0.0)))),
            "half_life": F.when(slope < -1e-6, math.log(2) / F.nullif(-slope, F.lit(0.0))),
            "df_stat": ratio(slope, se)})

    d = scan.over_series(series, build, keys=("a", "b"), back=n + 1, chunk=chunk)
    return d.where(F.col("_n") == n + 1).select("a", "b", "ts", "value_a", "value_b", "beta", "z", "half_life", "df_stat")


def spread_trades(stats: DataFrame, z_in: float = 2.0, z_out: float = 0.5, hl_min: float = 2, hl_max: float = 30, chunk: str = "month", rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Trades (a, b, entry, exit, direction) of each pair, and its rows with their number ``_pos``.

    Every row that may open a trade looks up its own exit, the first later row whose z is inside ``z_out`` or that lies
    more than two half-lives of the opening row ahead (null: the series ends first); the trades are the rows reached by
    jumping from exit to exit. Rows without z neither open nor close, but count as steps of the calendar."""
    keys, ahead = ["a", "b"], int(2 * hl_max) + 1
    d = scan.number_rows(stats.select("a", "b", "ts", "z", "half_life", "df_stat"), keys, chunk=chunk, name="_day").where("z IS NOT NULL")
    hl, z = F.col("half_life"), F.col("z")

    def closing(d, w):
        later = F.collect_list(F.struct("_pos", "_day", (F.abs(z) < z_out).alias("calm"))).over(w.rowsBetween(1, ahead))
        ends = F.filter(later, lambda r: r["calm"] | (r["_day"] - F.col("_day") > 2 * hl))
        return d.withColumns({"entry": F.col("_pos"), "exit": F.get(ends, F.lit(0))["_pos"]})

    opens = (F.col("df_stat") < CRITICAL_5) & hl.between(hl_min, hl_max) & (F.abs(z) > z_in)
    seen = scan.over_series(d, closing, keys=keys, ahead=ahead, chunk=chunk)
    may = seen.where(opens & ~F.isnan("half_life")).select("a", "b", "ts", "entry", "exit", F.when(z > 0, -1).otherwise(1).alias("direction"))
    may = may.withColumn("_after", F.coalesce(F.col("exit"), F.col("entry") + ahead) + 1)  # an exit row opens nothing
    taken = scan.chain(may, "entry", "_after", keys, chunk=chunk, rows=rows).drop("ts", "_after")
    return taken, scan.number_rows(d, keys, chunk=chunk)


def spread_positions(stats: DataFrame, z_in: float = 2.0, z_out: float = 0.5, hl_min: float = 2, hl_max: float = 30, chunk: str = "month", rows: int | None = None) -> DataFrame:
    """Rows (a, b, ts, direction, z) on which a pair is held (``spread_trades``), the exit's row not included."""
    trades, d = spread_trades(stats, z_in, z_out, hl_min, hl_max, chunk, rows)
    last = F.coalesce(F.col("exit") - 1, F.col("entry") + int(2 * hl_max) + 1)
    held = trades.select("a", "b", "direction", F.explode(F.sequence("entry", last)).alias("_pos"))
    return held.join(d, ["a", "b", "_pos"]).select("a", "b", "ts", "direction", "z")


def neutral_weights(positions: DataFrame) -> DataFrame:
    """Half the book per side, spread over the open pairs, netted per symbol."""
    d = scan.with_group(positions, ["ts"], _n=F.count(F.lit(1)))
    per = 1 / (2.0 * F.col("_n"))
    leg = F.explode(F.array(F.struct(F.col("a").alias("symbol"), (F.col("direction") * per).alias("w")),
                            F.struct(F.col("b").alias("symbol"), (-F.col("direction") * per).alias("w"))))
    return d.select("ts", leg.alias("l")).groupBy("ts", "l.symbol").agg(F.sum("l.w").alias("w"))


def tilt(signals: DataFrame, positions: DataFrame, step: float = 0.10, cap: float = 0.95) -> DataFrame:
    """Confidence up for the cheap leg and down for the dear one, per open pair."""
    up = F.when(F.col("direction") > 0, F.col("a")).otherwise(F.col("b"))
    dn = F.when(F.col("direction") > 0, F.col("b")).otherwise(F.col("a"))
    m = positions.select("ts", F.explode(F.array(F.struct(up.alias("symbol"), F.lit(1 + step).alias("m")), F.struct(dn.alias("symbol"), F.lit(1 - step).alias("m")))).alias("x"))
    m = m.groupBy("ts", "x.symbol").agg(F.product("x.m").alias("_m"))
    d = signals.join(m, ["ts", "symbol"], "left")
    c = F.least(F.lit(cap), F.greatest(F.lit(0.0), F.col("confidence") * F.col("_m")))
    return d.withColumn("confidence", F.coalesce(F.round(c, 4), F.col("confidence"))).drop("_m")
