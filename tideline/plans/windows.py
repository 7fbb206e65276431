"""Series windows on hourly candles, the weekly panel and derived series."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import aggregates, cross, scan
from tideline.operators import timeseries as ts
from tideline.plans import views as v
from tideline.plans.registry import query, rnd, rsql

H = "PARTITION BY symbol ORDER BY ts"
RET = f"SELECT *, close / lag(close) OVER ({H}) - 1 AS ret FROM hourly"


@query("W01_returns", f"""WITH {v.HOURLY}
SELECT symbol, ts, {rsql(f'close / lag(close) OVER ({H}) - 1')} AS ret_1,
  {rsql(f'ln(close / lag(close) OVER ({H}))')} AS log_ret FROM hourly""")
def _(t):
    return ts.returns(v.hourly(t)).select("symbol", "ts", rnd("ret_1").alias("ret_1"), rnd("log_ret").alias("log_ret"))


@query("W02_trailing_returns", f"""WITH {v.PANEL}
SELECT symbol, ts, {rsql(f'close / lag(close, 5) OVER ({H}) - 1')} AS ret_5,
  {rsql(f'close / lag(close, 21) OVER ({H}) - 1')} AS ret_21 FROM panel""")
def _(t):
    return ts.returns(v.panel(t), (5, 21), chunk="year").select(
        "symbol", "ts", rnd("ret_5").alias("ret_5"), rnd("ret_21").alias("ret_21"))


@query("W03_rolling_sum_24", f"""WITH {v.HOURLY}, r AS ({RET})
SELECT symbol, ts, {rsql(f'sum(ret) OVER ({H} ROWS 23 PRECEDING)', 4)} AS ret_sum FROM r""")
def _(t):
    return ts.sum_of_returns(v.hourly(t), 24).select("symbol", "ts", rnd("ret_sum", 4).alias("ret_sum"))


@query("W04_latest_row", f"""WITH {v.HOURLY}
SELECT symbol, ts, close, n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) k FROM hourly) WHERE k = 1""")
def _(t):
    return ts.latest(v.hourly(t)).select("symbol", "ts", "close", "n")


@query("W05_rolling_zscore", f"""WITH {v.PANEL}, s AS (
  SELECT symbol, ts, volume, avg(volume) OVER w AS m, stddev_samp(volume) OVER w AS sd, count(volume) OVER w AS k
  FROM panel WINDOW w AS ({H} ROWS 29 PRECEDING))
SELECT symbol, ts, CASE WHEN k >= 30 AND sd > 0 THEN {rsql('(volume - m) / sd')} END AS vol_z30 FROM s""")
def _(t):
    d = scan.over_series(v.panel(t), lambda d, w: d.withColumn("z", ts.zscore("volume", 30, w)), back=30, chunk="year")
    return d.select("symbol", "ts", rnd("z").alias("vol_z30"))


@query("W06_realised_vol", f"""WITH {v.PANEL}, r AS (SELECT symbol, ts, close / lag(close) OVER ({H}) - 1 AS ret FROM panel),
s AS (SELECT symbol, ts, stddev_samp(ret) OVER w AS sd, count(ret) OVER w AS k FROM r WINDOW w AS ({H} ROWS 19 PRECEDING))
SELECT symbol, ts, CASE WHEN k >= 10 THEN {rsql('sd')} END AS rv_20 FROM s""")
def _(t):
    def build(d, w):
        d = d.withColumn("r", ts.lag_return("close", 1, w))
        return d.withColumn("rv_20", ts.roll(F.stddev_samp, "r", 20, w, 10))
    return scan.over_series(v.panel(t), build, back=21, chunk="year").select("symbol", "ts", rnd("rv_20").alias("rv_20"))


@query("W07_rolling_median_30", f"""WITH {v.PANEL}
SELECT symbol, ts, CASE WHEN count(quote_volume) OVER w >= 30 THEN {rsql('median(quote_volume) OVER w', 4)} END AS liq
FROM panel WINDOW w AS ({H} ROWS 29 PRECEDING)""")
def _(t):
    d = scan.over_series(v.panel(t), lambda d, w: d.withColumn("liq", ts.rolling_median("quote_volume", 30, w)), back=30, chunk="year")
    return d.select("symbol", "ts", rnd("liq", 4).alias("liq"))


@query("W08_ewma_std", f"""WITH {v.PANEL}, r AS (SELECT symbol, ts, row_number() OVER ({H}) AS i,
  close / lag(close) OVER ({H}) - 1 AS x FROM panel),
s AS (SELECT a.symbol, a.ts, count(b.x) k, sum(power(0.94e0, a.i - b.i)) s0, sum(power(0.94e0, a.i - b.i) * b.x) s1,
    sum(power(0.94e0, a.i - b.i) * b.x * b.x) s2, sum(power(0.94e0, 2 * (a.i - b.i))) q0
  FROM r a LEFT JOIN r b ON a.symbol = b.symbol AND b.i <= a.i AND b.x IS NOT NULL GROUP BY 1, 2)
SELECT symbol, ts, CASE WHEN k >= 10 THEN {rsql('sqrt((s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - q0))', 5)} END AS ewma_vol FROM s""")
def _(t):
    r = scan.over_series(v.panel(t), lambda d, w: d.withColumn("r", ts.lag_return("close", 1, w)), back=1, chunk="year").select("symbol", "ts", "r")
    return ts.ewma_std_series(r, "r", 0.06, "e", rows=1024, chunk="year").select("symbol", "ts", rnd("e", 5).alias("ewma_vol"))


EWMA = f"""r AS (SELECT symbol, ts, ret, row_number() OVER ({H}) - 1 AS i FROM ({RET}) WHERE ret IS NOT NULL),
  v0 AS (SELECT symbol, var_pop(ret) AS v0 FROM r WHERE i < 20 GROUP BY 1),
  ev AS (SELECT a.symbol, a.ts, a.i, a.ret, power(0.94e0, a.i - 18) * any_value(v0.v0)
      + sum(0.06e0 * power(0.94e0, a.i - b.i) * b.ret * b.ret) AS var
    FROM r a JOIN v0 USING (symbol) JOIN r b ON a.symbol = b.symbol AND b.i BETWEEN 19 AND a.i
    WHERE a.i >= 19 GROUP BY a.symbol, a.ts, a.i, a.ret)"""


def small_returns(t):
    """Hourly returns scaled down by 100, without the first row of a symbol."""
    return ts.returns(v.hourly(t)).where(F.col("ret_1").isNotNull()).select("symbol", "ts", F.col("ret_1").alias("ret"))


@query("W09_ewma_variance", f"WITH {v.HOURLY}, {EWMA} SELECT symbol, ts, {rsql('var', 4)} AS ewma_var FROM ev")
def _(t):
    d = ts.ewma_variance(small_returns(t), "ret", rows=256)
    return d.where(F.col("ewma_var").isNotNull()).select("symbol", "ts", rnd("ewma_var", 4).alias("ewma_var"))


FWD = f"fw AS (SELECT *, lead(close) OVER ({H}) / close - 1 AS fwd FROM panel)"


def forward(t, h=1):
    return scan.over_series(v.panel(t), lambda d, w: d.withColumn("fwd", ts.lead_return("close", h, w)), ahead=h, chunk="year")


@query("W10_ranks_asc_desc", f"""WITH {v.PANEL}, {FWD}
SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY fwd, symbol) AS rank_asc,
  row_number() OVER (PARTITION BY ts ORDER BY fwd DESC, symbol DESC) AS rank_desc FROM fw WHERE fwd IS NOT NULL""")
def _(t):
    d = cross.ranks(forward(t).where("fwd IS NOT NULL"), ["ts"], "fwd")
    return d.select("symbol", "ts", "rank_asc", "rank_desc")


@query("W11_rank_percentile", f"""WITH {v.PANEL}
SELECT symbol, ts, {rsql('row_number() OVER (PARTITION BY ts ORDER BY volume, symbol) / CAST(count(*) OVER (PARTITION BY ts) AS DOUBLE)')} AS pct FROM panel""")
def _(t):
    d = cross.ranks(v.panel(t), ["ts"], "volume")
    return d.select("symbol", "ts", rnd(F.col("rank_asc") / F.col("n_group")).alias("pct"))


@query("W12_age", f"WITH {v.PANEL} SELECT symbol, ts, row_number() OVER ({H}) - 1 AS age FROM panel")
def _(t):
    return scan.number_rows(v.panel(t), chunk="year", name="age").select("symbol", "ts", "age")


@query("W13_quintiles_per_month", f"""WITH {v.USER_DAILY}, m AS (
  SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, sum(quote_volume) AS x FROM user_daily GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY x, symbol) - 1 AS k, count(*) OVER (PARTITION BY month) AS n FROM m)
SELECT symbol, month, CAST(floor(k * 5.0 / n) AS BIGINT) + 1 AS quintile FROM r""")
def _(t):
    m = v.ticks(t, "user_id").groupBy("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(
        aggregates.exact_sum("price").alias("x"))
    return cross.buckets(m, ["month"], "x", 5, "quintile").select("symbol", "month", "quintile")


@query("W14_tercile_midrank", f"""WITH {v.PANEL}, r AS (SELECT symbol, ts, n AS x,
  rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS mr, count(*) OVER () AS tot FROM panel)
SELECT symbol, ts, CASE WHEN mr / tot <= 1.0/3 THEN 'low' WHEN mr / tot <= 2.0/3 THEN 'mid' ELSE 'high' END AS tercile FROM r""")
def _(t):
    return cross.terciles(v.panel(t), "n").select("symbol", "ts", "tercile")


@query("W15_lead_returns", f"""WITH {v.PANEL}
SELECT symbol, ts, {rsql(f'lead(close, 4) OVER ({H}) / close - 1')} AS fwd_ret,
  {rsql(f'lead(high, 1) OVER ({H}) / close - 1')} AS fwd_high, {rsql(f'lead(low, 1) OVER ({H}) / close - 1')} AS fwd_low FROM panel""")
def _(t):
    def build(d, w):
        return d.withColumns({"fwd_ret": ts.lead_return("close", 4, w),
                              "fwd_high": ts.ratio(F.lead("high", 1).over(w), F.col("close")) - 1,
                              "fwd_low": ts.ratio(F.lead("low", 1).over(w), F.col("close")) - 1})
    d = scan.over_series(v.panel(t), build, ahead=4, chunk="year")
    return d.select("symbol", "ts", *[rnd(x).alias(x) for x in ("fwd_ret", "fwd_high", "fwd_low")])


@query("W16_calendar_fill", f"""WITH s AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS fx FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
g AS (SELECT CAST(unnest(generate_series((SELECT min(ts) FROM s), (SELECT max(ts) FROM s), INTERVAL 1 DAY)) AS TIMESTAMP) AS ts)
SELECT ts, {rsql('last_value(fx IGNORE NULLS) OVER (ORDER BY ts)', 8)} AS fx FROM g LEFT JOIN s USING (ts)""")
def _(t):
    s = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("fx"))
    return ts.calendar_fill(s, "fx").select("ts", rnd("fx", 8).alias("fx"))


@query("W17_drawdown", f"""WITH {v.PANEL}
SELECT symbol, ts, {rsql(f'close / max(close) OVER ({H} ROWS UNBOUNDED PRECEDING) - 1')} AS drawdown FROM panel""")
def _(t):
    return ts.drawdown(v.panel(t), "close", chunk="year").select("symbol", "ts", rnd("drawdown").alias("drawdown"))


@query("W18_equity_curve", f"""WITH {v.PANEL}, r AS (SELECT symbol, ts, (close / lag(close) OVER ({H}) - 1) / 1000 AS ret FROM panel)
SELECT symbol, ts, {rsql(f'exp(sum(ln(1 + ret)) OVER ({H} ROWS UNBOUNDED PRECEDING))')} AS equity FROM r WHERE ret IS NOT NULL""")
def _(t):
    d = ts.returns(v.panel(t), chunk="year").withColumn("ret", F.col("ret_1") / 1000).where("ret IS NOT NULL")
    return ts.compound(d, "ret", chunk="year").select("symbol", "ts", rnd("equity").alias("equity"))


@query("W19_gaps", f"""WITH {v.HOURLY}, g AS (SELECT symbol, ts, CAST(epoch(ts) - epoch(lag(ts) OVER ({H})) AS BIGINT) AS gap_seconds FROM hourly)
SELECT * FROM g WHERE gap_seconds > 3600""")
def _(t):
    return ts.gaps(v.hourly(t), 3600, 1.0).select("symbol", "ts", "gap_seconds")


@query("W20_last_point_per_day", """SELECT symbol, day, ts, equity FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, ts, value AS equity,
  row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) k FROM events) WHERE k = 1""")
def _(t):
    e = t.events.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("equity"))
    return ts.last_per_day(e, tie=["event_id"]).select("symbol", "day", "ts", "equity")


@query("W21_sequences", f"""WITH {v.PANEL}, s AS (SELECT symbol, ts, count(*) OVER w k, sum(CAST(close AS FLOAT)) OVER w a, sum(CAST(volume AS FLOAT)) OVER w b
  FROM panel WINDOW w AS ({H} ROWS 15 PRECEDING))
SELECT symbol, ts, {rsql('a', 1)} AS close_sum, {rsql('b', 1)} AS volume_sum FROM s WHERE k = 16""")
def _(t):
    d = ts.sequences(v.panel(t), ["close", "volume"], 16, chunk="year").where("seq IS NOT NULL")
    tot = lambda i: F.aggregate("seq", F.lit(0.0), lambda a, e: a + e[i].cast("double"))
    return d.select("symbol", "ts", rnd(tot(0), 1).alias("close_sum"), rnd(tot(1), 1).alias("volume_sum"))


@query("W22_context_and_future", f"""WITH {v.PANEL}, s AS (SELECT symbol, ts, count(*) OVER p kp, count(*) OVER f kf,
  sum(CAST(close AS FLOAT)) OVER p a, sum(CAST(close AS FLOAT)) OVER f b FROM panel
  WINDOW p AS ({H} ROWS 63 PRECEDING), f AS ({H} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))
SELECT symbol, ts, {rsql('a', 1)} AS context_sum, {rsql('b', 1)} AS future_sum FROM s WHERE kp = 64 AND kf = 12""")
def _(t):
    d = ts.context_and_future(v.panel(t), "close", 64, 12, chunk="year")
    tot = lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + e.cast("double"))
    return d.select("symbol", "ts", rnd(tot("context"), 1).alias("context_sum"), rnd(tot("future"), 1).alias("future_sum"))


@query("W23_future_overlap_flag", f"""WITH {v.PANEL}, p AS (SELECT symbol, ts, month(ts) = 6 AS is_val FROM panel)
SELECT symbol, ts, (count(*) OVER w < 4) OR coalesce(max(CAST(is_val AS INT)) OVER w, 1) = 1 AS overlaps
FROM p WINDOW w AS ({H} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def _(t):
    p = v.panel(t).withColumn("is_val", F.month("ts") == 6)
    return ts.future_overlaps(p, "is_val", 4, chunk="year").select("symbol", "ts", "overlaps")


@query("W24_calendar_range_moments", f"""WITH {v.HOURLY}
SELECT symbol, ts, {rsql('avg(close) OVER a', 5)} AS mean_24h, {rsql('stddev_pop(close) OVER b', 5)} AS std_168h, count(*) OVER b AS n_168h
FROM hourly WINDOW a AS ({H} RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW),
  b AS ({H} RANGE BETWEEN INTERVAL 604800 SECOND PRECEDING AND CURRENT ROW)""")
def _(t):
    d = ts.calendar_moments(v.hourly(t), "close", [24, 168])
    return d.select("symbol", "ts", rnd("mean_24h", 5).alias("mean_24h"), rnd("std_168h", 5).alias("std_168h"), "n_168h")


@query("W25_lagged_liquidity_stratum", f"""WITH {v.PANEL}, l AS (SELECT symbol, ts, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month,
  CASE WHEN count(quote_volume) OVER w >= 8 THEN median(quote_volume) OVER w END AS liq FROM panel WINDOW w AS ({H} ROWS 7 PRECEDING)),
m AS (SELECT symbol, CAST(month + INTERVAL 1 MONTH AS TIMESTAMP) AS month, arg_max(liq, ts) AS liq FROM l WHERE liq IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY liq, symbol) - 1 AS k, count(*) OVER (PARTITION BY month) AS n FROM m)
SELECT symbol, month, CAST(floor(k * 5.0 / n) AS BIGINT) + 1 AS quintile FROM r WHERE n >= 5""")
def _(t):
    return cross.liquidity_strata(v.panel(t), rows=8, chunk="year").select("symbol", "month", "quintile")


PATH = f"""pth AS (SELECT a.symbol, a.ts, b.i - a.i AS day,
    (b.close / a.close) * coalesce(b.fx / a.fx, 1) - 1 AS path_ret FROM px a JOIN px b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 4)"""
PX = f"px AS (SELECT p.symbol, p.ts, p.close, fx.fx, row_number() OVER (PARTITION BY p.symbol ORDER BY p.ts) AS i FROM panel p LEFT JOIN fx USING (ts))"


def paths(t, h=4):
    return ts.forward_path(v.panel(t).join(v.fx(t), "ts", "left"), h, chunk="year")


@query("W27_forward_path", f"WITH {v.PANEL}, {v.FX}, {PX}, {PATH} SELECT symbol, ts, day, {rsql('path_ret')} AS path_ret FROM pth")
def _(t):
    return paths(t).select("symbol", "ts", F.col("day").cast("long").alias("day"), rnd("path_ret").alias("path_ret"))


@query("W26_first_threshold_exit", f"""WITH {v.PANEL}, {v.FX}, {PX}, {PATH},
f AS (SELECT symbol, ts, min(day) FILTER (abs(path_ret) >= 0.5) AS hit, max(day) AS lst FROM pth GROUP BY 1, 2)
SELECT symbol, ts, coalesce(hit, lst) AS exit_day, {rsql('path_ret')} AS exit_ret, hit IS NOT NULL AS early
FROM f JOIN pth USING (symbol, ts) WHERE day = coalesce(hit, lst)""")
def _(t):
    d = paths(t).withColumns({"side": F.lit(1), "sigma": F.lit(0.5)})
    return ts.leg_exit(d, 1.0).select("symbol", "ts", F.col("exit_day").cast("long").alias("exit_day"),
                                      rnd("exit_ret").alias("exit_ret"), "early")
