"""Silver and gold rows, features, labels, splits, fits and scores."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tideline.functions import normal, rules
from tideline.operators import features as ft
from tideline.operators import aggregates, bars, cross, hurst, joins, labels, models, portfolio, scan, signals, splits
from tideline.operators import timeseries as ts
from tideline.plans import views as v
from tideline.plans.registry import query, rnd, rsql
from tideline.session import cut_lineage
from tideline.plans.windows import FWD, forward, small_returns

H = "PARTITION BY symbol ORDER BY ts"
YR = dict(chunk="year")


def with_fx(t):
    return v.panel(t).join(v.fx(t), "ts", "left")


# ---- rolling fits: no SQL form, checked against brute force in tests ---------------------------
@query("M01_silver_feature_pass")
def _(t):
    return signals.silver(v.hourly(t), 200, 500).select("symbol", "ts", "ret", "log_ret", "spread", "hurst", "garch_vol", "regime", "regime_conf")


@query("M02_rolling_hurst")
def _(t):
    return hurst.rolling_hurst(v.hourly(t), 200).select("symbol", "ts", "hurst")


@query("M03_rolling_garch_refit")
def _(t):
    return hurst.rolling_garch(ts.returns(v.hourly(t)), window=500).select("symbol", "ts", "garch_vol")


@query("M03_garch_fixed_parameters", f"""WITH {v.HOURLY}, r AS (SELECT symbol, ts, close / lag(close) OVER ({H}) - 1 AS ret FROM hourly), n AS (SELECT *, row_number() OVER ({H}) AS i FROM r WHERE ret IS NOT NULL)
SELECT a.symbol, a.ts, {rsql('any_value(power(0.8e0, a.i) * 0.01e0) + sum((0.001e0 + 0.1e0 * b.ret * b.ret) * power(0.8e0, a.i - b.i))', 4)} AS garch_var FROM n a JOIN n b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2""")
def _(t):
    return hurst.garch_fixed(small_returns(t), 0.001, 0.1, 0.8, 0.01, rows=256).select("symbol", "ts", rnd("garch_var", 4).alias("garch_var"))


@query("M04_silver_tail_recompute")
def _(t):
    return signals.silver_tail(v.hourly(t), 48, 550, hurst_window=200, garch_window=500).select("symbol", "ts", "ret", "hurst", "garch_vol", "regime")


# ---- catalogue ---------------------------------------------------------------------------------
RETS = [1, 2, 3, 5, 10, 21, 63]
ZS = "CASE WHEN count({x}) OVER {w} >= {n} AND stddev_samp({x}) OVER {w} > 0 THEN ({x} - avg({x}) OVER {w}) / stddev_samp({x}) OVER {w} END"
CATALOGUE = f"""pf AS (SELECT p.*, fx.fx FROM panel p LEFT JOIN fx USING (ts)),
b AS (SELECT *, (high - low) / close AS hl, close / lag(close, 5) OVER ({H}) - 1 AS r5, close / lag(close) OVER ({H}) - 1 AS r1,
  CASE WHEN count(close) OVER w20 >= 20 THEN avg(close) OVER w20 END AS ma20, CASE WHEN count(volume) OVER w20 >= 5 THEN avg(volume) OVER w20 END AS vm20 FROM pf WINDOW w20 AS ({H} ROWS 19 PRECEDING)),
f AS (SELECT symbol, ts, {", ".join(f"close / lag(close, {k}) OVER ({H}) - 1 AS ret_{k}d" for k in RETS)}, abs(r1) AS abs_ret_1d,
  {ZS.format(x='r5', w='w60', n=60)} AS ret_5d_z60, hl AS hl_range, {ZS.format(x='hl', w='w30', n=30)} AS hl_range_z30, {ZS.format(x='volume', w='w30', n=30)} AS vol_z30,
  CASE WHEN count(r1) OVER w20 >= 10 THEN stddev_samp(r1) OVER w20 END AS rv_20d, r5 - median(r5) OVER (PARTITION BY ts) AS rel_ret_5d,
  avg(CASE WHEN ma20 IS NOT NULL THEN CAST(close > ma20 AS INT) END) OVER (PARTITION BY ts) AS breadth_20d, ln(greatest(volume / vm20, 1e-3)) AS vol_rel,
  CAST(isodow(ts) - 1 AS DOUBLE) AS dow, CAST(day(ts) IN (1, 2, 3, 14, 15, 16, 17) AS DOUBLE) AS quincena, fx / lag(fx, 5) OVER ({H}) - 1 AS usdmxn_ret_5d
  FROM b WINDOW w20 AS ({H} ROWS 19 PRECEDING), w30 AS ({H} ROWS 29 PRECEDING), w60 AS ({H} ROWS 59 PRECEDING))"""
NAMES = [f"ret_{k}d" for k in RETS] + ["abs_ret_1d", "ret_5d_z60", "hl_range", "hl_range_z30", "vol_z30", "rv_20d", "rel_ret_5d", "breadth_20d", "vol_rel", "dow", "quincena", "usdmxn_ret_5d"]


@query("M05_M06_feature_matrix", f"""WITH {v.PANEL}, {v.FX}, {CATALOGUE}, m AS (SELECT ts, r1 FROM b WHERE symbol = 'Brand#1')
SELECT symbol, ts, {", ".join(f"{rsql(x, 5)} AS {x}" for x in NAMES)}, {rsql('m.r1', 5)} AS market_ret_1d FROM f LEFT JOIN m USING (ts)""")
def _(t):
    items = ft.pick(ft.catalogue("Brand#1"), NAMES + ["market_ret_1d"])
    d = ft.matrix(with_fx(t), items, **YR)
    return d.select("symbol", "ts", *[rnd(x, 5).alias(x) for x in NAMES + ["market_ret_1d"]])


@query("M05q_hurst_feature")
def _(t):
    return hurst.rolling_hurst(v.panel(t), 100, chunk="year").select("symbol", "ts", "hurst")


@query("M05u_log_prices_at_stamps", f"""WITH {v.HOURLY}, s AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25', INTERVAL 1 DAY)) AS TIMESTAMP) AS ts), p AS (SELECT symbol, s.ts FROM s, (SELECT DISTINCT symbol FROM hourly) u)
SELECT p.symbol, p.ts, {rsql('ln(h.close)')} AS log_px FROM p ASOF LEFT JOIN hourly h ON p.symbol = h.symbol AND p.ts >= h.ts""")
def _(t):
    h = v.hourly(t)
    st = splits.stamps(h.where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25 01:00:00").cast("timestamp_ntz"))))
    d = joins.as_of(signals.symbol_stamps(h, st), h, ["symbol"], ["close"])
    return d.select("symbol", "ts", rnd(F.log("close")).alias("log_px"))


# ---- labels --------------------------------------------------------------------------------------
@query("M07_absolute_label", f"WITH {v.PANEL}, {FWD} SELECT symbol, ts, CAST(fwd > 0.01 AS INTEGER) AS y FROM fw WHERE fwd IS NOT NULL")
def _(t):
    return labels.absolute(forward(t), ret="fwd").select("symbol", "ts", "y")


@query("M08_relative_label", f"WITH {v.PANEL}, {FWD} SELECT symbol, ts, CASE WHEN count(fwd) OVER (PARTITION BY ts) >= 5 THEN CAST(fwd - median(fwd) OVER (PARTITION BY ts) > 0 AS INTEGER) END AS y FROM fw")
def _(t):
    return labels.relative(forward(t), ret="fwd").select("symbol", "ts", "y")


@query("M09_extremes_label", f"""WITH {v.PANEL}, {FWD}, r AS (SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY fwd, symbol) a, count(*) OVER (PARTITION BY ts) n FROM fw WHERE fwd IS NOT NULL)
SELECT symbol, ts, CASE WHEN n < 11 THEN NULL WHEN n + 1 - a <= 5 THEN 1 WHEN a <= 5 THEN 0 END AS y FROM r""")
def _(t):
    return labels.extremes(forward(t), 5, ret="fwd").select("symbol", "ts", "y")


@query("M10_realised_half_label", f"""WITH {v.PANEL}, {FWD}, r AS (SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY fwd DESC, symbol DESC) a, count(*) OVER (PARTITION BY ts) n FROM fw WHERE fwd IS NOT NULL)
SELECT symbol, ts, CAST(a <= n / 2 AS INTEGER) AS y FROM r""")
def _(t):
    return labels.upper_half(forward(t), ret="fwd").select("symbol", "ts", "y")


@query("M11_forward_panel", f"""WITH {v.PANEL}, {v.FX}, p AS (SELECT p.*, fx.fx FROM panel p LEFT JOIN fx USING (ts)), l AS (SELECT *, lead(close, 4) OVER ({H}) / close - 1 AS r, coalesce(lead(fx, 4) OVER ({H}) / fx - 1, 0) AS m, coalesce(lead(fx) OVER ({H}) / fx - 1, 0) AS m1, lead(high) OVER ({H}) / close AS hi, lead(low) OVER ({H}) / close AS lo FROM p)
SELECT symbol, ts, {rsql('(1 + r) * (1 + m) - 1')} AS fwd_ret, {rsql('hi * (1 + m1) - 1')} AS fwd_high, {rsql('lo * (1 + m1) - 1')} AS fwd_low FROM l""")
def _(t):
    d = labels.forward_panel(with_fx(t), 4, **YR)
    return d.select("symbol", "ts", *[rnd(x).alias(x) for x in ("fwd_ret", "fwd_high", "fwd_low")])


@query("M12_vol_normalised_target", f"""WITH {v.HOURLY}, p AS (SELECT symbol, ts, close, (high - low) / close + 0.01 AS sigma, ts + INTERVAL 24 HOUR AS at, max(ts) OVER (PARTITION BY symbol) AS e FROM hourly)
SELECT p.symbol, p.ts, {rsql('CASE WHEN p.at <= p.e THEN h.close / p.close - 1 END / greatest(p.sigma * sqrt(24e0), 1e-4)')} AS y FROM p ASOF LEFT JOIN hourly h ON p.symbol = h.symbol AND p.at >= h.ts""")
def _(t):
    p = v.hourly(t).withColumn("sigma", rules.range_ratio(F.col("high"), F.col("low"), F.col("close")) + 0.01)
    return labels.vol_normalised(p, 24, "sigma").select("symbol", "ts", rnd("y").alias("y"))


POINTS = f"""h AS (SELECT *, stddev_samp(ret) OVER ({H} ROWS 47 PRECEDING) / 100 AS sigma FROM (SELECT *, close / lag(close) OVER ({H}) - 1 AS ret FROM hourly)),
st AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS TIMESTAMP) AS ts),
p AS (SELECT symbol, st.ts, st.ts - INTERVAL 24 HOUR AS a1, st.ts - INTERVAL 72 HOUR AS a2, st.ts + INTERVAL 24 HOUR AS af FROM st, (SELECT DISTINCT symbol FROM hourly) u),
q AS (SELECT p.symbol, p.ts, h0.close AS c0, h0.sigma, h1.close AS c1, h2.close AS c2, hf.close AS cf FROM p ASOF LEFT JOIN h h0 ON p.symbol = h0.symbol AND p.ts >= h0.ts
  ASOF LEFT JOIN h h1 ON p.symbol = h1.symbol AND p.a1 >= h1.ts ASOF LEFT JOIN h h2 ON p.symbol = h2.symbol AND p.a2 >= h2.ts ASOF LEFT JOIN h hf ON p.symbol = hf.symbol AND p.af >= hf.ts),
pts AS (SELECT symbol, ts, c0 / c1 - 1 AS mom_24h, c0 / c2 - 1 AS mom_72h, sigma, cf / c0 - 1 AS fwd, (cf / c0 - 1) / greatest(sigma * sqrt(24e0), 1e-4) AS y FROM q WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND sigma IS NOT NULL AND cf IS NOT NULL)"""


def sigmas(t, scale=100.0):
    def build(d, w):
        d = d.withColumn("ret", ts.lag_return("close", 1, w))
        return d.withColumn("sigma", ts.roll(F.stddev_samp, "ret", 48, w, 1) / scale)
    return scan.over_series(v.hourly(t), build, back=49).select("symbol", "ts", "close", "sigma")


def points(t):
    h = sigmas(t)
    probe = signals.symbol_stamps(h, splits.stamps(t.events))
    return cut_lineage(signals.point_matrix(h, probe, [24, 72], 24, h.where("sigma IS NOT NULL").select("symbol", "ts", "sigma")))


@query("M13_research_point_matrix", f"WITH {v.HOURLY}, {POINTS} SELECT symbol, ts, {rsql('mom_24h')} AS mom_24h, {rsql('mom_72h')} AS mom_72h, {rsql('y', 4)} AS y, CAST(symbol = 'error' AS DOUBLE) AS dum_error FROM pts")
def _(t):
    d = signals.dummies(points(t), ["click", "error"])
    return d.select("symbol", "ts", rnd("mom_24h").alias("mom_24h"), rnd("mom_72h").alias("mom_72h"), rnd("y", 4).alias("y"), "dum_error")


@query("M14_carry_features", f"""WITH {v.HOURLY}, r AS (SELECT symbol, ts, (close - 30) / 1e4 AS rate FROM hourly), z AS (SELECT *, ts - INTERVAL 48 HOUR AS at, avg(rate) OVER w AS m, stddev_pop(rate) OVER w AS s FROM r WINDOW w AS ({H} RANGE BETWEEN INTERVAL 240 HOUR PRECEDING AND CURRENT ROW))
SELECT z.symbol, z.ts, {rsql('z.rate * 1095')} AS level, {rsql('CASE WHEN s > 1e-12 THEN (z.rate - m) / s END', 4)} AS z, {rsql('(z.rate - o.rate) * 1095')} AS change FROM z ASOF LEFT JOIN r o ON z.symbol = o.symbol AND z.at >= o.ts""")
def _(t):
    r = v.hourly(t).select("symbol", "ts", ((F.col("close") - 30) / 1e4).alias("rate"))
    d = signals.carry_features(r, "rate", 48, 240, 1095.0)
    return d.select("symbol", "ts", rnd("level").alias("level"), rnd("z", 4).alias("z"), rnd("change").alias("change"))


VOTE = """vq AS (SELECT p.symbol, p.ts, h0.close c0, h1.close c1, h2.close c2 FROM (SELECT symbol, ts, ts - INTERVAL 24 HOUR a1, ts - INTERVAL 72 HOUR a2 FROM hourly) p JOIN hourly h0 ON p.symbol = h0.symbol AND p.ts = h0.ts
  ASOF LEFT JOIN hourly h1 ON p.symbol = h1.symbol AND p.a1 >= h1.ts ASOF LEFT JOIN hourly h2 ON p.symbol = h2.symbol AND p.a2 >= h2.ts),
vt AS (SELECT *, coalesce(sign(c0 / c1 - 1), 0) + coalesce(sign(c0 / c2 - 1), 0) AS votes, CAST(c1 IS NOT NULL AS INT) + CAST(c2 IS NOT NULL AS INT) AS valid FROM vq)"""


def votes(t):
    h = v.hourly(t)
    return signals.multiscale(h, h.select("symbol", "ts"), (24, 72))


@query("M15_multiscale_vote", f"""WITH {v.HOURLY}, {VOTE} SELECT symbol, ts, CASE WHEN votes > 0 THEN 'BUY' WHEN votes < 0 THEN 'SELL' ELSE 'HOLD' END AS direction, {rsql('coalesce(least(abs(votes) / nullif(valid, 0), 0.95), 0)')} AS confidence, CAST(votes AS BIGINT) AS votes, CAST(valid AS BIGINT) AS valid FROM vt""")
def _(t):
    return votes(t).select("symbol", "ts", "direction", rnd("confidence").alias("confidence"), "votes", "valid")


@query("M16_short_gate", f"""WITH {v.HOURLY}, {VOTE}, g AS (SELECT symbol, ts, CASE WHEN votes > 0 THEN 'BUY' WHEN votes < 0 THEN 'SELL' ELSE 'HOLD' END AS d, coalesce(least(abs(votes) / nullif(valid, 0), 0.95), 0) AS c, (c0 % 1) AS h, c0 / c1 - 1 AS r FROM vt)
SELECT symbol, ts, CASE WHEN d = 'SELL' AND NOT coalesce(c >= 0.5 AND h >= 0.5 AND r < 0, false) THEN 'HOLD' ELSE d END AS direction FROM g""")
def _(t):
    d = votes(t).join(v.hourly(t).select("symbol", "ts", (F.col("close") % 1).alias("h")), ["symbol", "ts"])
    return d.select("symbol", "ts", rules.short_confirmed(F.col("direction"), F.col("confidence"), F.col("h"), F.col("ret_24h")).alias("direction"))


GOLD = f"""g AS (SELECT *, close / lag(close) OVER ({H}) - 1 AS ret, (high - low) / close AS spread FROM hourly), gs AS (SELECT *, sum(ret) OVER ({H} ROWS 23 PRECEDING) AS ret_sum FROM g)"""


def _gold_sql(h):
    return f"""CASE WHEN {h} > 0.55 THEN 'trending' WHEN {h} < 0.45 THEN 'mean-reverting' ELSE 'volatile' END AS regime,
  round(CASE WHEN {h} > 0.55 THEN ({h} - 0.55) / 0.45 WHEN {h} < 0.45 THEN (0.45 - {h}) / 0.45 ELSE 1 - abs({h} - 0.5) / 0.05 END, 3) + 0e0 AS regime_conf,
  round(ret, 6) + 0e0 AS returns_1h, round(ret_sum, 6) + 0e0 AS returns_24h, round(spread, 6) + 0e0 AS spread"""


PROXY = "(1 / (1 + spread))"  # candles without the heavy rolling fit: calm bars count as persistent


@query("M17_gold_signal_latest", f"""WITH {v.HOURLY}, {GOLD}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM gs) SELECT symbol, ts, {_gold_sql(PROXY)} FROM l WHERE k = 1""")
def _(t):
    return signals.gold_latest(v.hourly(t), 1 / (1 + F.col("spread")))


@query("M17_gold_signal_as_of", f"""WITH {v.HOURLY}, {GOLD}, st AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS TIMESTAMP) AS ts), p AS (SELECT symbol, st.ts FROM st, (SELECT DISTINCT symbol FROM hourly) u)
SELECT p.symbol, p.ts, {_gold_sql(PROXY)} FROM p ASOF JOIN gs ON p.symbol = gs.symbol AND p.ts >= gs.ts""")
def _(t):
    return signals.gold_as_of(v.hourly(t), splits.stamps(t.events), 1 / (1 + F.col("spread")))


# ---- stamps and splits ----------------------------------------------------------------------
@query("M18_decision_stamps", "SELECT CAST(d AS TIMESTAMP) AS ts FROM (SELECT unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 1")
def _(t):
    return splits.stamps(t.orders.select(F.col("o_orderdate").alias("ts")), 1, 0)


@query("M19_iteration_confirmation", f"WITH {v.PANEL}, d AS (SELECT DISTINCT ts FROM panel), k AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM d) SELECT ts, CASE WHEN k < floor(n * 0.85) THEN 'iteration' ELSE 'confirmation' END AS part FROM k")
def _(t):
    return splits.partition_dates(v.panel(t))


SPLITS = """dt AS (SELECT DISTINCT ts, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM panel),
mo AS (SELECT DISTINCT month, date_diff('month', TIMESTAMP '1990-01-01', month) AS m FROM dt), dr AS (SELECT month, k, ((m * 7919 + k * 104729) * 1103515245 + 42 * 12345) % 2147483648 AS h FROM mo, (SELECT unnest(range(5)) AS k)),
rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, month) - 1 AS r, count(*) OVER (PARTITION BY k) AS n FROM dr),
vm AS (SELECT 'block_draw_' || k AS split, month FROM rk WHERE r < greatest(1, round(n * 0.2))),
nb AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM dt),
vl AS (SELECT vm.split, dt.ts FROM vm JOIN dt USING (month) UNION ALL SELECT 'temporal_holdout', ts FROM nb WHERE k >= floor(n * 0.8)),
bl AS (SELECT split, month AS s, CAST(last_day(month) AS TIMESTAMP) AS e FROM vm UNION ALL SELECT 'temporal_holdout', min(ts), max(ts) FROM nb WHERE k >= floor(n * 0.8)),
al AS (SELECT DISTINCT vl.split, dt.ts FROM vl, dt),
tr AS (SELECT al.split, al.ts FROM al WHERE NOT EXISTS (SELECT 1 FROM vl WHERE vl.split = al.split AND vl.ts = al.ts) AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.split = al.split AND al.ts >= bl.s - INTERVAL 28 DAY AND al.ts <= bl.e + INTERVAL 28 DAY))"""


@query("M20_hybrid_purged_splits", f"WITH {v.PANEL}, {SPLITS} SELECT split, ts, 'train' AS role FROM tr UNION ALL SELECT split, ts, 'val' FROM vl")
def _(t):
    return splits.hybrid(v.panel(t), horizon=28).select("split", "ts", "role")


CANARY = ["ret_1d", "ret_5d", "ret_5d_z60", "hl_range_z30", "rv_20d", "dow"]


@query("M21_leakage_canary", f"""WITH {v.PANEL}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k FROM (SELECT DISTINCT ts FROM panel)), n AS (SELECT count(*) AS c FROM panel JOIN d USING (ts) WHERE k % 9 = 8)
SELECT f AS feature, c AS n_compared, CAST(0 AS BIGINT) AS n_different, true AS causal FROM n, (SELECT unnest([{", ".join(f"'{x}'" for x in CANARY)}]) AS f)""")
def _(t):
    return ft.canary(v.panel(t), ft.pick(ft.catalogue("Brand#1"), CANARY), **YR)


DOSSIER = ["ret_5d", "hl_range", "vol_z30", "rv_20d"]


STUDY = ["ret_1d", "ret_5d", "ret_21d", "abs_ret_1d", "ret_5d_z60", "hl_range", "hl_range_z30", "vol_z30", "rv_20d", "rel_ret_5d", "breadth_20d", "vol_rel"]
_X = f"x AS (SELECT f.symbol, f.ts, {', '.join('f.' + c for c in STUDY)}, f.rv_20d AS rv, fw.fwd FROM f JOIN fw USING (symbol, ts) WHERE fw.fwd IS NOT NULL), l AS (UNPIVOT x ON {', '.join(STUDY)} INTO NAME feature VALUE val)"
STUDIED = f"WITH {v.PANEL}, {v.FX}, {CATALOGUE}, {FWD}, {_X}"


def ranked_sql(src, keys):
    return f"(SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY val) + (count(*) OVER (PARTITION BY {keys}, val) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {keys} ORDER BY fwd) + (count(*) OVER (PARTITION BY {keys}, fwd) - 1) / 2.0 AS ry FROM {src})"


def study_long(t):
    """(symbol, ts, rv, fwd, feature, value) of every studied feature."""
    d = ft.matrix(v.panel(t), ft.pick(ft.catalogue("Brand#1"), STUDY), **YR)
    d = d.join(forward(t).where("fwd IS NOT NULL").select("symbol", "ts", "fwd"), ["symbol", "ts"]).withColumn("rv", F.col("rv_20d"))
    return cut_lineage(aggregates.unpivot(d, ["symbol", "ts", "rv", "fwd"], STUDY).where("value IS NOT NULL"))


# the p-value's oracle is the finite trigonometric series of Student's t, not the fraction
@query("M22_feature_dossier", f"""{STUDIED}, s AS (SELECT feature, count(*) AS n, corr(rx, ry) AS ic, avg(val) AS mean, stddev_samp(val) AS std, skewness(val) AS skew FROM {ranked_sql('l', 'feature')} GROUP BY 1),
o AS (SELECT feature, avg(CAST(abs(val - mean) > 3 * std AS INT)) AS outliers FROM l JOIN s USING (feature) GROUP BY 1),
a AS (SELECT feature, n - 2 AS nu, atan(abs(ic) * sqrt((n - 2) / (1 - ic * ic)) / sqrt(n - 2)) AS th FROM s),
k AS (SELECT feature, nu, th, unnest(range(1, CAST(nu // 2 AS BIGINT))) AS j FROM a),
c AS (SELECT *, sum(CASE WHEN nu % 2 = 0 THEN ln((2e0 * j - 1) / (2 * j)) ELSE ln(2e0 * j / (2 * j + 1)) END) OVER (PARTITION BY feature ORDER BY j) AS lc FROM k),
q AS (SELECT feature, sum(exp(lc + (2 * j + nu % 2) * ln(cos(th)))) AS tail FROM c WHERE nu % 2 = 0 OR j <= (nu - 3) // 2 GROUP BY 1),
p AS (SELECT feature, greatest(0, 1 - CASE WHEN nu % 2 = 0 THEN sin(th) * (1 + tail) ELSE 2 / pi() * (th + sin(th) * (cos(th) + tail)) END) AS p_value FROM a JOIN q USING (feature))
SELECT feature, n, {rsql('ic', 5)} AS ic, {rsql('p_value', 6)} AS p_value, {rsql('mean', 5)} AS mean, {rsql('std', 5)} AS std, {rsql('outliers', 5)} AS outliers FROM s JOIN o USING (feature) JOIN p USING (feature)""")
def _(t):
    long = study_long(t)
    ic = models.spearman(long, ["feature"], "value", "fwd")
    m = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    out = long.join(F.broadcast(m), "feature").groupBy("feature").agg(F.avg((F.abs(F.col("value") - F.col("mean")) > 3 * F.col("std")).cast("double")).alias("outliers"))  # a row a feature
    d = ic.join(m, "feature").join(out, "feature").withColumn("p_value", normal.correlation_p(F.col("ic"), F.col("n")))
    return d.select("feature", "n", *[rnd(c, k).alias(c) for c, k in (("ic", 5), ("p_value", 6), ("mean", 5), ("std", 5), ("outliers", 5))])


@query("M22b_ic_by_regime", f"""{STUDIED}, e AS (SELECT quantile_cont(rv, 1 / 3e0) AS a, quantile_cont(rv, 2 / 3e0) AS b FROM x), g AS (SELECT l.*, CASE WHEN rv <= a THEN 'low' WHEN rv <= b THEN 'mid' ELSE 'high' END AS regime FROM l, e WHERE rv IS NOT NULL)
SELECT feature, regime, count(*) AS n, {rsql('corr(rx, ry)', 5)} AS ic FROM {ranked_sql('g', 'feature, regime')} GROUP BY 1, 2 HAVING count(*) > 100 AND count(DISTINCT val) > 1""")
def _(t):
    long = study_long(t)
    rv = long.where("rv IS NOT NULL").select("symbol", "ts", "rv").distinct().withColumn("_g", F.lit(0))
    cuts = scan.quantiles(rv, ["_g"], "rv", [1 / 3, 2 / 3], ["a", "b"]).drop("_g")
    d = long.where("rv IS NOT NULL").crossJoin(F.broadcast(cuts))  # one-row side
    d = cut_lineage(d.withColumn("regime", F.when(F.col("rv") <= F.col("a"), "low").when(F.col("rv") <= F.col("b"), "mid").otherwise("high")))
    wide = d.groupBy("feature", "regime").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    ic = models.spearman(d, ["feature", "regime"], "value", "fwd").join(wide, ["feature", "regime"]).where("n > 100 AND _lo < _hi")
    return ic.select("feature", "regime", "n", rnd("ic", 5).alias("ic"))


@query("M22c_rate_by_decile", f"""{STUDIED}, e AS (SELECT feature, quantile_cont(val, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM l GROUP BY 1)
SELECT feature, CAST(1 + len(list_filter(q, lambda z: z < val)) AS INTEGER) AS decile, count(*) AS n, {rsql('avg(CAST(fwd > 0 AS INT))', 5)} AS rate FROM l JOIN e USING (feature) GROUP BY 1, 2""")
def _(t):
    long = study_long(t)
    names = [f"q{i}" for i in range(1, 10)]
    edges = scan.quantiles(long.select("feature", "value"), ["feature"], "value", [i / 10 for i in range(1, 10)], names)
    d = long.join(F.broadcast(edges), "feature").withColumn("decile", 1 + sum((F.col(q) < F.col("value")).cast("int") for q in names))  # a row a feature
    return d.groupBy("feature", "decile").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("fwd") > 0).cast("double")), 5).alias("rate"))


@query("M22d_yearly_stability", f"{STUDIED} SELECT feature, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, {rsql('avg(val)', 5)} AS mean, {rsql('stddev_samp(val)', 5)} AS std FROM l GROUP BY 1, 2")
def _(t):
    return study_long(t).groupBy("feature", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 5).alias("mean"), rnd(F.stddev_samp("value"), 5).alias("std"))


# ---- fits --------------------------------------------------------------------------------------
def training(t):
    d = ft.matrix(v.panel(t), ft.pick(ft.catalogue("Brand#1"), DOSSIER), **YR)
    lab = labels.relative(forward(t), ret="fwd").select("symbol", "ts", "fwd", "y")
    return cut_lineage(d.join(lab, ["symbol", "ts"]))


@query("M23_logistic_regression")
def _(t):
    d = training(t)
    m = models.fit_logistic(d, DOSSIER)
    return models.score(m, d.dropna(subset=DOSSIER)).select("symbol", "ts", "y", rnd("p").alias("p"))


@query("M24_boosted_trees")
def _(t):
    d = training(t)
    m = models.fit_boosted(d, DOSSIER, rounds=5)
    return models.score(m, d.dropna(subset=DOSSIER)).select("symbol", "ts", "y", rnd("p").alias("p"))


RIDGE = """mz AS (SELECT {k} count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM rd GROUP BY ALL),
ms AS (SELECT *, n + 1.0 AS d1, n * cab / (sa * sb) AS o, n * cay / sa AS v1, n * cby / sb AS v2 FROM mz),
mw AS (SELECT *, (d1 * v1 - o * v2) / (d1 * d1 - o * o) / sa AS w1, (d1 * v2 - o * v1) / (d1 * d1 - o * o) / sb AS w2 FROM ms)"""


@query("M25_ridge_regression", f"WITH rd AS (SELECT l_linestatus AS g, l_quantity AS a, l_discount AS b, l_extendedprice / 1000 AS y FROM lineitem), {RIDGE.format(k='g,')} SELECT g, {rsql('my - w1 * ma - w2 * mb', 4)} AS intercept, {rsql('w1', 4)} AS w_a, {rsql('w2', 4)} AS w_b FROM mw")
def _(t):
    d = t.lineitem.select(F.col("l_linestatus").alias("g"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), (F.col("l_extendedprice") / 1000).alias("y"))
    return models.ridge(d, ["a", "b"], "y", ["g"]).select("g", *[rnd(x, 4).alias(x) for x in ("intercept", "w_a", "w_b")])


WF = f"""rdx AS (SELECT symbol, ts, mom_24h AS a, mom_72h AS b, fwd AS y FROM pts), sx AS (SELECT DISTINCT ts AS g FROM rdx),
rd AS (SELECT sx.g, r.a, r.b, r.y FROM sx JOIN rdx r ON r.ts <= sx.g - INTERVAL 48 HOUR), {RIDGE.format(k='g,')}"""


def walk_forward(t):
    p = points(t).select("symbol", "ts", F.col("mom_24h").alias("a"), F.col("mom_72h").alias("b"), F.col("fwd").alias("y"))
    w = models.walk_forward_ridge(p, p.select("ts").distinct(), ["a", "b"], "y", 48)
    return cut_lineage(models.apply_linear(p, w, ["a", "b"]))


@query("M26_walk_forward_ridge", f"WITH {v.HOURLY}, {POINTS}, {WF} SELECT r.symbol, r.ts, {rsql('my + w1 * (a - ma) + w2 * (b - mb)', 3)} AS pred FROM rdx r JOIN mw ON r.ts = mw.g WHERE n >= 30")
def _(t):
    return walk_forward(t).select("symbol", "ts", rnd("pred", 3).alias("pred"))


@query("M27_trial_run")
def _(t):
    d = training(t)
    mem = cut_lineage(splits.hybrid(d, horizon=28))
    dates = {r["split"]: np.array(r["days"], "datetime64[us]") for r in mem.where("role = 'train'").groupBy("split").agg(F.collect_set("ts").alias("days")).collect()}  # six calendars
    val = d.dropna(subset=[*DOSSIER, "y"]).join(mem.where("role = 'val'").select("split", "ts"), "ts")
    s = cut_lineage(models.score_many(val, models.fit_logistic_many(d, DOSSIER, dates, c=0.1), "split"))
    m = aggregates.confusion(s, ["split"], F.col("p") > 0.5, F.col("y") == 1).join(aggregates.auc_ap(s, ["split"], "p", "y"), "split")
    signal = s.withColumn("s", rules.from_probability(F.col("p"), 0.52, 0.48)).select("split", "symbol", "ts", (F.col("fwd") / 100).alias("fwd"), "s.direction", "s.confidence", F.col("rv_20d").alias("vol"))
    net = portfolio.evaluate_signals(signal, ["split", "ts"], 0.0036).groupBy("split").agg(F.avg("net").alias("mean_net"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n_stamps"))
    return m.join(net, "split", "left")


ARTEFACT = {"features": ["ret_5d", "hl_range", "vol_z30", "rv_20d"], "coef": [0.2, -0.4, 0.1, -0.3], "mean": [0.1, 0.5, 0.0, 1.0], "scale": [0.5, 0.4, 1.0, 0.6], "intercept": 0.05}
SCORE = "1 / (1 + exp(-(0.05e0 + 0.2e0 * (ret_5d - 0.1e0) / 0.5e0 - 0.4e0 * (hl_range - 0.5e0) / 0.4e0 + 0.1e0 * vol_z30 - 0.3e0 * (rv_20d - 1) / 0.6e0)))"


def scored_panel(t):
    d = ft.matrix(v.panel(t), ft.pick(ft.catalogue("Brand#1"), DOSSIER), **YR).dropna(subset=DOSSIER)
    return models.score_frozen(d, models.seal(ARTEFACT))


@query("M28_frozen_batch_scoring", f"WITH {v.PANEL}, {v.FX}, {CATALOGUE} SELECT symbol, ts, {rsql(SCORE)} AS p FROM f WHERE vol_z30 IS NOT NULL AND rv_20d IS NOT NULL AND ret_5d IS NOT NULL")
def _(t):
    return scored_panel(t).select("symbol", "ts", rnd("p").alias("p"))


@query("M29_parameter_sweep")
def _(t):
    d = training(t).dropna(subset=[*DOSSIER, "y"])
    parts = splits.partition_dates(d, 0.2)
    d = cut_lineage(d.join(parts, "ts"))
    days = np.array([r[0] for r in parts.where("part = 'iteration'").select("ts").collect()], "datetime64[us]")  # the calendar
    grid = {c: c for c in (0.01, 0.1, 1.0)}
    fits = models.fit_logistic_many(d, DOSSIER, dict.fromkeys(grid, days), c=grid)
    each = d.where("part = 'confirmation'").withColumn("c", F.explode(F.array(*map(F.lit, grid))))
    out = models.score_many(each, fits, "c").select("c", "p", "y")
    return aggregates.auc_ap(cut_lineage(out), ["c"], "p", "y")


@query("M30_linear_attribution", f"""WITH {v.PANEL}, {v.FX}, {CATALOGUE}, s AS (SELECT symbol, ts, 0.2e0 * (ret_5d - 0.1e0) / 0.5e0 AS ret_5d, -0.4e0 * (hl_range - 0.5e0) / 0.4e0 AS hl_range, 0.1e0 * vol_z30 AS vol_z30, -0.3e0 * (rv_20d - 1) / 0.6e0 AS rv_20d FROM f WHERE vol_z30 IS NOT NULL AND rv_20d IS NOT NULL AND ret_5d IS NOT NULL),
u AS (UNPIVOT s ON ret_5d, hl_range, vol_z30, rv_20d INTO NAME feature VALUE contribution) SELECT symbol, ts, feature, {rsql('contribution')} AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY abs(contribution) DESC) AS k FROM u) WHERE k <= 2""")
def _(t):
    d = scored_panel(t).withColumn("a", F.explode(rules.attribution(ARTEFACT, 2)))
    return d.select("symbol", "ts", "a.feature", rnd("a.contribution").alias("contribution"))


PRED = f"pr AS (SELECT r.symbol, r.ts, r.y, my AS train_mean, my + w1 * (a - ma) + w2 * (b - mb) AS pred FROM rdx r JOIN mw ON r.ts = mw.g WHERE n >= 30)"


@query("M31_walk_forward_skill", f"""WITH {v.HOURLY}, {POINTS}, {WF}, {PRED}, r AS (SELECT *, rank() OVER (ORDER BY pred) AS rx, rank() OVER (ORDER BY y) AS ry FROM pr)
SELECT {rsql('1 - sum(power(y - pred, 2)) / sum(power(y - train_mean, 2))', 4)} AS r2_oos, {rsql('avg(CASE WHEN abs(pred) >= 0.5 THEN CAST(sign(pred) = sign(y) AS INT) END)', 4)} AS hit_rate, count(*) FILTER (WHERE abs(pred) >= 0.5) AS n_active, {rsql('corr(rx, ry)', 4)} AS ic, count(*) AS n FROM r""")
def _(t):
    return models.skill(walk_forward(t), "pred", "y", 0.5).select(rnd("r2_oos", 4).alias("r2_oos"), rnd("hit_rate", 4).alias("hit_rate"), "n_active", rnd("ic", 4).alias("ic"), "n")


@query("M32_dead_zone_signals", f"""WITH {v.HOURLY}, {POINTS}, {WF}, {PRED} SELECT symbol, ts, CASE WHEN pred > 0 THEN 'BUY' ELSE 'SELL' END AS direction, {rsql('least(abs(pred), 0.95)', 3)} AS confidence FROM pr WHERE abs(pred) >= 0.25""")
def _(t):
    return models.dead_zone(walk_forward(t), "pred", 0.25).select("symbol", "ts", "direction", rnd("confidence", 3).alias("confidence"))


@query("M33_directional_classifier")
def _(t):
    d = sigmas(t)
    d = scan.over_series(d, lambda d, w: d.withColumns({"ret": ts.lag_return("close", 1, w), "fwd": ts.lead_return("close", 24, w)}), back=1, ahead=24)
    d = d.dropna().withColumns({"y": (F.col("fwd") > 0).cast("int")})
    d = d.join(splits.partition_dates(d, 0.2), "ts").withColumn("late", F.col("part") == "confirmation")
    m = models.fit_boosted(d, ["ret", "sigma"], rounds=5, validation="late")
    s = models.score(m, d)
    return s.withColumn("s", rules.from_probability(F.col("p"))).select("symbol", "ts", rnd("p").alias("p"), "s.direction", rnd(rules.kelly_size(F.col("s.confidence"), 1000.0, 0.25, F.col("sigma"))).alias("size"))


@query("M34_daily_scoring_panel", f"""WITH {v.HOURLY}, d AS (SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_max(close, ts) AS close, max(high) AS high, min(low) AS low FROM hourly GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT symbol, ts, close, high, low, symbol <> 'error' AS operable FROM d WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events)""")
def _(t):
    h = v.hourly(t)
    now = h.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("cut"))
    d = bars.roll_up(h, "day", 5).crossJoin(F.broadcast(now)).where("ts < cut")  # one-row side
    return d.select("symbol", "ts", "close", "high", "low", (F.col("symbol") != "error").alias("operable"))


@query("M35_holdout_signal_table")
def _(t):
    d = training(t)
    parts = splits.partition_dates(d, 0.2)
    m = models.fit_logistic(d.join(parts.where("part = 'iteration'"), "ts", "left_semi"), DOSSIER)
    s = models.score(m, d.join(parts.where("part = 'confirmation'"), "ts", "left_semi").dropna(subset=DOSSIER))
    return s.select("symbol", "ts", rnd("p").alias("p"), F.col("rv_20d").alias("rv"), "fwd")


@query("M36_iteration_slice", f"WITH {v.PANEL}, d AS (SELECT DISTINCT ts FROM panel), k AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM d) SELECT symbol, ts FROM panel JOIN k USING (ts) WHERE k.k < floor(k.n * 0.85)")
def _(t):
    return splits.iteration_only(v.panel(t)).select("symbol", "ts")
