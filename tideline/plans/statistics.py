"""G01-G20, Q01-Q06."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.normal import expected_max_z
from tideline.operators import cross, joins, quality, scan, shapes, stats
from tideline.operators import timeseries as ts
from tideline.plans import views as v
from tideline.plans.joins import PRIORITY, priority_daily
from tideline.plans.registry import cdf_sql, query, rnd, rsql
from tideline.plans.scalars import SG, signal_rows
from tideline.plans.windows import EWMA, small_returns
from tideline.session import cut_lineage

H = "PARTITION BY symbol ORDER BY ts"
PR = f"{PRIORITY}, x0 AS (SELECT symbol, ts, ln(close / lag(close) OVER ({H})) AS x FROM pd), xr AS (SELECT *, row_number() OVER ({H}) AS i, x - avg(x) OVER (PARTITION BY symbol) AS d, avg(x) OVER (PARTITION BY symbol) AS mu FROM x0 WHERE x IS NOT NULL)"


def log_returns(t):
    return ts.returns(priority_daily(t), chunk="year").where("log_ret IS NOT NULL").select("symbol", "ts", F.col("log_ret").alias("x"))


MOM = "mm AS (SELECT symbol, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, stddev_pop(x) AS sp FROM x0 WHERE x IS NOT NULL GROUP BY 1), ms AS (SELECT mm.symbol, any_value(n) AS n, any_value(m / s) AS sr, avg(power((x - m) / sp, 3)) AS g3, avg(power((x - m) / sp, 4)) AS g4 FROM x0 JOIN mm USING (symbol) WHERE x IS NOT NULL GROUP BY 1)"


@query("G01_sharpe", f"WITH {PR} SELECT symbol, {rsql('avg(x) / stddev_samp(x)')} AS sharpe, {rsql('avg(x) / stddev_samp(x) * sqrt(365)')} AS annual FROM xr GROUP BY 1")
def _(t):
    s = ts.ratio(F.avg("x"), F.stddev_samp("x"))
    return log_returns(t).groupBy("symbol").agg(rnd(s).alias("sharpe"), rnd(s * 365 ** 0.5).alias("annual"))


@query("G02_probabilistic_sharpe_moments", f"WITH {PR}, {MOM} SELECT symbol, n, {rsql('sr')} AS sharpe, {rsql('g3', 5)} AS skew, {rsql('g4', 5)} AS kurt, {rsql('sr * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr)', 5)} AS z FROM ms")
def _(t):
    d = stats.psr(log_returns(t), ["symbol"], "x")
    return d.select("symbol", "n", rnd("sharpe").alias("sharpe"), rnd("skew", 5).alias("skew"), rnd("kurt", 5).alias("kurt"), rnd("z", 5).alias("z"))


SCALE = "sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12))"


@query("G02_probabilistic_sharpe", f"WITH {PR}, {MOM}, z AS (SELECT *, sr * sqrt(n - 1) / {SCALE} AS z FROM ms) SELECT symbol, n, {rsql('sr')} AS sharpe, {rsql(cdf_sql('z'), 5)} AS psr FROM z")
def _(t):
    return stats.psr(log_returns(t), ["symbol"], "x").select("symbol", "n", rnd("sharpe").alias("sharpe"), rnd("psr", 5).alias("psr"))


@query("G03_deflated_sharpe", f"WITH {PR}, {MOM}, b AS (SELECT *, sqrt((1 + sr * sr / 2) / (n - 1)) * {expected_max_z(20)!r} AS benchmark FROM ms), z AS (SELECT *, (sr - benchmark) * sqrt(n - 1) / {SCALE} AS z FROM b) SELECT symbol, n, {rsql('sr')} AS sharpe, {rsql('benchmark')} AS benchmark, {rsql(cdf_sql('z'), 5)} AS dsr FROM z")
def _(t):
    return stats.deflated(log_returns(t), ["symbol"], "x", 20).select("symbol", "n", rnd("sharpe").alias("sharpe"), rnd("benchmark").alias("benchmark"), rnd("dsr", 5).alias("dsr"))


def vr_sql(q):
    theta = " + ".join(f"{(2 * (q - k) / q) ** 2!r} * sum(d * d * l{k} * l{k})" for k in range(1, q))
    return f"""vq AS (SELECT *, CASE WHEN count(*) OVER w = {q} THEN sum(x) OVER w END AS s, {", ".join(f"lag(d, {k}) OVER ({H}) AS l{k}" for k in range(1, q))} FROM xr WINDOW w AS ({H} ROWS {q - 1} PRECEDING)),
vs AS (SELECT symbol, count(*) AS n, sum(power(s - {q} * mu, 2)) / ({q} * (count(*) - {q} + 1) * (1 - {q} / CAST(count(*) AS DOUBLE))) / (sum(d * d) / (count(*) - 1)) AS vr, ({theta}) / power(sum(d * d), 2) AS theta FROM vq GROUP BY 1)"""


@query("G04_variance_ratio", f"WITH {PR}, {vr_sql(5)} SELECT symbol, n, {rsql('vr')} AS vr, {rsql('(vr - 1) / sqrt(theta)', 5)} AS z FROM vs")
def _(t):
    return stats.variance_ratio(log_returns(t), ["symbol"], ["ts"], "x", 5, chunk="year").select("symbol", "n", rnd("vr").alias("vr"), rnd("z", 5).alias("z"))


RHO = f"rl AS (SELECT *, lag(d) OVER ({H}) AS p FROM xr), rr AS (SELECT symbol, sum(d * p) / sum(p * p) AS rho, sum(p * p) AS bb FROM rl GROUP BY 1), rs AS (SELECT rl.symbol, any_value(rho) AS rho, sqrt(sum(power(d - rho * p, 2) * p * p)) / any_value(bb) AS se FROM rl JOIN rr USING (symbol) GROUP BY 1)"


@query("G05_robust_rho", f"WITH {PR}, {RHO} SELECT symbol, {rsql('rho')} AS rho, {rsql('se')} AS se FROM rs")
def _(t):
    return stats.rho_robust(log_returns(t), ["symbol"], ["ts"], "x", "year").select("symbol", rnd("rho").alias("rho"), rnd("se").alias("se"))


@query("G06_sign_persistence", f"WITH {PR}, l AS (SELECT *, lag(x) OVER ({H}) AS p FROM xr) SELECT symbol, count(*) AS n_pairs, {rsql('avg(CAST(sign(x) = sign(p) AS INT))')} AS persistence FROM l WHERE x <> 0 AND p <> 0 GROUP BY 1")
def _(t):
    return stats.sign_persistence(log_returns(t), ["symbol"], ["ts"], "x", "year").select("symbol", "n_pairs", rnd("persistence").alias("persistence"))


HORIZONS = (1, 2, 3, 5, 10, 21, 42, 63, 126)


@query("G07_trend_premium", f"""WITH {PRIORITY}, o AS (SELECT *, row_number() OVER ({H}) - 1 AS pos FROM pd), h AS ({" UNION ALL ".join(f"SELECT {h} AS h, pos, close / lag(close, {h}) OVER ({H}) - 1 AS past, lead(close, {h}) OVER ({H}) / close - 1 AS fwd FROM o" for h in HORIZONS)}),
z AS (SELECT h, count(*) AS n, count(*) FILTER (past > 0) AS up, avg(fwd) FILTER (past > 0) AS a, avg(fwd) FILTER (past < 0) AS b, avg(CAST(sign(past) = sign(fwd) AS INT)) AS s FROM h WHERE pos >= h AND pos % h = 0 AND past <> 0 AND fwd IS NOT NULL GROUP BY 1)
SELECT CAST(h AS INTEGER) AS h, n, {rsql('CASE WHEN n >= 30 THEN s END')} AS persistence, {", ".join(f"{rsql(f'CASE WHEN n >= 30 AND up >= 5 AND n - up >= 5 THEN {x} END')} AS {y}" for x, y in (("a", "after_up"), ("b", "after_down"), ("a - b", "premium")))} FROM z""")
def _(t):
    d = stats.stepped_returns(priority_daily(t), HORIZONS, chunk="year")
    return stats.trend_premium(d, ["h"], "past", "fwd").select("h", "n", *[rnd(c).alias(c) for c in ("persistence", "after_up", "after_down", "premium")])


@query("G08_wild_bootstrap")
def _(t):
    return stats.wild_bootstrap(cut_lineage(log_returns(t)), ["symbol"], ["ts"], "x", 5, 200, chunk="year")


@query("G09_block_bootstrap_median")
def _(t):
    return stats.block_bootstrap_median(cut_lineage(log_returns(t)), "x", 5, 500, chunk="year")


@query("G10_permutation_twin")
def _(t):
    return stats.permutation_twin(cut_lineage(log_returns(t)), ["symbol"], "x", ["ts"], 5, 20, chunk="year")


@query("G11_block_twin")
def _(t):
    return stats.block_twin(cut_lineage(log_returns(t)), ["symbol"], "x", ["ts"], 28, 10, chunk="year")


@query("G11_synthetic_twin_path")
def _(t):
    return stats.synthetic_twin(v.panel(t).select("symbol", "ts", "close"), 2, chunk="year")


def periods(df):
    full = F.struct(F.lit("full").alias("period"))
    late = F.when(F.col("ts") >= F.lit("1998-01-01").cast("timestamp_ntz"), F.struct(F.lit("late").alias("period")))
    return df.select("*", F.explode(F.filter(F.array(full, late), lambda s: s.isNotNull())).alias("_p")).select("*", "_p.period").drop("_p")


PP = f"""{PRIORITY}, y0 AS (SELECT symbol, ts, ln(close / lag(close) OVER ({H})) AS x FROM pd), y1 AS (SELECT 'full' AS period, * FROM y0 WHERE x IS NOT NULL UNION ALL SELECT 'late', * FROM y0 WHERE x IS NOT NULL AND ts >= TIMESTAMP '1998-01-01'),
xr AS (SELECT period || '|' || symbol AS symbol, ts, x, x - avg(x) OVER (PARTITION BY period, symbol) AS d, avg(x) OVER (PARTITION BY period, symbol) AS mu FROM y1)"""


@query("G12_structure_table", f"WITH {PP}, {vr_sql(2)}, {RHO} SELECT split_part(vs.symbol, '|', 1) AS period, split_part(vs.symbol, '|', 2) AS symbol, n, {rsql('vr')} AS vr, {rsql('(vr - 1) / sqrt(theta)', 5)} AS z, {rsql('rho')} AS rho, {rsql('se')} AS se FROM vs JOIN rs ON vs.symbol = rs.symbol")
def _(t):
    d = stats.structure_table(cut_lineage(periods(log_returns(t))), ["period", "symbol"], "x", 2, chunk="year")
    return d.select("period", "symbol", "n", rnd("vr").alias("vr"), rnd("z", 5).alias("z"), rnd("rho").alias("rho"), rnd("se").alias("se"))


@query("G13_falsifier_verdict", f"WITH {SG} SELECT event_id, CASE WHEN conf + 0.3 < 1 THEN 'anti-persistent' WHEN conf + 0.1 > 1 THEN 'persistent' ELSE 'undecided' END AS verdict FROM sg")
def _(t):
    d = signal_rows(t).select("event_id", (F.col("conf") + 0.1).alias("lo90"), (F.col("conf") + 0.3).alias("hi90"))
    return stats.falsifier(d).select("event_id", "verdict")


@query("G14_zigzag_pivots")
def _(t):
    return shapes.pivots(v.panel(t), chunk="year")


def catalogue(t):
    p = cut_lineage(v.panel(t).select("symbol", "ts", "close"))
    return shapes.mountains(p, cut_lineage(shapes.pivots(p, chunk="year")), chunk="year")


@query("G15_mountain_catalogue")
def _(t):
    return catalogue(t)


@query("G16_shape_silhouettes")
def _(t):
    return t.spark.createDataFrame(shapes.silhouette_by_k(catalogue(t), range(2, 9)), "k int, silhouette double")


@query("G17_forecast_regression", f"WITH {v.HOURLY}, {EWMA}, z AS (SELECT symbol, var AS f, lead(ret * ret) OVER ({H}) AS y FROM ev) SELECT symbol, {rsql('regr_slope(y, f)', 4)} AS b, {rsql('regr_r2(y, f)', 5)} AS r2, CAST(regr_count(y, f) AS BIGINT) AS n FROM z GROUP BY 1")
def _(t):
    e = ts.ewma_variance(small_returns(t), "ret", rows=256).where("ewma_var IS NOT NULL")
    d = scan.over_series(e, lambda d, w: d.withColumn("y", F.lead(F.col("ret") * F.col("ret")).over(w)), ahead=1)
    return stats.mincer_zarnowitz(d, ["symbol"], "y", "ewma_var").select("symbol", rnd("b", 4).alias("b"), rnd("r2", 5).alias("r2"), "n")


@query("G18_constant_mix_growth", f"WITH {PRIORITY}, r AS (SELECT symbol, (close / lag(close) OVER ({H}) - 1) / 1000 AS x FROM pd) SELECT symbol, {rsql('exp(sum(ln(1 + 0.5 * x)))', 5)} AS constant_mix, {rsql('0.5 * exp(sum(ln(1 + x))) + 0.5', 5)} AS buy_hold FROM r WHERE x IS NOT NULL GROUP BY 1")
def _(t):
    d = ts.returns(priority_daily(t), chunk="year").where("ret_1 IS NOT NULL").withColumn("x", F.col("ret_1") / 1000)
    return stats.constant_mix(d, ["symbol"], "x", 0.5).select("symbol", rnd("constant_mix", 5).alias("constant_mix"), rnd("buy_hold", 5).alias("buy_hold"))


@query("G19_structure_report")
def _(t):
    x = cut_lineage(log_returns(t))
    ci = stats.falsifier(stats.block_bootstrap_median(x, "x", 5, 500, chunk="year"))
    per = stats.structure_table(x, ["symbol"], "x", 5, chunk="year")
    return per.crossJoin(F.broadcast(ci))  # one-row side


@query("G20_shape_study")
def _(t):
    p = cut_lineage(v.panel(t).select("symbol", "ts", "close"))
    real = shapes.mountains(p, cut_lineage(shapes.pivots(p, (0.05, 0.10, 0.20, 0.35), chunk="year")), chunk="year").select("shape")
    twin = stats.synthetic_twin(p, 1, chunk="year").select("symbol", (F.timestamp_seconds(F.col("pos") * 604800)).cast("timestamp_ntz").alias("ts"), "close")
    twin = cut_lineage(twin)
    fake = shapes.mountains(twin, cut_lineage(shapes.pivots(twin, (0.05, 0.10, 0.20, 0.35), chunk="year")), chunk="year").select("shape")
    rows = [(n, k, s) for n, d in (("real", real), ("twin", fake)) for k, s in shapes.silhouette_by_k(d, range(2, 9))]
    return t.spark.createDataFrame(rows, "series string, k int, silhouette double")


# ---- quality ------------------------------------------------------------------------------------
@query("Q01_candle_validation", f"""WITH {v.HOURLY}, g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER ({H})) AS gap FROM hourly) SELECT symbol, count(*) AS n, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS n_null, count(*) FILTER (high < low) AS n_inverted,
count(*) FILTER (close > high OR close < low) AS n_outside, count(*) FILTER (gap > 10800) AS n_gaps, true AS valid FROM g GROUP BY 1""")
def _(t):
    return quality.candles(v.hourly(t), "1h")


@query("Q02_feature_validation", f"WITH {SG} SELECT event_type AS symbol, count(*) AS n, count(*) FILTER (h * 1.4 < 0 OR h * 1.4 > 1) AS bad_hurst, count(*) FILTER (vol - 0.02 < 0) AS bad_vol, count(*) FILTER (reg = 'volatile') AS bad_regime, false AS valid FROM sg GROUP BY 1")
def _(t):
    d = signal_rows(t).select(F.col("event_type").alias("symbol"), (F.col("h") * 1.4).alias("hurst"), (F.col("vol") - 0.02).alias("vol"),
                              F.when(F.col("reg") == "mean-reverting", "mean_reverting").otherwise(F.col("reg")).alias("regime"))
    return quality.features(d)


@query("Q03_month_holes", "WITH m AS (SELECT o_custkey AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo FROM orders) SELECT symbol, count(DISTINCT mo) AS months, date_diff('month', min(mo), max(mo)) + 1 - count(DISTINCT mo) AS holes FROM m GROUP BY 1")
def _(t):
    return quality.month_holes(t.orders.select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("ts")))


@query("Q04_duplicates_and_gaps", """WITH h AS (SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts FROM events), c AS (SELECT symbol, ts, count(*) AS c FROM h GROUP BY 1, 2)
SELECT symbol, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS duplicates, CAST((epoch(max(ts)) - epoch(min(ts))) / 3600 AS BIGINT) + 1 - count(*) AS missing_hours, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY 1""")
def _(t):
    return quality.duplicates_and_gaps(t.events.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")))


@query("Q05_corpus_report", f"""WITH {v.PANEL}, g AS (SELECT symbol, ts, date_diff('day', lag(ts) OVER ({H}), ts) AS gap FROM panel), s AS (SELECT symbol, max(ts) AS e, max(gap) AS hole, symbol NOT IN ('Brand#3') AS k FROM g GROUP BY 1), l AS (SELECT max(ts) AS l FROM panel)
SELECT count(*) FILTER (k) AS universe, count(*) FILTER (NOT k) AS excluded, count(*) FILTER (k AND date_diff('day', e, l) > 10) AS dead, count(*) FILTER (k AND hole > 10) AS reuse_suspects FROM s, l""")
def _(t):
    return quality.corpus_report(v.panel(t), ~F.col("symbol").isin("Brand#3"), 10)


@query("Q06_venue_bridge", f"""WITH x AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS d, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2), r AS (SELECT symbol, a / lag(a) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ra, b / lag(b) OVER (PARTITION BY symbol ORDER BY d) - 1 AS rb FROM x WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT symbol, count(*) AS n, {rsql('median(abs(ra - rb) * 1e4)', 3)} AS median_bps, {rsql('stddev_samp(ra - rb) * 1e4', 3)} AS tracking_bps, {rsql('corr(ra, rb)', 5)} AS corr, count(*) >= 60 AND median(abs(ra - rb) * 1e4) <= 30 AND corr(ra, rb) >= 0.95 AS same FROM r WHERE ra IS NOT NULL AND rb IS NOT NULL GROUP BY 1""")
def _(t):
    even = F.col("event_id") % 2 == 0
    x = t.events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg(F.when(even, F.col("value"))).alias("a"), F.avg(F.when(~even, F.col("value"))).alias("b")).dropna()
    r = scan.over_series(x, lambda d, w: d.withColumns({"ra": ts.lag_return("a", 1, w), "rb": ts.lag_return("b", 1, w)}), back=1).where("ra IS NOT NULL AND rb IS NOT NULL")
    return quality.bridge(r, "ra", "rb", ["symbol"]).select("symbol", "n", rnd("median_bps", 3).alias("median_bps"), rnd("tracking_bps", 3).alias("tracking_bps"), rnd("corr", 5).alias("corr"), "same")
