"""A01-A26 and K01-K09."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import aggregates as agg
from tideline.operators import bars, cross, sampling, scan
from tideline.operators import timeseries as ts
from tideline.plans import views as v
from tideline.plans.joins import PRIORITY, priority_daily
from tideline.plans.registry import query, rnd, rsql
from tideline.plans.windows import FWD, forward
from tideline.session import cut_lineage

H = "PARTITION BY symbol ORDER BY ts"


@query("A01_resample_ohlcv", f"""WITH {v.HOURLY} SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_candles FROM hourly GROUP BY 1, 2""")
def _(t):
    return bars.roll_up(v.hourly(t), "day").select("symbol", "ts", "open", "high", "low", "close", "volume", "n_candles")


@query("A02_resample_last_close", f"WITH {v.HOURLY} SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_max(close, ts) AS close FROM hourly GROUP BY 1, 2")
def _(t):
    return bars.last_close(v.hourly(t), "day")


@query("A03_cross_section_statistics", f"""WITH {v.PANEL} SELECT symbol, ts, {rsql('median(close) OVER (PARTITION BY ts)')} AS med, {rsql('avg(close) OVER (PARTITION BY ts)')} AS mean,
count(*) OVER (PARTITION BY ts) AS n_symbols FROM panel""")
def _(t):
    p = v.panel(t).select("symbol", "ts", "close")
    d = scan.with_group(p, ["ts"], mean=F.avg("close"), n_symbols=F.count(F.lit(1)))
    return d.join(cross.medians(p, ["ts"], "close", "med"), "ts").select("symbol", "ts", rnd("med").alias("med"), rnd("mean").alias("mean"), "n_symbols")


@query("A04_base_rates", f"""SELECT d.source, d.lang, count(*) AS n, {rsql('avg(quality)')} AS base_rate, {rsql('2 * avg(quality) / (1 + avg(quality))')} AS naive_f1
FROM documents d JOIN labels l USING (doc_id) GROUP BY GROUPING SETS ((source, lang), ())""")
def _(t):
    d = t.documents.join(t.labels, "doc_id").withColumn("y", F.col("quality"))
    return agg.base_rates(d, ["source", "lang"]).select("source", "lang", "n", rnd("base_rate").alias("base_rate"), rnd("naive_f1").alias("naive_f1"))


@query("A05_dominant_label", f"""WITH g AS (SELECT source, lang, count(*) AS cnt, sum(coalesce(quality, 0.5e0)) AS s FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cnt DESC, lang) AS k, sum(s) OVER (PARTITION BY source) AS ss, sum(cnt) OVER (PARTITION BY source) AS cc FROM g)
SELECT source, lang, cnt, {rsql('s / cnt')} AS avg_weight, {rsql('ss / cc')} AS avg_weight_all FROM r WHERE k = 1""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").withColumn("w", F.col("quality").cast("double"))
    return agg.dominant(d, ["source"], "lang", "w").select("source", "lang", "cnt", rnd("avg_weight").alias("avg_weight"), rnd("avg_weight_all").alias("avg_weight_all"))


@query("A06_vol_and_autocorrelation", f"""WITH {PRIORITY}, r AS (SELECT symbol, ts, ln(close / lag(close) OVER ({H})) AS x FROM pd), l AS (SELECT *, lag(x) OVER ({H}) AS y FROM r)
SELECT symbol, {rsql('stddev_samp(x)')} AS vol, {rsql('corr(x, y)')} AS autocorr FROM l GROUP BY 1""")
def _(t):
    def build(d, w):
        d = d.withColumn("x", ts.log_return("close", w))
        return d.withColumn("y", F.lag("x").over(w))
    d = scan.over_series(priority_daily(t), build, back=2, chunk="year")
    return d.groupBy("symbol").agg(rnd(F.stddev_samp("x")).alias("vol"), rnd(F.corr("x", "y")).alias("autocorr"))


@query("A07_conditional_sums", f"""WITH {v.FILLS} SELECT symbol, round(sum(CASE WHEN action = 'BUY' THEN cost ELSE -cost END), 4) + 0e0 AS net_cost,
CAST(sum(quantity) FILTER (WHERE action = 'SELL') AS DOUBLE) AS sold, count(*) FILTER (WHERE status = 'REJECTED') AS rejected FROM fills GROUP BY 1""")
def _(t):
    f = v.fills(t)
    buy = F.col("action") == "BUY"
    return f.groupBy("symbol").agg(rnd(F.sum(F.when(buy, F.col("cost")).otherwise(-F.col("cost"))), 4).alias("net_cost"),
                                   F.sum(F.when(~buy, F.col("quantity"))).alias("sold"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))


@query("A08_distinct_counts", "SELECT event_type AS symbol, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("symbol")).agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count_distinct("user_id").alias("users"))


@query("A09_available_period", "SELECT event_type AS symbol, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("symbol")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("A10_quantile_summary", f"SELECT o_orderpriority AS symbol, {rsql('quantile_cont(o_totalprice, 0.25)', 4)} AS q25, {rsql('quantile_cont(o_totalprice, 0.5)', 4)} AS q50, {rsql('quantile_cont(o_totalprice, 0.75)', 4)} AS q75 FROM orders GROUP BY 1")
def _(t):
    d = t.orders.select(F.col("o_orderpriority").alias("symbol"), "o_totalprice")
    return scan.quantiles(d, ["symbol"], "o_totalprice", [.25, .5, .75], ["q25", "q50", "q75"]).select("symbol", *[rnd(x, 4).alias(x) for x in ("q25", "q50", "q75")])


@query("A11_mode_per_group", "SELECT l_suppkey, l_linenumber AS mode FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def _(t):
    return agg.mode(t.lineitem, ["l_suppkey"], "l_linenumber")


@query("A12_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("A13_decile_target_rate", f"""WITH {v.PANEL}, f AS (SELECT symbol, ts, volume AS x, CAST(lead(close) OVER ({H}) > close AS INT) AS y FROM panel),
r AS (SELECT x, y, floor((row_number() OVER (ORDER BY x, symbol || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) - 1) * 10.0 / count(*) OVER ()) + 1 AS b FROM f WHERE y IS NOT NULL)
SELECT CAST(b AS BIGINT) AS bucket, count(*) AS n, {rsql('avg(y)')} AS rate, {rsql('avg(x)')} AS mean_x FROM r GROUP BY 1""")
def _(t):
    d = scan.over_series(v.panel(t), lambda d, w: d.withColumn("y", (F.lead("close").over(w) > F.col("close")).cast("int")), ahead=1, chunk="year")
    d = d.withColumn("row_key", F.concat_ws("|", "symbol", F.to_date("ts").cast("string")))
    return agg.decile_table(d, "volume", "y").select("bucket", "n", rnd("rate").alias("rate"), rnd("mean_x").alias("mean_x"))


@query("A14_pooled_year_tercile", f"""WITH {v.PANEL}, {FWD}, m AS (SELECT symbol, ts, fwd, year(ts) AS yr, n AS x FROM fw WHERE fwd IS NOT NULL),
r AS (SELECT *, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER () AS s FROM m),
z AS (SELECT *, CASE WHEN s <= 1.0/3 THEN 'low' WHEN s <= 2.0/3 THEN 'mid' ELSE 'high' END AS tercile FROM r)
SELECT yr, tercile, count(*) AS n, {rsql('avg(fwd)')} AS mean_fwd FROM z GROUP BY GROUPING SETS ((), (yr), (tercile))""")
def _(t):
    d = cross.terciles(forward(t).where("fwd IS NOT NULL").withColumnRenamed("n", "x"), "x").withColumn("yr", F.year("ts").cast("bigint"))
    y, z = F.col("yr"), F.col("tercile")
    return d.groupingSets([[], [y], [z]], y, z).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("fwd")).alias("mean_fwd"))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A15_correlation_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rsql(f'corr({a}, {b})', 5)} AS corr FROM lineitem"
                                                   for i, a in enumerate(NUM) for b in NUM[i + 1:]))
def _(t):
    return agg.correlation_pairs(t.lineitem, NUM).select("a", "b", rnd("corr", 5).alias("corr"))


@query("A16_feature_moments", " UNION ALL ".join(f"""SELECT '{x}' AS feature, {rsql(f'avg({x})', 5)} AS mean, {rsql(f'stddev_samp({x})', 5)} AS std,
{rsql(f'avg(power(({x} - m) / s, 3))', 5)} AS skew, {rsql(f'avg(CAST(abs({x} - m) > 3 * s1 AS INT))')} AS outliers, {rsql(f'count({x}) / count(*)')} AS coverage
FROM lineitem, (SELECT avg({x}) m, stddev_pop({x}) s, stddev_samp({x}) s1 FROM lineitem)""" for x in NUM))
def _(t):
    return agg.moments(t.lineitem, NUM).select("feature", rnd("mean", 5).alias("mean"), rnd("std", 5).alias("std"), rnd("skew", 5).alias("skew"),
                                               rnd("outliers").alias("outliers"), rnd("coverage").alias("coverage"))


@query("A17_compounded_by_year", f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, {rsql('exp(sum(ln(1 + (o_totalprice - 250000) / 1e9))) - 1', 5)} AS ret FROM orders GROUP BY 1""")
def _(t):
    d = t.orders.select(F.year("o_orderdate").cast("bigint").alias("yr"), ((F.col("o_totalprice") - 250000) / 1e9).alias("r"))
    return d.groupBy("yr").agg(rnd(agg.compounded("r"), 5).alias("ret"))


@query("A18_equal_weight_basket", f"""WITH {v.PANEL}, r AS (SELECT ts, ln(close / lag(close) OVER ({H})) AS x FROM panel) SELECT ts, {rsql('ln(1 + avg(exp(x) - 1))')} AS basket FROM r WHERE x IS NOT NULL GROUP BY 1""")
def _(t):
    d = ts.returns(v.panel(t), chunk="year").where("log_ret IS NOT NULL")
    return d.groupBy("ts").agg(rnd(F.log1p(F.avg(F.expm1("log_ret")))).alias("basket"))


@query("A19_annualised_funding", f"""WITH d AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, avg(o_totalprice - 250000) / 1e7 AS rate FROM orders GROUP BY 1, 2)
SELECT symbol, CASE WHEN date_diff('day', min(ts), max(ts)) + 1 >= 90 THEN {rsql('sum(rate) * 365 / (date_diff(\'day\', min(ts), max(ts)) + 1)')} END AS funding_annual FROM d GROUP BY 1""")
def _(t):
    d = t.orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg((F.avg(F.col("o_totalprice") - 250000) / 1e7).alias("rate"))
    return agg.annual_funding(d, "rate").select("symbol", rnd("funding_annual").alias("funding_annual"))


@query("A20_liquidity_vol_map", f"""WITH {v.USER_DAILY}, s AS (SELECT symbol, sum(quote_volume) AS liq, stddev_samp(close) AS vol, avg(close) AS stat FROM user_daily GROUP BY 1 HAVING count(*) > 1),
b AS (SELECT floor((row_number() OVER (ORDER BY liq, symbol) - 1) * 5.0 / count(*) OVER ()) + 1 AS q, floor((row_number() OVER (ORDER BY vol, symbol) - 1) * 3.0 / count(*) OVER ()) + 1 AS z, stat FROM s)
SELECT CAST(q AS BIGINT) AS liq_q, CAST(z AS BIGINT) AS vol_t, count(*) AS n, {rsql('median(stat)', 5)} AS med FROM b GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(t):
    s = v.user_daily(t).groupBy("symbol").agg(F.sum("quote_volume").alias("liq"), F.stddev_samp("close").alias("vol"), F.avg("close").alias("stat"), F.count(F.lit(1)).alias("k")).where("k > 1").withColumn("_all", F.lit(0))
    s = cut_lineage(s)  # one row per symbol, ranked twice below
    s = cross.buckets(s, ["_all"], "liq", 5, "liq_q").drop("n_group")
    s = cross.buckets(s, ["_all"], "vol", 3, "vol_t").drop("n_group")
    n = s.groupBy("liq_q", "vol_t").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return n.join(cross.medians(s, ["liq_q", "vol_t"], "stat", "med"), ["liq_q", "vol_t"]).select("liq_q", "vol_t", "n", rnd("med", 5).alias("med"))


SCORED = "sc AS (SELECT lang AS cfg, d.doc_id, (n_chars % 101) / 101e0 AS p, quality AS y FROM documents d JOIN labels l USING (doc_id))"


def scored(t):
    return t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("cfg"), "doc_id", (F.col("n_chars") % 101 / F.lit(101.0)).alias("p"), F.col("quality").alias("y"))


@query("A21_confusion_metrics", f"""WITH {SCORED}, c AS (SELECT cfg, count(*) FILTER (WHERE p > 0.5 AND y = 1) tp, count(*) FILTER (WHERE p > 0.5 AND y = 0) fp, count(*) FILTER (WHERE p <= 0.5 AND y = 1) fn, count(*) FILTER (WHERE p <= 0.5 AND y = 0) tn FROM sc GROUP BY 1)
SELECT cfg, tp, fp, fn, tn, {rsql('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {rsql('tp / nullif(tp + fp, 0)')} AS precision, {rsql('tp / nullif(tp + fn, 0)')} AS recall, {rsql('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM c""")
def _(t):
    d = agg.confusion(scored(t), ["cfg"], F.col("p") > 0.5, F.col("y") == 1)
    return d.select("cfg", "tp", "fp", "fn", "tn", *[rnd(x).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


@query("A22_auc_average_precision", f"""WITH {SCORED}, r AS (SELECT cfg, p, y, rank() OVER (PARTITION BY cfg ORDER BY p) + (count(*) OVER (PARTITION BY cfg, p) - 1) / 2.0 AS mr,
  sum(y) OVER (PARTITION BY cfg ORDER BY p DESC) AS cp, count(*) OVER (PARTITION BY cfg ORDER BY p DESC) AS ca FROM sc)
SELECT cfg, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, {rsql('(sum(mr) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0)')} AS auc,
  {rsql('(sum(cp / ca) FILTER (WHERE y = 1)) / sum(y)')} AS avg_precision FROM r GROUP BY 1""")
def _(t):
    return agg.auc_ap(scored(t), ["cfg"], "p", "y").select("cfg", "n_pos", "n_neg", rnd("auc").alias("auc"), rnd("avg_precision").alias("avg_precision"))


@query("A23_monthly_turnover", f"""WITH {v.FILLS} SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS n_fills, {rsql('sum(cost)', 3)} AS turnover, {rsql('sum(fee)', 3)} AS fees FROM fills WHERE status = 'FILLED' GROUP BY 1""")
def _(t):
    return v.fills(t).where("status = 'FILLED'").groupBy(bars.bucket("ts", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_fills"), rnd(F.sum("cost"), 3).alias("turnover"), rnd(F.sum("fee"), 3).alias("fees"))


@query("A24_monthly_spend_vs_cap", f"""WITH d AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, sum(o_totalprice) AS spend, count(*) FILTER (WHERE o_orderstatus = 'O') AS ok_runs FROM orders GROUP BY 1)
SELECT month, {rsql('spend', 2)} AS spend, ok_runs, spend > 40000000 AS over_cap FROM d""")
def _(t):
    d = t.orders.groupBy(bars.bucket("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("spend"), F.count_if(F.col("o_orderstatus") == "O").alias("ok_runs"))
    return d.select("month", rnd("spend", 2).alias("spend"), "ok_runs", (F.col("spend") > 40000000).alias("over_cap"))


USAGE = """us AS (SELECT conv_id AS run_id, count(*) AS n_calls, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS completion_tokens FROM conversations GROUP BY 1)"""


def usage(t):
    n = F.length("text")
    user = F.col("role") == "user"
    return t.conversations.groupBy(F.col("conv_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum(F.when(user, n).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(~user, n).otherwise(0)).alias("completion_tokens"))


@query("A25_usage_cost_trailing_average", f"""WITH {USAGE}, c AS (SELECT *, (prompt_tokens * 0.28e0 + completion_tokens * 0.42e0) / 1e6 AS cost FROM us)
SELECT run_id, prompt_tokens, completion_tokens, {rsql('cost', 9)} AS cost_usd, {rsql('avg(cost) OVER (ORDER BY run_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)', 9)} AS estimate FROM c""")
def _(t):
    c = usage(t).withColumn("cost", (F.col("prompt_tokens") * 0.28 + F.col("completion_tokens") * 0.42) / 1e6)
    # one series of runs in order: number it by blocks of ids, then a ten-row frame on pieces
    c = c.withColumns({"_s": F.lit(0), "at": F.timestamp_seconds(F.col("run_id") * 3600)})
    d = scan.over_series(c, lambda d, w: d.withColumn("est", F.avg("cost").over(w.rowsBetween(-10, -1))), ["_s"], ["at"], back=10)
    return d.select("run_id", "prompt_tokens", "completion_tokens", rnd("cost", 9).alias("cost_usd"), rnd("est", 9).alias("estimate"))


WIN = f"""win AS (SELECT o_orderpriority AS cfg, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t0, avg(o_totalprice - 252000) / 2000 AS net_pct,
  avg(o_totalprice - 252000) FILTER (WHERE o_orderkey % 2 = 0) / 2000 AS bench_pct FROM orders GROUP BY 1, 2)"""


def windows_table(t):
    x = F.col("o_totalprice") - 252000
    return t.orders.groupBy(F.col("o_orderpriority").alias("cfg"), bars.bucket("o_orderdate", "month").alias("t0")).agg(
        (F.avg(x) / 2000).alias("net_pct"), (F.avg(F.when(F.col("o_orderkey") % 2 == 0, x)) / 2000).alias("bench_pct"))


@query("A26_window_set_summary", f"""WITH {WIN}, s AS (SELECT cfg, count(net_pct) AS n, median(net_pct) AS median, avg(net_pct) AS mean, stddev_samp(net_pct) AS std, avg(CAST(net_pct > 0 AS INT)) AS pct_positive, min(net_pct) AS min, max(net_pct) AS max FROM win GROUP BY 1),
y AS (SELECT cfg, min(m) AS worst FROM (SELECT cfg, year(t0), avg(net_pct) AS m FROM win GROUP BY 1, 2) GROUP BY 1)
SELECT cfg, n, {", ".join(f"{rsql(x, 5)} AS {x}" for x in ("median", "mean", "std", "pct_positive", "min", "max"))}, {rsql('worst', 5)} AS worst_year, median > 0 AND pct_positive >= 0.55 AND worst >= -1 AS passed FROM s JOIN y USING (cfg)""")
def _(t):
    w = cut_lineage(windows_table(t))
    s = agg.window_set(w, ["cfg"])
    y = agg.by_year(w, ["cfg"]).groupBy("cfg").agg(F.min("mean").alias("worst"))
    ok = (F.col("median") > 0) & (F.col("pct_positive") >= 0.55) & (F.col("worst") >= -1)
    return s.join(y, "cfg").select("cfg", "n", *[rnd(x, 5).alias(x) for x in ("median", "mean", "std", "pct_positive", "min", "max")], rnd("worst", 5).alias("worst_year"), ok.alias("passed"))


# ---- sorts, limits, top-k ------------------------------------------------------------------------
@query("K01_top_k_above_threshold", f"WITH {v.PANEL} SELECT symbol, ts, volume, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) AS k FROM panel WHERE volume > 50) WHERE k <= 3")
def _(t):
    return cross.top_k(v.panel(t).where("volume > 50"), ["ts"], "volume", 3).select("symbol", "ts", "volume", F.col("rank").cast("bigint").alias("rank"))


@query("K02_top_and_bottom_k", f"""WITH {v.PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY close DESC, symbol) a, row_number() OVER (PARTITION BY ts ORDER BY close, symbol) b FROM panel)
SELECT 'top' AS side, symbol, ts FROM r WHERE a <= 2 UNION ALL SELECT 'bottom', symbol, ts FROM r WHERE b <= 2""")
def _(t):
    p = v.panel(t)
    a = cross.top_k(p, ["ts"], "close", 2).select(F.lit("top").alias("side"), "symbol", "ts")
    return a.unionByName(cross.top_k(p, ["ts"], "close", 2, largest=False).select(F.lit("bottom").alias("side"), "symbol", "ts"))


@query("K03_precision_at_k", f"""WITH {v.PANEL}, {FWD}, r AS (SELECT ts, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) a, row_number() OVER (PARTITION BY ts ORDER BY fwd DESC, symbol) b FROM fw WHERE fwd IS NOT NULL),
d AS (SELECT ts, count(*) FILTER (WHERE a <= 5 AND b <= 5) / 5e0 AS pr FROM r GROUP BY 1) SELECT count(*) AS n_dates, {rsql('avg(pr)')} AS precision_at_k FROM d""")
def _(t):
    d = cross.precision_at_k(forward(t).where("fwd IS NOT NULL"), "volume", "fwd", 5)
    return d.agg(F.count(F.lit(1)).alias("n_dates"), rnd(F.avg("precision")).alias("precision_at_k"))


@query("K04_top_volatile_dates", f"WITH d AS (SELECT CAST(ts AS DATE) AS day, max(value) AS vol FROM events GROUP BY 1) SELECT day, vol FROM d ORDER BY vol DESC, day LIMIT 20")
def _(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("vol")).orderBy(F.desc("vol"), "day").limit(20)


@query("K05_nth_row", f"WITH {v.HOURLY} SELECT symbol, ts, close FROM (SELECT *, row_number() OVER ({H}) - 1 AS k FROM hourly WHERE ts > TIMESTAMP '2024-01-05') WHERE k = 24")
def _(t):
    d = v.hourly(t).where(F.col("ts") > F.lit("2024-01-05").cast("timestamp_ntz"))
    return scan.number_rows(d).where("_pos = 24").select("symbol", "ts", "close")


@query("K06_best_signal", f"WITH {v.FILLS} SELECT account, symbol, price AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY price DESC, symbol) AS k FROM fills WHERE action <> 'SELL') WHERE k = 1")
def _(t):
    f = v.fills(t).where("action <> 'SELL'")
    best = f.groupBy("account").agg(F.max("price").alias("confidence"))
    tied = f.select("account", "symbol", F.col("price").alias("confidence")).join(best, ["account", "confidence"])
    return tied.groupBy("account", "confidence").agg(F.min("symbol").alias("symbol")).select("account", "symbol", "confidence")


@query("K07_leaderboard", f"""WITH {WIN}, s AS (SELECT cfg, avg(net_pct) AS mean, count(*) AS n FROM win GROUP BY 1) SELECT cfg, {rsql('mean', 5)} AS mean, n, mean > 0 AND n >= 20 AS passed FROM s ORDER BY passed DESC, mean DESC NULLS LAST""")
def _(t):
    s = windows_table(t).groupBy("cfg").agg(F.avg("net_pct").alias("mean"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("passed", (F.col("mean") > 0) & (F.col("n") >= 20)).orderBy(F.desc("passed"), F.desc_nulls_last("mean"))
    return s.select("cfg", rnd("mean", 5).alias("mean"), "n", "passed")


@query("K08_grid_argmax", f"""WITH {SCORED}, g AS (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS thr), f AS (SELECT cfg, thr, 2e0 * count(*) FILTER (WHERE p > thr AND y = 1) / nullif(2 * count(*) FILTER (WHERE p > thr AND y = 1) + count(*) FILTER (WHERE (p > thr) <> (y = 1)), 0) AS f1 FROM sc, g GROUP BY 1, 2)
SELECT cfg, thr, {rsql('f1')} AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY cfg ORDER BY f1 DESC NULLS LAST, thr) AS k FROM f) WHERE k = 1""")
def _(t):
    grid = F.explode(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)]))
    c = agg.confusion(scored(t).withColumn("thr", grid), ["cfg", "thr"], F.col("p") > F.col("thr"), F.col("y") == 1)
    b = c.groupBy("cfg").agg(F.max_by(F.struct("thr", "f1"), F.struct(F.coalesce("f1", F.lit(-1.0)), -F.col("thr"))).alias("b"))
    return b.select("cfg", "b.thr", rnd("b.f1").alias("f1"))


@query("K09_window_sample", f"""WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT o_orderdate AS ts, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders),
c(ts, n) AS (SELECT min(ts), min(n) FROM d WHERE n >= (SELECT min(n) FROM d) + {(42 * 1103515245 + 42 * 12345) % 2147483648 % 28}
  UNION ALL SELECT x.ts, x.n FROM c, LATERAL (SELECT min(ts) AS ts, min(n) AS n FROM d WHERE d.n >= c.n + 28) x WHERE x.n IS NOT NULL)
SELECT ts FROM c ORDER BY (n * 1103515245 + 42 * 12345) % 2147483648, ts LIMIT 40""")
def _(t):
    return sampling.window_starts(t.orders.select(F.col("o_orderdate").alias("ts")).distinct(), 28, 40, 42)
