"""Row-level functions, and the row rules X12-X17 on signal-like rows."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import normal, rules
from tideline.plans import views as v
from tideline.plans.registry import query, rnd, rsql

SG = """sg AS (SELECT event_id, event_type, ts, value, (event_id % 41) / 100e0 + 0.3 AS h, (event_id % 13) / 100e0 AS vol, (event_id % 101) / 101e0 AS conf,
  (value - 50) / 1000 AS ret24, (value - 30) / 3000 AS ret1,
  CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS act,
  CASE event_id % 4 WHEN 0 THEN 'hack' WHEN 1 THEN 'listing' WHEN 2 THEN 'macro' END AS label, (event_id % 7) / 7e0 AS trust,
  CASE event_id % 3 WHEN 0 THEN 'trending' WHEN 1 THEN 'mean-reverting' ELSE 'volatile' END AS reg FROM events)"""


def signal_rows(t):
    i = F.col("event_id")
    return t.events.select(
        "event_id", "event_type", "ts", "value", (i % 41 / F.lit(100.0) + 0.3).alias("h"), (i % 13 / F.lit(100.0)).alias("vol"), (i % 101 / F.lit(101.0)).alias("conf"),
        ((F.col("value") - 50) / 1000).alias("ret24"), ((F.col("value") - 30) / 3000).alias("ret1"),
        F.when(i % 3 == 0, "BUY").when(i % 3 == 1, "SELL").otherwise("HOLD").alias("act"),
        F.when(i % 4 == 0, "hack").when(i % 4 == 1, "listing").when(i % 4 == 2, "macro").alias("label"), (i % 7 / F.lit(7.0)).alias("trust"),
        F.when(i % 3 == 0, "trending").when(i % 3 == 1, "mean-reverting").otherwise("volatile").alias("reg"))


@query("X01_epoch_normalisation", "SELECT event_id, make_timestamp((epoch_us(ts) // 1000) * 1000) AS at FROM events")
def _(t):
    us = F.expr("unix_micros(cast(ts as timestamp))")
    raw = F.when(F.col("event_id") % 2 == 0, us).otherwise(F.floor(us / 1000))
    return t.events.select("event_id", rules.epoch_to_ts(raw).alias("at"))


@query("X02_time_text_parsing", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN TIMESTAMP '2000-01-01' ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS at FROM events""")
def _(t):
    s = F.col("ts")
    i = F.col("event_id") % 4
    text = (F.when(i == 0, F.concat(F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
            .when(i == 1, F.concat(F.date_format(s, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
            .when(i == 2, F.unix_timestamp(s).cast("string")).otherwise("soon"))
    return t.events.select("event_id", rules.parse_time(text, F.lit("2000-01-01").cast("timestamp_ntz")).alias("at"))


@query("X03_stable_content_id", "SELECT doc_id, left(sha1(concat_ws('|', source, lang, text)), 16) AS id FROM documents")
def _(t):
    return t.documents.select("doc_id", rules.stable_id(F.col("source"), F.col("lang"), F.col("text")).alias("id"))


CLEAN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<!--(.|\n)*?-->|<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("X04_html_to_text", f"SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, {CLEAN} AS t FROM pages)")
def _(t):
    return t.pages.select("page_id", rules.strip_html(F.col("html")).alias("x")).select("page_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("n"))


@query("X05_length_cap", "SELECT doc_id, length(left(text, 4000)) AS n, md5(left(text, 4000)) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.substring("text", 1, 4000).alias("x")).select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


WATCH = ["BTC/USDT", "ETH/USDT", "SOL/USDT", "AVAX/USDT"]


@query("X06_symbol_inference", """SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'btc') OR contains(lower(text), 'bitcoin') THEN 'BTC' END, CASE WHEN contains(lower(text), 'eth') OR contains(lower(text), 'ethereum') THEN 'ETH' END,
CASE WHEN contains(lower(text), 'sol') OR contains(lower(text), 'solana') THEN 'SOL' END, CASE WHEN contains(lower(text), 'avax') OR contains(lower(text), 'avalanche') THEN 'AVAX' END) AS symbols FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.concat_ws(",", rules.infer_symbols(F.col("text"), WATCH)).alias("symbols"))


TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{k}'" for k, w in rules.TAXONOMY) + f" ELSE '{rules.OTHER_LABEL}' END"


@query("X07_keyword_taxonomy", f"SELECT doc_id, {TOPIC} AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", rules.topic(F.col("text")).alias("label"))


@query("X08_label_sentiment", f"SELECT doc_id, CASE WHEN label IN ('protocol_upgrade', 'listing', 'adoption', 'partnership') THEN 0.6e0 WHEN label IN ('regulatory', 'hack') THEN -0.4e0 ELSE 0e0 END AS sentiment FROM (SELECT doc_id, {TOPIC} AS label FROM documents)")
def _(t):
    return t.documents.select("doc_id", rules.sentiment(rules.topic(F.col("text"))).alias("sentiment"))


@query("X09_regime_classification", f"""WITH {SG} SELECT event_id, CASE WHEN h > 0.55 THEN 'trending' WHEN h < 0.45 THEN 'mean_reverting' ELSE 'random_walk' END AS label,
round(CASE WHEN h > 0.55 THEN (h - 0.55) / 0.45 WHEN h < 0.45 THEN (0.45 - h) / 0.45 ELSE 1 - abs(h - 0.5) / 0.05 END, 3) + 0e0 AS confidence FROM sg""")
def _(t):
    return signal_rows(t).select("event_id", rules.regime(F.col("h")).alias("r")).select("event_id", "r.label", (F.col("r.confidence") + 0.0).alias("confidence"))


@query("X10_range_ratio", f"WITH {v.HOURLY} SELECT symbol, ts, {rsql('(high - low) / close')} AS spread FROM hourly")
def _(t):
    return v.hourly(t).select("symbol", "ts", rnd(rules.range_ratio(F.col("high"), F.col("low"), F.col("close"))).alias("spread"))


@query("X11_calendar_features", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, CAST(day(o_orderdate) IN (1, 2, 3, 14, 15, 16, 17) AS INTEGER) AS pay_day FROM orders")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", rules.weekday(d).alias("dow"), rules.pay_day(d).alias("pay_day"))


@query("X12_probability_signal", f"""WITH {SG} SELECT event_id, CASE WHEN conf > 0.65 THEN 'BUY' WHEN conf <= 0.25 THEN 'SELL' ELSE 'HOLD' END AS direction, {rsql('2 * abs(conf - 0.5)')} AS confidence,
{rsql("CASE act WHEN 'BUY' THEN 0.5 + conf / 2 WHEN 'SELL' THEN 0.5 - conf / 2 ELSE 0.5 END")} AS p FROM sg""")
def _(t):
    return signal_rows(t).select("event_id", rules.from_probability(F.col("conf")).alias("s"), rnd(rules.to_probability(F.col("act"), F.col("conf"))).alias("p")).select(
        "event_id", "s.direction", rnd("s.confidence").alias("confidence"), "p")


@query("X13_kelly_size", f"WITH {SG} SELECT event_id, {rsql('1000 * conf * 0.25 * CASE WHEN vol > 0 THEN least(1, 0.01 / vol) ELSE 1 END')} AS size FROM sg")
def _(t):
    return signal_rows(t).select("event_id", rnd(rules.kelly_size(F.col("conf"), 1000.0, 0.25, F.col("vol"))).alias("size"))


@query("X14_var_check", f"WITH {SG} SELECT event_id, value * vol * 2 * sqrt(24e0) <= 1000 * 0.02 AS ok FROM sg")
def _(t):
    return signal_rows(t).select("event_id", rules.var_ok(F.col("vol"), F.col("value"), 1000.0, 0.02).alias("ok"))


MODULATE = """CASE WHEN act IN ('BUY', 'SELL') AND label IN ('hack', 'listing') THEN
  round(least(1, conf * CASE WHEN (label = 'listing') = (act = 'BUY') THEN 1.2e0 ELSE 0.6e0 END * CASE WHEN trust < 0.5 THEN 0.7e0 ELSE 1e0 END) + 1e-9, 3) ELSE conf END"""


@query("X15_news_modulation", f"WITH {SG} SELECT event_id, {rsql(MODULATE)} AS confidence FROM sg")
def _(t):
    return signal_rows(t).select("event_id", rnd(rules.news_modulate(*[F.col(x) for x in ("conf", "act", "label", "trust")])).alias("confidence"))


GATED = """ga AS (SELECT *, reg = 'trending' AND h >= 0.52 AS tr, reg = 'mean-reverting' AND h <= 0.48 AS rv FROM sg),
gb AS (SELECT *, CASE WHEN tr AND ret24 > 0.002 THEN 'BUY' WHEN tr AND ret24 < -0.002 THEN 'SELL' WHEN rv AND ret1 < -0.002 THEN 'BUY' WHEN rv AND ret1 > 0.002 THEN 'SELL' END AS side,
  conf * CASE WHEN tr THEN 0.8e0 ELSE 0.6e0 END * (1 - 0.5e0 * least(vol / 0.08e0, 1)) AS raw FROM ga),
gc AS (SELECT *, CASE WHEN side IS NOT NULL AND vol <= 0.08 AND raw >= 0.25 THEN side ELSE 'HOLD' END AS action,
  CASE WHEN side IS NOT NULL AND vol <= 0.08 AND raw >= 0.25 THEN round(least(raw, 0.95e0) + 1e-9, 3) ELSE 0e0 END AS sconf FROM gb)"""


def gated(t):
    g = rules.gated_signal(*[F.col(x) for x in ("reg", "conf", "h", "ret1", "ret24", "vol")])
    return signal_rows(t).withColumn("g", g).withColumns({"action": F.col("g.action"), "sconf": F.col("g.confidence")})


@query("X16_gated_heuristic_signal", f"WITH {SG}, {GATED} SELECT event_id, action, {rsql('sconf')} AS confidence FROM gc")
def _(t):
    return gated(t).select("event_id", "action", rnd("sconf").alias("confidence"))


@query("X17_engineered_features", f"""WITH {SG}, g AS (SELECT *, CASE WHEN vol > 0 THEN vol ELSE 0.001e0 END AS gv FROM sg) SELECT event_id, {rsql('abs(ret24) / gv')} AS vol_ratio, {rsql('abs(h - 0.5)')} AS hurst_strength, {rsql('ret1 / gv')} AS momentum_1h,
{rsql('ret24 / gv')} AS momentum_24h, CAST(reg = 'trending' AS DOUBLE) AS regime_trending, CAST(reg = 'mean-reverting' AS DOUBLE) AS regime_mean_reverting FROM g""")
def _(t):
    gv = F.when(F.col("vol") > 0, F.col("vol")).otherwise(0.001)
    return signal_rows(t).select(
        "event_id", rnd(F.abs("ret24") / gv).alias("vol_ratio"), rnd(F.abs(F.col("h") - 0.5)).alias("hurst_strength"), rnd(F.col("ret1") / gv).alias("momentum_1h"),
        rnd(F.col("ret24") / gv).alias("momentum_24h"), *[(F.col("reg") == r).cast("double").alias("regime_" + r.replace("-", "_")) for r in ("trending", "mean-reverting")])


@query("X18_fx_compounding", f"WITH {SG} SELECT event_id, {rsql('(1 + ret24) * (1 + coalesce(CASE WHEN event_id % 5 > 0 THEN ret1 END, 0)) - 1')} AS r FROM sg")
def _(t):
    fx = F.when(F.col("event_id") % 5 > 0, F.col("ret1"))
    return signal_rows(t).select("event_id", rnd(rules.compound_fx(F.col("ret24"), fx)).alias("r"))


@query("X19_normal_cdf_ppf")
def _(t):
    z = (F.col("value") - 50) / 25
    return t.events.select("event_id", normal.cdf(z).alias("cdf")).withColumn("ppf", normal.ppf(F.col("cdf")))


MODEL = {"features": ["h", "vol", "ret24"], "coef": [0.7, -1.1, 2.5], "mean": [0.5, 0.06, 0.0], "scale": [0.12, 0.04, 0.05], "intercept": -0.2}
Z = "-0.2e0 + 0.7e0 * (h - 0.5e0) / 0.12e0 - 1.1e0 * (vol - 0.06e0) / 0.04e0 + 2.5e0 * ret24 / 0.05e0"


@query("X20_frozen_logistic_score", f"WITH {SG} SELECT event_id, {rsql(f'1 / (1 + exp(-({Z})))')} AS p FROM sg")
def _(t):
    return signal_rows(t).select("event_id", rnd(rules.logistic_score(MODEL)).alias("p"))


@query("X21_json_signal_round_trip", f"""WITH {SG} SELECT event_id, event_type AS symbol, act AS action, {rsql('conf', 4)} AS confidence FROM sg""")
def _(t):
    s = F.to_json(F.struct(F.col("event_type").alias("symbol"), F.struct(F.col("act").alias("action"), F.col("conf").alias("confidence")).alias("signal")))
    schema = "symbol string, signal struct<action: string, confidence: double>"
    d = signal_rows(t).select("event_id", F.from_json(s, schema).alias("j"))
    return d.select("event_id", "j.symbol", "j.signal.action", rnd("j.signal.confidence", 4).alias("confidence"))


@query("X22_rebalance_period", "WITH d AS (SELECT DISTINCT o_orderdate AS ts FROM orders), p AS (SELECT ts, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) / 28.0) AS BIGINT) AS period FROM d) SELECT ts, period, coalesce(period > lag(period) OVER (ORDER BY ts), true) AS due, date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) % 28 <> 0 AS catch_up FROM p")
def _(t):
    from tideline.operators import scan
    anchor = F.lit("1995-01-01").cast("date")
    d = t.orders.select(F.col("o_orderdate").alias("ts")).distinct().withColumns({"_g": F.lit(0), "period": rules.period_index(F.col("ts"), anchor)})
    d = scan.over_series(d, lambda d, w: d.withColumn("due", F.coalesce(F.col("period") > F.lag("period").over(w), F.lit(True))), ["_g"], back=1, chunk="year")
    return d.select("ts", "period", "due", (F.datediff(F.to_date("ts"), anchor) % 28 != 0).alias("catch_up"))


@query("X23_step_rounding", "SELECT l_orderkey, l_linenumber, round(floor(l_extendedprice / 0.25e0 + 1e-9) * 0.25e0, 4) AS qty FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(rules.round_step(F.col("l_extendedprice"), F.lit(0.25)), 4).alias("qty"))


@query("X25_taker_imbalance", f"WITH {v.HOURLY} SELECT symbol, ts, {rsql('CASE WHEN volume > 1 THEN n / (volume * 3e0) - 0.5 END')} AS imbalance FROM hourly")
def _(t):
    vol = F.when(F.col("volume") > 1, F.col("volume") * 3).otherwise(0.0)
    return v.hourly(t).select("symbol", "ts", rnd(rules.taker_imbalance(F.col("n"), vol)).alias("imbalance"))


FILTERS = T.ArrayType(T.StructType([T.StructField("filterType", T.StringType()), T.StructField("stepSize", T.StringType()), T.StructField("notional", T.StringType())]))


@query("X26_instrument_filters", """SELECT p_partkey, (p_size % 5 + 1) / 100e0 AS step_size, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 5e0 END AS min_notional FROM part""")
def _(t):
    js = F.concat(F.lit('[{"filterType":"LOT_SIZE","stepSize":"'), ((F.col("p_size") % 5 + 1) / 100.0).cast("string"), F.lit('"}'),
                  F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(',{"filterType":"MIN_NOTIONAL","notional":"'), F.col("p_size").cast("string"), F.lit('"}'))).otherwise(""), F.lit("]"))
    f = F.from_json(js, FILTERS)
    pick = lambda kind, field: F.filter(f, lambda x: x["filterType"] == kind)[field]
    first = lambda a: F.try_element_at(a, F.lit(1)).cast("double")
    return t.part.select("p_partkey", first(pick("LOT_SIZE", "stepSize")).alias("step_size"),
                         F.coalesce(first(pick("MIN_NOTIONAL", "notional")), F.lit(5.0)).alias("min_notional"))


@query("X27_news_fields_of_signal", f"WITH {SG} SELECT event_id, label AS news_cluster, CASE WHEN label IS NOT NULL THEN {rsql('trust')} END AS trust FROM sg")
def _(t):
    news = F.when(F.col("label").isNotNull(), F.struct(F.col("label").alias("news_cluster"), F.col("trust")))
    d = signal_rows(t).select("event_id", F.struct(news.alias("news")).alias("signal"))
    return d.select("event_id", "signal.news.news_cluster", rnd("signal.news.trust").alias("trust"))


@query("X28_symbol_helpers", "SELECT c_custkey, upper(split_part(p, '_', 2)) AS pocket, upper(split_part(p, '_', 1)) || 'USDT' AS contract, replace(p, '/', '_') AS safe FROM (SELECT c_custkey, lower(c_mktsegment) || '_mxn' AS p FROM customer)")
def _(t):
    p = F.concat(F.lower("c_mktsegment"), F.lit("_mxn"))
    return t.customer.select("c_custkey", rules.quote_pocket(p).alias("pocket"), rules.contract_name(p).alias("contract"), rules.safe_name(p).alias("safe"))


MAPPING = {"click": "CLICK/USD", "view": "VIEW/USD", "error": "ERR/USD"}


@query("S02_symbol_canonicalisation", "SELECT CASE event_type WHEN 'click' THEN 'CLICK/USD' WHEN 'view' THEN 'VIEW/USD' WHEN 'error' THEN 'ERR/USD' ELSE event_type END AS symbol, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(rules.lookup(F.col("event_type"), MAPPING).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
