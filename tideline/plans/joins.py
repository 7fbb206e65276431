"""J01-J18, E01-E05, F01-F16."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import bars, cross, joins, scan
from tideline.operators import timeseries as ts
from tideline.plans import views as v
from tideline.plans.registry import query, rnd, rsql

H = "PARTITION BY symbol ORDER BY ts"


@query("J01_inner_composite_key", """SELECT d.source, l.quality, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def _(t):
    return t.documents.join(t.labels, "doc_id").groupBy("source", "quality").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("J02_left_join", """SELECT d.source, count(*) AS n, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"))


@query("J03_panel_with_fx", f"WITH {v.PANEL}, {v.FX} SELECT symbol, ts, close, {rsql('fx', 9)} AS fx FROM panel LEFT JOIN fx USING (ts)")
def _(t):
    return v.panel(t).join(v.fx(t), "ts", "left").select("symbol", "ts", "close", rnd("fx", 9).alias("fx"))


@query("J04_four_series_on_date", """WITH d AS (SELECT o_orderpriority p, o_orderdate ts, sum(o_totalprice) x FROM orders GROUP BY 1, 2)
SELECT a.ts, round(a.x, 2) AS x1, round(b.x, 2) AS x2, round(c.x, 2) AS x3, round(e.x, 2) AS x4 FROM d a JOIN d b USING (ts) JOIN d c USING (ts) JOIN d e USING (ts)
WHERE a.p = '1-URGENT' AND b.p = '2-HIGH' AND c.p = '3-MEDIUM' AND e.p = '5-LOW'""")
def _(t):
    d = t.orders.groupBy("o_orderpriority", F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("x"))

    def leg(p, name):
        return d.where(F.col("o_orderpriority") == p).select("ts", F.round("x", 2).alias(name))

    return leg("1-URGENT", "x1").join(leg("2-HIGH", "x2"), "ts").join(leg("3-MEDIUM", "x3"), "ts").join(leg("5-LOW", "x4"), "ts")


@query("J05_market_factor", f"""WITH {v.PANEL}, m AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS r FROM panel WHERE symbol = 'Brand#1')
SELECT symbol, ts, {rsql('r')} AS market_ret FROM panel LEFT JOIN m USING (ts)""")
def _(t):
    p = v.panel(t)
    m = ts.returns(p.where("symbol = 'Brand#1'"), chunk="year").select("ts", F.col("ret_1").alias("r"))
    return p.join(m, "ts", "left").select("symbol", "ts", rnd("r").alias("market_ret"))


@query("J06_asof_calendar_offset", f"""WITH {v.HOURLY}, p AS (SELECT symbol, ts, close, ts - INTERVAL 24 HOUR AS at FROM hourly)
SELECT p.symbol, p.ts, {rsql('p.close / b.close - 1')} AS ret_24h FROM p ASOF LEFT JOIN hourly b ON p.symbol = b.symbol AND p.at >= b.ts""")
def _(t):
    d = joins.as_of_offset(v.hourly(t), "close", "24 hours", "past")
    return d.select("symbol", "ts", rnd(ts.ratio(F.col("close"), F.col("past")) - 1).alias("ret_24h"))


@query("J07_asof_features_on_stamps", f"""WITH {v.HOURLY}, s AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS TIMESTAMP) AS ts),
p AS (SELECT symbol, s.ts FROM s, (SELECT DISTINCT symbol FROM hourly) u)
SELECT p.symbol, p.ts, b.ts AS asof_ts, b.close, b.n FROM p ASOF LEFT JOIN hourly b ON p.symbol = b.symbol AND p.ts >= b.ts""")
def _(t):
    h = v.hourly(t)
    stamps = F.sequence(F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-30").cast("timestamp_ntz"), F.expr("interval 1 day"))
    p = h.select("symbol").distinct().select("symbol", F.explode(stamps).alias("ts"))
    return joins.as_of(p, h, ["symbol"], ["close", "n"]).select("symbol", "ts", "asof_ts", "close", "n")


@query("J08_forward_positional", f"WITH {v.HOURLY} SELECT symbol, ts, {rsql(f'lead(close, 24) OVER ({H}) / close - 1')} AS fwd FROM hourly")
def _(t):
    d = scan.over_series(v.hourly(t), lambda d, w: d.withColumn("fwd", ts.lead_return("close", 24, w)), ahead=24)
    return d.select("symbol", "ts", rnd("fwd").alias("fwd"))


@query("J09_forward_tolerance", f"""WITH {v.PANEL}
SELECT a.symbol, a.ts, min(b.ts) AS next_ts, {rsql('arg_min(b.close, b.ts) / any_value(a.close) - 1')} AS fwd
FROM panel a JOIN panel b ON a.symbol = b.symbol AND b.ts BETWEEN a.ts + INTERVAL 28 DAY AND a.ts + INTERVAL 36 DAY GROUP BY 1, 2""")
def _(t):
    p = v.panel(t).select("symbol", "ts", "close")
    d = joins.first_within(p, p, ["symbol"], ["close"], 28, 8)
    return d.select("symbol", "ts", "next_ts", rnd(ts.ratio(F.col("next_close"), F.col("close")) - 1).alias("fwd"))


@query("J10_semi_join_on_dates", f"""WITH {v.PANEL} SELECT symbol, ts, close FROM panel WHERE ts IN
(SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) FROM orders WHERE o_totalprice > 490000)""")
def _(t):
    days = t.orders.where("o_totalprice > 490000").select(bars.bucket("o_orderdate", "week").alias("ts")).distinct()
    return v.panel(t).join(days, "ts", "left_semi").select("symbol", "ts", "close")


BLOCKS = """blocks AS (SELECT * FROM (VALUES (TIMESTAMP '1996-03-01', TIMESTAMP '1996-03-31'), (TIMESTAMP '1998-07-01', TIMESTAMP '1998-07-31')) v(s, e))"""


@query("J11_range_anti_join", f"""WITH {v.PANEL}, {BLOCKS} SELECT symbol, ts FROM panel p WHERE NOT EXISTS
(SELECT 1 FROM blocks WHERE p.ts BETWEEN s - INTERVAL 14 DAY AND e + INTERVAL 21 DAY)""")
def _(t):
    b = t.spark.sql("SELECT * FROM VALUES (timestamp_ntz'1996-03-01', timestamp_ntz'1996-03-31'), (timestamp_ntz'1998-07-01', timestamp_ntz'1998-07-31') AS v(start, end)")
    return joins.outside_blocks(v.panel(t).select("symbol", "ts"), b, 14, 21)


@query("J12_window_exclusion", f"WITH {v.PANEL} SELECT symbol, ts FROM panel WHERE NOT (ts BETWEEN TIMESTAMP '1997-01-01' - INTERVAL 28 DAY AND TIMESTAMP '1997-01-01' + INTERVAL 56 DAY)")
def _(t):
    t0 = F.lit("1997-01-01").cast("timestamp_ntz")
    near = F.col("ts").between(t0 - F.expr("interval 28 days"), t0 + F.expr("interval 56 days"))
    return v.panel(t).where(~near).select("symbol", "ts")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def priority_daily(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
        F.avg("o_totalprice").alias("close"))


PRIORITY = "pd AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)"


@query("J13_pair_series", f"""WITH {PRIORITY} SELECT a.symbol AS a, b.symbol AS b, a.ts, {rsql('ln(a.close) - ln(b.close)')} AS spread
FROM pd a JOIN pd b ON a.ts = b.ts AND a.symbol < b.symbol""")
def _(t):
    d = joins.pair_series(priority_daily(t), joins.symbol_pairs(t.spark, PRIORITIES), "close")
    return d.select("a", "b", "ts", rnd(F.log("value_a") - F.log("value_b")).alias("spread"))


@query("J15_twin_alignment", f"""WITH x AS (SELECT event_id % 2 AS src, event_type AS symbol, CAST(ts AS DATE) AS d, avg(value) AS px FROM events GROUP BY 1, 2, 3),
j AS (SELECT a.symbol, a.d, a.px AS pa, b.px AS pb FROM x a JOIN x b ON a.symbol = b.symbol AND a.d = b.d WHERE a.src = 0 AND b.src = 1),
r AS (SELECT *, pa / lag(pa) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ra, pb / lag(pb) OVER (PARTITION BY symbol ORDER BY d) - 1 AS rb FROM j)
SELECT symbol, count(*) AS n_common, {rsql('stddev_samp(ra)', 5)} AS vol_a, {rsql('stddev_samp(rb)', 5)} AS vol_b, {rsql('corr(ra, rb)', 5)} AS corr,
  abs(stddev_samp(ra) - stddev_samp(rb)) <= 0.01 AS vol_ok FROM r GROUP BY 1""")
def _(t):
    x = t.events.groupBy((F.col("event_id") % 2).alias("src"), F.col("event_type").alias("symbol"), bars.bucket("ts", "day").alias("ts")).agg(F.avg("value").alias("px"))
    a = x.where("src = 0").select("symbol", "ts", F.col("px").alias("pa"))
    j = a.join(x.where("src = 1").select("symbol", "ts", F.col("px").alias("pb")), ["symbol", "ts"])
    r = scan.over_series(j, lambda d, w: d.withColumns({"ra": ts.lag_return("pa", 1, w), "rb": ts.lag_return("pb", 1, w)}), back=1)
    va, vb = F.stddev_samp("ra"), F.stddev_samp("rb")
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_common"), rnd(va, 5).alias("vol_a"), rnd(vb, 5).alias("vol_b"),
                                   rnd(F.corr("ra", "rb"), 5).alias("corr"), (F.abs(va - vb) <= 0.01).alias("vol_ok"))


@query("J16_label_prob_join", f"""WITH {v.PANEL} SELECT p.symbol, p.ts, {rsql('p.volume / (p.volume + 100)')} AS prob, q.n AS n_orders
FROM panel p JOIN (SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) ts, p_brand AS symbol, count(*) n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) q
ON p.symbol = q.symbol AND p.ts = q.ts""")
def _(t):
    q = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        bars.bucket("o_orderdate", "week").alias("ts"), F.col("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("n_orders"))
    return v.panel(t).join(q, ["symbol", "ts"]).select("symbol", "ts", rnd(F.col("volume") / (F.col("volume") + 100)).alias("prob"), "n_orders")


@query("J17_second_precision_join", """SELECT e.event_id, s.first_id FROM events e JOIN
(SELECT event_type, date_trunc('second', ts) AS sec, min(event_id) AS first_id FROM events GROUP BY 1, 2) s ON e.event_type = s.event_type AND date_trunc('second', e.ts) = s.sec""")
def _(t):
    e = t.events.withColumn("sec", F.date_trunc("second", "ts"))
    s = e.groupBy("event_type", "sec").agg(F.min("event_id").alias("first_id"))
    return e.join(s, ["event_type", "sec"]).select("event_id", "first_id")


@query("J18_point_assembly", f"""WITH {v.HOURLY}, f AS (SELECT symbol, ts, lead(close, 24) OVER ({H}) / close - 1 AS fwd FROM hourly)
SELECT h.symbol, h.ts, {rsql('(h.high - h.low) / h.close')} AS spread, CAST(f.fwd > 0 AS INTEGER) AS y FROM hourly h JOIN f ON h.symbol = f.symbol AND h.ts = f.ts WHERE f.fwd IS NOT NULL""")
def _(t):
    h = v.hourly(t)
    f = scan.over_series(h, lambda d, w: d.withColumn("fwd", ts.lead_return("close", 24, w)), ahead=24).where("fwd IS NOT NULL").select("symbol", "ts", "fwd")
    return h.join(f, ["symbol", "ts"]).select("symbol", "ts", rnd((F.col("high") - F.col("low")) / F.col("close")).alias("spread"), (F.col("fwd") > 0).cast("int").alias("y"))


# ---- set operations ----------------------------------------------------------------------------
@query("E01_union_by_name", """SELECT CAST(event_type AS VARCHAR) AS symbol, ts, value AS price, CAST(NULL AS DOUBLE) AS qty FROM events
UNION ALL SELECT l_returnflag, l_shipdate, l_extendedprice, l_quantity FROM lineitem""")
def _(t):
    a = t.events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))
    b = t.lineitem.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    return a.unionByName(b, allowMissingColumns=True)


@query("E02_common_dates", "SELECT o_orderdate AS ts FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT l_shipdate FROM lineitem WHERE l_quantity = 50")
def _(t):
    a = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").alias("ts"))
    return a.intersect(t.lineitem.where("l_quantity = 50").select("l_shipdate"))


@query("E03_excluded_symbols", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def _(t):
    return t.customer.select("c_custkey").subtract(t.orders.where("o_totalprice > 300000").select("o_custkey"))


@query("E04_key_union_zero_fill", f"""WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS x FROM lineitem WHERE l_quantity > 49 GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_quantity) AS y FROM lineitem WHERE l_quantity < 2 GROUP BY 1)
SELECT k, coalesce(x, 0e0) AS x, coalesce(y, 0e0) AS y FROM a FULL JOIN b USING (k)""")
def _(t):
    a = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("x"))
    b = t.lineitem.where("l_quantity < 2").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("y"))
    return joins.zero_filled_union(a, b, ["k"], ["x", "y"])


@query("E05_distinct", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def _(t):
    return t.orders.select("o_custkey", "o_orderpriority").dropDuplicates()


# ---- filters and projections ----------------------------------------------------------------
@query("F01_universe_predicate", "SELECT p_brand AS symbol, count(*) AS n FROM part WHERE p_brand LIKE 'Brand#%' AND NOT contains(p_type, '_') AND p_brand NOT IN ('Brand#3', 'Brand#7') GROUP BY 1")
def _(t):
    keep = F.col("p_brand").startswith("Brand#") & ~F.col("p_type").contains("_") & ~F.col("p_brand").isin("Brand#3", "Brand#7")
    return t.part.where(keep).groupBy(F.col("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query("F02_sparse_bar_filter", f"""WITH {v.HOURLY} SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_max(close, ts) AS close, count(*) AS n_candles FROM hourly GROUP BY 1, 2 HAVING count(*) >= 10""")
def _(t):
    return bars.roll_up(v.hourly(t), "day", 10).select("symbol", "ts", "close", "n_candles")


@query("F03_entry_age_mask", f"""WITH {v.PANEL} SELECT symbol, ts, CASE WHEN row_number() OVER ({H}) > 60 THEN {rsql(f'ln(close / lag(close) OVER ({H}))')} END AS log_ret FROM panel""")
def _(t):
    d = scan.over_series(v.panel(t), lambda d, w: d.withColumn("lr", F.when(F.col("_pos") >= 60, ts.log_return("close", w))), back=1, chunk="year")
    return d.select("symbol", "ts", rnd("lr").alias("log_ret"))


@query("F04_complete_days", "SELECT event_type AS symbol, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts < date_trunc('day', (SELECT max(ts) FROM events)) GROUP BY 1, 2")
def _(t):
    now = t.events.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("cut"))
    d = t.events.crossJoin(F.broadcast(now)).where("ts < cut")  # one-row side
    return d.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("F05_operability_flag", f"WITH {v.PANEL} SELECT symbol, ts, close, symbol NOT IN ('Brand#3', 'Brand#7') AS operable FROM panel")
def _(t):
    return v.panel(t).select("symbol", "ts", "close", (~F.col("symbol").isin("Brand#3", "Brand#7")).alias("operable"))


FEAT = f"ft AS (SELECT symbol, ts, close / lag(close, 5) OVER ({H}) - 1 AS f, lead(close) OVER ({H}) / close - 1 AS y FROM panel)"


def feat(t):
    return scan.over_series(v.panel(t), lambda d, w: d.withColumns({"f": ts.lag_return("close", 5, w), "y": ts.lead_return("close", 1, w)}), back=5, ahead=1, chunk="year")


@query("F06_score_and_learn_base", f"WITH {v.PANEL}, {FEAT} SELECT 'score' AS base, symbol, count(*) AS n FROM ft WHERE f IS NOT NULL GROUP BY 2 UNION ALL SELECT 'learn', symbol, count(*) FROM ft WHERE f IS NOT NULL AND y IS NOT NULL GROUP BY 2")
def _(t):
    d = feat(t)
    score = d.dropna(subset=["f"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.lit("score"))
    learn = d.dropna(subset=["f", "y"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.lit("learn"))
    return score.unionByName(learn)


@query("F07_asof_truncation", "SELECT event_type AS symbol, count(*) AS n, max(ts) AS last_ts FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def _(t):
    return t.events.where(F.col("ts") <= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).groupBy(F.col("event_type").alias("symbol")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


SYMS = """CASE WHEN doc_id % 3 = 0 THEN '["BTC","ETH"]' WHEN doc_id % 3 = 1 THEN '["SOL"]' ELSE '["BTC"]' END"""


@query("F08_json_array_membership", f"SELECT doc_id, source FROM documents WHERE {SYMS} LIKE '%\"BTC\"%'")
def _(t):
    d = t.documents.withColumn("symbols", F.expr(SYMS))
    return d.where(joins.json_array_contains("symbols", "BTC")).select("doc_id", "source")


@query("F09_time_window_predicate", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-10'")
def _(t):
    at = F.lit("2024-01-10").cast("timestamp_ntz")
    return t.events.where((F.col("ts") > at - F.expr("interval 24 hours")) & (F.col("ts") <= at)).select("event_id")


@query("F10_price_and_range_guard", "SELECT event_id, value FROM events WHERE value > 1 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def _(t):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-20"))
    return t.events.where((F.col("value") > 1) & F.col("ts").between(lo, hi)).select("event_id", "value")


@query("F11_min_observations", f"WITH {v.USER_DAILY} SELECT symbol, ts, close FROM user_daily WHERE symbol IN (SELECT symbol FROM user_daily GROUP BY 1 HAVING count(close) >= 10)")
def _(t):
    d = scan.with_group(v.user_daily(t), ["symbol"], obs=F.count("close"))
    return d.where("obs >= 10").select("symbol", "ts", "close")


@query("F12_clean_text", "SELECT doc_id FROM documents WHERE NOT (text ILIKE '%ignore%') AND length(trim(text)) > 0")
def _(t):
    return t.documents.where(~F.col("text").ilike("%ignore%") & (F.length(F.trim("text")) > 0)).select("doc_id")


@query("F13_projection_rename_assign", "SELECT l_orderkey AS order_id, l_quantity AS qty, round(l_extendedprice * (1 - l_discount), 5) AS net FROM lineitem")
def _(t):
    return t.lineitem.withColumnsRenamed({"l_orderkey": "order_id", "l_quantity": "qty"}).withColumns(
        {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 5)}).select("order_id", "qty", "net")


@query("F14_grid_sampling", f"WITH {v.PANEL}, g AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS k FROM panel) SELECT symbol, ts, close FROM g WHERE (k - 1 - 2) % 4 = 0 AND k > 2")
def _(t):
    p = v.panel(t)
    return p.join(cross.grid_dates(p, 4, 2), "ts").select("symbol", "ts", "close")


@query("F15_non_overlapping_rows", f"WITH {v.PANEL}, g AS (SELECT *, row_number() OVER ({H}) - 1 AS k FROM panel) SELECT symbol, ts, close FROM g WHERE k >= 4 AND k % 4 = 0")
def _(t):
    return scan.number_rows(v.panel(t), chunk="year").where("_pos >= 4 AND _pos % 4 = 0").select("symbol", "ts", "close")


@query("F16_eligible_dates", f"""WITH {v.PANEL}, g AS (SELECT *, row_number() OVER ({H}) AS k, lead(ts, 4) OVER ({H}) AS nxt FROM panel)
SELECT ts, count(DISTINCT symbol) AS n FROM g WHERE k >= 64 AND nxt IS NOT NULL GROUP BY 1 HAVING count(DISTINCT symbol) >= 6""")
def _(t):
    d = scan.over_series(v.panel(t), lambda d, w: d.withColumns({"nxt": F.lead("ts", 4).over(w), "k": F.col("_pos") + 1}), ahead=4, chunk="year")
    return d.where("k >= 64 AND nxt IS NOT NULL").groupBy("ts").agg(F.count_distinct("symbol").alias("n")).where("n >= 6")
