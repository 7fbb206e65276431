"""Streaming jobs over the events table, compared with their batch meaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline.plans import views as v
from tideline.plans.registry import query, rnd, rsql
from tideline.plans.storage import fresh
from tideline.streaming import jobs

W = "PARTITION BY event_type ORDER BY ts, event_id"
CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


def stream(t):
    return jobs.event_stream(t.spark, t.sf_dir)


def sliced(t, batches=6):
    """The events in `batches` micro-batches of five days; every eleventh row comes one micro-batch late."""
    path = fresh(t, "replay")
    day = F.datediff("ts", F.lit("2024-01-01"))
    arrival = F.least(F.greatest((day / 5).cast("int"), F.lit(0)) + (F.col("event_id") % 11 == 0).cast("int"), F.lit(batches - 1))
    jobs.replay(t.events, arrival, path, 0, batches - 1)
    return jobs.event_stream(t.spark, path, "*.parquet", 1)


LATE = "12 days"
SETTLED = "(SELECT max(ts) - INTERVAL 12 DAY FROM events)"


@query("R01_incremental_dedup", "SELECT event_id, event_type, value FROM events")
def _(t):
    s = stream(t)
    twice = s.union(stream(t))
    return jobs.drain(jobs.deduplicated(twice, ["event_id"], "60 days")).select("event_id", "event_type", "value")


@query("R02_streaming_candles", f"WITH h AS ({v._bars_sql('hour')}) SELECT symbol, ts, open, high, low, close, n FROM h WHERE ts + INTERVAL 1 HOUR <= {CLOSED}")
def _(t):
    return jobs.drain(jobs.candles(stream(t), "1 hour", "2 hours")).select("symbol", "ts", "open", "high", "low", "close", "n")


@query("R03_late_data_upsert", f"WITH {v.HOURLY} SELECT symbol, ts, n FROM hourly")
def _(t):
    path = fresh(t, "late")

    def recompute(batch):
        hours = batch.select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
        all_rows = t.events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
        d = all_rows.join(hours, ["event_type", "hour"], "left_semi").groupBy(F.col("event_type").alias("symbol"), F.col("hour").alias("ts"))
        return d.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("version")).withColumn("day", F.to_date("ts"))

    jobs.late_upsert(stream(t), path, ["symbol", "ts"], "version", ["day"], recompute)
    return t.spark.read.parquet(path).select("symbol", "ts", "n")


@query("R04_sliding_window", f"""WITH w AS (SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) - INTERVAL 1 HOUR * k AS ts, value FROM events, (SELECT unnest(range(24)) AS k))
SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, count(*) AS n, {rsql('sum(value)', 4)} AS total FROM w WHERE ts + INTERVAL 24 HOUR <= {CLOSED} GROUP BY 1, 2""")
def _(t):
    return jobs.drain(jobs.totals(stream(t), "24 hours", "2 hours", "1 hour")).select("symbol", "ts", "n", rnd("total", 4).alias("total"))


@query("R05_delayed_outcomes", f"""WITH o AS (SELECT a.event_id, any_value(a.event_type) AS symbol, any_value(a.ts) AS ts, arg_min(b.event_id, row(b.ts, b.event_id)) AS out_id, arg_min(b.value, row(b.ts, b.event_id)) AS out_value
FROM events a LEFT JOIN events b ON a.event_type = b.event_type AND b.ts >= a.ts + INTERVAL 24 HOUR AND b.ts < a.ts + INTERVAL 25 HOUR GROUP BY a.event_id)
SELECT symbol, event_id, out_id, out_value FROM o WHERE to_timestamp((epoch_us(ts + INTERVAL 24 HOUR) // 21600000000) * 21600 + 21600 + 3600)::TIMESTAMP <= {SETTLED}""")
def _(t):
    s = sliced(t).select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    return jobs.drain(jobs.outcomes(s, 24, LATE))


def stateful(t, processor, schema):
    return jobs.drain(jobs.keyed(stream(t), processor, schema))


@query("R06_grid_rebalance", f"""WITH e AS (SELECT user_id AS book, event_id, ts, event_type AS asset, value + 1000 AS price, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {SETTLED}),
r AS (SELECT *, n // 7 AS period FROM e QUALIFY row_number() OVER (PARTITION BY book, n // 7 ORDER BY ts, event_id) = 1),
f AS (SELECT book, event_id, ts, period, n, lag(ts) OVER (PARTITION BY book ORDER BY ts) AS p_ts, lag(event_id) OVER (PARTITION BY book ORDER BY ts) AS p_id FROM r),
a AS (SELECT f.book, f.event_id, f.period, f.n, e.asset, arg_max(e.price, row(e.ts, e.event_id)) AS price,
  arg_max(e.price, row(e.ts, e.event_id)) FILTER (WHERE f.p_ts IS NOT NULL AND (e.ts, e.event_id) <= (f.p_ts, f.p_id)) AS base
  FROM f JOIN e ON e.book = f.book AND (e.ts, e.event_id) <= (f.ts, f.event_id) GROUP BY ALL),
d AS (SELECT *, coalesce(price / base, 0) / coalesce(sum(price / base) OVER k, 1) AS drift, count(*) OVER k AS assets FROM a WINDOW k AS (PARTITION BY book, event_id))
SELECT CAST(book AS BIGINT) AS book, event_id, CAST(period AS BIGINT) AS period, any_value(n) % 7 <> 0 AS catch_up, count(*) AS assets, {rsql('sum(abs(1.0e0 / assets - drift))')} AS turnover FROM d GROUP BY book, event_id, period""")
def _(t):
    s = sliced(t).select(F.col("user_id").cast("long").alias("book"), "ts", "event_id", F.col("event_type").alias("asset"), (F.col("value") + 1000).alias("value"))
    return jobs.drain(jobs.rebalances(s, "2024-01-01", LATE)).withColumn("turnover", rnd("turnover"))


@query("R07_duplicate_run_guard", "SELECT event_type AS symbol, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2")
def _(t):
    s = stream(t).withColumn("day", F.to_date("ts")).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_type", "day"])
    return jobs.drain(s.select(F.col("event_type").alias("symbol"), "day"))


@query("R08_drawdown_alert", f"""WITH d AS (SELECT event_type AS symbol, event_id, CAST(ts AS DATE) AS day, ts, (value + 1000) / max(value + 1000) OVER ({W}) - 1 AS dd FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, event_id) AS k FROM d WHERE dd <= -0.03) SELECT symbol, event_id, {rsql('dd')} AS "drop" FROM k WHERE k = 1""")
def _(t):
    return stateful(t, jobs.DrawdownAlert(), "symbol string, event_id long, drop double").select("symbol", "event_id", rnd("drop").alias("drop"))


WM = W.replace("PARTITION BY event_type", "PARTITION BY event_type, date_trunc('month', ts)")


@query("R09_budget_brake", f"SELECT event_type AS symbol, event_id, {rsql('sum(value) OVER (' + WM + ')', 4)} AS spent, sum(value) OVER ({WM}) > 5000 AS braked FROM events")
def _(t):
    return stateful(t, jobs.RunningSpend(), "symbol string, event_id long, spent double, braked boolean").select("symbol", "event_id", rnd("spent", 4).alias("spent"), "braked")


@query("R10_incremental_ewma", f"""WITH e AS (SELECT event_type AS symbol, event_id, value, row_number() OVER ({W}) - 1 AS i FROM events),
v0 AS (SELECT symbol, var_pop(value) AS v0 FROM e WHERE i < 20 GROUP BY 1),
ev AS (SELECT a.symbol, a.event_id, power(0.94e0, a.i - 18) * any_value(v0) + sum(0.06e0 * power(0.94e0, a.i - b.i) * b.value * b.value) AS v FROM e a JOIN v0 USING (symbol) JOIN e b ON a.symbol = b.symbol AND b.i BETWEEN 19 AND a.i WHERE a.i >= 19 GROUP BY a.symbol, a.event_id, a.i)
SELECT e.symbol, e.event_id, {rsql('v', 4)} AS v FROM e LEFT JOIN ev USING (symbol, event_id)""")
def _(t):
    return stateful(t, jobs.EwmaVariance(), "symbol string, event_id long, v double").select("symbol", "event_id", rnd("v", 4).alias("v"))


@query("R11_staleness_guard", "SELECT user_id AS symbol, max(ts) AS newest, max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY AS hold FROM events GROUP BY 1")
def _(t):
    return jobs.stale(t.events.select(F.col("user_id").alias("symbol"), "ts"), F.lit("2024-01-31").cast("timestamp_ntz"))


@query("R11b_staleness_stream", f"""WITH e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol, ts FROM events), g AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS n FROM e)
SELECT symbol, ts AS newest, ts + INTERVAL 2 DAY AS hold_from FROM g WHERE (n IS NULL OR n > ts + INTERVAL 2 DAY) AND ts + INTERVAL 2 DAY <= {SETTLED}""")
def _(t):
    return jobs.drain(jobs.holds(sliced(t).select(F.col("user_id").cast("string").alias("symbol"), "ts"), 2 * 86_400, LATE))


@query("R12_session_windows", f"""WITH e AS (SELECT user_id, ts, value, CASE WHEN user_id % 2 = 0 THEN INTERVAL 20 HOUR ELSE INTERVAL 36 HOUR END AS gap FROM events),
b AS (SELECT *, CASE WHEN ts > lag(ts) OVER k + gap THEN 1 ELSE 0 END AS cut FROM e WINDOW k AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, count(*) AS n, {rsql('sum(value)', 4)} AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, k HAVING max(ts) + any_value(gap) <= {SETTLED}""")
def _(t):
    gap = F.when(F.col("user_id") % 2 == 0, "20 hours").otherwise("36 hours")
    return jobs.drain(jobs.sessions(sliced(t), ["user_id"], gap, LATE)).withColumn("total", rnd("total", 4))
