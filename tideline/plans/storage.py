"""Reads and keyed sinks, each written to a fresh folder and read back."""
from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tideline import schemas
from tideline.functions import rules
from tideline.operators import quality, scan, text
from tideline.operators import timeseries as ts
from tideline.plans import views as v
from tideline.plans.registry import query, rnd, rsql
from tideline.session import cut_lineage, shared_dir
from tideline.sources import readers, sinks

COLS = ["symbol", "ts", "open", "high", "low", "close"]


def fresh(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def hour_rows(t):
    return v.hourly(t).select(*COLS)


@query("S01_candle_ingest", f"WITH {v.HOURLY} SELECT symbol || '/USD' AS symbol, '1h' AS timeframe, ts, close FROM hourly WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def _(t):
    raw = hour_rows(t).withColumn("open_time", F.unix_timestamp("ts") * 1000).drop("ts")
    raw = raw.unionByName(raw.where(F.col("open_time") % 7200000 == 0))  # a page fetched twice
    d = sinks.ingest(raw, "2024-01-05", "2024-01-20", F.concat("symbol", F.lit("/USD")), "1h")
    return d.select("symbol", "timeframe", "ts", "close")


def zipped(t, micro=False):
    """One archive per (symbol, month) of hourly candles, as (path, content) rows."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        head = ",".join(readers.KLINE_COLUMNS) + "\n" if micro else ""
        lines = [f"{o},{a!r},{b!r},{c!r},{d!r},{q!r},0,{z!r},{n},0,0,0" for o, a, b, c, d, q, z, n in zip(
            pdf["open_time"], pdf["open"], pdf["high"], pdf["low"], pdf["close"], pdf["volume"], pdf["quote_volume"], pdf["n"], strict=True)]
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("part.csv", head + "\n".join(lines))
        return pd.DataFrame({"path": [f"{pdf['symbol'].iloc[0]}-1h-{pdf['month'].iloc[0]}.zip"], "content": [buf.getvalue()]})

    unit = 1_000_000 if micro else 1000
    h = v.hourly(t).withColumns({"open_time": F.unix_timestamp("ts") * unit, "month": F.date_format("ts", "yyyy-MM")})
    return h.groupBy("symbol", "month").applyInPandas(pack, "path string, content binary")


@query("S03_kline_archives", f"WITH {v.HOURLY} SELECT symbol, ts, open, high, low, close, n AS n_trades FROM hourly")
def _(t):
    k = readers.klines(zipped(t, micro=True))
    return k.select(F.split_part("path", F.lit("-"), F.lit(1)).alias("symbol"), "ts", "open", "high", "low", "close", "n_trades")


@query("S04_funding_archives", "SELECT event_type AS symbol, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, CAST(8 AS INTEGER) AS interval_hours, value AS rate FROM events")
def _(t):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("f.csv", "\n".join(f"{m},8,{x!r}" for m, x in zip(pdf["ms"], pdf["value"], strict=True)))
        return pd.DataFrame({"path": [pdf["event_type"].iloc[0]], "content": [buf.getvalue()]})

    # one archive per symbol and day, so that a file stays small however long the series is
    e = t.events.select("event_type", F.date_trunc("day", "ts").alias("day"), "value", (F.unix_timestamp("ts") * 1000).alias("ms"))
    files = e.groupBy("event_type", "day").applyInPandas(pack, "path string, content binary")
    return readers.funding(files).select(F.col("path").alias("symbol"), "ts", "interval_hours", "rate")


@query("S05_corpus_consolidation", f"WITH {v.HOURLY} SELECT symbol, ts, close * 2 AS close FROM hourly WHERE ts < TIMESTAMP '2024-02-01'")
def _(t):
    h = v.hourly(t)
    old = h.select("symbol", "ts", "close", F.concat("symbol", F.lit("-1h-2024-01.csv")).alias("path"))
    new = h.select("symbol", "ts", (F.col("close") * 2).alias("close"), F.concat("symbol", F.lit("-1h-2024-01.v2.csv")).alias("path"))
    late = h.select("symbol", "ts", (F.col("close") * 9).alias("close"), F.concat("symbol", F.lit("-1h-2024-02.csv")).alias("path"))
    return readers.consolidate(old.unionByName(new).unionByName(late), ["symbol", "ts"], "2024-01").select("symbol", "ts", "close")


@query("S06_failed_file_gate", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    d = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return readers.reject_when_bad(d, F.col("n") == 0)


@query("S07_feed_reader", "SELECT doc_id, left(sha1(concat_ws('|', source, 'http://n/' || doc_id, 'item ' || doc_id)), 16) AS id, source, 'item ' || doc_id AS title, TIMESTAMP '2024-03-05 10:00:00' AS published_at FROM documents")
def _(t):
    even = F.col("doc_id") % 2 == 0
    link, title = F.concat(F.lit("http://n/"), F.col("doc_id").cast("string")), F.concat(F.lit("item "), F.col("doc_id").cast("string"))
    now = F.lit("1999-01-01").cast("timestamp_ntz")
    x = F.to_xml(F.struct(title.alias("title"), link.alias("link"), F.lit("Tue, 5 Mar 2024 10:00:00 GMT").alias("pubDate")), {"rowTag": "item"})
    a = readers.rss(t.documents.where(even).withColumn("x", x), "x", F.col("source"), now, ["BTC"])
    j = F.to_json(F.struct(link.alias("url"), title.alias("title"), F.lit("2024-03-05T10:00:00Z").alias("published_at")))
    b = readers.json_feed(t.documents.where(~even).withColumn("x", j), "x", F.col("source"), now)
    return a.unionByName(b).select(F.regexp_extract("title", r"(\d+)", 1).cast("bigint").alias("doc_id"), "id", "source", "title", "published_at")


FAN = "SELECT doc_id AS id, source, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id * 43 % 43200) AS published_at FROM documents"


@query("S08_source_fan_in", f"SELECT id, source, published_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id) AS k FROM ({FAN}) WHERE source IN ('src1', 'src2', 'src5')) WHERE k <= 5")
def _(t):
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 43 % 43200) * 60).cast("timestamp_ntz")
    return readers.fan_in(t.documents.select(F.col("doc_id").alias("id"), "source", at.alias("published_at")), ["src1", "src2", "src5"], 5)


def news_batch(t, stamp):
    d = t.documents.select(rules.stable_id(F.col("source"), F.col("text")).alias("id"), "source", rules.squash(F.col("text")).alias("title"), F.lit(stamp).alias("version"))
    return text.scan_text(d, "title").drop("injection_score")


@query("S09_news_sink", "SELECT source, count(DISTINCT left(sha1(concat_ws('|', source, text)), 16)) AS stored FROM documents GROUP BY 1")
def _(t):
    path = fresh(t, "news")
    sinks.upsert(sinks.newest(news_batch(t, 1), ["id", "source"], "version"), path, ["id", "source"], "version", ["source"])
    sinks.upsert(sinks.newest(news_batch(t, 2), ["id", "source"], "version"), path, ["id", "source"], "version", ["source"])
    return t.spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("stored"))


@query("S10_fx_csv", f"SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN count(*) % 5 <> 0 THEN {rsql('avg(o_totalprice)', 3)} END AS value FROM orders GROUP BY 1")
def _(t):
    path = fresh(t, "fx")
    d = t.orders.groupBy("o_orderdate").agg(rnd(F.avg("o_totalprice"), 3).alias("x"), F.count(F.lit(1)).alias("n"))
    d.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("n") % 5 != 0, F.col("x").cast("string")).otherwise("n/a").alias("value")).write.option("header", "true").csv(path)
    return readers.series_csv(t.spark, path)


@query("S11_parquet_round_trip", f"WITH {v.HOURLY} SELECT {', '.join(COLS)} FROM hourly")
def _(t):
    path = fresh(t, "scan")
    hour_rows(t).write.parquet(path)
    return t.spark.read.parquet(path)


@query("S12_json_ledger_scan", f"WITH {v.HOURLY}, d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS decision_date, symbol, arg_max(close, ts) AS close FROM hourly GROUP BY 1, 2) SELECT decision_date, count(*) AS n, {rsql('sum(close)', 3)} AS total FROM d GROUP BY 1")
def _(t):
    path = fresh(t, "ledger")
    from tideline.operators import bars
    d = bars.last_close(v.hourly(t), "day").groupBy(F.col("ts").alias("decision_date")).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("prices"))
    d.select(F.lit("m").alias("model_id"), "decision_date", F.lit(True).alias("is_rebalance"), "prices").write.json(path)
    return readers.json_ledger(t.spark, path).select("decision_date", F.size("prices").cast("bigint").alias("n"), rnd(F.aggregate(F.map_values("prices"), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("S13_json_report", f"WITH {v.HOURLY} SELECT symbol, count(*) AS n, max(ts) AS last_ts FROM hourly GROUP BY 1")
def _(t):
    path = fresh(t, "report")
    v.hourly(t).groupBy("symbol").agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")).alias("coverage")).write.json(path)
    return t.spark.read.schema("symbol string, coverage struct<n: bigint, last_ts: timestamp_ntz>").json(path).select("symbol", "coverage.n", "coverage.last_ts")


def candle_batch(t, cond, scale, version):
    h = v.hourly(t).where(cond)
    return h.select("symbol", F.lit("1h").alias("timeframe"), "ts", *[(F.col(x) * scale).alias(x) for x in ("open", "high", "low", "close")], "volume", F.lit(version).cast("timestamp_ntz").alias("ingested_at")).withColumn("month", F.date_format("ts", "yyyy-MM"))


@query("S14_fixed_schema_table", f"WITH {v.HOURLY} SELECT symbol, count(*) AS n, 0::BIGINT AS n_before, {rsql('sum(volume)', 2)} AS volume FROM hourly GROUP BY 1")
def _(t):
    path = fresh(t, "tables")
    before = sinks.ensure_table(t.spark, path, schemas.CANDLES).count()
    sinks.append(candle_batch(t, F.lit(True), 1.0, "2024-01-01").drop("month"), path)
    kept = sinks.ensure_table(t.spark, path, schemas.CANDLES)  # a second time it is left as it is
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("volume"), 2).alias("volume")).withColumn("n_before", F.lit(before).cast("long"))


@query("S15_upsert_by_key", f"WITH {v.HOURLY} SELECT symbol, ts, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN close * 2 ELSE close END AS close FROM hourly")
def _(t):
    path, key = fresh(t, "up"), ["symbol", "timeframe", "ts"]
    mid = F.lit("2024-01-15").cast("timestamp_ntz")
    sinks.upsert(candle_batch(t, F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), 1.0, "2024-02-01"), path, key, "ingested_at", ["month"])
    sinks.upsert(candle_batch(t, F.col("ts") >= mid, 2.0, "2024-02-02"), path, key, "ingested_at", ["month"])
    return t.spark.read.parquet(path).select("symbol", "ts", "close")


@query("S16_replace_range", f"WITH {v.HOURLY} SELECT symbol, ts, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' THEN close * 3 ELSE close END AS close FROM hourly")
def _(t):
    path = fresh(t, "range")
    lo, hi = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")
    sinks.overwrite(candle_batch(t, F.lit(True), 1.0, "2024-02-01"), path, ["month"])
    sinks.replace_range(candle_batch(t, (F.col("ts") >= lo) & (F.col("ts") < hi), 3.0, "2024-02-02"), path, ["symbol"], "2024-01-10", "2024-01-12", ["month"])
    return t.spark.read.parquet(path).select("symbol", "ts", "close")


@query("S17_append_with_run_id", "SELECT run_id, event_type AS symbol, count(*) AS n FROM (SELECT unnest(['r1', 'r2']) AS run_id), events GROUP BY 1, 2")
def _(t):
    path = fresh(t, "log")
    d = t.events.select(F.col("event_type").alias("symbol"), "value")
    sinks.append(d, path, "r1")
    sinks.append(d, path, "r2")
    return t.spark.read.parquet(path).groupBy("run_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("S18_export_per_symbol", f"WITH {v.HOURLY} SELECT symbol, count(*) AS n, CAST(0 AS BIGINT) AS duplicates FROM hourly GROUP BY 1")
def _(t):
    path = fresh(t, "export")
    hour_rows(t).write.partitionBy("symbol").parquet(path)
    return quality.duplicates_and_gaps(t.spark.read.parquet(path)).select("symbol", "n", "duplicates")


@query("S19_archive_table", "SELECT 'archive' AS place, count(*) AS n FROM orders UNION ALL SELECT 'live', CAST(0 AS BIGINT)")
def _(t):
    live, old = fresh(t, "live"), fresh(t, "old")
    t.orders.write.parquet(live)
    sinks.archive(t.spark, live, old, t.orders.schema)
    count = lambda p, n: sinks.read_table(t.spark, p, t.orders.schema).agg(F.lit(n).alias("place"), F.count(F.lit(1)).alias("n"))
    return count(old, "archive").unionByName(count(live, "live"))


@query("S20_file_listing", "SELECT '2024-01' AS month, count(DISTINCT event_type) AS n FROM events")
def _(t):
    path = fresh(t, "files")
    t.events.select(F.concat("event_type", F.lit("-2024-01")).alias("name"), "value").write.partitionBy("name").csv(path)
    d = readers.listing(t.spark, path, "*.csv").select("month", F.regexp_extract("path", r"name=([^/]+)", 1).alias("name"))
    return d.groupBy("month").agg(F.count_distinct("name").alias("n"))


@query("S21_incremental_delta", f"WITH {v.HOURLY} SELECT symbol, ts FROM hourly WHERE ts >= TIMESTAMP '2024-01-20'")
def _(t):
    path = fresh(t, "delta")
    h = hour_rows(t)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    h.where(F.col("ts") < cut).write.parquet(path)
    return cut_lineage(sinks.delta(h, path)).select("symbol", "ts")


@query("S22_flag_by_prefix", "SELECT CAST(conv_id AS VARCHAR) AS run_id, max(turn) > 5 OR CAST(conv_id AS VARCHAR) LIKE '1%' AS logged FROM conversations GROUP BY 1, conv_id")
def _(t):
    d = t.conversations.groupBy(F.col("conv_id").cast("string").alias("run_id")).agg((F.max("turn") > 5).alias("logged"))
    return sinks.flag_by_prefix(sinks.flag_by_prefix(d, "run_id", "1", "logged"), "run_id", "1", "logged")


@query("S23_backfill", f"""WITH {v.HOURLY}, h AS (SELECT *, (dense_rank() OVER (ORDER BY symbol)) % 4 AS k FROM hourly WHERE ts < TIMESTAMP '2024-01-25')
SELECT symbol, count(*) AS n_candles, CASE WHEN k = 1 THEN 0 ELSE count(*) END AS n_features, CASE k WHEN 1 THEN 'candles' WHEN 2 THEN 'features' END AS failed FROM h GROUP BY symbol, k""")
def _(t):
    names = v.hourly(t).select("symbol").distinct()
    k = scan.number_rows(names.withColumn("_g", F.lit(0)), ["_g"], ["symbol"], "none").select("symbol", ((F.col("_pos") + 1) % 4).alias("k"))
    h = v.hourly(t).join(k, "symbol").withColumn("ingested_at", F.lit("2024-02-01").cast("timestamp_ntz"))
    turned = F.col("k") == 1  # every fourth symbol comes with high and low exchanged, the next with a volatility below 0
    h = h.withColumns({"high": F.when(turned, F.col("low") - 1).otherwise(F.col("high")), "low": F.when(turned, F.col("high")).otherwise(F.col("low"))})

    def silver(c):
        d = ts.returns(c, chunk="month").join(F.broadcast(k), "symbol")  # a row a symbol
        side = F.when(F.col("k") == 2, -1.0).otherwise(1.0)
        made = d.withColumns({"hurst": rules.range_ratio(F.col("close"), F.col("low"), F.col("high")), "vol": side * (1 + rules.range_ratio(F.col("high"), F.col("low"), F.col("close")))})
        return made.withColumns({"regime": rules.regime(F.col("hurst"))["label"], "computed_at": F.lit("2024-02-01").cast("timestamp_ntz")}).select("symbol", "ts", "ret_1", "hurst", "vol", "regime", "computed_at")

    return sinks.backfill(h.drop("k"), fresh(t, "backfill"), "2024-01-01", "2024-01-25", silver)


@query("S24_late_upsert", f"SELECT o_custkey AS symbol, o_orderdate AS ts, {rsql('arg_max(o_totalprice, o_orderkey)', 2)} AS rate FROM orders GROUP BY 1, 2")
def _(t):
    path = fresh(t, "funding")
    d = t.orders.select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("rate"), F.col("o_orderkey").alias("version"), F.date_format("o_orderdate", "yyyy").alias("year"))
    sinks.upsert(sinks.newest(d, ["symbol", "ts"], "version"), path, ["symbol", "ts"], "version", ["year"])
    return t.spark.read.parquet(path).select("symbol", "ts", rnd("rate", 2).alias("rate"))


@query("S25_run_status_log", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    path = fresh(t, "runs")
    for s in ("F", "O", "P"):
        sinks.append(t.orders.where(F.col("o_orderstatus") == s).select("o_orderkey", F.col("o_orderstatus").alias("status")), path)
    return t.spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
