"""Role tables (candles, panel, fills, news …) derived from the given tables, in Spark and as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import bars
from tideline.plans.registry import Tables


# ---- ticks and hourly candles: symbol = event type -------------------------------------------
def ticks(t: Tables, symbol: str = "event_type") -> DataFrame:
    return t.events.select(
        F.col(symbol).cast("string").alias("symbol"), "ts", "event_id", F.col("value").alias("price")
    )


def hourly(t: Tables) -> DataFrame:
    return bars.resample(ticks(t), "hour", tie=["event_id"])


def _bars_sql(unit: str, symbol: str = "event_type") -> str:
    return f"""SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts,
      arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume,
      sum(value) AS quote_volume, count(*) AS n
    FROM events GROUP BY 1, 2"""


HOURLY = f"hourly AS ({_bars_sql('hour')})"


def user_daily(t: Tables) -> DataFrame:
    """Wide universe: one daily candle per user."""
    return bars.resample(ticks(t, "user_id"), "day", tie=["event_id"])


USER_DAILY = f"user_daily AS ({_bars_sql('day', 'user_id')})"


# ---- long panel: brand x week ------------------------------------------------------------------
def panel(t: Tables) -> DataFrame:
    px = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        "l_orderkey",
        "l_linenumber",
    )
    return bars.resample(px, "week", tie=["l_orderkey", "l_linenumber", "price"], size="size")


PANEL = """panel AS (
    SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts,
      arg_min(px, row(l_shipdate, l_orderkey, l_linenumber, px)) AS open, max(px) AS high, min(px) AS low,
      arg_max(px, row(l_shipdate, l_orderkey, l_linenumber, px)) AS close, sum(l_quantity) AS volume,
      sum(px * l_quantity) AS quote_volume, count(*) AS n
    FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem JOIN part ON l_partkey = p_partkey)
    GROUP BY 1, 2)"""


# ---- market reference series with holes: mean order price per week ---------------------------
def fx_daily(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("fx"))


def fx(t: Tables) -> DataFrame:
    week = F.date_trunc("week", "o_orderdate").cast("timestamp_ntz")
    return t.orders.groupBy(week.alias("ts")).agg((F.avg("o_totalprice") / 1000).alias("fx"))


FX = """fx AS (SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts,
    avg(o_totalprice) / 1000 AS fx FROM orders GROUP BY 1)"""


# ---- fills -----------------------------------------------------------------------------------
def fills(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")
    )
    qty, cost = F.col("l_quantity"), F.col("l_extendedprice")
    return j.select(
        F.col("o_custkey").alias("account"),
        F.col("p_brand").alias("symbol"),
        F.when(F.col("l_linenumber") % 2 == 1, "BUY").otherwise("SELL").alias("action"),
        qty.alias("quantity"),
        (cost / qty).alias("price"),
        cost.alias("cost"),
        (cost * F.col("l_tax")).alias("fee"),
        F.when(F.col("l_returnflag") == "R", "REJECTED").otherwise("FILLED").alias("status"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax",
    )


FILL_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "quantity", "l_discount", "l_tax"]

FILLS = """fills AS (
    SELECT o_custkey AS account, p_brand AS symbol,
      CASE WHEN l_linenumber % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS action, l_quantity AS quantity,
      l_extendedprice / l_quantity AS price, l_extendedprice AS cost, l_extendedprice * l_tax AS fee,
      CASE WHEN l_returnflag = 'R' THEN 'REJECTED' ELSE 'FILLED' END AS status, l_shipdate AS ts,
      l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

FILL_SQL_ORDER = ", ".join(FILL_ORDER)
