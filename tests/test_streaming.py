"""Stateful streams over several micro-batches: late rows, restarts, timers."""
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.session import shared_dir
from tideline.streaming import jobs

START = pd.Timestamp("2024-01-01")


def feed(spark, path, rows, schema="symbol string, minutes long, event_id long, value double"):
    """One file, and so one micro-batch, of (symbol, minutes since START, event_id, value)."""
    d = spark.createDataFrame(rows, schema)
    ts = F.timestamp_seconds(F.lit(START.timestamp()) + F.col("minutes") * 60).cast("timestamp_ntz")
    d.withColumn("ts", ts).drop("minutes").coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # the source takes files by their time


def source(spark, path):
    d = spark.readStream.schema("symbol string, event_id long, value double, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/streams-{uuid.uuid4().hex}"


def minutes(ts):
    return int((pd.Timestamp(ts) - START).total_seconds() // 60)


def test_late_row_joins_two_sessions_across_a_restart(spark, folder):
    run = lambda: jobs.drain(jobs.sessions(source(spark, f"{folder}/in"), ["symbol"], F.when(F.col("symbol") == "a", "60 minutes").otherwise("10 minutes"), "5 hours"), base=folder)
    feed(spark, f"{folder}/in", [("a", 0, 1, 1.0), ("b", 0, 2, 1.0)])
    feed(spark, f"{folder}/in", [("a", 100, 3, 2.0), ("b", 15, 4, 2.0)])
    run()
    feed(spark, f"{folder}/in", [("a", 50, 5, 4.0)])  # late: 0 and 100 are one session now
    feed(spark, f"{folder}/in", [("z", 2000, 6, 0.0)])
    got = {(r["symbol"], r["n"], r["total"], minutes(r["first_ts"]), minutes(r["last_ts"])) for r in run().collect()}
    assert got == {("a", 3, 7.0, 0, 100), ("b", 1, 1.0, 0, 0), ("b", 1, 2.0, 15, 15)}


def test_outcomes_are_one_per_signal_with_late_prices_and_a_restart(spark, folder):
    run = lambda: jobs.drain(jobs.outcomes(source(spark, f"{folder}/in"), 1, "12 hours", tolerance_s=1800, bucket_s=7200), base=folder)
    feed(spark, f"{folder}/in", [("a", 0, 1, 10.0), ("a", 75, 2, 12.0), ("b", 58, 3, 5.0)])
    feed(spark, f"{folder}/in", [("a", 130, 4, 13.0), ("b", 121, 5, 6.0)])  # b's target 118 is in the bucket before its price
    run()
    feed(spark, f"{folder}/in", [("a", 65, 6, 11.0), ("a", 75, 7, 99.0)])  # a late and earlier price; a tie goes to the smaller id
    feed(spark, f"{folder}/in", [("z", 3000, 8, 0.0)])
    got = {(r["symbol"], r["event_id"]): r["out_id"] for r in run().collect()}
    assert got == {("a", 1): 6, ("a", 2): None, ("a", 6): 4, ("a", 7): None, ("a", 4): None, ("b", 3): 5, ("b", 5): None}


def test_rebalances_keep_drifted_holdings_over_batches_and_restarts(spark, folder):
    day = 1440

    def run():
        d = source(spark, f"{folder}/in").select(F.lit(7).cast("long").alias("book"), "ts", "event_id", F.col("symbol").alias("asset"), "value")
        return jobs.drain(jobs.rebalances(d, "2024-01-01", "2 days"), base=folder)

    feed(spark, f"{folder}/in", [("x", 0, 1, 10.0), ("y", 60, 2, 10.0)])
    feed(spark, f"{folder}/in", [("x", 8 * day, 4, 20.0)])
    run()
    feed(spark, f"{folder}/in", [("y", 7 * day, 3, 10.0), ("x", 9 * day, 5, 1.0)])  # late, and the true first row of its week
    feed(spark, f"{folder}/in", [("y", 15 * day, 6, 30.0), ("z", 40 * day, 9, 1.0)])
    got = {r["event_id"]: (r["period"], r["catch_up"], r["assets"], round(r["turnover"], 9)) for r in run().collect()}
    assert got == {1: (0, False, 1, 1.0), 3: (1, False, 2, 1.0), 6: (2, True, 2, round(2 * abs(0.5 - 0.1 / (0.1 + 3.0)), 9))}


def test_staleness_by_event_time(spark, folder):
    run = lambda: jobs.drain(jobs.holds(source(spark, f"{folder}/in").select("symbol", "ts"), 3600, "3 hours"), base=folder)
    feed(spark, f"{folder}/in", [("a", 0, 1, 0.0), ("a", 100, 2, 0.0), ("b", 0, 3, 0.0)])
    run()
    feed(spark, f"{folder}/in", [("a", 50, 4, 0.0)])  # late: fills a's gap
    feed(spark, f"{folder}/in", [("z", 1000, 5, 0.0)])
    assert {(r["symbol"], minutes(r["newest"]), minutes(r["hold_from"])) for r in run().collect()} == {("a", 100, 160), ("b", 0, 60)}


def test_staleness_by_the_clock_needs_no_new_input(spark, folder):
    feed(spark, f"{folder}/in", [("a", 0, 1, 0.0), ("b", 5, 2, 0.0)])
    name = f"holds_{uuid.uuid4().hex}"
    q = jobs.holds(source(spark, f"{folder}/in").select("symbol", "ts"), 4, "1 hour", by_clock=True).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table(name).count() < 2:
            time.sleep(0.5)
        assert {r["symbol"] for r in spark.table(name).collect()} == {"a", "b"}
    finally:
        q.stop()


class _State:
    """A state variable in memory."""

    def __init__(self):
        self.rows, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.rows is not None

    def get(self):
        self.calls += 1
        return self.rows

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    update = put

    def appendList(self, rows):
        self.put((self.rows or []) + list(rows))

    def clear(self):
        self.put(None)


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, *schema):
        return self.states.setdefault(name, _State())

    getValueState = getMapState = getListState

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 10**12


def test_a_key_needs_one_timer_for_many_entries():
    handle = _Handle()
    p = jobs.Staleness(60, False)
    p.init(handle)
    list(p.handleInputRows(("a",), iter([pd.DataFrame({"at": [100_000_000 * k for k in range(1000)]})]), handle))
    assert handle.timers == [60_000]
    out = pd.concat(list(p.handleExpiredTimer(("a",), handle, None)))
    assert len(out) == 1000 and handle.timers == [60_000] and handle.states["entries"].calls < 8


def test_ordered_rows_need_one_timer_for_many_hours():
    handle = _Handle()
    p = jobs.GridRebalance("1970-01-01")
    p.init(handle)
    rows = pd.DataFrame({"at": [3_600_000_000 * k for k in range(400)], "event_id": range(400), "asset": "x", "value": 1.0})
    list(p.handleInputRows((1,), iter([rows]), handle))
    assert handle.timers == [3_600_000] and handle.states["waiting"].calls < 4


def test_many_books_share_the_calls_of_one_key():
    handle = _Handle()
    p = jobs.GridRebalance("1970-01-01")
    p.init(handle)
    day = 86_400_000_000
    for asset, at in (("x", 0), ("y", 8 * day)):
        rows = pd.DataFrame({"book": range(500), "at": at, "event_id": range(500), "asset": asset, "value": 1.0})
        list(p.handleInputRows((3,), iter([rows[:200], rows[200:]]), handle))
    out = pd.concat(list(p.handleExpiredTimer((3,), handle, None)))
    assert len(out) == 1000 and set(zip(out["period"], out["assets"])) == {(0, 1), (1, 2)} and out.groupby("book").size().eq(2).all()
    assert handle.timers == [3_600_000, 8 * 86_400_000 + 3_600_000] and sum(s.calls for s in handle.states.values()) < 10


def test_keyed_results_leave_in_parts():
    handle, n = _Handle(), 20_000
    p = jobs.RunningSpend()
    p.init(handle)
    rows = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="s")[::-1], "event_id": range(n), "value": 1.0})
    out = list(p.handleInputRows(("a",), iter([rows[:7000], rows[7000:]]), handle))
    assert len(out) == 3 and pd.concat(out)["spent"].tolist() == [float(k + 1) for k in range(n)] and pd.concat(out)["event_id"].iloc[0] == n - 1


def test_totals_sort_nothing(spark):
    d = spark.createDataFrame([("a", START.to_pydatetime(), 1.0), ("a", (START + pd.Timedelta("30min")).to_pydatetime(), 2.0)], "event_type string, ts timestamp, value double")
    t = jobs.totals(d, "2 hours", "1 hour", "1 hour")
    assert "SortAggregate" not in t._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["n"], r["total"]) for r in t.collect()) == [(2, 3.0), (2, 3.0)]
