"""Pieces, halos and carries must equal the plain window, also for a symbol with most of the rows."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import joins, scan


@pytest.fixture(scope="module")
def series(spark):
    n = spark.range(400).select(F.col("id"), F.when(F.col("id") % 10 < 7, "HOT").otherwise(F.concat(F.lit("S"), (F.col("id") % 3).cast("string"))).alias("symbol"))
    return n.select("symbol", F.timestamp_seconds(1704067200 + F.col("id") * 7211).cast("timestamp_ntz").alias("ts"),
                    F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101).cast("double")).alias("x"))


def rows_any(df):
    return [tuple(r) for r in df.collect()]


def by_symbol():
    return Window.partitionBy("symbol").orderBy("ts")


@pytest.mark.parametrize("size", [5, 7, 64, 10_000])
def test_over_series_equals_plain_window(series, size):
    build = lambda d, w: d.withColumns({"a": F.lag("x", 3).over(w), "b": F.count("x").over(w.rowsBetween(-4, 0)), "c": F.lead("x", 2).over(w)})
    got = rows_any(scan.over_series(series, build, back=5, ahead=2, rows=size).select("symbol", "ts", "a", "b", "c"))
    want = rows_any(series.select("symbol", "ts", F.lag("x", 3).over(by_symbol()), F.count("x").over(by_symbol().rowsBetween(-4, 0)), F.lead("x", 2).over(by_symbol())))
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("chunk", ["day", "month", "year"])
def test_running_equals_plain_window(series, chunk):
    g = scan.running(series, [("sum", F.col("x"), "s"), ("max", F.col("x"), "m"), ("last", F.col("x"), "l")], chunk=chunk)
    u = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    p = series.select("symbol", "ts", F.sum("x").over(u), F.max("x").over(u), F.last("x", True).over(u))
    assert sorted(map(str, rows_any(g.select("symbol", "ts", "s", "m", "l")))) == sorted(map(str, rows_any(p)))


def test_ranks_with_a_value_held_by_most_rows(spark):
    d = spark.range(1000).select(F.lit("k").alias("k"), F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") % 17 * 1.0).alias("v"), F.format_string("%05d", F.col("id")).alias("t"))
    got = scan.number_by_value(d, ["k"], "v", "t").select("t", "_pos")
    want = d.select("t", (F.row_number().over(Window.partitionBy("k").orderBy("v", "t")) - 1).alias("p"))
    assert rows_any(got.orderBy("t")) == rows_any(want.orderBy("t"))
    q = scan.quantiles(d, ["k"], "v", [0.25, 0.5, 0.9], ["a", "b", "c"]).first()
    import numpy as np

    v = [r.v for r in d.collect()]
    assert np.allclose([q.a, q.b, q.c], np.quantile(v, [0.25, 0.5, 0.9]))


@pytest.mark.parametrize("size", [3, 50, 9999])
def test_affine_scan(series, size):
    d = series.where("x IS NOT NULL")
    got = {(r.symbol, r.ts): (r.v, r.p) for r in scan.affine_scan(d, F.lit(0.9), F.col("x"), "v", init=1.0, prev="p", rows=size).collect()}
    state = {}
    for r in d.orderBy("symbol", "ts").collect():
        before = state.get(r.symbol, 1.0)
        v = 0.9 * before + r.x
        state[r.symbol] = v
        assert got[(r.symbol, r.ts)] == pytest.approx((v, before))


def test_as_of_join_with_gaps(spark):
    b = spark.sql("SELECT 'a' AS symbol, timestamp_ntz'2024-01-01' AS ts, 1.0D AS v UNION ALL SELECT 'a', timestamp_ntz'2024-03-01', 2.0D")
    p = spark.sql("SELECT 'a' AS symbol, ts FROM VALUES (timestamp_ntz'2023-12-31'), (timestamp_ntz'2024-01-01'), (timestamp_ntz'2024-02-28'), (timestamp_ntz'2024-06-01') AS t(ts)")
    assert [r.v for r in joins.as_of(p, b, ["symbol"], ["v"]).orderBy("ts").collect()] == [None, 1.0, 1.0, 2.0]
