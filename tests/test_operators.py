"""Hand-computed cases, invariants and theory for the operators SQL cannot state."""
import io
import math
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import normal
from tideline.operators import aggregates, cross, custom, hurst, labels, ledger, models, pairs, portfolio, sampling, scan, shapes, signals, stats, text
from tideline.operators import timeseries as ts
from tideline.sources import readers, sinks


def hourly(spark, n=700, symbols=("A", "B")):
    rng = np.random.default_rng(1)
    out = []
    for s in symbols:
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        ts = pd.date_range("2024-01-01", periods=n, freq="h")
        out.append(pd.DataFrame({"symbol": s, "ts": ts, "open": c, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": 10.0}))
    return spark.createDataFrame(pd.concat(out), "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_hurst_does_not_depend_on_the_pieces(spark):
    h = hourly(spark, 300)
    a = hurst.rolling_hurst(h, 100, rows=100).orderBy("symbol", "ts").toPandas()["hurst"]
    b = hurst.rolling_hurst(h, 100, rows=10_000).orderBy("symbol", "ts").toPandas()["hurst"]
    assert a.isna().sum() == 2 * 99
    assert np.allclose(a.astype(float), b.astype(float), equal_nan=True)


def test_silver_tail_equals_full(spark):
    h = hourly(spark, 700)
    kw = dict(hurst_window=100, garch_window=200)
    full = signals.silver(h, **kw).select("symbol", "ts", "ret", "hurst")
    tail = signals.silver_tail(h, 48, 550, **kw).select("symbol", "ts", F.col("ret").alias("r2"), F.col("hurst").alias("h2"))
    j = full.join(tail, ["symbol", "ts"])
    assert j.count() == 96
    assert j.where("abs(ret - r2) > 1e-12 OR abs(hurst - h2) > 1e-9").count() == 0


def test_variance_ratio_of_ar1(spark):
    rng, rho, n = np.random.default_rng(3), 0.3, 6000
    e = rng.normal(0, 0.03, n)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = rho * x[i - 1] + e[i]
    d = spark.createDataFrame(pd.DataFrame({"symbol": "A", "t": range(n), "x": x}))
    r = stats.variance_ratio(d, ["symbol"], ["t"], "x", 5, chunk=1000).first()
    assert r.vr == pytest.approx(1 + 2 * sum((1 - k / 5) * rho**k for k in range(1, 5)), abs=0.08)
    assert r.z > 3
    short = stats.variance_ratio(d.where("t < 50"), ["symbol"], ["t"], "x", 5, chunk=1000).first()
    assert short.vr is None


def test_resampling_is_independent_of_partitioning(spark):
    d = spark.createDataFrame(pd.DataFrame({"symbol": "A", "t": range(300), "x": np.sin(np.arange(300) * 1.7) / 50}))
    a = stats.wild_bootstrap(d, ["symbol"], ["t"], "x", 2, 10, chunk=100).first()
    b = stats.wild_bootstrap(d.repartition(7), ["symbol"], ["t"], "x", 2, 10, chunk=100).first()
    assert a.p_value == b.p_value and 0 < a.p_value <= 1


def brute_pivots(c, tol):
    out, hi, lo, way = [], 0, 0, 0
    for j in range(1, len(c)):
        if way == 0:
            hi, lo = (j if c[j] > c[hi] else hi), (j if c[j] < c[lo] else lo)
        elif way > 0 and c[j] > c[hi]:
            hi = j
        elif way < 0 and c[j] < c[lo]:
            lo = j
        if way <= 0 and j != lo and c[j] >= c[lo] * (1 + tol):
            out.append((lo, -1, j))
            way, hi = 1, j
        elif way >= 0 and j != hi and c[j] <= c[hi] * (1 - tol):
            out.append((hi, 1, j))
            way, lo = -1, j
    return out


def test_pivots_match_and_never_look_ahead(spark):
    h = hourly(spark, 400, ("A",))
    c = [r.close for r in h.orderBy("ts").collect()]
    key = lambda d: [(r.pos, r.kind, r.confirm_pos) for r in d.orderBy("confirm_pos").collect()]
    full = key(shapes.pivots(h, (0.05,)))
    assert full == brute_pivots(c, 0.05) and len(full) > 2
    cut = key(shapes.pivots(h.where("ts < timestamp_ntz'2024-01-11'"), (0.05,)))
    assert cut == [p for p in full if p[2] < 240]
    m = shapes.mountains(h, shapes.pivots(h, (0.05,))).collect()
    assert all(len(r["shape"]) == 24 and min(r["shape"]) == 0 and max(r["shape"]) == pytest.approx(1) for r in m)


def test_pivots_do_not_depend_on_the_pieces(spark):
    rng = np.random.default_rng(3)
    walk = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.03, 600))), 1)  # ties among the prices
    paths = {"W": walk, "D": np.linspace(900, 100, 150), "U": np.linspace(100, 900, 150), "F": np.full(40, 7.0), "O": np.array([5.0])}
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=i), float(x)) for k, c in paths.items() for i, x in enumerate(c)]
    h = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").repartition(5)
    want = sorted((k, tol, *p) for k, c in paths.items() for tol in (0.05, 0.2) for p in brute_pivots(c, tol))
    assert len(want) > 30
    for size in (7, 64, 8192):
        got = shapes.pivots(h, (0.05, 0.2), rows=size).collect()
        assert sorted((r.symbol, r.tol, r.pos, r.kind, r.confirm_pos) for r in got) == want
        assert all(r.close == paths[r.symbol][r.pos] and r.ts == rows[0][1] + timedelta(hours=r.pos) for r in got)
    assert shapes.pivots(h.limit(0)).count() == 0


def slow_pair_book(d, z_in, z_out, hl_min, hl_max):
    """Rows held, by following one trade after the other."""
    out, k = [], 0
    d = d.reset_index(drop=True)
    while k < len(d):
        r = d.loc[k]
        k += 1
        if not (r.df_stat < pairs.CRITICAL_5 and hl_min <= r.half_life <= hl_max and abs(r.z) > z_in):
            continue
        start, side = k - 1, -1 if r.z > 0 else 1
        out.append((r.ts, side))
        while k < len(d):
            now, k = d.loc[k], k + 1
            if np.isnan(now.z):
                continue
            if abs(now.z) < z_out or k - 1 - start > 2 * r.half_life:
                break
            out.append((now.ts, side))
    return out


def test_pair_positions_do_not_depend_on_the_pieces(spark):
    rng, frames = np.random.default_rng(5), []
    for a, n in (("A", 500), ("B", 90), ("C", 1)):
        z = rng.normal(0, 2.2, n)
        z[rng.random(n) < 0.05] = np.nan
        frames.append(pd.DataFrame({"a": a, "b": "Z", "ts": pd.date_range("2024-01-01", periods=n, freq="D"), "z": z, "half_life": rng.uniform(0.5, 12, n), "df_stat": rng.uniform(-6, -2, n)}))
    d = pd.concat(frames, ignore_index=True)
    want = sorted((a, ts, side) for a, g in d.groupby("a") for ts, side in slow_pair_book(g, 2.0, 0.5, 1, 10))
    s = spark.createDataFrame(d).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "z": F.when(~F.isnan("z"), F.col("z"))})
    assert len(want) > 100
    for size in (5, 8192):
        got = pairs.spread_positions(s.repartition(4), hl_min=1, hl_max=10, rows=size).collect()
        assert sorted((r.a, pd.Timestamp(r.ts), r.direction) for r in got) == want
    assert pairs.spread_positions(s.limit(0)).count() == 0


def test_normal_cdf_column(spark):
    z = [-40.0, -8.0, -3.0, -0.5, -1e-9, 0.0, 1e-9, 0.7, 2.0, 6.0, 8.0, 40.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal.cdf("z").alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=1e-13) for r in got)
    none = spark.createDataFrame([(None,), (float("nan"),)], "z double").select(normal.cdf("z").alias("p")).collect()
    assert [r.p for r in none] == [None, None]


def test_slice_phases(spark):
    d = [("a", datetime(2024, 1, 1) + timedelta(days=i), r, 0.01) for i, r in enumerate([0.05, -0.01, 0.02, 0.03])] + [("b", datetime(2024, 1, 1), 1.0, 0.0)]
    got = portfolio.slice_long(spark.createDataFrame(d, "k string, ts timestamp_ntz, net double, bench double"), ["k"], min_obs=4, cost=0.004).collect()
    assert [r.k for r in got] == ["a"] and got[0].n == 4
    excess = [0.044, -0.02, 0.01, 0.02]  # the benchmark pays its entry in the first period
    assert got[0].excess == pytest.approx(sum(excess) / 4) and got[0].drop_best == pytest.approx(0.01 / 3) and got[0].profit_factor == pytest.approx(10.0)


def test_table_is_ensured_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.ensure_table(spark, path, "a long, b string").columns == ["a", "b"]
    sinks.append(spark.range(3).selectExpr("id AS a", "'x' AS b"), path)
    assert sinks.ensure_table(spark, path, "a long, b string").count() == 3


def fills(spark, rows):
    d = pd.DataFrame(rows, columns=["action", "quantity", "price"])
    d["ts"] = pd.date_range("2023-12-30", periods=len(d), freq="D")
    d = d.assign(account=1, symbol="X", status="FILLED", fee=0.0, cost=d.quantity * d.price)
    return spark.createDataFrame(d, "action string, quantity double, price double, ts timestamp_ntz, account long, symbol string, status string, fee double, cost double")


def test_cost_basis_clamps_sells(spark):
    r = ledger.cost_summary(fills(spark, [("BUY", 1.0, 100.0), ("BUY", 1.0, 200.0), ("SELL", 1.0, 180.0), ("SELL", 5.0, 100.0), ("BUY", 2.0, 50.0)]), rows=2).first()
    assert r.realised == pytest.approx(30 - 50) and r.quantity == 2 and r.avg_cost == pytest.approx(50)


def test_netting_flips_to_short_and_back(spark):
    f = fills(spark, [("BUY", 2.0, 100.0), ("SELL", 5.0, 110.0), ("SELL", 1.0, 90.0), ("BUY", 1.0, 80.0)])
    r = ledger.open_positions(ledger.net_positions(f, rows=2), ["ts"]).first()
    assert (r.action, r.quantity) == ("SELL", 3.0)
    assert r.entry_price == pytest.approx((3 * 110 + 90) / 4) and r.realised == pytest.approx(20 + (105 - 80))


def test_short_series_take_one_exchange_and_equal_the_pieces(spark):
    rng = np.random.default_rng(5)
    n = 300
    d = pd.DataFrame({"action": rng.choice(["BUY", "SELL"], n), "quantity": rng.integers(1, 9, n).astype(float), "price": rng.uniform(10, 20, n).round(2), "account": rng.integers(0, 6, n), "symbol": rng.choice(["X", "Y"], n)})
    d["ts"] = pd.date_range("2023-12-01", periods=n, freq="6h")
    d = d.assign(status="FILLED", fee=0.5, cost=d.quantity * d.price)
    f = spark.createDataFrame(d, "action string, quantity double, price double, account long, symbol string, ts timestamp_ntz, status string, fee double, cost double")
    for name, of in (("cost", ledger.cost_summary), ("net", ledger.positions)):
        folded, cut, both = (of(f, rows=rows) for rows in (1000, 3, 25))  # 25: some series in one piece, some in two
        keys = ["account", "symbol"]
        want = folded.toPandas().sort_values(keys, ignore_index=True)
        for other in (cut, both):
            pd.testing.assert_frame_equal(want, other.select(*folded.columns).toPandas().sort_values(keys, ignore_index=True))
        assert folded._jdf.queryExecution().sparkPlan().toString().count("Exchange") + folded._jdf.queryExecution().optimizedPlan().toString().count("Repartition") <= 2, name
    rows = ledger.net_positions(f).groupBy("account", "symbol").agg(F.sum("realised").alias("r")).join(ledger.positions(f), ["account", "symbol"])
    assert rows.where("abs(r - realised) > 1e-9").isEmpty()


def test_roll_forward_matches_hand_computation(spark):
    rows = [("p", "2024-01-01", "A", "BUY", 0.5, 0.1, 0.10, 1.0), ("p", "2024-01-02", "A", "BUY", 0.5, 0.1, -0.05, 1.0), ("p", "2024-01-03", "A", "HOLD", 0.0, 0.1, 0.0, 1.0)]
    d = spark.createDataFrame(pd.DataFrame(rows, columns="portfolio ts symbol direction confidence vol ret mult".split()).assign(ts=lambda x: pd.to_datetime(x.ts)))
    got = portfolio.roll_forward(d.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 0.01).orderBy("ts").collect()
    e1 = 1 - 0.01 + 0.10
    assert got[0].equity == pytest.approx(e1)
    assert got[1].traded == 0  # drift of the book stays inside the band
    assert got[2].traded == pytest.approx(1.10 * 0.95, abs=1e-3)


def test_similarity_counts_copies_and_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    v[20:40] = v[0]
    v[41] = v[40] + 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")
    f = np.array([[np.float32(x) for x in r] for r in v], dtype=np.float64)
    want = ((f @ f.T) >= 0.85).sum(1) - 1
    got = {r.id: r.neighbours for r in text.similar(d, "id", "v", 0.85, pivots=4, block=7, counts=True).collect()}
    assert [got[i] for i in range(60)] == want.tolist()
    c = {r.id: r.cluster_id for r in text.dbscan(d, "id", "v", 0.85, 3).collect()}
    assert len({c[i] for i in [0, *range(20, 40)]}) == 1 and c[0] >= 0


def test_logistic_is_the_c_form_optimum(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    d = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    m = models.fit_logistic(d, ["a", "b"], c=0.5, balanced=False)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, b = np.zeros(2), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        X = np.c_[z, np.ones(300)]
        g = X.T @ (p - y) + np.r_[w / 0.5, 0]
        h = X.T @ (X * (p * (1 - p))[:, None]) + np.diag([2, 2, 0.0])
        s = np.linalg.solve(h, g)
        w, b = w - s[:2], b - s[2]
    assert np.allclose(np.array(m.stages[2].coefficients), w, atol=1e-5)
    art = models.freeze(m, ["a", "b"])
    p1 = [r.p for r in models.score(m, d).select("p").collect()]
    p2 = [r.p for r in models.score_frozen(d, art).select("p").collect()]
    assert np.allclose(p1, p2)
    with pytest.raises(ValueError):
        models.score_frozen(d, {**art, "intercept": 9.0})


def test_labels_on_one_day(spark):
    d = spark.createDataFrame([(f"S{i:02d}", i / 100) for i in range(11)], "symbol string, fwd_ret double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    y = {r.symbol: r.y for r in labels.extremes(d, 5).collect()}
    assert sum(v == 1 for v in y.values()) == 5 and y["S05"] is None and y["S00"] == 0
    r = {x.symbol: x.y for x in labels.relative(d).collect()}
    assert sum(r.values()) == 5
    assert all(x.y is None for x in labels.relative(d.limit(4)).collect())


def test_archives_in_milli_and_microseconds(spark):
    def pack(lines):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("a.csv", "\n".join(lines))
        return buf.getvalue()

    row = "29000,29500,28900,29400,12,0,100,5000,0,0,0"
    head = ",".join(readers.KLINE_COLUMNS)
    d = spark.createDataFrame([("ms", pack([f"1609459200000,{row}"])), ("us", pack([head, f"1609459200000000,{row}"]))], "path string, content binary")
    got = readers.klines(d).collect()
    assert len(got) == 2 and {(str(r.ts), r.close, r.n_trades) for r in got} == {("2021-01-01 00:00:00", 29400.0, 5000)}


def test_gate_rejects_a_bad_load(spark):
    with pytest.raises(ValueError):
        readers.reject_when_bad(spark.range(50).toDF("n"), F.col("n") == 0)


def test_upsert_is_idempotent(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, p string, version int")
    for _ in range(2):
        sinks.upsert(d, str(tmp_path / "t"), ["k"], "version", ["p"])
    sinks.upsert(d.where("k = 1").withColumn("version", F.lit(2)), str(tmp_path / "t"), ["k"], "version", ["p"])
    assert sorted((r.k, r.version) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 2), (2, 1)]


def test_html_text(spark):
    rows = spark.createDataFrame([("<p>Fish &amp; <b>chips</b></p>\n x " + "y" * 9000,), (None,)], "h string")
    assert [r["t"] for r in text.clean(rows, "h", "t").collect()] == ["Fish & chips x " + "y" * 9000, ""]
    assert [r["t"] for r in text.clean(rows, "h", "t", 6).collect()] == ["Fish &", ""]


def test_pair_statistics_against_regression(spark):
    rng = np.random.default_rng(11)
    b = np.cumsum(rng.normal(0, 0.02, 140))
    a = 0.7 * b + rng.normal(0, 0.01, 140)
    d = spark.createDataFrame(pd.DataFrame({"a": "x", "b": "y", "ts": pd.date_range("2024-01-01", periods=140), "value_a": a, "value_b": b}),
                              "a string, b string, ts timestamp_ntz, value_a double, value_b double")
    last = pairs.spread_statistics(d, 90).orderBy(F.desc("ts")).first()
    ya, yb = a[-91:], b[-91:]
    beta = np.polyfit(yb, ya, 1)[0]
    res = ya - beta * yb
    assert last.beta == pytest.approx(beta)
    assert last.z == pytest.approx((res[-1] - res[:-1].mean()) / res[:-1].std())
    assert last.half_life == pytest.approx(np.log(2) / -np.polyfit(res[:-1], np.diff(res), 1)[0])


def test_number_rows_survives_one_partition(spark):
    d = spark.range(100).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("ts"))
    assert [r._pos for r in scan.number_rows(d.coalesce(1)).orderBy("ts").collect()] == list(range(100))


def test_ewma_std_of_all_rows(spark):
    x = [None if i % 7 == 3 else math.sin(i) * (1e6 if i == 2 else 1) for i in range(900)]
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1) + timedelta(hours=i), v) for i, v in enumerate(x)], "symbol string, ts timestamp_ntz, x double")
    got = [r["e"] for r in ts.ewma_std_series(rows, "x", 0.06, "e", rows=100).orderBy("ts").collect()]
    for i in (5, 30, 450, 899):
        w = [(0.94 ** (i - j), v) for j, v in enumerate(x[:i + 1]) if v is not None]
        if len(w) < 10:
            assert got[i] is None
            continue
        s0, s1, s2, q0 = (sum(f(a, v) for a, v in w) for f in (lambda a, v: a, lambda a, v: a * v, lambda a, v: a * v * v, lambda a, v: a * a))
        assert got[i] == pytest.approx(math.sqrt(max(0, (s2 / s0 - (s1 / s0) ** 2) * s0 * s0 / (s0 * s0 - q0))), rel=1e-6)


def test_ewma_variance_starts_with_the_last_seed_row(spark):
    r = [0.01 * ((i * 37) % 11 - 5) for i in range(60)]
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1) + timedelta(hours=i), v) for i, v in enumerate(r)], "symbol string, ts timestamp_ntz, ret double")
    got = [x["ewma_var"] for x in ts.ewma_variance(rows, "ret", rows=16).orderBy("ts").collect()]
    mean = sum(r[:20]) / 20
    v = sum((x - mean) ** 2 for x in r[:20]) / 20
    for i in range(60):
        if i < 19:
            assert got[i] is None
        else:
            v = 0.94 * v + 0.06 * r[i] ** 2
            assert got[i] == pytest.approx(v)


def test_calendar_moments_hold_dense_frames(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1) + timedelta(minutes=i), float(i)) for i in range(3000)], "symbol string, ts timestamp_ntz, x double")
    last = ts.calendar_moments(rows, "x", [1, 24]).orderBy(F.desc("ts")).first()
    assert (last["n_1h"], last["n_24h"], last["mean_1h"]) == (61, 1441, 2969.0)


def test_window_starts_reach_the_target(spark):
    days = [(datetime(2021, 1, 1) + timedelta(days=i),) for i in range(1642)]
    dates = spark.createDataFrame(days, "ts timestamp_ntz")
    for seed in (42, 1):
        got = sorted(r["ts"] for r in sampling.window_starts(dates, 28, 40, seed).collect())
        assert len(got) == 40 and all((b - a).days >= 28 for a, b in zip(got, got[1:]))
    sparse = dates.where("day(ts) in (1, 15, 16)")
    got = sorted(r["ts"] for r in sampling.window_starts(sparse, 28, 10**6, 5).collect())
    assert len(got) >= 50 and all((b - a).days >= 28 for a, b in zip(got, got[1:]))


def test_ranks_keep_rows_without_a_value(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("b", None, 1), ("c", 0.5, 1), ("d", None, 2)], "symbol string, x double, ts int")
    got = {r["symbol"]: (r["rank_asc"], r["rank_desc"], r["n_group"]) for r in cross.ranks(rows, ["ts"], "x").collect()}
    assert got == {"a": (2, 1, 2), "b": (None, None, 2), "c": (1, 2, 2), "d": (None, None, 0)}


def test_hot_value_is_cut_behind_its_ties_common_beginning(spark):
    rows = spark.range(5000).select(F.lit(1).alias("g"), F.lit(2.0).alias("x"), F.concat(F.lit("Brand#"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("tie"))
    assert scan._value_chunks(rows, ["g"], "x", "tie").select("_vb", "_vt").distinct().count() >= 40
    assert [r["k"] for r in scan.number_by_value(rows, ["g"], "x", "tie", "k").orderBy("tie").collect()] == list(range(5000))


def test_tail_equals_full_pass(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 900)))
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 5) + timedelta(hours=i), float(c), float(c) * 1.01, float(c) * 0.99, float(c), 1.0) for i, c in enumerate(close)],
                                 "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    full = {r["ts"]: r for r in signals.silver(rows, 100, 300).collect()}
    tail = signals.silver_tail(rows, 48, 550, hurst_window=100, garch_window=300).collect()
    assert len(tail) == 48
    for r in tail:
        assert r["garch_vol"] == pytest.approx(full[r["ts"]]["garch_vol"], rel=1e-12) and r["hurst"] == pytest.approx(full[r["ts"]]["hurst"])


def test_similarity_multiplies_few_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(100, 32))
    x = centres[rng.integers(0, 100, 20_000)] + 0.18 * rng.normal(size=(20_000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    work = spark.sparkContext.accumulator(0)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(8)
    got = {r.id: r.neighbours for r in text.similar(d, "id", "v", 0.85, counts=True, work=work).collect()}
    y = x.astype(np.float64)
    want = np.concatenate([((y[a:a + 2000] @ y.T) >= 0.85).sum(1) - 1 for a in range(0, 20_000, 2000)])
    assert [got[i] for i in range(20_000)] == want.tolist()
    assert 0 < work.value < 0.05 * 20_000 ** 2 / 2


def test_similarity_of_one_full_cell_is_cut_into_rings(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    y = x.astype(np.float64)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(y @ y.T >= 0.9, 1)))}
    work = spark.sparkContext.accumulator(0)
    for pivots in (1, 3):
        assert {(r.a, r.b) for r in text.similar(d, "id", "v", 0.9, pivots=pivots, block=20, work=work).collect()} == want
    assert work.value < 2 * 600 * 600


def test_custom_aggregate_merges_states_of_a_hot_key(spark):
    class Range(custom.Aggregate):
        inputs = ("v", "w")

        def start(self):
            return np.array([-np.inf, 0.0])

        def fold(self, state, v, w):
            return self.merge(state, np.array([v.max(), w.sum()])) if len(v) else state

        def merge(self, a, b):
            return np.array([max(a[0], b[0]), a[1] + b[1]])

        def finish(self, state):
            return None if np.isinf(state[0]) else float(state[0] + state[1])

    rng = np.random.default_rng(3)
    rows = [("hot" if i % 10 else None if i % 20 else f"k{i % 70}", float(v), float(i % 3) if i % 7 else None) for i, v in enumerate(rng.normal(size=6000))]
    d = spark.createDataFrame(rows, "k string, v double, w double").repartition(24)
    out = custom.aggregate(d, ["k"], {"r": Range(), "t": custom.TailMean("v", 5), "l": custom.LogVariance("v")}, fan_in=4)
    got = {r.k: r for r in out.collect()}
    groups = {}
    for k, v, w in rows:
        groups.setdefault(k, []).append((v, w))
    assert set(got) == set(groups) and None in got
    for k, vs in groups.items():
        used = [(v, w) for v, w in vs if w is not None]
        logs = np.log([v for v, _ in vs if v > 0])
        assert got[k].r == (pytest.approx(max(v for v, _ in used) + sum(w for _, w in used)) if used else None)
        assert got[k].t == pytest.approx(np.mean(sorted(v for v, _ in vs)[-5:]))
        assert got[k].l == (pytest.approx(logs.var(ddof=1)) if len(logs) > 1 else None)
    assert custom.aggregate(d.limit(0), ["k"], {"r": Range()}).count() == 0


def test_many_logistic_fits_equal_single_ones(spark):
    rng = np.random.default_rng(8)
    days = pd.date_range("2024-01-01", periods=60, freq="D")
    x = rng.normal(size=(3000, 3)) * [1.0, 5.0, 0.1] + [0.0, 3.0, -1.0]
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 0.2 * x[:, 1] + 4 * x[:, 2])))).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, ts=days[np.arange(3000) % 60])
    d = spark.createDataFrame(pdf, "a double, b double, c double, y int, ts timestamp_ntz").repartition(6)
    calendar = days.to_numpy().astype("datetime64[us]")
    dates = {k: calendar[(calendar < calendar[k]) | (calendar > calendar[k + 10])] for k in range(0, 50, 5)}
    dates["none"] = calendar[:0]
    fits = models.fit_logistic_many(d, ["a", "b", "c"], dates, c=dict.fromkeys(dates, 0.5))
    assert set(fits) == set(dates) - {"none"}
    for k in (0, 25):
        one = models.freeze(models.fit_logistic(d.where(F.col("ts").isin([t.item() for t in dates[k]])), ["a", "b", "c"], c=0.5), ["a", "b", "c"])
        for name in ("mean", "scale", "coef"):
            assert fits[k][name] == pytest.approx(one[name], abs=1e-6)
        assert fits[k]["intercept"] == pytest.approx(one["intercept"], abs=1e-6)
    scored = models.score_many(d.withColumn("k", F.lit(0)), {0: fits[0]}, "k").toPandas()
    z = fits[0]["intercept"] + ((scored[["a", "b", "c"]].to_numpy() - fits[0]["mean"]) / fits[0]["scale"]) @ fits[0]["coef"]
    assert np.allclose(scored["p"], 1 / (1 + np.exp(-z)))


def test_student_t_tail(spark):
    from tideline.functions import normal

    # closed forms: one degree of freedom is Cauchy, two has an algebraic tail, many are nearly normal
    rows = [(t, nu) for t in (0.0, 0.1, 1.0, 2.5, 12.0, -2.5) for nu in (1.0, 2.0, 30.0, 1e6)]
    got = spark.createDataFrame(rows, "t double, nu double").select("t", "nu", normal.t_two_sided(F.col("t"), F.col("nu")).alias("p")).collect()
    for r in got:
        t = abs(r.t)
        if r.nu == 1:
            assert r.p == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        elif r.nu == 2:
            assert r.p == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
        elif r.nu == 1e6:
            assert r.p == pytest.approx(math.erfc(t / math.sqrt(2)), abs=1e-5)
        else:  # Simpson's rule over the density
            c = math.exp(math.lgamma(15.5) - math.lgamma(15)) / math.sqrt(30 * math.pi)
            x = np.linspace(0, t, 2001)
            f = c * (1 + x * x / 30) ** -15.5
            area = t / 6000 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
            assert r.p == pytest.approx(1 - 2 * area, abs=1e-9)


def test_silhouettes_carry_no_centroids_on_rows(spark):
    d = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], i % 4) for i in range(40)], "id int, v array<double>, cluster_id int")
    plan = text.silhouettes(d, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInPandas" in plan


def test_silhouettes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(3 * (i % 3), 1, 4)], -1 if i == 7 else 9 if i == 8 else i % 3) for i in range(40)]
    got = {r["id"]: r["silhouette"] for r in text.silhouettes(spark.createDataFrame(rows, "id int, v array<double>, cluster_id int"), "v").collect()}
    assert set(got) == {i for i, _, c in rows if c != -1}
    far = lambda x, c, i: [sum((p - q) ** 2 for p, q in zip(x, y)) for j, y, k in rows if k == c and j != i]
    for i, x, c in rows:
        if c == -1:
            continue
        own = far(x, c, i)
        b = min(np.mean(far(x, k, None)) for k in {0, 1, 2, 9} - {c})
        assert abs(got[i] - (0 if not own else (b - np.mean(own)) / max(b, np.mean(own)))) < 1e-9
    assert text.silhouettes(spark.createDataFrame(rows[:1], "id int, v array<double>, cluster_id int"), "v").first()["silhouette"] is None


def test_guardrail_points_divide_by_zero_as_their_sql(spark):
    d = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0), (2.0, 5.0), (None, 5.0)], "a double, b double")
    r = d.select(ts.ieee_ratio(F.col("b"), F.col("a")).alias("r")).collect()
    assert r[0].r == math.inf and math.isnan(r[1].r) and r[2].r == 2.5 and r[3].r is None


def _unsteady(spark, n=400):
    """Values whose last bits change with every evaluation, as sums of doubles in the order of a shuffle do."""
    @F.pandas_udf("double")
    def noisy(x: pd.Series) -> pd.Series:
        return x * (1 + np.random.default_rng().uniform(-1e-13, 1e-13, len(x)))

    return spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("symbol"), noisy.asNondeterministic()((F.col("id") % 5 + 1).cast("double")).alias("x"))


def test_buckets_of_unsteady_values_are_whole(spark):
    r = cross.buckets(_unsteady(spark, 20_000), ["g"], "x", 20, "q").groupBy("q").count().collect()
    assert {x["q"]: x["count"] for x in r} == {q: 1000 for q in range(1, 21)}


def test_window_set_of_unsteady_values(spark):
    r = aggregates.window_set(_unsteady(spark), ["g"], "x").collect()
    assert len(r) == 1 and r[0]["n"] == 400 and abs(r[0]["median"] - 3) < 1e-9


def test_similarity_without_pruning_sends_no_vector_to_every_cell(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(2000, 16))
    x[100:110] = x[100]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    y = x.astype(np.float64)
    hits = y @ y.T >= 0.35
    for block in (150, 2048):
        work = spark.sparkContext.accumulator(0)
        got = {r.id: r.neighbours for r in text.similar(d, "id", "v", 0.35, block=block, counts=True, work=work).collect()}
        assert [got[i] for i in range(2000)] == (hits.sum(1) - 1).tolist()
        assert work.value < 0.6 * 2000 ** 2 or block == 2048  # all cells: every pair twice
    keep = np.r_[0:101, 110:2000]
    want = {(int(keep[i]), int(keep[j])) for i, j in zip(*np.nonzero(np.triu(hits[np.ix_(keep, keep)], 1)))}
    assert {(r.a, r.b) for r in text.similar(d.where("id <= 100 OR id >= 110"), "id", "v", 0.35, block=150).collect()} == want


def test_exact_sums_do_not_depend_on_the_order(spark):
    parts = {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1], "c": [0.3, 0.3], "d": [0.6, None], "nan": [0.6, float("nan")], "big": [1e30, 1.0], "none": [None]}
    d = spark.createDataFrame([(k, x) for k, xs in parts.items() for x in xs], "k string, x double")
    got = {r.k: r.x for r in d.groupBy("k").agg(aggregates.exact_sum("x").alias("x")).collect()}
    assert [got[k] for k in "abcd"] == [0.6] * 4 and got["nan"] != got["nan"] and got["big"] == 1e30 and got["none"] is None


def test_quintiles_of_equal_sums_go_by_symbol(spark, tmp_path):
    day = pd.Timestamp("2024-01-05")
    parts = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.3, 0.3], [0.6], [0.2, 0.2, 0.2]]
    rows = [(i, day.to_pydatetime(), u, "view", x, None) for i, (u, x) in enumerate((u, x) for u, xs in enumerate(parts) for x in xs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    import __spark_entry__ as entry

    got = {r.symbol: r.quintile for r in entry.queries()["W13_quintiles_per_month"](spark, str(tmp_path)).collect()}
    assert got == {str(u): u + 1 for u in range(5)}


def _unit_rows(n, dims, seed):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("threshold, kw", [(0.35, {"block": 40}), (0.9, {"pivots": 4, "block": 20}), (0.9, {})])
def test_similar_pairs_hold_copies_and_long_vectors(spark, threshold, kw):
    x = _unit_rows(400, 8, 14)
    x[50:90] = x[7]
    x[100] *= 5  # its partners lie further away than those of unit vectors
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[7].tolist()), (400, None)], "id long, v array<float>")
    y = x.astype(np.float64)
    want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(y @ y.T >= threshold, 1))))
    assert sorted((r.a, r.b) for r in text.similar(d, "id", "v", threshold, **kw).collect()) == want


def _dbscan(x, cosine, least):
    """Labels by the definition."""
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, True)
    core = hit.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(hit & core[None, :], label[None, :], len(x)).min(1), label)
        if (new == label).all():
            break
        label = new
    near = np.where(hit & core[None, :], label[None, :], len(x)).min(1)
    return np.where(near == len(x), -1, near).tolist()


@pytest.mark.parametrize("cosine, block", [(0.6, 30), (0.6, 2048), (0.95, 2048)])
def test_density_clusters_write_no_pairs(spark, monkeypatch, cosine, block):
    centres = _unit_rows(12, 8, 15)
    x = np.vstack([centres[np.arange(600) % 12] + 0.12 * np.random.default_rng(16).normal(size=(600, 8)), _unit_rows(100, 8, 17)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[20:30] = x[3]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    own, written = text._matches, {}

    def matches(rep, threshold, pivots, _, kind, work=None):
        written[kind] = own(rep, threshold, pivots, block, kind, work)
        return written[kind]

    monkeypatch.setattr(text, "_matches", matches)
    got = {r.id: r.cluster_id for r in text.dbscan(d, "id", "v", cosine, 4).collect()}
    assert [got[i] for i in range(700)] == _dbscan(x.astype(np.float64), cosine, 4)
    pairs = int(np.triu(x.astype(np.float64) @ x.astype(np.float64).T >= cosine, 1).sum())
    assert cosine == 0.95 or written["links"].count() < pairs / 4


def test_feature_moments_shuffle_single_rows(spark):
    d = spark.createDataFrame([(float(k % 7), None if k % 4 == 0 else 1.0 * k) for k in range(100)] + [(1000.0, 1.0)], "a double, b double")
    m = aggregates.moments(d, ["a", "b"])
    got = {r["feature"]: r for r in m.collect()}
    assert got["a"]["outliers"] == pytest.approx(1 / 101) and got["b"]["coverage"] == pytest.approx(76 / 101)
    assert got["a"]["mean"] == pytest.approx(np.mean([k % 7 for k in range(100)] + [1000])) and "hashpartitioning" not in m._jdf.queryExecution().executedPlan().toString()
