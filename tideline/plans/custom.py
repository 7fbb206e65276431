"""A user's own aggregates, scorers and strategies."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import custom
from tideline.operators import portfolio as pf
from tideline.plans import portfolios as pl
from tideline.plans.registry import query, rnd, rsql


@query("U03_custom_aggregate", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC) AS k FROM lineitem)
SELECT l_returnflag, l_linestatus, {rsql('var_samp(ln(l_extendedprice))', 5)} AS log_variance, {rsql('avg(l_extendedprice) FILTER (WHERE k <= 10)', 3)} AS tail_mean FROM r GROUP BY ALL""")
def _(t):
    d = custom.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], {"log_variance": custom.LogVariance("l_extendedprice"), "tail_mean": custom.TailMean("l_extendedprice", 10)})
    return d.select("l_returnflag", "l_linestatus", rnd("log_variance", 5).alias("log_variance"), rnd("tail_mean", 3).alias("tail_mean"))


ARTEFACTS = {
    "purchase": {"kind": "logistic", "features": ["value", "hour"], "weights": [0.8, -0.3], "means": [50.0, 12.0], "scales": [25.0, 6.0], "bias": 0.1},
    "click": {"kind": "trees", "trees": [("value", 40.0, 0.25, ("hour", 12, 0.5, 0.75)), ("hour", 6, -0.125, 0.125)], "bias": 0.0},
    "signup": {"kind": "linear", "features": ["value"], "weights": [0.01], "bias": 0.0},
}


@query("U06_scorer_by_stream_type", f"""SELECT event_id, {rsql('''CASE event_type WHEN 'purchase' THEN 1 / (1 + exp(-(0.1e0 + (value - 50) / 25e0 * 0.8e0 + (hour(ts) - 12) / 6e0 * -0.3e0)))
WHEN 'click' THEN CASE WHEN value < 40 THEN 0.25e0 WHEN hour(ts) < 12 THEN 0.5e0 ELSE 0.75e0 END + CASE WHEN hour(ts) < 6 THEN -0.125e0 ELSE 0.125e0 END WHEN 'signup' THEN 0.01e0 * value END''')} AS score FROM events""")
def _(t):
    d = t.events.withColumn("hour", F.hour("ts"))
    return custom.scored(d, ARTEFACTS, "event_type").select("event_id", rnd("score").alias("score"))


def momentum(s, floor):
    return pf.momentum_signals(s.where(F.abs("past") >= floor), "past").withColumn("vol", F.col("rv"))


def reversal(s, floor):
    return momentum(s.withColumn("past", -F.col("past")), floor)


_M = pl.DIRS.replace("past > 0.002", "past > 0").replace("past < -0.002", "past < 0").replace("least(abs(past) * 20, 0.95)", "least(abs(past) / 0.2, 0.95)")


def _one(name, sign, floor):
    sig = f"(SELECT * REPLACE ({sign} * past AS past) FROM sig WHERE abs(past) >= {floor})"
    return f"(WITH {_M.replace('FROM sig', 'FROM ' + sig)} SELECT '{name}' AS strategy, * FROM ({pl.EVAL}))"


@query("U07_strategy_slot", f"{pl.BASE} SELECT strategy, ts, net, gross, n FROM ({' UNION ALL '.join(_one(*x) for x in (('momentum', 1, 0.0), ('momentum_wide', 1, 0.002), ('reversal', -1, 0.0)))})")
def _(t):
    slots = [custom.Strategy("momentum", momentum, floor=0.0), custom.Strategy("momentum_wide", momentum, floor=0.002), custom.Strategy("reversal", reversal, floor=0.0)]
    d = custom.compare(slots, pl.sig(t), lambda rows, keys: pf.evaluate_signals(rows, keys, 0.0036))
    return d.select("strategy", "ts", rnd("net").alias("net"), rnd("gross").alias("gross"), "n")
