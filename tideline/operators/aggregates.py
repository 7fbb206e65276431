"""Grouped statistics. Everything combines on the map side; order statistics go through ranks."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import cross, scan
from tideline.operators.timeseries import ratio
from tideline.session import cut_lineage


def exact_sum(col: str) -> Column:
    """Sum of doubles by the decimals they are written with, so that it does not depend on the order of the rows and equal
    totals are equal. Values of 1e20 or more, or a NaN among them, make it the plain sum."""
    d = F.col(col).try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(d) == F.count(col), F.try_sum(d).cast("double")), F.sum(col))


def base_rates(df: DataFrame, group: Sequence[str], y: str = "y") -> DataFrame:
    """Count, mean label and the F1 of always saying yes, per group and pooled in one pass."""
    p = F.avg(y)
    cols = [F.col(g) for g in group]
    return df.groupingSets([cols, []], *cols).agg(
        F.count(F.lit(1)).alias("n"), p.alias("base_rate"), (2 * p / (1 + p)).alias("naive_f1"))


def dominant(df: DataFrame, keys: Sequence[str], label: str, weight: str, default: float = 0.5) -> DataFrame:
    """Most frequent label per key with its mean weight, next to the mean over all labels.
    Ties go to the alphabetically first label."""
    w = F.coalesce(F.col(weight), F.lit(default))
    g = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("cnt"), F.sum(w).alias("s"))
    best = F.max_by(F.struct(label, "cnt", (F.col("s") / F.col("cnt")).alias("avg_weight")),
                    F.struct("cnt", F.expr(f"transform(split({label}, ''), c -> -ascii(c))")))
    return g.groupBy(*keys).agg(best.alias("_b"), (F.sum("s") / F.sum("cnt")).alias("avg_weight_all")).select(
        *keys, "_b.*", "avg_weight_all")


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key, the smallest one on ties."""
    g = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col(value))).alias("mode"))


def decile_table(df: DataFrame, feature: str, y: str, k: int = 10) -> DataFrame:
    """Target rate per equal-count bucket of the feature (ties ordered by symbol)."""
    d = df.where(F.col(feature).isNotNull() & F.col(y).isNotNull()).select(feature, y, "row_key", F.lit(0).alias("_g"))
    d = cross.buckets(d, ["_g"], feature, k, "bucket", tie="row_key")
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"), F.avg(feature).alias("mean_x"))


def correlation_pairs(df: DataFrame, cols: Sequence[str], floor: float | None = None) -> DataFrame:
    """Pairwise correlations of the given columns from one aggregate row."""
    prs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(prs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                      for i, (a, b) in enumerate(prs)])
    out = one.select(F.explode(items).alias("r")).select("r.*")
    return out if floor is None else out.where(F.abs("corr") > floor)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    wide = df.select(*ids, *[F.col(x).cast("double").alias(x) for x in cols])
    return wide.unpivot(list(ids), list(cols), "feature", "value")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, std, skew, share beyond three sigmas and coverage of each column, from two passes that shuffle one row a task."""
    d = df.select(*[F.col(x).cast("double").alias(x) for x in cols])
    stats = {"mean": F.avg, "std": F.stddev_samp, "skew": F.skewness, "coverage": lambda x: F.count(x) / F.count(F.lit(1))}
    one = d.agg(*[F.struct(*[f(x).alias(k) for k, f in stats.items()]).alias(f"_{x}") for x in cols])
    far = d.crossJoin(F.broadcast(one)).agg(  # one row
        *[F.avg((F.abs(F.col(x) - F.col(f"_{x}.mean")) > 3 * F.col(f"_{x}.std")).cast("double")).alias(f"_far_{x}") for x in cols])
    items = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"_{x}").alias("_s"), F.col(f"_far_{x}").alias("outliers")) for x in cols])
    return one.crossJoin(F.broadcast(far)).select(F.explode(items).alias("r")).select("r.feature", "r._s.*", "r.outliers")  # one row x one row


def compounded(ret: str) -> Column:
    """Product of 1+r minus 1, exact also for total losses."""
    return F.product(1 + F.col(ret)) - 1


def annual_funding(df: DataFrame, rate: str, min_days: int = 90) -> DataFrame:
    span = F.datediff(F.max("ts"), F.min("ts")) + 1
    return df.groupBy("symbol").agg(
        F.when(span >= min_days, F.sum(rate) * 365 / span).alias("funding_annual"), span.alias("days"))


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    def n(c):
        return F.count_if(c)

    g = df.groupBy(*keys).agg(
        n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"),
        n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = ratio(tp.cast("double"), (tp + fp).cast("double"))
    rec = ratio(tp.cast("double"), (tp + fn).cast("double"))
    return g.withColumns({
        "accuracy": ratio((tp + tn).cast("double"), (tp + fp + fn + tn).cast("double")),
        "precision": prec, "recall": rec, "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn)})


def auc_ap(df: DataFrame, keys: Sequence[str], score: str, y: str, scale: float = 1.0) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per key. Rows first shrink to one row per
    distinct score, then running counts give the ranks without ordering a whole key."""
    keys = list(keys)
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(*keys, score).agg(
        F.sum(F.col(y).cast("long")).alias("_p"), F.sum(1 - F.col(y).cast("long")).alias("_n"))
    cut = scan._value_chunks(g, keys, score, None)
    g = scan.running(cut, [("sum", F.col("_n"), "_cn"), ("sum", F.col("_p"), "_cp")], keys, [score],
                     chunk_cols=["_vb", "_vt"])
    tot = g.groupBy(*keys).agg(F.sum("_p").alias("_allp"), F.sum("_n").alias("_alln"))
    g = scan.attach(g, tot, keys)
    above_p = F.col("_allp") - F.col("_cp") + F.col("_p")
    above_n = F.col("_alln") - F.col("_cn") + F.col("_n")
    auc = F.sum(F.col("_p") * (F.col("_cn") - F.col("_n") / 2.0))
    ap = F.sum(F.col("_p") * above_p / (above_p + above_n).cast("double"))
    return g.groupBy(*keys).agg(
        F.max("_allp").alias("n_pos"), F.max("_alln").alias("n_neg"),
        (auc / F.nullif(F.max("_allp") * F.max("_alln") * 1.0, F.lit(0.0))).alias("auc"),
        (ap / F.nullif(F.max("_allp") * 1.0, F.lit(0.0))).alias("avg_precision"))


def window_set(windows: DataFrame, keys: Sequence[str], value: str = "net_pct") -> DataFrame:
    """Median/mean/std/share positive/min/max over a set of evaluation windows. The median reads the windows several
    times, and their means may come out with another last bit each time, so they are fixed first."""
    windows = cut_lineage(windows.select(*keys, value))
    med = scan.quantiles(windows, keys, value, [0.5], ["median"])
    g = windows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.avg((F.col(value) > 0).cast("double")).alias("pct_positive"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.join(med, list(keys))


def by_year(windows: DataFrame, keys: Sequence[str], value: str = "net_pct", at: str = "t0") -> DataFrame:
    return windows.groupBy(*keys, F.year(at).alias("year")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
