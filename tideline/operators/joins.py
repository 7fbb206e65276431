"""As-of, tolerance, range-exclusion and pair joins, all as equi-joins or carried values."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import scan


def as_of(probe: DataFrame, build: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "ts",
          chunk: str = "month") -> DataFrame:
    """Latest build row with build.ts <= probe.<at>, per key; unmatched probes keep nulls.

    Both sides are stacked and the last build value is carried forward over pieces of time: one
    exchange, no range join, and a hot key is spread over its pieces. ``build`` holds at most
    one row per (keys, ts)."""
    keys = list(keys)
    payload = F.struct(F.col("ts").alias("asof_ts"), *values)
    rest = F.struct(*probe.columns)
    b = build.select(*keys, F.col("ts").alias("_t"), F.lit(0).alias("_side"), payload.alias("_b"),
                     F.lit(None).cast(probe.select(rest.alias("r")).schema["r"].dataType).alias("_p"),
                     F.lit("").alias("_id"))
    p = probe.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast(build.select(payload.alias("r")).schema["r"].dataType).alias("_b"),
                     rest.alias("_p"), F.lit("").alias("_id"))
    both = b.unionByName(p)
    out = scan.running(both, [("last", F.col("_b"), "_hit")], keys, ["_t", "_side"], chunk)
    return out.where(F.col("_side") == 1).select("_p.*", "_hit.*")


def as_of_many(probe: DataFrame, build: DataFrame, value: str, offsets_hours: Sequence[int], names: Sequence[str],
               chunk: str = "month") -> DataFrame:
    """Value of the build series as of ts + each offset. The offsets become rows, so any number of
    look-backs and look-aheads is one pass, folded back to one row per (symbol, ts)."""
    items = F.explode(F.array(*[F.lit(h) for h in offsets_hours])).alias("_h")
    p = probe.select("symbol", "ts", items).withColumn("_at", F.col("ts") + F.make_dt_interval(hours=F.col("_h")))
    hit = as_of(p, build.select("symbol", "ts", F.col(value).alias("_v")), ["symbol"], ["_v"], at="_at", chunk=chunk)
    return hit.groupBy("symbol", "ts").agg(*[F.max(F.when(F.col("_h") == h, F.col("_v"))).alias(n)
                                             for h, n in zip(offsets_hours, names, strict=True)])


def as_of_offset(panel: DataFrame, value: str, offset: str, name: str, chunk: str = "month") -> DataFrame:
    """Calendar look-back: the last value known at ts - offset (contrast with positional lag)."""
    probe = panel.withColumn("_at", F.col("ts") - F.expr(f"interval {offset}"))
    build = panel.select("symbol", "ts", F.col(value).alias(name))
    return as_of(probe, build, ["symbol"], [name], at="_at", chunk=chunk).drop("_at", "asof_ts")


def first_within(probe: DataFrame, build: DataFrame, keys: Sequence[str], values: Sequence[str], after_days: int,
                 tolerance_days: int) -> DataFrame:
    """First build row with ts in [t+after, t+after+tolerance]. Time is cut into buckets of the
    tolerance, so each probe meets at most two buckets in an ordinary equi-join."""
    keys = list(keys)
    width = tolerance_days * 86400
    b = build.select(*keys, F.col("ts").alias("_bt"), *[F.col(v).alias(f"next_{v}") for v in values])
    b = b.withColumn("_k", F.floor(F.unix_timestamp("_bt") / width))
    lo = F.unix_timestamp("ts") + after_days * 86400
    p = probe.withColumns({"_lo": lo, "_hi": lo + width})
    p = p.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    j = p.join(b, [*keys, "_k"]).where(F.unix_timestamp("_bt").between(F.col("_lo"), F.col("_hi")))
    rest = [c for c in probe.columns if c not in (*keys, "ts")]
    hit = F.struct(F.col("_bt").alias("next_ts"), *[f"next_{v}" for v in values], *rest)
    return j.groupBy(*keys, "ts").agg(F.min_by(hit, "_bt").alias("_h")).select(*keys, "ts", "_h.*")


def excluded_days(blocks: DataFrame, purge: int, embargo: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every day inside [start - purge, end + embargo] of any block, as rows."""
    day = F.explode(F.sequence(F.date_sub(F.to_date("start"), purge), F.date_add(F.to_date("end"), embargo)))
    return blocks.select(*keys, day.alias("day")).distinct()


def outside_blocks(dates: DataFrame, blocks: DataFrame, purge: int, embargo: int, keys: Sequence[str] = ()) -> DataFrame:
    """Range anti-join: drops dates near any block, as an anti-join on the day."""
    bad = excluded_days(blocks, purge, embargo, keys)
    d = dates.withColumn("day", F.to_date("ts"))
    return d.join(bad, [*keys, "day"], "left_anti").drop("day")


def symbol_pairs(spark, symbols: Sequence[str]) -> DataFrame:
    """The pairs (a < b) of a configured universe; the list is a parameter, so its size is known."""
    s = sorted(symbols)
    rows = [(a, b) for i, a in enumerate(s) for b in s[i + 1:]]
    return spark.createDataFrame(rows, "a string, b string")


def pair_series(panel: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """One row per (pair, ts) where both legs have a value: two equi-joins, no product per date."""
    left = panel.select(F.col("symbol").alias("a"), "ts", F.col(value).alias("value_a")).join(pairs, "a")
    right = panel.select(F.col("symbol").alias("b"), "ts", F.col(value).alias("value_b"))
    return left.join(right, ["b", "ts"])


def zero_filled_union(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Union of keys of two books; a side that lacks the key counts as zero."""
    j = left.join(right, list(keys), "full")
    return j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})


def json_array_contains(col: str, item: str | Column) -> Column:
    return F.array_contains(F.from_json(col, "array<string>"), item)
