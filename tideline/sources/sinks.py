"""Parquet sinks with keys. There is no MERGE on plain Parquet, so a sink rewrites the partitions a
batch touches: old and new rows meet, the newest per key stays, and the result is materialised in
the shared folder before the partitions are replaced."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import quality
from tideline.session import cut_lineage


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or an empty one with its fixed schema where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def ensure_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, written empty with its fixed schema first where there is none; what is there stays."""
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def newest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def overwrite(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def upsert(batch: DataFrame, path: str, keys: Sequence[str], version: str, partition: Sequence[str]) -> None:
    """Insert or replace by key; only partitions present in the batch are read and rewritten."""
    old = read_table(batch.sparkSession, path, batch.schema)
    if partition:
        old = old.join(batch.select(*partition).distinct(), list(partition), "left_semi")
    merged = newest(old.select(*batch.columns).unionByName(batch), keys, version)
    overwrite(cut_lineage(merged), path, partition)


def replace_range(batch: DataFrame, path: str, keys: Sequence[str], since, until, partition: Sequence[str]) -> None:
    """Delete [since, until) of the batch's keys, then insert the batch."""
    old = read_table(batch.sparkSession, path, batch.schema)
    lo, hi = F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")
    mine = batch.select(*keys).distinct()
    inside = (F.col("ts") >= lo) & (F.col("ts") < hi)
    kept = old.where(~inside).unionByName(old.where(inside).join(mine, list(keys), "left_anti").select(*old.columns))
    overwrite(cut_lineage(kept.select(*batch.columns).unionByName(batch)), path, partition)


def append(df: DataFrame, path: str, run_id: str | None = None) -> None:
    (df if run_id is None else df.withColumn("run_id", F.lit(run_id))).write.mode("append").parquet(path)


def delta(batch: DataFrame, path: str, key: str = "symbol") -> DataFrame:
    """Rows newer than what the table already holds for their key."""
    seen = read_table(batch.sparkSession, path, batch.schema).groupBy(key).agg(F.max("ts").alias("_seen"))
    return batch.join(seen, key, "left").where(F.col("_seen").isNull() | (F.col("ts") > F.col("_seen"))).drop("_seen")


def flag_by_prefix(df: DataFrame, ident: str, prefix: str, flag: str) -> DataFrame:
    return df.withColumn(flag, F.col(flag) | F.col(ident).startswith(prefix))


def archive(spark: SparkSession, path: str, target: str, schema) -> None:
    """Copy a table away, then leave it empty."""
    read_table(spark, path, schema).write.mode("overwrite").parquet(target)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def backfill(candles: DataFrame, path: str, since, until, transform: Callable[[DataFrame], DataFrame], timeframe: str = "1h", chunk: str = "month") -> DataFrame:
    """Loads [since, until) of all symbols in one chain and reports each: candles are upserted to ``path``/candles and
    checked, ``transform`` of the symbols that pass goes to ``path``/features and is checked too. Returns (symbol,
    n_candles, n_features, failed); ``failed`` names the check a symbol did not pass (null: none). A symbol that fails
    does not stop the others. Both tables are partitioned by month, so candles carry ``ingested_at`` and features
    ``computed_at`` as their versions."""
    spark, keys = candles.sparkSession, ["symbol", "timeframe", "ts"]
    lo, hi = F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")
    month = F.date_format("ts", "yyyy-MM")
    batch = candles.where((F.col("ts") >= lo) & (F.col("ts") < hi)).withColumns({"timeframe": F.lit(timeframe), "month": month})
    upsert(batch, f"{path}/candles", keys, "ingested_at", ["month"])
    stored = read_table(spark, f"{path}/candles", batch.schema).join(batch.select("symbol").distinct(), "symbol", "left_semi")
    first = cut_lineage(quality.candles(stored, timeframe, chunk).select("symbol", F.col("n").alias("n_candles"), "valid"))
    made = transform(stored.join(first.where("valid").select("symbol"), "symbol", "left_semi")).withColumns({"timeframe": F.lit(timeframe), "month": month})
    upsert(made, f"{path}/features", keys, "computed_at", ["month"])
    kept = read_table(spark, f"{path}/features", made.schema).join(first.where("valid").select("symbol"), "symbol", "left_semi")
    second = quality.features(kept).select("symbol", F.col("n").alias("n_features"), F.col("valid").alias("_sound"))
    failed = F.when(~F.col("valid"), "candles").when(~F.coalesce("_sound", F.lit(False)), "features")
    return first.join(second, "symbol", "left").select("symbol", "n_candles", F.coalesce("n_features", F.lit(0)).cast("long").alias("n_features"), failed.alias("failed"))


def ingest(raw: DataFrame, since, until, symbol: Column, timeframe: str) -> DataFrame:
    """Half-open range, stamps from epoch, one row per stamp."""
    from tideline.functions import rules

    d = raw.withColumn("ts", rules.epoch_to_ts(F.col("open_time")))
    d = d.where((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return d.withColumns({"symbol": symbol, "timeframe": F.lit(timeframe)}).dropDuplicates(["symbol", "timeframe", "ts"]).drop("open_time")
