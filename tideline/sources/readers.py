"""Readers: archives, landed feeds, CSV series, JSON ledgers, file listings."""
from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import schemas
from tideline.functions import rules

# Column order of the archives, which may come without a header line.
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "n_trades", "taker_base", "taker_quote", "ignore")
FUNDING_COLUMNS = ("calc_time", "funding_interval_hours", "last_funding_rate")


def _unzip(columns: Sequence[str], keep: Sequence[str]):
    """Rows of the CSV files inside each archive; header lines vanish as non-numeric."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            for part in pd.read_csv(f, header=None, names=list(columns), dtype=str, chunksize=50_000):
                                num = part[list(keep)].apply(pd.to_numeric, errors="coerce")
                                yield num[num[keep[0]].notna()].assign(path=path)

    return run


def archives(spark: SparkSession, directory: str, glob: str = "*.zip") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory).select("path", "content")


def klines(files: DataFrame) -> DataFrame:
    """(path, content) archives to candles; open_time in milliseconds or microseconds."""
    keep = ("open_time", "open", "high", "low", "close", "volume", "quote_volume", "n_trades")
    raw = files.mapInPandas(_unzip(KLINE_COLUMNS, keep), "open_time double, open double, high double, low double, close double, volume double, quote_volume double, n_trades double, path string")
    return raw.select("path", rules.epoch_to_ts(F.col("open_time").cast("long")).alias("ts"), "open", "high", "low", "close", "volume", "quote_volume", F.col("n_trades").cast("long").alias("n_trades"))


def funding(files: DataFrame) -> DataFrame:
    raw = files.mapInPandas(_unzip(FUNDING_COLUMNS, FUNDING_COLUMNS), "calc_time double, funding_interval_hours double, last_funding_rate double, path string")
    return raw.select("path", rules.epoch_to_ts(F.col("calc_time").cast("long")).alias("ts"), F.col("funding_interval_hours").cast("int").alias("interval_hours"), F.col("last_funding_rate").alias("rate"))


def month_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4}-\d{2})(?!-?\d)", 1)


def listing(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Files below a prefix with the month in their name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(directory).select("path", "length", month_of(F.col("path")).alias("month"))


def consolidate(rows: DataFrame, keys: Sequence[str], until_month: str) -> DataFrame:
    """One row per key: months up to the cutoff, the last file wins on a duplicate stamp."""
    rest = [c for c in rows.columns if c not in keys]
    d = rows.withColumn("_m", month_of(F.col("path"))).where(F.col("_m") <= until_month)
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("path")).alias("_r")).select(*keys, "_r.*")


def reject_when_bad(files: DataFrame, failed: Column, limit: float = 0.01) -> DataFrame:
    """Raises when more than the allowed share of files failed to load."""
    r = files.agg(F.avg(failed.cast("double")).alias("share")).first()
    if r["share"] is not None and r["share"] > limit:
        raise ValueError(f"{r['share']:.2%} of the files failed, limit {limit:.2%}")
    return files


RSS_ITEM = "title string, link string, description string, pubDate string"


def rss(items: DataFrame, xml: str, source: Column, fallback: Column, watch: Sequence[str]) -> DataFrame:
    """RSS item texts to the common news schema."""
    d = items.withColumn("_x", F.from_xml(F.col(xml), RSS_ITEM))
    title, link = F.coalesce("_x.title", F.lit("")), F.coalesce("_x.link", F.lit(""))
    return _news(d, source, link, title, F.col("_x.description"), rules.parse_time(F.col("_x.pubDate"), fallback), rules.infer_symbols(title, watch))


def json_feed(items: DataFrame, js: str, source: Column, fallback: Column) -> DataFrame:
    d = items.withColumn("_x", F.from_json(F.col(js), "url string, title string, body string, published_at string, symbols array<string>"))
    return _news(d, source, F.coalesce("_x.url", F.lit("")), F.coalesce("_x.title", F.lit("")), F.col("_x.body"), rules.parse_time(F.col("_x.published_at"), fallback), F.col("_x.symbols"))


def _news(d, source, url, title, body, at, symbols) -> DataFrame:
    return d.select(rules.stable_id(source, url, title).alias("id"), source.alias("source"), url.alias("url"), title.alias("title"), body.alias("body"), at.alias("published_at"), symbols.alias("symbols"))


def fan_in(news: DataFrame, sources: Sequence[str], limit: int) -> DataFrame:
    """Configured sources only, newest items of each up to the limit (a feature of the feed)."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("published_at"), "id"))
    return news.where(F.col("source").isin(*sources)).withColumn("_r", rn).where(F.col("_r") <= limit).drop("_r")


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """date,value lines; non-numeric values become null."""
    raw = spark.read.schema("date string, value string").option("header", "true").csv(path)
    return raw.select(F.to_timestamp_ntz("date", F.lit("yyyy-MM-dd")).alias("ts"), F.col("value").try_cast("double").alias("value"))


def json_ledger(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(schemas.LEDGER).json(directory)
