"""Named queries with the SQL that states the same result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Tables:
    """Lazy access to the given parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")


def nudge(digits: int) -> float:
    """A small part of the last digit. Exact halves, which engines round either way depending on the
    last bit of a sum, then go up on both sides."""
    return float(f"1.7e-{digits + 3}")


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, the form every oracle uses too."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + nudge(digits), digits) + F.lit(0.0)


def rsql(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE)+{nudge(digits)!r},{digits})+0e0)"


def cdf_sql(z: str) -> str:
    """Standard normal CDF of a column in the oracle's SQL, with the gamma function where the library multiplies terms up."""
    terms = f"list_sum([exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300) / sqrt(2e0)) - {z} * {z} / 2 - lgamma(k + 1.5)) for k in range(120)])"
    return f"CASE WHEN {z} > 8 THEN 1e0 WHEN {z} < -8 THEN 0e0 ELSE 0.5 + 0.5 * sign({z}) * {terms} END"
