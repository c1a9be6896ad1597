"""Made-up rows of any number, the same each time: a multiplicative hash of the row number stands in for chance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.grid import from_micros_col, micros_col, ntz, uuid_of_col

MONTH_US = 30 * 86_400_000_000


def scatter(c: Column, modulus: int = 1_000_000) -> Column:
    return F.pmod(c * F.lit(2654435761), F.lit(modulus))


def messages(spark: SparkSession, n: int, months: int = 6, since: dt.datetime = dt.datetime(2024, 1, 1), tenants: int = 5) -> DataFrame:
    """(id, h, tenant, created_at), spread over the months."""
    h = scatter(F.col("id"))
    at = from_micros_col(h * F.lit(months * MONTH_US // 1_000_000) + micros_col(ntz(since)))
    return spark.range(1, n + 1).select("id", h.alias("h"), (h % tenants).alias("tenant"), at.alias("created_at"))


def events(spark: SparkSession, n: int, months: int = 6, since: dt.datetime = dt.datetime(2024, 1, 1)) -> DataFrame:
    """(id, created_at, user_id, kind, payload): times rise with the id."""
    at = from_micros_col(F.col("id") * F.lit(months * MONTH_US // max(n, 1)) + micros_col(ntz(since)))
    return spark.range(1, n + 1).select("id", at.alias("created_at"), scatter(F.col("id"), 50_000).alias("user_id"), F.pmod("id", F.lit(8)).alias("kind"), F.repeat(F.md5(F.col("id").cast("string")), 11).alias("payload"))


def uuid_events(spark: SparkSession, n: int, months: int = 6, since: dt.datetime = dt.datetime(2024, 1, 1)) -> DataFrame:
    """(id, payload) with time-ordered UUIDs whose tail is a hash of the row number."""
    e = events(spark, n, months, since)
    tail = F.md5(F.concat(F.lit("tail"), F.col("id").cast("string")))
    head = F.substring(uuid_of_col(F.col("created_at")), 1, 14)
    return e.select(F.concat(head, F.lit("7"), F.substring(tail, 1, 3), F.lit("-8"), F.substring(tail, 4, 3), F.lit("-"), F.substring(tail, 7, 12)).alias("id"), "payload")
