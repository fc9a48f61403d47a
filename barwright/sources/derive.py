"""Bars, panels and flows derived from the star-schema tables. Sums are of whole cents, so that they are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x) -> F.Column:
    return F.round(F.col(x) * 100).cast("long")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders, an order priority a ticker: date, open, high, low, close, volume, value_cents, ret."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", "o_totalprice")
    out = orders.groupBy("ticker", "date").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"), F.sum(cents("o_totalprice")).alias("value_cents"),
    )
    # A tame return between -2 and 2 %, for products over thousands of rows.
    return out.withColumn("ret", 0.02 * (F.col("close") - F.col("open")) / (F.col("close") + F.col("open")))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events, an event type a ticker."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("date"), "ts", "event_id", "value")
    first = F.struct("ts", "event_id")
    return e.groupBy("ticker", "date").agg(F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", first).alias("close"), F.count(F.lit(1)).alias("volume"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows of suppliers: trading_value, foreign_net_value, volume, market_cap, open, close (null without), flags."""
    l = table(spark, sf_dir, "lineitem")
    # The unit price in hundredths of a cent, by whole division: the same in any engine.
    units = F.floor(F.try_divide(cents("l_extendedprice") * 100, F.col("l_quantity").cast("long"))).cast("long")
    part = lambda s: F.try_divide(F.sum(F.when(F.col("l_linestatus") == s, units)) / 10000.0, F.count(F.when(F.col("l_linestatus") == s, 1)))
    sign = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    out = l.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").cast("string").alias("ticker")).agg(
        F.sum(cents("l_extendedprice")).alias("trading_value"), F.sum(cents("l_extendedprice") * sign).alias("foreign_net_value"), F.count(F.lit(1)).alias("volume"),
        F.sum("l_quantity").alias("market_cap"), part("F").alias("open"), part("O").alias("close"),
    )
    return out.withColumn("is_listed", F.lit(True)).withColumn("is_tradable", F.col("open").isNotNull() & F.col("close").isNotNull())


PARTIES = {"p1": "1-URGENT", "p2": "2-HIGH", "p3": "3-MEDIUM", "p4": "4-NOT SPECIFIED", "p5": "5-LOW"}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily signed flows of five parties, and the day's open, close and turnover; ticker says which half of the customers."""
    o = table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date")).withColumn("ticker", F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd"))
    signed = cents("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return o.groupBy("ticker", "date").agg(
        *[F.coalesce(F.sum(F.when(F.col("o_orderpriority") == p, signed)), F.lit(0)).alias(c) for c, p in PARTIES.items()],
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.sum(cents("o_totalprice")).alias("value_cents"),
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse daily rate for each ticker of bars(): the largest unit price shipped, on every third day, sometimes null."""
    l = table(spark, sf_dir, "lineitem")
    out = l.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.max("l_discount").alias("rate"))
    out = out.where(F.dayofyear("date") % 3 == 0).select("date", F.when(F.dayofyear("date") % 2 == 0, F.col("rate")).alias("rate"))
    return out.crossJoin(F.broadcast(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker")).distinct()))


#: The same in DuckDB's SQL, as common table expressions.
BARS = """bars0 AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value_cents FROM orders GROUP BY 1, 2),
 bars AS (SELECT *, 0.02::DOUBLE * (close - open) / (close + open) AS ret FROM bars0)"""
HOURLY = """hours AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS date, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
PANEL = """pan0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS trading_value,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS BIGINT) AS foreign_net_value, count(*) AS volume, sum(l_quantity) AS market_cap,
  sum(CAST(floor(CAST(round(l_extendedprice * 100) AS BIGINT) * 100 / CAST(l_quantity AS BIGINT)) AS BIGINT)) FILTER (WHERE l_linestatus = 'F') / 10000.0::DOUBLE / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS open,
  sum(CAST(floor(CAST(round(l_extendedprice * 100) AS BIGINT) * 100 / CAST(l_quantity AS BIGINT)) AS BIGINT)) FILTER (WHERE l_linestatus = 'O') / 10000.0::DOUBLE / nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS close FROM lineitem GROUP BY 1, 2),
 pan AS (SELECT *, true AS is_listed, open IS NOT NULL AND close IS NOT NULL AS is_tradable FROM pan0)"""
FLOWS = """flow AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS ticker, CAST(o_orderdate AS DATE) AS date,
  """ + ", ".join(f"CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) FILTER (WHERE o_orderpriority = '{p}'), 0) AS BIGINT) AS {c}" for c, p in PARTIES.items()) + """,
  min_by(o_totalprice, o_orderkey) AS open, max_by(o_totalprice, o_orderkey) AS close, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value_cents FROM orders GROUP BY 1, 2)"""
RATES = """rate0 AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_discount) AS rate FROM lineitem GROUP BY 1),
 rates AS (SELECT date, ticker, CASE WHEN dayofyear(date) % 2 = 0 THEN rate END AS rate FROM rate0, (SELECT DISTINCT o_orderpriority AS ticker FROM orders) WHERE dayofyear(date) % 3 = 0)"""
