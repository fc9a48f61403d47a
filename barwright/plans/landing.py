"""Histories, panel files, closed candles and text scalars, each with its SQL twin. Files go to a folder of the query's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.rolling import Series
from ..operators import state, xsection
from ..session import new_folder
from ..sources import history, readers
from ..sources.derive import BARS, RATES, bars, rates, table
from .registry import query
from .signals import _CHANNEL

S = Series()


@query(f"""WITH {BARS}, m AS (SELECT ticker, max(date) FILTER (WHERE date < DATE '1997-01-01') AS last FROM bars GROUP BY ticker),
 r AS (SELECT b.ticker, b.date, b.date >= m.last - 5 AND day(b.date) <> 20 AS fetched, b.date < DATE '1997-01-01' AS old, open, high, low, close, volume FROM bars b JOIN m USING (ticker))
 SELECT ticker, date, round(CASE WHEN fetched THEN open + 1 ELSE open END, 2) AS open, round(CASE WHEN fetched THEN high + 1 ELSE high END, 2) AS high, round(CASE WHEN fetched THEN low + 1 ELSE low END, 2) AS low,
   round(CASE WHEN fetched THEN close + 1 ELSE close END, 2) AS close, volume FROM r WHERE old OR fetched""", "date")
def history_refresh(spark, sf_dir):
    """A history written and read as CSV, refreshed by rows fetched from five days before its end, written and read again.

    Fetched prices are one higher, so that it shows which rows they replace; those of the 20th are provisional.
    """
    path = new_folder(spark, "history")
    b = bars(spark, sf_dir).select(*history.COLUMNS)
    history.write_history(b.where("date < DATE '1997-01-01'"), f"{path}/old")
    old = history.read_history(spark, f"{path}/old").unionByName(history.read_history(spark, f"{path}/missing"))
    fetched = b.withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")}).withColumn("is_provisional", F.dayofmonth("date") == 20)
    # Of the verified rows and their overlap with the old ones as many must be there as a merge wants.
    history.write_history(history.refreshed(old, fetched, verified=b), f"{path}/new")
    return history.read_history(spark, f"{path}/new")


@query(_CHANNEL.replace("FROM bars\n", "FROM bars WHERE date >= DATE '1996-06-03' - 60\n") + " SELECT ticker, date, dc_high, dc_low FROM sig WHERE date BETWEEN DATE '1996-06-03' AND DATE '1997-06-30'", "date")
def buffered_start(spark, sf_dir):
    """Channels from the first day asked for, since the scan begins 60 days before it."""
    rows = state.channel_signals(history.buffered(bars(spark, sf_dir), "1996-06-03"), 20, 10, S)
    return history.clip(rows, "1996-06-03", "1997-06-30").select("ticker", "date", "dc_high", "dc_low")


@query(_CHANNEL + """, e AS (SELECT ticker, date, close, position, coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY date), 0) AS b FROM sig)
 SELECT ticker, date, close, CASE WHEN position > b THEN 'BUY' ELSE 'SELL' END AS signal FROM e WHERE position <> b""", "date")
def signal_log(spark, sf_dir):
    """The log of signals, computed anew and written whole over an older and longer one."""
    path = new_folder(spark, "log") + "/signals"
    edges = state.edges(state.channel_signals(bars(spark, sf_dir), 20, 10, S), S).select("ticker", F.col("date").cast("string").alias("date"), "close", "signal")
    for rows in (edges.unionAll(edges), edges):
        rows.write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema("ticker string, date date, close double, signal string").option("header", True).csv(path)


@query(f"""WITH {BARS} SELECT ticker, date, open, close FROM bars WHERE day(date) % 3 <> 0 AND volume % 4 <> 1""", "date")
def closed_candles(spark, sf_dir):
    """Candles that a second source says are closed, with its prices: every third day it says OPEN, and some prices differ."""
    b = bars(spark, sf_dir)
    second = b.withColumn("status", F.when(F.dayofmonth("date") % 3 == 0, "OPEN").otherwise("CLOSE")).withColumn("close", F.when(F.col("volume") % 4 == 1, F.col("close") + 0.01).otherwise(F.col("close") + 0.0005))
    return readers.closed_candles(b, second).select("ticker", "date", "open", "close")


@query("""SELECT CASE WHEN o_orderkey < 1000000 THEN lpad(CAST(o_orderkey AS VARCHAR), 6, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS ticker, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS open, o_orderkey % 2 = 0 AS is_listed, o_orderkey % 3 = 0 AS is_tradable,
 strftime(o_orderdate, '%Y-%m-%d') || ' 09:00:00' AS stamp FROM orders""", "date")
def panel_file(spark, sf_dir):
    """A panel written as text and read with its types: short codes padded, bad numbers null, flags of eight spellings."""
    o = table(spark, sf_dir, "orders")
    said = lambda k: F.when(F.col("o_orderkey") % k == 0, F.element_at(F.array(*map(F.lit, ("Y", "true", "1", " yes "))), (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, ("N", "FALSE", "0", "no"))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    one = F.lit("1")
    raw = o.select(
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.col("o_orderkey").cast("string").alias("ticker"), F.when(F.col("o_orderkey") % 7 == 0, "1,0-").otherwise(F.col("o_custkey").cast("string")).alias("open"), one.alias("close"), one.alias("volume"),
        one.alias("trading_value"), one.alias("foreign_net_value"), one.alias("market_cap"), said(2).alias("is_listed"), said(3).alias("is_tradable"), F.date_format("o_orderdate", "yyyy-MM-dd 09:00:00").alias("asof"),
    )
    path = new_folder(spark, "panel")
    raw.write.option("header", True).csv(path)
    return readers.panel_csv(spark, path).select("ticker", "date", "open", "is_listed", "is_tradable", F.date_format("data_available_at", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE AS strict, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS dotted, CAST(o_orderkey % 5 AS BIGINT) + o_custkey AS summed FROM orders""", "dotted")
def strict_texts(spark, sf_dir):
    """Numbers with signs and separators that must parse, days with dots or another shape, and a sum over columns with nulls."""
    o = table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    fifth = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 5)
    return o.select("o_orderkey", scalar.number_strict(F.concat(F.lit(" +"), F.format_number("o_totalprice", 2), F.lit(" "))).alias("strict"), scalar.dotted_day(day).alias("dotted"), scalar.row_sum(fifth, F.col("o_custkey")).alias("summed"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_sha256 FROM pages""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(scalar.html_escaped(F.col("html")), 256).alias("escaped_sha256"))


@query("""WITH l AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' 한국어' ELSE n_name END AS label FROM nation), w AS (SELECT *, length(label) + CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 0 END AS width FROM l)
 SELECT n_nationkey, label, CAST(width AS INTEGER) AS width, label || repeat(' ', greatest(0, 24 - width)) AS padded FROM w""")
def display_labels(spark, sf_dir):
    """Labels padded by the columns they take: a Korean letter takes two."""
    n = table(spark, sf_dir, "nation")
    label = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" 한국어"))).otherwise(F.col("n_name")).alias("label"))
    return label.select("n_nationkey", "label", scalar.display_width(F.col("label")).alias("width"), scalar.display_padded(F.col("label"), 24).alias("padded"))


@query("""SELECT n_name AS label, CAST(list_sum(list_transform(string_split(n_name, ''), lambda c: unicode(c))) AS INTEGER) AS seed FROM nation""")
def label_seeds(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), scalar.label_seed(F.col("n_name")).alias("seed"))


@query(f"""WITH {RATES}, f AS (SELECT ticker, date, last_value(rate IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS rate FROM rates WHERE date >= DATE '1996-06-03' - 15)
 SELECT ticker, date, round(rate, 6) AS rate FROM f WHERE date >= DATE '1996-06-03'""", "date")
def rate_scan(spark, sf_dir):
    """A series of one value column from 15 days before the first day asked for, carried forward."""
    r = history.buffered(rates(spark, sf_dir), "1996-06-03", 15, ("rate",))
    return history.clip(r.withColumn("rate", S.last_known("rate")), "1996-06-03").select("ticker", "date", F.round("rate", 6).alias("rate"))


@query("""WITH f AS (SELECT o_custkey AS name, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) SELECT name, row_number() OVER (ORDER BY first) AS place FROM f""")
def distinct_in_order(spark, sf_dir):
    """The distinct customers in the order of their first order, numbered."""
    return xsection.distinct_in_order(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), "o_orderkey"), "name", "o_orderkey", "place").select("name", "place")
