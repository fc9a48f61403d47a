"""Answers landed page by page, candles as JSON, and whole payloads, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import state
from ..session import new_folder
from ..sources import paged, publish, readers
from ..sources.derive import BARS, bars, table
from ..sources.normalise import normalised
from ..sources.registry import DATASETS
from .registry import query
from .signals import _CHANNEL, signals

S = Series()

_LANDED = """WITH o AS (SELECT o_custkey // 100 AS g, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderkey, row_number() OVER (PARTITION BY o_custkey // 100 ORDER BY o_orderkey) - 1 AS rn FROM orders),
 p AS (SELECT *, 2 * (rn // 50) + CASE WHEN rn % 50 = 49 THEN 1 ELSE 0 END AS page FROM o)"""


def _landing(spark, sf_dir) -> str:
    """Orders by hundreds of customers, a chain each, landed in pages of 49 records (an array) and of one (an object) by turns.

    The flags are M and, with spaces, F; the last page's is D. Behind it lies one page of an earlier request, which must not be read.
    """
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 100).alias("g"), "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.round("o_totalprice").cast("long").cast("string").alias("price"))
    rn = F.row_number().over(Window.partitionBy("g").orderBy("o_orderkey")) - 1
    o = o.withColumn("rn", rn).withColumn("page", (2 * F.floor(F.col("rn") / 50) + F.when(F.col("rn") % 50 == 49, 1).otherwise(0)).cast("int"))
    record = F.struct(F.col("day").alias("stck_bsop_date"), F.col("price").alias("stck_clpr"), F.when(F.col("o_orderkey") % 11 != 0, F.col("price")).alias("stck_oprc"))
    pages = o.groupBy("g", "page").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", record.alias("r")))).alias("r")).withColumn("r", F.transform("r", lambda x: x["r"]))  # 49 records at most
    pages = pages.withColumn("last", F.lead("page").over(Window.partitionBy("g").orderBy("page")).isNull())
    body = lambda out: F.concat(F.lit('{"rt_cd":"0","output":'), out, F.lit(',"output2":'), F.to_json(F.struct(F.size("r").alias("said"))), F.lit("}"))
    own = body(F.when(F.col("page") % 2 == 1, F.to_json(F.get("r", F.lit(0)))).otherwise(F.to_json("r")))
    flag = F.when(F.col("last"), "D").when(F.col("page") % 2 == 0, "M").otherwise(" F ")
    name = F.concat(F.lit("no="), F.col("g").cast("string")).alias("chain")
    old = body(F.lit('{"stck_bsop_date":"19900101","stck_clpr":"1"}'))
    lines = pages.select(name, "page", paged.answer(F.col("page"), flag, own).alias("line"))
    stale = pages.where("last").select(name, F.col("page") + 1, paged.answer(F.col("page") + 1, F.lit("M"), old))
    path = new_folder(spark, "pages")
    paged.land(lines.union(stale), path)
    return path


@query(_LANDED + """, n AS (SELECT *, row_number() OVER (PARTITION BY g, date ORDER BY rn DESC) AS n FROM p)
 SELECT lpad(CAST(g AS VARCHAR), 6, '0') AS ticker, date, close, open FROM (SELECT g, date, price AS close, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(price AS DOUBLE) END AS open, n FROM n) WHERE n = 1""", "date")
def paged_ingest(spark, sf_dir):
    """Chains of landed pages read, and their records normalised: the chain is the ticker, the last record of a day stays."""
    raw = paged.dataset_records(paged.landed_pages(spark, _landing(spark, sf_dir)), DATASETS["price_daily"], "output")
    out = normalised(raw, DATASETS["price_daily"], F.substring("chain", 4, 20), F.lit("2026-01-01 00:00:00"), "_seq", "pages")
    return out.select("ticker", "date", "close", F.col("open").cast("double").alias("open"))


@query(_LANDED + " SELECT 'no=' || g AS chain, CAST(page AS INTEGER) AS page, count(*) AS n, count(*) AS said FROM p GROUP BY g, page")
def paged_counts(spark, sf_dir):
    """How many records each page has, and how many it says, in an output of its own that is one object."""
    r = paged.landed_pages(spark, _landing(spark, sf_dir))
    said = F.max(F.when(F.col("output") == "output2", F.get_json_object("record", "$.said").cast("long")))
    return r.groupBy("chain", "page").agg(F.count_if(F.col("output") == "output").alias("n"), said.alias("said"))


@query(f"""WITH {BARS} SELECT ticker, date, open, high, low, close, CASE WHEN ticker <> '5-LOW' AND day(date) <> 9 THEN CAST(volume AS DOUBLE) END AS volume, CAST(CASE WHEN ticker <> '5-LOW' THEN 7 ELSE 6 END AS INTEGER) AS n_columns FROM bars""", "date")
def candle_rows(spark, sf_dir):
    """Candles of JSON answers, a ticker's month each: one has no volumes at all, and so no such column; the others lack it on some days."""
    b = bars(spark, sf_dir).withColumn("v", F.when((F.col("ticker") != "5-LOW") & (F.dayofmonth("date") != 9), F.col("volume")))
    candle = F.struct(F.date_format("date", "yyyyMMdd").alias("localDate"), F.col("open").alias("openPrice"), F.col("high").alias("highPrice"), F.col("low").alias("lowPrice"), F.col("close").alias("closePrice"), F.col("v").alias("accumulatedTradingVolume"))
    bodies = b.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.to_json(F.struct(F.collect_list(candle).alias("priceInfos"))).alias("body")).drop("month")
    read = [readers.candles(bodies.where(which), "body") for which in ("ticker != '5-LOW'", "ticker = '5-LOW'")]
    a, z = (df.withColumn("n_columns", F.lit(len(df.columns))) for df in read)
    return a.unionByName(z, allowMissingColumns=True).select("ticker", "date", "open", "high", "low", "close", "volume", "n_columns")


_PUT = """'"close":' || round(close, 2) || ',"dc_high":' || coalesce(CAST(round(dc_high, 2) AS VARCHAR), 'null') || ',"dc_low":' || coalesce(CAST(round(dc_low, 2) AS VARCHAR), 'null') || ',"position":' || position"""


@query(_CHANNEL + f""", ed AS (SELECT ticker, date, position, coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY date), 0) AS b FROM sig),
 la AS (SELECT ticker, max(date) AS on_date, max_by(CASE WHEN position > b THEN 'BUY' ELSE 'SELL' END, date) AS signal FROM ed WHERE position <> b GROUP BY ticker),
 ne AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM sig), lv AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM sig WHERE dc_high IS NOT NULL AND dc_low IS NOT NULL),
 ch AS (SELECT ticker, '[' || string_agg('{{"date":"' || date || '",' || {_PUT} || '}}', ',' ORDER BY date) || ']' AS chart FROM lv WHERE n <= 60 GROUP BY ticker)
 SELECT ne.ticker, '{{"strategy":"channel","as_of_date":"' || date || '",' || {_PUT} || ',"last_signal":' || coalesce('"' || signal || '"', 'null') || ',"last_signal_date":' || coalesce('"' || on_date || '"', 'null') || ',"chart":' || coalesce(chart, '[]') || '}}' AS payload
 FROM ne LEFT JOIN la ON la.ticker = ne.ticker LEFT JOIN ch ON ch.ticker = ne.ticker WHERE n = 1""")
def publish_signal(spark, sf_dir):
    """The payload of each ticker's signal, as JSON text."""
    s = signals(spark, sf_dir)
    return publish.signal_payload(s, state.edges(s, S), "channel")


@query(_CHANNEL + """, m AS (SELECT ticker, date, close, position, CASE WHEN day(date) NOT IN (13, 14) THEN ret END AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM sig),
 g AS (SELECT *, sum(1 - position) OVER (PARTITION BY ticker ORDER BY date) AS g FROM sig), b AS (SELECT ticker, min(date) AS first_date, count(*) AS n_rows FROM g WHERE position = 1 GROUP BY ticker, g),
 t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY first_date DESC) AS n FROM b)
 SELECT ticker, block, date, round(number, 6) AS number, held FROM (SELECT ticker, 'latest' AS block, date, ret AS number, CAST(position AS BIGINT) AS held FROM m WHERE n = 1 UNION ALL SELECT ticker, 'chart', date, ret, position FROM m WHERE n <= 120
  UNION ALL SELECT ticker, 'bands', first_date, NULL, n_rows FROM t WHERE n <= 30)""", "date")
def publish_document(spark, sf_dir):
    """A document of blocks for each ticker, written as text and read back: the newest row, a chart of 120 rows, the newest 30 bands. Infinite and NaN values are null."""
    s = signals(spark, sf_dir)
    odd = F.when(F.dayofmonth("date") == 13, float("inf")).when(F.dayofmonth("date") == 14, float("nan")).otherwise(F.col("ret"))
    rows = s.select("ticker", "date", odd.alias("number"), F.col("position").cast("long").alias("held"))
    bands = state.runs(s, F.col("position") == 1, S).select("ticker", F.col("first_date").alias("date"), F.lit(None).cast("double").alias("number"), F.col("n_rows").alias("held"))
    fields = ["date", "number", "held"]
    blocks = [publish.block(rows, "latest", "ticker", "date", fields, single=True), publish.block(rows, "chart", "ticker", "date", fields, 120), publish.block(bands, "bands", "ticker", "date", fields, 30)]
    path = new_folder(spark, "payload")
    publish.payload(blocks, "ticker", {"strategy": F.lit("channel")}).select(F.to_json(F.struct("ticker", "payload")).alias("value")).write.text(path)
    one = "struct<date: date, number: double, held: bigint>"
    doc = spark.read.schema("ticker string, payload string").json(path).select("ticker", F.from_json("payload", f"latest {one}, chart array<{one}>, bands array<{one}>").alias("d"))
    each = F.array(*[F.struct(F.lit(k).alias("block"), v.alias("rows")) for k, v in (("latest", F.array("d.latest")), ("chart", F.col("d.chart")), ("bands", F.col("d.bands")))])
    out = doc.select("ticker", F.explode(each).alias("b")).select("ticker", "b.block", F.explode("b.rows").alias("r"))
    return out.select("ticker", "block", "r.date", F.round("r.number", 6).alias("number"), "r.held")
