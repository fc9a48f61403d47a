"""Gates, parsing, ingest and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.rolling import Series
from ..operators import gates as g
from ..operators import xsection
from ..sources import ingest, readers
from ..sources.derive import BARS, FLOWS, PANEL, bars, flows, panel, table
from ..sources.normalise import normalised
from ..session import new_folder
from ..sources.registry import DATASETS
from ..sources.store import PanelStore
from .registry import query, r6
from .signals import _CHANNEL, signals

S = Series()


@query(f"""WITH {BARS}, b AS (SELECT ticker, date, open, CASE WHEN day(date) = 17 THEN open - 1 ELSE high END AS high, low, CASE WHEN day(date) = 3 THEN NULL ELSE close END AS close FROM bars)
 SELECT ticker, count(*) AS n, count(*) - count(DISTINCT date) AS duplicate_dates, count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS null_rows, count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS not_positive,
  count(*) FILTER (WHERE high < greatest(open, close)) AS high_below, count(*) FILTER (WHERE low > least(open, close)) AS low_above, count(*) FILTER (WHERE high < low) AS crossed, false AS valid FROM b GROUP BY ticker""")
def ohlc_validity(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("high", F.when(F.dayofmonth("date") == 17, F.col("open") - 1).otherwise(F.col("high"))).withColumn("close", F.when(F.dayofmonth("date") != 3, F.col("close")))
    return g.ohlc_verdict(b, S)


def _gate_sql(rows: str) -> str:
    """The gate over a table of rows; its segments are of the years 1995 to 1998 and 1999 to 2001."""
    says = [
        ("nk > 0", "null keys"), ("rp > 0", "repeated keys"), ("nn > 0", "null numbers"), ("ng > 0", "negative numbers"), ("np > 0", "rows in trade without price"), ("fa > 0", "flow above turnover"),
    ]
    waits = [("d1 < 24", "too few days in train"), ("d2 < 60", "too few days in holdout"), ("least_names < 5", "too few names on a day")]
    said = ", ".join(f"CASE WHEN {c} THEN '{text}' END" for c, text in (*says, *waits))
    return f"""f AS (SELECT count(*) AS n, count(*) FILTER (WHERE date IS NULL OR ticker IS NULL OR trim(ticker) = '') AS nk, count(*) - (SELECT count(*) FROM (SELECT DISTINCT date, ticker FROM {rows})) AS rp,
   count(*) FILTER (WHERE open IS NULL OR close IS NULL OR volume IS NULL OR trading_value IS NULL OR foreign_net_value IS NULL OR market_cap IS NULL) AS nn, count(*) FILTER (WHERE volume < 0 OR trading_value < 0 OR market_cap < 0) AS ng,
   count(*) FILTER (WHERE is_listed AND is_tradable AND (coalesce(open, 0) <= 0 OR coalesce(close, 0) <= 0 OR coalesce(trading_value, 0) <= 0 OR coalesce(market_cap, 0) <= 0)) AS np,
   count(*) FILTER (WHERE abs(foreign_net_value) > trading_value * 1.001::DOUBLE) AS fa,
   count(DISTINCT CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN date END) AS d1, count(DISTINCT CASE WHEN date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' THEN date END) AS d2 FROM {rows}),
  m AS (SELECT coalesce(min(c), 0) AS least_names FROM (SELECT count(DISTINCT ticker) AS c FROM {rows} WHERE is_listed AND is_tradable AND trading_value > 0 GROUP BY date))
  SELECT n, CASE WHEN {" OR ".join(c for c, _ in says)} THEN 'FAIL' WHEN {" OR ".join(c for c, _ in waits)} THEN 'NOT_READY' ELSE 'PASS' END AS status, concat_ws('; ', {said}) AS reasons,
   'no availability: entry two days after the signal' AS warnings, CAST(2 AS INTEGER) AS execution_lag, least_names FROM f, m"""


_CUTS = [("train", "1995-01-01", "1998-12-31"), ("holdout", "1999-01-01", "2001-12-31")]


@query(f"WITH {PANEL}, " + _gate_sql("pan"))
def panel_gate(spark, sf_dir):
    """Rows out of trade have no price, so that the gate fails by its null numbers."""
    return g.panel_gate(panel(spark, sf_dir), _CUTS, min_days={"train": 24, "holdout": 60}, min_names=5)


@query(f"""WITH {PANEL}, ok AS (SELECT * FROM pan WHERE is_tradable), """ + _gate_sql("ok"))
def panel_gate_clean(spark, sf_dir):
    """The rows in trade alone: only days and names can keep them waiting."""
    return g.panel_gate(panel(spark, sf_dir).where("is_tradable"), _CUTS, min_days={"train": 24, "holdout": 60}, min_names=5)


@query(f"""WITH {PANEL}, bad AS (SELECT date, CASE WHEN CAST(ticker AS BIGINT) % 7 = 3 THEN ' ' ELSE ticker END AS ticker, open, CASE WHEN CAST(ticker AS BIGINT) % 5 = 1 THEN 0 ELSE close END AS close, volume - 3 AS volume, trading_value,
   foreign_net_value * 3 AS foreign_net_value, market_cap, CAST(ticker AS BIGINT) % 2 = 0 AS is_listed, is_tradable FROM pan), """ + _gate_sql("bad"))
def panel_gate_faults(spark, sf_dir):
    """Faults planted by rule: blank tickers, prices of 0, negative volumes, flows above turnover, rows not listed."""
    n = F.col("ticker").cast("long")
    p = panel(spark, sf_dir).withColumns({"close": F.when(n % 5 == 1, 0.0).otherwise(F.col("close")), "volume": F.col("volume") - 3, "foreign_net_value": F.col("foreign_net_value") * 3, "is_listed": n % 2 == 0})
    return g.panel_gate(p.withColumn("ticker", F.when(n % 7 == 3, " ").otherwise(F.col("ticker"))), _CUTS, min_days={"train": 24, "holdout": 60}, min_names=5)


_FAULTY = f"""WITH {FLOWS}, x AS (SELECT ticker, date, p1 AS foreign_net_qty, p2 AS individual_net_qty, p3 AS institution_net_qty, CASE WHEN day(date) = 13 THEN 5 ELSE 0 END - p1 - p2 - p3 AS etc_corp_net_qty, value_cents AS trading_value,
  CASE WHEN day(date) = 7 THEN 2 * value_cents ELSE p1 END AS foreign_net_value, CASE WHEN day(date) = 5 THEN value_cents + 1 ELSE 0 END AS short_qty, value_cents AS volume, greatest(open, close) AS low0, day(date) = 28 AS is_provisional FROM flow)"""
_RULES = {"net_sum": "abs(foreign_net_qty + individual_net_qty + institution_net_qty + etc_corp_net_qty) > 1", "flow_above": "abs(foreign_net_value) > trading_value * 1.001::DOUBLE", "short_above": "short_qty > volume", "crossed": "day(date) = 19", "provisional": "is_provisional"}


@query(_FAULTY + " UNION ALL ".join(f" SELECT 'flows' AS dataset, '{k}' AS rule, count(*) AS n, min(date) AS first_date FROM x WHERE {rule} HAVING count(*) > 0" for k, rule in _RULES.items()), "first_date")
def gated_ingest(spark, sf_dir):
    """Rows with planted faults put into a store: the warnings that come with the write, one for each of the five rules."""
    d, c = F.dayofmonth("date"), F.col
    top = F.greatest("open", "close")
    rows = flows(spark, sf_dir).select(
        "ticker", "date", c("p1").alias("foreign_net_qty"), c("p2").alias("individual_net_qty"), c("p3").alias("institution_net_qty"), (F.when(d == 13, 5).otherwise(0) - c("p1") - c("p2") - c("p3")).alias("etc_corp_net_qty"),
        c("value_cents").alias("trading_value"), F.when(d == 7, 2 * c("value_cents")).otherwise(c("p1")).alias("foreign_net_value"), F.when(d == 5, c("value_cents") + 1).otherwise(0).alias("short_qty"), c("value_cents").alias("volume"),
        F.when(d == 19, top - 1).otherwise(top).alias("high"), top.alias("low"), (d == 28).alias("is_provisional"),
    )
    return ingest.checked_upsert(PanelStore(spark, new_folder(spark, "gated")), "flows", rows, ["trading_value"])[1]


@query(f"""WITH {FLOWS}, r AS (SELECT ticker, date, abs(p1 + p2 + p3 + p4 + p5) > 1 AS net, abs(p1) > value_cents * 1.001::DOUBLE OR abs(p2) > value_cents * 1.001::DOUBLE OR abs(p3) > value_cents * 1.001::DOUBLE AS above FROM flow)
 SELECT ticker, count(*) FILTER (WHERE net) AS net_sum, coalesce(CAST(min(date) FILTER (WHERE net) AS VARCHAR), '') AS net_sum_first, count(*) FILTER (WHERE above) AS flow_above, coalesce(CAST(min(date) FILTER (WHERE above) AS VARCHAR), '') AS flow_above_first FROM r GROUP BY ticker""")
def consistency_checks(spark, sf_dir):
    out = g.consistency(flows(spark, sf_dir), ["p1", "p2", "p3", "p4", "p5"], "value_cents")
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("net_sum_first", "flow_above_first")})


@query(f"""WITH {BARS}, o AS (SELECT ticker, date, close * CASE ticker WHEN '1-URGENT' THEN 1.5 WHEN '2-HIGH' THEN CASE WHEN date < DATE '2001-01-01' THEN 1.1 ELSE 1 END ELSE 1 END AS other FROM bars),
 j AS (SELECT b.ticker, abs(b.close - o.other) / abs(b.close) AS gap, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date DESC) AS n FROM bars b JOIN o USING (ticker, date)),
 a AS (SELECT ticker, count(*) AS compared, count(*) FILTER (WHERE gap > 0.005) AS mismatched, quantile_cont(gap, 0.5) AS m, quantile_cont(gap, 0.5) FILTER (WHERE n <= 60) AS r FROM j GROUP BY ticker)
 SELECT ticker, compared, mismatched, round(m, 6) AS median_gap, round(r, 6) AS recent_gap, CASE WHEN r > 0.02 THEN 'wrong target' WHEN m > 0.02 THEN 'adjusted prices' ELSE 'ok' END AS verdict FROM a""")
def cross_check_close(spark, sf_dir):
    b = bars(spark, sf_dir)
    factor = F.when(F.col("ticker") == "1-URGENT", 1.5).when((F.col("ticker") == "2-HIGH") & (F.col("date") < F.lit("2001-01-01").cast("date")), 1.1).otherwise(1.0)
    out = g.closes_agree(b, b.withColumn("close", F.col("close") * factor), series=S)
    return out.select("ticker", "compared", "mismatched", r6("median_gap").alias("median_gap"), r6("recent_gap").alias("recent_gap"), "verdict")


@query(f"""WITH {BARS}, n AS (SELECT ticker, date, CASE WHEN ticker = '1-URGENT' OR day(date) = 9 AND ticker = '2-HIGH' THEN NULL ELSE volume END AS volume, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM bars), a AS (SELECT ticker, count(*) FILTER (WHERE volume IS NULL) AS holes, max(date) AS ends, count(volume) AS v FROM n WHERE b <= 200 GROUP BY ticker)
 SELECT ticker, holes, ends, CASE WHEN v = 0 THEN 'no volume' WHEN datediff('day', ends, DATE '2001-12-01') > 120 THEN 'history too old' WHEN holes > 0 THEN 'holes in volume' ELSE '' END AS note FROM a""", "ends")
def history_note(spark, sf_dir):
    gone = (F.col("ticker") == "1-URGENT") | ((F.dayofmonth("date") == 9) & (F.col("ticker") == "2-HIGH"))
    return g.continuity(bars(spark, sf_dir).withColumn("volume", F.when(~gone, F.col("volume"))), "2001-12-01", series=S)


# Parsing and ingest

_RAWNUM = """raw AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN ' 1,234.50% ' WHEN 2 THEN 'N/A' WHEN 3 THEN CAST(event_id AS VARCHAR) WHEN 4 THEN '+' || CAST(event_id AS VARCHAR) || ',000' ELSE 'bad' END AS t FROM events)"""


@query(f"""WITH {_RAWNUM}, s AS (SELECT event_id, t, trim(regexp_replace(trim(t), '[,%]', '', 'g')) AS b FROM raw) SELECT event_id, CASE WHEN b NOT IN ('', '-', '--', 'N/A') THEN TRY_CAST(b AS DOUBLE) END AS number FROM s""")
def parse_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    k, text = F.col("event_id") % 6, F.col("event_id").cast("string")
    t = F.when(k == 0, "-").when(k == 1, " 1,234.50% ").when(k == 2, "N/A").when(k == 3, text).when(k == 4, F.concat(F.lit("+"), text, F.lit(",000"))).otherwise("bad")
    return e.select("event_id", scalar.number(t).alias("number"))


@query("""WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '20260231' ELSE strftime(o_orderdate, '%d.%m') END AS t FROM orders)
 SELECT o_orderkey, CASE WHEN regexp_full_match(regexp_replace(t, '[-/]', '', 'g'), '[0-9]{8}') THEN CAST(try_strptime(regexp_replace(t, '[-/]', '', 'g'), '%Y%m%d') AS DATE) END AS day FROM raw""", "day")
def parse_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    shape = lambda f: F.date_format(F.col("o_orderdate"), f)
    t = F.when(k == 0, shape("yyyyMMdd")).when(k == 1, shape("yyyy-MM-dd")).when(k == 2, "20260231").otherwise(shape("dd.MM"))
    return o.select("o_orderkey", scalar.day(t).alias("day"))


@query("""SELECT o_orderkey, strftime(CAST(greatest(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER)) AS TIMESTAMP) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS available FROM orders""")
def availability_stamp(spark, sf_dir):
    """A settlement date up to two days later, out the next day at 9 in Seoul, which is midnight UTC."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    basis = scalar.availability_basis(F.col("date"), F.date_add("date", (F.col("o_orderkey") % 3).cast("int")))
    return o.select("o_orderkey", F.date_format(scalar.available_at(basis, 1, 9), "yyyy-MM-dd HH:mm:ss").alias("available"))


_THIRD = """WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(k AS INTEGER) AS b, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS n FROM orders, range(1, 8) r(k) WHERE isodow(CAST(o_orderdate AS DATE) + CAST(k AS INTEGER)) < 6)
 SELECT o_orderkey, b AS third FROM s WHERE n = 3"""


@query(_THIRD, "third")
def business_days(spark, sf_dir):
    """The third business day after each order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.business_day_after(F.col("o_orderdate").cast("date"), 3).alias("third"))


@query(_THIRD, "third")
def business_days_whole(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.business_day_after(F.col("o_orderdate").cast("date"), 3).alias("third"))


def _ingested(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.round("o_totalprice").cast("long").cast("string")
    raw = o.select(F.col("o_custkey").cast("string").alias("code"), F.date_format("o_orderdate", "yyyyMMdd").alias("stck_bsop_date"), price.alias("stck_clpr"), F.when(F.col("o_orderkey") % 11 != 0, price).alias("stck_oprc"), F.col("o_orderkey").alias("seq"), (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 5 HOURS")).alias("at"))
    return normalised(raw, DATASETS["price_daily"], F.col("code"), F.col("at"), "seq", "orders")


@query("""WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice) AS BIGINT) AS close, o_orderkey, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS n FROM orders)
 SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS ticker, date, close, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(close AS DOUBLE) END AS open, true AS is_provisional FROM r WHERE n = 1""", "date")
def panel_ingest(spark, sf_dir):
    """Normalised, stamped, put into a store and read from it. Collected at 5 UTC of the day and out at 16 in Seoul, 7 UTC: provisional all."""
    store = PanelStore(spark, new_folder(spark, "ingest"))
    store.upsert("price_daily", _ingested(spark, sf_dir))
    return store.read("price_daily", confirmed_only=False).select("ticker", "date", "close", F.col("open").cast("double").alias("open"), "is_provisional")


@query(f"""WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice) AS BIGINT) AS close, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS n FROM orders)
 SELECT CAST(o_custkey AS VARCHAR) AS ticker, date, close, CAST(NULL AS BIGINT) AS high, CAST({len(DATASETS["price_daily"].schema)} AS INTEGER) AS n_columns FROM r WHERE n = 1""", "date")
def store_columns(spark, sf_dir):
    """Rows of a registered dataset with a column that it doesn't have and without most that it has: the table has the dataset's columns."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), F.round("o_totalprice").alias("close"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("note"))
    store = PanelStore(spark, new_folder(spark, "columns"))
    store.upsert("price_daily", rows, ["seq"])
    out = store.read("price_daily")
    return out.select("ticker", "date", "close", "high", F.lit(len(out.columns)).alias("n_columns"))


_LATEST = """WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price, 0 AS w FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 3 = 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, date ORDER BY w DESC, price DESC) AS n FROM r)
 SELECT o_custkey AS ticker, date, price FROM n WHERE n = 1"""


def _two_batches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("w"))
    o = o.withColumn("price", F.col("price") + F.col("w"))
    return [o.where(F.col("w") == w).drop("w") for w in (0, 1)]


@query(_LATEST, "date")
def upsert_latest(spark, sf_dir):
    """Two upserts into a store: the newer rows replace the older ones of the same key whole; the dearest of a key comes last."""
    store = PanelStore(spark, new_folder(spark, "upsert"))
    for rows in _two_batches(spark, sf_dir):
        store.upsert("prices", rows, ["price"])
    return store.read("prices").select(F.col("ticker").cast("long").alias("ticker"), "date", "price")


@query(_LATEST, "date")
def upsert_replayed(spark, sf_dir):
    """The same as batches of a stream that starts again from its first: what the store has is passed over. Parts are small, so that buckets split."""
    store = PanelStore(spark, new_folder(spark, "replayed"), part_rows=200)
    one, two = _two_batches(spark, sf_dir)
    for number, rows in ((0, one), (1, two), (0, one), (1, two)):
        store.upsert("prices", rows, ["price"], ("orders", number))
    return store.read("prices").select(F.col("ticker").cast("long").alias("ticker"), "date", "price")


@query(f"""WITH {BARS} SELECT 'bars' AS dataset, ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars WHERE ticker <> '5-LOW' GROUP BY ticker""", "first_date last_date")
def store_coverage(spark, sf_dir):
    """What a store holds, by dataset and ticker, after one ticker's rows are deleted; a dataset that isn't there adds nothing."""
    store = PanelStore(spark, new_folder(spark, "coverage"))
    store.upsert("bars", bars(spark, sf_dir))
    store.delete("bars", ["5-LOW"])
    out = store.coverage("missing").withColumn("dataset", F.lit("missing"))
    for name in store.tables():
        out = out.unionByName(store.coverage(name).withColumn("dataset", F.lit(name)))
    return out


@query(f"""WITH {BARS} SELECT ticker, date, close FROM bars WHERE ticker IN ('1-URGENT', '5-LOW') AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND day(date) <> 20""", "date")
def panel_read(spark, sf_dir):
    """Some tickers and days of a store, without provisional rows."""
    store = PanelStore(spark, new_folder(spark, "read"))
    store.upsert("bars", bars(spark, sf_dir).withColumn("is_provisional", F.dayofmonth("date") == 20))
    return store.read("bars", ["1-URGENT", "5-LOW"], "1996-01-01", "1999-12-31").select("ticker", "date", "close")


def _u(name):
    return f"('0x' || substr(sha256(ticker || '|' || strftime(date, '%Y%m%d') || '|{name}'), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


@query(f"""WITH d AS (SELECT ticker, CAST(date AS DATE) AS date FROM (SELECT unnest(['005930', '000660']) AS ticker), range(DATE '2024-01-01', DATE '2024-07-01', INTERVAL 1 DAY) r(date) WHERE isodow(date) < 6),
 b AS (SELECT *, 60000 + CAST(round_even({_u('base')} * 20000, 0) AS BIGINT) AS base FROM d), x AS (SELECT ticker, date, base - CAST(round_even({_u('low')} * 1500, 0) AS BIGINT) AS low, base + CAST(round_even({_u('high')} * 1500, 0) AS BIGINT) AS high FROM b),
 y AS (SELECT *, low + CAST(round_even((high - low) * {_u('open')}, 0) AS BIGINT) AS open, low + CAST(round_even((high - low) * {_u('close')}, 0) AS BIGINT) AS close, 2000000 + CAST(round_even({_u('vol')} * 8000000, 0) AS BIGINT) AS volume FROM x)
 SELECT ticker, date, low, high, open, close, volume, volume * close AS trading_value FROM y""", "date")
def mock_source(spark, sf_dir):
    return readers.synthetic(spark, ["005930", "000660"], "2024-01-01", "2024-06-30")


@query("""SELECT CAST(1 AS INTEGER) AS page, '2026.07.31' AS day, 262500.0::DOUBLE AS close, 26.81::DOUBLE AS change_pct, 58478873.0::DOUBLE AS volume, CAST(9 AS INTEGER) AS n_cells""")
def html_rows(spark, sf_dir):
    """Rows of a page of a public shape; a second page holds no such row."""
    cells = ["2026.07.31", "262,500", "up 55,500", "+26.81%", "58,478,873", "+3,618,959", "<span>+8,359,011</span>", "2,730,295,646", "46.70%"]
    page = "<table><tr><th>day</th></tr><tr>" + "".join(f"<td class='n'> {c}\n</td>" for c in cells) + "</tr><tr><td colspan=9>&nbsp;</td></tr></table>"
    p = spark.createDataFrame([(1, page), (2, "<table><tr><td>2026.07.31</td><td>1</td></tr></table>")], "page int, html string")
    c = readers.html_rows(p, "html")
    n = lambda i: scalar.number(F.get("cells", F.lit(i)))
    return c.select("page", F.get("cells", F.lit(0)).alias("day"), n(1).alias("close"), n(3).alias("change_pct"), n(4).alias("volume"), F.size("cells").alias("n_cells"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"items": ['), "props", F.lit("]}")).alias("body"))
    return readers.json_list(e, "body", "$.items", {"k": "long"}, "k")


@query(f"""WITH {BARS}, m AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY ticker), c AS (SELECT ticker, a, b, a + CAST(k * 100 AS INTEGER) AS first FROM m, range(0, 100) r(k) WHERE a + CAST(k * 100 AS INTEGER) <= b),
 f AS (SELECT c.ticker, c.first, least(c.first + 99, b) AS last, (SELECT min(date) FROM bars x WHERE x.ticker = c.ticker AND x.date BETWEEN c.first AND c.first + 99) AS oldest FROM c) SELECT ticker, first, last, coalesce(oldest > first + 7, true) AS truncated FROM f""", "first last")
def range_chunks(spark, sf_dir):
    """The chunks of each ticker's range, and whether a chunk's oldest row comes more than a week after its start."""
    b = bars(spark, sf_dir).select("ticker", "date")
    m = b.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    c = m.select("ticker", "a", F.explode(readers.chunks(F.col("a"), F.col("b"), 100)).alias("c")).select("ticker", F.col("c.first").alias("first"), F.col("c.last").alias("last"), F.floor(F.datediff("c.first", "a") / 100).alias("k"))
    held = b.join(m, "ticker").groupBy("ticker", F.floor(F.datediff("date", "a") / 100).alias("k")).agg(F.min("date").alias("oldest"))
    out = c.join(held, ["ticker", "k"], "left")
    return out.select("ticker", "first", "last", F.coalesce(F.col("oldest") > F.date_add("first", 7), F.lit(True)).alias("truncated"))


# Publishing


@query(_CHANNEL + """, n AS (SELECT ticker, date, close, position, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM sig)
 SELECT ticker, '[' || string_agg('{"date":"' || date || '","position":' || position || '}', ',' ORDER BY date) || ']' AS payload FROM n WHERE b <= 12 GROUP BY ticker""")
def publish_payload(spark, sf_dir):
    """The newest rows of each ticker as a JSON array, oldest first."""
    last = xsection.newest(signals(spark, sf_dir), 12, ["ticker"], "date")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("date", "position"))), lambda x: F.struct(x["date"].cast("string").alias("date"), x["position"].alias("position")))
    return last.groupBy("ticker").agg(F.to_json(rows).alias("payload"))


@query("""SELECT c_custkey, regexp_replace(regexp_replace('token=abc' || c_custkey || '&name=' || c_name, '(?i)(token|key|secret)=[^&\\s]+', '\\1=***', 'g'), '\\d{6,}', '***', 'g') AS said FROM customer""")
def redaction(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", scalar.redacted(F.concat(F.lit("token=abc"), F.col("c_custkey").cast("string"), F.lit("&name="), F.col("c_name"))).alias("said"))
