"""Readers of text sources: panel CSV files, HTML rows, nested JSON lists, JSON candles, synthetic rows, range chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.params import has_columns
from ..functions.rolling import Series
from ..operators.gates import ohlc_verdict

REQUIRED = ["date", "ticker", "open", "close", "volume", "trading_value", "foreign_net_value", "market_cap", "is_listed", "is_tradable"]


def panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """A panel from CSV text, in order of date and ticker: codes padded, numbers with bad texts null (separators too), UTC stamps.

    The stamps are of data_available_at, or of asof where there is no such column. A missing required column raises, and so
    does a flag that is null or unknown; the error lists five of them.
    """
    raw = spark.read.option("header", True).csv(path)
    has_columns(raw.columns, REQUIRED)
    for c in ("is_listed", "is_tradable"):
        odd = raw.where(scalar.truth(F.col(c)).isNull()).select(c).distinct().orderBy(c).limit(5).collect()
        if odd:
            raise ValueError(f"{c} has unknown values: {[r[0] for r in odd]}")
    kinds = {"date": lambda c: scalar.day(F.col(c)), "ticker": lambda c: scalar.padded(F.trim(c)), "is_listed": lambda c: scalar.truth(F.col(c)), "is_tradable": lambda c: scalar.truth(F.col(c))}
    kinds |= dict.fromkeys(("open", "close", "volume", "trading_value", "foreign_net_value", "market_cap"), lambda c: F.trim(c).try_cast("double"))
    columns = [(kinds[c](c) if c in kinds else F.col(c)).alias(c) for c in raw.columns if c not in ("data_available_at", "asof")]
    stamp = next((c for c in ("data_available_at", "asof") if c in raw.columns), None)
    return raw.select(*columns, *([F.try_to_timestamp(F.col(stamp)).alias("data_available_at")] if stamp else [])).orderBy("date", "ticker")


def html_rows(pages: DataFrame, html: str, least: int = 9, first: str = r"^\d{4}\.\d{2}\.\d{2}$") -> DataFrame:
    """The cells of table rows with at least `least` cells whose first one fits; tags go, white space is one space."""
    rows = pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_tr"))
    plain = lambda c: scalar.one_space(F.regexp_replace(c, r"(?s)<[^>]*>", " "))
    cells = F.transform(F.regexp_extract_all("_tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), plain)
    return rows.withColumn("cells", cells).where((F.size("cells") >= least) & F.get("cells", F.lit(0)).rlike(first)).drop("_tr", html)


def json_list(bodies: DataFrame, body: str, path: str, fields: dict[str, str], key: str) -> DataFrame:
    """Objects of a nested list, each field parsed as long, double, date or text; rows without the key go."""
    from .normalise import parsed

    kind = ", ".join(f"`{f}`: string" for f in fields)
    items = F.from_json(F.get_json_object(body, path), f"array<struct<{kind}>>")
    out = bodies.select(*[c for c in bodies.columns if c != body], F.explode(items).alias("_r"))
    return out.select(*[c for c in out.columns if c != "_r"], *[parsed(F.col("_r")[f], k).alias(f) for f, k in fields.items()]).where(F.col(key).isNotNull())


#: The provider's names of a candle's fields.
CANDLE = {"localDate": ("date", "date"), "openPrice": ("open", "double"), "highPrice": ("high", "double"), "lowPrice": ("low", "double"), "closePrice": ("close", "double"), "accumulatedTradingVolume": ("volume", "double")}


def candles(bodies: DataFrame, body: str, key: str = "ticker") -> DataFrame:
    """Daily candles of JSON answers, checked; without the column of volumes where no candle of any answer has one.

    No candle at all, or candles that aren't valid bars of their key, raise.
    """
    out = json_list(bodies, body, "$.priceInfos", {f: kind for f, (_, kind) in CANDLE.items()}, "localDate")
    out = out.withColumnsRenamed({f: c for f, (c, _) in CANDLE.items()})
    found = ohlc_verdict(out, Series(key), F.count("volume").alias("volumes"))
    seen = found.agg(F.count_if(~F.col("valid")).alias("invalid"), F.sum("volumes").alias("volumes"), F.min_by(key, "valid").alias("first")).first()  # one row
    if seen.volumes is None:
        raise ValueError("no candles")
    if seen.invalid:
        raise ValueError(f"{seen.invalid} series of candles are invalid, {seen.first} among them")
    return out if seen.volumes else out.drop("volume")


def synthetic(spark: SparkSession, tickers: list[str], start: str, end: str) -> DataFrame:
    """Bars on Monday-to-Friday days made of hashes: the same for the same ticker and day wherever they are made."""
    days = spark.createDataFrame([(t,) for t in tickers], "ticker string").select("ticker", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    u = lambda name: scalar.unit_interval(F.col("ticker"), F.date_format("date", "yyyyMMdd"), F.lit(name))
    base = 60000 + scalar.whole(u("base") * 20000)
    out = days.withColumn("low", base - scalar.whole(u("low") * 1500)).withColumn("high", base + scalar.whole(u("high") * 1500))
    inside = lambda name: F.col("low") + scalar.whole((F.col("high") - F.col("low")) * u(name))
    out = out.withColumn("open", inside("open")).withColumn("close", inside("close")).withColumn("volume", 2_000_000 + scalar.whole(u("vol") * 8_000_000))
    return out.withColumn("trading_value", F.col("volume") * F.col("close"))


def chunks(start: Column, end: Column, days: int) -> Column:
    """The forward chunks of a date range: structs of first and last."""
    firsts = F.sequence(start, end, F.make_dt_interval(F.lit(days)))
    return F.transform(firsts, lambda d: F.struct(d.cast("date").alias("first"), F.least(F.date_add(d.cast("date"), days - 1), end).alias("last")))


def closed_candles(live: DataFrame, confirmed: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Live candles (ticker, date, prices) that a second source says are closed, with prices that agree; others go."""
    prices = ["open", "high", "low", "close"]
    c = confirmed.where("status = 'CLOSE'").select("ticker", "date", *[F.col(p).alias(f"_{p}") for p in prices])
    apart = F.greatest(*[F.abs(F.col(p) - F.col(f"_{p}")) for p in prices])
    return live.join(c, ["ticker", "date"]).where(apart <= tolerance).drop(*[f"_{p}" for p in prices])
