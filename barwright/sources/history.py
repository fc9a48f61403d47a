"""Histories of bars as CSV files: read with checks, merged, refreshed and written whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.params import at_least, has_columns
from ..functions.rolling import Series
from ..operators.gates import require_valid
from ..operators.xsection import last_of_key

COLUMNS = {"ticker": "string", "date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "long"}
#: Header names that mean one of the columns, after lower case and underscores.
SYNONYMS = {"symbol": "ticker", "code": "ticker", "day": "date", "adj_close": "close", "last": "close", "vol": "volume"}
#: Rows that a verified history, and its overlap with the old one, must have before they are merged.
LEAST_ROWS = 60
MARK = "﻿"


def plain_names(df: DataFrame) -> DataFrame:
    """Header names in lower case, spaces as underscores, known synonyms as the column that they mean; a byte order mark goes."""
    names = [c.lstrip(MARK).strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[SYNONYMS.get(c, c) for c in names])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The typed rows of a history, which must be valid bars; an empty table where there is no file."""
    try:
        raw = plain_names(spark.read.option("header", True).csv(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))
    has_columns(raw.columns, list(COLUMNS))
    return require_valid(raw.select(*[F.col(c).cast(k) for c, k in COLUMNS.items()]))


def write_history(bars: DataFrame, path: str, marked: bool = True) -> None:
    """CSV of a row a key, the last given: prices to two places, in order, lines ended by LF, after a byte order mark.

    Files are ranges of ticker and date, in order by name: one where the rows are few, more as they outgrow a partition.
    """
    rows = last_of_key(bars.withColumn("_row", F.monotonically_increasing_id()), ["ticker", "date"], ["_row"])
    price = {"open", "high", "low", "close"}
    out = rows.select(*[(F.col(c).cast("decimal(18,2)") if c in price else F.col(c)).alias(c) for c in COLUMNS]).repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date")
    out.withColumnRenamed("ticker", MARK + "ticker" if marked else "ticker").write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def mergeable(history: DataFrame, verified: DataFrame, least: int = LEAST_ROWS) -> tuple[int, int]:
    """Rows of the verified history and of its overlap with the old one; too few of either raise."""
    rows = verified.count()
    overlap = verified.join(history, ["ticker", "date"], "left_semi").count()
    at_least(rows, least, "verified rows")
    at_least(overlap, least, "overlapping rows")
    return rows, overlap


def resume_dates(history: DataFrame, days: int = 5) -> DataFrame:
    """Where fetching goes on for each ticker: some days before its last row."""
    return history.groupBy("ticker").agg(F.date_sub(F.max("date"), days).alias("resume"))


def refreshed(history: DataFrame, fetched: DataFrame, days: int = 5, verified: DataFrame | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """The history with the fetched rows from the resume date on, without provisional ones; a fetched row replaces an old one.

    With a verified history of the same bars, the two are merged only if it and its overlap with the old one have enough rows (mergeable).
    """
    if verified is not None:
        mergeable(history, verified, least)
    known = fetched.join(resume_dates(history, days), "ticker", "left").where(F.col("resume").isNull() | (F.col("date") >= F.col("resume")))
    known = known.where(~F.coalesce(F.col("is_provisional"), F.lit(False)))
    both = history.select(*COLUMNS).withColumn("_new", F.lit(0)).union(known.select(*COLUMNS).withColumn("_new", F.lit(1)))
    return last_of_key(both, ["ticker", "date"], ["_new"]).drop("_new")


def buffered(bars: DataFrame, start: str, days: int = 60, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """The rows from some days before the start on, so that windows are full when it comes; clip() takes them off again. Rates have one column of values."""
    has_columns(bars.columns, ["ticker", "date", *columns])
    return bars.where(F.col("date") >= F.date_sub(F.lit(start).cast("date"), days))


def clip(rows: DataFrame, start: str, end: str | None = None, series: Series = Series()) -> DataFrame:
    out = rows.where(F.col(series.order) >= F.lit(start).cast("date"))
    return out.where(F.col(series.order) <= F.lit(end).cast("date")) if end else out
