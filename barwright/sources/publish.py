"""Rows as JSON to publish: a record of a row, a payload of blocks for each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import scalar
from ..functions.params import at_least
from ..operators.xsection import newest

#: Absent values are said, so that records of a block have the same fields.
SAID = {"ignoreNullFields": "false"}


def clean(df: DataFrame) -> DataFrame:
    """Infinite and NaN values become null: JSON has neither."""
    return df.withColumns({f.name: scalar.finite(F.col(f.name)) for f in df.schema if isinstance(f.dataType, DoubleType | FloatType)})


def as_json(*fields: Column | str) -> Column:
    """The fields as one JSON object, dates as ISO text."""
    return F.to_json(F.struct(*fields), SAID)


def block(rows: DataFrame, name: str, key: str, order: str, fields: list[str], n: int | None = None, single: bool = False) -> DataFrame:
    """A block of a payload: each key's rows as an array of records in order, the newest n where given; or its newest row alone."""
    if n is not None:
        at_least(n, 1, "rows of a block")
    own = newest(rows, 1 if single else n, [key], order) if single or n is not None else rows
    own = clean(own.select(key, F.col(order).alias("_order"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(fields)]))
    own = own.select(key, F.struct("_order", F.struct(*[F.col(f"_f{i}").alias(c) for i, c in enumerate(fields)]).alias("_v")).alias("_r"))
    listed = F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["_v"])
    return own.groupBy(key).agg((F.get(listed, F.lit(0)) if single else listed).alias(name))


def payload(blocks: list[DataFrame], key: str, head: dict[str, Column] | None = None) -> DataFrame:
    """One JSON document a key, of the head's fields and all blocks; a block that a key lacks is null."""
    names = [c for b in blocks for c in b.columns if c != key]
    joined = reduce(lambda a, b: a.join(b, key, "full"), blocks)
    return joined.select(key, as_json(*[v.alias(k) for k, v in (head or {}).items()], *names).alias("payload"))


def signal_payload(rows: DataFrame, edges: DataFrame, strategy: str, key: str = "ticker", n: int = 60) -> DataFrame:
    """Of each key: its newest row (date, close, dc_high, dc_low, position), its last signal, and a chart of the newest n rows with both channels."""
    live = rows.where(F.col("dc_high").isNotNull() & F.col("dc_low").isNotNull())
    to2 = lambda c: F.round(c, 2).alias(c)
    day = F.col("date").cast("string")
    last = newest(rows, 1, [key], "date").select(key, day.alias("as_of_date"), to2("close"), to2("dc_high"), to2("dc_low"), "position")
    said = newest(edges, 1, [key], "date").select(key, F.col("signal").alias("last_signal"), day.alias("last_signal_date"))
    chart = block(live.select(key, day.alias("date"), to2("close"), to2("dc_high"), to2("dc_low"), "position"), "chart", key, "date", ["date", "close", "dc_high", "dc_low", "position"], n)
    out = clean(last).join(said, key, "left").join(chart, key, "left")
    fields = ["as_of_date", "close", "dc_high", "dc_low", "position", "last_signal", "last_signal_date"]
    none = F.from_json(F.lit("[]"), chart.schema["chart"].dataType)
    return out.select(key, as_json(F.lit(strategy).alias("strategy"), *fields, F.coalesce("chart", none).alias("chart")).alias("payload"))
