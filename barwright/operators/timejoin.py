"""Joins along time: as-of, calendar shifts, next events, merges of two histories, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Series


def as_of(left: DataFrame, right: DataFrame, value: str, skip_nulls: bool = True, series: Series = Series()) -> DataFrame:
    """Each left row with the right value of the same key last known at its date.

    The rows of both are put in one order and the last value is carried on: n log n, one exchange, no range join. With
    skip_nulls the last value that isn't null counts, else the last row even where its value is null.
    """
    key, order = series.key, series.order
    l = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("_side"))
    r = right.select(key, order, value, F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.when((F.col("_side") == 0) & (F.col(value).isNotNull() if skip_nulls else F.lit(True)), F.struct(F.col(value).alias("v")))
    both = l.unionByName(r, allowMissingColumns=True)
    return both.withColumn(value, F.last(held, ignorenulls=True).over(w)["v"]).where("_side = 1").drop("_side")


def calendar(rows: DataFrame, order: str = "date") -> DataFrame:
    """The distinct dates with their positions from 0. A row a date: the window over it is small."""
    return rows.select(order).where(F.col(order).isNotNull()).distinct().withColumn("pos", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))


def shifted(rows: DataFrame, days: DataFrame, column: str, by: int, name: str) -> DataFrame:
    """The date `by` calendar positions after a column's; null past the end. The calendar is a row a date, so it is broadcast."""
    ahead = days.select("date", "pos").withColumn("_to", F.col("pos") + by)
    moved = ahead.join(days.select(F.col("pos").alias("_to"), F.col("date").alias(name)), "_to", "left").select(F.col("date").alias(column), name)
    return rows.join(F.broadcast(moved), column, "left")


def next_event(rows: DataFrame, event: Column, taken: list[str], name: str, series: Series = Series()) -> DataFrame:
    """The columns of the first strictly later row of the key where the event holds, as a struct."""
    later = series.rows.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(F.when(event, F.struct(*taken)), ignorenulls=True).over(later))


def precedence_merge(older: DataFrame, newer: DataFrame, drop: list[str], series: Series = Series()) -> DataFrame:
    """The newer history whole, and of the older one what comes before it; columns in `drop` are null in the older part."""
    first = newer.groupBy(series.key).agg(F.min(series.order).alias("_first"))
    before = older.join(first, series.key, "left").where(F.col("_first").isNull() | (F.col(series.order) < F.col("_first"))).drop("_first", *drop)
    return before.unionByName(newer, allowMissingColumns=True)


def reconciled(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 0.001, series: Series = Series()) -> DataFrame:
    """The rows of both histories (key and date) with whether any column differs by more than the tolerance."""
    on = [series.key, series.order]
    both = a.select(*on, *[F.col(c).alias(f"_a_{c}") for c in columns]).join(b.select(*on, *[F.col(c).alias(f"_b_{c}") for c in columns]), on)
    apart = F.greatest(*[F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) for c in columns], F.lit(0.0))
    return both.select(*on, (apart > tolerance).alias("differs"), apart.alias("largest_gap"))


def aligned(parts: list[tuple[str, DataFrame]], value: str, fill, order: str = "date") -> DataFrame:
    """Several series on the union of their dates, one column each, missing values filled."""
    out = None
    for name, df in parts:
        part = df.select(order, F.col(value).alias(name))
        out = part if out is None else out.join(part, order, "full_outer")
    return out.select(order, *[F.coalesce(F.col(name), F.lit(fill)).alias(name) for name, _ in parts])
