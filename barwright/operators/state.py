"""Stateful row loops as windows: position switches, rally counters, runs, contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Series


def position(df: DataFrame, entry: Column, exit_: Column, live: Column, series: Series = Series(), name: str = "position") -> DataFrame:
    """0 or 1 by entry and exit signals; both on a row switch it over; rows that aren't live show 0 and keep the state.

    A row sets the state (one signal), turns it (both) or leaves it: the state is the last one set, turned as often as
    has been since.
    """
    on, off = F.coalesce(live & entry, F.lit(False)), F.coalesce(live & exit_, F.lit(False))
    out = df.withColumn("_set", F.when(on & ~off, 1).when(off & ~on, 0)).withColumn("_turns", F.sum(F.when(on & off, 1).otherwise(0)).over(series.so_far))
    base = F.coalesce(F.last("_set", ignorenulls=True).over(series.so_far), F.lit(0))
    since = F.coalesce(F.last(F.when(F.col("_set").isNotNull(), F.col("_turns")), ignorenulls=True).over(series.so_far), F.lit(0))
    state = F.pmod(base + F.col("_turns") - since, F.lit(2))
    return out.withColumn(name, F.when(F.coalesce(live, F.lit(False)), state).otherwise(0).cast("int")).drop("_set", "_turns")


def channel_signals(bars: DataFrame, n_entry: int, n_exit: int, series: Series = Series()) -> DataFrame:
    """The breakout signal: yesterday's channel, entries above it, exits below it, and the position."""
    out = bars.withColumn("dc_high", series.over(F.max, "high", -n_entry, -1)).withColumn("dc_low", series.over(F.min, "low", -n_exit, -1))
    out = out.withColumn("long_entry", F.coalesce(F.col("close") > F.col("dc_high"), F.lit(False))).withColumn("long_exit", F.coalesce(F.col("close") < F.col("dc_low"), F.lit(False)))
    return position(out, F.col("long_entry"), F.col("long_exit"), F.col("dc_high").isNotNull(), series)


def edges(df: DataFrame, series: Series = Series()) -> DataFrame:
    """The rows where the position changes: BUY or SELL."""
    before = F.coalesce(F.lag("position").over(series.rows), F.lit(0))
    signal = F.when(F.col("position") > before, "BUY").when(F.col("position") < before, "SELL")
    return df.withColumn("signal", signal).where("signal IS NOT NULL")


def rally(df: DataFrame, correction: Column, low: str = "low", series: Series = Series()) -> DataFrame:
    """Days since the lowest low of a correction: rally_day (1 on each new or equal low, 0 outside) and rally_low."""
    out = df.withColumn("_in", F.coalesce(correction, F.lit(False))).withColumn("_island", F.sum((~F.col("_in")).cast("int")).over(series.so_far))
    keys = [series.key] if isinstance(series.key, str) else series.key
    w = Window.partitionBy(*keys, "_island", "_in").orderBy(series.order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_low", F.min(low).over(so_far)).withColumn("_n", F.row_number().over(w))
    reset = F.coalesce(F.max(F.when(F.col(low) == F.col("_low"), F.col("_n"))).over(so_far), F.lit(1))
    out = out.withColumn("rally_day", F.when(F.col("_in"), F.col("_n") - reset + 1).otherwise(0).cast("long"))
    return out.withColumn("rally_low", F.when(F.col("_in"), F.col("_low"))).withColumnRenamed("_in", "in_correction").drop("_island", "_low", "_n")


def follow_through(bars: DataFrame, gain: float = 2.0, window: tuple[int, int] = (4, 10), drop: float = 0.10, peak_rows: int = 250, least: int = 60, series: Series = Series()) -> DataFrame:
    """Follow-through days: in a correction, a gain on more volume than its mean, within the window of the rally count."""
    out = bars.withColumn("peak", series.over(F.max, "close", -(peak_rows - 1), 0, least))
    out = rally(out, F.col("close") < F.col("peak") * (1 - F.lit(drop)), series=series)
    out = out.withColumn("gain", series.change("close") * 100).withColumn("in_window", F.col("rally_day").between(*window))
    out = out.withColumn("gain_ok", F.coalesce(F.col("gain") >= gain, F.lit(False)))
    enough = F.count("volume").over(series.all) >= 50
    out = out.withColumn("volume_ma50", F.when(enough, series.over(F.avg, "volume", -49, 0))).withColumn("volume_ratio", F.try_divide(F.col("volume"), F.col("volume_ma50")))
    out = out.withColumn("volume_ok", F.coalesce(F.col("volume") > F.col("volume_ma50"), F.lit(False)))
    return out.withColumn("ftd", F.col("in_window") & F.col("gain_ok") & F.col("volume_ok"))


def runs(df: DataFrame, flag: Column, series: Series = Series()) -> DataFrame:
    """The runs of consecutive rows with the flag: key, first_date, last_date, n_rows."""
    out = df.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_run", F.sum((~F.col("_on")).cast("int")).over(series.so_far))
    return out.where("_on").groupBy(series.key, "_run").agg(F.min(series.order).alias("first_date"), F.max(series.order).alias("last_date"), F.count(F.lit(1)).alias("n_rows")).drop("_run")


def longest_run(df: DataFrame, flag: Column, name: str, series: Series = Series()) -> DataFrame:
    """The rows of the longest run of each series, 0 without any."""
    longest = runs(df, flag, series).groupBy(series.key).agg(F.max("n_rows").alias(name))
    return df.select(series.key).distinct().join(longest, series.key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def contributions(df: DataFrame, r: str, paid: Column, series: Series = Series()) -> DataFrame:
    """The value of a plan that pays in before each row's return: V = (V + c)(1 + r), for r above -1."""
    out = df.withColumn("_growth", series.equity(r)).withColumn("_paid", paid)
    unit = F.col("_paid") / F.coalesce(F.lag("_growth").over(series.rows), F.lit(1.0))
    return out.withColumn("_unit", unit).withColumn("value", F.col("_growth") * F.sum("_unit").over(series.so_far)).withColumn("paid_in", F.sum("_paid").over(series.so_far)).drop("_growth", "_paid", "_unit")


def first_of_month(series: Series = Series()) -> Column:
    month = F.date_format(series.order, "yyyy-MM")
    return F.coalesce(month != F.lag(month).over(series.rows), F.lit(True))


def channel_projection(bars: DataFrame, n: int, steps: list[int], series: Series = Series()) -> DataFrame:
    """The channel's top after k more flat days: of each key, for each step."""
    back = Window.partitionBy(series.key).orderBy(F.desc(series.order))
    last = bars.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)
    each = last.select(series.key, "high", "close", "_back", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    top = F.max(F.when(F.col("_back") <= n - F.col("step"), F.col("high")))
    now = F.max(F.when(F.col("_back") == 1, F.col("close")))
    return each.groupBy(series.key, "step").agg(F.when(F.col("step") == 0, top).otherwise(F.greatest(top, now)).alias("projected_high"))
