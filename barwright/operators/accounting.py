"""Returns, costs and performance of weights over return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import at_least
from ..functions.rolling import Series
from .state import runs
from .stats import profit_factor, tail_mean


def future_return(h: int, series: Series = Series()) -> Column:
    """From the next open to the close h rows ahead."""
    at_least(h, 1, "horizon")
    return F.try_divide(F.lead("close", h).over(series.rows), F.nullif(F.lead("open", 1).over(series.rows), F.lit(0))) - 1


def open_to_open(series: Series = Series()) -> Column:
    """From this open to the next, in percent."""
    return (F.try_divide(F.lead("open").over(series.rows), F.nullif(F.col("open"), F.lit(0))) - 1) * 100


def next_day_intraday(signal: Column, cost: float, series: Series = Series()) -> Column:
    """Open to close on the row after a signal, less the cost; 0 without."""
    held = F.lag(signal, 1, False).over(series.rows)
    return F.when(held, F.col("close") / F.col("open") - 1 - cost).otherwise(F.lit(0.0))


def net_of_turnover(weight: str, r: str, bps: float | Column, series: Series = Series()) -> Column:
    """Percent return of a weight less half the round-trip cost of each change; the first row pays for its weight.

    A null return nullifies its row, the cost included.
    """
    turn = F.abs(F.col(weight) - F.coalesce(F.lag(weight).over(series.rows), F.lit(0.0)))
    return F.col(weight) * F.col(r) - turn * (bps / 2) / 100


def net_of_switches(position: str, r: str, fee: float | Column, series: Series = Series()) -> Column:
    """The return held, less a fee where the position changes; the first row pays none."""
    return F.col(position) * F.col(r) - F.when(F.abs(F.col(position) - F.lag(position).over(series.rows)) > 0, fee).otherwise(0.0)


def summary(df: DataFrame, net: str, weight: str, series: Series = Series(), days: float = 252.0) -> DataFrame:
    """One row a series: n, total, annual, mdd, longest_underwater, cvar5, losing_share, sharpe, exposure, trades.

    `net` is in percent and null counts as 0; `days` rows make a year.
    """
    clean = df.withColumn("_r", F.coalesce(F.col(net), F.lit(0.0)) / 100).withColumn("_equity", series.equity("_r"))
    clean = clean.withColumn("_down", series.drawdown("_equity")).withColumn("_entry", (F.col(weight) - F.lag(weight).over(series.rows) == 1).cast("int"))
    clean = clean.withColumn("_pct", F.col("_r") * 100)
    deviation = F.stddev_samp("_r")
    rows = clean.groupBy(series.key).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max_by("_equity", series.order) - 1) * 100).alias("total"),
        ((F.pow(F.max_by("_equity", series.order), F.lit(days) / F.count(F.lit(1))) - 1) * 100).alias("annual"),
        (F.min("_down") * 100).alias("mdd"),
        F.avg((F.col("_r") < 0).cast("int")).alias("losing_share"),
        (F.try_divide(F.avg("_r"), F.nullif(deviation, F.lit(0.0))) * F.sqrt(F.lit(days))).alias("sharpe"),
        F.avg(weight).alias("exposure"),
        F.coalesce(F.sum("_entry"), F.lit(0)).cast("long").alias("trades"),
    )
    under = runs(clean, F.col("_down") < -1e-12, series).groupBy(series.key).agg(F.max("n_rows").alias("longest_underwater"))
    tail = tail_mean(clean, "_pct", [series.key], name="cvar5")
    out = rows.join(under, series.key, "left").join(tail, series.key, "left")
    return out.withColumn("longest_underwater", F.coalesce("longest_underwater", F.lit(0)).cast("long"))


def risk(df: DataFrame, r: str, series: Series = Series()) -> DataFrame:
    """total, mdd (a loss on the first row counts), win_rate, profit_factor, losing_streak of each series of returns."""
    own = df.where(F.col(r).isNotNull()).withColumn("_equity", series.equity(r)).withColumn("_down", F.least(F.lit(0.0), series.drawdown("_equity", start_at_one=True)))
    rows = own.groupBy(series.key).agg((F.max_by("_equity", series.order) - 1).alias("total"), F.min("_down").alias("mdd"), F.avg((F.col(r) > 0).cast("int")).alias("win_rate"), profit_factor(F.col(r)).alias("profit_factor"))
    streak = runs(own, F.col(r) < 0, series).groupBy(series.key).agg(F.max("n_rows").alias("losing_streak"))
    return rows.join(streak, series.key, "left").withColumn("losing_streak", F.coalesce("losing_streak", F.lit(0)).cast("long"))


def spreads(trades: DataFrame, horizon: int, bps: float) -> DataFrame:
    """Equal-weighted top against bottom for each entry date (entry_date, bucket, gross_return), every horizon-th date.

    Dates without a top or a bottom go before the sampling. One leg's cost is charged to top_net, two to spread_net.
    """
    leg = at_least(bps, 0, "cost") / 10_000
    at_least(horizon, 1, "horizon")
    mean = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("gross_return")))
    out = trades.groupBy("entry_date").agg(mean("top").alias("top"), mean("bottom").alias("bottom"), F.avg("gross_return").alias("universe")).dropna(subset=["top", "bottom"])
    if horizon > 1:  # a row a date
        out = out.withColumn("_n", F.row_number().over(Window.orderBy("entry_date"))).where((F.col("_n") - 1) % horizon == 0).drop("_n")
    return out.select(
        "entry_date", "top", "bottom", "universe", (F.col("top") - leg).alias("top_net"), (F.col("universe") - leg).alias("universe_net"),
        (F.col("top") - F.col("universe")).alias("top_excess"), (F.col("top") - F.col("bottom") - 2 * leg).alias("spread_net"),
    )


def gated(weight: Column, gates: list[str], risky: float, threshold: int | None = None) -> Column:
    """The weight times `risky` where enough gates are up: `threshold`, or two of two and more."""
    up = sum((F.col(g).cast("int") for g in gates), F.lit(0))
    return F.when(up >= (min(2, len(gates)) if threshold is None else threshold), weight * risky).otherwise(weight)
