"""One series' signal (the index's) followed on another: from open to next open, by strategies, with contributions and by years.

Rows are of both series on the days that both have: the key, date, index_open, index_position, open, position. A day's
position is held from the next day's open to the one after; the last row has no next open and earns nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import at_least
from ..functions.rolling import Series
from .accounting import net_of_turnover, open_to_open, summary
from .state import contributions, first_of_month

#: Strategies: whose return is earned, and by whose position (None: always).
STRATEGIES = {"index_hold": ("index", None), "index_by_index": ("index", "index"), "own_hold": ("own", None), "own_by_index": ("own", "index"), "own_by_own": ("own", "own")}


def moves(pairs: DataFrame, series: Series = Series()) -> DataFrame:
    """key, order, index_r and own_r (percent, null on the last row), index_w and own_w (yesterday's position, 0 without a return)."""
    other = pairs.select(series.key, series.order, F.col("index_open").alias("open"), F.col("index_position").alias("position"), F.col("open").alias("_o"), F.col("position").alias("_p"))
    held = lambda c: F.coalesce(F.lag(c).over(series.rows), F.lit(0)).cast("double")
    both = other.select(series.key, series.order, "_o", open_to_open(series).alias("index_r"), held("position").alias("_wi"), held("_p").alias("_wo"))
    both = both.withColumnRenamed("_o", "open").withColumn("own_r", open_to_open(series))
    usable = F.col("index_r").isNotNull() & F.col("own_r").isNotNull()
    weight = lambda c: F.when(usable, F.col(c)).otherwise(0.0)
    return both.select(series.key, series.order, "index_r", "own_r", weight("_wi").alias("index_w"), weight("_wo").alias("own_w"))


def _net(moved: DataFrame, runs: list[tuple[str, float]], group: Column | None, series: Series) -> tuple[DataFrame, Series]:
    """Each run's (strategy, cost) rows with weight and net, restarted in each group where one is given; and their series `_leg`."""
    for _, cost in runs:
        at_least(cost, 0, "cost")
    case = lambda k, c: F.struct(F.lit(k).alias("strategy"), F.lit(float(c)).alias("cost"), F.col(f"{STRATEGIES[k][0]}_r").alias("r"), (F.col(f"{STRATEGIES[k][1]}_w") if STRATEGIES[k][1] else F.lit(1.0)).alias("weight"))
    own = moved.withColumn("group", F.lit(0) if group is None else group)
    own = own.select(series.key, series.order, "group", F.explode(F.array(*[case(k, c) for k, c in runs])).alias("_s")).select(series.key, series.order, "group", "_s.*")
    own = own.withColumn("_leg", F.struct(series.key, "group", "strategy", "cost"))
    each = Series("_leg", series.order)
    return own.withColumn("net", net_of_turnover("weight", "r", F.col("cost"), each)), each


def summaries(pairs: DataFrame, runs: list[tuple[str, float]], series: Series = Series()) -> DataFrame:
    """accounting.summary of each (strategy, cost in basis points a round trip), with `switches`: how often the weight changes."""
    own, each = _net(moves(pairs, series), runs, None, series)
    own = own.withColumn("_turned", F.abs(F.col("weight") - F.lag("weight").over(each.rows)) > 1e-9)
    switches = own.groupBy("_leg").agg(F.count_if("_turned").alias("switches"))
    return summary(own, "net", "weight", each).join(switches, "_leg").select("_leg.*", "*").drop("_leg", "group")


def contributed(pairs: DataFrame, runs: list[tuple[str, float]], amount: float, series: Series = Series()) -> DataFrame:
    """The same amount paid in on each month's first row: paid_in, value, gain, deepest loss of what was paid, mdd of the value (percent)."""
    at_least(amount, 0, "amount")
    own, each = _net(moves(pairs, series), runs, None, series)
    own = own.withColumn("_r", F.coalesce("net", F.lit(0.0)) / 100)
    plan = contributions(own, "_r", F.when(first_of_month(each), float(amount)).otherwise(0.0), each)
    plan = plan.withColumn("_down", each.drawdown("value")).withColumn("_short", F.try_divide(F.col("paid_in") - F.col("value"), F.col("paid_in")))
    out = plan.groupBy("_leg").agg(F.max_by("paid_in", series.order).alias("paid_in"), F.max_by("value", series.order).alias("value"), (F.max("_short") * 100).alias("deepest_loss"), (F.min("_down") * 100).alias("value_mdd"))
    return out.withColumn("gain", (F.try_divide(F.col("value"), F.col("paid_in")) - 1) * 100).select("_leg.*", "*").drop("_leg", "group")


def by_year(pairs: DataFrame, runs: list[tuple[str, float]], least: int = 40, series: Series = Series()) -> DataFrame:
    """days, total and mdd (percent) of each run in each year with enough rows; a year begins anew and pays for its first weight."""
    own, each = _net(moves(pairs, series), runs, F.year(series.order), series)
    own = own.withColumn("_e", each.equity(F.coalesce("net", F.lit(0.0)) / 100)).withColumn("_d", each.drawdown("_e"))
    out = own.groupBy("_leg").agg(F.count(F.lit(1)).alias("days"), ((F.max_by("_e", series.order) - 1) * 100).alias("total"), (F.min("_d") * 100).alias("mdd"))
    return out.where(F.col("days") >= least).select("_leg.*", "*").drop("_leg").withColumnRenamed("group", "year")
