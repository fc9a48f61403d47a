"""Performance of strategies: annual rates, active days, paths with a delay, comparisons with a base or another series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import at_least
from ..functions.rolling import Series
from . import accounting
from .state import runs
from .stats import tail_mean

YEAR_DAYS, YEAR_ROWS = 365.25, 252.0


def years_between(first: Column, last: Column, floor: bool = False) -> Column:
    """Years of calendar days; with a floor, one trading day at least."""
    years = F.datediff(last, first) / YEAR_DAYS
    return F.greatest(years, F.lit(1 / YEAR_ROWS)) if floor else F.nullif(years, F.lit(0.0))


def annual(growth: Column, years: Column) -> Column:
    """The yearly rate of a growth factor over some years."""
    return F.pow(growth, F.try_divide(F.lit(1.0), years)) - 1


def annual_rates(df: DataFrame, r: str, series: Series = Series()) -> DataFrame:
    """The same returns by four conventions: calendar years with a floor, calendar years from the first row's equity, calendar years, and rows of 252 a year."""
    own = df.withColumn("_e", series.equity(r))
    g = own.groupBy(series.key).agg(F.max_by("_e", series.order).alias("_last"), F.min_by("_e", series.order).alias("_first"), F.min(series.order).alias("_a"), F.max(series.order).alias("_b"), F.count(F.lit(1)).alias("_n"))
    plain = years_between(F.col("_a"), F.col("_b"))
    return g.select(
        series.key, annual(F.col("_last"), years_between(F.col("_a"), F.col("_b"), True)).alias("calendar_floor"), annual(F.col("_last") / F.col("_first"), plain).alias("from_first_row"),
        annual(F.col("_last"), plain).alias("calendar"), annual(F.col("_last"), F.col("_n") / YEAR_ROWS).alias("by_rows"),
    )


def active_performance(df: DataFrame, r: str, active: str, series: Series = Series()) -> DataFrame:
    """Returns (null as 0) of a strategy, with statistics of its active rows alone: win rate, mean, tail mean, losing streak."""
    own = df.withColumn("_r", F.coalesce(F.col(r), F.lit(0.0))).withColumn("_e", series.equity("_r"))
    own = own.withColumn("_d", series.drawdown("_e")).withColumn("_a", F.when(F.col(active), F.col("_r")))
    rows = own.groupBy(series.key).agg(
        (F.max_by("_e", series.order) - 1).alias("total_return"), annual(F.max_by("_e", series.order), years_between(F.min(series.order), F.max(series.order), True)).alias("cagr"), F.min("_d").alias("mdd"),
        (F.try_divide(F.avg("_r"), F.nullif(F.stddev_samp("_r"), F.lit(0.0))) * F.sqrt(F.lit(YEAR_ROWS))).alias("sharpe"), F.count("_a").alias("active_days"),
        F.avg(F.when(F.col("_a").isNotNull(), (F.col("_a") > 0).cast("double"))).alias("win_rate"), F.avg("_a").alias("avg_active_return"),
    )
    tail = tail_mean(own, "_a", [series.key], name="cvar_95")
    streak = runs(own.where("_a IS NOT NULL"), F.col("_a") < 0, series).groupBy(series.key).agg(F.max("n_rows").alias("max_losing_streak"))
    out = rows.join(tail, series.key, "left").join(streak, series.key, "left")
    return out.withColumn("max_losing_streak", F.coalesce("max_losing_streak", F.lit(0)).cast("long"))


def paths(df: DataFrame, position: str = "position", lag: int = 2, series: Series = Series()) -> DataFrame:
    """Following a signal against holding on, as logarithms of growth: held is the position `lag` rows before, open to open.

    The last held row also earns its open to close; holding on begins at the second open.
    """
    held = F.coalesce(F.lag(position, lag).over(series.rows), F.lit(0))
    step = F.log(1 + F.coalesce(series.change("open"), F.lit(0.0)) * held)
    own = df.withColumn("_h", held).withColumn("_s", step).withColumn("_n", F.row_number().over(series.rows))
    last = lambda c: F.max_by(c, series.order)
    g = own.groupBy(series.key).agg(F.max(F.when(F.col("_n") == 2, F.col("open"))).alias("entry"), last("close").alias("now"), last("open").alias("_o"), last("_h").alias("_h"), F.sum("_s").alias("_s")).where("entry IS NOT NULL")
    strat = F.col("_s") + F.when(F.col("_h") == 1, F.log(F.col("now") / F.col("_o"))).otherwise(0.0)
    return g.select(series.key, "entry", "now", strat.alias("strat_log"), F.log(F.col("now") / F.col("entry")).alias("hold_log")).withColumn("gap_log", F.col("hold_log") - F.col("strat_log"))


def sweep(df: DataFrame, position: str, r: str, lags: list[int], fees: list[float], series: Series = Series()) -> DataFrame:
    """cagr and mdd of a position at each delay and fee a switch, beside those of holding on (hold_cagr, hold_mdd)."""
    for fee in fees:
        at_least(fee, 0, "fee")
    moved = {f"_held{k}": F.coalesce(F.lag(position, k).over(series.rows), F.lit(0)) if k else F.col(position) for k in lags}
    each_lag = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_held{k}").alias("held")) for k in lags])).alias("_l")
    own = df.withColumns(moved).select(series.key, series.order, r, each_lag).select("*", "_l.*").drop("_l")
    own = own.withColumn("fee", F.explode(F.array(*[F.lit(float(x)) for x in fees]))).withColumn("_key", F.concat_ws("|", series.key, "lag", "fee"))
    each = Series("_key", series.order)
    own = own.withColumn("_net", accounting.net_of_switches("held", r, F.col("fee"), each))
    own = own.withColumn("_e", each.equity("_net")).withColumn("_m", each.equity(r))
    own = own.withColumn("_d", each.drawdown("_e")).withColumn("_dm", each.drawdown("_m"))
    years = years_between(F.min(series.order), F.max(series.order))
    return own.groupBy(series.key, "lag", "fee").agg(
        annual(F.max_by("_e", series.order), years).alias("cagr"), annual(F.max_by("_m", series.order), years).alias("hold_cagr"), F.min("_d").alias("mdd"), F.min("_dm").alias("hold_mdd")
    )


def trade_off(table: DataFrame, strategy: str, base: str, keys: list[str]) -> DataFrame:
    """Each strategy's row against the base strategy's: differences of annual, mdd, sharpe, exposure, and shares of improvement of mdd and cvar5."""
    other = table.where(F.col(strategy) == base).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("annual", "mdd", "cvar5", "sharpe", "exposure")])
    gain = lambda c: F.try_divide(F.col(c) - F.col(f"_{c}"), F.nullif(F.abs(f"_{c}"), F.lit(0.0)))
    less = lambda c: F.col(c) - F.col(f"_{c}")
    return table.where(F.col(strategy) != base).join(other, keys).select(
        *keys, strategy, less("annual").alias("annual_gap"), less("mdd").alias("mdd_gap"), gain("mdd").alias("mdd_improved"), gain("cvar5").alias("cvar_improved"), less("sharpe").alias("sharpe_gap"), less("exposure").alias("exposure_gap")
    )


def tracking(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """How series b (percent) follows a: correlation, the gap of their yearly rates in percent, and the deviation of daily differences."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    growth = lambda c: F.product(1 + F.col(c) / 100)
    return both.groupBy(*keys).agg(
        F.corr(a, b).alias("correlation"), ((F.pow(growth(b) / growth(a), F.lit(YEAR_ROWS) / F.count(F.lit(1))) - 1) * 100).alias("annual_gap"), F.stddev_samp(F.col(b) - F.col(a)).alias("tracking_error")
    )


def sign_stability(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """In how many folds a value is negative: negative, folds, and as text k/n."""
    g = df.groupBy(*keys).agg(F.count(F.when(F.col(value) < 0, 1)).alias("negative"), F.count(value).alias("folds"))
    return g.withColumn("stability", F.concat_ws("/", "negative", "folds"))


def strategy_matrix(df: DataFrame, strategies: dict[str, Column], r: Column, bps: float, multiples: list[float], series: Series = Series()) -> DataFrame:
    """The active performance of each strategy, given as a name and a signal, for each key and cost multiple, and of the portfolio of all keys.

    A row earns r, less the cost, where the row before has the signal. In the portfolio a key without a row on a date earns 0.
    """
    at_least(bps, 0, "cost")
    cases = [F.struct(F.lit(k).alias("strategy"), F.lag(F.coalesce(v, F.lit(False)), 1, False).over(series.rows).alias("held")) for k, v in strategies.items()]
    each = df.select(series.key, series.order, r.alias("_r0"), F.array(*cases).alias("_s")).select(series.key, series.order, "_r0", F.explode("_s").alias("_s"))
    each = each.select(F.col(series.key).cast("string").alias("ticker"), series.order, "_r0", "_s.*").withColumn("cost_multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    each = each.withColumn("r", F.when(F.col("held"), F.col("_r0") - F.col("cost_multiplier") * bps / 10_000).otherwise(0.0)).drop("_r0")
    n = df.agg(F.count_distinct(series.key).alias("_n"))  # one row
    whole = each.groupBy(series.order, "strategy", "cost_multiplier").agg(F.sum("r").alias("r"), F.bool_or("held").alias("held")).crossJoin(F.broadcast(n))
    whole = whole.withColumn("r", F.col("r") / F.col("_n")).drop("_n").withColumn("ticker", F.lit("portfolio"))
    every = each.unionByName(whole).withColumn("run", F.struct("ticker", "strategy", "cost_multiplier"))
    return active_performance(every, "r", "held", Series("run", series.order)).select("run.*", "*").drop("run")
