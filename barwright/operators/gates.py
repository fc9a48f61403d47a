"""Checks of panels and bars: verdicts as rows, counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Series
from .xsection import newest


def ohlc_verdict(bars: DataFrame, series: Series = Series(), *more: Column) -> DataFrame:
    """Of each series: rows, duplicate dates, nulls, prices not above 0, highs and lows out of order, and whether all hold; and more aggregates."""
    prices = ["open", "high", "low", "close"]
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in prices])
    bad = reduce(lambda a, b: a | b, [F.col(c) <= 0 for c in prices])
    top, bottom = F.col("high") < F.greatest("open", "close"), F.col("low") > F.least("open", "close")
    out = bars.groupBy(series.key).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct(series.order)).alias("duplicate_dates"),
        F.count_if(null).alias("null_rows"), F.count_if(bad).alias("not_positive"), F.count_if(top).alias("high_below"), F.count_if(bottom).alias("low_above"), F.count_if(F.col("high") < F.col("low")).alias("crossed"), *more,
    )
    faults = ["duplicate_dates", "null_rows", "not_positive", "high_below", "low_above", "crossed"]
    return out.withColumn("valid", (F.col("n") > 0) & reduce(lambda a, b: a & b, [F.col(c) == 0 for c in faults]))


def require_valid(bars: DataFrame, series: Series = Series()) -> DataFrame:
    """The bars, or an error that names the first series at fault."""
    bad = ohlc_verdict(bars, series).where("NOT valid").orderBy(series.key).first()
    if bad:
        raise ValueError(f"invalid bars: {bad.asDict()}")
    return bars


@dataclass(frozen=True)
class Registration:
    """What must be said before a study computes any number: its data, that they are real, its boundaries, the drawdown that it allows."""

    data: str | None
    kind: str
    research_end: str | None
    validation_end: str | None
    most_drawdown: float | None

    def lacks(self) -> str:
        """The first thing that isn't said, or empty."""
        if not self.data:
            return "no panel is given"
        if self.kind != "real":
            return "the data aren't known to be real"
        if not self.research_end or not self.validation_end:
            return "the ends of research and validation aren't set"
        if date.fromisoformat(self.research_end) >= date.fromisoformat(self.validation_end):
            return "research must end before validation"
        if self.most_drawdown is None or not 0 < self.most_drawdown < 1:
            return "the drawdown allowed must lie between 0 and 1"
        return ""


#: Of a panel's rows: numbers that must be there, that can't be negative, and that a row in trade needs above 0.
NUMBERS = ["open", "close", "volume", "trading_value", "foreign_net_value", "market_cap"]
COUNTED, TRADED = ["volume", "trading_value", "market_cap"], ["open", "close", "trading_value", "market_cap"]


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def panel_gate(panel: DataFrame, segments: list[tuple[str, str, str]], min_days: int | dict[str, int] = 252, min_names: int = 30, flow_slack: float = 1.001, stamped: str | None = "data_available_at", lag: int = 1) -> DataFrame:
    """One row: status PASS, FAIL or NOT_READY, reasons, warnings, execution_lag, and least_names.

    FAIL: null, blank or repeated keys, null or negative numbers, rows in trade (listed and tradable) with a price, turnover
    or size not above 0, flows above turnover, stamps partly missing, a lag under one day, segments out of order. NOT_READY: no rows, too few
    days in a segment, or names on a day: those in trade with a turnover, over the days that have any. Without any stamps
    the lag is two days at least, with a warning. A column that isn't there fails at once.
    """
    missing = sorted({"date", "ticker", "is_listed", "is_tradable", *NUMBERS} - set(panel.columns))
    if missing:
        kinds = "n long, status string, reasons string, warnings string, execution_lag int, least_names long"
        return panel.sparkSession.createDataFrame([(None, "FAIL", "missing columns: " + ", ".join(missing), "", lag, None)], kinds)
    c = F.col
    traded = F.coalesce(c("is_listed") & c("is_tradable"), F.lit(False))
    stamps = F.count(stamped) if stamped and stamped in panel.columns else F.lit(0)
    bad = {
        "null_keys": c("date").isNull() | c("ticker").isNull() | (F.trim(c("ticker").cast("string")) == ""), "null_numbers": _any(c(x).isNull() for x in NUMBERS), "negative": _any(c(x) < 0 for x in COUNTED),
        "no_price": traded & _any(c(x).isNull() | (c(x) <= 0) for x in TRADED), "flow_above": F.abs("foreign_net_value") > c("trading_value") * flow_slack,
    }
    facts = panel.agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct(F.struct("date", "ticker"))).alias("repeated"), *[F.count_if(rule).alias(k) for k, rule in bad.items()], stamps.alias("stamps"),
        *[F.count_distinct(F.when(c("date").between(a, b), c("date"))).alias(f"days_{name}") for name, a, b in segments],
    )
    names = panel.where(traded & (c("trading_value") > 0) & c("date").isNotNull()).groupBy("date").agg(F.count_distinct("ticker").alias("names")).agg(F.coalesce(F.min("names"), F.lit(0)).alias("least_names"))
    facts = facts.crossJoin(F.broadcast(names))  # both of one row
    ordered = all(a <= b for _, a, b in segments) and all(p[2] < q[1] for p, q in zip(segments, segments[1:], strict=False))
    said = {
        "null_keys": "null keys", "repeated": "repeated keys", "null_numbers": "null numbers", "negative": "negative numbers", "no_price": "rows in trade without price", "flow_above": "flow above turnover",
    }
    partly = (c("stamps") > 0) & (c("stamps") < c("n"))
    fails = [*[F.when(c(k) > 0, text) for k, text in said.items()], F.when(partly, "availability partly missing"), F.when(F.lit(lag < 1), "lag under one day"), F.when(F.lit(not ordered), "segments out of order")]
    few = [F.when(c(f"days_{name}") < (min_days[name] if isinstance(min_days, dict) else min_days), f"too few days in {name}") for name, _, _ in segments]
    waits = [F.when(c("n") == 0, "no rows"), *few, F.when(c("least_names") < min_names, "too few names on a day")]
    out = facts.withColumn("fails", F.array_compact(F.array(*fails))).withColumn("waits", F.array_compact(F.array(*waits)))
    status = F.when(F.size("fails") > 0, "FAIL").when(F.size("waits") > 0, "NOT_READY").otherwise("PASS")
    unstamped = c("stamps") == 0
    warnings = F.when(unstamped, "no availability: entry two days after the signal").otherwise("")
    own = max(1, lag)
    return out.select("n", status.alias("status"), F.concat_ws("; ", F.concat("fails", "waits")).alias("reasons"), warnings.alias("warnings"), F.when(unstamped, max(2, own)).otherwise(own).alias("execution_lag"), "least_names")


#: Parties whose net flows close to zero.
CLOSED = ["foreign_net_qty", "individual_net_qty", "institution_net_qty", "etc_corp_net_qty"]


def consistency_rules(columns: list[str], flow_slack: float = 1.001) -> dict[str, Column]:
    """What rows can contradict, for the rules whose columns are there: net flows that don't sum to zero, flows above turnover, shorts above volume, crossed bars, provisional rows."""
    c = F.col
    net = reduce(lambda a, b: a + b, [F.coalesce(c(x), F.lit(0)) for x in CLOSED])
    rules = {
        "net_sum": (CLOSED, lambda: F.abs(net) > 1), "flow_above": (["trading_value", "foreign_net_value"], lambda: F.abs("foreign_net_value") > c("trading_value") * flow_slack),
        "short_above": (["short_qty", "volume"], lambda: c("short_qty") > c("volume")), "crossed": (["high", "low"], lambda: c("high") < c("low")), "provisional": (["is_provisional"], lambda: c("is_provisional")),
    }
    return {k: F.coalesce(rule(), F.lit(False)) for k, (needs, rule) in rules.items() if set(needs) <= set(columns)}


def rule_facts(rules: dict[str, Column], date: str = "date") -> list[Column]:
    """Aggregates of rules: how many rows meet each, and the first date of one."""
    return [x for k, rule in rules.items() for x in (F.count_if(rule).alias(k), F.min(F.when(rule, F.col(date))).alias(f"{k}_first"))]


def consistency(panel: DataFrame, parties: list[str], total: str, key: str = "ticker") -> DataFrame:
    """Of each key, with first dates: net flows of some parties that don't sum to zero, flows above the total; and what consistency_rules finds for the panel's other columns."""
    net = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in parties])
    rules = {"net_sum": F.abs(net) > 1, "flow_above": _any(F.abs(F.coalesce(c, F.lit(0))) > F.col(total) * 1.001 for c in parties)}
    own = {k: r for k, r in consistency_rules(panel.columns).items() if k not in rules}
    return panel.groupBy(key).agg(*rule_facts({**rules, **own}))


def closes_agree(a: DataFrame, b: DataFrame, limit: float = 0.02, tolerance: float = 0.005, recent: int = 60, series: Series = Series()) -> DataFrame:
    """Two sources' closes of each key: compared, mismatched, median gaps over all and the newest rows, and a verdict."""
    both = a.select(series.key, series.order, F.col("close").alias("_a")).join(b.select(series.key, series.order, F.col("close").alias("_b")), [series.key, series.order])
    both = both.withColumn("gap", F.try_divide(F.abs(F.col("_a") - F.col("_b")), F.nullif(F.abs("_a"), F.lit(0.0))))
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy(series.key).orderBy(F.desc(series.order))))
    out = both.groupBy(series.key).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("gap") > tolerance).alias("mismatched"), F.median("gap").alias("median_gap"), F.median(F.when(F.col("_n") <= recent, F.col("gap"))).alias("recent_gap"),
    )
    verdict = F.when(F.col("recent_gap") > limit, "wrong target").when(F.col("median_gap") > limit, "adjusted prices").otherwise("ok")
    return out.withColumn("verdict", verdict)


def continuity(bars: DataFrame, as_of: str, tail: int = 200, old_days: int = 120, series: Series = Series()) -> DataFrame:
    """A note on each key's newest rows: volume missing, holes among the last `tail`, or history that ends too early."""
    last = newest(bars, tail, [series.key], series.order).groupBy(series.key).agg(F.count_if(F.col("volume").isNull()).alias("holes"), F.max(series.order).alias("ends"), F.count("volume").alias("volumes"))
    note = F.when(F.col("volumes") == 0, "no volume").when(F.datediff(F.lit(as_of).cast("date"), "ends") > old_days, "history too old").when(F.col("holes") > 0, "holes in volume").otherwise("")
    return last.select(series.key, "holes", "ends", note.alias("note"))
