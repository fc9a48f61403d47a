"""An index's signal on another series, from open to next open: strategies and costs, contributions, years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import replication
from .registry import query
from .signals import _CHANNEL, signals
from .tracks import SUMMED, _r, _summary

S = Series()
#: Round trips in basis points: the usual one, and those that the index's signal on the other series is tried with.
USUAL, TRIED = 10.0, [5.0, 25.0, 50.0]
RUNS = [(k, USUAL) for k in replication.STRATEGIES] + [("own_by_index", c) for c in TRIED]
OWN = [(k, USUAL) for k in ("own_hold", "own_by_index", "own_by_own")]
AMOUNT = 1_000_000


def _pairs(spark, sf_dir):
    """The first ticker is held for the index. Opens are 1 and the bars' tame return, for products over thousands of rows."""
    s = signals(spark, sf_dir).select("ticker", "date", (1 + F.col("ret")).alias("open"), "position")
    index = s.where("ticker = '1-URGENT'").select("date", F.col("open").alias("index_open"), F.col("position").alias("index_position"))
    return s.where("ticker != '1-URGENT'").join(index, "date")


def _weighted(runs: list[tuple[str, float]], group: str = "") -> str:
    """DuckDB's SQL for the rows of runs (ticker, strategy, cost, date, r, weight) as the table wt."""
    said = ", ".join(f"('{k}', {c}::DOUBLE)" for k, c in runs)
    return _CHANNEL + f""",
 pr AS (SELECT b.ticker, a.date, 1 + a.ret AS oa, 1 + b.ret AS ob, a.position AS pa, b.position AS pb FROM sig a JOIN sig b ON a.date = b.date AND a.ticker = '1-URGENT' AND b.ticker <> '1-URGENT'),
 mv AS (SELECT ticker, date, (lead(oa) OVER w / oa - 1) * 100 AS ra, (lead(ob) OVER w / ob - 1) * 100 AS rb, coalesce(lag(pa) OVER w, 0) AS la, coalesce(lag(pb) OVER w, 0) AS lb FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 ru AS (SELECT * FROM (VALUES {said}) v(strategy, cost)),
 wt AS (SELECT ticker, strategy, cost, date{group}, CASE WHEN strategy LIKE 'index%' THEN ra ELSE rb END AS r,
   CASE WHEN strategy LIKE '%hold' THEN 1 WHEN ra IS NULL OR rb IS NULL THEN 0 WHEN strategy LIKE '%by_index' THEN la ELSE lb END::DOUBLE AS weight FROM mv, ru)"""


@query(_weighted(RUNS) + ", " + _summary("wt", "ticker, strategy, cost", "(cost / 2)") + """,
 sw AS (SELECT ticker, strategy, cost, count(*) FILTER (WHERE abs(turned) > 1e-9) AS switches FROM (SELECT *, weight - lag(weight) OVER (PARTITION BY ticker, strategy, cost ORDER BY date) AS turned FROM wt) GROUP BY ALL)
 SELECT * FROM su JOIN sw USING (ticker, strategy, cost)""")
def replication_summary(spark, sf_dir):
    """Five strategies at the usual cost, and the index's signal on the other series at three more."""
    return _r(replication.summaries(_pairs(spark, sf_dir), RUNS, S), *SUMMED)


@query(_weighted(OWN) + f""",
 nt AS (SELECT *, coalesce(weight * r - abs(weight - coalesce(lag(weight) OVER w, 0)) * (cost / 2) / 100, 0) / 100 AS net, CASE WHEN coalesce(strftime(date, '%Y-%m') <> strftime(lag(date) OVER w, '%Y-%m'), true) THEN {AMOUNT}::DOUBLE ELSE 0 END AS c
   FROM wt WINDOW w AS (PARTITION BY ticker, strategy ORDER BY date)),
 gr AS (SELECT *, product(1 + net) OVER w AS g, sum(c) OVER w AS paid FROM nt WINDOW w AS (PARTITION BY ticker, strategy ORDER BY date)),
 un AS (SELECT *, c / coalesce(lag(g) OVER (PARTITION BY ticker, strategy ORDER BY date), 1) AS unit FROM gr), va AS (SELECT *, g * sum(unit) OVER (PARTITION BY ticker, strategy ORDER BY date) AS value FROM un),
 dn AS (SELECT *, value / max(value) OVER (PARTITION BY ticker, strategy ORDER BY date) - 1 AS down FROM va)
 SELECT ticker, strategy, cost, round(max_by(paid, date), 2) AS paid_in, round(max_by(value, date), 2) AS value, round(max((paid - value) / paid) * 100, 6) AS deepest_loss, round(min(down) * 100, 6) AS value_mdd,
  round((max_by(value, date) / max_by(paid, date) - 1) * 100, 6) AS gain FROM dn GROUP BY ticker, strategy, cost""")
def replication_contributions(spark, sf_dir):
    """A plan that pays in a million on each month's first day, by three strategies."""
    out = replication.contributed(_pairs(spark, sf_dir), OWN, AMOUNT, S)
    return _r(_r(out, "paid_in", "value", digits=2), "deepest_loss", "value_mdd", "gain")


@query(_weighted(OWN, ", CAST(year(date) AS INTEGER) AS year") + """,
 nt AS (SELECT *, coalesce(weight * r - abs(weight - coalesce(lag(weight) OVER w, 0)) * (cost / 2) / 100, 0) / 100 AS net FROM wt WINDOW w AS (PARTITION BY ticker, strategy, year ORDER BY date)),
 eq AS (SELECT *, product(1 + net) OVER w AS e FROM nt WINDOW w AS (PARTITION BY ticker, strategy, year ORDER BY date)),
 dn AS (SELECT *, e / max(e) OVER (PARTITION BY ticker, strategy, year ORDER BY date) - 1 AS down FROM eq)
 SELECT ticker, year, strategy, cost, count(*) AS days, round((max_by(e, date) - 1) * 100, 6) AS total, round(min(down) * 100, 6) AS mdd FROM dn GROUP BY ALL HAVING count(*) >= 40""")
def replication_years(spark, sf_dir):
    """The same by year, where a year has 40 days or more."""
    return _r(replication.by_year(_pairs(spark, sf_dir), OWN, 40, S), "total", "mdd")
