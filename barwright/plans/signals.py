"""Signals, rolling statistics and state machines over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import state
from ..operators.xsection import newest
from ..sources.derive import BARS, FLOWS, HOURLY, bars, flows, hourly_bars
from .registry import query, r6

S = Series()
#: The breakout's channel lengths.
ENTRY, EXIT = 20, 10

_CHANNEL = f"""WITH {BARS}, c AS (SELECT *,
  CASE WHEN count(high) OVER e = {ENTRY} THEN max(high) OVER e END AS dc_high, CASE WHEN count(low) OVER x = {EXIT} THEN min(low) OVER x END AS dc_low FROM bars
  WINDOW e AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {ENTRY} PRECEDING AND 1 PRECEDING), x AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {EXIT} PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, coalesce(close > dc_high, false) AS long_entry, coalesce(close < dc_low, false) AS long_exit, dc_high IS NOT NULL AS live FROM c),
 k AS (SELECT *, CASE WHEN live AND long_entry AND NOT long_exit THEN 1 WHEN live AND long_exit AND NOT long_entry THEN 0 END AS k,
  sum(CASE WHEN live AND long_entry AND long_exit THEN 1 ELSE 0 END) OVER w AS tc FROM f WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 s AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER w, 0) AS base, coalesce(last_value(CASE WHEN k IS NOT NULL THEN tc END IGNORE NULLS) OVER w, 0) AS t0 FROM k WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 sig AS (SELECT *, CAST(CASE WHEN live THEN (base + tc - t0) % 2 ELSE 0 END AS INTEGER) AS position FROM s)"""


def signals(spark, sf_dir):
    return state.channel_signals(bars(spark, sf_dir), ENTRY, EXIT, S)


@query(_CHANNEL + " SELECT ticker, date, close, dc_high, dc_low, long_entry, long_exit, position FROM sig", "date")
def breakout_position(spark, sf_dir):
    return signals(spark, sf_dir).select("ticker", "date", "close", "dc_high", "dc_low", "long_entry", "long_exit", "position")


@query(_CHANNEL + """, e AS (SELECT ticker, date, close, position, coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY date), 0) AS b FROM sig)
 SELECT ticker, date, close, CASE WHEN position > b THEN 'BUY' ELSE 'SELL' END AS signal FROM e WHERE position <> b""", "date")
def signal_edges(spark, sf_dir):
    return state.edges(signals(spark, sf_dir), S).select("ticker", "date", "close", "signal")


_RALLY = f"""WITH {BARS}, p AS (SELECT *, CASE WHEN count(close) OVER w >= 60 THEN max(close) OVER w END AS peak FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)),
 c AS (SELECT *, coalesce(close < peak * (1 - 0.10::DOUBLE), false) AS cor FROM p),
 i AS (SELECT *, sum(CASE WHEN cor THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS isl FROM c),
 r AS (SELECT *, min(low) OVER w AS rl, row_number() OVER w AS rn FROM i WINDOW w AS (PARTITION BY ticker, isl, cor ORDER BY date)),
 d AS (SELECT *, CAST(CASE WHEN cor THEN rn - coalesce(max(CASE WHEN low = rl THEN rn END) OVER (PARTITION BY ticker, isl, cor ORDER BY date), 1) + 1 ELSE 0 END AS BIGINT) AS rally_day, CASE WHEN cor THEN rl END AS rally_low FROM r),
 g AS (SELECT *, (close / lag(close) OVER w - 1) * 100 AS gain, rally_day BETWEEN 4 AND 10 AS in_window, count(volume) OVER (PARTITION BY ticker) >= 50 AS has,
   CASE WHEN count(volume) OVER v = 50 THEN avg(volume) OVER v END AS ma FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
 ftd AS (SELECT *, coalesce(gain >= 2.0, false) AS gain_ok, CASE WHEN has THEN ma END AS volume_ma50, has AND coalesce(volume > ma, false) AS volume_ok,
   in_window AND coalesce(gain >= 2.0, false) AND has AND coalesce(volume > ma, false) AS ftd FROM g)"""


def follow(spark, sf_dir):
    return state.follow_through(bars(spark, sf_dir), series=S)


@query(_RALLY + " SELECT ticker, date, cor AS in_correction, rally_day, rally_low FROM d", "date")
def rally_counter(spark, sf_dir):
    return follow(spark, sf_dir).select("ticker", "date", "in_correction", "rally_day", "rally_low")


@query(_RALLY + " SELECT ticker, date, rally_day, round(gain, 6) AS gain, in_window, gain_ok, round(volume_ma50, 6) AS volume_ma50, volume_ok, ftd FROM ftd", "date")
def ftd_confirm(spark, sf_dir):
    return follow(spark, sf_dir).select("ticker", "date", "rally_day", r6("gain").alias("gain"), "in_window", "gain_ok", r6("volume_ma50").alias("volume_ma50"), "volume_ok", "ftd")


@query(_RALLY + """, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM ftd)
 SELECT ticker, date, close, CASE WHEN ftd THEN 'confirmed' WHEN NOT cor THEN 'no correction' WHEN NOT in_window THEN 'outside window' WHEN NOT gain_ok THEN 'gain too small' ELSE 'volume too small' END AS state, rally_day FROM n WHERE b = 1""", "date")
def current_state(spark, sf_dir):
    last = newest(follow(spark, sf_dir), 1, ["ticker"], "date")
    said = F.when(F.col("ftd"), "confirmed").when(~F.col("in_correction"), "no correction").when(~F.col("in_window"), "outside window").when(~F.col("gain_ok"), "gain too small").otherwise("volume too small")
    return last.select("ticker", "date", "close", said.alias("state"), "rally_day")


@query(_RALLY + """, e AS (SELECT *, min(low) OVER a AS ahead_low, last_value(close) OVER a AS ahead_close, count(*) OVER a AS na FROM ftd WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
 SELECT ticker, count(*) AS n_ftd, CAST(count(*) FILTER (WHERE ahead_low < rally_low) AS BIGINT) AS n_false, round(avg((ahead_close / close - 1) * 100) FILTER (WHERE na > 0), 6) AS mean_forward,
  round(avg(CASE WHEN ahead_close > close THEN 1.0 ELSE 0.0 END) FILTER (WHERE na > 0), 6) AS win_rate FROM e WHERE ftd GROUP BY ticker""")
def false_signal_eval(spark, sf_dir):
    ahead = S.frame(1, 20)
    e = follow(spark, sf_dir).withColumn("ahead_low", F.min("low").over(ahead)).withColumn("ahead_close", F.last("close").over(ahead)).where("ftd")
    gain = (F.col("ahead_close") / F.col("close") - 1) * 100
    return e.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_ftd"), F.count_if(F.col("ahead_low") < F.col("rally_low")).alias("n_false"), r6(F.avg(gain)).alias("mean_forward"), r6(F.avg((F.col("ahead_close") > F.col("close")).cast("double"))).alias("win_rate"))


@query(_RALLY + """, m AS (SELECT ticker, quantile_cont(rally_day, 0.5) AS lag_median, quantile_cont((close / rally_low - 1) * 100, 0.5) AS premium_median, count(*) AS n FROM ftd WHERE ftd AND rally_low IS NOT NULL GROUP BY ticker)
 SELECT ticker, n, round(lag_median, 6) AS lag_median, round(premium_median, 6) AS premium_median FROM m""")
def entry_lag(spark, sf_dir):
    e = follow(spark, sf_dir).where("ftd AND rally_low IS NOT NULL")
    return e.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), r6(F.median("rally_day")).alias("lag_median"), r6(F.median((F.col("close") / F.col("rally_low") - 1) * 100)).alias("premium_median"))


@query(_CHANNEL + """, n AS (SELECT ticker, date, close, row_number() OVER w AS rn, first_value(CASE WHEN long_entry THEN date END IGNORE NULLS) OVER a AS next_date, first_value(CASE WHEN long_entry THEN close END IGNORE NULLS) OVER a AS next_close
  FROM sig WINDOW w AS (PARTITION BY ticker ORDER BY date), a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
 SELECT ticker, date, next_date, round(next_close / close - 1, 6) AS price_edge FROM n WHERE next_date IS NOT NULL""", "date next_date")
def next_event(spark, sf_dir):
    from ..operators.timejoin import next_event as found

    out = found(signals(spark, sf_dir), F.col("long_entry"), ["date", "close"], "next", S).where("next IS NOT NULL")
    return out.select("ticker", "date", F.col("next.date").alias("next_date"), r6(F.col("next.close") / F.col("close") - 1).alias("price_edge"))


@query(f"""WITH {FLOWS} SELECT ticker, date, round(CASE WHEN count(*) OVER w = 20 THEN sum(p1) OVER w / sum(value_cents) OVER w END, 6) AS ratio20,
  CASE WHEN count(*) OVER v = 5 THEN CAST(sum(CASE WHEN p1 > 0 THEN 1 ELSE 0 END) OVER v AS DOUBLE) END AS positive5 FROM flow
 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", "date")
def rolling_sum_ratio(spark, sf_dir):
    f = flows(spark, sf_dir)
    ratio = F.try_divide(S.over(F.sum, "p1", -19, 0), S.over(F.sum, "value_cents", -19, 0))
    return f.select("ticker", "date", r6(ratio).alias("ratio20"), S.over(F.sum, (F.col("p1") > 0).cast("double"), -4, 0).alias("positive5"))


@query(f"""WITH {BARS} SELECT ticker, date, round(CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) * 100 END, 6) AS realized_vol FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "date")
def rolling_std(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", r6(S.over(F.stddev_samp, "ret", -19, 0) * F.sqrt(F.lit(252.0)) * 100).alias("realized_vol"))


@query(f"""WITH {BARS} SELECT ticker, date, round(CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END, 6) AS forward_vol FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)""", "date")
def forward_vol(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", r6(S.over(F.stddev_samp, "ret", 1, 20)).alias("forward_vol"))


@query(f"""WITH {BARS} SELECT ticker, date, round(volume / CASE WHEN count(volume) OVER w = 20 THEN avg(volume) OVER w END, 6) AS volume_ratio FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""", "date")
def volume_ratio(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", r6(F.col("volume") / S.over(F.avg, "volume", -20, -1)).alias("volume_ratio"))


@query(f"""WITH {FLOWS} SELECT ticker, date, round(CASE WHEN count(p1) OVER w = 60 THEN covar_pop(p1, p2) OVER w / nullif(stddev_pop(p1) OVER w * stddev_pop(p2) OVER w, 0) END, 5) AS corr60 FROM flow WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""", "date")
def rolling_corr(spark, sf_dir):
    return flows(spark, sf_dir).select("ticker", "date", F.round(S.correlation("p1", "p2", 60), 5).alias("corr60"))


@query(f"""WITH {BARS}, h AS (SELECT ticker, date, close, list(close) OVER w AS held, count(close) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
 SELECT ticker, date, round(CASE WHEN n = 50 THEN (len(list_filter(held, lambda v: v < close)) + (len(list_filter(held, lambda v: v = close)) + 1) / 2) / 50 END, 6) AS trailing_rank FROM h""", "date")
def trailing_rank(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", r6(S.trailing_rank("close", 50)).alias("trailing_rank"))


@query(f"""WITH {HOURLY} SELECT ticker, date, open, high, low, close, volume, round(close / lag(close, 3) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS change3 FROM hours""", "date")
def hourly_change(spark, sf_dir):
    return hourly_bars(spark, sf_dir).select("ticker", "date", "open", "high", "low", "close", "volume", r6(S.change("close", 3)).alias("change3"))


_EQUITY = f"""WITH {BARS}, q AS (SELECT ticker, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS equity FROM bars),
 dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown FROM q)"""


@query(_EQUITY + " SELECT ticker, date, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM dd", "date")
def equity_drawdown(spark, sf_dir):
    e = bars(spark, sf_dir).withColumn("e", S.equity("ret")).withColumn("d", S.drawdown("e"))
    return e.select("ticker", "date", r6("e").alias("equity"), r6("d").alias("drawdown"))


@query(f"""WITH {BARS}, g AS (SELECT *, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS g FROM bars), c AS (SELECT ticker, g, count(*) FILTER (WHERE ret < 0) AS n FROM g GROUP BY ticker, g)
 SELECT ticker, CAST(max(n) AS BIGINT) AS losing_streak FROM c GROUP BY ticker""")
def losing_streak(spark, sf_dir):
    return state.longest_run(bars(spark, sf_dir), F.col("ret") < 0, "losing_streak", S)


@query(_EQUITY + """, g AS (SELECT *, drawdown < -1e-12 AS u, sum(CASE WHEN drawdown < -1e-12 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS g FROM dd), c AS (SELECT ticker, g, count(*) FILTER (WHERE u) AS n FROM g GROUP BY ticker, g)
 SELECT ticker, CAST(max(n) AS BIGINT) AS underwater FROM c GROUP BY ticker""")
def underwater_run(spark, sf_dir):
    e = bars(spark, sf_dir).withColumn("e", S.equity("ret")).withColumn("d", S.drawdown("e"))
    return state.longest_run(e, F.col("d") < -1e-12, "underwater", S)


@query(_CHANNEL + """, g AS (SELECT *, sum(1 - position) OVER (PARTITION BY ticker ORDER BY date) AS g FROM sig)
 SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM g WHERE position = 1 GROUP BY ticker, g""", "first_date last_date")
def condition_bands(spark, sf_dir):
    return state.runs(signals(spark, sf_dir), F.col("position") == 1, S)


@query(f"""WITH {BARS}, m AS (SELECT *, CASE WHEN coalesce(strftime(date, '%Y-%m') <> strftime(lag(date) OVER w, '%Y-%m'), true) THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS c, exp(sum(ln(1 + ret)) OVER w) AS g FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 u AS (SELECT *, c / coalesce(lag(g) OVER (PARTITION BY ticker ORDER BY date), 1) AS unit FROM m)
 SELECT ticker, date, round(g * sum(unit) OVER w, 4) AS value, sum(c) OVER w AS paid_in FROM u WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "date")
def contribution(spark, sf_dir):
    paid = F.when(state.first_of_month(S), 100.0).otherwise(0.0)
    return state.contributions(bars(spark, sf_dir), "ret", paid, S).select("ticker", "date", F.round("value", 4).alias("value"), "paid_in")


@query(f"""WITH {BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars), k AS (SELECT unnest([0, 1, 5, 10]) AS step)
 SELECT ticker, step, CASE WHEN step = 0 THEN max(high) FILTER (WHERE back <= 20 - step) ELSE greatest(max(high) FILTER (WHERE back <= 20 - step), max(close) FILTER (WHERE back = 1)) END AS projected_high FROM b, k WHERE back <= 20 GROUP BY ticker, step""")
def channel_projection(spark, sf_dir):
    return state.channel_projection(bars(spark, sf_dir), 20, [0, 1, 5, 10], S)


@query(_CHANNEL + """, e AS (SELECT *, coalesce(position - lag(position) OVER (PARTITION BY ticker ORDER BY date), 1) <> 0 AS chg, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM sig)
 SELECT ticker, date, CAST(rn - max(CASE WHEN chg THEN rn END) OVER (PARTITION BY ticker ORDER BY date) AS BIGINT) AS days_since FROM e""", "date")
def days_since_change(spark, sf_dir):
    e = signals(spark, sf_dir).withColumn("rn", F.row_number().over(S.rows))
    changed = F.coalesce(F.col("position") - F.lag("position").over(S.rows), F.lit(1)) != 0
    e = e.withColumn("changed", changed)
    return e.select("ticker", "date", (F.col("rn") - F.max(F.when(F.col("changed"), F.col("rn"))).over(S.so_far)).cast("long").alias("days_since"))
