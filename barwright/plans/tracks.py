"""Performance, comparisons and block resampling of strategies over daily bars, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import accounting, performance, resample, state, stats
from ..sources.derive import BARS, FLOWS, bars, flows
from .registry import query, r6
from .signals import _CHANNEL, _RALLY, follow, signals

S = Series()
DRAWS, TRIALS, BLOCK = 2000, 20, 5
LAGS, FEES = [0, 1, 2], [0.0, 0.0003, 0.001]
COST = 30.0


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {BARS},
 g AS (SELECT ticker, product(1 + ret) AS last, 1 + min_by(ret, date) AS first, date_diff('day', min(date), max(date)) / 365.25::DOUBLE AS y, count(*) AS n FROM bars GROUP BY ticker)
 SELECT ticker, round(pow(last, 1 / greatest(y, 1 / 252.0::DOUBLE)) - 1, 6) AS calendar_floor, round(pow(last / first, 1 / y) - 1, 6) AS from_first_row,
        round(pow(last, 1 / y) - 1, 6) AS calendar, round(pow(last, 252.0::DOUBLE / n) - 1, 6) AS by_rows FROM g""")
def annual_rates(spark, sf_dir):
    return _r(performance.annual_rates(bars(spark, sf_dir), "ret", S), "calendar_floor", "from_first_row", "calendar", "by_rows")


@query(_CHANNEL + """,
 a AS (SELECT ticker, date, coalesce(lag(position) OVER w = 1, false) AS active, CASE WHEN lag(position) OVER w = 1 THEN 1 + ret - 1 - 0.003::DOUBLE ELSE 0 END AS r FROM sig WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 e AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker ORDER BY date) AS eq FROM a),
 d AS (SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM e),
 q AS (SELECT ticker, quantile_cont(r, 0.05) AS cut FROM a WHERE active GROUP BY ticker),
 t AS (SELECT ticker, avg(r) AS cvar FROM a JOIN q USING (ticker) WHERE active AND r <= cut GROUP BY ticker),
 i AS (SELECT ticker, r < 0 AS lost, row_number() OVER (PARTITION BY ticker ORDER BY date) - row_number() OVER (PARTITION BY ticker, r < 0 ORDER BY date) AS island FROM a WHERE active),
 lo AS (SELECT ticker, max(k) AS streak FROM (SELECT ticker, count(*) AS k FROM i WHERE lost GROUP BY ticker, island) GROUP BY ticker),
 g AS (SELECT ticker, max_by(eq, date) AS last, greatest(date_diff('day', min(date), max(date)) / 365.25::DOUBLE, 1 / 252.0::DOUBLE) AS y, min(dd) AS mdd, avg(r) / stddev_samp(r) * sqrt(252.0::DOUBLE) AS sharpe,
        count(*) FILTER (WHERE active) AS active_days, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE active) AS win_rate, avg(r) FILTER (WHERE active) AS avg_active_return FROM d GROUP BY ticker)
 SELECT ticker, round(last - 1, 6) AS total_return, round(pow(last, 1 / y) - 1, 6) AS cagr, round(mdd, 6) AS mdd, round(sharpe, 6) AS sharpe, active_days, round(win_rate, 6) AS win_rate,
        round(avg_active_return, 6) AS avg_active_return, round(cvar, 6) AS cvar_95, CAST(coalesce(streak, 0) AS BIGINT) AS max_losing_streak FROM g LEFT JOIN t USING (ticker) LEFT JOIN lo USING (ticker)""")
def active_performance(spark, sf_dir):
    """Open to close on the row after a signal, less 30 basis points; the prices are of the bars' tame return."""
    own = signals(spark, sf_dir).withColumn("open", F.lit(1.0)).withColumn("close", 1 + F.col("ret"))
    own = own.withColumn("r", accounting.next_day_intraday(F.col("position") == 1, 0.003, S)).withColumn("active", F.coalesce(F.lag("position").over(S.rows) == 1, F.lit(False)))
    return _r(performance.active_performance(own, "r", "active", S), "total_return", "cagr", "mdd", "sharpe", "win_rate", "avg_active_return", "cvar_95")


@query(_CHANNEL + """,
 fr AS (SELECT * FROM sig WHERE date >= DATE '1996-01-01'),
 h AS (SELECT ticker, date, open, close, coalesce(lag(position, 2) OVER w, 0) AS held, coalesce(open / lag(open) OVER w - 1, 0) AS oo, row_number() OVER w AS n FROM fr WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 g AS (SELECT ticker, max(open) FILTER (WHERE n = 2) AS entry, max_by(close, date) AS now, max_by(open, date) AS o, max_by(held, date) AS held, sum(ln(1 + oo * held)) AS s FROM h GROUP BY ticker),
 fin AS (SELECT ticker, entry, now, s + CASE WHEN held = 1 THEN ln(now / o) ELSE 0 END AS a, ln(now / entry) AS b FROM g WHERE entry IS NOT NULL)
 SELECT ticker, entry, now, round(a, 6) AS strat_log, round(b, 6) AS hold_log, round(b - a, 6) AS gap_log FROM fin""")
def track_scenarios(spark, sf_dir):
    """Growth as logarithms: the derived prices jump, and their products leave any rounding behind."""
    own = signals(spark, sf_dir).where("date >= DATE '1996-01-01'")
    return _r(performance.paths(own, series=S), "strat_log", "hold_log", "gap_log")


@query(_CHANNEL + f""",
 l AS (SELECT s.ticker, date, ret, lg AS lag, CASE lg WHEN 0 THEN position WHEN 1 THEN coalesce(lag(position, 1) OVER w, 0) ELSE coalesce(lag(position, 2) OVER w, 0) END AS held FROM sig s, (SELECT unnest({LAGS}) AS lg)
   WINDOW w AS (PARTITION BY s.ticker, lg ORDER BY date)),
 n AS (SELECT ticker, date, ret, lag, fee, held * ret - CASE WHEN abs(held - lag(held) OVER w) > 0 THEN fee ELSE 0 END AS r FROM l, (SELECT unnest({FEES}) ::DOUBLE AS fee) WINDOW w AS (PARTITION BY ticker, lag, fee ORDER BY date)),
 e AS (SELECT *, product(1 + r) OVER w AS eq, product(1 + ret) OVER w AS em FROM n WINDOW w AS (PARTITION BY ticker, lag, fee ORDER BY date)),
 d AS (SELECT *, eq / max(eq) OVER w - 1 AS dd, em / max(em) OVER w - 1 AS dm FROM e WINDOW w AS (PARTITION BY ticker, lag, fee ORDER BY date))
 SELECT ticker, lag, fee, round(pow(max_by(eq, date), 365.25::DOUBLE / date_diff('day', min(date), max(date))) - 1, 6) AS cagr,
        round(pow(max_by(em, date), 365.25::DOUBLE / date_diff('day', min(date), max(date))) - 1, 6) AS hold_cagr, round(min(dd), 6) AS mdd, round(min(dm), 6) AS hold_mdd FROM d GROUP BY ticker, lag, fee""")
def lag_fee_sweep(spark, sf_dir):
    return _r(performance.sweep(signals(spark, sf_dir), "position", "ret", LAGS, FEES, S), "cagr", "hold_cagr", "mdd", "hold_mdd")


# Strategies that differ in their entries, summarised and held against one of them.


def _summary(source: str, keys: str, half: str | float = COST / 2) -> str:
    """DuckDB's SQL for the summary of `source` ({keys}, date, r in percent, weight), as the tables nt .. su; `half` of the cost of a change."""
    w = f"PARTITION BY {keys} ORDER BY date"
    return f"""nt AS (SELECT *, coalesce(weight * r - abs(weight - coalesce(lag(weight) OVER ({w}), 0)) * {half} / 100, 0) / 100 AS net, CAST(weight - lag(weight) OVER ({w}) = 1 AS INTEGER) AS entered FROM {source}),
 eq AS (SELECT *, product(1 + net) OVER ({w}) AS eq FROM nt), dd AS (SELECT *, eq / max(eq) OVER ({w}) - 1 AS dd FROM eq),
 cu AS (SELECT {keys}, quantile_cont(net * 100, 0.05) AS cut FROM nt GROUP BY {keys}), tl AS (SELECT {keys}, avg(net * 100) AS cvar5 FROM nt JOIN cu USING ({keys}) WHERE net * 100 <= cut GROUP BY {keys}),
 il AS (SELECT {keys}, dd < -1e-12 AS under, row_number() OVER ({w}) - row_number() OVER (PARTITION BY {keys}, dd < -1e-12 ORDER BY date) AS island FROM dd),
 un AS (SELECT {keys}, max(k) AS longest FROM (SELECT {keys}, count(*) AS k FROM il WHERE under GROUP BY {keys}, island) GROUP BY {keys}),
 sm AS (SELECT {keys}, count(*) AS n, (max_by(eq, date) - 1) * 100 AS total, (pow(max_by(eq, date), 252.0::DOUBLE / count(*)) - 1) * 100 AS annual, min(dd) * 100 AS mdd, avg(CASE WHEN net < 0 THEN 1.0 ELSE 0.0 END) AS losing_share,
   avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0::DOUBLE) AS sharpe, avg(weight) AS exposure, CAST(coalesce(sum(entered), 0) AS BIGINT) AS trades FROM dd GROUP BY {keys}),
 su AS (SELECT {keys}, n, round(total, 6) AS total, round(annual, 6) AS annual, round(mdd, 6) AS mdd, CAST(coalesce(longest, 0) AS BIGINT) AS longest_underwater, round(cvar5, 6) AS cvar5, round(losing_share, 6) AS losing_share,
   round(sharpe, 6) AS sharpe, round(exposure, 6) AS exposure, trades FROM sm LEFT JOIN tl USING ({keys}) LEFT JOIN un USING ({keys}))"""


SUMMED = ("total", "annual", "mdd", "cvar5", "losing_share", "sharpe", "exposure")


def summarised(weighted, keys):
    """accounting.summary of (keys, date, r, weight) after costs, for each combination of the keys."""
    own = weighted.withColumn("_key", F.concat_ws("|", *keys))
    each = Series("_key", "date")
    own = own.withColumn("net", accounting.net_of_turnover("weight", "r", COST, each))
    return accounting.summary(own, "net", "weight", each).join(own.select("_key", *keys).distinct(), "_key").drop("_key")


_COMBINED = _CHANNEL + ", ftd AS (" + _RALLY + """ SELECT ticker, date, ftd FROM ftd),
 en AS (SELECT x.ticker, x.date, x.ret * 100 AS r, x.long_exit, x.live, st, CASE st WHEN 'channel' THEN x.long_entry WHEN 'ftd' THEN f.ftd ELSE x.long_entry OR f.ftd END AS entry
   FROM sig x JOIN ftd f ON x.ticker = f.ticker AND x.date = f.date, (SELECT unnest(['channel', 'ftd', 'union']) AS st)),
 ek AS (SELECT *, CASE WHEN live AND entry AND NOT long_exit THEN 1 WHEN live AND long_exit AND NOT entry THEN 0 END AS k2, sum(CASE WHEN live AND entry AND long_exit THEN 1 ELSE 0 END) OVER w AS tc2 FROM en WINDOW w AS (PARTITION BY ticker, st ORDER BY date)),
 ep AS (SELECT *, CASE WHEN live THEN (coalesce(last_value(k2 IGNORE NULLS) OVER w, 0) + tc2 - coalesce(last_value(CASE WHEN k2 IS NOT NULL THEN tc2 END IGNORE NULLS) OVER w, 0)) % 2 ELSE 0 END AS position FROM ek WINDOW w AS (PARTITION BY ticker, st ORDER BY date)),
 ew AS (SELECT ticker, st AS strategy, date, r, CAST(coalesce(lag(position) OVER (PARTITION BY ticker, st ORDER BY date), 0) AS DOUBLE) AS weight FROM ep UNION ALL SELECT ticker, 'hold', date, ret * 100, 1.0::DOUBLE FROM bars), """ + _summary("ew", "ticker, strategy")


def combined(spark, sf_dir):
    """Positions from channel entries, follow-through days or either, all leaving by the channel, and holding on; yesterday's position earns."""
    ftd = follow(spark, sf_dir).select("ticker", "date", "ftd")
    own = signals(spark, sf_dir).join(ftd, ["ticker", "date"])
    entries = {"channel": F.col("long_entry"), "ftd": F.col("ftd"), "union": F.col("long_entry") | F.col("ftd")}
    own = own.withColumn("e", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("entry")) for k, v in entries.items()]))).select("*", "e.*")
    each = Series("_key", "date")
    own = state.position(own.withColumn("_key", F.concat_ws("|", "ticker", "strategy")), F.col("entry"), F.col("long_exit"), F.col("dc_high").isNotNull(), each)
    r = (F.col("ret") * 100).alias("r")
    held = own.select("ticker", "strategy", "date", r, F.coalesce(F.lag("position").over(each.rows), F.lit(0)).cast("double").alias("weight"))
    return summarised(held.union(bars(spark, sf_dir).select("ticker", F.lit("hold"), "date", r, F.lit(1.0))), ["ticker", "strategy"])


@query(_COMBINED + " SELECT * FROM su")
def entry_combinations(spark, sf_dir):
    return _r(combined(spark, sf_dir), *SUMMED)


@query(_COMBINED + """ SELECT a.ticker, a.strategy, round(a.annual - b.annual, 5) AS annual_gap, round(a.mdd - b.mdd, 5) AS mdd_gap, round((a.mdd - b.mdd) / nullif(abs(b.mdd), 0), 5) AS mdd_improved,
   round((ta.cvar5 - tb.cvar5) / nullif(abs(tb.cvar5), 0), 5) AS cvar_improved, round(a.sharpe - b.sharpe, 5) AS sharpe_gap, round(a.exposure - b.exposure, 5) AS exposure_gap
  FROM sm a JOIN sm b ON a.ticker = b.ticker AND b.strategy = 'channel' AND a.strategy <> 'channel' LEFT JOIN tl ta ON ta.ticker = a.ticker AND ta.strategy = a.strategy LEFT JOIN tl tb ON tb.ticker = b.ticker AND tb.strategy = b.strategy""")
def trade_off(spark, sf_dir):
    out = performance.trade_off(combined(spark, sf_dir), "strategy", "channel", ["ticker"])
    return _r(out, "annual_gap", "mdd_gap", "mdd_improved", "cvar_improved", "sharpe_gap", "exposure_gap", digits=5)


# One series' signal on another.

_PAIR = _CHANNEL + """,
 pr AS (SELECT b.ticker, a.date, a.ret * 100 AS ra, b.ret * 100 AS rb, a.position AS pa, b.position AS pb FROM sig a JOIN sig b ON a.date = b.date AND a.ticker = '1-URGENT' AND b.ticker <> '1-URGENT')"""


def _pair(spark, sf_dir):
    """The other tickers' days beside the first's, which is held for the index."""
    s = signals(spark, sf_dir).select("ticker", "date", (F.col("ret") * 100).alias("r"), "position")
    index = s.where("ticker = '1-URGENT'").select("date", F.col("r").alias("ra"), F.col("position").alias("pa"))
    return s.where("ticker != '1-URGENT'").select("ticker", "date", F.col("r").alias("rb"), F.col("position").alias("pb")).join(index, "date")


@query(_PAIR + """, en AS (SELECT *, pa - lag(pa) OVER w AS da, pb - lag(pb) OVER w AS db FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, round(corr(ra, rb), 6) AS correlation, round((pow(product(1 + rb / 100) / product(1 + ra / 100), 252.0::DOUBLE / count(*)) - 1) * 100, 6) AS annual_gap, round(stddev_samp(rb - ra), 6) AS tracking_error,
  round(avg(CASE WHEN pa = pb THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) FILTER (WHERE da = 1) AS index_entries, count(*) FILTER (WHERE db = 1) AS own_entries FROM en GROUP BY ticker""")
def tracking_pair(spark, sf_dir):
    p = _pair(spark, sf_dir)
    entered = lambda c: F.count(F.when(F.col(c) == 1, 1))
    n = p.withColumn("da", F.col("pa") - F.lag("pa").over(S.rows)).withColumn("db", F.col("pb") - F.lag("pb").over(S.rows))
    agree = n.groupBy("ticker").agg(r6(F.avg((F.col("pa") == F.col("pb")).cast("double"))).alias("agreement"), entered("da").alias("index_entries"), entered("db").alias("own_entries"))
    return _r(performance.tracking(p, "ra", "rb", ["ticker"]), "correlation", "annual_gap", "tracking_error").join(agree, "ticker")


@query(_PAIR + """, lg AS (SELECT *, CAST(coalesce(lag(pa) OVER w, 0) AS DOUBLE) AS wa, CAST(coalesce(lag(pb) OVER w, 0) AS DOUBLE) AS wb FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 wt AS (SELECT ticker, st AS strategy, date, CASE WHEN st LIKE 'index%' THEN ra ELSE rb END AS r, CASE st WHEN 'index_hold' THEN 1 WHEN 'own_hold' THEN 1 WHEN 'index_by_index' THEN wa WHEN 'own_by_index' THEN wa ELSE wb END::DOUBLE AS weight
   FROM lg, (SELECT unnest(['index_hold', 'index_by_index', 'own_hold', 'own_by_index', 'own_by_own']) AS st)), """ + _summary("wt", "ticker, strategy") + " SELECT * FROM su")
def index_signal_study(spark, sf_dir):
    """Holding and following either signal, on the index and on the other series, over the same days and costs."""
    p = _pair(spark, sf_dir)
    wa, wb = (F.coalesce(F.lag(c).over(S.rows), F.lit(0)).cast("double") for c in ("pa", "pb"))
    p = p.withColumn("wa", wa).withColumn("wb", wb)
    kinds = {"index_hold": ("ra", F.lit(1.0)), "index_by_index": ("ra", F.col("wa")), "own_hold": ("rb", F.lit(1.0)), "own_by_index": ("rb", F.col("wa")), "own_by_own": ("rb", F.col("wb"))}
    p = p.withColumn("s", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(r).alias("r"), w.alias("weight")) for k, (r, w) in kinds.items()])))
    return _r(summarised(p.select("ticker", "date", "s.*"), ["ticker", "strategy"]), *SUMMED)


@query(f"""WITH {FLOWS}, y AS (SELECT ticker, year(date) AS fold, regr_slope(close / open - 1, p1 / CAST(value_cents AS DOUBLE)) AS slope FROM flow GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT ticker, count(*) FILTER (WHERE slope < 0) AS negative, count(slope) AS folds, (count(*) FILTER (WHERE slope < 0)) || '/' || count(slope) AS stability FROM y GROUP BY ticker""")
def sign_stability(spark, sf_dir):
    f = flows(spark, sf_dir).select("ticker", F.year("date").alias("fold"), (F.col("close") / F.col("open") - 1).alias("y"), (F.col("p1") / F.col("value_cents")).alias("x"))
    return performance.sign_stability(f.groupBy("ticker", "fold").agg(stats.slope("y", "x").alias("slope")), "slope", ["ticker"])


@query(f"""WITH {BARS}, p AS (SELECT ticker, date, close, max(close) OVER (PARTITION BY ticker ORDER BY date) AS peak, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS place FROM bars)
 SELECT ticker, place, date, close, round(close / peak - 1, 6) AS drop_from_peak FROM p WHERE place <= 10 ORDER BY ticker, place""", "date")
def newest_first(spark, sf_dir):
    """The ten newest rows of each ticker, newest first, with the drop from the running peak."""
    from pyspark.sql import Window

    own = bars(spark, sf_dir).withColumn("drop_from_peak", r6(S.drawdown("close")))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("place <= 10")
    return own.select("ticker", F.col("place").cast("long").alias("place"), "date", "close", "drop_from_peak").orderBy("ticker", "place")


# Block resampling of slopes.

_XY = f"""WITH {FLOWS}, xy AS (SELECT ticker, date, (close / open - 1) AS y, p1 / CAST(value_cents AS DOUBLE) AS x, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM flow)"""


def _xy(spark, sf_dir):
    f = flows(spark, sf_dir).select("ticker", "date", (F.col("close") / F.col("open") - 1).alias("y"), (F.col("p1") / F.col("value_cents")).alias("x"))
    return resample.positioned(f, "date", "ticker")


@query(_XY + f""", ln AS (SELECT DISTINCT ticker, n FROM xy WHERE n >= {4 * BLOCK}), bl AS (SELECT ticker, n, draw, unnest(range(CAST(ceil(n / {BLOCK}) AS BIGINT))) AS blk FROM ln, range({DRAWS}) t(draw)),
 sta AS (SELECT *, least(CAST(floor(('0x' || substr(sha256('21|' || ticker || '|' || draw || '|' || blk), 1, 8))::BIGINT / 4294967295.0::DOUBLE * n) AS BIGINT), n - 1) AS start FROM bl),
 ix AS (SELECT ticker, draw, blk * {BLOCK} + off AS place, (start + off) % n AS pos, n FROM sta, range({BLOCK}) o(off)),
 dr AS (SELECT i.ticker, draw, regr_slope(y, x) AS slope FROM ix i JOIN xy USING (ticker, pos) WHERE place < i.n GROUP BY i.ticker, draw),
 ob AS (SELECT ticker, regr_slope(y, x) AS slope FROM xy GROUP BY ticker)
 SELECT ticker, round(any_value(o.slope), 4) AS slope, round(quantile_cont(d.slope, 0.025), 4) AS ci_low, round(quantile_cont(d.slope, 0.975), 4) AS ci_high,
  round(least(1.0, 2 * least((count(*) FILTER (WHERE d.slope <= 0) + 1) / (count(d.slope) + 1), (count(*) FILTER (WHERE d.slope >= 0) + 1) / (count(d.slope) + 1))), 6) AS p_two, count(d.slope) AS draws
 FROM dr d JOIN ob o USING (ticker) WHERE d.slope IS NOT NULL GROUP BY ticker""")
def bootstrap_slope(spark, sf_dir):
    """The slope of a day's move on a party's flow, with the interval and p of circular blocks; four blocks of rows at least."""
    p = _xy(spark, sf_dir)
    starts = resample.hashed_starts(p.where(F.col("n") >= 4 * BLOCK).select("ticker", "n").distinct(), ["ticker"], DRAWS, BLOCK, 21)
    found = resample.interval(resample.draw_values(starts, p, BLOCK, {"slope": resample.slope_of(F.col("y"), F.col("x"))}, ["ticker"]), "slope", ["ticker"])
    out = p.groupBy("ticker").agg(stats.slope("y", "x").alias("slope")).join(found, "ticker")
    return _r(out.withColumn("p_two", r6("p_two")), "slope", "ci_low", "ci_high", digits=4).drop("p_one")


@query(_XY + f""", bl AS (SELECT DISTINCT ticker, n, trial FROM xy, range(1, {TRIALS + 1}) t(trial)), bk AS (SELECT ticker, n, trial, unnest(range(CAST(ceil(n / {BLOCK}) AS BIGINT))) AS blk FROM bl),
 fi AS (SELECT *, coalesce(sum(least({BLOCK}, n - blk * {BLOCK})) OVER (PARTITION BY ticker, trial ORDER BY sha256('31|' || trial || '|' || blk), blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM bk),
 mv AS (SELECT x.ticker, trial, first + x.pos % {BLOCK} AS pos, x.x AS fake FROM xy x JOIN fi f ON x.ticker = f.ticker AND x.pos // {BLOCK} = f.blk)
 SELECT m.ticker, CAST(trial AS INTEGER) AS trial, round(regr_slope(y, fake), 4) AS slope FROM mv m JOIN xy USING (ticker, pos) GROUP BY m.ticker, trial""")
def placebo_slopes(spark, sf_dir):
    """Slopes on a flow whose blocks are shuffled, twenty times: how far chance alone goes."""
    p = resample.shuffled_blocks(_xy(spark, sf_dir).select("ticker", "pos", "n", "x", "y"), "x", BLOCK, TRIALS, 31, ["ticker"], "fake")
    return p.groupBy("ticker", "trial").agg(F.round(stats.slope("y", "fake"), 4).alias("slope"))
