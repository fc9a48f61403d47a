"""The feature table and the studies over all its conditions, features and horizons, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import features, performance, resample, stats, xsection
from ..operators.features import FEATURES, HORIZONS
from ..sources.derive import FLOWS, flows, table
from .registry import query, r6

S = Series()
BLOCK, DRAWS = 5, 500

#: Rows of a block that the placebo moves together.
PLACEBO_BLOCK = 5
_FEATURES = f"""WITH {FLOWS},
 fx0 AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS fx FROM lineitem GROUP BY 1), fx AS (SELECT date, fx FROM fx0 WHERE dayofyear(date) % 3 = 0 AND dayofyear(date) % 2 = 0),
 d0 AS (SELECT f.ticker, f.date, open, close, greatest(open, close) AS high, least(open, close) AS low, value_cents AS volume, p1 AS foreign_, p2 AS institution, p4 * 100.0::DOUBLE / nullif(value_cents, 0) AS holding_pct,
   open AS reported_close, p5 AS reported_volume, fx.fx AS fx FROM flow f ASOF LEFT JOIN fx ON f.date >= fx.date),
 d1 AS (SELECT *, nullif(volume, 0) AS v, CASE WHEN count(volume) OVER w20 = 20 THEN avg(CAST(volume AS DOUBLE)) OVER w20 END AS mean20,
   CASE WHEN count(high) OVER c = 20 THEN max(high) OVER c END AS dc_high, CASE WHEN count(low) OVER c = 20 THEN min(low) OVER c END AS dc_low FROM d0
   WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), c AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 d2 AS (SELECT *, foreign_ / CAST(v AS DOUBLE) AS foreign_flow_1d, CASE WHEN count(v) OVER w5 = 5 THEN sum(foreign_) OVER w5 / CAST(sum(v) OVER w5 AS DOUBLE) END AS foreign_flow_5d,
   CASE WHEN count(v) OVER w20 = 20 THEN sum(foreign_) OVER w20 / CAST(sum(v) OVER w20 AS DOUBLE) END AS foreign_flow_20d, CASE WHEN count(v) OVER w5 = 5 THEN sum(institution) OVER w5 / CAST(sum(v) OVER w5 AS DOUBLE) END AS institution_flow_5d,
   CASE WHEN count(foreign_) OVER w5 = 5 THEN CAST(sum(CAST(foreign_ > 0 AS INTEGER)) OVER w5 AS BIGINT) END AS foreign_positive_days_5d, holding_pct - lag(holding_pct, 5) OVER o AS foreign_holding_change_5d,
   close / nullif(lag(close) OVER o, 0) - 1 AS price_return_1d, volume / nullif(lag(mean20) OVER o, 0) AS volume_ratio_20d, fx / nullif(lag(fx) OVER o, 0) - 1 AS fx_return_1d, fx / nullif(lag(fx, 5) OVER o, 0) - 1 AS fx_return_5d,
   {", ".join(f"lead(close, {h}) OVER o / lead(open, 1) OVER o - 1 AS future_return_{h}d" for h in HORIZONS)}, coalesce(close > dc_high, false) AS long_entry, coalesce(close < dc_low, false) AS long_exit, dc_high IS NOT NULL AS live FROM d1
   WINDOW o AS (PARTITION BY ticker ORDER BY date), w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 d3 AS (SELECT *, CASE WHEN live AND long_entry AND NOT long_exit THEN 1 WHEN live AND long_exit AND NOT long_entry THEN 0 END AS st, sum(CASE WHEN live AND long_entry AND long_exit THEN 1 ELSE 0 END) OVER o AS tn FROM d2 WINDOW o AS (PARTITION BY ticker ORDER BY date)),
 d4 AS (SELECT *, CAST(CASE WHEN live THEN (coalesce(last_value(st IGNORE NULLS) OVER o, 0) + tn - coalesce(last_value(CASE WHEN st IS NOT NULL THEN tn END IGNORE NULLS) OVER o, 0)) % 2 ELSE 0 END AS INTEGER) AS position,
   coalesce(foreign_flow_5d > 0 AND foreign_positive_days_5d >= 3, false) AS foreign_signal FROM d3 WINDOW o AS (PARTITION BY ticker ORDER BY date)),
 pb AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY ticker) AS rows_ FROM d4),
 bk AS (SELECT ticker, rows_, list_sum(list_transform(string_split(ticker, ''), lambda c: ascii(c))) AS seed, unnest(range(CAST(ceil(rows_ / {PLACEBO_BLOCK}) AS BIGINT))) AS blk FROM (SELECT DISTINCT ticker, rows_ FROM pb)),
 mb AS (SELECT *, coalesce(sum(least({PLACEBO_BLOCK}, rows_ - blk * {PLACEBO_BLOCK})) OVER (PARTITION BY ticker ORDER BY sha256(seed || '|1|' || blk), blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM bk),
 ml AS (SELECT p.ticker, first + place % {PLACEBO_BLOCK} AS place, foreign_signal AS placebo_signal FROM pb p JOIN mb m ON p.ticker = m.ticker AND p.place // {PLACEBO_BLOCK} = m.blk),
 ft AS (SELECT pb.* EXCLUDE (place, rows_), placebo_signal, foreign_signal AND coalesce(fx_return_5d < 0, false) AS foreign_fx_signal, foreign_signal AND position = 1 AS combined_signal, reported_close / close - 1 AS close_mismatch_pct, reported_volume / CAST(v AS DOUBLE) - 1 AS volume_mismatch_pct FROM pb JOIN ml USING (ticker, place))"""

#: Conditions as SQL that both engines read; all: the baseline.
CONDITIONS = {
    "all": "true", "bought_today": "{foreign} > 0", "bought_5d": "foreign_flow_5d > 0", "bought_3_of_5": "foreign_positive_days_5d >= 3", "holding_up": "foreign_holding_change_5d > 0", "fx_down": "fx_return_5d < 0",
    "bought_fx_down": "foreign_signal AND fx_return_5d < 0", "in_channel": "position = 1", "channel_and_bought": "combined_signal",
}


def built_features(spark, sf_dir):
    f = flows(spark, sf_dir)
    prices = f.select("ticker", "date", "open", "close", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), F.col("value_cents").alias("volume"))
    own = f.select("ticker", "date", F.col("p1").alias("foreign"), F.col("p2").alias("institution"), F.try_divide(F.col("p4") * 100.0, F.col("value_cents")).alias("holding_pct"), F.col("open").alias("reported_close"), F.col("p5").alias("reported_volume"))
    fx = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.max("l_extendedprice").alias("fx"))
    fx = fx.where(F.dayofyear("date") % 3 == 0).withColumn("fx", F.when(F.dayofyear("date") % 2 == 0, F.col("fx"))).withColumn("ticker", F.explode(F.array(F.lit("even"), F.lit("odd"))))
    return features.with_placebo(features.feature_table(prices, own, fx, S), "foreign_signal", "placebo_signal", PLACEBO_BLOCK, S)


_SHOWN = [*FEATURES, *(f"future_return_{h}d" for h in HORIZONS), "close_mismatch_pct", "volume_mismatch_pct"]


@query(_FEATURES + " SELECT ticker, date, fx, position, foreign_signal, foreign_fx_signal, placebo_signal, combined_signal, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _SHOWN) + " FROM ft", "date")
def feature_build(spark, sf_dir):
    shown = [r6(F.col(c).cast("double")).alias(c) for c in _SHOWN]
    return built_features(spark, sf_dir).select("ticker", "date", "fx", "position", "foreign_signal", "foreign_fx_signal", "placebo_signal", "combined_signal", *shown)


def _clip(c):
    """Returns ahead are clipped to one, since the derived prices jump as no market's do."""
    return F.when(F.col(c).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))))


_AHEAD = ", ".join(f"CASE WHEN future_return_{h}d IS NOT NULL THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, future_return_{h}d)) END AS r{h}" for h in HORIZONS)
_HELD = ", ".join(f"coalesce({c.format(foreign='foreign_')}, false) AS c_{k}" for k, c in CONDITIONS.items())
_CASES = [(c, h) for c in CONDITIONS for h in HORIZONS]


def _long(value):
    return " UNION ALL ".join(f"SELECT ticker, {value.format(c=c, h=h)}, '{c}' AS condition, {h} AS horizon FROM cf" for c, h in _CASES)


@query(_FEATURES + f""", cf AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n, {_AHEAD}, {_HELD} FROM ft),
 bl AS (SELECT ticker, n, draw, unnest(range(CAST(ceil(n / {BLOCK}) AS BIGINT))) AS blk FROM (SELECT DISTINCT ticker, n FROM cf), range({DRAWS}) t(draw)),
 sta AS (SELECT *, least(CAST(floor(('0x' || substr(sha256('41|' || ticker || '|' || draw || '|' || blk), 1, 8))::BIGINT / 4294967295.0::DOUBLE * n) AS BIGINT), n - 1) AS start FROM bl),
 ix AS (SELECT ticker, draw, blk * {BLOCK} + off AS place, (start + off) % n AS pos, n FROM sta, range({BLOCK}) o(off)),
 dr AS (SELECT i.ticker, draw, {", ".join(f"avg(r{h}) FILTER (WHERE c_{c}) - avg(r{h}) AS e_{c}_{h}" for c, h in _CASES)} FROM ix i JOIN cf USING (ticker, pos) WHERE place < i.n GROUP BY i.ticker, draw),
 dl AS ({" UNION ALL ".join(f"SELECT ticker, e_{c}_{h} AS e, '{c}' AS condition, {h} AS horizon FROM dr" for c, h in _CASES)}),
 pv AS (SELECT ticker, condition, horizon, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, (count(*) FILTER (WHERE e <= 0) + 1) / (count(e) + 1) AS p FROM dl WHERE e IS NOT NULL GROUP BY ticker, condition, horizon),
 ob AS ({_long("c_{c} AS held, r{h} AS r")}), oa AS (SELECT ticker, condition, horizon, count(r) FILTER (WHERE held) AS n, avg(r) FILTER (WHERE held) AS mean, quantile_cont(r, 0.5) FILTER (WHERE held) AS median,
   avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE held AND r IS NOT NULL) AS win_rate, avg(r) FILTER (WHERE held) - avg(r) AS excess FROM ob GROUP BY ticker, condition, horizon),
 jo AS (SELECT oa.*, lo, hi, round(p, 9) AS p, condition <> 'all' AS tested FROM oa LEFT JOIN pv USING (ticker, condition, horizon)),
 rk AS (SELECT *, p * count(p) OVER (PARTITION BY tested) / row_number() OVER (PARTITION BY tested, p IS NULL ORDER BY p, ticker, condition, horizon) AS q0 FROM jo)
 SELECT ticker, condition, horizon, n, round(mean, 6) AS mean, round(median, 6) AS median, round(win_rate, 6) AS win_rate, round(excess, 6) AS excess, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p, 6) AS p,
   CASE WHEN tested AND p IS NOT NULL THEN round(least(1.0, min(q0) OVER (PARTITION BY tested, p IS NULL ORDER BY p, ticker, condition, horizon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) END AS q FROM rk""")
def condition_study_whole(spark, sf_dir):
    """Nine conditions by five horizons: their returns, the excess over all days with its interval and p of block draws, and q over all but the baseline.

    A draw serves all conditions and horizons of a ticker: one join, one grouping.
    """
    f = built_features(spark, sf_dir).select("ticker", "date", *[_clip(f"future_return_{h}d").alias(f"r{h}") for h in HORIZONS], *[F.coalesce(F.expr(c.format(foreign="foreign")), F.lit(False)).alias(f"c_{k}") for k, c in CONDITIONS.items()])
    f = resample.positioned(f, "date", "ticker")
    starts = resample.hashed_starts(f.select("ticker", "n").distinct(), ["ticker"], DRAWS, BLOCK, 41)
    draws = resample.draw_values(starts, f, BLOCK, {f"e_{c}_{h}": resample.excess(F.col(f"r{h}"), F.col(f"c_{c}")) for c, h in _CASES}, ["ticker"])
    cases = lambda value: F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(h).alias("horizon"), *value(c, h)) for c, h in _CASES])).alias("s")
    keys = ["ticker", "condition", "horizon"]
    p = resample.interval(draws.select("ticker", cases(lambda c, h: [F.col(f"e_{c}_{h}").alias("e")])).select("ticker", "s.*"), "e", keys).select(*keys, "ci_low", "ci_high", F.round("p_one", 9).alias("p"))
    rows = f.select("ticker", cases(lambda c, h: [F.col(f"c_{c}").alias("held"), F.col(f"r{h}").alias("r")])).select("ticker", "s.*").withColumn("x", F.when(F.col("held"), F.col("r")))
    found = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.avg(F.when(F.col("x").isNotNull(), (F.col("x") > 0).cast("double"))).alias("win_rate"), (F.avg("x") - F.avg("r")).alias("excess"))
    out = found.join(p, keys, "left").withColumn("tested", F.when(F.col("condition") != "all", F.col("p")))
    out = stats.false_discovery(out, "tested", "q")
    return out.select(*keys, "n", *[r6(c).alias(c) for c in ("mean", "median", "win_rate", "excess", "ci_low", "ci_high", "p", "q")])


@query(_FEATURES + f""", ok AS (SELECT *, {_AHEAD} FROM ft WHERE foreign_flow_5d IS NOT NULL), q AS (SELECT ticker, list_distinct([{", ".join(f"quantile_cont(foreign_flow_5d, {k / 5})" for k in range(6))}]) AS edges, count(DISTINCT foreign_flow_5d) AS n FROM ok GROUP BY ticker),
 b AS (SELECT ok.*, CAST(greatest(len(list_filter(edges, lambda e: e < foreign_flow_5d)) - 1, 0) + 1 AS INTEGER) AS bin FROM ok JOIN q USING (ticker) WHERE q.n >= 5),
 lg AS ({" UNION ALL ".join(f"SELECT ticker, bin, {h} AS horizon, r{h} AS r FROM b" for h in HORIZONS)})
 SELECT ticker, bin, horizon, count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE r IS NOT NULL), 6) AS win_rate FROM lg GROUP BY ticker, bin, horizon""")
def quantile_study_whole(spark, sf_dir):
    f = xsection.quantile_bins(built_features(spark, sf_dir), "foreign_flow_5d", ["ticker"], 5)
    lg = f.select("ticker", "bin", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), _clip(f"future_return_{h}d").alias("r")) for h in HORIZONS])).alias("s")).select("ticker", "bin", "s.*")
    return lg.groupBy("ticker", "bin", "horizon").agg(F.count("r").alias("n"), r6(F.avg("r")).alias("mean"), r6(F.median("r")).alias("median"), r6(F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double")))).alias("win_rate"))


@query(_FEATURES + f""", ah AS (SELECT ticker, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)}, {_AHEAD} FROM ft), lg AS ({" UNION ALL ".join(f"SELECT ticker, '{c}' AS feature, {h} AS horizon, {c} AS x, r{h} AS r FROM ah WHERE {c} IS NOT NULL AND r{h} IS NOT NULL" for c in FEATURES for h in HORIZONS)}),
 rk AS (SELECT *, rank() OVER (PARTITION BY ticker, feature, horizon ORDER BY x) + (count(*) OVER (PARTITION BY ticker, feature, horizon, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY ticker, feature, horizon ORDER BY r) + (count(*) OVER (PARTITION BY ticker, feature, horizon, r) - 1) / 2 AS ry FROM lg)
 SELECT ticker, feature, horizon, count(*) AS n, round(corr(x, r), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM rk GROUP BY ticker, feature, horizon""")
def correlation_study_whole(spark, sf_dir):
    """Ten features by five horizons, strongest rank correlation first."""
    f = built_features(spark, sf_dir).select("ticker", *[F.col(c).cast("double").alias(c) for c in FEATURES], *[_clip(f"future_return_{h}d").alias(f"r{h}") for h in HORIZONS])
    lg = f.unpivot(["ticker", *[f"r{h}" for h in HORIZONS]], list(FEATURES), "feature", "x")
    lg = lg.select("ticker", "feature", "x", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"r{h}").alias("r")) for h in HORIZONS])).alias("s")).select("ticker", "feature", "x", "s.*").where("x IS NOT NULL AND r IS NOT NULL")
    keys = ["ticker", "feature", "horizon"]
    rk = lg.select("*", xsection.average_rank("x", keys).alias("rx"), xsection.average_rank("r", keys).alias("ry"))
    out = rk.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(stats.correlation("x", "r"), 5).alias("pearson"), F.round(stats.correlation("rx", "ry"), 5).alias("spearman"))
    return out.orderBy(F.desc("spearman"), *keys)


#: The strategies of the matrix as SQL that both engines read.
STRATEGIES = {
    "every_day": "true", "bought_today": "{foreign} > 0", "bought_5d": "foreign_flow_5d > 0", "bought_3_of_5": "foreign_signal", "bought_fx_down": "foreign_fx_signal", "placebo": "placebo_signal",
    "in_channel": "position = 1", "channel_and_bought": "combined_signal",
}
MULTIPLES, BPS = (1.0, 1.5, 2.0), 30.0
_PERFORMANCE = ["total_return", "cagr", "mdd", "sharpe", "win_rate", "avg_active_return", "cvar_95"]
_SIGNALS = ", ".join(f"coalesce({c.format(foreign='foreign_')}, false) AS s_{k}" for k, c in STRATEGIES.items())
_MATRIX = " UNION ALL ".join(f"SELECT ticker, date, ret, '{k}' AS strategy, lag(s_{k}, 1, false) OVER (PARTITION BY ticker ORDER BY date) AS held FROM sg" for k in STRATEGIES)


@query(_FEATURES + f""", sg AS (SELECT ticker, date, 0.02::DOUBLE * (close - open) / (close + open) AS ret, {_SIGNALS} FROM ft), lg AS ({_MATRIX}),
 ea AS (SELECT ticker, date, strategy, cost_multiplier, held, CASE WHEN held THEN ret - cost_multiplier * {BPS}::DOUBLE / 10000 ELSE 0 END AS r FROM lg, (SELECT unnest({list(MULTIPLES)}::DOUBLE[]) AS cost_multiplier)),
 ev AS (SELECT ticker, date, strategy, cost_multiplier, held, r FROM ea
  UNION ALL SELECT 'portfolio', date, strategy, cost_multiplier, bool_or(held), sum(r) / (SELECT count(DISTINCT ticker) FROM ft) FROM ea GROUP BY date, strategy, cost_multiplier),
 eq AS (SELECT *, CASE WHEN held THEN r END AS a, exp(sum(ln(1 + r)) OVER (PARTITION BY ticker, strategy, cost_multiplier ORDER BY date)) AS e FROM ev),
 dd AS (SELECT *, e / max(e) OVER (PARTITION BY ticker, strategy, cost_multiplier ORDER BY date) - 1 AS d, quantile_cont(a, 0.05) OVER (PARTITION BY ticker, strategy, cost_multiplier) AS q FROM eq),
 pf AS (SELECT ticker, strategy, cost_multiplier, max_by(e, date) - 1 AS total_return, pow(max_by(e, date), 1 / greatest(datediff('day', min(date), max(date)) / 365.25::DOUBLE, 1 / 252.0::DOUBLE)) - 1 AS cagr, min(d) AS mdd,
   avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0::DOUBLE) AS sharpe, count(a) AS active_days, avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE a IS NOT NULL) AS win_rate, avg(a) AS avg_active_return,
   avg(a) FILTER (WHERE a <= q + 1e-12) AS cvar_95 FROM dd GROUP BY ALL),
 il AS (SELECT ticker, strategy, cost_multiplier, a, sum(CASE WHEN a < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker, strategy, cost_multiplier ORDER BY date) AS isl FROM eq WHERE held),
 sk AS (SELECT ticker, strategy, cost_multiplier, max(c) AS streak FROM (SELECT ticker, strategy, cost_multiplier, isl, count(*) FILTER (WHERE a < 0) AS c FROM il GROUP BY ALL) GROUP BY ALL)
 SELECT ticker, strategy, cost_multiplier, active_days, coalesce(streak, 0) AS max_losing_streak, {", ".join(f"round({c}, 6) AS {c}" for c in _PERFORMANCE)} FROM pf LEFT JOIN sk USING (ticker, strategy, cost_multiplier)""")
def strategy_matrix_whole(spark, sf_dir):
    """Eight strategies by tickers and the portfolio by three cost multiples; the returns are tame ones, as the derived prices jump."""
    f = built_features(spark, sf_dir)
    tame = 0.02 * (F.col("close") - F.col("open")) / (F.col("close") + F.col("open"))
    out = performance.strategy_matrix(f, {k: F.expr(c.format(foreign="foreign")) for k, c in STRATEGIES.items()}, tame, BPS, list(MULTIPLES), S)
    return out.select("ticker", "strategy", "cost_multiplier", "active_days", "max_losing_streak", *[r6(c).alias(c) for c in _PERFORMANCE])
