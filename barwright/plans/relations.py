"""Relations of flows, gates and volatility with what follows, with all draws and rows of the survey; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import resample, stats
from ..sources.derive import BARS, FLOWS, bars, flows
from .registry import query, r6
from .studies import _GATES, GATES, WHOLE, gate_sides, gates

S = Series()
BLOCK, ROLLING, HORIZONS = 5, 250, (20, 60, 120, 250)
PARTIES = [f"p{i}" for i in range(1, 6)]
FEATURES = ["short_by_long", "vol_of_vol", "below_high", "busy", "turnover_growth"]


def _index_sql(rows: str, seed: int) -> str:
    """The table ix: of every draw of every ticker of `rows`, the position that stands at each place."""
    return f""", ln AS (SELECT DISTINCT ticker, n FROM {rows}),
 bl AS (SELECT ticker, n, draw, unnest(range(CAST(ceil(n / {BLOCK}) AS BIGINT))) AS blk FROM ln, range({WHOLE}) t(draw)),
 un AS (SELECT *, ('0x' || substr(sha256('{seed}|' || ticker || '|' || draw || '|' || blk), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS u FROM bl),
 sta AS (SELECT *, least(CAST(floor(u * n) AS BIGINT), n - 1) AS start FROM un),
 ix AS (SELECT ticker, draw, blk * {BLOCK} + off AS place, (start + off) % n AS pos, n FROM sta, range({BLOCK}) o(off))"""


def _p_two_sql(v: str) -> str:
    below, above = (f"(count(*) FILTER (WHERE {v} {sign} 0) + 1) / (count({v}) + 1)" for sign in ("<=", ">="))
    return f"round(least(1.0, 2 * least({below}, {above})), 9)"


def _q_sql(p: str, family: str) -> tuple[str, str]:
    """Benjamini-Hochberg over a family: the value by rank, and the least of it from a row on (of the column raw_<p>)."""
    raw = f"{p} * count({p}) OVER (PARTITION BY {family}) / row_number() OVER (PARTITION BY {family}, {p} IS NULL ORDER BY {p}) AS raw_{p}"
    frame = f"PARTITION BY {family}, {p} IS NULL ORDER BY {p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return raw, f"CASE WHEN {p} IS NOT NULL THEN round(least(1.0, min(raw_{p}) OVER ({frame})), 6) END"


def _starts(series, seed):
    return resample.hashed_starts(series.select("ticker", "n").distinct(), ["ticker"], WHOLE, BLOCK, seed)


# Flows of parties and the next day's move.

_NEXT = f"""WITH {FLOWS}, nx AS (SELECT ticker, date, close / open - 1 AS ret, lead(close) OVER w / close - 1 AS next_close, lead(close) OVER w / lead(open) OVER w - 1 AS next_open,
  {", ".join(f"{p} / CAST(value_cents AS DOUBLE) AS x_{p}" for p in PARTIES)} FROM flow WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def _next(spark, sf_dir):
    after = lambda c: F.lead(c).over(S.rows)
    return flows(spark, sf_dir).select(
        "ticker", "date", (F.col("close") / F.col("open") - 1).alias("ret"), (after("close") / F.col("close") - 1).alias("next_close"), (after("close") / after("open") - 1).alias("next_open"),
        *[(F.col(p) / F.col("value_cents")).alias(f"x_{p}") for p in PARTIES],
    )


def _rolling_sql(y: str, name: str) -> str:
    x, y = f"CASE WHEN {y} IS NOT NULL THEN x_p1 END", f"CASE WHEN x_p1 IS NOT NULL THEN {y} END"
    spread = f"nullif(stddev_pop({x}) OVER w * stddev_pop({y}) OVER w, 0)"
    return f"CASE WHEN count({x}) OVER w = {ROLLING} THEN round(covar_pop({x}, {y}) OVER w / {spread}, 5) END AS {name}"


_ROLLING = {"same_day": "ret", "next_by_close": "next_close", "next_by_open": "next_open"}


@query(_NEXT + f""", rl AS (SELECT ticker, date, {", ".join(_rolling_sql(y, k) for k, y in _ROLLING.items())} FROM nx
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {ROLLING - 1} PRECEDING AND CURRENT ROW))
 SELECT * FROM rl WHERE same_day IS NOT NULL""", "date")
def rolling_relations(spark, sf_dir):
    """Correlations over 250 rows of a party's flow with the day's move, the next close and the next day's own move."""
    out = _next(spark, sf_dir).select("ticker", "date", *[F.round(S.correlation("x_p1", y, ROLLING), 5).alias(k) for k, y in _ROLLING.items()])
    return out.where("same_day IS NOT NULL")


_RAW, _Q = _q_sql("p_two", "ticker")


@query(_NEXT + ", xy AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM nx)" + _index_sql("xy", 51) + f""",
 dr AS (SELECT i.ticker, draw, {", ".join(f"regr_slope(next_open, x_{p}) AS {p}" for p in PARTIES)} FROM ix i JOIN xy USING (ticker, pos) WHERE place < i.n GROUP BY i.ticker, draw),
 dl AS (UNPIVOT dr ON {", ".join(PARTIES)} INTO NAME party VALUE slope),
 pv AS (SELECT ticker, party, quantile_cont(slope, 0.025) AS lo, quantile_cont(slope, 0.975) AS hi, {_p_two_sql("slope")} AS p_two FROM dl GROUP BY ticker, party),
 ow AS (SELECT ticker, {", ".join(f"regr_slope(next_open, x_{p}) AS {p}" for p in PARTIES)} FROM nx GROUP BY ticker),
 ob AS (UNPIVOT ow ON {", ".join(PARTIES)} INTO NAME party VALUE slope), jo AS (SELECT *, {_RAW} FROM ob JOIN pv USING (ticker, party))
 SELECT ticker, party, round(slope, 4) AS slope, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, round(p_two, 6) AS p_two, {_Q} AS q FROM jo""")
def party_slopes(spark, sf_dir):
    """The slope of the next day's move on each party's flow, its interval and p of block draws, and q over the parties.

    A draw serves all parties of a ticker.
    """
    p = resample.positioned(_next(spark, sf_dir), "date", "ticker")
    slopes = {c: resample.slope_of(F.col("next_open"), F.col(f"x_{c}")) for c in PARTIES}
    per_draw = resample.draw_values(_starts(p, 51), p, BLOCK, slopes, ["ticker"]).unpivot(["ticker", "draw"], PARTIES, "party", "slope")
    found = resample.interval(per_draw, "slope", ["ticker", "party"]).withColumn("p_two", F.round("p_two", 9))
    own = resample.row_values(p, slopes, ["ticker"]).unpivot(["ticker"], PARTIES, "party", "slope")
    out = stats.false_discovery(own.join(found, ["ticker", "party"]), "p_two", "q", ["ticker"])
    return out.select("ticker", "party", *[F.round(c, 4).alias(c) for c in ("slope", "ci_low", "ci_high")], r6("p_two").alias("p_two"), r6("q").alias("q"))


def _interaction_sql(rows: str, keys: str) -> str:
    above = "(n * (aa * by_ - ay * ab) - a * (a * by_ - ay * b) + y * (a * ab - aa * b))"
    below = "(n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b))"
    sums = "count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_"
    return f"SELECT {keys}, {above} / nullif({below}, 0) AS v FROM (SELECT {keys}, {sums} FROM {rows} GROUP BY {keys})"


@query(_NEXT + f""", ok AS (SELECT ticker, date, x_p1, next_open AS y, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM nx WHERE next_open IS NOT NULL),
 xy AS (SELECT ticker, pos, n, x_p1 AS a, x_p1 * (pos / (n - 1.0::DOUBLE)) AS b, y FROM ok){_index_sql("xy", 52)},
 dr AS (SELECT i.ticker, draw, a, b, y FROM ix i JOIN xy USING (ticker, pos) WHERE place < i.n), dv AS ({_interaction_sql("dr", "ticker, draw")}),
 pv AS (SELECT ticker, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, {_p_two_sql("v")} AS p_two FROM dv WHERE v IS NOT NULL GROUP BY ticker)
 SELECT ticker, round(v, 4) AS interaction, n, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, round(p_two, 6) AS p_two FROM ({_interaction_sql("xy", "ticker")}) JOIN pv USING (ticker) JOIN ln USING (ticker)""")
def interaction_study(spark, sf_dir):
    """Whether a party's flow says more of the next day's move as time goes on: the coefficient, its interval and p of block draws of whole rows."""
    p = resample.positioned(stats.with_time(_next(spark, sf_dir), "next_open", "x_p1", ["ticker"], "date"), "date", "ticker")
    own = {"interaction": resample.interaction_of(F.col("a"), F.col("b"), F.col("y"))}
    found = resample.interval(resample.draw_values(_starts(p, 52), p, BLOCK, own, ["ticker"]), "interaction", ["ticker"])
    out = resample.row_values(p, own, ["ticker"]).join(found, "ticker").join(p.select("ticker", "n").distinct(), "ticker")
    return out.select("ticker", "n", *[F.round(c, 4).alias(c) for c in ("interaction", "ci_low", "ci_high")], r6("p_two").alias("p_two"))


# Gates on the days held: a day is held where the day before it rose.

_GATE_RAW, _GATE_Q = zip(_q_sql("mean_p", "ticker"), _q_sql("tail_p", "ticker"), strict=True)


def _gate_long(rows: str, keys: str) -> str:
    return f"UNPIVOT (SELECT {keys}, ret, {', '.join(GATES)} FROM {rows}) ON {', '.join(GATES)} INTO NAME gate VALUE up"


@query(_GATES + f""", ac AS (SELECT *, coalesce(lag(ret) OVER (PARTITION BY ticker ORDER BY date) > 0, false) AS active FROM gts),
 hd AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM ac WHERE active){_index_sql("hd", 53)},
 dw AS (SELECT i.ticker, draw, ret, {", ".join(GATES)} FROM ix i JOIN hd USING (ticker, pos) WHERE place < i.n UNION ALL SELECT ticker, -1, ret, {", ".join(GATES)} FROM hd),
 lg AS ({_gate_long("dw", "ticker, draw")}), cu AS (SELECT ticker, draw, gate, up, quantile_cont(ret, 0.05) AS q, count(*) AS n FROM lg GROUP BY ALL),
 sd AS (SELECT ticker, draw, gate, up, max(n) AS n, avg(ret) AS mean, avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END) AS losing, avg(ret) FILTER (WHERE ret <= q + 1e-12) AS tail FROM lg JOIN cu USING (ticker, draw, gate, up) GROUP BY ticker, draw, gate, up),
 wd AS (SELECT ticker, draw, gate, {", ".join(f"max({c}) FILTER (WHERE {u} up) AS {s}_{c}" for c in ("n", "mean", "losing", "tail") for s, u in (("risky", ""), ("clear", "NOT")))} FROM sd GROUP BY ticker, draw, gate),
 df AS (SELECT *, risky_mean - clear_mean AS md, CASE WHEN risky_n >= 5 AND clear_n >= 5 THEN risky_tail - clear_tail END AS td FROM wd),
 pv AS (SELECT ticker, gate, {", ".join(f"quantile_cont({v}, 0.025) AS {k}_low, quantile_cont({v}, 0.975) AS {k}_high, CASE WHEN count({v}) > 0 THEN {_p_two_sql(v)} END AS {k}_p" for k, v in (("mean", "md"), ("tail", "td")))} FROM df WHERE draw >= 0 GROUP BY ticker, gate),
 jo AS (SELECT df.*, pv.* EXCLUDE (ticker, gate), {", ".join(_GATE_RAW)} FROM df LEFT JOIN pv USING (ticker, gate) WHERE draw = -1)
 SELECT ticker, gate, coalesce(risky_n, 0) AS flagged, coalesce(clear_n, 0) AS clear, {", ".join(f"round({c}, 6) AS {c}" for c in ("risky_mean", "clear_mean", "mean_low", "mean_high", "mean_p", "risky_tail", "clear_tail", "tail_low", "tail_high", "tail_p", "risky_losing", "clear_losing"))},
  round(md, 6) AS mean_difference, round(td, 6) AS tail_difference, {_GATE_Q[0]} AS mean_q, {_GATE_Q[1]} AS tail_q FROM jo""")
def gate_effects_whole(spark, sf_dir):
    """Of each gate, on the days held: mean, tail and share of losses while it is up or not, the differences with intervals and p of block draws, and q over the gates.

    A tail difference wants five rows on each side. The rows themselves go along as draw -1, so that one grouping serves both;
    gates stand side by side, so that a draw's rows aren't repeated for each.
    """
    g = gates(spark, sf_dir).withColumn("active", F.coalesce(F.lag("ret").over(S.rows) > 0, F.lit(False))).where("active")
    p = resample.positioned(g, "date", "ticker").select("ticker", "pos", "n", "ret", *GATES)
    sides = gate_sides()
    drawn = resample.draw_lists(_starts(p, 53), p, BLOCK, sides, ["ticker"])
    whole = p.groupBy("ticker").agg(F.lit(-1).cast("long").alias("draw"), *[F.collect_list(v).alias(k) for k, v in sides.items()])
    facts = {
        "n": lambda v: F.nullif(F.size(v), F.lit(0)), "mean": resample.list_mean, "losing": lambda v: F.size(F.filter(v, lambda x: x < 0)) / F.nullif(F.size(v), F.lit(0)), "tail": resample.list_tail,
    }
    made = [F.struct(F.lit(g).alias("gate"), *[f(F.col(f"{'up' if s == 'risky' else 'no'}_{g}")).alias(f"{s}_{k}") for k, f in facts.items() for s in ("risky", "clear")]) for g in GATES]
    wide = drawn.unionByName(whole).select("ticker", "draw", F.explode(F.array(*made)).alias("f")).select("ticker", "draw", "f.*")
    enough = (F.col("risky_n") >= 5) & (F.col("clear_n") >= 5)
    wide = wide.withColumn("mean_difference", F.col("risky_mean") - F.col("clear_mean")).withColumn("tail_difference", F.when(enough, F.col("risky_tail") - F.col("clear_tail")))
    out = wide.where("draw = -1").drop("draw")
    for k in ("mean", "tail"):
        found = resample.interval(wide.where("draw >= 0"), f"{k}_difference", ["ticker", "gate"])
        found = found.select("ticker", "gate", F.col("ci_low").alias(f"{k}_low"), F.col("ci_high").alias(f"{k}_high"), F.round("p_two", 9).alias(f"{k}_p"))
        out = stats.false_discovery(out.join(found, ["ticker", "gate"], "left"), f"{k}_p", f"{k}_q", ["ticker"])
    counts = [F.coalesce("risky_n", F.lit(0)).alias("flagged"), F.coalesce("clear_n", F.lit(0)).alias("clear")]
    return out.select("ticker", "gate", *counts, *[r6(c).alias(c) for c in out.columns if c not in ("ticker", "gate", "risky_n", "clear_n")])


# Volatility: ranks, horizons, and what features add.


@query(f"""WITH {BARS}, h AS (SELECT ticker, date, close, list(close) OVER w AS held, count(close) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {ROLLING - 1} PRECEDING AND CURRENT ROW))
 SELECT ticker, date, CASE WHEN n = {ROLLING} THEN round((len(list_filter(held, lambda v: v < close)) + (len(list_filter(held, lambda v: v = close)) + 1) / 2) / {ROLLING}, 6) END AS trailing_rank FROM h""", "date")
def trailing_rank_whole(spark, sf_dir):
    """The share of the last 250 closes that a close ranks above. A row's list is of 250 values, so memory is bounded and work is rows times 250."""
    return bars(spark, sf_dir).select("ticker", "date", r6(S.trailing_rank("close", ROLLING)).alias("trailing_rank"))


def _sd_sql(h: int) -> str:
    back, ahead = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)", f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(ret) {back} = {h} THEN stddev_samp(ret) {back} END AS b{h}, CASE WHEN count(ret) {ahead} = {h} THEN stddev_samp(ret) {ahead} END AS a{h}"


_SDS = f"WITH {BARS}, sd AS (SELECT *, {', '.join(map(_sd_sql, HORIZONS))} FROM bars)"


def _sds(spark, sf_dir):
    sides = {f"{k}{h}": S.over(F.stddev_samp, "ret", *((-(h - 1), 0) if k == "b" else (1, h))) for h in HORIZONS for k in "ba"}
    return bars(spark, sf_dir).withColumns(sides)


@query(_SDS + " " + " UNION ALL ".join(f"SELECT ticker, {h} AS horizon, regr_count(a{h}, b{h}) AS n, round(regr_r2(a{h}, b{h}), 6) AS r2 FROM sd GROUP BY ticker" for h in HORIZONS))
def horizon_r2_whole(spark, sf_dir):
    """R2 of the volatility of the next h rows on that of the last h, for four horizons."""
    facts = [F.struct(F.lit(h).alias("horizon"), F.count(F.when(F.col(f"b{h}").isNotNull(), F.col(f"a{h}"))).alias("n"), r6(F.pow(stats.correlation(f"a{h}", f"b{h}"), 2)).alias("r2")) for h in HORIZONS]
    return _sds(spark, sf_dir).groupBy("ticker").agg(F.array(*facts).alias("f")).select("ticker", F.explode("f").alias("f")).select("ticker", "f.*")


@query(_SDS + f""", v AS (SELECT *, b20 / nullif(b60, 0) AS short_by_long, CASE WHEN count(b60) OVER s = 60 THEN stddev_samp(b60) OVER s END AS vol_of_vol,
  CASE WHEN count(close) OVER y = 250 THEN close / max(close) OVER y - 1 END AS below_high, CASE WHEN count(volume) OVER s = 60 THEN volume / avg(volume) OVER s END AS busy,
  value_cents / nullif(CAST(lag(value_cents, 20) OVER o AS DOUBLE), 0) - 1 AS turnover_growth FROM sd
  WINDOW o AS (PARTITION BY ticker ORDER BY date), s AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), y AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)),
 lg AS (UNPIVOT (SELECT ticker, a60, b60, {", ".join(FEATURES)} FROM v) ON {", ".join(FEATURES)} INTO NAME feature VALUE x),
 rs AS (SELECT ticker, feature, count(*) AS n, corr(a60, b60) AS r1, corr(a60, x) AS r2, corr(b60, x) AS r12 FROM lg WHERE a60 IS NOT NULL AND b60 IS NOT NULL GROUP BY ticker, feature)
 SELECT ticker, feature, n, round(r1 * r1, 5) AS r2, round((r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / nullif(1 - r12 * r12, 0) - r1 * r1, 5) AS added FROM rs""")
def feature_increments(spark, sf_dir):
    """What each feature adds to trailing volatility in saying the next 60 rows' volatility."""
    ratio = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    made = {
        "short_by_long": ratio(F.col("b20"), F.col("b60")), "vol_of_vol": S.over(F.stddev_samp, "b60", -59, 0), "below_high": F.col("close") / S.over(F.max, "close", -249, 0) - 1,
        "busy": F.col("volume") / S.over(F.avg, "volume", -59, 0), "turnover_growth": S.change("value_cents", 20),
    }
    lg = _sds(spark, sf_dir).select("ticker", "a60", "b60", *[made[c].alias(c) for c in FEATURES]).unpivot(["ticker", "a60", "b60"], FEATURES, "feature", "x")
    lg = lg.where("a60 IS NOT NULL AND b60 IS NOT NULL AND x IS NOT NULL")
    r2, added = stats.added_r2("a60", "b60", "x")
    return lg.groupBy("ticker", "feature").agg(F.count(F.lit(1)).alias("n"), F.round(r2, 5).alias("r2"), F.round(added, 5).alias("added"))
