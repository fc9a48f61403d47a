"""Studies: conditions, quantiles, correlations, gates, walk-forward folds, resampling and false discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import accounting, resample, stats, xsection
from ..session import kept
from ..sources.derive import BARS, FLOWS, bars, flows
from .panels import _PARTY, _parties
from .registry import query, r6

S = Series()

# The condition study: conditions by horizons, against the mean of all rows.

_FWD = f"""WITH {BARS}, fw AS (SELECT ticker, date, open, close, ret, volume, lead(close, 1) OVER w / lead(open, 1) OVER w - 1 AS h1, lead(close, 5) OVER w / lead(open, 1) OVER w - 1 AS h5,
  close > lag(close) OVER w AS rising, volume > 1 AS busy FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 st AS (SELECT ticker, date, condition, horizon, CASE WHEN CASE horizon WHEN 1 THEN h1 ELSE h5 END IS NOT NULL THEN greatest(-1.0, least(1.0, CASE horizon WHEN 1 THEN h1 ELSE h5 END)) END AS r, coalesce(CASE condition WHEN 'rising' THEN rising WHEN 'busy' THEN busy ELSE true END, false) AS held
  FROM fw, (SELECT unnest(['all', 'busy', 'rising']) AS condition), (SELECT unnest([1, 5]) AS horizon))"""


def conditioned(spark, sf_dir):
    b = bars(spark, sf_dir)
    b = b.select(
        "ticker", "date", accounting.future_return(1, S).alias("h1"), accounting.future_return(5, S).alias("h5"),
        F.coalesce(F.col("close") > F.lag("close").over(S.rows), F.lit(False)).alias("rising"), (F.col("volume") > 1).alias("busy"), F.lit(True).alias("all"),
    )
    b = b.withColumn("c", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("held")) for c in ("all", "busy", "rising")])))
    b = b.withColumn("h", F.explode(F.array(F.struct(F.lit(1).alias("horizon"), F.col("h1").alias("r")), F.struct(F.lit(5).alias("horizon"), F.col("h5").alias("r")))))
    # Returns are clipped to one: the derived prices jump as no market's do.
    return b.select("ticker", "date", "c.*", "h.horizon", F.when(F.col("h.r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("h.r")))).alias("r"))


@query(_FWD + """ SELECT ticker, condition, horizon, count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM st WHERE held AND r IS NOT NULL GROUP BY ticker, condition, horizon""")
def condition_study(spark, sf_dir):
    c = conditioned(spark, sf_dir).where("held AND r IS NOT NULL")
    return c.groupBy("ticker", "condition", "horizon").agg(F.count("r").alias("n"), r6(F.avg("r")).alias("mean"), r6(F.median("r")).alias("median"), r6(F.avg((F.col("r") > 0).cast("double"))).alias("win_rate"))


@query(f"""WITH {BARS}, fw AS (SELECT ticker, close / open AS x, greatest(-1.0, least(1.0, lead(close, 5) OVER w / lead(open, 1) OVER w - 1)) AS r, lead(close, 5) OVER w AS a FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 ok AS (SELECT * FROM fw WHERE a IS NOT NULL), q AS (SELECT ticker, list_distinct([quantile_cont(x, 0), quantile_cont(x, 0.2), quantile_cont(x, 0.4), quantile_cont(x, 0.6), quantile_cont(x, 0.8), quantile_cont(x, 1)]) AS edges, count(DISTINCT x) AS n FROM ok GROUP BY ticker),
 b AS (SELECT ticker, r, CAST(greatest(len(list_filter(edges, lambda e: e < x)) - 1, 0) + 1 AS INTEGER) AS bin FROM ok JOIN q USING (ticker) WHERE n >= 5)
 SELECT ticker, bin, count(*) AS n, round(avg(r), 5) AS mean FROM b GROUP BY ticker, bin""")
def quantile_study(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", (F.col("close") / F.col("open")).alias("x"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), accounting.future_return(5, S))).alias("r"), F.lead("close", 5).over(S.rows).alias("ahead")).where("ahead IS NOT NULL")
    return xsection.quantile_bins(b, "x", ["ticker"], 5).groupBy("ticker", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 5).alias("mean"))


@query(f"""WITH {BARS}, fw AS (SELECT ticker, volume::DOUBLE AS volume, high / low AS span, close / open AS body, greatest(-1.0, least(1.0, lead(close, 5) OVER w / lead(open, 1) OVER w - 1)) AS r, lead(close, 5) OVER w AS a FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 lg AS (UNPIVOT (SELECT ticker, r, volume, span, body FROM fw WHERE a IS NOT NULL) ON volume, span, body INTO NAME feature VALUE x),
 rk AS (SELECT *, rank() OVER (PARTITION BY ticker, feature ORDER BY x) + (count(*) OVER (PARTITION BY ticker, feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY ticker, feature ORDER BY r) + (count(*) OVER (PARTITION BY ticker, feature, r) - 1) / 2 AS ry FROM lg)
 SELECT ticker, feature, round(corr(x, r), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM rk GROUP BY ticker, feature""")
def correlation_study(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", F.col("volume").cast("double").alias("volume"), (F.col("high") / F.col("low")).alias("span"), (F.col("close") / F.col("open")).alias("body"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), accounting.future_return(5, S))).alias("r"), F.lead("close", 5).over(S.rows).alias("a")).where("a IS NOT NULL")
    lg = b.unpivot(["ticker", "r"], ["volume", "span", "body"], "feature", "x")
    rk = lg.select("*", xsection.average_rank("x", ["ticker", "feature"]).alias("rx"), xsection.average_rank("r", ["ticker", "feature"]).alias("ry"))
    return rk.groupBy("ticker", "feature").agg(F.round(stats.correlation("x", "r"), 5).alias("pearson"), F.round(stats.correlation("rx", "ry"), 5).alias("spearman"))


@query(_PARTY + """, b AS (SELECT ticker, party, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM pr GROUP BY 1, 2), n AS (SELECT pr.*, greatest(lo, least(hi, r)) AS w, row_number() OVER (PARTITION BY ticker, party ORDER BY date) AS rn, count(*) OVER (PARTITION BY ticker, party) AS cnt FROM pr JOIN b USING (ticker, party))
 SELECT ticker, party, round(regr_slope(r, x), 2) AS all_rows, round(regr_slope(w, x), 2) AS winsorized, round(regr_slope(r, x) FILTER (WHERE abs(r) <= 50), 2) AS small_moves, round(regr_slope(r, x) FILTER (WHERE rn <= cnt // 2), 2) AS first_half, round(regr_slope(r, x) FILTER (WHERE rn > cnt // 2), 2) AS second_half FROM n GROUP BY ticker, party""")
def robustness_slices(spark, sf_dir):
    p = _parties(spark, sf_dir)
    cut = p.groupBy("ticker", "party").agg(F.percentile("r", F.array(F.lit(0.01), F.lit(0.99))).alias("cut"))
    from pyspark.sql import Window

    w = Window.partitionBy("ticker", "party")
    n = p.join(cut, ["ticker", "party"]).withColumn("w", F.greatest(F.col("cut")[0], F.least(F.col("cut")[1], F.col("r")))).withColumn("rn", F.row_number().over(w.orderBy("date"))).withColumn("half", F.floor(F.count(F.lit(1)).over(w) / 2))
    only = lambda c: F.when(c, F.col("x"))
    n = n.withColumn("xs", only(F.abs("r") <= 50)).withColumn("x1", only(F.col("rn") <= F.col("half"))).withColumn("x2", only(F.col("rn") > F.col("half")))
    slopes = {"all_rows": ("r", "x"), "winsorized": ("w", "x"), "small_moves": ("r", "xs"), "first_half": ("r", "x1"), "second_half": ("r", "x2")}
    return n.groupBy("ticker", "party").agg(*[F.round(stats.slope(*v), 2).alias(k) for k, v in slopes.items()])


# False discovery

_PVALUES = """pv AS (SELECT p_brand AS family, p_type AS test, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE (sum(p_partkey) % 1000) / 1000.0::DOUBLE END AS p FROM part GROUP BY 1, 2)"""


@query(f"""WITH {_PVALUES}, r AS (SELECT *, p * count(p) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p) AS q0 FROM pv)
 SELECT family, test, p, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(q0) OVER (PARTITION BY family, p IS NULL ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) END AS q FROM r""")
def bh_fdr(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("test")).agg(F.count(F.lit(1)).alias("c"), F.sum("p_partkey").alias("s"))
    p = part.select("family", "test", F.when(F.col("c") % 7 != 0, (F.col("s") % 1000) / 1000.0).alias("p"))
    return stats.false_discovery(p, "p", "q", ["family"]).select("family", "test", "p", r6("q").alias("q"))


# Resampling

_BLOCK = 5
WHOLE, OF_GATE, OF_HYPOTHESIS = 2000, 600, 500


def _positions(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date", (F.col("ret") * 100).alias("r"), (F.col("volume") > 1).alias("busy"))
    return resample.positioned(b, "date", "ticker").select("ticker", "pos", "n", "r", "busy")


def _hashed_sql(draws, seed):
    """The draws of every ticker as the table dr."""
    return f"""WITH {BARS}, po AS (SELECT ticker, ret * 100 AS r, volume > 1 AS busy, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
 ln AS (SELECT DISTINCT ticker, n FROM po), bl AS (SELECT ticker, n, draw, unnest(range(CAST(ceil(n / {_BLOCK}) AS BIGINT))) AS blk FROM ln, range({draws}) t(draw)),
 sta AS (SELECT *, least(CAST(floor(('0x' || substr(sha256('{seed}|' || ticker || '|' || draw || '|' || blk), 1, 8))::BIGINT / 4294967295.0::DOUBLE * n) AS BIGINT), n - 1) AS start FROM bl),
 ix AS (SELECT ticker, draw, blk * {_BLOCK} + off AS place, (start + off) % n AS pos, n FROM sta, range({_BLOCK}) o(off)), dr AS (SELECT i.ticker, draw, r, busy FROM ix i JOIN po USING (ticker, pos) WHERE place < i.n)"""


_EXCESS = """, ex AS (SELECT ticker, draw, avg(r) FILTER (WHERE busy) - avg(r) AS excess FROM dr GROUP BY ticker, draw)
 SELECT ticker, round(quantile_cont(excess, 0.025), 6) AS ci_low, round(quantile_cont(excess, 0.975), 6) AS ci_high, round((count(*) FILTER (WHERE excess <= 0) + 1) / (count(excess) + 1), 6) AS p_one
 FROM ex WHERE excess IS NOT NULL GROUP BY ticker"""


def _hashed(spark, sf_dir, draws):
    p = _positions(spark, sf_dir)
    starts = resample.hashed_starts(p.select("ticker", "n").distinct(), ["ticker"], draws, _BLOCK, 11)
    d = resample.draw_values(starts, p, _BLOCK, {"excess": resample.excess(F.col("r"), F.col("busy"))}, ["ticker"])
    return resample.interval(d, "excess", ["ticker"]).select("ticker", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), r6("p_one").alias("p_one"))


@query(_hashed_sql(WHOLE, 11) + _EXCESS)
def bootstrap_hash(spark, sf_dir):
    return _hashed(spark, sf_dir, WHOLE)


@query(_hashed_sql(WHOLE, 11) + _EXCESS)
def bootstrap_hash_whole(spark, sf_dir):
    return _hashed(spark, sf_dir, WHOLE)


@query()
def bootstrap_pcg(spark, sf_dir):
    """The same with the seeded generator's draws; tests hold it against a plain loop with that generator."""
    p = _positions(spark, sf_dir)
    starts = resample.seeded_starts_of(p.select("ticker", "n").distinct(), "ticker", WHOLE, _BLOCK, 11)
    d = resample.draw_values(starts, p, _BLOCK, {"excess": resample.excess(F.col("r"), F.col("busy"))}, ["ticker"])
    return resample.interval(d, "excess", ["ticker"])


@query(_hashed_sql(WHOLE, 12) + """, cu AS (SELECT ticker, draw, busy, quantile_cont(r, 0.05) AS q, count(r) AS n FROM dr GROUP BY ticker, draw, busy),
 tl AS (SELECT ticker, draw, busy, CASE WHEN max(n) >= 5 THEN avg(r) FILTER (WHERE r <= q + 1e-12) END AS tail FROM dr JOIN cu USING (ticker, draw, busy) GROUP BY ticker, draw, busy),
 df AS (SELECT ticker, draw, max(tail) FILTER (WHERE busy) - max(tail) FILTER (WHERE NOT busy) AS d FROM tl GROUP BY ticker, draw)
 SELECT ticker, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, round((count(*) FILTER (WHERE d <= 0) + 1) / (count(d) + 1), 6) AS p_one,
  round(least(1.0, 2 * least((count(*) FILTER (WHERE d <= 0) + 1) / (count(d) + 1), (count(*) FILTER (WHERE d >= 0) + 1) / (count(d) + 1))), 6) AS p_two, count(d) AS draws FROM df WHERE d IS NOT NULL GROUP BY ticker""")
def bootstrap_tail(spark, sf_dir):
    """Block draws of the difference of tail means between busy and calm rows. The twin's quantile of equal values may fall short of them by a rounding."""
    p = _positions(spark, sf_dir)
    starts = resample.hashed_starts(p.select("ticker", "n").distinct(), ["ticker"], WHOLE, _BLOCK, 12)
    found = resample.interval(resample.tail_draws(starts, p, _BLOCK, "r", "busy", ["ticker"]), "difference", ["ticker"])
    return found.withColumns({c: r6(c) for c in ("ci_low", "ci_high", "p_one", "p_two")})


@query()
def block_permute(spark, sf_dir):
    """A signal with its blocks in random order, beside the signal; the counts agree."""
    b = resample.positioned(bars(spark, sf_dir).select("ticker", "date", (F.col("volume") > 1).alias("busy")), "date", "ticker")
    return resample.permuted_each(b, "ticker", "busy", _BLOCK, 3, "placebo").select("ticker", F.col("date").cast("string").alias("date"), "busy", "placebo")


@query()
def sign_flip_placebo(spark, sf_dir):
    return resample.sign_flip_bounds(_positions(spark, sf_dir).withColumn("r", F.col("r") / 100), "ticker", "r", 10, OF_HYPOTHESIS, 10, 5)


# Gates

#: Rows among which a gate ranks a value.
RANK_ROWS = 250

_GATES = f"""WITH {FLOWS}, rr AS (SELECT ticker, date, 2.0::DOUBLE * (close - open) / (close + open) AS ret, p1 / 100.0::DOUBLE AS p1, p2 / 100.0::DOUBLE AS p2, value_cents / 100.0::DOUBLE AS bal FROM flow),
 v AS (SELECT *, CASE WHEN count(ret) OVER w = 20 THEN round(stddev_samp(ret) OVER w, 9) END AS vol, CASE WHEN count(p1) OVER f = 5 THEN sum(p1) OVER f END AS s1, CASE WHEN count(p2) OVER f = 5 THEN round(sum(p2) OVER f, 4) END AS s2, round(bal / lag(bal, 20) OVER o - 1, 9) AS gr FROM rr
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), o AS (PARTITION BY ticker ORDER BY date)),
 lk AS (SELECT *, list(vol) OVER w AS hv, list(s2) OVER w AS h2, list(gr) OVER w AS hg FROM v WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {RANK_ROWS - 1} PRECEDING AND CURRENT ROW)),
 fl AS (SELECT ticker, date, list_filter(hv, lambda x: x IS NOT NULL) AS hv, list_filter(h2, lambda x: x IS NOT NULL) AS h2, list_filter(hg, lambda x: x IS NOT NULL) AS hg, vol, s1, s2, gr, ret FROM lk),
 gt AS (SELECT ticker, date, ret, coalesce(CASE WHEN len(hv) = {RANK_ROWS} THEN (len(list_filter(hv, lambda x: x < vol)) + (len(list_filter(hv, lambda x: x = vol)) + 1) / 2) / {RANK_ROWS} >= 0.8 END, false) AS hot_vol, coalesce(s1 < 0, false) AS outflow,
  coalesce(CASE WHEN len(h2) = {RANK_ROWS} THEN (len(list_filter(h2, lambda x: x < s2)) + (len(list_filter(h2, lambda x: x = s2)) + 1) / 2) / {RANK_ROWS} >= 0.8 END, false) AS hot_buyers,
  coalesce(CASE WHEN len(hg) = {RANK_ROWS} AND gr IS NOT NULL THEN (len(list_filter(hg, lambda x: x < gr)) + (len(list_filter(hg, lambda x: x = gr)) + 1) / 2) / {RANK_ROWS} >= 0.8 END, false) AS surge0 FROM fl),
 gts AS (SELECT ticker, date, ret, hot_vol, outflow, hot_buyers, coalesce(lag(surge0) OVER (PARTITION BY ticker ORDER BY date), false) AS surge FROM gt)"""
GATES = ["hot_vol", "outflow", "hot_buyers", "surge"]


def gates(spark, sf_dir):
    f = flows(spark, sf_dir).select("ticker", "date", (2.0 * (F.col("close") - F.col("open")) / (F.col("close") + F.col("open"))).alias("ret"), (F.col("p1") / 100.0).alias("p1"), (F.col("p2") / 100.0).alias("p2"), (F.col("value_cents") / 100.0).alias("bal"))
    f = f.withColumn("vol", F.round(S.over(F.stddev_samp, "ret", -19, 0), 9)).withColumn("s1", S.over(F.sum, "p1", -4, 0)).withColumn("s2", F.round(S.over(F.sum, "p2", -4, 0), 4)).withColumn("gr", F.round(S.change("bal", 20), 9))
    high = lambda c: F.coalesce(S.trailing_rank(c, RANK_ROWS) >= 0.8, F.lit(False))
    f = f.select("ticker", "date", "ret", high("vol").alias("hot_vol"), F.coalesce(F.col("s1") < 0, F.lit(False)).alias("outflow"), high("s2").alias("hot_buyers"), high("gr").alias("surge0"))
    return f.withColumn("surge", F.lag("surge0", 1, False).over(S.rows)).drop("surge0")


@query(_GATES + " SELECT ticker, date, hot_vol, outflow, hot_buyers, surge FROM gts", "date")
def gate_flags(spark, sf_dir):
    return gates(spark, sf_dir).drop("ret")


@query(_GATES + """ SELECT ticker, date, CASE WHEN CAST(hot_vol AS INTEGER) + CAST(outflow AS INTEGER) + CAST(hot_buyers AS INTEGER) + CAST(surge AS INTEGER) >= 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM gts""", "date")
def gate_weighting(spark, sf_dir):
    return gates(spark, sf_dir).select("ticker", "date", accounting.gated(F.lit(1.0), GATES, 0.5).alias("weight"))


_GATELONG = _GATES + """, u AS (UNPIVOT gts ON hot_vol, outflow, hot_buyers, surge INTO NAME gate VALUE up)"""


@query(_GATELONG + """, q AS (SELECT ticker, gate, up, quantile_cont(ret, 0.05) AS q, count(*) AS n FROM u GROUP BY 1, 2, 3), t AS (SELECT u.ticker, u.gate, u.up, avg(ret) FILTER (WHERE ret <= q.q) AS tail, avg(ret) AS mean, count(*) AS n FROM u JOIN q ON u.ticker = q.ticker AND u.gate = q.gate AND u.up = q.up GROUP BY 1, 2, 3)
 SELECT ticker, gate, CAST(sum(n) FILTER (WHERE up) AS BIGINT) AS flagged, round(max(mean) FILTER (WHERE up) - max(mean) FILTER (WHERE NOT up), 6) AS mean_difference, round(max(tail) FILTER (WHERE up) - max(tail) FILTER (WHERE NOT up), 6) AS tail_difference FROM t GROUP BY ticker, gate""")
def gate_effects(spark, sf_dir):
    u = gates(spark, sf_dir).unpivot(["ticker", "date", "ret"], GATES, "gate", "up")
    tail = stats.tail_mean(u, "ret", ["ticker", "gate", "up"], name="tail")
    each = u.groupBy("ticker", "gate", "up").agg(F.avg("ret").alias("mean"), F.count(F.lit(1)).alias("n")).join(tail, ["ticker", "gate", "up"])
    side = lambda c, b: F.max(F.when(F.col("up") == b, F.col(c)))
    return each.groupBy("ticker", "gate").agg(F.coalesce(side("n", True), F.lit(0)).alias("flagged"), r6(side("mean", True) - side("mean", False)).alias("mean_difference"), r6(side("tail", True) - side("tail", False)).alias("tail_difference"))


@query(_GATES + """ SELECT ticker, round(corr(CAST(hot_vol AS INTEGER), CAST(outflow AS INTEGER)), 6) AS hot_vol_outflow, round(corr(CAST(hot_vol AS INTEGER), CAST(surge AS INTEGER)), 6) AS hot_vol_surge, round(avg(CAST(outflow AS INTEGER)), 6) AS outflow_share FROM gts GROUP BY ticker""")
def gate_overlap(spark, sf_dir):
    g = gates(spark, sf_dir)
    for c in GATES:
        g = g.withColumn(c, F.col(c).cast("double"))
    return g.groupBy("ticker").agg(r6(stats.correlation("hot_vol", "outflow")).alias("hot_vol_outflow"), r6(stats.correlation("hot_vol", "surge")).alias("hot_vol_surge"), r6(F.avg("outflow")).alias("outflow_share"))


_FOLDS = f"""WITH {BARS}, n AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker), k AS (SELECT ticker, n, unnest(range(0, 1000)) AS k FROM n),
 fo AS (SELECT ticker, CAST(k + 1 AS INTEGER) AS fold, 250 AS train_start, CAST(500 + k * 84 AS INTEGER) AS test_start, CAST(least(500 + (k + 1) * 84, n) AS INTEGER) AS test_end FROM k WHERE 500 + k * 84 < n AND least(500 + (k + 1) * 84, n) - (500 + k * 84) >= 42)"""


def fold_table(spark, sf_dir):
    n = bars(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return n.select("ticker", F.explode(resample.folds(F.col("n"), 250, 250, 84)).alias("f")).select("ticker", "f.*")


@query(_FOLDS + " SELECT * FROM fo")
def walkforward_folds(spark, sf_dir):
    return fold_table(spark, sf_dir)


@query(_FOLDS + """, po AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM bars)
 SELECT f.ticker, fold, count(*) FILTER (WHERE pos < test_start) AS train_rows, count(*) FILTER (WHERE pos >= test_start) AS test_rows, round(avg(ret) FILTER (WHERE pos < test_start), 6) AS train_mean, round(avg(ret) FILTER (WHERE pos >= test_start), 6) AS test_mean
 FROM fo f JOIN po p ON f.ticker = p.ticker AND pos >= train_start AND pos < test_end GROUP BY f.ticker, fold""")
def fold_join(spark, sf_dir):
    """Rows and folds of the same ticker by position: the fold table has a row for each 84 rows of a series, so it is small."""
    p = resample.positioned(bars(spark, sf_dir).select("ticker", "date", "ret"), "date", "ticker").drop("n")
    j = p.join(fold_table(spark, sf_dir), "ticker").where("pos >= train_start AND pos < test_end")
    train, test = F.col("pos") < F.col("test_start"), F.col("pos") >= F.col("test_start")
    return j.groupBy("ticker", "fold").agg(F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"), r6(F.avg(F.when(train, F.col("ret")))).alias("train_mean"), r6(F.avg(F.when(test, F.col("ret")))).alias("test_mean"))


_TRAIN = _GATES + """, ps AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n FROM gts),
 k AS (SELECT DISTINCT ticker, n, unnest(range(0, 1000)) AS k FROM ps),
 fo AS (SELECT ticker, CAST(k + 1 AS INTEGER) AS fold, 250 AS train_start, 500 + k * 84 AS test_start, least(500 + (k + 1) * 84, n) AS test_end
  FROM k WHERE 500 + k * 84 < n AND least(500 + (k + 1) * 84, n) - (500 + k * 84) >= 42),
 tr AS (SELECT ps.ticker, fold, idx - train_start AS pos, test_start - train_start AS n, ret, hot_vol, outflow, hot_buyers, surge
  FROM ps JOIN fo ON ps.ticker = fo.ticker AND idx >= train_start AND idx < test_start)"""


def _sides(form: str) -> str:
    return ", ".join(form.format(g=g, s=s, on=on) for g in GATES for s, on in (("up", g), ("no", f"NOT {g}")))


def _tails(rows: str, keys: str) -> str:
    """Of each draw the tail of each gate's two sides, of five values at least."""
    cuts = _sides("quantile_cont(ret, 0.05) FILTER (WHERE {on}) AS q_{s}_{g}, count(ret) FILTER (WHERE {on}) AS n_{s}_{g}")
    tails = _sides("CASE WHEN max(n_{s}_{g}) >= 5 THEN avg(ret) FILTER (WHERE {on} AND ret <= q_{s}_{g} + 1e-12) END AS t_{s}_{g}")
    return f"""SELECT {keys}, {', '.join(f't_up_{g} - t_no_{g} AS {g}' for g in GATES)}
  FROM (SELECT {keys}, {tails} FROM {rows} JOIN (SELECT {keys}, {cuts} FROM {rows} GROUP BY {keys}) USING ({keys}) GROUP BY {keys})"""


_SELECTION = _TRAIN + f""", ln AS (SELECT DISTINCT ticker, fold, n FROM tr),
 bl AS (SELECT ticker, fold, n, draw, unnest(range(CAST(ceil(n / 5) AS BIGINT))) AS blk FROM ln, range({OF_GATE}) t(draw)),
 un AS (SELECT *, ('0x' || substr(sha256('21|' || ticker || '|' || fold || '|' || draw || '|' || blk), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS u FROM bl),
 sta AS (SELECT *, least(CAST(floor(u * n) AS BIGINT), n - 1) AS start FROM un),
 ix AS (SELECT ticker, fold, draw, blk * 5 + off AS place, (start + off) % n AS pos, n FROM sta, range(5) o(off)),
 dr AS (SELECT i.ticker, i.fold, draw, ret, hot_vol, outflow, hot_buyers, surge FROM ix i JOIN tr ON i.ticker = tr.ticker AND i.fold = tr.fold AND i.pos = tr.pos WHERE place < i.n),
 dd AS (UNPIVOT ({_tails("dr", "ticker, fold, draw")}) ON hot_vol, outflow, hot_buyers, surge INTO NAME gate VALUE d),
 pv AS (SELECT ticker, fold, gate, round(least(1.0, 2 * least((count(*) FILTER (WHERE d <= 0) + 1) / (count(d) + 1), (count(*) FILTER (WHERE d >= 0) + 1) / (count(d) + 1))), 9) AS p_two
  FROM dd WHERE d IS NOT NULL GROUP BY ALL),
 ob AS (UNPIVOT ({_tails("tr", "ticker, fold")}) ON hot_vol, outflow, hot_buyers, surge INTO NAME gate VALUE observed),
 lg AS (UNPIVOT (SELECT ticker, fold, hot_vol, outflow, hot_buyers, surge FROM tr) ON hot_vol, outflow, hot_buyers, surge INTO NAME gate VALUE up),
 ct AS (SELECT ticker, gate, fold, count(*) FILTER (WHERE up) AS flagged, count(*) FILTER (WHERE NOT up) AS clear FROM lg GROUP BY ALL),
 sel AS (SELECT ct.*, observed, p_two, coalesce(flagged >= 10 AND clear >= 10 AND observed < 0 AND p_two < 0.10, false) AS chosen
  FROM ct LEFT JOIN ob USING (ticker, gate, fold) LEFT JOIN pv USING (ticker, gate, fold))"""


def gate_sides():
    """The returns while each gate is up and while it isn't, by name."""
    return {f"{s}_{g}": F.when(F.col(g) == (s == "up"), F.col("ret")) for g in GATES for s in ("up", "no")}


def _training(g):
    """The training rows of each fold with their place among them, and the folds."""
    at = resample.positioned(g, "date", "ticker")
    folds = at.select("ticker", "n").distinct().select("ticker", F.explode(resample.folds(F.col("n"), 250, 250, 84)).alias("f")).select("ticker", "f.*")
    train = at.drop("n").join(folds, "ticker").where("pos >= train_start AND pos < test_start")
    place, n = (F.col("pos") - F.col("train_start")).cast("long"), (F.col("test_start") - F.col("train_start")).cast("long")
    return train.select("ticker", "fold", place.alias("pos"), n.alias("n"), "ret", *GATES), folds


def selected_gates(g):
    """Of each fold and gate: the training rows' tail difference with its block bootstrap, and whether the gate is chosen. A draw serves all gates of a fold."""
    train, _ = _training(g)
    keys = ["ticker", "fold"]
    counts = [F.struct(F.lit(x).alias("gate"), F.count_if(x).alias("flagged"), F.count_if(~F.col(x)).alias("clear")) for x in GATES]
    facts = train.groupBy(*keys).agg(F.array(*counts).alias("g")).select(*keys, F.explode("g").alias("g")).select(*keys, "g.*")
    sides = gate_sides()
    tails = [F.struct(F.lit(x).alias("gate"), (resample.list_tail(F.col(f"up_{x}"), least=5) - resample.list_tail(F.col(f"no_{x}"), least=5)).alias("difference")) for x in GATES]
    each = lambda df, more: df.select(*keys, *more, F.explode(F.array(*tails)).alias("t")).select(*keys, *more, "t.*")
    whole = each(train.groupBy(*keys).agg(*[F.collect_list(v).alias(k) for k, v in sides.items()]), []).withColumnRenamed("difference", "observed")
    starts = resample.hashed_starts(train.select(*keys, "n").distinct(), keys, OF_GATE, 5, 21)
    draws = each(resample.draw_lists(starts, train, 5, sides, keys), ["draw"])
    p = resample.interval(draws, "difference", [*keys, "gate"]).select(*keys, "gate", F.round("p_two", 9).alias("p_two"))
    out = facts.join(whole, [*keys, "gate"], "left").join(p, [*keys, "gate"], "left")
    chosen = (F.col("flagged") >= 10) & (F.col("clear") >= 10) & (F.col("observed") < 0) & (F.col("p_two") < 0.10)
    return out.withColumn("chosen", F.coalesce(chosen, F.lit(False)))


@query(_SELECTION + " SELECT ticker, gate, fold, flagged, clear, round(observed, 6) AS observed, round(p_two, 6) AS p_two, chosen FROM sel")
def walkforward_selection(spark, sf_dir):
    out = selected_gates(kept(gates(spark, sf_dir), "gates"))
    return out.select("ticker", "gate", "fold", "flagged", "clear", r6("observed").alias("observed"), r6("p_two").alias("p_two"), "chosen")


# Walk-forward weights: the gates chosen in training halve the weight in the fold's test rows.


@query(_SELECTION + """, te AS (SELECT ps.ticker, date, fold, ret, hot_vol, outflow, hot_buyers, surge FROM ps JOIN fo ON ps.ticker = fo.ticker AND idx >= test_start AND idx < test_end),
 tl AS (UNPIVOT te ON hot_vol, outflow, hot_buyers, surge INTO NAME gate VALUE up),
 n AS (SELECT t.ticker, t.date, t.fold, any_value(ret) AS ret, count(*) FILTER (WHERE chosen) AS n_chosen, count(*) FILTER (WHERE chosen AND up) AS n_up
  FROM tl t JOIN sel s ON t.ticker = s.ticker AND t.fold = s.fold AND t.gate = s.gate GROUP BY t.ticker, t.date, t.fold)
 SELECT ticker, date, fold, n_chosen, n_up, CASE WHEN n_chosen > 0 AND n_up >= least(2, n_chosen) THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, ret FROM n""", "date")
def walkforward_weights(spark, sf_dir):
    """Of each test row: gates chosen for its fold, how many are up, and the weight (two up, or the only one, halve it)."""
    g = kept(gates(spark, sf_dir), "gates")
    at = resample.positioned(g, "date", "ticker").drop("n")
    _, folds = _training(g)
    test = at.join(folds, "ticker").where("pos >= test_start AND pos < test_end")
    chosen = selected_gates(g).where("chosen").groupBy("ticker", "fold").agg(F.collect_set("gate").alias("own"))
    rows = test.join(chosen, ["ticker", "fold"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    up = sum((F.when(F.col(x) & F.array_contains("own", x), 1).otherwise(0) for x in GATES), F.lit(0)).cast("long")
    rows = rows.withColumn("n_chosen", F.size("own").cast("long")).withColumn("n_up", up)
    risky = (F.col("n_chosen") > 0) & (F.col("n_up") >= F.least(F.lit(2), F.col("n_chosen")))
    return rows.select("ticker", "date", "fold", "n_chosen", "n_up", F.when(risky, 0.5).otherwise(1.0).alias("weight"), "ret")
