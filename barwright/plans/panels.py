"""Time joins, cross-sections, aggregates and accounting over bars, flows and the supplier panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import accounting, stats, timejoin, xsection
from ..sources.derive import BARS, FLOWS, PANEL, RATES, bars, flows, panel, rates
from .registry import query, r6
from .signals import _CHANNEL, signals

S = Series()


# Time joins


@query(f"""WITH {BARS}, {RATES}, known AS (SELECT * FROM rates WHERE rate IS NOT NULL)
 SELECT b.ticker, b.date, b.close, k.rate FROM bars b ASOF LEFT JOIN known k ON b.ticker = k.ticker AND b.date >= k.date""", "date")
def asof_skip_null(spark, sf_dir):
    return timejoin.as_of(bars(spark, sf_dir).select("ticker", "date", "close"), rates(spark, sf_dir), "rate", True, S).select("ticker", "date", "close", "rate")


@query(f"""WITH {BARS}, {RATES} SELECT b.ticker, b.date, b.close, k.rate FROM bars b ASOF LEFT JOIN rates k ON b.ticker = k.ticker AND b.date >= k.date""", "date")
def asof_label(spark, sf_dir):
    return timejoin.as_of(bars(spark, sf_dir).select("ticker", "date", "close"), rates(spark, sf_dir), "rate", False, S).select("ticker", "date", "close", "rate")


@query(f"""WITH {BARS}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars))
 SELECT b.ticker, b.date, e.date AS entry_date, x.date AS exit_date FROM bars b JOIN c ON b.date = c.date LEFT JOIN c e ON e.pos = c.pos + 2 LEFT JOIN c x ON x.pos = c.pos + 6""", "date entry_date exit_date")
def calendar_shift(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date")
    days = timejoin.calendar(b)
    out = timejoin.shifted(b, days, "date", 2, "entry_date")
    return timejoin.shifted(out, days, "entry_date", 4, "exit_date").select("ticker", "date", "entry_date", "exit_date")


@query(f"""WITH {BARS}, newer AS (SELECT * FROM bars WHERE date >= DATE '1998-01-01'), f AS (SELECT ticker, min(date) AS first FROM newer GROUP BY ticker)
 SELECT b.ticker, b.date, close * 1.5 AS close, CAST(NULL AS DOUBLE) AS volume FROM bars b LEFT JOIN f ON b.ticker = f.ticker WHERE first IS NULL OR date < first
 UNION ALL SELECT ticker, date, close, CAST(volume AS DOUBLE) FROM newer""", "date")
def precedence_merge(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date", "close", F.col("volume").cast("double").alias("volume"))
    older, newer = b.withColumn("close", F.col("close") * 1.5), b.where(F.col("date") >= F.lit("1998-01-01").cast("date"))
    return timejoin.precedence_merge(older, newer, ["volume"], S).select("ticker", "date", "close", "volume")


@query(f"""WITH {BARS}, o AS (SELECT ticker, date, open, close + CASE WHEN day(date) = 13 THEN 0.5 WHEN day(date) = 7 THEN 0.0005 ELSE 0 END AS close FROM bars)
 SELECT b.ticker, b.date, round(abs(b.close - o.close), 6) AS largest_gap FROM bars b JOIN o USING (ticker, date) WHERE abs(b.close - o.close) > 0.001""", "date")
def reconcile(spark, sf_dir):
    b = bars(spark, sf_dir)
    other = b.withColumn("close", F.col("close") + F.when(F.dayofmonth("date") == 13, 0.5).when(F.dayofmonth("date") == 7, 0.0005).otherwise(0.0))
    return timejoin.reconciled(b, other, ["open", "close"], series=S).where("differs").select("ticker", "date", r6("largest_gap").alias("largest_gap"))


@query(f"""WITH {BARS} SELECT coalesce(a.date, b.date) AS date, coalesce(a.volume, 0) AS urgent, coalesce(b.volume, 0) AS low FROM (SELECT * FROM bars WHERE ticker = '1-URGENT' AND day(date) % 2 = 0) a
 FULL JOIN (SELECT * FROM bars WHERE ticker = '5-LOW' AND day(date) % 3 = 0) b ON a.date = b.date""", "date")
def outer_align(spark, sf_dir):
    b = bars(spark, sf_dir)
    urgent, low = b.where("ticker = '1-URGENT' AND day(date) % 2 = 0"), b.where("ticker = '5-LOW' AND day(date) % 3 = 0")
    return timejoin.aligned([("urgent", urgent), ("low", low)], "volume", 0)


@query(f"""WITH {BARS} SELECT a.date, a.close AS close_a, b.close AS close_b FROM bars a JOIN bars b ON a.date = b.date WHERE a.ticker = '1-URGENT' AND b.ticker = '2-HIGH'""", "date")
def inner_join_pair(spark, sf_dir):
    b = bars(spark, sf_dir)
    side = lambda t, n: b.where(F.col("ticker") == t).select("date", F.col("close").alias(n))
    return side("1-URGENT", "close_a").join(side("2-HIGH", "close_b"), "date")


@query(f"""WITH {BARS}, {FLOWS} SELECT b.ticker, b.date, b.close, f.p1, f.p2 FROM (SELECT ticker, date, close FROM bars) b LEFT JOIN (SELECT date, CAST(p1 AS DOUBLE) AS p1, CAST(p2 AS DOUBLE) AS p2 FROM flow WHERE ticker = 'odd' AND p1 <> 0) f ON b.date = f.date""", "date")
def left_join_balance(spark, sf_dir):
    f = flows(spark, sf_dir).where("ticker = 'odd' AND p1 <> 0").select("date", F.col("p1").cast("double").alias("p1"), F.col("p2").cast("double").alias("p2"))
    return bars(spark, sf_dir).select("ticker", "date", "close").join(f, "date", "left").select("ticker", "date", "close", "p1", "p2")


@query(f"""WITH {BARS}, a AS (SELECT DISTINCT date FROM bars WHERE ticker = '1-URGENT'), b AS (SELECT DISTINCT date FROM bars WHERE ticker = '2-HIGH')
 SELECT (SELECT count(*) FROM a SEMI JOIN b USING (date)) AS overlap, (SELECT count(*) FROM a ANTI JOIN b USING (date)) AS only_a, (SELECT count(*) FROM (SELECT date FROM a UNION SELECT date FROM b)) AS either""")
def date_sets(spark, sf_dir):
    b = bars(spark, sf_dir)
    x, y = (b.where(F.col("ticker") == t).select("date").distinct() for t in ("1-URGENT", "2-HIGH"))
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return one(x.join(y, "date", "left_semi"), "overlap").crossJoin(one(x.join(y, "date", "left_anti"), "only_a")).crossJoin(one(x.union(y).distinct(), "either"))


# Cross-sections

_RANK = f"""WITH {PANEL}, e AS (SELECT *, foreign_net_value / CAST(trading_value AS DOUBLE) AS x FROM pan WHERE is_tradable AND trading_value >= 1000000 AND open > 0 AND close > 0),
 g AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x, ticker) / CAST(n AS DOUBLE) AS rank FROM g WHERE n >= 10),
 bk AS (SELECT *, CASE WHEN rank <= 0.1 THEN 'bottom' WHEN rank > 1 - 0.1::DOUBLE THEN 'top' ELSE 'middle' END AS bucket FROM r)"""


def ranked(spark, sf_dir, sectors=False, p=None):
    """Ranks by flow within a date, or within a date's sector (the parity of the supplier); of the panel p where it is given."""
    by = ["date", "sector"] if sectors else ["date"]
    e = (panel(spark, sf_dir) if p is None else p).where("is_listed AND is_tradable AND trading_value >= 1000000 AND open > 0 AND close > 0").withColumn("x", F.col("foreign_net_value") / F.col("trading_value"))
    e = e.withColumn("sector", F.col("ticker").cast("long") % 2)
    return xsection.first_rank_share(xsection.large_groups(e, by, 10), "x", by, ["ticker"]).withColumn("bucket", xsection.bucket(F.col("rank"), 0.1))


@query(_RANK + " SELECT date, ticker, round(x, 6) AS x, round(rank, 6) AS rank, bucket FROM bk", "date")
def rank_first_pct(spark, sf_dir):
    return ranked(spark, sf_dir).select("date", "ticker", r6("x").alias("x"), r6("rank").alias("rank"), "bucket")


@query(_RANK + " SELECT date, bucket, count(*) AS n, round(avg(x), 6) AS mean_x FROM bk GROUP BY date, bucket", "date")
def decile_bucket(spark, sf_dir):
    return ranked(spark, sf_dir).groupBy("date", "bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean_x"))


@query(f"""WITH {PANEL}, s AS (SELECT date, count(*) AS n FROM pan GROUP BY date) SELECT p.date, p.ticker, p.trading_value FROM pan p JOIN s USING (date) WHERE n >= 60""", "date")
def group_size_filter(spark, sf_dir):
    return xsection.large_groups(panel(spark, sf_dir), ["date"], 60).select("date", "ticker", "trading_value")


@query(f"""WITH {BARS}, q AS (SELECT ticker, list_distinct([quantile_cont(close, 0), quantile_cont(close, 0.2), quantile_cont(close, 0.4), quantile_cont(close, 0.6), quantile_cont(close, 0.8), quantile_cont(close, 1)]) AS edges, count(DISTINCT close) AS n FROM bars GROUP BY ticker),
 b AS (SELECT b.ticker, b.ret, greatest(len(list_filter(edges, lambda e: e < close)) - 1, 0) + 1 AS bin FROM bars b JOIN q USING (ticker) WHERE n >= 5)
 SELECT ticker, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM b GROUP BY ticker, bin""")
def qcut5(spark, sf_dir):
    return xsection.quantile_bins(bars(spark, sf_dir), "close", ["ticker"], 5).groupBy("ticker", "bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ret")).alias("mean_ret"))


@query(f"""WITH {BARS}, r AS (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY volume) + (count(*) OVER (PARTITION BY ticker, volume) - 1) / 2 AS a, rank() OVER (PARTITION BY ticker ORDER BY high - low) + (count(*) OVER (PARTITION BY ticker, high - low) - 1) / 2 AS b FROM bars)
 SELECT ticker, round(corr(a, b), 6) AS spearman FROM r GROUP BY ticker""")
def avg_rank_spearman(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("span", F.col("high") - F.col("low"))
    r = b.select("ticker", xsection.average_rank("volume", ["ticker"]).alias("a"), xsection.average_rank("span", ["ticker"]).alias("b"))
    return r.groupBy("ticker").agg(r6(stats.correlation("a", "b")).alias("spearman"))


_VOL = f"""WITH {BARS}, v AS (SELECT ticker, date, ret, CASE WHEN count(ret) OVER w = 20 THEN round(stddev_samp(ret) OVER w, 9) END AS vol FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 cut AS (SELECT ticker, round(quantile_cont(vol, 1/3::DOUBLE), 9) AS c0, round(quantile_cont(vol, 2/3::DOUBLE), 9) AS c1 FROM v WHERE vol IS NOT NULL GROUP BY ticker),
 reg AS (SELECT v.*, CASE WHEN vol <= c0 THEN 'low' WHEN vol <= c1 THEN 'mid' ELSE 'high' END AS regime FROM v JOIN cut USING (ticker) WHERE vol IS NOT NULL)"""


def regimes(spark, sf_dir):
    v = bars(spark, sf_dir).withColumn("vol", F.round(S.over(F.stddev_samp, "ret", -19, 0), 9))
    return xsection.terciles(v, "vol", ["ticker"])


@query(_VOL + " SELECT ticker, regime, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(stddev_samp(ret), 6) AS sd_ret FROM reg GROUP BY ticker, regime")
def tercile_regime(spark, sf_dir):
    return regimes(spark, sf_dir).groupBy("ticker", "regime").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ret")).alias("mean_ret"), r6(F.stddev_samp("ret")).alias("sd_ret"))


@query(_VOL + """, l AS (SELECT regime AS now, lead(regime, 60) OVER (PARTITION BY ticker ORDER BY date) AS later FROM reg)
 SELECT now, round(100.0 * count(*) FILTER (WHERE later = 'low') / count(later), 6) AS low, round(100.0 * count(*) FILTER (WHERE later = 'mid') / count(later), 6) AS mid, round(100.0 * count(*) FILTER (WHERE later = 'high') / count(later), 6) AS high FROM l WHERE later IS NOT NULL GROUP BY now""")
def transition_matrix(spark, sf_dir):
    t = regimes(spark, sf_dir).select(F.col("regime").alias("now"), F.lead("regime", 60).over(S.rows).alias("later")).where("later IS NOT NULL")
    out = stats.row_shares(t, "now", "later", ["low", "mid", "high"])
    return out.select("now", *[r6(c).alias(c) for c in ("low", "mid", "high")])


@query(f"""WITH {BARS}, n AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars) SELECT ticker, date, close FROM n WHERE (rn - 1) % 7 = 0""", "date")
def systematic_sample(spark, sf_dir):
    return xsection.every_nth(bars(spark, sf_dir), 7, ["ticker"], ["date"]).select("ticker", "date", "close")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC) AS n FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM r WHERE n = 1""")
def dedupe_keep_last(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return xsection.last_of_key(l, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice"]).drop("l_shipdate")


@query(f"""WITH {PANEL}, t AS (SELECT ticker, sum(foreign_net_value) AS f, sum(trading_value) AS v, count(*) FILTER (WHERE foreign_net_value > 0) AS up, max_by(market_cap, date) - min_by(market_cap, date) AS moved FROM pan GROUP BY ticker)
 SELECT ticker, round(f / v::DOUBLE, 6) AS intensity, up AS positive_months, round(moved, 4) AS moved FROM t ORDER BY intensity DESC, ticker LIMIT 20""")
def scanner_topk(spark, sf_dir):
    t = panel(spark, sf_dir).groupBy("ticker").agg(
        r6(F.sum("foreign_net_value") / F.sum("trading_value").cast("double")).alias("intensity"), F.count_if(F.col("foreign_net_value") > 0).alias("positive_months"), F.round(F.max_by("market_cap", "date") - F.min_by("market_cap", "date"), 4).alias("moved"),
    )
    return t.orderBy(F.desc("intensity"), "ticker").limit(20)


# Aggregates


@query(f"""WITH {PANEL} SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM pan GROUP BY ticker""", "first_date last_date")
def coverage(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"""WITH {BARS} SELECT ticker, CAST(year(date) AS INTEGER) AS year, round(exp(sum(ln(1 + ret))) - 1, 6) AS yearly FROM bars GROUP BY 1, 2 HAVING count(*) >= 40""")
def yearly_product(spark, sf_dir):
    y = bars(spark, sf_dir).groupBy("ticker", F.year("date").alias("year")).agg(r6(F.product(1 + F.col("ret")) - 1).alias("yearly"), F.count(F.lit(1)).alias("n"))
    return y.where("n >= 40").drop("n")


@query(f"""WITH {BARS}, b AS (SELECT ticker, CASE WHEN volume > 1 THEN 'busy' ELSE 'calm' END AS flag, ret * 100 AS r FROM bars), q AS (SELECT ticker, flag, quantile_cont(r, 0.05) AS q, count(*) AS n FROM b GROUP BY 1, 2)
 SELECT ticker, flag, round(avg(r), 6) AS cvar FROM b JOIN q USING (ticker, flag) WHERE r <= q.q AND n >= 5 GROUP BY ticker, flag""")
def cvar_by_flag(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", F.when(F.col("volume") > 1, "busy").otherwise("calm").alias("flag"), (F.col("ret") * 100).alias("r"))
    return stats.tail_mean(b, "r", ["ticker", "flag"], least=5).where("cvar IS NOT NULL").select("ticker", "flag", r6("cvar").alias("cvar"))


def _parties(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("r", (F.col("close") / F.col("open") - 1) * 100)
    long = f.unpivot(["ticker", "date", "r", "value_cents"], ["p1", "p2", "p3", "p4", "p5"], "party", "flow")
    return long.withColumn("x", F.col("flow") / F.col("value_cents"))


_PARTY = f"""WITH {FLOWS}, lg AS (UNPIVOT (SELECT ticker, date, (close / open - 1) * 100 AS r, value_cents, p1, p2, p3, p4, p5 FROM flow) ON p1, p2, p3, p4, p5 INTO NAME party VALUE flow), pr AS (SELECT *, flow / CAST(value_cents AS DOUBLE) AS x FROM lg)"""


@query(_PARTY + " SELECT ticker, party, round(regr_slope(r, x), 3) AS slope, round(corr(r, x), 6) AS correlation, count(*) AS n FROM pr GROUP BY ticker, party")
def slope_by_party(spark, sf_dir):
    return _parties(spark, sf_dir).groupBy("ticker", "party").agg(F.round(stats.slope("r", "x"), 3).alias("slope"), r6(stats.correlation("r", "x")).alias("correlation"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FLOWS} SELECT ticker, CAST(year(date) AS INTEGER) AS year, round(sum(p2) FILTER (WHERE p1 < 0) / -CAST(sum(p1) FILTER (WHERE p1 < 0) AS DOUBLE), 6) AS absorbed, round(corr(p1, p2), 6) AS correlation, round(quantile_cont(p2, 0.5), 2) AS median_flow
 FROM flow GROUP BY 1, 2 HAVING count(*) >= 60""")
def absorption_by_year(spark, sf_dir):
    f = flows(spark, sf_dir).groupBy("ticker", F.year("date").alias("year")).agg(
        r6(F.sum(F.when(F.col("p1") < 0, F.col("p2"))) / -F.sum(F.when(F.col("p1") < 0, F.col("p1"))).cast("double")).alias("absorbed"), r6(stats.correlation("p1", "p2")).alias("correlation"), F.round(F.median("p2"), 2).alias("median_flow"), F.count(F.lit(1)).alias("n"),
    )
    return f.where("n >= 60").drop("n")


_PAIRS = [(f"p{i}", f"p{j}") for i in range(1, 6) for j in range(i + 1, 6)]


@query(f"WITH {FLOWS} SELECT ticker, " + ", ".join(f"round(corr({a}, {b}), 5) AS {a}_{b}" for a, b in _PAIRS) + " FROM flow GROUP BY ticker")
def pearson_matrix(spark, sf_dir):
    return flows(spark, sf_dir).groupBy("ticker").agg(*[F.round(stats.correlation(a, b), 5).alias(f"{a}_{b}") for a, b in _PAIRS])


@query(f"""WITH {FLOWS}, o AS (SELECT ticker, (close / open - 1) AS y, p1 / CAST(value_cents AS DOUBLE) AS a, (row_number() OVER (PARTITION BY ticker ORDER BY date) - 1.0::DOUBLE) / (count(*) OVER (PARTITION BY ticker) - 1) AS t FROM flow),
 s AS (SELECT ticker, count(*)::DOUBLE AS n, sum(a) AS a, sum(a * t) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * a * t) AS ab, sum(a * t * a * t) AS bb, sum(a * y) AS ay, sum(a * t * y) AS by_ FROM o GROUP BY ticker)
 SELECT ticker, round((n * (aa * by_ - ay * ab) - a * (a * by_ - ay * b) + y * (a * ab - aa * b)) / (n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b)), 4) AS interaction FROM s""")
def interaction_coef(spark, sf_dir):
    f = flows(spark, sf_dir).select("ticker", "date", (F.col("close") / F.col("open") - 1).alias("y"), (F.col("p1") / F.col("value_cents")).alias("x"))
    out = stats.time_interaction(f, "y", "x", ["ticker"], "date")
    return out.select("ticker", F.round("interaction", 4).alias("interaction"))


@query()
def ols_r2(spark, sf_dir):
    """R2 of forward on trailing volatility, volume and the bar's span."""
    b = bars(spark, sf_dir).withColumn("vol", S.over(F.stddev_samp, "ret", -19, 0)).withColumn("ahead", S.over(F.stddev_samp, "ret", 1, 20)).withColumn("span", F.col("high") / F.col("low"))
    return stats.r_squared(b, "ahead", ["vol", "volume", "span"], ["ticker"])


@query(_VOL + """, h AS (SELECT v.*, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS ahead FROM v WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
 SELECT ticker, round(regr_r2(ahead, vol), 6) AS r2 FROM h GROUP BY ticker""")
def horizon_r2(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("vol", S.over(F.stddev_samp, "ret", -19, 0)).withColumn("ahead", S.over(F.stddev_samp, "ret", 1, 20))
    return b.groupBy("ticker").agg(r6(F.pow(stats.correlation("ahead", "vol"), 2)).alias("r2"))


# Returns and accounting


@query(f"""WITH {BARS} SELECT ticker, date, """ + ", ".join(f"round(lead(close, {h}) OVER w / lead(open, 1) OVER w - 1, 6) AS fwd{h}" for h in (1, 5, 20)) + """, round((lead(open) OVER w / open - 1) * 100, 6) AS open_to_open FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "date")
def future_returns(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", *[r6(accounting.future_return(h, S)).alias(f"fwd{h}") for h in (1, 5, 20)], r6(accounting.open_to_open(S)).alias("open_to_open"))


_NET = _CHANNEL + """, wt AS (SELECT ticker, date, coalesce(lag(position) OVER w, 0)::DOUBLE AS weight, lead(ret) OVER w * 100 AS r FROM sig WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 net AS (SELECT *, weight * r - abs(weight - coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY date), 0)) * (10 / 2) / 100 AS net FROM wt)"""


def weighted(spark, sf_dir, bps=10.0):
    w = signals(spark, sf_dir).withColumn("weight", F.coalesce(F.lag("position").over(S.rows), F.lit(0)).cast("double")).withColumn("r", F.lead("ret").over(S.rows) * 100)
    return w.withColumn("net", accounting.net_of_turnover("weight", "r", bps, S))


@query(_NET + " SELECT ticker, date, weight, round(net, 6) AS net FROM net", "date")
def turnover_cost(spark, sf_dir):
    return weighted(spark, sf_dir).select("ticker", "date", "weight", r6("net").alias("net"))


_SUMMARY = """, cl AS (SELECT {key}, date, weight, coalesce(net, 0) / 100 AS r FROM {source}), eq AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY {key} ORDER BY date)) AS e, weight - lag(weight) OVER (PARTITION BY {key} ORDER BY date) = 1 AS entry FROM cl),
 dr AS (SELECT *, e / max(e) OVER (PARTITION BY {key} ORDER BY date) - 1 AS d FROM eq), un AS (SELECT *, d < -1e-12 AS u, sum(CASE WHEN d < -1e-12 THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY date) AS g FROM dr),
 lg AS (SELECT {key}, max(n) AS longest FROM (SELECT {key}, g, count(*) FILTER (WHERE u) AS n FROM un GROUP BY {key}, g) GROUP BY {key}), q5 AS (SELECT {key}, quantile_cont(r * 100, 0.05) AS q FROM cl GROUP BY {key}),
 cv AS (SELECT {key}, avg(r * 100) AS cvar5 FROM cl JOIN q5 USING ({key}) WHERE r * 100 <= q GROUP BY {key})
 SELECT {key}, count(*) AS n, round((max_by(e, date) - 1) * 100, 4) AS total, round((pow(max_by(e, date), 252.0 / count(*)) - 1) * 100, 4) AS annual, round(min(d) * 100, 4) AS mdd, CAST(max(longest) AS BIGINT) AS longest_underwater,
  round(max(cvar5), 4) AS cvar5, round(avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END), 6) AS losing_share, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 5) AS sharpe, round(avg(weight), 6) AS exposure, CAST(count(*) FILTER (WHERE entry) AS BIGINT) AS trades
 FROM dr JOIN lg USING ({key}) JOIN cv USING ({key}) GROUP BY {key}"""


def _rounded(s):
    fours = {"total", "annual", "mdd", "cvar5"}
    return s.select(*[F.round(c, 4).alias(c) if c in fours else F.round(c, 5).alias(c) if c == "sharpe" else r6(c).alias(c) if c in ("losing_share", "exposure") else F.col(c) for c in s.columns])


@query(_NET + _SUMMARY.format(key="ticker", source="net"))
def strategy_summary(spark, sf_dir):
    return _rounded(accounting.summary(weighted(spark, sf_dir), "net", "weight", S))


@query(_CHANNEL + """, wt AS (SELECT ticker, date, coalesce(lag(position) OVER w, 0)::DOUBLE AS weight, lead(ret) OVER w * 100 AS r FROM sig WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 cst AS (SELECT unnest([5.0, 10.0, 25.0, 50.0]) AS bps), net AS (SELECT ticker || '|' || CAST(CAST(bps AS INTEGER) AS VARCHAR) AS run, date, weight, weight * r - abs(weight - coalesce(lag(weight) OVER (PARTITION BY ticker, bps ORDER BY date), 0)) * (bps / 2) / 100 AS net FROM wt, cst)"""
       + _SUMMARY.format(key="run", source="net"))
def cost_sensitivity(spark, sf_dir):
    each = weighted(spark, sf_dir).drop("net").withColumn("bps", F.explode(F.array(*[F.lit(x) for x in (5.0, 10.0, 25.0, 50.0)])))
    each = each.withColumn("run", F.concat("ticker", F.lit("|"), F.col("bps").cast("int").cast("string")))
    own = Series("run")
    turn = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(own.rows), F.lit(0.0)))
    return _rounded(accounting.summary(each.withColumn("net", F.col("weight") * F.col("r") - turn * (F.col("bps") / 2) / 100), "net", "weight", own))


@query(_CHANNEL + """, wt AS (SELECT ticker || '|' || year(date) AS slice, date, coalesce(lag(position) OVER w, 0)::DOUBLE AS weight, lead(ret) OVER w * 100 AS r FROM sig WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 net AS (SELECT *, weight * r - abs(weight - coalesce(lag(weight) OVER (PARTITION BY slice ORDER BY date), 0)) * (10 / 2) / 100 AS net FROM wt)""" + _SUMMARY.format(key="slice", source="net"))
def yearly_slice(spark, sf_dir):
    """The cost is charged anew at the start of each slice."""
    own = Series("slice")
    w = weighted(spark, sf_dir).drop("net").withColumn("slice", F.concat("ticker", F.lit("|"), F.year("date").cast("string")))
    return _rounded(accounting.summary(w.withColumn("net", accounting.net_of_turnover("weight", "r", 10.0, own)), "net", "weight", own))


@query(f"""WITH {BARS}, q AS (SELECT ticker, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS e FROM bars), d AS (SELECT *, least(0, e / greatest(1, max(e) OVER (PARTITION BY ticker ORDER BY date)) - 1) AS d FROM q)
 SELECT ticker, round(max_by(e, date) - 1, 6) AS total, round(min(d), 6) AS mdd, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(ret) FILTER (WHERE ret > 0) / abs(sum(ret) FILTER (WHERE ret < 0)), 5) AS profit_factor FROM d GROUP BY ticker""")
def risk_stats(spark, sf_dir):
    out = accounting.risk(bars(spark, sf_dir), "ret", S)
    return out.select("ticker", r6("total").alias("total"), r6("mdd").alias("mdd"), r6("win_rate").alias("win_rate"), F.round("profit_factor", 5).alias("profit_factor"))


@query(f"""WITH {BARS}, s AS (SELECT *, close > open AS up, volume > 1 AS busy FROM bars), t AS (SELECT ticker, date, open, close, lag(up, 1, false) OVER w AS h1, lag(busy, 1, false) OVER w AS h2 FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 m AS (SELECT ticker, date, name, c, CASE WHEN (CASE name WHEN 'up' THEN h1 WHEN 'busy' THEN h2 ELSE true END) THEN 0.02::DOUBLE * (close - open) / (close + open) - 0.001::DOUBLE * c ELSE 0 END AS r, (CASE name WHEN 'up' THEN h1 WHEN 'busy' THEN h2 ELSE true END) AS held FROM t, (SELECT unnest(['up', 'busy', 'hold']) AS name), (SELECT unnest([0, 1, 2]) AS c)),
 a AS (SELECT ticker, date, name, c, r, held FROM m UNION ALL SELECT 'portfolio', date, name, c, sum(r) / (SELECT count(DISTINCT ticker) FROM bars), bool_or(held) FROM m GROUP BY date, name, c)
 SELECT ticker, name, c AS cost_times, count(*) AS n, CAST(count(*) FILTER (WHERE held) AS BIGINT) AS active, round(exp(sum(ln(1 + r))) - 1, 6) AS total FROM a GROUP BY ticker, name, c""")
def strategy_matrix(spark, sf_dir):
    """Strategies by tickers by cost multiples, and the equal-weighted portfolio (a missing ticker earns 0)."""
    t = bars(spark, sf_dir)
    rules = {"up": F.lag(F.col("close") > F.col("open"), 1, False).over(S.rows), "busy": F.lag(F.col("volume") > 1, 1, False).over(S.rows), "hold": F.lit(True)}
    t = t.select("ticker", "date", "ret", F.array(*[F.struct(F.lit(k).alias("name"), v.alias("held")) for k, v in rules.items()]).alias("rules"))
    t = t.select("ticker", "date", "ret", F.explode("rules").alias("s")).select("ticker", "date", "ret", "s.*")
    m = t.withColumn("cost_times", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("r", F.when(F.col("held"), F.col("ret") - 0.001 * F.col("cost_times")).otherwise(0.0))
    n = t.agg(F.count_distinct("ticker").alias("_n"))  # one row
    whole = m.groupBy("date", "name", "cost_times").agg(F.sum("r").alias("r"), F.bool_or("held").alias("held")).crossJoin(n).withColumn("r", F.col("r") / F.col("_n")).drop("_n").withColumn("ticker", F.lit("portfolio"))
    every = m.select("ticker", "date", "name", "cost_times", "r", "held").unionByName(whole)
    return every.groupBy("ticker", "name", "cost_times").agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("active"), r6(F.product(1 + F.col("r")) - 1).alias("total"))


# The cross-sectional hypothesis: ranks, entries two periods later, exits, spreads.

_TRADES = _RANK + """, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM pan)),
 sg AS (SELECT bk.date AS signal_date, e.date AS entry_date, x.date AS exit_date, ticker, bucket FROM bk JOIN cal c ON bk.date = c.date JOIN cal e ON e.pos = c.pos + 2 JOIN cal x ON x.pos = c.pos + 3),
 al AS (SELECT sg.*, a.open AS entry_open, b.close AS exit_close, coalesce(a.is_listed AND a.is_tradable AND b.is_tradable AND a.open > 0 AND b.close > 0, false) AS ok FROM sg LEFT JOIN pan a ON a.date = entry_date AND a.ticker = sg.ticker LEFT JOIN pan b ON b.date = exit_date AND b.ticker = sg.ticker),
 tr AS (SELECT *, exit_close / entry_open - 1 AS gross FROM al WHERE ok)"""


def built(spark, sf_dir, lag=2, horizon=2, sectors=False, p=None):
    """The trades of the ranks: entry `lag` dates after the signal, exit on the horizon's last date."""
    p = panel(spark, sf_dir) if p is None else p
    days = timejoin.calendar(p)
    s = ranked(spark, sf_dir, sectors, p).select(F.col("date").alias("signal_date"), "ticker", "bucket")
    s = timejoin.shifted(s, days, "signal_date", lag, "entry_date")
    s = timejoin.shifted(s, days, "entry_date", horizon - 1, "exit_date").dropna(subset=["entry_date", "exit_date"])
    entry = p.select(F.col("date").alias("entry_date"), "ticker", F.col("open").alias("entry_open"), (F.col("is_listed") & F.col("is_tradable")).alias("entry_ok"))
    leave = p.select(F.col("date").alias("exit_date"), "ticker", F.col("close").alias("exit_close"), F.col("is_tradable").alias("exit_ok"))
    t = s.join(entry, ["entry_date", "ticker"], "left").join(leave, ["exit_date", "ticker"], "left")
    ok = F.coalesce(F.col("entry_ok") & F.col("exit_ok") & (F.col("entry_open") > 0) & (F.col("exit_close") > 0), F.lit(False))
    return t.withColumn("executable", ok).withColumn("gross_return", F.when(ok, F.col("exit_close") / F.col("entry_open") - 1))


@query(_TRADES + " SELECT signal_date, entry_date, exit_date, ticker, bucket, round(gross, 9) AS gross_return FROM tr", "signal_date entry_date exit_date")
def hypothesis_trades(spark, sf_dir):
    return built(spark, sf_dir).where("executable").select("signal_date", "entry_date", "exit_date", "ticker", "bucket", F.round("gross_return", 9).alias("gross_return"))


@query(_TRADES + " SELECT count(*) FILTER (WHERE bucket IN ('top', 'bottom') AND NOT ok) AS missing_selected, count(*) FILTER (WHERE ok) AS executable FROM al")
def missing_exits(spark, sf_dir):
    return built(spark, sf_dir).agg(F.count_if(F.col("bucket").isin("top", "bottom") & ~F.col("executable")).alias("missing_selected"), F.count_if("executable").alias("executable"))


@query(_TRADES + """, sp AS (SELECT entry_date, avg(gross) FILTER (WHERE bucket = 'top') AS top, avg(gross) FILTER (WHERE bucket = 'bottom') AS bottom, avg(gross) AS universe FROM tr GROUP BY entry_date),
 nn AS (SELECT *, row_number() OVER (ORDER BY entry_date) AS n FROM sp WHERE top IS NOT NULL AND bottom IS NOT NULL)
 SELECT entry_date, round(top, 6) AS top, round(bottom, 6) AS bottom, round(universe, 6) AS universe, round(top - 0.003, 6) AS top_net, round(universe - 0.003, 6) AS universe_net, round(top - universe, 6) AS top_excess, round(top - bottom - 2 * 0.003, 6) AS spread_net FROM nn WHERE (n - 1) % 2 = 0""", "entry_date")
def spread_table(spark, sf_dir):
    out = accounting.spreads(built(spark, sf_dir).where("executable"), 2, 30)
    return out.select("entry_date", *[r6(c).alias(c) for c in out.columns[1:]])
