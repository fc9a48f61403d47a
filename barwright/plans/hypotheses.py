"""Cross-sectional hypotheses by segment and cost: evaluation with draws and placebo, and the decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..functions.scalar import unit_interval
from ..operators import accounting, resample, stats
from ..operators.gates import Registration
from ..session import kept
from ..sources.derive import PANEL, panel
from .panels import built
from .registry import query, r6
from .studies import OF_HYPOTHESIS

#: Name, after, until (the first date out and the last date in).
SEGMENTS = [("research", None, "1997-12-31"), ("validation", "1997-12-31", "1999-12-31"), ("holdout", "1999-12-31", None)]
#: Name, holding periods, whether ranks are within sectors.
HYPOTHESES = [("H1", 1, False), ("H2", 5, False), ("H3", 1, True)]
COSTS = [1.0, 1.5, 2.0]
BPS, BLOCK = 30.0, 10
#: Observations that validation and holdout need, and the deepest drawdown that passes.
LEAST, MOST_DRAWDOWN = 12, 0.9


def trades(spark, sf_dir):
    """The trades of all hypotheses in one table. The panel is made once and kept, so that the lines are read once."""
    p = kept(panel(spark, sf_dir), "panel")
    out = None
    for name, horizon, sectors in HYPOTHESES:
        part = built(spark, sf_dir, horizon=horizon, sectors=sectors, p=p).select(F.lit(name).alias("hypothesis"), "entry_date", "bucket", "executable", "gross_return")
        out = part if out is None else out.unionByName(part)
    return kept(out, "trades")


def runs(all_trades):
    """Spreads of each hypothesis, segment and cost: run, date, leg and the returns."""
    out = None
    for name, horizon, _ in HYPOTHESES:
        part = accounting.spreads(all_trades.where((F.col("hypothesis") == name) & F.col("executable")), horizon, 0.0).withColumn("hypothesis", F.lit(name))
        out = part if out is None else out.unionByName(part)
    segment = F.lit(None).cast("string")
    for name, after, until in SEGMENTS:
        inside = (F.col("entry_date") > F.lit(after or "0001-01-01").cast("date")) & (F.col("entry_date") <= F.lit(until or "9999-12-31").cast("date"))
        segment = F.when(inside, name).otherwise(segment)
    each = out.withColumn("segment", segment).withColumn("cost", F.explode(F.array(*map(F.lit, COSTS)))).withColumn("leg", F.col("cost") * BPS / 10_000)
    run, gross = F.concat_ws("|", "hypothesis", F.col("cost").cast("string"), "segment"), F.col("top") - F.col("bottom")
    own = ["hypothesis", "cost", "segment", run.alias("run"), F.col("entry_date").alias("date"), "leg", "top_excess"]
    return each.select(*own, (F.col("top") - F.col("leg")).alias("top_net"), gross.alias("gross"), (gross - 2 * F.col("leg")).alias("spread_net"))


def detail(all_trades):
    """Of each hypothesis, cost and segment: means, bounds and p of block draws, the placebo's bound, risk, and q over the holdouts of one cost."""
    each = kept(runs(all_trades), "runs")
    facts = each.groupBy("run", "hypothesis", "cost", "segment").agg(
        F.count(F.lit(1)).alias("observations"), F.avg("spread_net").alias("spread_net_mean"), F.avg("top_net").alias("top_net_mean"), F.avg("top_excess").alias("top_excess"),
    )
    p = resample.positioned(each, "date", "run").select("run", "pos", "n", "top_net", "spread_net", "gross", "leg")
    starts = resample.hashed_starts(p.select("run", "n").distinct(), ["run"], OF_HYPOTHESIS, BLOCK, 31)
    drawn = resample.draw_values(starts, p, BLOCK, {c: resample.mean(F.col(f"{c}_net")) for c in ("spread", "top")}, ["run"])
    for c in ("spread", "top"):
        i = resample.interval(drawn, c, ["run"])
        facts = facts.join(i.select("run", F.col("ci_low").alias(f"{c}_ci_low"), F.col("ci_high").alias(f"{c}_ci_high"), F.round("p_one", 9).alias(f"{c}_p")), "run", "left")
    # The sign of a block in a draw; a block's sum is made once.
    blocks = p.groupBy("run", "n", "leg", F.floor(F.col("pos") / BLOCK).alias("blk")).agg(F.sum("gross").alias("gross"))
    signs = blocks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(OF_HYPOTHESIS - 1))))
    u = unit_interval(F.lit("5"), "run", F.col("draw").cast("string"), F.col("blk").cast("string"))
    flipped = signs.groupBy("run", "draw").agg((F.sum(F.when(u < 0.5, -F.col("gross")).otherwise(F.col("gross"))) / F.max("n") - 2 * F.max("leg")).alias("m"))
    flipped = flipped.groupBy("run").agg(F.percentile("m", F.lit(0.95)).alias("placebo_95"))
    risk = accounting.risk(each.select("run", "date", "top_net"), "top_net", Series("run"))
    # Growth as a logarithm: a monthly return of one, as the derived prices give, makes totals beyond a double's digits.
    risk = risk.withColumn("growth", F.log(1 + F.col("total"))).drop("total")
    facts = facts.join(flipped, "run", "left").join(risk, "run", "left").drop("run")
    held = F.col("segment") == "holdout"
    for c in ("spread", "top"):
        facts = stats.false_discovery(facts.withColumn("_p", F.when(held, F.col(f"{c}_p"))), "_p", f"{c}_q", ["cost"]).drop("_p")
    return facts


def _ranks_sql(name: str, by: str) -> str:
    return f""" rk{name} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY x, ticker) / CAST(n AS DOUBLE) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM el) WHERE n >= 10)"""


def _trades_sql(name: str, horizon: int, sectors: bool) -> str:
    return f"""SELECT '{name}' AS hypothesis, {horizon} AS horizon, e.date AS entry_date, bucket, a.open AS entry_open, b.close AS exit_close,
   coalesce(a.is_listed AND a.is_tradable AND b.is_tradable AND a.open > 0 AND b.close > 0, false) AS ok
  FROM (SELECT *, CASE WHEN rank <= 0.1 THEN 'bottom' WHEN rank > 1 - 0.1::DOUBLE THEN 'top' ELSE 'middle' END AS bucket FROM rk{'s' if sectors else 'd'}) s
  JOIN cal c ON s.date = c.date JOIN cal e ON e.pos = c.pos + 2 JOIN cal x ON x.pos = c.pos + {2 + horizon - 1}
  LEFT JOIN pan a ON a.date = e.date AND a.ticker = s.ticker LEFT JOIN pan b ON b.date = x.date AND b.ticker = s.ticker"""


_SEGMENT = "CASE " + " ".join(f"WHEN entry_date <= '{until}' THEN '{name}'" for name, _, until in SEGMENTS if until) + f" ELSE '{SEGMENTS[-1][0]}' END"


def _p_sql(c: str) -> str:
    return f"quantile_cont({c}, 0.025) AS {c}_ci_low, quantile_cont({c}, 0.975) AS {c}_ci_high, round((count(*) FILTER (WHERE {c} <= 0) + 1) / (count({c}) + 1), 9) AS {c}_p"


def _q_sql(c: str) -> str:
    """Benjamini-Hochberg over the holdouts of one cost; ties in p get one q whatever their order."""
    return f"""CASE WHEN h{c} IS NOT NULL THEN least(1.0, min(r{c}) OVER (PARTITION BY cost, h{c} IS NULL ORDER BY h{c} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {c}_q"""


_DETAIL = f"""WITH {PANEL}, el AS (SELECT *, foreign_net_value / CAST(trading_value AS DOUBLE) AS x, CAST(ticker AS BIGINT) % 2 AS sector FROM pan WHERE is_tradable AND trading_value >= 1000000 AND open > 0 AND close > 0),
 {_ranks_sql("d", "date")}, {_ranks_sql("s", "date, sector")}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM pan)),
 al AS ({" UNION ALL ".join(_trades_sql(*h) for h in HYPOTHESES)}),
 sp AS (SELECT hypothesis, horizon, entry_date, avg(exit_close / entry_open - 1) FILTER (WHERE bucket = 'top') AS top, avg(exit_close / entry_open - 1) FILTER (WHERE bucket = 'bottom') AS bottom,
   avg(exit_close / entry_open - 1) AS universe FROM al WHERE ok GROUP BY ALL),
 sm AS (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY entry_date) AS k FROM sp WHERE top IS NOT NULL AND bottom IS NOT NULL),
 ru AS (SELECT hypothesis, cost, {_SEGMENT} AS segment, hypothesis || '|' || cost || '|' || {_SEGMENT} AS run, entry_date AS date, cost * {BPS}::DOUBLE / 10000 AS leg, top - universe AS top_excess,
   top - cost * {BPS}::DOUBLE / 10000 AS top_net, top - bottom AS gross, top - bottom - 2 * (cost * {BPS}::DOUBLE / 10000) AS spread_net
  FROM sm, (SELECT unnest({COSTS}::DOUBLE[]) AS cost) WHERE (k - 1) % horizon = 0),
 po AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY run) AS n FROM ru),
 ln AS (SELECT DISTINCT run, n FROM po), bl AS (SELECT run, n, draw, unnest(range(CAST(ceil(n / {BLOCK}) AS BIGINT))) AS blk FROM ln, range({OF_HYPOTHESIS}) t(draw)),
 un AS (SELECT *, ('0x' || substr(sha256('31|' || run || '|' || draw || '|' || blk), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS u, ('0x' || substr(sha256('5|' || run || '|' || draw || '|' || blk), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS v FROM bl),
 sta AS (SELECT *, least(CAST(floor(u * n) AS BIGINT), n - 1) AS start FROM un),
 ix AS (SELECT run, draw, blk * {BLOCK} + off AS place, (start + off) % n AS pos, n FROM sta, range({BLOCK}) o(off)),
 dr AS (SELECT i.run, draw, avg(top_net) AS top, avg(spread_net) AS spread FROM ix i JOIN po ON i.run = po.run AND i.pos = po.pos WHERE place < i.n GROUP BY i.run, draw),
 pv AS (SELECT run, {_p_sql("spread")}, {_p_sql("top")} FROM dr GROUP BY run),
 fl AS (SELECT s.run, draw, avg(gross * CASE WHEN v < 0.5 THEN -1 ELSE 1 END) - 2 * max(leg) AS m FROM sta s JOIN po ON s.run = po.run AND s.blk = po.pos // {BLOCK} GROUP BY s.run, draw),
 pl AS (SELECT run, quantile_cont(m, 0.95) AS placebo_95 FROM fl GROUP BY run),
 eq AS (SELECT run, date, top_net, exp(sum(ln(1 + top_net)) OVER (PARTITION BY run ORDER BY date)) AS e, sum(CASE WHEN top_net < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY date) AS isl FROM ru),
 dn AS (SELECT *, least(0, e / greatest(1, max(e) OVER (PARTITION BY run ORDER BY date)) - 1) AS d, count(*) FILTER (WHERE top_net < 0) OVER (PARTITION BY run, isl) AS streak FROM eq),
 rs AS (SELECT run, ln(max_by(e, date)) AS growth, min(d) AS mdd, avg(CASE WHEN top_net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
   CASE WHEN count(*) FILTER (WHERE top_net < 0) > 0 THEN coalesce(sum(top_net) FILTER (WHERE top_net > 0), 0) / abs(sum(top_net) FILTER (WHERE top_net < 0)) ELSE 'inf'::DOUBLE END AS profit_factor, max(streak) AS losing_streak FROM dn GROUP BY run),
 fa AS (SELECT run, hypothesis, cost, segment, count(*) AS observations, avg(spread_net) AS spread_net_mean, avg(top_net) AS top_net_mean, avg(top_excess) AS top_excess FROM ru GROUP BY ALL),
 jo AS (SELECT fa.*, pv.* EXCLUDE (run), placebo_95, rs.* EXCLUDE (run), CASE WHEN segment = 'holdout' THEN spread_p END AS hspread, CASE WHEN segment = 'holdout' THEN top_p END AS htop
  FROM fa LEFT JOIN pv USING (run) LEFT JOIN pl USING (run) LEFT JOIN rs USING (run)),
 rw AS (SELECT *, {", ".join(f"h{c} * count(h{c}) OVER (PARTITION BY cost) / row_number() OVER (PARTITION BY cost, h{c} IS NULL ORDER BY h{c}) AS r{c}" for c in ("spread", "top"))} FROM jo),
 de AS (SELECT * EXCLUDE (hspread, htop, rspread, rtop, run), {_q_sql("spread")}, {_q_sql("top")} FROM rw)"""
#: What the queries show rounded.
_NUMBERS = [
    "spread_net_mean", "top_net_mean", "top_excess", "spread_ci_low", "spread_ci_high", "spread_p", "top_ci_low", "top_ci_high", "top_p", "placebo_95", "growth", "mdd", "win_rate", "profit_factor", "spread_q", "top_q",
]


@query(_DETAIL + f" SELECT hypothesis, cost, segment, observations, losing_streak, {', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)} FROM de")
def hypothesis_detail(spark, sf_dir):
    """Three hypotheses by three costs by three segments."""
    out = detail(trades(spark, sf_dir))
    return out.select("hypothesis", "cost", "segment", "observations", "losing_streak", *[r6(c).alias(c) for c in _NUMBERS])


def _checks_sql() -> list[tuple[str, str]]:
    """The checks of a decision in order, over v (validation) and h (holdout)."""
    return [
        ("validation''s return bound above 0", "v.top_ci_low > 0"), ("holdout''s return q below 0.05", "h.top_q < 0.05"), ("returns above 0", "v.top_net_mean > 0 AND h.top_net_mean > 0"),
        ("validation''s spread bound above 0", "v.spread_ci_low > 0"), ("holdout''s spread q below 0.05", "h.spread_q < 0.05"), ("holdout''s spread above its placebo", "h.spread_net_mean > h.placebo_95"),
        ("above the universe", "v.top_excess > 0 AND h.top_excess > 0"), ("drawdown within bounds", f"v.mdd >= -{MOST_DRAWDOWN} AND h.mdd >= -{MOST_DRAWDOWN}"),
    ]


@query(_DETAIL + f""", gone AS (SELECT hypothesis, count(*) FILTER (WHERE bucket IN ('top', 'bottom') AND NOT ok) AS missing FROM al GROUP BY hypothesis),
 v AS (SELECT * FROM de WHERE cost = 2 AND segment = 'validation'), h AS (SELECT * FROM de WHERE cost = 2 AND segment = 'holdout'),
 jn AS (SELECT coalesce(v.hypothesis, h.hypothesis) AS hypothesis, coalesce(v.observations < {LEAST} OR h.observations < {LEAST}, true) AS few,
   {", ".join(f"coalesce({sql}, false) AS k{i}" for i, (_, sql) in enumerate(_checks_sql()))} FROM v FULL JOIN h ON v.hypothesis = h.hypothesis),
 wt AS (SELECT jn.hypothesis, concat_ws('; ', CASE WHEN few THEN 'too few observations' END, CASE WHEN missing > 0 THEN missing || ' selected rows without prices' END) AS waits,
   concat_ws('; ', {", ".join(f"CASE WHEN NOT k{i} THEN '{name}' END" for i, (name, _) in enumerate(_checks_sql()))}) AS failed FROM jn LEFT JOIN gone USING (hypothesis))
 SELECT hypothesis, CASE WHEN waits <> '' THEN 'NOT_READY' WHEN failed <> '' THEN 'FAIL' ELSE 'PASS' END AS status, waits, failed FROM wt""")
def hypothesis_decision(spark, sf_dir):
    """PASS, FAIL or NOT_READY of each hypothesis at double cost, with the checks that fail.

    NOT_READY: too few observations in validation or holdout, or selected rows without a price on entry or exit.
    """
    return decision(spark, sf_dir, Registration(sf_dir, "real", SEGMENTS[0][2], SEGMENTS[1][2], MOST_DRAWDOWN))


def decision(spark, sf_dir, plan):
    """The same under a registration; where that lacks anything, every hypothesis waits for it and no row is read."""
    if lack := plan.lacks():
        return spark.createDataFrame([(name, "NOT_READY", lack, "") for name, _, _ in HYPOTHESES], "hypothesis string, status string, waits string, failed string")
    most = plan.most_drawdown
    t = trades(spark, sf_dir)
    d = detail(t).where("cost = 2.0")
    side = lambda s: d.where(F.col("segment") == s).select("hypothesis", F.struct(*[c for c in d.columns if c != "hypothesis"]).alias(s))
    both = side("validation").join(side("holdout"), "hypothesis", "full")
    gone = t.groupBy("hypothesis").agg(F.count_if(F.col("bucket").isin("top", "bottom") & ~F.col("executable")).alias("missing"))
    both = both.join(gone, "hypothesis", "left")
    v, h = F.col("validation"), F.col("holdout")
    checks = {
        "validation's return bound above 0": v["top_ci_low"] > 0, "holdout's return q below 0.05": h["top_q"] < 0.05, "returns above 0": (v["top_net_mean"] > 0) & (h["top_net_mean"] > 0),
        "validation's spread bound above 0": v["spread_ci_low"] > 0, "holdout's spread q below 0.05": h["spread_q"] < 0.05, "holdout's spread above its placebo": h["spread_net_mean"] > h["placebo_95"],
        "above the universe": (v["top_excess"] > 0) & (h["top_excess"] > 0), "drawdown within bounds": (v["mdd"] >= -most) & (h["mdd"] >= -most),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    few = F.coalesce((v["observations"] < LEAST) | (h["observations"] < LEAST), F.lit(True))
    waits = F.array_compact(F.array(F.when(few, "too few observations"), F.when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" selected rows without prices")))))
    status = F.when(F.size(waits) > 0, "NOT_READY").when(F.size(failed) > 0, "FAIL").otherwise("PASS")
    return both.select("hypothesis", status.alias("status"), F.concat_ws("; ", waits).alias("waits"), F.concat_ws("; ", failed).alias("failed"))
