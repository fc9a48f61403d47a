"""Draws from block sums and block lists against draws written out row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import resample, stats

KEYS = ["ticker"]


@pytest.fixture(scope="module", params=[1, 4, 5, 23, 61])
def drawn(spark, request):
    """Two series of a length that the block does or doesn't divide, with nulls; their draws row by row."""
    rng, n = np.random.default_rng(request.param), request.param
    rows = [(t, i, *(None if rng.random() < 0.1 else float(v) for v in rng.normal(size=2)), bool(rng.random() < 0.4)) for t in "ab" for i in range(n + (t == "b"))]
    series = resample.positioned(spark.createDataFrame(rows, "ticker string, date int, x double, y double, f boolean"), "date", "ticker").cache()
    starts = resample.hashed_starts(series.select("ticker", "n").distinct(), KEYS, 20, 5, 3).cache()
    return series, starts, resample.drawn(starts, series, 5, KEYS).toPandas()


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9


def test_values_from_block_sums(drawn):
    series, starts, rows = drawn
    own = {
        "mean": resample.mean(F.col("y")), "excess": resample.excess(F.col("y"), F.col("f")), "slope": resample.slope_of(F.col("y"), F.col("x")),
        "share": resample.Statistic({"up": F.when(F.col("f"), 1.0), "n": F.lit(1.0)}, lambda s: F.coalesce(s["up"], F.lit(0.0)) / s["n"]),
    }
    got = {(r.ticker, r.draw): r for r in resample.draw_values(starts, series, 5, own, KEYS).collect()}
    assert len(got) == 40 == rows.groupby(["ticker", "draw"]).ngroups
    for key, g in rows.groupby(["ticker", "draw"]):
        y, both = g.y.dropna(), g.dropna(subset=["x", "y"])
        up = g.y[g.f].dropna()
        want = {"mean": y.mean() if len(y) else None, "excess": up.mean() - y.mean() if len(up) else None, "share": g.f.mean(), "slope": None}
        if len(both) >= 3 and both.x.nunique() > 1:
            want["slope"] = np.cov(both.x, both.y, bias=True)[0, 1] / both.x.var(ddof=0)
        assert all(near(got[key][c], w) for c, w in want.items()), (key, got[key], want)


def test_interaction_from_block_sums_is_that_of_the_rows(drawn):
    series, _, _ = drawn
    timed = resample.positioned(stats.with_time(series.drop("pos", "n"), "y", "x", KEYS, "date"), "date", "ticker")
    got = {r.ticker: r.v for r in resample.row_values(timed, {"v": resample.interaction_of(F.col("a"), F.col("b"), F.col("y"))}, KEYS).collect()}
    for r in stats.interaction(timed, KEYS).collect():
        assert near(got[r.ticker], r.interaction)


def test_tails_from_block_lists(drawn):
    series, starts, rows = drawn
    got = {(r.ticker, r.draw): r.difference for r in resample.tail_draws(starts, series, 5, "y", "f", KEYS, 0.3, 2).collect()}
    tail = lambda v: v[v <= np.quantile(v, 0.3) + 1e-12].mean() if len(v) >= 2 else None
    for key, g in rows.groupby(["ticker", "draw"]):
        up, down = tail(g.y[g.f].dropna()), tail(g.y[~g.f].dropna())
        assert near(got[key], None if up is None or down is None else up - down)


def test_each_series_has_draws_of_its_own(spark):
    lengths = spark.createDataFrame([("a", 50), ("b", 50)], "ticker string, n long")
    starts = resample.hashed_starts(lengths, KEYS, 30, 5, 3).toPandas()
    a, b = (starts[starts.ticker == t].sort_values(["draw", "blk"]).start.tolist() for t in "ab")
    assert len(a) == len(b) == 300 and a != b and set(a) | set(b) <= set(range(50))


def test_fewer_rows_are_joined_than_drawn(drawn):
    """A draw joins a row for each of its blocks, not each of its rows."""
    series, starts, rows = drawn
    joined = starts.count()
    assert joined == sum(-(-n // 5) * 20 for n in series.groupBy("ticker").count().toPandas()["count"])
    assert len(rows) == 20 * series.count()
