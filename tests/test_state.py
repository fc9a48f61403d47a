"""Windows against plain loops, on random and awkward series."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions.rolling import Series
from barwright.operators import accounting, state

S = Series()


def frame(spark, seed, n=160, tickers=("a", "b")):
    rng, rows = random.Random(seed), []
    for t in tickers:
        price = 100.0
        for i in range(n):
            price *= 1 + rng.choice([-0.06, -0.02, 0, 0.01, 0.05])
            high = None if rng.random() < 0.03 else round(price * (1 + 0.02 * rng.random()), 2)
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(days=i), round(price, 2), high, round(price * 0.98, 2), round(price, 2), None if rng.random() < 0.05 else rng.randint(1, 9)))
    rows.append(("lone", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long")


def by_ticker(df):
    return {t: p.sort_values("date").reset_index(drop=True) for t, p in df.toPandas().groupby("ticker")}


@pytest.mark.parametrize("seed", range(3))
def test_positions(spark, seed):
    for p in by_ticker(state.channel_signals(frame(spark, seed), 5, 3, S)).values():
        on, want = 0, []
        for i in range(len(p)):
            highs, lows = p.high[max(0, i - 5) : i], p.low[max(0, i - 3) : i]
            top = highs.max() if len(highs) == 5 and highs.notna().all() else None
            bottom = lows.min() if len(lows) == 3 else None
            if top is None:
                want.append(0)
                continue
            entry, leave = p.close[i] > top, bottom is not None and p.close[i] < bottom
            if on == 0 and entry:
                on = 1
            elif on == 1 and leave:
                on = 0
            want.append(on)
        assert p.position.tolist() == want


def test_both_signals_switch(spark):
    rows = [("a", i, bool(e), bool(x), bool(v)) for i, (e, x, v) in enumerate([(1, 1, 1), (1, 1, 1), (0, 0, 1), (1, 0, 1), (1, 1, 1), (1, 1, 0), (0, 0, 1), (1, 1, 1), (0, 1, 1)])]
    df = spark.createDataFrame(rows, "ticker string, date int, e boolean, x boolean, v boolean")
    out = state.position(df, F.col("e"), F.col("x"), F.col("v"), S).orderBy("date")
    assert [r.position for r in out.collect()] == [1, 0, 0, 1, 0, 0, 0, 1, 0]


@pytest.mark.parametrize("seed", range(3))
def test_rally(spark, seed):
    df = frame(spark, seed).withColumn("peak", S.over(F.max, "close", -39, 0, 10))
    out = state.rally(df, F.col("close") < F.col("peak") * 0.9, series=S)
    for p in by_ticker(out).values():
        day, low = 0, float("inf")
        for r in p.itertuples():
            if not (pd.notna(r.peak) and r.close < r.peak * 0.9):
                day, low = 0, float("inf")
            elif r.low <= low:
                day, low = 1, r.low
            else:
                day += 1
            assert r.rally_day == day and (day == 0) == pd.isna(r.rally_low)


def test_runs_and_contributions(spark):
    df = frame(spark, 7).withColumn("r", F.when(F.pmod(F.hash("ticker", "date"), F.lit(3)) == 0, -0.01).otherwise(0.008))
    streak = {r.ticker: r.n for r in state.longest_run(df, F.col("r") < 0, "n", S).collect()}
    value = by_ticker(state.contributions(df, "r", F.when(F.dayofmonth("date") == 1, 10.0).otherwise(0.0), S))
    for t, p in value.items():
        best = now = 0
        v = 0.0
        for r in p.itertuples():
            now = now + 1 if r.r < 0 else 0
            best = max(best, now)
            v = (v + (10.0 if r.date.day == 1 else 0.0)) * (1 + r.r)
            assert np.isclose(v, r.value)
        assert streak[t] == best


def test_rolling_follows_pandas(spark):
    df = frame(spark, 3).withColumn("v", F.col("volume").cast("double"))
    out = df.select("*", S.over(F.stddev_samp, "v", -4, 0).alias("sd"), S.over(F.avg, "v", 1, 3).alias("ahead"), S.correlation("v", "close", 6).alias("c"), S.trailing_rank("close", 8).alias("rank"))
    for p in by_ticker(out).values():
        assert np.allclose(p.sd.astype(float), p.v.rolling(5).std(), equal_nan=True)
        assert np.allclose(p.ahead.astype(float), p.v[::-1].rolling(3).mean()[::-1].shift(-1), equal_nan=True)
        want = p.v.rolling(6).corr(p.close.where(p.v.notna())) if len(p) > 6 else pd.Series([np.nan] * len(p))
        got, ok = p.c.astype(float), np.isfinite(want)
        assert np.allclose(got[ok & got.notna()], want[ok & got.notna()])
        assert np.allclose(p["rank"].astype(float), p.close.rolling(8).rank(pct=True), equal_nan=True)


def test_constant_and_empty(spark):
    df = spark.createDataFrame([("a", i, 1.0, 2.0) for i in range(10)], "ticker string, date int, x double, y double")
    assert all(r.c is None for r in df.select(S.correlation("x", "y", 3).alias("c")).collect())
    assert state.channel_signals(frame(spark, 1).limit(0), 5, 3, S).count() == 0


def test_costs(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 0.5, None), ("a", 2, 0.0, 1.0)], "ticker string, date int, w double, r double")
    net = lambda bps: [r.n for r in df.select("date", accounting.net_of_turnover("w", "r", bps, S).alias("n")).orderBy("date").collect()]
    assert net(0) == [2.0, None, 0.0]
    assert np.isclose(net(10)[0], 2.0 - 0.05) and net(10)[1] is None and np.isclose(net(10)[2], -0.025)
    totals = [accounting.summary(df.withColumn("n", accounting.net_of_turnover("w", "r", b, S)), "n", "w", S).first().total for b in (0, 10, 50)]
    assert totals[0] > totals[1] > totals[2]


def test_first_loss_counts(spark):
    df = spark.createDataFrame([("a", 0, -0.5), ("a", 1, 0.1)], "ticker string, date int, r double")
    row = accounting.risk(df, "r", S).first()
    assert np.isclose(row.mdd, -0.5) and row.losing_streak == 1 and np.isclose(row.profit_factor, 0.2)
