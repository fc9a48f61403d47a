"""Scans over chunks against the plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from barwright.functions.rolling import Series
from barwright.operators import scan, state

S = Series()


def series(spark, rows, columns):
    return spark.createDataFrame(rows, f"ticker string, n int, {columns}").select("*", F.date_add(F.lit("2001-01-01").cast("date"), F.col("n")).alias("date")).repartition(5)


def both(a, b, columns):
    key = lambda r: (str(r.ticker), str(r.date))
    x, y = (sorted(d.select("ticker", "date", *columns).collect(), key=key) for d in (a, b))
    assert len(x) == len(y) > 0
    for p, q in zip(x, y, strict=True):
        assert p[:2] == q[:2] and all(u == v or u is not None and v is not None and abs(u - v) < 1e-9 for u, v in zip(p[2:], q[2:], strict=True)), (p, q)


@pytest.fixture(scope="module")
def walk(spark):
    """Three series of random bars, one with gaps, one of few rows, with nulls; one row a series at the least."""
    r, rows = random.Random(8), []
    for ticker, n, gap in (("a", 700, 1), ("b", 400, 9), ("c", 7, 1), ("d", 1, 1)):
        price, day = 100.0, 0
        for _ in range(n):
            day += r.choice([1, 1, gap])
            price = max(5, price + r.choice([-4, -2, -1, 0, 1, 2, 4]))
            low = None if r.random() < 0.05 else price - r.randrange(3)
            rows.append((ticker, day, price + r.randrange(3), low, price, None if r.random() < 0.05 else r.uniform(-0.1, 0.1)))
    return series(spark, rows, "high double, low double, close double, ret double").cache()


@pytest.mark.parametrize("rows", [1, 3, 50, 10_000])
def test_chunks_are_bounded_and_in_order(spark, walk, rows):
    spans, _ = scan.chunk_table(walk, rows, S)
    chunked = scan.cut(walk, rows, S)
    sizes = chunked.groupBy("ticker", scan.CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    assert sizes.agg(F.max("n")).head()[0] < rows + spans.agg(F.max("_n")).head()[0]
    found = sorted((r.ticker, r[scan.CHUNK], r.a, r.b) for r in sizes.collect())
    assert all(p[0] != q[0] or p[3] < q[2] for p, q in zip(found, found[1:], strict=False))
    assert chunked.count() == walk.count()


@pytest.mark.parametrize(("rows", "before"), [(3, 20), (50, 20), (30, 100), (10_000, 5)])
def test_halo_gives_rolling_windows_what_they_need(walk, rows, before):
    own = scan.within(S)
    want = walk.withColumn("top", S.over(F.max, "high", -before, -1)).withColumn("n_low", F.count("low").over(S.frame(-before, 0)))
    got = scan.with_halo(scan.cut(walk, rows, S), before, S)
    got = scan.without_halo(got.withColumn("top", own.over(F.max, "high", -before, -1)).withColumn("n_low", F.count("low").over(own.frame(-before, 0))))
    both(got, want, ["top", "n_low"])


@pytest.mark.parametrize("rows", [1, 7, 50, 10_000])
def test_position(walk, rows):
    """Entries, exits, both at once (turns) and rows that aren't live."""
    entry, exit_, live = F.xxhash64("date", F.lit(1)) % 9 == 0, F.xxhash64("date", F.lit(2)) % 7 == 0, F.xxhash64("date", F.lit(3)) % 5 != 0
    both(scan.scanned_position(scan.cut(walk, rows, S), entry, exit_, live, S), state.position(walk, entry, exit_, live, S), ["position"])
    turn = F.xxhash64("date", F.lit(4)) % 3 == 0
    both(scan.scanned_position(scan.cut(walk, rows, S), turn, turn, F.lit(True), S), state.position(walk, turn, turn, F.lit(True), S), ["position"])
    columns = ["dc_high", "dc_low", "position"]
    both(scan.scanned_channel(walk, 20, 10, rows, S), state.channel_signals(walk, 20, 10, S), columns)


@pytest.mark.parametrize("rows", [1, 7, 50, 10_000])
@pytest.mark.parametrize("share", [2, 40, 10**9])
def test_rally(walk, rows, share):
    correction = F.xxhash64("ticker", "date") % share != 0
    got = scan.scanned_rally(scan.cut(walk, rows, S), correction, series=S)
    both(got, state.rally(walk, correction, series=S), ["in_correction", "rally_day", "rally_low"])


@pytest.mark.parametrize("rows", [1, 7, 50, 10_000])
@pytest.mark.parametrize("one", [False, True])
def test_equity(walk, rows, one):
    w = walk.withColumn("ret", F.when(F.xxhash64("date") % 97 == 0, -1.2).otherwise(F.col("ret")))
    want = w.withColumn("equity", S.equity("ret")).withColumn("drawdown", S.drawdown("equity", one))
    both(scan.scanned_equity(scan.cut(w, rows, S), "ret", S, one), want, ["equity", "drawdown"])


def test_no_task_holds_a_series(walk):
    """Every window and join of the plan is by chunk, or over the table of chunks."""
    plan = scan.scanned_channel(walk, 20, 10, 50, S)._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window" in line and "high" in line]
    assert over_rows and all("_chunk" in line for line in over_rows)


def test_empty(walk):
    assert scan.scanned_channel(walk.limit(0), 20, 10, 50, S).count() == 0
