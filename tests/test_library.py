"""Resampling, gates, parsing, the store, readers and streams."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.functions import scalar
from barwright.functions.rolling import Series
from barwright.operators import gates, resample, state, stats, timejoin, xsection
from barwright.plans.queries import QUERIES
from barwright.sources import history, readers
from barwright.sources.normalise import normalised, records
from barwright.sources.registry import DATASETS
from barwright.sources.store import PanelStore

S = Series()


def test_bootstrap_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    x, flag = rng.normal(size=57), rng.random(57) < 0.4
    df = spark.createDataFrame([(i, float(v), bool(f)) for i, (v, f) in enumerate(zip(x, flag, strict=True))], "date int, r double, f boolean")
    p = resample.positioned(df, "date")
    draws = resample.drawn(resample.seeded_starts(spark, 57, 40, 5, 9), p, 5)
    got = [r.excess for r in resample.conditional_excess(draws, "r", F.col("f"), []).orderBy("draw").collect()]
    g, want = np.random.default_rng(9), []
    for _ in range(40):
        starts = g.integers(0, 57, math.ceil(57 / 5))
        idx = ((starts[:, None] + np.arange(5)) % 57).ravel()[:57]
        want.append(x[idx][flag[idx]].mean() - x[idx].mean())
    assert np.allclose(got, want)
    row = resample.interval(resample.conditional_excess(draws, "r", F.col("f"), []), "excess", []).first()
    assert np.allclose([row.ci_low, row.ci_high], np.quantile(want, [0.025, 0.975]))
    assert np.isclose(row.p_one, (np.count_nonzero(np.array(want) <= 0) + 1) / 41)


def test_placebos(spark):
    df = resample.positioned(spark.createDataFrame([(i, i % 10 < 5, float(i)) for i in range(23)], "date int, f boolean, r double"), "date")
    out = resample.permuted(df, "f", 5, 1, "p").orderBy("pos").toPandas()
    assert out.p.sum() == out.f.sum() and len(out) == 23
    order, want = np.random.default_rng(1).permutation(5), []
    for b in order:
        want += out.f[b * 5 : b * 5 + 5].tolist()
    assert out.p.tolist() == want
    bound = resample.sign_flip_bound(df, "r", 10, 50, 5, 2).first()[0]
    g = np.random.default_rng(2)
    means = [(np.arange(23) * np.repeat(g.choice([-1.0, 1.0], 5), 5)[:23]).mean() - 0.002 for _ in range(50)]
    assert np.isclose(bound, np.quantile(means, 0.95))


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.80, None]
    out = stats.false_discovery(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double"), "p").orderBy("i").toPandas()
    assert np.allclose(out.q[:4], [0.04, 0.16 / 3, 0.16 / 3, 0.8]) and np.isnan(out.q[4])


def test_as_of(spark):
    d = lambda k: dt.date(2024, 1, k)
    left = spark.createDataFrame([("a", d(k)) for k in (1, 3, 5, 7)], "ticker string, date date")
    right = spark.createDataFrame([("a", d(2), 1.0), ("a", d(5), None), ("b", d(1), 9.0)], "ticker string, date date, v double")
    take = lambda skip: [r.v for r in timejoin.as_of(left, right, "v", skip, S).orderBy("date").collect()]
    assert take(True) == [None, 1.0, 1.0, 1.0] and take(False) == [None, 1.0, None, None]


def test_quantile_bins_drop_equal_edges(spark):
    df = spark.createDataFrame([("a", v) for v in [1.0] * 10 + [2.0, 3.0, 4.0, 5.0]], "ticker string, x double")
    import pandas as pd

    out = xsection.quantile_bins(df, "x", ["ticker"], 5).toPandas()
    want = pd.qcut(out.x, 5, labels=False, duplicates="drop") + 1
    assert out.bin.tolist() == want.tolist()


def test_panel_gate(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), f"{t:06}", 1.0, 1.0, 5, 100, 10 * (t % 3 - 1), 1.0, True, True) for i in range(20) for t in range(12)]
    names = ["date", "ticker", "open", "close", "volume", "trading_value", "foreign_net_value", "market_cap", "is_listed", "is_tradable"]
    df = spark.createDataFrame(rows, names)
    cuts = [("all", "2024-01-01", "2024-12-31")]
    of = lambda x, **k: gates.panel_gate(x, cuts, **{"min_days": 10, "min_names": 10, **k}).first()
    assert of(df).status == "PASS" and of(df).execution_lag == 2
    assert of(df, min_days=50).status == "NOT_READY"
    assert "repeated keys" in of(df.union(df.limit(1))).reasons
    assert "flow above turnover" in of(df.withColumn("foreign_net_value", F.col("trading_value") * 2)).reasons
    stamped = df.withColumn("data_available_at", F.when(F.col("ticker") != "000003", F.current_timestamp()))
    assert "availability partly missing" in of(stamped).reasons
    assert of(stamped.fillna("x").withColumn("data_available_at", F.current_timestamp())).execution_lag == 1
    assert of(df.limit(0)).status == "NOT_READY"
    null = lambda c: df.withColumn(c, F.when(F.col("ticker") != "000003", F.col(c)))
    for c in gates.NUMBERS:
        assert "null numbers" in of(null(c)).reasons and of(null(c)).status == "FAIL"
    assert "null keys" in of(df.withColumn("ticker", F.lit(" "))).reasons and "negative numbers" in of(df.withColumn("volume", F.lit(-1))).reasons
    assert "rows in trade without price" in of(df.withColumn("close", F.lit(0.0))).reasons
    assert of(df.withColumn("is_listed", F.col("ticker") < "000005")).least_names == 5 and of(df.withColumn("is_listed", F.lit(None).cast("boolean"))).least_names == 0
    assert "lag under one day" in of(df, lag=0).reasons and of(df, lag=3).execution_lag == 3 and "missing columns: volume" in of(df.drop("volume")).reasons
    turned = gates.panel_gate(df, [("b", "2024-02-01", "2024-12-31"), ("a", "2024-01-01", "2024-01-31")], min_days=1, min_names=1).first()
    assert "segments out of order" in turned.reasons and of(df).warnings and not of(stamped.fillna("x").withColumn("data_available_at", F.current_timestamp())).warnings


def test_checked_upsert(spark, tmp_path):
    from barwright.sources.ingest import checked_upsert

    store = PanelStore(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("1", dt.date(2024, 1, k), 2.0 - k, 1.0, k == 2) for k in (1, 2, 3)], "ticker string, date date, high double, low double, is_provisional boolean")
    put, warned = checked_upsert(store, "p", rows, batch=("s", 0))
    assert put == 3 and {tuple(r) for r in warned.collect()} == {("p", "crossed", 2, dt.date(2024, 1, 2)), ("p", "provisional", 1, dt.date(2024, 1, 2))}
    put, warned = checked_upsert(store, "p", rows, batch=("s", 0))
    assert put == 0 and warned.count() == 0 and store.read("p", confirmed_only=False).count() == 3


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(scalar.number(F.lit(" 1,234.5% "))) == 1234.5 and one(scalar.number(F.lit("abc"))) is None and one(scalar.number(F.lit("--"))) is None
    assert one(scalar.number_strict(F.lit("+3,618,959"))) == 3618959.0
    with pytest.raises(Exception, match="abc"):
        one(scalar.number_strict(F.lit("abc")))
    assert one(scalar.padded(F.lit("5930"))) == "005930" and one(scalar.padded(F.lit("1234567"))) == "1234567"
    assert one(scalar.whole(F.lit(2.5))) == 2 and one(scalar.day(F.lit("20260231"))) is None and one(scalar.dotted_day(F.lit("2026.07.31"))) == dt.date(2026, 7, 31)
    assert one(scalar.available_at(F.lit(dt.date(2026, 8, 5)), 0, 18)) == dt.datetime(2026, 8, 5, 9)
    assert one(scalar.truth(F.lit(" Y "))) is True and one(scalar.truth(F.lit("maybe"))) is None
    assert one(scalar.label_seed(F.lit("abc"))) == sum(map(ord, "abc"))
    assert one(scalar.finite(F.lit(float("inf")))) is None and one(scalar.business_day_after(F.lit(dt.date(2024, 1, 5)), 1)) == dt.date(2024, 1, 8)


def test_normalise(spark):
    d = DATASETS["credit_balance_daily"]
    raw = spark.createDataFrame([("20260102", "20260106", "1,000", 1), ("20260102", "20260106", "1,001", 2), ("bad", "", "5", 3), ("20260105", None, "", 4)], "deal_date string, stlm_date string, stck_prpr string, seq int")
    out = normalised(raw, d, F.lit("5930"), F.lit("2026-01-06 12:00:00"), "seq", "test").collect()
    assert [r.close for r in out] == [1001] and out[0].ticker == "005930" and out[0].is_provisional
    assert out[0].data_available_at == dt.datetime(2026, 1, 7) and out[0].margin_new_qty is None
    assert list(out[0].asDict()) == d.schema.fieldNames()
    assert normalised(raw.limit(0), d, F.lit("x"), F.lit("2026-01-06"), "seq", "t").schema.fieldNames() == d.schema.fieldNames()
    body = spark.createDataFrame([('{"output": [{"deal_date": "20260102", "stck_prpr": "7"}]}',), ('{"output": {"deal_date": "20260103", "stck_prpr": "8"}}',), ("broken",)], "body string")
    assert {r.deal_date for r in records(body, "body", "output", d).collect()} == {"20260102", "20260103"}
    assert len(DATASETS) == 9 and len(DATASETS["investor_flow_daily"].columns) == 41 and len(DATASETS["market_investor_flow_daily"].columns) == 38


def test_store(spark, tmp_path):
    store = PanelStore(spark, f"file://{tmp_path}")
    d = lambda k: dt.date(2024, 1, k)
    first = spark.createDataFrame([("005930", d(1), 1.0, 5, True), ("005930", d(2), 2.0, 6, False), ("7", d(1), 3.0, 7, False)], "ticker string, date date, close double, volume int, is_provisional boolean")
    assert store.read("p").count() == 0 and store.coverage("p").count() == 0 and store.delete("p") == 0 and store.tables() == []
    assert store.read("price_daily").columns == DATASETS["price_daily"].schema.fieldNames()
    with pytest.raises(ValueError, match="start"):
        store.read("p", start="2024-01-02", end="2024-01-01")
    assert store.upsert("p", first) == 3 and store.upsert("p", first) == 3
    assert {(r.ticker, r.date) for r in store.read("p").collect()} == {("005930", d(2)), ("7", d(1))}
    newer = spark.createDataFrame([("005930", d(1), 9.0, False, "x")], "ticker string, date date, close double, is_provisional boolean, note string")
    assert store.upsert("p", newer) == 1
    rows = {(r.ticker, r.date): r for r in store.read("p").collect()}
    assert len(rows) == 3 and rows["005930", d(1)].volume is None and rows["005930", d(1)].note == "x" and rows["7", d(1)].close == 3.0
    assert store.read("p", tickers=["7"]).count() == 1 and store.read("p", start="2024-01-02").count() == 1
    assert {(r.ticker, r.n) for r in store.coverage("p").collect()} == {("005930", 2), ("7", 1)}
    assert store.delete("p", []) == 0 and store.delete("p", ["7"]) == 1 and store.read("p").count() == 2 and store.tables() == ["p"]
    twice = spark.createDataFrame([("7", d(1), 1.0), ("7", d(1), 2.0)], "ticker string, date date, close double").coalesce(1)
    assert store.upsert("p", twice) == 1 and [r.close for r in store.read("p", ["7"]).collect()] == [2.0]
    assert store.delete("p") == 3 and store.tables() == []


def test_merge_wants_enough_verified_rows(spark):
    bar = lambda k: ("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), 1.0, 1.0, 1.0, 1.0, 5, False)
    kinds = "ticker string, date date, open double, high double, low double, close double, volume long, is_provisional boolean"
    old, new = (spark.createDataFrame([bar(k) for k in r], kinds) for r in (range(70), range(60, 80)))
    assert history.refreshed(old, new, verified=old).count() == 80
    with pytest.raises(ValueError, match="verified"):
        history.refreshed(old, new, verified=new)
    with pytest.raises(ValueError, match="overlapping"):
        history.refreshed(old, new, verified=spark.createDataFrame([bar(k) for k in range(65, 140)], kinds))


def _prices(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_store_keeps_its_rows_when_a_write_is_lost(spark, tmp_path, monkeypatch):
    """A failure before the manifest is renamed: nothing is lost or doubled, and the same write then goes through."""
    d = lambda k: dt.date(2020 + k % 3, 1, k + 1)
    store = PanelStore(spark, f"file://{tmp_path}")
    store.upsert("p", _prices(spark, [(str(t), d(k), 1.0) for t in range(5) for k in range(4)]))
    before = sorted(map(tuple, store.read("p").collect()))
    newer = _prices(spark, [("1", d(0), 2.0), ("9", d(1), 3.0)])

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(PanelStore, "_commit", lost)
        for write in (lambda: store.upsert("p", newer, batch=("s", 0)), lambda: store.delete("p", ["1", "2"]), lambda: store.delete("p")):
            with pytest.raises(OSError):
                write()
            assert sorted(map(tuple, store.read("p").collect())) == before
    assert store.upsert("p", newer, batch=("s", 0)) == 2
    after = sorted(map(tuple, store.read("p").collect()))
    assert len(after) == 21 and ("1", d(0), 2.0) in after
    assert store.upsert("p", newer.withColumn("close", F.lit(7.0)), batch=("s", 0)) == 0 and sorted(map(tuple, store.read("p").collect())) == after
    assert store.delete("p", ["1", "2"]) == 8 and store.read("p").count() == 13
    assert store.upsert("p", newer, batch=("s", 0)) == 0 and store.upsert("p", newer, batch=("s", 1)) == 2
    assert len(store._names("p", "manifests")) == 2  # the newest and the one before


def test_store_refuses_a_second_writer(spark, tmp_path):
    store = PanelStore(spark, f"file://{tmp_path}")
    store.upsert("p", _prices(spark, [("1", dt.date(2020, 1, 1), 1.0)]))
    seen = store._manifest("p")
    store.upsert("p", _prices(spark, [("1", dt.date(2020, 1, 1), 2.0)]))
    with pytest.raises(RuntimeError, match="another writer"):
        store._next("p", seen, store.read("p").schema, 1, {})
    assert [r.close for r in store.read("p").collect()] == [2.0]


def test_store_parts_stay_small(spark, tmp_path):
    """Buckets double with the rows; rows without a date or ticker, and a ticker with most of the rows, have parts too."""
    store = PanelStore(spark, f"file://{tmp_path}", part_rows=40)
    rows = [(str(t), dt.date(2020, 1, 1) + dt.timedelta(days=k), float(k)) for t in range(40) for k in range(5)] + [("hot", dt.date(2018, 1, 1) + dt.timedelta(days=k), 1.0) for k in range(700)] + [(None, None, 1.0), ("1", None, 2.0)]
    for some in (rows[:100], rows[100:500], rows[500:]):
        store.upsert("p", _prices(spark, some))
    m = store._manifest("p")
    assert m["buckets"] >= 4 and max(p["rows"] for p in m["parts"].values()) <= 366 + 3 * 40 and sum(p["rows"] for p in m["parts"].values()) == len(rows)
    assert sorted(map(str, store.read("p").collect())) == sorted(map(str, _prices(spark, rows).collect()))
    assert store.read("p", ["hot"], "2018-06-01", "2018-06-10").count() == 10


def test_readers(spark, tmp_path):
    head = ",".join(readers.REQUIRED) + ",asof"
    (tmp_path / "p.csv").write_text(head + "\n2024-01-02,5930,1,2,3,bad,5,6,Y,0,2024-01-02T09:00:00\n")
    r = readers.panel_csv(spark, f"file://{tmp_path}/p.csv").first()
    assert r.ticker == "005930" and r.trading_value is None and r.is_listed and not r.is_tradable and r.data_available_at is not None
    for flags in (",0", "maybe,0", "Y,"):
        (tmp_path / "f.csv").write_text(head + f"\n2024-01-02,5930,1,2,3,4,5,6,{flags},2024-01-02T09:00:00\n")
        with pytest.raises(ValueError, match="unknown values"):
            readers.panel_csv(spark, f"file://{tmp_path}/f.csv")
    (tmp_path / "q.csv").write_text("date\n2024-01-02\n")
    with pytest.raises(ValueError, match="ticker"):
        readers.panel_csv(spark, f"file://{tmp_path}/q.csv")
    live = spark.createDataFrame([("a", 1, 1.0, 2.0, 1.0, 2.0), ("a", 2, 1.0, 2.0, 1.0, 2.0), ("a", 3, 1.0, 2.0, 1.0, 2.0)], "ticker string, date int, open double, high double, low double, close double")
    told = live.withColumn("status", F.when(F.col("date") == 2, "OPEN").otherwise("CLOSE")).withColumn("close", F.col("close") + F.when(F.col("date") == 3, 0.5).otherwise(0.0))
    assert [r.date for r in readers.closed_candles(live, told).collect()] == [1]


def test_histories(spark, tmp_path):
    d = lambda k: dt.date(2024, 1, k)
    kinds = ", ".join(f"{c} {k}" for c, k in history.COLUMNS.items())
    rows = spark.createDataFrame([("a", d(2), 1.0, 3.0, 1.0, 2.0, 5), ("a", d(1), 1.004, 3.0, 1.0, 2.0, 5), ("a", d(2), 2.0, 3.0, 1.0, 2.5, 6)], kinds).coalesce(1)
    path = f"file://{tmp_path}/h"
    history.write_history(rows, path)
    text = next((tmp_path / "h").glob("part-*.csv")).read_bytes()
    assert text == "\ufeffticker,date,open,high,low,close,volume\na,2024-01-01,1.00,3.00,1.00,2.00,5\na,2024-01-02,2.00,3.00,1.00,2.50,6\n".encode()
    assert [(r.date, r.close) for r in history.read_history(spark, path).orderBy("date").collect()] == [(d(1), 2.0), (d(2), 2.5)]
    none = history.read_history(spark, f"file://{tmp_path}/none")
    assert none.columns == list(history.COLUMNS) and none.count() == 0
    (tmp_path / "odd.csv").write_text("Symbol,Day,Open,High,Low,Adj Close,Vol\nb,2024-01-01,1,2,1,2,3\n")
    assert history.read_history(spark, f"file://{tmp_path}/odd.csv").first().close == 2.0
    (tmp_path / "bad.csv").write_text("Symbol,Day,Open,High,Low,Adj Close,Vol\nb,2024-01-01,1,1,1,2,3\n")
    with pytest.raises(ValueError, match="invalid"):
        history.read_history(spark, f"file://{tmp_path}/bad.csv")
    many = spark.range(70).select(F.lit("a").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    assert history.mergeable(many, many) == (70, 70)
    for old, new, what in ((many, many.limit(59), "verified"), (many.limit(59), many, "overlapping")):
        with pytest.raises(ValueError, match=what):
            history.mergeable(old, new)


def test_parameters(spark, sf_dir):
    from barwright.functions import params
    from barwright.operators import accounting
    from barwright.sources.derive import bars

    for bad in (0, 0.5, -1, 0.7):
        with pytest.raises(ValueError, match="quantile"):
            params.share(bad)
    assert params.share(0.1) == 0.1 and params.period("2024-01-01", "2024-01-01")
    with pytest.raises(ValueError, match="horizon"):
        accounting.future_return(0)
    with pytest.raises(ValueError, match="cost"):
        accounting.spreads(bars(spark, sf_dir), 1, -1)
    with pytest.raises(ValueError, match="low"):
        history.buffered(bars(spark, sf_dir).drop("low"), "1996-01-01")


def test_r_squared(spark):
    rng = np.random.default_rng(3)
    rows = [("g", *map(float, r)) for r in rng.normal(size=(40, 3))] + [("flat", 1.0, 2.0, float(v)) for v in rng.normal(size=5)]
    found = {r.g: r.r2 for r in stats.r_squared(spark.createDataFrame(rows, "g string, y double, a double, b double"), "y", ["a", "b"], ["g"]).collect()}
    x = np.array([r[1:] for r in rows[:40]])
    design = np.column_stack((np.ones(40), x[:, 1:]))
    rest = x[:, 0] - design @ np.linalg.lstsq(design, x[:, 0], rcond=None)[0]
    assert found["flat"] is None and np.isclose(found["g"], 1 - rest.var() / x[:, 0].var())


def test_streams(spark, tmp_path, sf_dir):
    from barwright.sources.derive import bars
    from barwright.streaming import incremental

    b = bars(spark, sf_dir).select("ticker", "date", "high", "low", "close").cache()
    want = {(r.ticker, r.date): r.position for r in state.channel_signals(b, 20, 10, S).collect()}
    cut = dt.date(1998, 1, 1)
    for k, part in enumerate([b.where(F.col("date") < F.lit(cut)), b.where(F.col("date") >= F.lit(cut))]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in")
    q = incremental.streamed_positions(stream).writeStream.format("memory").queryName("positions").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert {(r.ticker, r.date): r.position for r in spark.table("positions").collect()} == want

    store = PanelStore(spark, f"file://{tmp_path}/store")
    q = spark.readStream.schema(b.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").writeStream.foreachBatch(incremental.upserting(store, "bars")).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert store.read("bars").count() == b.count()

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/ev")
    ticks = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    q = incremental.tumbling_bars(ticks, "event_type", "ts", "value", "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert spark.table("hours").agg(F.sum("volume")).first()[0] == events.count()


@pytest.mark.parametrize("name, draws", [("walkforward_selection", 600), ("walkforward_weights", 600), ("bootstrap_hash_whole", 2000), ("bootstrap_tail", 2000), ("hypothesis_detail", 500), ("hypothesis_decision", 500)])
def test_registered_draws(spark, sf_dir, monkeypatch, name, draws):
    """The queries run with the survey's draws."""
    seen, own = [], resample.hashed_starts
    monkeypatch.setattr(resample, "hashed_starts", lambda lengths, keys, n, block, seed: seen.append(n) or own(lengths, keys, n, block, seed))
    QUERIES[name](spark, sf_dir)
    assert seen == [draws]


def test_all_tickers_are_resampled(spark, sf_dir):
    """Each ticker has a result, the one that it has alone."""
    for name in ("bootstrap_pcg", "block_permute", "sign_flip_placebo"):
        assert "ticker" in QUERIES[name](spark, sf_dir).columns
    data = [(k, i, i % 10 < 5, float(i * j % 7)) for j, k in enumerate("abc", 1) for i in range(20 + j)]
    df = spark.createDataFrame(data, "ticker string, date int, f boolean, r double")
    every = resample.positioned(df, "date", "ticker")
    starts = resample.seeded_starts_of(every.select("ticker", "n").distinct(), "ticker", 40, 5, 9).toPandas()
    moved = resample.permuted_each(every, "ticker", "f", 5, 1, "p").toPandas()
    bounds = {r.ticker: r.placebo_95 for r in resample.sign_flip_bounds(every, "ticker", "r", 10, 50, 5, 2).collect()}
    for k, n in (("a", 21), ("b", 22), ("c", 23)):
        one = resample.positioned(df.where(F.col("ticker") == k), "date")
        own = starts[starts.ticker == k].sort_values(["draw", "blk"])[["draw", "blk", "start"]].to_numpy()
        assert (own == resample.seeded_starts(spark, n, 40, 5, 9).orderBy("draw", "blk").toPandas().to_numpy()).all()
        assert moved[moved.ticker == k].sort_values("pos").p.tolist() == resample.permuted(one, "f", 5, 1, "p").orderBy("pos").toPandas().p.tolist()
        assert np.isclose(bounds[k], resample.sign_flip_bound(one, "r", 10, 50, 5, 2).first()[0])


def test_draws_are_not_broadcast(spark):
    """A few series become many draws: their table is merged with the rows, however small the planner takes it to be."""
    df = spark.createDataFrame([(k, i, i % 10 < 5, float(i * j % 7)) for j, k in enumerate("abc", 1) for i in range(40)], "ticker string, date int, f boolean, r double")
    series = resample.positioned(df, "date", "ticker")
    lengths, keys = series.select("ticker", "n").distinct(), ["ticker"]
    excess = {"e": resample.excess(F.col("r"), F.col("f"))}
    for starts in (resample.seeded_starts_of(lengths, "ticker", 30, 5, 9), resample.hashed_starts(lengths, keys, 30, 5, 9)):
        made = [resample.drawn(starts, series, 5, keys), resample.draw_values(starts, series, 5, excess, keys), resample.draw_lists(starts, series, 5, {"r": F.col("r")}, keys)]
        made += [resample.shuffled_blocks(series, "r", 5, 4, 1, keys, "p"), resample.permuted_each(series, "ticker", "f", 5, 1, "p"), resample.sign_flip_bounds(series, "ticker", "r", 10, 50, 5, 2)]
        for each in made:
            assert each.collect()
            assert "BroadcastExchange" not in each._jdf.queryExecution().executedPlan().toString()
    values, rows = made[1].toPandas().set_index(["ticker", "draw"]).e, resample.conditional_excess(made[0], "r", F.col("f"), keys).toPandas().set_index(["ticker", "draw"]).excess
    assert len(values) == 90 and np.allclose(values.sort_index(), rows.sort_index(), equal_nan=True)


def test_business_days_of_all_orders(spark, sf_dir):
    got = {r.o_orderkey: r.third for r in QUERIES["business_days_whole"](spark, sf_dir).collect()}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).collect()
    assert got == {r.o_orderkey: str(np.busday_offset(r.d, 3, roll="backward")) for r in orders}


def test_small_parts_stay_few(spark, tmp_path, monkeypatch):
    """Parts double while they are few; beyond that they grow, so that files and the manifest don't follow the rows. What is read is the same."""
    from barwright.sources import store as module

    monkeypatch.setattr(module, "FEW_PARTS", 8)
    store = PanelStore(spark, f"file://{tmp_path}", part_rows=5)
    rows = spark.range(400).select(F.col("id").cast("string").alias("ticker"), F.expr("date_add(DATE '2020-01-01', CAST(id % 700 AS INT))").alias("date"), F.col("id").alias("x"))
    store.upsert("p", rows.where("id < 10 OR id >= 390"))
    few = len(store._manifest("p")["parts"])
    store.upsert("p", rows)
    assert few < len(store._manifest("p")["parts"]) <= 8
    assert sorted(r.x for r in store.read("p").collect()) == list(range(400))
    monkeypatch.setattr(module, "PART_ROWS", 20)  # parts of full size double again
    store.upsert("p", rows)
    assert 8 < len(store._manifest("p")["parts"]) <= 64
