"""Typed state: late rows, nulls and restarts against the windows over all rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barwright.functions.rolling import Series
from barwright.operators import state
from barwright.sources.store import PanelStore
from barwright.streaming import signals

S = Series()


def test_signals_go_on_after_a_restart_and_late_rows_are_left_out(spark, tmp_path):
    r, rows = random.Random(5), []
    for ticker, n in (("a", 160), ("b", 90)):
        price = 100.0
        for k in range(n):
            price = max(10, price + r.choice([-6, -3, -1, 1, 2, 5]))
            low = None if r.random() < 0.05 else price - r.randrange(3)
            rows.append((ticker, dt.date(2020, 1, 1) + dt.timedelta(days=k), price + r.randrange(3), low, price))
    bars = spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double").cache()
    rules = signals.Rules(n_entry=8, n_exit=5, peak_rows=30, least=10)
    store = PanelStore(spark, f"file://{tmp_path}/store")
    cuts = [dt.date(2020, 2, 20), dt.date(2020, 4, 1)]
    late = spark.createDataFrame([("a", dt.date(2020, 1, 5), 1e6, 1e6, 1e6)], bars.schema)  # before what has been given
    parts = [bars.where(F.col("date") < cuts[0]), bars.where((F.col("date") >= cuts[0]) & (F.col("date") < cuts[1])).unionByName(late), bars.where(F.col("date") >= cuts[1])]
    for k, part in enumerate(parts):
        part.coalesce(2).write.parquet(f"{tmp_path}/in/part={k}")
        for _ in range(2):  # a start without new rows changes nothing
            landed = spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/in/part=*")
            signals.run_into(store, "signals", signals.streamed_signals(landed, rules), f"{tmp_path}/checkpoint")
    got = {(x.ticker, x.date): (x.position, x.in_correction, x.rally_day, x.rally_low) for x in store.read("signals").collect()}
    want = state.channel_signals(bars, 8, 5, S).withColumn("peak", S.over(F.max, "close", -29, 0, 10))
    want = state.rally(want, F.col("close") < F.col("peak") * (1 - F.lit(0.10)), series=S)
    assert got == {(x.ticker, x.date): (x.position, x.in_correction, x.rally_day, x.rally_low) for x in want.collect()}
    assert any(v[0] for v in got.values()) and any(v[2] > 2 for v in got.values())
