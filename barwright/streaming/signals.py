"""The breakout position and the rally counter of a stream of bars, with typed state.

A ticker's state is what the row loops carry from one bar to the next: the position, the running low and the day of a
correction, the newest highs, lows and closes that the channel and the peak look back on, and the date of its last bar. The
results are those of the windows in state.py over all rows. Rows of one trigger are put in order by date; a row not after its
ticker's last bar comes too late and is left out, since what follows it has been given already.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import PanelStore

OUT = "ticker string, date date, close double, position int, in_correction boolean, rally_day long, rally_low double"
STATE = "position int, inside boolean, low double, day long, last date, highs array<double>, lows array<double>, closes array<double>"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class Rules:
    """Channel lengths, the peak's rows and the least of them, and the drop from it that makes a correction."""

    n_entry: int = 20
    n_exit: int = 10
    peak_rows: int = 250
    least: int = 60
    drop: float = 0.10


def _known(values) -> list[float]:
    return [v for v in values if v is not None and v == v]


class SignalProcessor(StatefulProcessor):
    """One ticker's bars, trigger by trigger."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("signal", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        r = self.rules
        on, inside, low, day, last, *held = self.state.get() if self.state.exists() else (0, False, None, 0, None, [], [], [])
        highs, lows, closes = (deque(v, n) for v, n in zip(held, (r.n_entry, r.n_exit, r.peak_rows), strict=True))
        out = []
        for bar in pd.concat(list(rows)).sort_values("date", kind="stable").itertuples():
            if last is not None and bar.date <= last:
                continue
            last = bar.date
            live = len(_known(highs)) == r.n_entry
            enter = live and bar.close > max(highs)
            leave = live and len(_known(lows)) == r.n_exit and bar.close < min(lows)
            on = on ^ 1 if enter and leave else 1 if enter else 0 if leave else on
            closes.append(bar.close)
            peak = _known(closes)
            correct = len(peak) >= r.least and bar.close < max(peak) * (1 - r.drop)
            own = None if pd.isna(bar.low) else float(bar.low)
            if correct:
                fresh = not inside or own is not None and (low is None or own <= low)
                low, day = (own, 1) if fresh else (low, day + 1)
            inside = bool(correct)
            out.append((key[0], bar.date, bar.close, int(on) if live else 0, inside, day if inside else 0, low if inside else None))
            highs.append(bar.high)
            lows.append(bar.low)
        if out:
            plain = [[float(v) for v in d] for d in (highs, lows, closes)]
            self.state.update((int(on), inside, low if inside else None, int(day) if inside else 0, last, *plain))
        yield pd.DataFrame(out, columns=["ticker", "date", "close", "position", "in_correction", "rally_day", "rally_low"]).astype({"rally_low": "float64"})

    def close(self) -> None:
        pass


def streamed_signals(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The signals of a stream of bars: ticker, date, high, low, close. The session must keep state in RocksDB (see rocks)."""
    own = bars.select("ticker", "date", "high", "low", "close").groupBy("ticker")
    return own.transformWithStateInPandas(SignalProcessor(rules), OUT, "Append", "None")


@contextmanager
def rocks(spark: SparkSession):
    """The session with the state store that typed state needs."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_into(store: PanelStore, dataset: str, signals: DataFrame, checkpoint: str) -> None:
    """Runs a stream of signals over what is there, each batch put into the store once, and ends. Started again from its checkpoint, it goes on."""

    def put(rows: DataFrame, batch: int) -> None:
        store.upsert(dataset, rows, ["close"], (dataset, batch))

    with rocks(signals.sparkSession):
        signals.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
