"""Incremental runs with Structured Streaming: tumbling bars, an upserting sink, positions with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import PanelStore

STATE = "state int, highs array<double>, lows array<double>"
OUT = "ticker string, date date, close double, position int"


def tumbling_bars(ticks: DataFrame, key: str, time: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bars of a stream of values by event time; rows later than the watermark are dropped."""
    w = F.window(time, width)
    out = ticks.withWatermark(time, late).groupBy(w.alias("w"), F.col(key).alias("ticker")).agg(
        F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count(F.lit(1)).alias("volume"),
    )
    return out.select("ticker", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")


def upserting(store: PanelStore, dataset: str, stream: str = "stream", order: list[str] | None = None):
    """A foreachBatch sink that writes each batch once: the store keeps the number of the last batch of a stream with its rows. Later rows replace provisional ones."""
    return lambda rows, batch: store.upsert(dataset, rows, order, (stream, batch)) and None


def streamed_positions(bars: DataFrame, n_entry: int = 20, n_exit: int = 10) -> DataFrame:
    """The breakout position of a stream of bars (ticker, date, high, low, close) in date order within a ticker's batches.

    The state of a ticker is its position and the last n highs and lows: the same results as the windows over all rows.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, highs, lows = state.get if state.exists else (0, [], [])
        highs, lows, out = list(highs), list(lows), []
        for r in pd.concat(list(parts)).sort_values("date").itertuples():
            live = len(highs) == n_entry and not any(pd.isna(highs))
            entry = live and r.close > max(highs)
            leave = live and len(lows) == n_exit and not any(pd.isna(lows)) and r.close < min(lows)
            on = on ^ 1 if entry and leave else 1 if entry else 0 if leave else on
            out.append((key[0], r.date, r.close, on if live else 0))
            highs, lows = [*highs, r.high][-n_entry:], [*lows, r.low][-n_exit:]
        state.update((on, highs, lows))
        yield pd.DataFrame(out, columns=["ticker", "date", "close", "position"])

    return bars.select("ticker", "date", "high", "low", "close").groupBy("ticker").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
