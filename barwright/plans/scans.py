"""State machines over series cut into chunks: the results, and the SQL twins, of the plain windows in signals.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Series
from ..operators import scan
from ..session import new_folder
from ..sources.derive import bars
from ..sources.store import PanelStore
from ..streaming import signals as stream
from .registry import query, r6
from .signals import _CHANNEL, _EQUITY, _RALLY, ENTRY, EXIT

S = Series()
#: Rows of a chunk; so few that the small tables' series have dozens of chunks. A cluster's are in the millions.
ROWS = 50


@query(_CHANNEL + " SELECT ticker, date, close, dc_high, dc_low, long_entry, long_exit, position FROM sig", "date")
def breakout_position_scan(spark, sf_dir):
    out = scan.scanned_channel(bars(spark, sf_dir), ENTRY, EXIT, ROWS, S)
    return out.select("ticker", "date", "close", "dc_high", "dc_low", "long_entry", "long_exit", "position")


@query(_RALLY + " SELECT ticker, date, cor AS in_correction, rally_day, rally_low FROM d", "date")
def rally_counter_scan(spark, sf_dir):
    """The peak of 250 rows comes from the chunks before, the correction's days from the scan."""
    own = scan.within(S)
    b = scan.with_halo(scan.cut(bars(spark, sf_dir), ROWS, S), 249, S)
    b = scan.without_halo(b.withColumn("peak", own.over(F.max, "close", -249, 0, 60)))
    out = scan.scanned_rally(b, F.col("close") < F.col("peak") * (1 - F.lit(0.10)), series=S)
    return out.select("ticker", "date", "in_correction", "rally_day", "rally_low")


@query(_EQUITY + " SELECT ticker, date, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM dd", "date")
def equity_drawdown_scan(spark, sf_dir):
    out = scan.scanned_equity(scan.cut(bars(spark, sf_dir), ROWS, S), "ret", S)
    return out.select("ticker", "date", r6("equity").alias("equity"), r6("drawdown").alias("drawdown"))


@query(f"""SELECT ticker, date, close, position, in_correction, rally_day, rally_low
 FROM ({_CHANNEL} SELECT ticker, date, close, position FROM sig) JOIN ({_RALLY} SELECT ticker, date, cor AS in_correction, rally_day, rally_low FROM d) USING (ticker, date)""", "date")
def streamed_signals(spark, sf_dir):
    """Positions and rallies of bars that land in three parts, by a stream that is started again from its checkpoint for each."""
    folder, b = new_folder(spark, "stream"), bars(spark, sf_dir).select("ticker", "date", "high", "low", "close")
    store = PanelStore(spark, f"{folder}/store")
    for k, (first, last) in enumerate((("1900-01-01", "1994-12-31"), ("1995-01-01", "1996-12-31"), ("1997-01-01", "2999-12-31"))):
        b.where(F.col("date").between(first, last)).write.parquet(f"{folder}/in/part={k}")
        landed = spark.readStream.schema(b.schema).parquet(f"{folder}/in/part=*")
        stream.run_into(store, "signals", stream.streamed_signals(landed), f"{folder}/checkpoint")
    return store.read("signals").select("ticker", "date", "close", "position", "in_correction", "rally_day", "rally_low")
