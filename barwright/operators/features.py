"""The feature table of a flow study: flows by volume, holdings, rates, channel, returns ahead and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import has_columns
from ..functions.rolling import Series
from ..functions.scalar import label_seed
from .accounting import future_return
from .resample import positioned, shuffled_blocks
from .state import channel_signals
from .timejoin import as_of

HORIZONS = (1, 3, 5, 10, 20)
FEATURES = (
    "foreign_flow_1d", "foreign_flow_5d", "foreign_flow_20d", "foreign_positive_days_5d", "foreign_holding_change_5d", "institution_flow_5d", "price_return_1d", "volume_ratio_20d", "fx_return_1d", "fx_return_5d",
)


def feature_table(prices: DataFrame, flows: DataFrame, fx: DataFrame, series: Series = Series()) -> DataFrame:
    """Prices (open, high, low, close, volume) joined with flows (foreign, institution, holding_pct, reported_close, reported_volume) and the rate (fx) last known.

    Days of both tables alone count. A volume of 0 gives null shares. Signals are false where they can't be told.
    """
    has_columns(prices.columns, [series.key, series.order, "open", "high", "low", "close", "volume"])
    has_columns(flows.columns, [series.key, series.order, "foreign", "institution", "holding_pct", "reported_close", "reported_volume"])
    d = as_of(prices.join(flows, [series.key, series.order]), fx, "fx", series=series).withColumn("_v", F.nullif("volume", F.lit(0)))
    share = lambda c, n: F.try_divide(series.over(F.sum, c, -(n - 1), 0), series.over(F.sum, "_v", -(n - 1), 0))
    before = F.lag("_mean").over(series.rows)
    d = d.withColumn("_mean", series.over(F.avg, F.col("volume").cast("double"), -19, 0))
    d = d.withColumns(
        {
            "foreign_flow_1d": F.try_divide(F.col("foreign"), F.col("_v")), "foreign_flow_5d": share("foreign", 5), "foreign_flow_20d": share("foreign", 20), "institution_flow_5d": share("institution", 5),
            "foreign_positive_days_5d": series.over(F.sum, (F.col("foreign") > 0).cast("int"), -4, 0), "foreign_holding_change_5d": F.col("holding_pct") - F.lag("holding_pct", 5).over(series.rows),
            "price_return_1d": series.change("close"), "volume_ratio_20d": F.try_divide(F.col("volume"), before), "fx_return_1d": series.change("fx"), "fx_return_5d": series.change("fx", 5),
            **{f"future_return_{h}d": future_return(h, series) for h in HORIZONS},
        }
    )
    d = channel_signals(d, 20, 20, series)
    signal = F.coalesce((F.col("foreign_flow_5d") > 0) & (F.col("foreign_positive_days_5d") >= 3), F.lit(False))
    d = d.withColumn("foreign_signal", signal)
    return d.withColumns(
        {
            "foreign_fx_signal": F.col("foreign_signal") & F.coalesce(F.col("fx_return_5d") < 0, F.lit(False)), "combined_signal": F.col("foreign_signal") & (F.col("position") == 1),
            "close_mismatch_pct": F.try_divide(F.col("reported_close"), F.col("close")) - 1, "volume_mismatch_pct": F.try_divide(F.col("reported_volume"), F.col("_v")) - 1,
        }
    ).drop("_v", "_mean")


def with_placebo(df: DataFrame, flag: str, name: str, block: int = 5, series: Series = Series()) -> DataFrame:
    """A signal's placebo: its blocks in another order, so that counts and runs stay and times don't. Each series has the order of its label's seed."""
    rows = positioned(df, series.order, series.key)
    return shuffled_blocks(rows, flag, block, 1, label_seed(F.col(series.key)), [series.key], name).drop("pos", "n", "trial")
