"""Row loops over series that are longer than a task: scans over chunks of time.

A series is cut into chunks of a set number of rows (cut). What a loop does to its state over a chunk is one element of an
associative algebra: a map on {0, 1} for the position, lowest low and days for the rally counter, a product and its peak for
equity. Each chunk is reduced to its element, the elements of a series (a row a chunk) are scanned to the state before each
chunk, and that state is applied to the chunk's rows. No window is over more than a chunk, or over more rows than there
are chunks. Rolling windows take the rows they need from the chunks before (with_halo).

The results are those of the plain windows of state.py and rolling.py; equity differs by the rounding of its products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import at_least
from ..functions.rolling import Series
from .state import channel_signals, position, rally

CHUNK, HALO = "_chunk", "_halo"


def within(series: Series) -> Series:
    """The same order within the chunks of a series."""
    return Series([series.key, CHUNK], series.order)


def _clock(df: DataFrame, series: Series) -> Column:
    """The order as a number: days of dates, microseconds of timestamps, numbers as they are."""
    kind = dict(df.dtypes)[series.order]
    return F.unix_date(series.order).cast("long") if kind == "date" else F.unix_micros(series.order) if kind == "timestamp" else F.col(series.order).cast("long")


def chunk_table(df: DataFrame, rows: int, series: Series = Series(), parts: int = 10) -> tuple[DataFrame, Column]:
    """The chunk of each span of time of each series (a row for each rows / parts rows), and a row's span.

    Spans are of one width for all series, so that the longest has `parts` of them for each `rows` rows on average; spans are
    gathered to chunks in order. A chunk has fewer rows than `rows` and those of its fullest span together.
    """
    at_least(rows, 1, "rows")
    at = _clock(df, series)
    facts = df.groupBy(series.key).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(F.lit(1)).alias("n"))
    f = facts.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("n")).head()  # one row
    low, width = f.low or 0, max(1, ((f.high or 0) - (f.low or 0)) // max(1, (f.n or 0) * parts // rows))
    span = F.floor((at - low) / width)
    counts = df.groupBy(series.key, span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(series.key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn(CHUNK, F.floor(before / rows)), span


def cut(df: DataFrame, rows: int, series: Series = Series()) -> DataFrame:
    """The rows with their chunk; chunks are numbered in order, with gaps. Rows without an order, or without a key, have none."""
    spans, span = chunk_table(df, rows, series)
    return df.withColumn("_span", span).join(spans.drop("_n"), [series.key, "_span"], "left").drop("_span")


def with_halo(chunked: DataFrame, before: int, series: Series = Series()) -> DataFrame:
    """The rows, and copies of the last `before` rows ahead of each chunk in it (marked by HALO): rolling windows within chunks then see what they need."""
    at_least(before, 1, "before")
    sizes = chunked.groupBy(series.key, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    # A chunk's rows are wanted by the chunks that follow, as far as the rows between are fewer than `before`.
    after = Window.partitionBy(series.key).orderBy(CHUNK).rowsBetween(1, before)
    step = lambda a, x: F.struct((a["between"] + x["_n"]).alias("between"), F.concat(a["to"], F.array(F.struct(x[CHUNK].alias("chunk"), a["between"].alias("between")))).alias("to"))
    start = F.struct(F.lit(0).cast("long").alias("between"), F.array().cast("array<struct<chunk: bigint, between: bigint>>").alias("to"))
    wants = F.filter(F.aggregate(F.collect_list(F.struct(CHUNK, "_n")).over(after), start, step, lambda a: a["to"]), lambda x: x["between"] < before)
    sizes = sizes.withColumn("_wants", wants).drop("_n")
    back = F.row_number().over(Window.partitionBy(series.key, CHUNK).orderBy(F.desc(series.order)))
    last = chunked.withColumn("_back", back).where(F.col("_back") <= before).join(sizes, [series.key, CHUNK])
    copies = last.withColumn("_to", F.explode("_wants")).where(F.col("_back") + F.col("_to.between") <= before)
    copies = copies.withColumn(CHUNK, F.col("_to.chunk")).drop("_back", "_wants", "_to")
    return chunked.withColumn(HALO, F.lit(False)).unionByName(copies.withColumn(HALO, F.lit(True)))


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(f"NOT {HALO}").drop(HALO)


def _entering(elements: DataFrame, series: Series) -> Window:
    """The chunks of a series before a chunk."""
    return Window.partitionBy(series.key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def scanned_position(chunked: DataFrame, entry: Column, exit_: Column, live: Column, series: Series = Series(), name: str = "position") -> DataFrame:
    """state.position over chunks. An element is a map on {0, 1}: a constant (the chunk sets the state) or a number of turns."""
    own = within(series)
    on, off = F.coalesce(live & entry, F.lit(False)), F.coalesce(live & exit_, F.lit(False))
    df = chunked.withColumn("_live", F.coalesce(live, F.lit(False))).withColumn("_set", F.when(on & ~off, 1).when(off & ~on, 0)).withColumn("_turns", F.sum((on & off).cast("int")).over(own.so_far))
    last = lambda c: F.last(c, ignorenulls=True).over(own.so_far)
    # Of each row, the map from the chunk's start: the constant it gives, or null and the turns.
    set_at = last(F.when(F.col("_set").isNotNull(), F.col("_turns")))
    df = df.withColumn("_to", F.pmod(last("_set") + F.col("_turns") - set_at, F.lit(2))).drop("_set")
    whole = F.max_by(F.struct(F.col("_to").alias("to"), F.col("_turns").alias("turns")), series.order)
    elements = df.groupBy(series.key, CHUNK).agg(whole.alias("_e"))
    before = _entering(elements, series)
    turns = F.coalesce(F.sum("_e.turns").over(before), F.lit(0))
    known = F.last(F.when(F.col("_e.to").isNotNull(), F.col("_e.to")), ignorenulls=True).over(before)
    # Turns of the chunks after that which last set the state: all up to it are taken off.
    so_far = F.sum("_e.turns").over(before.rowsBetween(Window.unboundedPreceding, 0))
    elements = elements.withColumn("_all", turns).withColumn("_upto", so_far)
    known_at = F.coalesce(F.last(F.when(F.col("_e.to").isNotNull(), F.col("_upto")), ignorenulls=True).over(before), F.lit(0))
    elements = elements.select(series.key, CHUNK, F.pmod(F.coalesce(known, F.lit(0)) + F.col("_all") - known_at, F.lit(2)).alias("_in"))
    out = df.join(elements, [series.key, CHUNK])
    state = F.coalesce("_to", F.pmod(F.col("_in") + F.col("_turns"), F.lit(2)))
    return out.withColumn(name, F.when(F.col("_live"), state).otherwise(0).cast("int")).drop("_live", "_turns", "_to", "_in")


def scanned_channel(bars: DataFrame, n_entry: int, n_exit: int, rows: int, series: Series = Series()) -> DataFrame:
    """state.channel_signals over chunks: the channel from rows before, the position by the scan."""
    halo = with_halo(cut(bars, rows, series), max(n_entry, n_exit), series)
    out = without_halo(channel_signals(halo, n_entry, n_exit, within(series)).drop("position"))
    return scanned_position(out, F.col("long_entry"), F.col("long_exit"), F.col("dc_high").isNotNull(), series).drop(CHUNK)


def scanned_rally(chunked: DataFrame, correction: Column, low: str = "low", series: Series = Series()) -> DataFrame:
    """state.rally over chunks. An element is the lowest low and the days since of the correction that a chunk ends in, and whether it began in the chunk."""
    own = within(series)
    df = chunked.withColumn("_ok", F.coalesce(correction, F.lit(False)))
    # Whether a correction has run since before the chunk; then what the rows ahead of the chunk say still counts.
    df = df.withColumn("_open", F.sum((~F.col("_ok")).cast("int")).over(own.so_far) == 0)
    df = rally(df, F.col("_ok"), low, own).drop("_ok").withColumn("_nth", F.row_number().over(own.rows))
    last = F.max_by(F.struct(F.col("rally_low").alias("low"), F.col("rally_day").alias("day"), "in_correction", F.col("_open").alias("open"), F.col("_nth").alias("n")), series.order)
    elements = df.groupBy(series.key, CHUNK).agg(last.alias("_e"))
    # Chunks of one correction: a chunk in which one begins, or that ends outside, starts an island.
    w = Window.partitionBy(series.key).orderBy(CHUNK)
    elements = elements.withColumn("_island", F.sum((~F.col("_e.open")).cast("int")).over(w)).select("*", "_e.*").drop("_e")
    i = Window.partitionBy(series.key, "_island").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    elements = elements.withColumn("_lowest", F.min("low").over(i)).withColumn("_rows", F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).over(i))
    # The day of the last chunk that reached the lowest low, and the rows of the chunks since; without any low, days since the start.
    reached = F.col("low").isNotNull() & (F.col("low") == F.col("_lowest"))
    held = F.last(F.when(reached, F.struct("day", "_rows")), ignorenulls=True).over(i)
    first = F.first(F.struct("day", "_rows")).over(i)
    at = F.coalesce(held, first)
    elements = elements.withColumn("_day", at["day"] + F.col("_rows") - at["_rows"])
    prev = lambda c: F.lag(c).over(w)
    inside = F.coalesce(prev("in_correction"), F.lit(False))
    elements = elements.select(series.key, CHUNK, inside.alias("_was"), prev("_lowest").alias("_low0"), prev("_day").alias("_day0"))
    out = df.join(elements, [series.key, CHUNK])
    goes_on = F.col("_open") & F.col("_was")
    stands = goes_on & (F.col("rally_low").isNull() | (F.col("rally_low") > F.col("_low0")))
    day = F.when(F.coalesce(stands, F.lit(False)), F.col("_day0") + F.col("_nth")).otherwise(F.col("rally_day"))
    lowest = F.when(goes_on, F.least("rally_low", "_low0")).otherwise(F.col("rally_low"))
    return out.withColumn("rally_day", day).withColumn("rally_low", lowest).drop("_open", "_nth", "_was", "_low0", "_day0")


def scanned_equity(chunked: DataFrame, r: str, series: Series = Series(), start_at_one: bool = False) -> DataFrame:
    """The running product of 1 + r and its drawdown over chunks: equity, drawdown. An element is the product with its greatest and least value."""
    own = within(series)
    df = chunked.withColumn("_local", F.product(1 + F.col(r)).over(own.so_far)).withColumn("_max", F.max("_local").over(own.so_far)).withColumn("_min", F.min("_local").over(own.so_far))
    elements = df.groupBy(series.key, CHUNK).agg(F.max_by(F.struct("_local", "_max", "_min"), series.order).alias("_e"))
    before = _entering(elements, series)
    elements = elements.withColumn("_equity", F.product("_e._local").over(before))
    at_start = F.coalesce("_equity", F.lit(1.0))
    elements = elements.withColumn("_top", _peak(at_start, F.col("_e._max"), F.col("_e._min"))).withColumn("_peak", F.max("_top").over(before))
    out = df.join(elements.select(series.key, CHUNK, "_equity", "_peak"), [series.key, CHUNK])
    peak = F.greatest("_peak", _peak(at_start, F.col("_max"), F.col("_min")))
    peak = F.greatest(F.lit(1.0), peak) if start_at_one else peak
    out = out.withColumn("equity", F.when(F.col("_local").isNull(), F.col("_equity")).otherwise(at_start * F.col("_local")))
    return out.withColumn("drawdown", F.col("equity") / peak - 1).drop("_local", "_max", "_min", "_equity", "_peak")


def _peak(equity: Column, most: Column, least: Column) -> Column:
    """The greatest of equity times a chunk's values, whatever equity's sign."""
    return F.when(equity >= 0, equity * most).otherwise(equity * least)
