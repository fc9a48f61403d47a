"""Block resampling as joins: draws of circular blocks, placebo permutations and sign flips.

Which blocks a draw takes comes from a table of starts: from a seeded generator (the same draws as a plain loop with that
generator; for one series on the driver, for each series of a table on the executors), or from a hash of (seed, keys, draw,
block), made by Spark, so that each series has draws of its own.

What a draw computes isn't made from its rows. A Statistic is a value of sums; the sums of the block that begins at each row
are made once, and a draw adds up those of its blocks (draw_values): n / block rows a draw, joined with a table of n rows
and summed before they are shuffled. For quantiles the values themselves are needed: draw_lists joins the starts with the list of
each block's rows, n / block rows a draw again, and gathers a draw's values in one array. drawn() writes out the rows.

Tables of draws are many times what they are made of, which the planner's estimates of size don't show: their joins are merges,
or a table of draws would be taken for a small one and sent through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.params import at_least
from ..functions.scalar import unit_interval


def positioned(df: DataFrame, order: str, key: str | None = None) -> DataFrame:
    """Row positions from 0 in order, and the series' length n."""
    w = Window.partitionBy(key) if key else Window.partitionBy()
    return df.withColumn("pos", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


def seeded_starts(spark: SparkSession, n: int, draws: int, block: int, seed: int) -> DataFrame:
    """draw, blk, start: as numpy's default generator draws them one draw after another."""
    blocks = math.ceil(n / block)
    starts = np.random.default_rng(seed).integers(0, n, (draws, blocks))
    rows = [(d, b, int(starts[d, b])) for d in range(draws) for b in range(blocks)]
    return spark.createDataFrame(rows, "draw long, blk long, start long")


def _each(lengths: DataFrame, key: str, columns: str, make: Callable[[int], Iterator[dict]]) -> DataFrame:
    """The rows that make(n) gives, part by part, for each series of a table (key, n); made on the executors."""
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            for name, n in zip(pdf[key].tolist(), pdf["n"].tolist(), strict=True):
                for part in make(int(n)):
                    yield pd.DataFrame({key: name, "n": n, **part})

    return lengths.select(key, "n").mapInPandas(rows, f"{key} {dict(lengths.dtypes)[key]}, n long, {columns}")


def seeded_starts_of(lengths: DataFrame, key: str, draws: int, block: int, seed: int) -> DataFrame:
    """seeded_starts of each series of a table (key, n), with its key and n; each series has the generator's draws from the seed."""

    def make(n: int) -> Iterator[dict]:
        rng, blocks = np.random.default_rng(seed), math.ceil(n / block)
        for d in range(draws):
            yield {"draw": d, "blk": np.arange(blocks), "start": rng.integers(0, n, blocks)}

    return _each(lengths, key, "draw long, blk long, start long", make)


def hashed_starts(lengths: DataFrame, keys: list[str], draws: int, block: int, seed: int) -> DataFrame:
    """The same columns for each series of a table (keys, n), from a hash of seed, keys, draw and block: starts spread over 0..n-1.

    Draws are dealt out before their blocks are made, so that a table of a few long series keeps all tasks busy.
    """
    each = lengths.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    each = each.repartition(int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "draw")
    each = each.select(*keys, "n", F.col("draw").cast("long").alias("draw"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))).alias("blk"))
    u = unit_interval(F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("draw").cast("string"), F.col("blk").cast("string"))
    return each.select(*keys, "n", "draw", F.col("blk").cast("long").alias("blk"), F.least(F.floor(u * F.col("n")), F.col("n") - 1).cast("long").alias("start"))


def drawn(starts: DataFrame, series: DataFrame, block: int, keys: list[str] | None = None) -> DataFrame:
    """The rows of every draw: the series' columns with draw and place (place < n). starts needs n (or the series has it)."""
    keys = keys or []
    if "n" not in starts.columns:
        starts = starts.crossJoin(F.broadcast(series.agg(F.max("n").alias("n"))))
    each = starts.select(*keys, "n", "draw", (F.col("blk") * block).alias("first"), "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("off"))
    each = each.withColumn("place", F.col("first") + F.col("off")).where("place < n")
    each = each.select(*keys, "draw", "place", F.pmod(F.col("start") + F.col("off"), F.col("n")).alias("pos"))
    return each.hint("merge").join(series.drop("n"), [*keys, "pos"])


@dataclass(frozen=True)
class Statistic:
    """A statistic of sums: what is summed of a row, and the value from the sums by the same names.

    Any such pair can be given to draw_values and row_values; mean, excess, slope and interaction are some.
    """

    parts: dict[str, Column]
    value: Callable[[dict[str, Column]], Column]


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def _moments(**columns: Column) -> dict[str, Column]:
    """Columns where none of them is null, with their count n."""
    all_ = None
    for c in columns.values():
        all_ = c.isNotNull() if all_ is None else all_ & c.isNotNull()
    return {"n": F.when(all_, 1.0)} | {k: F.when(all_, c.cast("double")) for k, c in columns.items()}


def mean(x: Column) -> Statistic:
    return Statistic(_moments(x=x), lambda s: _ratio(s["x"], s["n"]))


def excess(x: Column, flag: Column) -> Statistic:
    """The mean of flagged rows less the mean of all."""
    own = F.when(flag, x)
    return Statistic({**_moments(x=x), **{f"f{k}": c for k, c in _moments(x=own).items()}}, lambda s: _ratio(s["fx"], s["fn"]) - _ratio(s["x"], s["n"]))


def slope_of(y: Column, x: Column, least: int = 3) -> Statistic:
    """cov/var over rows with both values; null under `least` of them or where x doesn't vary."""
    m = _moments(x=x, y=y)
    parts = {"n": m["n"], "x": m["x"], "y": m["y"], "xx": m["x"] * m["x"], "xy": m["x"] * m["y"]}
    # The determinant of equal values is rounding; what is under a share of its terms counts as none.
    spread = lambda s: s["n"] * s["xx"] - s["x"] * s["x"]
    varies = lambda s: F.when(spread(s) > 1e-12 * s["n"] * s["xx"], spread(s))
    return Statistic(parts, lambda s: F.when(s["n"] >= least, F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], varies(s))))


def interaction_of(a: Column, b: Column, y: Column) -> Statistic:
    """The coefficient of b in y ~ 1 + a + b, by the normal equations' determinants; null where they have no solution."""
    m = _moments(a=a, b=b, y=y)
    parts = {**m, **{p + q: m[p] * m[q] for p, q in ("aa", "ab", "bb", "ay", "by")}}

    def det(p, q, r):
        return p[0] * (q[1] * r[2] - q[2] * r[1]) - p[1] * (q[0] * r[2] - q[2] * r[0]) + p[2] * (q[0] * r[1] - q[1] * r[0])

    def value(c):
        below = det((c["n"], c["a"], c["b"]), (c["a"], c["aa"], c["ab"]), (c["b"], c["ab"], c["bb"]))
        return _ratio(det((c["n"], c["a"], c["y"]), (c["a"], c["aa"], c["ay"]), (c["b"], c["ab"], c["by"])), below)

    return Statistic(parts, value)


def _named(statistics: dict[str, Statistic]) -> tuple[dict[str, Column], dict[str, Column]]:
    """The distinct parts of some statistics by column name, and their values from those columns."""
    names: dict[str, str] = {}
    parts, values = {}, {}
    for k, s in statistics.items():
        own = {}
        for p, c in s.parts.items():
            name = names.setdefault(str(c), f"_m{len(names)}")
            parts[name], own[p] = c, F.col(name)
        values[k] = s.value(own)
    return parts, values


def row_values(df: DataFrame, statistics: dict[str, Statistic], keys: list[str]) -> DataFrame:
    """The statistics over the rows of each group, by name."""
    parts, values = _named(statistics)
    sums = df.select(*keys, *[c.alias(k) for k, c in parts.items()]).groupBy(*keys).agg(*[F.sum(k).alias(k) for k in parts])
    return sums.select(*keys, *[v.alias(k) for k, v in values.items()])


def _blocks(n: Column, block: int) -> Column:
    return F.ceil(n / block)


def _of_blocks(series: DataFrame, block: int, keys: list[str], columns: list[Column]) -> DataFrame:
    """Each row once for each block it is in: keys, start, off (its place in the block), last (whether it is also in a last, shorter block from there)."""
    offs = series.select(*keys, "n", "pos", *columns, F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("off"))
    short = F.col("n") - (_blocks(F.col("n"), block) - 1) * block
    return offs.withColumn("start", F.pmod(F.col("pos") - F.col("off"), F.col("n"))).withColumn("last", F.col("off") < short)


def draw_values(starts: DataFrame, series: DataFrame, block: int, statistics: dict[str, Statistic], keys: list[str]) -> DataFrame:
    """The statistics of each draw, by name: keys, draw. series: keys, pos, n and what the statistics read; starts: as hashed_starts makes them."""
    at_least(block, 1, "block")
    parts, values = _named(statistics)
    each = _of_blocks(series, block, keys, [c.alias(k) for k, c in parts.items()])
    full, short = (lambda k: F.sum(k).alias(k)), (lambda k: F.sum(F.when(F.col("last"), F.col(k))).alias(k))
    sums = each.groupBy(*keys, "start").agg(F.struct(*map(full, parts)).alias("_full"), F.struct(*map(short, parts)).alias("_short"))
    at_end = F.col("blk") == _blocks(F.col("n"), block) - 1
    met = starts.hint("merge").join(sums, [*keys, "start"]).select(*keys, "draw", F.when(at_end, F.col("_short")).otherwise(F.col("_full")).alias("_b"))
    sums = met.groupBy(*keys, "draw").agg(*[F.sum(f"_b.{k}").alias(k) for k in parts])
    return sums.select(*keys, "draw", *[v.alias(k) for k, v in values.items()])


def draw_lists(starts: DataFrame, series: DataFrame, block: int, values: dict[str, Column], keys: list[str]) -> DataFrame:
    """The values of each draw's rows as arrays of doubles by name, without nulls and in no order: keys, draw. An array has as many values as its series, at most."""
    each = _of_blocks(series, block, keys, [v.cast("double").alias(k) for k, v in values.items()])
    lists = lambda on: F.struct(*[F.collect_list(F.when(on, F.col(k)) if on is not None else F.col(k)).alias(k) for k in values])
    made = each.groupBy(*keys, "start").agg(lists(None).alias("_full"), lists(F.col("last")).alias("_short"))
    at_end = F.col("blk") == _blocks(F.col("n"), block) - 1
    met = starts.hint("merge").join(made, [*keys, "start"]).select(*keys, "draw", F.when(at_end, F.col("_short")).otherwise(F.col("_full")).alias("_b"))
    return met.groupBy(*keys, "draw").agg(*[F.flatten(F.collect_list(f"_b.{k}")).alias(k) for k in values])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def list_quantile(ordered: Column, q: float) -> Column:
    """The linear quantile of a sorted array without nulls; null of an empty one."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def list_mean(values: Column) -> Column:
    return _let(values, lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0)))


def list_tail(values: Column, q: float = 0.05, least: int = 1) -> Column:
    """The mean of an array's values at or below their q-quantile; null under `least` values."""
    tail = lambda o: _let(list_quantile(o, q), lambda cut: list_mean(F.filter(o, lambda v: v <= cut + 1e-12)))
    return _let(F.sort_array(values), lambda o: F.when(F.size(o) >= least, tail(o)))


def tail_draws(starts: DataFrame, series: DataFrame, block: int, x: str, flag: str, keys: list[str], q: float = 0.05, least: int = 5) -> DataFrame:
    """Of each draw, the tail mean of flagged rows less that of the others (difference); null where a side has under `least` rows."""
    sides = {"up": F.when(F.col(flag), F.col(x)), "down": F.when(~F.col(flag), F.col(x))}
    lists = draw_lists(starts, series, block, sides, keys)
    return lists.select(*keys, "draw", (list_tail(F.col("up"), q, least) - list_tail(F.col("down"), q, least)).alias("difference"))


def interval(per_draw: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Bounds of 95 % and p-values of the draws of a statistic; null draws are left out.

    p_one: share of draws at or below 0. p_two: twice the smaller side. One is added to the draws and the counts.
    """
    x = F.col(value)
    low, high, n = F.count(F.when(x <= 0, 1)), F.count(F.when(x >= 0, 1)), F.count(x)
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return per_draw.where(x.isNotNull()).groupBy(*keys).agg(
        q[0].alias("ci_low"), q[1].alias("ci_high"), ((low + 1) / (n + 1)).alias("p_one"),
        F.least(F.lit(1.0), 2 * F.least((low + 1) / (n + 1), (high + 1) / (n + 1))).alias("p_two"), n.alias("draws"),
    )


def shuffled_blocks(series: DataFrame, column: str, block: int, trials: int, seed: int | Column, keys: list[str], name: str) -> DataFrame:
    """The series once for each trial, with the column's blocks in an order that hashes give (a shorter last block moves too). A seed may be a column of the keys."""
    at_least(block, 1, "block")
    each = series.select(*keys, "n").distinct().withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("blk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
    u = F.sha2(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.col("trial").cast("string"), F.col("blk").cast("string")), 256)
    length = F.least(F.lit(block), F.col("n") - F.col("blk") * block)
    w = Window.partitionBy(*keys, "trial").orderBy("_u", "blk").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_u", u).withColumn("first", F.coalesce(F.sum(length).over(w), F.lit(0))).select(*keys, "trial", "blk", "first")
    moved = series.select(*keys, F.floor(F.col("pos") / block).cast("int").alias("blk"), (F.col("pos") % block).alias("_off"), F.col(column).alias(name)).join(each.hint("merge"), [*keys, "blk"])
    moved = moved.select(*keys, "trial", (F.col("first") + F.col("_off")).alias("pos"), name)
    return series.join(moved.hint("merge"), [*keys, "pos"])


def conditional_excess(draws: DataFrame, x: str, flag: Column, keys: list[str]) -> DataFrame:
    """Of each draw, the mean of flagged rows less the mean of all."""
    return draws.groupBy(*keys, "draw").agg((F.avg(F.when(flag, F.col(x))) - F.avg(x)).alias("excess"))


def sign_flip_bound(series: DataFrame, x: str, bps: float, draws: int, block: int, seed: int) -> DataFrame:
    """The 95th percentile of the mean with block signs drawn at random, less two legs' cost."""
    spark, n = series.sparkSession, series.agg(F.max("n")).first()[0] or 0
    if not n or draws <= 0:
        return spark.createDataFrame([(None,)], "placebo_95 double")
    block = max(1, min(block, n))
    rng = np.random.default_rng(seed)
    rows = [(d, b, float(s)) for d in range(draws) for b, s in enumerate(rng.choice([-1.0, 1.0], size=math.ceil(n / block)))]
    signs = spark.createDataFrame(rows, "draw long, blk long, sign double")
    means = signs.join(series.withColumn("blk", F.floor(F.col("pos") / block)), "blk").groupBy("draw").agg((F.avg(F.col(x) * F.col("sign")) - 2 * bps / 10_000).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.95)).alias("placebo_95"))


def sign_flip_bounds(series: DataFrame, key: str, x: str, bps: float, draws: int, block: int, seed: int) -> DataFrame:
    """sign_flip_bound of each series of a table."""

    def make(n: int) -> Iterator[dict]:
        rng, size = np.random.default_rng(seed), max(1, min(block, n))
        for d in range(draws):
            yield {"draw": d, "blk": np.arange(math.ceil(n / size)), "sign": rng.choice([-1.0, 1.0], size=math.ceil(n / size))}

    signs = _each(series.select(key, "n").distinct(), key, "draw long, blk long, sign double", make).drop("n")
    blk = F.floor(F.col("pos") / F.greatest(F.lit(1), F.least(F.lit(block), F.col("n"))))
    means = signs.hint("merge").join(series.withColumn("blk", blk), [key, "blk"]).groupBy(key, "draw").agg((F.avg(F.col(x) * F.col("sign")) - 2 * bps / 10_000).alias("m"))
    return means.groupBy(key).agg(F.percentile("m", F.lit(0.95)).alias("placebo_95"))


def permuted_each(series: DataFrame, key: str, column: str, block: int, seed: int, name: str) -> DataFrame:
    """permuted, for each series of a table."""

    def make(n: int) -> Iterator[dict]:
        order = np.random.default_rng(seed).permutation(math.ceil(n / block))
        lengths = np.minimum(block, n - order * block)
        yield {"blk": order, "first": np.cumsum(lengths) - lengths}

    moved = _each(series.select(key, "n").distinct(), key, "blk long, first long", make).drop("n")
    new = series.select(key, F.floor(F.col("pos") / block).alias("blk"), (F.col("pos") % block).alias("off"), F.col(column).alias(name)).join(moved.hint("merge"), [key, "blk"])
    return series.join(new.select(key, (F.col("first") + F.col("off")).alias("pos"), name).hint("merge"), [key, "pos"])


def permuted(series: DataFrame, column: str, block: int, seed: int, name: str) -> DataFrame:
    """The column with its blocks in a random order (the last, shorter block moves too): the values keep their counts."""
    spark, n = series.sparkSession, series.agg(F.max("n")).first()[0] or 0
    order = np.random.default_rng(seed).permutation(math.ceil(n / block))
    lengths = [min(block, n - b * block) for b in order.tolist()]
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1])).tolist() if lengths else []
    moved = spark.createDataFrame([(int(b), int(f)) for b, f in zip(order.tolist(), firsts, strict=True)], "blk long, first long")
    new = series.select(F.floor(F.col("pos") / block).alias("blk"), (F.col("pos") % block).alias("off"), F.col(column).alias(name)).join(F.broadcast(moved), "blk")
    return series.join(new.select((F.col("first") + F.col("off")).alias("pos"), name), "pos")


def folds(n: Column, warmup: int, train: int, test: int) -> Column:
    """Expanding folds over n rows: structs of fold, train_start, test_start and test_end; the last has half a window or more."""
    first = warmup + train
    at = F.sequence(F.lit(0), F.greatest(F.floor((n - first - 1) / test), F.lit(0)).cast("int"))
    all_ = F.transform(at, lambda k: F.struct((k + 1).alias("fold"), F.lit(warmup).alias("train_start"), (F.lit(first) + k * test).alias("test_start"), F.least(F.lit(first) + (k + 1) * test, n.cast("int")).alias("test_end")))
    return F.filter(all_, lambda f: f["test_end"] - f["test_start"] >= test // 2)
