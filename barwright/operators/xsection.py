"""Cross-sections: ranks, buckets and filters within a date or another group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import share
from ..session import kept


def first_rank_share(df: DataFrame, x: str, groups: list[str], ties: list[str], name: str = "rank") -> DataFrame:
    """The row's rank by x in its group as a share of the group, ties in the order of `ties`."""
    w = Window.partitionBy(*groups)
    return df.withColumn(name, F.row_number().over(w.orderBy(x, *ties)) / F.count(F.lit(1)).over(w))


def bucket(rank: Column, q: float) -> Column:
    share(q)
    return F.when(rank <= q, "bottom").when(rank > 1 - F.lit(q), "top").otherwise("middle")


def large_groups(df: DataFrame, groups: list[str], least: int) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*groups))).where(F.col("_n") >= least).drop("_n")


def quantile_bins(df: DataFrame, x: str, groups: list[str], n: int, name: str = "bin") -> DataFrame:
    """Bins 1..n between linear quantiles, closed to the right, equal edges taken once; groups under n distinct values go."""
    shares = [k / n for k in range(n + 1)]
    cuts = df.where(F.col(x).isNotNull()).groupBy(*groups).agg(F.percentile(x, F.array(*map(F.lit, shares))).alias("_edges"), F.count_distinct(x).alias("_n"))
    out = df.where(F.col(x).isNotNull()).join(cuts.where(F.col("_n") >= n), groups)
    edges = F.array_distinct("_edges")
    return out.withColumn(name, (F.greatest(F.size(F.filter(edges, lambda e: e < F.col(x))) - 1, F.lit(0)) + 1).cast("int")).drop("_edges", "_n")


def average_rank(x: str, groups: list[str]) -> Column:
    w = Window.partitionBy(*groups)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*groups, x)) - 1) / 2


def terciles(df: DataFrame, x: str, groups: list[str], name: str = "regime", digits: int = 9) -> DataFrame:
    """low, mid, high by the group's own thirds; the cuts are rounded, so that a value that is a cut falls at or below it."""
    cuts = df.where(F.col(x).isNotNull()).groupBy(*groups).agg(F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_cuts"))
    out = df.where(F.col(x).isNotNull()).join(cuts, groups)
    return out.withColumn(name, F.when(F.col(x) <= F.round(F.col("_cuts")[0], digits), "low").when(F.col(x) <= F.round(F.col("_cuts")[1], digits), "mid").otherwise("high")).drop("_cuts")


def every_nth(df: DataFrame, n: int, groups: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where((F.col("_n") - 1) % n == 0).drop("_n")


def last_of_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key by an explicit order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest(df: DataFrame, n: int, groups: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def distinct_in_order(df: DataFrame, column: str, order: str, name: str = "place") -> DataFrame:
    """The distinct values of a column in the order in which they first come, with their places from 1.

    Places are made from sorted parts, each numbered by itself, and the parts' counts, so that no task holds all values.
    """
    first = df.groupBy(column).agg(F.min(order).alias("_first")).repartitionByRange("_first", column).withColumn("_part", F.spark_partition_id())
    first = kept(first, "distinct")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    counts = first.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_first", column))
    return first.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before", "_first")
