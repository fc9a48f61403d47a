"""Aggregates and tests: tails, slopes, correlations, tables of counts, false discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slope(y: str, x: str, least: int = 3) -> Column:
    """cov/var, null under `least` pairs or where x doesn't vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(px) >= least, F.try_divide(F.covar_pop(px, py), F.nullif(F.var_pop(px), F.lit(0.0))))


def correlation(x: str, y: str) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(px, py), F.nullif(F.stddev_pop(px) * F.stddev_pop(py), F.lit(0.0)))


def tail_mean(df: DataFrame, x: str, groups: list[str], q: float = 0.05, least: int = 1, name: str = "cvar") -> DataFrame:
    """The mean of the values at or below the q-quantile of each group; null under `least` values."""
    cut = df.where(F.col(x).isNotNull()).groupBy(*groups).agg(F.percentile(x, F.lit(q)).alias("_q"), F.count(x).alias("_n"))
    joined = df.where(F.col(x).isNotNull()).join(cut, groups)
    return joined.groupBy(*groups).agg(F.when(F.max("_n") >= least, F.avg(F.when(F.col(x) <= F.col("_q"), F.col(x)))).alias(name))


def profit_factor(x: Column) -> Column:
    """Gains by losses, infinite without losses."""
    gains, losses = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0))
    return F.when(losses < 0, F.try_divide(gains, F.abs(losses))).otherwise(F.lit(float("inf")))


def row_shares(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of column values for each row value, as percentages of the row."""
    counts = df.groupBy(row).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values])
    total = sum((F.col(v) for v in values), F.lit(0))
    return counts.select(row, *[(F.try_divide(F.col(v) * 100.0, total)).alias(v) for v in values])


def with_time(df: DataFrame, y: str, x: str, groups: list[str], order: str) -> DataFrame:
    """The rows with both values as y, a = x and b = x*tau, tau from 0 to 1 over the rows of a group in order."""
    w = Window.partitionBy(*groups)
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    own = own.withColumn("_n", F.count(F.lit(1)).over(w))
    own = own.withColumn("_t", F.try_divide(F.row_number().over(w.orderBy(order)) - 1.0, F.col("_n") - 1.0))
    return own.select(*groups, order, F.col(x).alias("a"), (F.col(x) * F.col("_t")).alias("b"), F.col(y).alias("y"))


def interaction(timed: DataFrame, groups: list[str]) -> DataFrame:
    """The coefficient of b in y ~ 1 + a + b of each group, by the normal equations' determinants; null where they have no solution."""
    pairs = {"a": ("a",), "b": ("b",), "y": ("y",), "aa": ("a", "a"), "ab": ("a", "b"), "bb": ("b", "b"), "ay": ("a", "y"), "by": ("b", "y")}
    sums = [F.sum(reduce(lambda p, q: p * q, map(F.col, cs))).alias(f"_{k}") for k, cs in pairs.items()]
    g = timed.groupBy(*groups).agg(F.count(F.lit(1)).cast("double").alias("_n"), *sums)
    c = {k: F.col(f"_{k}") for k in ("n", *pairs)}

    def det(p, q, r):
        return p[0] * (q[1] * r[2] - q[2] * r[1]) - p[1] * (q[0] * r[2] - q[2] * r[0]) + p[2] * (q[0] * r[1] - q[1] * r[0])

    below = det((c["n"], c["a"], c["b"]), (c["a"], c["aa"], c["ab"]), (c["b"], c["ab"], c["bb"]))
    above = det((c["n"], c["a"], c["y"]), (c["a"], c["aa"], c["ay"]), (c["b"], c["ab"], c["by"]))
    return g.select(*groups, F.try_divide(above, F.nullif(below, F.lit(0.0))).alias("interaction"))


def time_interaction(df: DataFrame, y: str, x: str, groups: list[str], order: str) -> DataFrame:
    """The coefficient of x*tau in y ~ 1 + x + x*tau, tau from 0 to 1 over the rows."""
    return interaction(with_time(df, y, x, groups, order), groups)


def added_r2(y: str, x: str, extra: str) -> tuple[Column, Column]:
    """R2 of y on x, and what a second regressor adds to it; over rows with all three values, from their correlations."""
    all_three = F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(extra).isNotNull()
    a, b, c = (F.when(all_three, F.col(v)) for v in (y, x, extra))

    def r(p: Column, q: Column) -> Column:
        return F.try_divide(F.covar_pop(p, q), F.nullif(F.stddev_pop(p) * F.stddev_pop(q), F.lit(0.0)))

    one, other, between = r(a, b), r(a, c), r(b, c)
    both = F.try_divide(one * one + other * other - 2 * one * other * between, F.nullif(1 - between * between, F.lit(0.0)))
    return one * one, both - one * one


def false_discovery(df: DataFrame, p: str, name: str = "q", families: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: q of each row of its family; null p stays null and isn't counted.

    A family is a table of tests (a row a hypothesis), so its window is small.
    """
    families = families or []
    w = Window.partitionBy(*families, F.col(p).isNull())
    raw = F.col(p) * F.count(p).over(w) / F.row_number().over(w.orderBy(p))
    out = df.withColumn("_raw", F.when(F.col(p).isNotNull(), raw))
    return out.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(w.orderBy(p).rowsBetween(0, Window.unboundedFollowing))))).drop("_raw")


def r_squared(df: DataFrame, y: str, xs: list[str], groups: list[str]) -> DataFrame:
    """The R2 of y on several regressors with a constant, one fit a group.

    The sums of products are one grouped aggregation; a group's small system is solved from them.
    """
    import numpy as np
    import pandas as pd

    own = df.dropna(subset=[y, *xs])
    names = [y, *xs]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    g = own.groupBy(*groups).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(names)], *sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                k, n = len(names), row["_n"]
                mean = np.array([row[f"_s{i}"] for i in range(k)]) / n
                cov = np.array([[row[f"_{min(i, j)}_{max(i, j)}"] / n - mean[i] * mean[j] for j in range(k)] for i in range(k)])
                beta = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
                out.append([*[row[c] for c in groups], int(n), float(cov[1:, 0] @ beta / cov[0, 0]) if cov[0, 0] > 0 else None])
            yield pd.DataFrame(out, columns=[*groups, "n", "r2"])

    kinds = dict(df.dtypes)
    return g.mapInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in groups) + ", n long, r2 double")
