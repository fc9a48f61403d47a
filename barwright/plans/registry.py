"""Queries and their SQL twins by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the same in DuckDB's SQL where there is such.

    The columns named in `dates` are given as ISO text on both sides, since the engines hand dates to Python differently.
    """

    def put(f: Query) -> Query:
        names = dates.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c in names}) if names else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return put


def r6(x: Column | str) -> Column:
    """Rounded to six decimals, as the SQL twins do; rounding comes last and never before a threshold."""
    return F.round(x, 6)
