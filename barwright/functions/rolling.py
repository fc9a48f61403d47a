"""Rolling expressions over the rows of a series, null until enough values are seen.

A Series names the key and the order; all its expressions share one window specification, so that one exchange and one
sort serve them all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    key: str | list[str] = "ticker"  # one column, or several
    order: str = "date"

    @property
    def rows(self):
        return Window.partitionBy(self.key).orderBy(self.order)

    def frame(self, first: int, last: int):
        return self.rows.rowsBetween(first, last)

    @property
    def so_far(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def all(self):
        return Window.partitionBy(self.key)

    def over(self, f: Callable[[Column], Column], x: Column | str, first: int, last: int, least: int | None = None) -> Column:
        """f of x over rows first..last, where at least `least` (default: all) of them have a value."""
        w, x = self.frame(first, last), F.col(x) if isinstance(x, str) else x
        return F.when(F.count(x).over(w) >= (last - first + 1 if least is None else least), f(x).over(w))

    def last_known(self, x: Column | str) -> Column:
        return F.last(x, ignorenulls=True).over(self.so_far)

    def change(self, x: str, k: int = 1) -> Column:
        """x against its value k rows before, as a share."""
        return F.try_divide(F.col(x), F.nullif(F.lag(x, k).over(self.rows), F.lit(0))) - 1

    def equity(self, r: Column | str) -> Column:
        """The running product of 1 + r."""
        return F.product(1 + (F.col(r) if isinstance(r, str) else r)).over(self.so_far)

    def drawdown(self, equity: str, start_at_one: bool = False) -> Column:
        """Equity against its running peak; start_at_one counts a loss on the first row."""
        peak = F.max(equity).over(self.so_far)
        return F.col(equity) / (F.greatest(F.lit(1.0), peak) if start_at_one else peak) - 1

    def correlation(self, x: str, y: str, n: int) -> Column:
        """Over n rows on which both have values; null where one doesn't vary."""
        w = self.frame(-(n - 1), 0)
        px, py = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
        spread = F.stddev_pop(px).over(w) * F.stddev_pop(py).over(w)
        return F.when(F.count(px).over(w) == n, F.try_divide(F.covar_pop(px, py).over(w), F.nullif(spread, F.lit(0.0))))

    def trailing_rank(self, x: str, n: int) -> Column:
        """The share of the last n values that x ranks above, ties at their average; null before n values."""
        w = self.frame(-(n - 1), 0)
        held = F.collect_list(x).over(w)  # without nulls, at most n long
        less, same = F.size(F.filter(held, lambda v: v < F.col(x))), F.size(F.filter(held, lambda v: v == F.col(x)))
        return F.when(F.col(x).isNotNull() & (F.count(x).over(w) == n), (less + (same + 1) / 2) / F.size(held))
