"""Column helpers over windows of a ticker's bars in date order.

Every rolling value is null until its whole frame has values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def so_far() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def framed(agg: Callable[[Column], Column], x: Column, lo: int, hi: int) -> Column:
    """``agg`` of ``x`` over rows lo to hi around the current one; null unless all of them have values."""
    frame = by_date().rowsBetween(lo, hi)
    return F.when(F.count(x).over(frame) == hi - lo + 1, agg(x).over(frame))


def rolling(agg: Callable[[Column], Column], x: Column, n: int) -> Column:
    return framed(agg, x, -(n - 1), 0)


def previous(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_date())


def log_return(x: Column, n: int = 1) -> Column:
    return F.ln(x) - F.ln(previous(x, n))


def simple_return(x: Column) -> Column:
    return F.try_divide(x, previous(x)) - 1


def forward_return(x: Column, h: int) -> Column:
    """Entry at the next close, exit h closes later; null past the end."""
    return F.try_divide(F.lead(x, 1 + h).over(by_date()), F.lead(x, 1).over(by_date())) - 1


def position() -> Column:
    return (F.row_number().over(by_date()) - 1).cast("long")


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def drawdown(x: Column, over: WindowSpec | None = None) -> Column:
    return x / F.max(x).over(over or so_far()) - 1


def edge(condition: Column, over: WindowSpec | None = None) -> Column:
    """True where a condition holds and didn't on the row before; nulls count as false."""
    held = F.coalesce(condition, F.lit(False))
    return held & ~F.coalesce(F.lag(held, 1).over(over or by_date()), F.lit(False))
