"""Column builders over backward windows of one symbol: the row at a date reads no later bar."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    """One symbol's bars in order. All windows of this key and order share one exchange and one sort."""
    return Window.partitionBy("symbol").orderBy("bar_date")


def last(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return (w or by_symbol()).rowsBetween(-(n - 1), 0)


def before(n: int, skip: int = 1, w: WindowSpec | None = None) -> WindowSpec:
    """n rows that end `skip` rows before the current one."""
    return (w or by_symbol()).rowsBetween(-(n + skip - 1), -skip)


def full(value: Column, of: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    """value where all of the last n rows have `of`, else null."""
    return F.when(F.count(of).over(last(n, w)) == n, value)


def sma(c: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(F.avg(c).over(last(n, w)), c, n, w)


def lag(c: str | Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(c, n).over(w or by_symbol())


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """x within [low, high]; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def rank_average(c: str, n: int, w: WindowSpec | None = None) -> Column:
    """Rank of the current value among the last n (ties: their mean rank), over n."""
    return _ranked(c, n, w, lambda below, equal: (below + (equal + 1) / 2) / n)


def rank_at_most(c: str, n: int, w: WindowSpec | None = None) -> Column:
    """Share of the last n values that are at most the current one."""
    return _ranked(c, n, w, lambda below, equal: (below + equal) / n)


def _ranked(c: str, n: int, w: WindowSpec | None, of) -> Column:
    values = F.collect_list(c).over(last(n, w))
    below = F.size(F.filter(values, lambda v: v < F.col(c))).cast("double")
    equal = F.size(F.filter(values, lambda v: v == F.col(c))).cast("double")
    return F.when((F.size(values) == n) & F.col(c).isNotNull(), of(below, equal))
