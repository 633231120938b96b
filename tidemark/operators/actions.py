"""Corporate actions: the chain of split and dividend factors of a symbol, and bars adjusted by it.

A bar's factor is the product of the factors of all actions that come after it. The products are exact: they are
kept as fractions of whole numbers until each is rounded once, so they don't depend on the order of the actions.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import incremental, store

CHAIN = "symbol string, ex_date date, factor double, split double"


def with_closes(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """actions (symbol, ex_date, kind, ratio, amount) with base, the symbol's last close before the ex-date (null without one)."""
    closes = bars.select("symbol", F.col("bar_date").alias("ex_date"), F.col("close").alias("base"))
    return store.as_of(actions, closes, ["symbol"], "ex_date", ["base"], strict=True)


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """Factors for bars before each ex-date: products from the last action back."""
    whole, split, out = Fraction(1), Fraction(1), []
    for day, own in sorted(rows.groupby("ex_date", sort=False), key=lambda x: x[0], reverse=True):
        for kind, ratio, amount, base in zip(own["kind"], own["ratio"], own["amount"], own["base"]):
            if kind in ("split", "stock_div") and ratio is not None and ratio > 0:
                whole /= Fraction(ratio)
                split /= Fraction(ratio)
            elif kind == "cash_div" and amount is not None and base is not None and 0 < amount < base:
                whole *= 1 - Fraction(amount) / Fraction(base)
        out.append((rows["symbol"].iloc[0], day, float(whole), float(split)))
    return pd.DataFrame(out, columns=["symbol", "ex_date", "factor", "split"])


def chain(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, ex_date, factor, split: what prices, and by splits alone volumes, before each ex-date are multiplied and divided by.

    A split or stock dividend of `ratio` new shares for one divides prices by it; a cash dividend of `amount`
    multiplies them by 1 - amount / the last close before. Actions without a positive ratio, or with an amount that
    is not between 0 and that close, change nothing. One row for each ex-date of a symbol; a symbol's actions are
    a few rows, whatever the number of its bars.
    """
    numbers = with_closes(actions, bars).select("symbol", "ex_date", "kind", *[F.col(c).cast("double").alias(c) for c in ("ratio", "amount", "base")])
    whole = numbers.dropna(subset=["symbol", "ex_date"])
    return whole.groupBy("symbol").applyInPandas(lambda pdf: _chained(pdf.astype(object).where(pdf.notna(), None)), CHAIN)


def adjusted(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """bars with open, high, low, close and volume adjusted, the raw ones as *_raw, and the factor.

    A symbol's few steps meet its bars as one array: bars that lie in buckets by symbol are not moved.
    """
    prices, raw = ("open", "high", "low", "close"), ("open", "high", "low", "close", "volume")
    steps = factors.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ex_date", "factor", "split"))).alias("__steps"))
    own = bars.select("*", *[F.col(c).alias(f"{c}_raw") for c in raw])
    step = F.get(F.filter("__steps", lambda x: x["ex_date"] > F.col("bar_date")), F.lit(0))
    seen = own.join(steps, "symbol", "left").withColumn("__step", step).select(*own.columns, "__step.factor", "__step.split")
    factor, split = F.coalesce("factor", F.lit(1.0)), F.coalesce("split", F.lit(1.0))
    return seen.withColumns({"factor": factor, **{c: F.col(c) * factor for c in prices}, "volume": F.col("volume") / split}).drop("split")


def readjust(table: incremental.Table, bars: DataFrame, actions: DataFrame, new: DataFrame) -> DataFrame:
    """Brings a table of adjusted bars up to some new (or corrected) actions, which are part of `actions` already.

    Only bars of their symbols from before the newest of their ex-dates are adjusted again, and only years in which a
    row differs are rewritten. Returns the changed keys.
    """
    ends = new.groupBy("symbol").agg(F.max("ex_date").alias("__until"))
    own = bars.join(ends, "symbol").filter(F.col("bar_date") < F.col("__until")).drop("__until")
    mine = lambda df: df.join(ends.select("symbol"), "symbol", "left_semi")
    return incremental.merge(table, adjusted(own, chain(mine(actions), mine(bars))))
