"""What a portfolio held as of each day, and the filters of scans that read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import strategies


def held(trades: DataFrame, days: DataFrame) -> DataFrame:
    """day, symbol, positions, notional for each day and symbol with an open trade.

    trades: symbol, entry_date, exit_date (null: open), notional. A trade is held from its entry to the day before its
    exit. Opening and closing are events; a day's holding is their running sum: one sorted sweep for each symbol, then
    as many rows as positions are open.
    """
    events = trades.select("symbol", F.col("entry_date").alias("day"), F.lit(1).alias("n"), "notional").union(
        trades.filter("exit_date is not null").select("symbol", "exit_date", F.lit(-1), -F.col("notional"))
    )
    daily = events.groupBy("symbol", "day").agg(F.sum("n").alias("n"), F.sum("notional").alias("notional"))
    w = Window.partitionBy("symbol").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    spells = daily.select("symbol", F.col("day").alias("first"), F.lead("day").over(w).alias("next"), F.sum("n").over(run).alias("positions"), F.sum("notional").over(run).alias("notional")).filter("positions > 0")
    known = days.select("day").distinct()
    top = known.agg(F.max("day")).first()[0]
    last = F.coalesce(F.date_sub("next", 1), F.lit(top))
    each = spells.filter(F.col("first") <= last).select("symbol", "positions", "notional", F.explode(F.sequence("first", last)).alias("day"))
    return each.join(known, "day", "left_semi").select("day", "symbol", "positions", "notional")


def drawdowns(equity: DataFrame) -> DataFrame:
    """as_of_date, equity, peak: the account's greatest equity so far. One row a day."""
    return equity.select("as_of_date", "equity", F.max("equity").over(Window.orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


def filtered(signals: DataFrame, holdings: DataFrame, sectors: DataFrame, equity: DataFrame, earnings: DataFrame, volumes: DataFrame) -> DataFrame:
    """signals (symbol, bar_date, entry, qty, ...) with blocked: the first portfolio filter that stands against each, as of its day.

    holdings: held(). sectors: symbol, sector. equity: as_of_date, equity: the last one at or before a day counts.
    earnings: symbol, report_date. volumes: symbol, bar_date, adv. What isn't known doesn't block. Signals of one day
    don't see each other.
    """
    days = signals.select("bar_date").distinct()
    mine = holdings.join(sectors, "symbol", "left")
    open_now = mine.groupBy("day").agg(F.sum("positions").alias("__open"))
    by_sector = mine.filter("sector is not null").groupBy("day", "sector").agg(F.sum("notional").alias("__in_sector"))
    account = drawdowns(equity)
    # Two tables of one row a day.
    as_of = days.join(F.broadcast(account), F.col("as_of_date") <= F.col("bar_date"), "left").groupBy("bar_date").agg(F.max_by(F.struct("equity", "peak"), "as_of_date").alias("__a"))
    next_report = earnings.select("symbol", F.explode(F.sequence(F.date_sub("report_date", 7), "report_date")).alias("bar_date"), "report_date")
    next_report = next_report.groupBy("symbol", "bar_date").agg(F.min("report_date").alias("__report"))
    s = signals.join(sectors.withColumnRenamed("sector", "__sector"), "symbol", "left")
    s = s.join(F.broadcast(as_of), "bar_date", "left").join(F.broadcast(open_now.withColumnRenamed("day", "bar_date")), "bar_date", "left")
    s = s.join(by_sector.withColumnsRenamed({"day": "bar_date", "sector": "__sector"}), ["bar_date", "__sector"], "left")
    s = s.join(holdings.select(F.col("day").alias("bar_date"), "symbol", F.lit(True).alias("__held")), ["bar_date", "symbol"], "left")
    s = s.join(next_report, ["symbol", "bar_date"], "left").join(volumes.select("symbol", "bar_date", F.col("adv").alias("__adv")), ["symbol", "bar_date"], "left")
    reason = strategies.filter_chain(
        F.col("__a.equity"), F.col("__a.peak"), F.coalesce("__held", F.lit(False)), F.datediff("__report", "bar_date"), F.coalesce("__open", F.lit(0)), F.col("entry") * F.col("qty"), F.coalesce("__in_sector", F.lit(0.0)), F.nullif("__adv", F.lit(0.0))
    )
    return s.withColumn("blocked", reason).select(*signals.columns, "blocked")
