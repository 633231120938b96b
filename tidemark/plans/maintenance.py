"""Queries of tables that are kept up to date by merges: bars, their weekly aggregate, and bars adjusted by corporate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import actions as ca
from tidemark.operators import incremental as inc
from tidemark.plans.registry import query
from tidemark.sources import driver as d
from tidemark.sources import shared
from tidemark.sources.driver import with_views

KEYS = ("symbol", "bar_date")
#: The first load ends before this day; the provider has corrected what comes later.
LOADED = "1998-01-01"


def _provided(spark, sf) -> DataFrame:
    """What the provider has today: bars from 1998 on have one more share in their volume."""
    return d.bars(spark, sf).withColumn("volume", F.col("volume") + F.when(F.col("bar_date") >= F.lit("1997-12-25").cast("date"), 1).otherwise(0))


def _table(spark, label: str, keys=KEYS, day: str = "bar_date") -> inc.Table:
    path = shared.folder(spark, label)
    shared.delete_on_exit(spark, path)
    return inc.Table(path, tuple(keys), day)


def _kept(spark, sf) -> tuple[inc.Table, inc.Table]:
    """Bars and weekly bars after a first load and two backfills of the same bars."""
    bars, weeks, ledger = _table(spark, "bars-kept"), _table(spark, "weeks-kept", ("symbol", "week"), "week"), _table(spark, "ledger").path
    inc.log_changes(ledger, inc.merge(bars, d.bars(spark, sf).filter(F.col("bar_date") < F.lit(LOADED).cast("date"))), 0)
    inc.refresh_weekly(bars, weeks, ledger, spark)
    for batch in (1, 2):
        inc.log_changes(ledger, inc.backfill(bars, _provided(spark, sf), "1990-01-01"), batch)
        inc.refresh_weekly(bars, weeks, ledger, spark)
    return bars, weeks


#: Each symbol is fetched from 5 days before its last loaded bar on.
BACKFILLED = with_views("bars") + f""", have as (select symbol, max(bar_date) - 5 as since from bars where bar_date < date '{LOADED}' group by 1),
kept as (select b.* replace (volume + case when bar_date >= coalesce(since, date '1990-01-01') and bar_date >= date '1997-12-25' then 1 else 0 end as volume) from bars b left join have using (symbol))"""


@query("backfill_merged", BACKFILLED + " select symbol, bar_date, open, high, low, close, adj_close, volume from kept")
def backfill_merged(spark, sf):
    return _kept(spark, sf)[0].read(spark).select(*KEYS, "open", "high", "low", "close", "adj_close", "volume")


@query("weekly_refreshed", BACKFILLED + (
    " select symbol, cast(date_trunc('week', bar_date) as date) as week, arg_min(open, bar_date) as open, max(high) as high, min(low) as low, "
    "arg_max(close, bar_date) as close, max_by({'a': adj_close}, bar_date)['a'] as adj_close, cast(sum(volume) as bigint) as volume from kept group by 1, 2"
))
def weekly_refreshed(spark, sf):
    return _kept(spark, sf)[1].read(spark).select("symbol", "week", "open", "high", "low", "close", "adj_close", "volume")


#: Factors by a recursion from each symbol's last action back.
FACTORS = """, ac as (select a.*, b.close as base from actions a asof left join bars b on a.symbol = b.symbol and a.ex_date > b.bar_date),
fa as (select symbol, ex_date, product(case when kind = 'split' then 1 / ratio when amount < base then 1 - amount / base else 1 end) as f,
              product(case when kind = 'split' then 1 / ratio else 1 end) as s, row_number() over (partition by symbol order by ex_date desc) as k from ac group by 1, 2),
ch as (select symbol, ex_date, f, s, k from fa where k = 1 union all select fa.symbol, fa.ex_date, ch.f * fa.f, ch.s * fa.s, fa.k from ch join fa on fa.symbol = ch.symbol and fa.k = ch.k + 1)"""


@query("action_factors", with_views("bars", "actions") + FACTORS + " select symbol, ex_date, round(f, 9) as factor, round(s, 9) as split from ch")
def action_factors(spark, sf):
    factors = ca.chain(d.actions(spark, sf), d.bars(spark, sf))
    return factors.select("symbol", "ex_date", F.round("factor", 9).alias("factor"), F.round("split", 9).alias("split"))


@query("adjust_by_actions", with_views("bars", "actions") + FACTORS + (
    " select b.symbol, bar_date, round(close * coalesce(f, 1), 6) as close, round(volume / coalesce(s, 1), 3) as volume, close as close_raw "
    "from bars b asof left join ch on b.symbol = ch.symbol and b.bar_date < ch.ex_date"
))
def adjust_by_actions(spark, sf):
    """Bars adjusted by the actions up to 1998, kept as a table, then adjusted again for the later ones."""
    bars, actions = d.bars(spark, sf).drop("adj_close"), d.actions(spark, sf)
    early = actions.filter(F.col("ex_date") < F.lit("1998-01-01").cast("date"))
    table = _table(spark, "adjusted")
    inc.merge(table, ca.adjusted(bars, ca.chain(early, bars)))
    ca.readjust(table, bars, actions, actions.join(early, ["symbol", "ex_date", "kind"], "left_anti"))
    return table.read(spark).select(*KEYS, F.round("close", 6).alias("close"), F.round("volume", 3).alias("volume"), "close_raw")
