"""Canonical market tables, derived from the star-schema parquet tables.

Each function returns a DataFrame with the columns that its operators expect. Prices are multiples of
2^-10, so sums over windows are exact in doubles whatever the order of addition.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, bar_date, open, high, low, close, adj_close, volume: one row for each supplier and ship date."""
    # Lines are dealt out by symbol once: the sums by day, the windows and the buckets of bars() all find a symbol in one task.
    symbol = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol")
    lines = table(spark, sf_dir, "lineitem").select(symbol, F.col("l_shipdate").cast("date").alias("bar_date"), F.col("l_quantity").cast("long").alias("q"), "l_linenumber", "l_partkey")
    z = F.sum(F.col("q") * (F.col("l_linenumber") + 1) + F.col("l_partkey")).alias("z")
    dealt = lines.repartition(_buckets(spark), "symbol")
    daily = dealt.groupBy("symbol", "bar_date").agg(z, F.sum("q").alias("q"))
    by_day = Window.partitionBy("symbol").orderBy("bar_date")
    ret = (F.col("z") * 7919) % 41 - 20  # thousandths: their sums are exact, and rounded once by the division
    path = F.sum(ret).over(by_day.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(1000.0)
    priced = daily.withColumn("close", F.floor(100 * F.exp(path) * 1024) / F.lit(1024.0))
    gap = ((F.col("z") % 11) - 5) * F.lit(0.0005)
    opened = priced.withColumn("open", F.coalesce(F.lag("close").over(by_day), F.lit(100.0)) * (1 + gap))
    return opened.select(
        "symbol",
        "bar_date",
        "open",
        (F.greatest("open", "close") * (1 + (F.col("z") % 7) * F.lit(0.001))).alias("high"),
        (F.least("open", "close") * (1 - (F.col("z") % 5) * F.lit(0.001))).alias("low"),
        "close",
        F.when(F.col("z") % 50 != 0, F.col("close") * F.when(F.col("bar_date") < F.lit("1998-06-01").cast("date"), 0.5).otherwise(1.0)).alias("adj_close"),
        (F.col("q") * 1000).alias("volume"),
    )


def _buckets(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


_BARS: dict[tuple, str] = {}
_LOCK = threading.Lock()


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """made_bars() as a table: written once for an application and the files of a folder, bucketed and sorted by symbol.

    Windows and groups by symbol need no exchange then, and filters on symbols, days and prices reach the files.
    """
    key = shared.stamp(spark, sf_dir)
    with _LOCK:
        if key not in _BARS:
            path, name = shared.folder(spark, "bars"), f"tidemark_bars_{uuid.uuid4().hex}"
            made_bars(spark, sf_dir).write.bucketBy(_buckets(spark), "symbol").sortBy("symbol", "bar_date").option("path", path).saveAsTable(name)
            shared.delete_on_exit(spark, path)
            _BARS[key] = name
    return spark.table(_BARS[key])


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bar_date, close: the mean close of all symbols, the benchmark series."""
    return bars(spark, sf_dir).groupBy("bar_date").agg(F.avg("close").alias("close"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_code, as_of_date, value: a volatility index and a credit spread by order date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("as_of_date"), "o_custkey", "o_orderkey")
    daily = orders.groupBy("as_of_date").agg(F.sum("o_custkey").alias("c"), F.sum("o_orderkey").alias("k"))
    vix = daily.select(F.lit("VIX").alias("series_code"), "as_of_date", (12 + (F.col("c") * 7919 % 401) / F.lit(16.0)).alias("value"))
    return vix.union(daily.select(F.lit("OAS"), "as_of_date", 2 + (F.col("k") * 7919 % 97) / F.lit(16.0)))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ex_date, kind (split, cash_div), ratio, amount: some of the lines that a supplier has shipped first in an order."""
    k = F.col("l_partkey")
    some = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_orderkey % 23 = 0")
    kind = F.when(k % 5 == 0, "split").otherwise("cash_div").alias("kind")
    return some.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").cast("date").alias("ex_date"), kind).agg(
        F.max(F.when(k % 5 == 0, F.when(k % 2 == 0, 2.0).otherwise(1.5))).alias("ratio"), F.max(F.when(k % 5 != 0, (k % 8 + 1) / F.lit(16.0))).alias("amount")
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector: the supplier's region; one symbol in nine has none."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.when(F.col("s_suppkey") % 9 != 0, F.col("r_name")).alias("sector"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, joined_date, left_date (null: still in)."""
    joined = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") * 37 % 900).cast("int"))
    left = F.when(F.col("s_suppkey") % 4 == 0, F.date_add(joined, 1500))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), joined.alias("joined_date"), left.alias("left_date"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, market_cap, payload: a nested JSON document with numbers, strings and marks for missing values."""
    cap = (F.floor(F.col("s_acctbal")) + 2000).cast("long") * 1000000
    payload = F.format_string('{"General":{"Code":"S%d","Sector":"%s"},"Highlights":{"MarketCapitalization":%d,"PERatio":"%s","DividendShare":"%s"},"SplitsDividends":{"PayoutRatio":%s}}', "s_suppkey", F.concat(F.lit("Sector "), F.col("s_nationkey").cast("string")), cap, F.when(F.col("s_suppkey") % 5 == 0, "NA").otherwise((F.col("s_suppkey") % 40).cast("string")), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise("0"), F.when(F.col("s_suppkey") % 3 == 0, "153.75").otherwise("0.25"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.when(F.col("s_suppkey") % 11 != 0, cap).alias("market_cap"), payload.alias("payload"))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, report_date, estimate, actual (null before the report)."""
    key = F.col("o_custkey") % 10 + 1
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("S"), key.cast("string")).alias("symbol"), F.col("o_orderdate").cast("date").alias("report_date")).agg(
        (F.min("o_custkey") % 50 / F.lit(16.0)).alias("estimate"), (F.when(F.max("o_orderstatus") != "P", F.max("o_custkey") % 60) / F.lit(16.0)).alias("actual")
    )


def insider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw insider records: code ("S1.US"), filed_on, transaction_code, shares, price (null at times), value."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".us")).alias("code"),
        F.col("l_shipdate").cast("date").alias("filed_on"),
        F.when(F.col("l_returnflag") == "R", "S").when(F.col("l_returnflag") == "A", "P").otherwise("G").alias("transaction_code"),
        F.col("l_quantity").cast("long").alias("shares"),
        F.when(F.col("l_partkey") % 10 != 0, (F.col("l_partkey") % 500 + 50) / F.lit(8.0)).alias("price"),
        (F.col("l_partkey") % 900 * 100.0).alias("value"),
        "l_orderkey",
        "l_linenumber",
    )


#: Names of the economic events, in the order of their numbers.
EVENTS = (
    "FOMC Statement", "CPI YoY", "Nonfarm Payrolls", "Unemployment Rate", "PPI", "Core PCE Price Index", "GDP Growth Rate", "JOLTS Job Openings", "Retail Sales MoM",
    "Michigan Consumer Sentiment", "ISM Services PMI", "10-Year Bond Auction", "Mortgage Applications", "Capital Expenditure",
)


def economic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_at, country, name, importance."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("event_at"),
        F.element_at(F.array(*[F.lit(c) for c in ("US", "DE", "FR", "JP")]), (F.col("user_id") % 4 + 1).cast("int")).alias("country"),
        F.element_at(F.array(*[F.lit(c) for c in EVENTS]), (F.col("event_id") % 14 + 1).cast("int")).alias("name"),
        "value",
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, symbol, published_at, title, body, tags."""
    return table(spark, sf_dir, "documents").select(
        F.substring(F.sha2(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), 256), 1, 32).alias("article_id"),
        "doc_id",
        F.concat(F.lit("S"), (F.col("doc_id") % 10 + 1).cast("string")).alias("symbol"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 360).cast("int")).alias("published_on"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("body"),
        F.array("lang", "source").alias("tags"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, list_name, symbol, target_price, direction, alert_enabled."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item_id"),
        F.lower("c_mktsegment").alias("list_name"),
        F.concat(F.lit("S"), (F.col("c_custkey") % 10 + 1).cast("string")).alias("symbol"),
        F.when(F.col("c_custkey") % 6 != 0, (F.col("c_custkey") % 300 + 20) / F.lit(2.0)).alias("target_price"),
        F.when(F.col("c_custkey") % 6 != 0, F.when(F.col("c_custkey") % 2 == 0, "above").otherwise("below")).alias("direction"),
        (F.col("c_custkey") % 3 != 0).alias("alert_enabled"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, symbol, side, entry_date, exit_date, entry, exit, stop, qty, commission, exit_reason, score."""
    k = F.col("o_orderkey")
    entry = (k % 400 + 80) / F.lit(4.0)
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        k.alias("trade_id"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 10 + 1).cast("string")).alias("symbol"),
        F.when(k % 5 == 0, "short").otherwise("long").alias("side"),
        F.col("o_orderdate").cast("date").alias("entry_date"),
        F.date_add(F.col("o_orderdate").cast("date"), (k % 30 + 1).cast("int")).alias("exit_date"),
        entry.alias("entry"),
        (entry + (k * 31 % 41 - 18) / F.lit(4.0)).alias("exit"),
        (entry - 2.5).alias("stop"),
        (k % 90 + 10).alias("qty"),
        (k % 3 * 0.5).alias("commission"),
        F.element_at(F.array(*[F.lit(x) for x in ("stop", "target", "time", "rule")]), (k % 4 + 1).cast("int")).alias("exit_reason"),
        (k % 100 / F.lit(128.0)).alias("score"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as_of_date, equity, positions_value: an account of 1,000,000 and a daily gain from order keys."""
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("as_of_date")).agg(((F.sum("o_orderkey") * 7919 % 2001 - 960) * 4.0).alias("gain"), F.count(F.lit(1)).alias("n"))
    path = F.sum("gain").over(Window.orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0))
    return daily.select("as_of_date", (1000000.0 + path).alias("equity"), (F.col("n") * 65536.0).alias("positions_value"))


#: The same tables in DuckDB's SQL, for the oracle. name -> (tables it needs, query).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """
        with d as (select l_suppkey, cast(l_shipdate as date) as bar_date,
                     cast(sum(cast(l_quantity as bigint) * (l_linenumber + 1) + l_partkey) as bigint) as z,
                     cast(sum(cast(l_quantity as bigint)) as bigint) as q from lineitem group by 1, 2),
        r as (select *, cast(((z * 7919) % 41 - 20) * 0.001 as decimal(9,6)) as ret from d),
        c as (select *, sum(ret) over (partition by l_suppkey order by bar_date rows between unbounded preceding and current row) as lr from r),
        p as (select *, floor(100 * exp(cast(lr as double)) * 1024) / cast(1024 as double) as close from c),
        o as (select *, coalesce(lag(close) over (partition by l_suppkey order by bar_date), cast(100.0 as double)) * (1 + cast(((z % 11) - 5) * 0.0005 as double)) as open from p)
        select 'S' || cast(l_suppkey as varchar) as symbol, bar_date, open, greatest(open, close) * (1 + cast((z % 7) * 0.001 as double)) as high,
               least(open, close) * (1 - cast((z % 5) * 0.001 as double)) as low, close,
               case when z % 50 <> 0 then close * cast(case when bar_date < date '1998-06-01' then 0.5 else 1.0 end as double) end as adj_close,
               q * 1000 as volume from o"""),
    "market": (("bars",), "select bar_date, avg(close) as close from bars group by bar_date"),
    "macro": ((), """
        with d as (select cast(o_orderdate as date) as as_of_date, cast(sum(o_custkey) as bigint) as c, cast(sum(o_orderkey) as bigint) as k from orders group by 1)
        select 'VIX' as series_code, as_of_date, 12 + (c * 7919 % 401) / 16.0::double as value from d
        union all select 'OAS', as_of_date, 2 + (k * 7919 % 97) / 16.0::double from d"""),
    "actions": ((), """
        select 'S' || cast(l_suppkey as varchar) as symbol, cast(l_shipdate as date) as ex_date, case when l_partkey % 5 = 0 then 'split' else 'cash_div' end as kind,
               max(case when l_partkey % 5 = 0 then case when l_partkey % 2 = 0 then 2.0 else 1.5 end end::double) as ratio,
               max(case when l_partkey % 5 <> 0 then (l_partkey % 8 + 1) / 16.0::double end) as amount
        from lineitem where l_linenumber = 1 and l_orderkey % 23 = 0 group by 1, 2, 3"""),
    "sectors": ((), """
        select 'S' || cast(s_suppkey as varchar) as symbol, case when s_suppkey % 9 <> 0 then r_name end as sector
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    "membership": ((), """
        select 'S' || cast(s_suppkey as varchar) as symbol, date '1995-01-01' + cast(s_suppkey * 37 % 900 as integer) as joined_date,
               case when s_suppkey % 4 = 0 then date '1995-01-01' + cast(s_suppkey * 37 % 900 + 1500 as integer) end as left_date from supplier"""),
    "fundamentals": ((), """
        select 'S' || cast(s_suppkey as varchar) as symbol, case when s_suppkey % 11 <> 0 then (cast(floor(s_acctbal) as bigint) + 2000) * 1000000 end as market_cap,
               case when s_suppkey % 5 = 0 then null else cast(s_suppkey % 40 as double) end as pe_ratio,
               case when s_suppkey % 7 = 0 then null else cast(0 as double) end as dividend_share,
               cast(case when s_suppkey % 3 = 0 then 153.75 else 0.25 end as double) as payout_ratio,
               'Sector ' || cast(s_nationkey as varchar) as sector_name, (cast(floor(s_acctbal) as bigint) + 2000) * 1000000 as raw_cap from supplier"""),
    "earnings": ((), """
        select 'S' || cast(o_custkey % 10 + 1 as varchar) as symbol, cast(o_orderdate as date) as report_date, min(o_custkey) % 50 / 16.0::double as estimate,
               case when max(o_orderstatus) <> 'P' then max(o_custkey) % 60 end / 16.0::double as actual from orders group by 1, 2"""),
    "insider": ((), """
        select 's' || cast(l_suppkey as varchar) || '.us' as code, cast(l_shipdate as date) as filed_on,
               case l_returnflag when 'R' then 'S' when 'A' then 'P' else 'G' end as transaction_code, cast(l_quantity as bigint) as shares,
               case when l_partkey % 10 <> 0 then (l_partkey % 500 + 50) / 8.0::double end as price, l_partkey % 900 * 100.0::double as value, l_orderkey, l_linenumber from lineitem"""),
    "economic_events": ((), """
        select event_id, ts as event_at, (['US', 'DE', 'FR', 'JP'])[user_id % 4 + 1] as country,
               (['FOMC Statement', 'CPI YoY', 'Nonfarm Payrolls', 'Unemployment Rate', 'PPI', 'Core PCE Price Index', 'GDP Growth Rate',
'JOLTS Job Openings', 'Retail Sales MoM', 'Michigan Consumer Sentiment', 'ISM Services PMI', '10-Year Bond Auction', 'Mortgage Applications',
'Capital Expenditure'])[event_id % 14 + 1] as name, value from events"""),
    "news": ((), """
        select substr(sha256('doc/' || cast(doc_id as varchar)), 1, 32) as article_id, doc_id, 'S' || cast(doc_id % 10 + 1 as varchar) as symbol,
               date '2000-01-01' + cast(doc_id % 360 as integer) as published_on, substr(text, 1, 60) as title, text as body, [lang, source] as tags from documents"""),
    "watchlist": ((), """
        select c_custkey as item_id, lower(c_mktsegment) as list_name, 'S' || cast(c_custkey % 10 + 1 as varchar) as symbol,
               case when c_custkey % 6 <> 0 then (c_custkey % 300 + 20) / 2.0::double end as target_price,
               case when c_custkey % 6 <> 0 then case when c_custkey % 2 = 0 then 'above' else 'below' end end as direction, c_custkey % 3 <> 0 as alert_enabled from customer"""),
    "trades": ((), """
        with t as (select *, (o_orderkey % 400 + 80) / 4.0::double as entry from orders where o_orderstatus = 'F')
        select o_orderkey as trade_id, 'S' || cast(o_custkey % 10 + 1 as varchar) as symbol, case when o_orderkey % 5 = 0 then 'short' else 'long' end as side,
               cast(o_orderdate as date) as entry_date, cast(o_orderdate as date) + cast(o_orderkey % 30 + 1 as integer) as exit_date, entry,
               entry + (o_orderkey * 31 % 41 - 18) / 4.0::double as exit, entry - 2.5::double as stop, o_orderkey % 90 + 10 as qty, o_orderkey % 3 * 0.5::double as commission,
               (['stop', 'target', 'time', 'rule'])[o_orderkey % 4 + 1] as exit_reason, o_orderkey % 100 / 128.0::double as score from t"""),
    "equity": ((), """
        with d as (select cast(o_orderdate as date) as as_of_date, (cast(sum(o_orderkey) as bigint) * 7919 % 2001 - 960) * 4.0::double as gain, count(*) as n from orders group by 1)
        select as_of_date, 1000000.0::double + sum(gain) over (order by as_of_date rows between unbounded preceding and current row) as equity, n * 65536.0::double as positions_value from d"""),
}


def with_views(*names: str) -> str:
    """A WITH clause (without a trailing comma) that defines the named views and what they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, sql = VIEWS[name]
        for n in needs:
            add(n)
        done.setdefault(name, sql)

    for n in names:
        add(n)
    return "with recursive " + ", ".join(f"{n} as materialized ({q})" for n, q in done.items())
