"""Queries of scans, upserts, predicates, joins and aggregates over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.plans.registry import query
from tidemark.sources import driver as d
from tidemark.sources.driver import with_views


def date(text: str):
    return F.lit(text).cast("date")


# Scans


@query("scan_bars", with_views("bars") + " select * from bars where symbol = 'S3' and bar_date between date '1996-01-01' and date '1998-12-31'")
def scan_bars(spark, sf):
    return d.bars(spark, sf).filter((F.col("symbol") == "S3") & F.col("bar_date").between(date("1996-01-01"), date("1998-12-31")))


@query("adjust_bars", with_views("bars") + (
    ", f as (select *, case when close > 0 and adj_close is not null then adj_close / close else 1.0::double end as f from bars) "
    "select symbol, bar_date, open * f as open, high * f as high, low * f as low, coalesce(adj_close, close) as close, adj_close, volume / f as volume, "
    "open as open_raw, high as high_raw, low as low_raw, close as close_raw, volume as volume_raw from f"
))
def adjust_bars(spark, sf):
    return store.adjusted(d.bars(spark, sf))


@query("latest_bar_date", with_views("bars") + " select symbol, max(bar_date) as latest from bars group by symbol union all select '*', max(bar_date) from bars")
def latest_bar_date(spark, sf):
    bars = d.bars(spark, sf)
    return bars.groupBy("symbol").agg(F.max("bar_date").alias("latest")).union(bars.agg(F.max("bar_date").alias("latest")).select(F.lit("*"), "latest"))


@query("scan_macro_range", with_views("macro") + " select as_of_date, value from macro where series_code = 'VIX' and as_of_date between date '1996-01-01' and date '1997-12-31'")
def scan_macro_range(spark, sf):
    return d.macro(spark, sf).filter((F.col("series_code") == "VIX") & F.col("as_of_date").between(date("1996-01-01"), date("1997-12-31"))).select("as_of_date", "value")


@query("latest_macro_value", with_views("macro") + " select series_code, arg_max(value, as_of_date) as value, max(as_of_date) as as_of_date from macro where as_of_date <= date '1999-06-30' group by 1")
def latest_macro_value(spark, sf):
    return store.latest(d.macro(spark, sf).filter(F.col("as_of_date") <= date("1999-06-30")), ["series_code"], "as_of_date", ["as_of_date", "value"])


# Upserts: the table as it was on some day, and what came later


def _old_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    m = d.macro(spark, sf)
    old = m.filter(F.col("as_of_date") < date("1999-01-01"))
    return old, m.filter(F.col("as_of_date") >= date("1998-06-01")).withColumn("value", F.col("value") + 1)


@query("upsert_overwrite", with_views("macro") + " select series_code, as_of_date, value + case when as_of_date >= date '1998-06-01' then 1 else 0 end as value from macro")
def upsert_overwrite(spark, sf):
    return store.upsert(*_old_new(spark, sf), ["series_code", "as_of_date"])


@query("upsert_coalesce", with_views("earnings") + " select symbol, report_date, case when report_date >= date '1998-06-01' and day(report_date) % 2 = 0 then estimate + 1 else estimate end as estimate, actual from earnings")
def upsert_coalesce(spark, sf):
    e = d.earnings(spark, sf)
    new = e.filter(F.col("report_date") >= date("1998-06-01")).select("symbol", "report_date", F.when(F.dayofmonth("report_date") % 2 == 0, F.col("estimate") + 1).alias("estimate"), F.lit(None).cast("double").alias("actual"))
    return store.upsert_coalesce(e, new, ["symbol", "report_date"])


@query("insert_ignore", with_views("macro") + " select series_code, as_of_date, value + case when as_of_date >= date '1999-01-01' then 1 else 0 end as value from macro")
def insert_ignore(spark, sf):
    return store.insert_ignore(*_old_new(spark, sf), ["series_code", "as_of_date"])


@query("delete_orphans", with_views("watchlist") + " select item_id, list_name from watchlist where list_name <> 'building' and item_id % 5 <> 0")
def delete_orphans(spark, sf):
    w = d.watchlist(spark, sf)
    lists = w.filter("list_name <> 'building'").select("list_name").distinct()
    return store.without_orphans(w.filter("item_id % 5 <> 0").select("item_id", "list_name"), lists, ["list_name"])


# Provider documents: landed JSON and CSV lines


#: Summer time of the years in the tables: from the first Sunday of April to the last one of October.
_EOD = with_views("bars") + """, dst as (select *, make_date(year(bar_date), 4, 1) + cast((7 - isodow(make_date(year(bar_date), 4, 1))) % 7 as integer) as a, make_date(year(bar_date), 10, 31) - cast(isodow(make_date(year(bar_date), 10, 31)) % 7 as integer) as b from bars)
select symbol, bar_date, close, volume, cast(bar_date as timestamp) + to_hours(case when bar_date >= a and bar_date < b then 20 else 21 end) as bar_ts from dst where volume % 13000 <> 0"""


@query("provider_eod", _EOD)
def provider_eod(spark, sf):
    b = d.bars(spark, sf)
    landed = b.select(F.to_json(F.struct(F.when(F.col("volume") % 13000 != 0, F.col("symbol")).alias("code"), F.col("bar_date").cast("string").alias("date"), "close", "volume")).alias("line"))
    return _eod(landed)


def _eod(landed: DataFrame) -> DataFrame:
    """Bars from JSON lines; lines without code or date are left out; a day's bar is stamped at 16:00 in New York."""
    row = F.from_json("line", "code string, date string, close double, volume long")
    rows = landed.select(row.alias("r")).filter("r.code is not null and r.date is not null")
    day = F.col("r.date").cast("date")
    stamp = F.to_utc_timestamp(F.to_timestamp(F.concat("r.date", F.lit(" 16:00:00"))), "America/New_York").cast("timestamp_ntz")
    return rows.select(F.col("r.code").alias("symbol"), day.alias("bar_date"), "r.close", "r.volume", stamp.alias("bar_ts"))


@query("provider_universe", with_views("membership") + " select symbol, joined_date, left_date from membership where left_date is not null union all select symbol, date '2001-12-31', cast(null as date) from membership where left_date is null")
def provider_universe(spark, sf):
    m = d.membership(spark, sf)
    entry = F.struct(F.col("symbol").alias("Code"), F.col("joined_date").cast("string").alias("StartDate"), F.col("left_date").cast("string").alias("EndDate"))
    # One document with two maps, as a provider sends it: the members of today, and all that ever left.
    current = m.filter("left_date is null").select(F.to_json(F.create_map("symbol", entry)).alias("doc"), F.lit("Components").alias("part"))
    past = m.filter("left_date is not null").select(F.to_json(F.create_map("symbol", entry)).alias("doc"), F.lit("Historical").alias("part"))
    parsed = current.union(past).select("part", F.explode(F.map_values(F.from_json("doc", "map<string, struct<Code: string, StartDate: string, EndDate: string>>"))).alias("m"))
    now = parsed.filter("part = 'Components'").select(F.col("m.Code").alias("symbol"), date("2001-12-31").alias("joined_date"), F.lit(None).cast("date").alias("left_date"))
    then = parsed.filter("part = 'Historical'").select(F.col("m.Code").alias("symbol"), F.col("m.StartDate").cast("date").alias("joined_date"), F.col("m.EndDate").cast("date").alias("left_date"))
    return store.upsert(now, then, ["symbol", "joined_date"])


@query("provider_macro", with_views("macro") + " select series_code, as_of_date, value from macro where cast(value * 16 as bigint) % 7 not in (0, 1)")
def provider_macro(spark, sf):
    m = d.macro(spark, sf)
    k = (F.col("value") * 16).cast("long") % 7
    told = F.when(k == 0, F.lit(".")).when(k == 1, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    landed = m.select("series_code", F.to_json(F.struct(F.col("as_of_date").cast("string").alias("date"), told.alias("value"))).alias("line"))
    row = landed.select("series_code", F.from_json("line", "date string, value string").alias("r"))
    return row.select("series_code", F.col("r.date").cast("date").alias("as_of_date"), F.col("r.value").try_cast("double").alias("value")).filter("value is not null")


@query("source_csv", with_views("bars") + " select symbol, bar_date, close, volume from bars")
def source_csv(spark, sf):
    lines = d.bars(spark, sf).select(F.concat_ws(",", "bar_date", "symbol", "close", "volume").alias("line"))
    return lines.select(F.from_csv("line", "bar_date date, symbol string, close double, volume long").alias("r")).select("r.symbol", "r.bar_date", "r.close", "r.volume")


@query("incremental_backfill", with_views("bars") + (
    " , m as (select symbol, max(bar_date) filter (where bar_date < date '2000-01-01') as have from bars group by 1) "
    "select symbol, have, greatest(date '1995-01-01', have - 5) as fetch_from, have - 5 > date '2001-11-01' as skipped from m"
))
def incremental_backfill(spark, sf):
    have = d.bars(spark, sf).groupBy("symbol").agg(F.max(F.when(F.col("bar_date") < date("2000-01-01"), F.col("bar_date"))).alias("have"))
    start = F.date_sub("have", 5)
    return have.select("symbol", "have", F.greatest(date("1995-01-01"), start).alias("fetch_from"), (start > date("2001-11-01")).alias("skipped"))


@query("bulk_refresh_days", with_views("bars", "membership") + (
    " select bar_date, count(*) as n, sum(volume) as volume from bars where bar_date between date '1999-03-01' and date '1999-03-31' "
    "and symbol in (select symbol from membership where left_date is null) group by 1"
))
def bulk_refresh_days(spark, sf):
    wanted = d.membership(spark, sf).filter("left_date is null").select("symbol")
    days = d.bars(spark, sf).filter(F.col("bar_date").between(date("1999-03-01"), date("1999-03-31")))
    return days.join(wanted, "symbol", "left_semi").groupBy("bar_date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("refresh_cooldown", (
    "select user_id, max(ts) filter (where event_type = 'purchase') as last_ok, coalesce(max(ts) filter (where event_type = 'purchase') < timestamp "
    "'2024-01-30 00:00:00' - interval 24 hour, true) as due, greatest(0, cast(floor(epoch(max(ts) filter (where event_type = 'purchase') + interval 23 hour "
    "- timestamp '2024-01-30 00:00:00')) as bigint)) as seconds_left from events group by 1"
))
def refresh_cooldown(spark, sf):
    ok = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    e = d.table(spark, sf, "events").groupBy("user_id").agg(ok.alias("last_ok"))
    due = F.coalesce(F.col("last_ok") < now - F.expr("interval 24 hours"), F.lit(True))
    left = F.when(F.col("last_ok").isNotNull(), F.greatest(F.lit(0).cast("long"), F.expr("timestampdiff(second, timestamp_ntz'2024-01-30 00:00:00', last_ok + interval 23 hours)").cast("long"))).otherwise(F.lit(0).cast("long"))
    return e.select("user_id", "last_ok", due.alias("due"), left.alias("seconds_left"))


@query("sink_export_text", with_views("watchlist") + " select list_name, string_agg(distinct symbol, ', ' order by symbol) as line from watchlist group by 1")
def sink_export_text(spark, sf):
    return d.watchlist(spark, sf).groupBy("list_name").agg(F.concat_ws(", ", F.sort_array(F.collect_set("symbol"))).alias("line"))


@query("sink_export_json", with_views("trades") + """ select symbol, '{"symbol":"' || symbol || '","n":' || cast(count(*) as varchar) || ',"qty":' || cast(cast(sum(qty) as bigint) as varchar) || '}' as doc from trades group by symbol""")
def sink_export_json(spark, sf):
    per = d.trades(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))
    return per.select("symbol", F.to_json(F.struct("symbol", "n", "qty")).alias("doc"))


@query("sink_export_csv", with_views("bars") + " select bar_date, string_agg(symbol || ',' || cast(volume as varchar), ';' order by symbol) as line from bars group by 1")
def sink_export_csv(spark, sf):
    b = d.bars(spark, sf)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "volume"))), lambda x: F.concat_ws(",", x["symbol"], x["volume"].cast("string"))), ";")
    return b.groupBy("bar_date").agg(line.alias("line"))


# Predicates and projections


@query("filter_dynamic_where", with_views("trades") + " select trade_id from trades where side = 'long' and score >= 0.25 and score <= 0.6")
def filter_dynamic_where(spark, sf):
    return where(d.trades(spark, sf), side="long", score_min=0.25, score_max=0.6, symbol=None).select("trade_id")


def where(df: DataFrame, **asked) -> DataFrame:
    """Rows that meet every condition that is not None: column=value, column_min=, column_max=."""
    for name, value in asked.items():
        if value is not None:
            c = name.removesuffix("_min").removesuffix("_max")
            df = df.filter(F.col(c) >= value if name.endswith("_min") else F.col(c) <= value if name.endswith("_max") else F.col(c) == value)
    return df


@query("filter_ilike", with_views("bars") + " select distinct symbol from bars where upper(symbol) like upper('%s1%')")
def filter_ilike(spark, sf):
    return d.bars(spark, sf).filter(F.col("symbol").ilike("%s1%")).select("symbol").distinct()


@query("filter_optional_param", with_views("economic_events") + " select event_id from economic_events where country = 'US'")
def filter_optional_param(spark, sf):
    return where(d.economic_events(spark, sf), country="US", name=None).select("event_id")


@query("filter_in_list", with_views("earnings") + " select * from earnings where symbol in ('S1', 'S4', 'S9')")
def filter_in_list(spark, sf):
    return d.earnings(spark, sf).filter(F.col("symbol").isin("S1", "S4", "S9"))


@query("filter_array", with_views("news") + " select article_id, list_contains(tags, 'en') as is_en, list_has_any(tags, ['src1', 'fr']) as picked from news where list_contains(tags, 'en') or list_has_any(tags, ['src1', 'fr'])")
def filter_array(spark, sf):
    en, any_ = F.array_contains("tags", "en"), F.arrays_overlap("tags", F.array(F.lit("src1"), F.lit("fr")))
    return d.news(spark, sf).filter(en | any_).select("article_id", en.alias("is_en"), any_.alias("picked"))


@query("filter_pairs", with_views("trades") + " select trade_id from trades where (exit_reason = 'stop' and side = 'long') or (exit_reason = 'time' and side = 'short')")
def filter_pairs(spark, sf):
    pairs = spark.createDataFrame([("stop", "long"), ("time", "short")], "exit_reason string, side string")
    return d.trades(spark, sf).join(F.broadcast(pairs), ["exit_reason", "side"], "left_semi").select("trade_id")


@query("filter_date_between_interval", with_views("earnings") + " select distinct symbol from earnings where report_date between date '1998-03-02' and date '1998-03-02' + 7")
def filter_date_between_interval(spark, sf):
    day = date("1998-03-02")
    return d.earnings(spark, sf).filter(F.col("report_date").between(day, F.date_add(day, 7))).select("symbol").distinct()


@query("project_case", with_views("trades") + " select trade_id, case when side = 'long' then (exit - entry) * qty else (entry - exit) * qty end - commission as pnl from trades")
def project_case(spark, sf):
    move = F.when(F.col("side") == "long", F.col("exit") - F.col("entry")).otherwise(F.col("entry") - F.col("exit"))
    return d.trades(spark, sf).select("trade_id", (move * F.col("qty") - F.col("commission")).alias("pnl"))


@query("project_safe_ratio", with_views("trades") + " select trade_id, greatest(exit, entry) as best, least(exit, entry, stop) as worst, (exit - entry) / nullif(commission, 0) as per_cost, coalesce(nullif(commission, 0), 1) as cost from trades")
def project_safe_ratio(spark, sf):
    cost = F.nullif("commission", F.lit(0.0))
    return d.trades(spark, sf).select("trade_id", F.greatest("exit", "entry").alias("best"), F.least("exit", "entry", "stop").alias("worst"), F.try_divide(F.col("exit") - F.col("entry"), cost).alias("per_cost"), F.coalesce(cost, F.lit(1.0)).alias("cost"))


@query("project_json_extract", with_views("fundamentals") + " select symbol, pe_ratio, dividend_share, payout_ratio, sector_name, raw_cap from fundamentals")
def project_json_extract(spark, sf):
    at = lambda path: F.get_json_object("payload", path)
    return d.fundamentals(spark, sf).select("symbol", store.number(at("$.Highlights.PERatio")).alias("pe_ratio"), store.number(at("$.Highlights.DividendShare")).alias("dividend_share"), store.number(at("$.SplitsDividends.PayoutRatio")).alias("payout_ratio"), at("$.General.Sector").alias("sector_name"), at("$.Highlights.MarketCapitalization").cast("long").alias("raw_cap"))


@query("project_fit_numeric", with_views("fundamentals") + " select symbol, case when abs(payout_ratio) < 100 then round(payout_ratio, 1) end as small, case when abs(raw_cap::double) < 1e10 then round(raw_cap::double, 0) end as cap from fundamentals")
def project_fit_numeric(spark, sf):
    f = d.fundamentals(spark, sf)
    at = lambda path: store.number(F.get_json_object("payload", path))
    return f.select("symbol", store.fits(at("$.SplitsDividends.PayoutRatio"), 3, 1).alias("small"), store.fits(at("$.Highlights.MarketCapitalization"), 10, 0).alias("cap"))


@query("project_hash_id", "select doc_id, substr(sha256('https://news.example/' || cast(doc_id as varchar)), 1, 32) as id from documents")
def project_hash_id(spark, sf):
    link = F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string"))
    return d.table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(link, 256), 1, 32).alias("id"))


@query("project_clip", with_views("bars") + " select symbol, bar_date, case when adj_close is not null then greatest(-1, least(1, adj_close / 50 - 1)) end as clipped from bars")
def project_clip(spark, sf):
    from tidemark.functions.windows import clip

    return d.bars(spark, sf).select("symbol", "bar_date", clip(F.col("adj_close") / 50 - 1).alias("clipped"))


# Joins


@query("join_inner_equi", with_views("bars", "sectors") + " select sector, count(*) as n, max(close) as top from bars join sectors using (symbol) where sector is not null group by 1")
def join_inner_equi(spark, sf):
    return d.bars(spark, sf).join(d.sectors(spark, sf).filter("sector is not null"), "symbol").groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("top"))


@query("join_left_equi", with_views("watchlist", "bars") + (
    ", l as (select symbol, arg_max(close, bar_date) as last_close, max(bar_date) as last_date from bars group by 1) "
    "select item_id, w.symbol, last_close, last_date from watchlist w left join l on w.symbol = l.symbol"
))
def join_left_equi(spark, sf):
    last = store.latest(d.bars(spark, sf), ["symbol"], "bar_date", ["close", "bar_date"]).withColumnsRenamed({"close": "last_close", "bar_date": "last_date"})
    return d.watchlist(spark, sf).join(last, "symbol", "left").select("item_id", "symbol", "last_close", "last_date")


@query("join_self_mn", with_views("news") + " select a.article_id, b.doc_id as other from news a join news b on a.symbol = b.symbol and a.published_on = b.published_on and a.doc_id < b.doc_id where a.symbol = 'S3'")
def join_self_mn(spark, sf):
    n = d.news(spark, sf).filter("symbol = 'S3'")
    other = n.select("published_on", F.col("doc_id").alias("other"))
    return n.join(other, "published_on").filter("doc_id < other").select("article_id", "other")


@query("join_semi_exists", with_views("watchlist", "earnings") + " select item_id from watchlist w where exists (select 1 from earnings e where e.symbol = w.symbol and e.report_date between date '1999-01-01' and date '1999-01-20')")
def join_semi_exists(spark, sf):
    soon = d.earnings(spark, sf).filter(F.col("report_date").between(date("1999-01-01"), date("1999-01-20")))
    return d.watchlist(spark, sf).join(soon, "symbol", "left_semi").select("item_id")


@query("join_anti", with_views("trades") + " select trade_id from trades t where trade_id not in (select max(trade_id) from trades group by symbol, exit_date)")
def join_anti(spark, sf):
    t = d.trades(spark, sf)
    last = t.groupBy("symbol", "exit_date").agg(F.max("trade_id").alias("trade_id"))
    return t.join(last, "trade_id", "left_anti").select("trade_id")


@query("join_scalar_subquery", with_views("trades", "equity") + " select trade_id, entry * qty / (select equity from equity order by as_of_date desc limit 1) as weight from trades")
def join_scalar_subquery(spark, sf):
    last = d.equity(spark, sf).agg(F.max_by("equity", "as_of_date").alias("latest"))
    return d.trades(spark, sf).join(F.broadcast(last)).select("trade_id", (F.col("entry") * F.col("qty") / F.col("latest")).alias("weight"))


@query("join_correlated_array_agg", with_views("news", "watchlist") + " select n.article_id, coalesce((select list(item_id order by item_id) from watchlist w where w.symbol = n.symbol and w.list_name = 'machinery'), []) as items from news n")
def join_correlated_array_agg(spark, sf):
    """Articles of a symbol lie together, so that files hold its long list once, as a dictionary, and hot symbols are dealt over tasks."""
    per = d.watchlist(spark, sf).filter("list_name = 'machinery'").groupBy("symbol").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    together = d.news(spark, sf).select("article_id", "symbol").repartitionByRange(parts, "symbol", "article_id")
    return together.join(per, "symbol", "left").select("article_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


@query("join_update_from", with_views("trades", "bars") + (
    ", l as (select symbol, arg_max(close, bar_date) as c from bars group by 1) select trade_id, coalesce(c, exit) as mark, case "
    "when side = 'long' then coalesce(c, exit) - entry else entry - coalesce(c, exit) end * qty as open_pnl from trades left join l using (symbol)"
))
def join_update_from(spark, sf):
    last = store.latest(d.bars(spark, sf), ["symbol"], "bar_date", ["close"])
    t = d.trades(spark, sf).join(last, "symbol", "left").withColumn("mark", F.coalesce("close", "exit"))
    move = F.when(F.col("side") == "long", F.col("mark") - F.col("entry")).otherwise(F.col("entry") - F.col("mark"))
    return t.select("trade_id", "mark", (move * F.col("qty")).alias("open_pnl"))


@query("join_interval_membership", with_views("bars", "membership") + (
    " select bar_date, count(distinct symbol) as members from bars b where exists (select 1 from membership m where m.symbol = b.symbol "
    "and joined_date <= bar_date and (left_date is null or left_date > bar_date)) group by 1"
))
def join_interval_membership(spark, sf):
    held = store.in_interval(d.bars(spark, sf).select("symbol", "bar_date"), d.membership(spark, sf), ["symbol"], "bar_date", "joined_date", "left_date")
    return held.groupBy("bar_date").agg(F.countDistinct("symbol").alias("members"))


@query("join_asof_backward", with_views("bars", "macro") + " select symbol, bar_date, m.value as vix from bars b asof left join (select * from macro where series_code = 'VIX') m on b.bar_date >= m.as_of_date")
def join_asof_backward(spark, sf):
    # The series has no key; a fixed one would put all bars into one task, so the dates go first.
    b = d.bars(spark, sf).select("symbol", "bar_date")
    vix = d.macro(spark, sf).filter("series_code = 'VIX'").select(F.lit(1).alias("k"), F.col("as_of_date").alias("bar_date"), "value")
    days = store.as_of(b.select("bar_date").distinct().withColumn("k", F.lit(1)), vix, ["k"], "bar_date", ["value"])
    return b.join(days.select("bar_date", F.col("value").alias("vix")), "bar_date", "left").select("symbol", "bar_date", "vix")


@query("join_asof_forward", with_views("bars", "earnings") + " select b.symbol, b.bar_date, e.report_date as next_report from bars b asof left join earnings e on b.symbol = e.symbol and b.bar_date <= e.report_date")
def join_asof_forward(spark, sf):
    e = d.earnings(spark, sf).select("symbol", F.col("report_date").alias("bar_date"), F.col("report_date").alias("next_report"))
    return store.as_of(d.bars(spark, sf).select("symbol", "bar_date"), e, ["symbol"], "bar_date", ["next_report"], forward=True)


@query("join_align_inner", with_views("market", "macro") + " select bar_date, close, value from market join macro on bar_date = as_of_date where series_code = 'OAS'")
def join_align_inner(spark, sf):
    oas = d.macro(spark, sf).filter("series_code = 'OAS'").select(F.col("as_of_date").alias("bar_date"), "value")
    return d.market(spark, sf).join(oas, "bar_date").select("bar_date", "close", "value")


@query("join_align_outer", with_views("market", "macro") + " select coalesce(a.bar_date, b.as_of_date) as bar_date, close, value from market a full join (select * from macro where series_code = 'OAS') b on a.bar_date = b.as_of_date")
def join_align_outer(spark, sf):
    oas = d.macro(spark, sf).filter("series_code = 'OAS'").select(F.col("as_of_date").alias("bar_date"), "value")
    return d.market(spark, sf).join(oas, "bar_date", "full")


@query("join_theta", with_views("trades", "bars") + (
    ", l as (select symbol, arg_max(close, bar_date) as c from bars group by 1) select t.trade_id, w.c as level from trades t "
    "join l w on t.symbol = w.symbol and abs(t.entry - w.c) <= 0.5 * abs(t.exit - t.entry)"
))
def join_theta(spark, sf):
    last = store.latest(d.bars(spark, sf), ["symbol"], "bar_date", ["close"])
    near = F.abs(F.col("entry") - F.col("close")) <= 0.5 * F.abs(F.col("exit") - F.col("entry"))
    return d.trades(spark, sf).join(last, "symbol").filter(near).select("trade_id", F.col("close").alias("level"))


# Aggregates, ranks, limits


@query("agg_weekly_ohlcv", with_views("bars") + (
    " select symbol, cast(date_trunc('week', bar_date) as date) as week, arg_min(open, bar_date) as open, max(high) as high, min(low) as low, "
    "arg_max(close, bar_date) as close, cast(sum(volume) as bigint) as volume from bars group by 1, 2"
))
def agg_weekly_ohlcv(spark, sf):
    return resampled(d.bars(spark, sf), "week")


def resampled(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a week (from Monday), month or year: first open, extremes, last close, volume."""
    at = F.date_trunc(unit, "bar_date").cast("date").alias(unit)
    return bars.groupBy("symbol", at).agg(F.min_by("open", "bar_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_date").alias("close"), F.sum("volume").alias("volume"))


@query("agg_resample_monthly", with_views("bars") + (
    ", m as (select symbol, cast(date_trunc('month', bar_date) as date) as month, arg_max(close, bar_date) as close from bars group by 1, 2) "
    "select symbol, month, close, round(close / lag(close) over (partition by symbol order by month) - 1, 8) as ret from m"
))
def agg_resample_monthly(spark, sf):
    m = resampled(d.bars(spark, sf), "month")
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("month"))
    return m.select("symbol", "month", "close", F.round(F.col("close") / before - 1, 8).alias("ret"))


@query("agg_positions", with_views("trades") + " select symbol, cast(sum(qty) as bigint) as qty, round(sum(entry * qty) / sum(qty), 8) as avg_cost, min(entry_date) as since from trades where exit_date > date '2001-07-01' group by 1")
def agg_positions(spark, sf):
    open_ = d.trades(spark, sf).filter(F.col("exit_date") > date("2001-07-01"))
    return open_.groupBy("symbol").agg(F.sum("qty").alias("qty"), F.round(F.sum(F.col("entry") * F.col("qty")) / F.sum("qty"), 8).alias("avg_cost"), F.min("entry_date").alias("since"))


@query("agg_count_list", with_views("sectors", "watchlist") + " select s.symbol, count(w.item_id) as n from sectors s left join watchlist w on s.symbol = w.symbol group by 1")
def agg_count_list(spark, sf):
    return d.sectors(spark, sf).join(d.watchlist(spark, sf), "symbol", "left").groupBy("symbol").agg(F.count("item_id").alias("n"))


@query("agg_conditional", with_views("insider") + (
    " select code, count(*) filter (where transaction_code = 'P') as buys, count(*) filter (where transaction_code = 'S') as sells, coalesce(sum(value) "
    "filter (where transaction_code = 'P'), 0) - coalesce(sum(value) filter (where transaction_code = 'S'), 0) as net from insider group by 1"
))
def agg_conditional(spark, sf):
    is_ = lambda c: F.col("transaction_code") == c
    worth = lambda c: F.coalesce(F.sum(F.when(is_(c), F.col("value"))), F.lit(0.0))
    return d.insider(spark, sf).groupBy("code").agg(F.count_if(is_("P")).alias("buys"), F.count_if(is_("S")).alias("sells"), (worth("P") - worth("S")).alias("net"))


@query("agg_array_distinct_filter", with_views("news") + " select symbol, list_sort(list(distinct tags[1]) filter (where tags[1] <> 'en')) as langs from news group by 1")
def agg_array_distinct_filter(spark, sf):
    other = F.collect_set(F.when(F.col("tags")[0] != "en", F.col("tags")[0]))
    return d.news(spark, sf).groupBy("symbol").agg(F.sort_array(other).alias("langs"))


@query("agg_having", with_views("bars") + " select symbol, count(*) as n from bars where bar_date < date '1996-06-01' group by 1 having count(*) >= 100")
def agg_having(spark, sf):
    return d.bars(spark, sf).filter(F.col("bar_date") < date("1996-06-01")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n >= 100")


@query("agg_max_scalar", with_views("bars", "trades") + " select (select max(bar_date) from bars) as last_bar, (select max(trade_id) from trades) as last_trade, (select count(*) from trades where exit_date >= date '2001-07-01') as recent")
def agg_max_scalar(spark, sf):
    b = d.bars(spark, sf).agg(F.max("bar_date").alias("last_bar"))
    t = d.trades(spark, sf).agg(F.max("trade_id").alias("last_trade"), F.count_if(F.col("exit_date") >= date("2001-07-01")).alias("recent"))
    return b.join(F.broadcast(t))


@query("agg_distinct", with_views("membership") + " select distinct symbol from membership where joined_date <= date '1996-06-30' and (left_date is null or left_date > date '1996-06-30')")
def agg_distinct(spark, sf):
    return members_as_of(d.membership(spark, sf), "1996-06-30")


def members_as_of(membership: DataFrame, day: str) -> DataFrame:
    return membership.filter((F.col("joined_date") <= date(day)) & (F.col("left_date").isNull() | (F.col("left_date") > date(day)))).select("symbol").distinct()


@query("agg_histogram", with_views("trades") + " select exit_reason, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from trades group by 1")
def agg_histogram(spark, sf):
    t = d.trades(spark, sf)
    per = t.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(t.agg(F.count(F.lit(1)).alias("all")))).select("exit_reason", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("agg_quantiles", with_views("trades") + (
    " select symbol, quantile_cont(exit - entry, 0.25) as p25, quantile_cont(exit - entry, 0.5) as p50, quantile_cont(exit - entry, 0.75) as p75, min(exit "
    "- entry) as lo, max(exit - entry) as hi from trades group by 1"
))
def agg_quantiles(spark, sf):
    move = F.col("exit") - F.col("entry")
    q = d.trades(spark, sf).groupBy("symbol").agg(F.percentile(move, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min(move).alias("lo"), F.max(move).alias("hi"))
    return q.select("symbol", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "lo", "hi")


@query("agg_winner_loser_delta", with_views("trades") + (
    ", u as (select exit > entry as win, 'score' as input, score as v from trades union all select exit > entry, 'qty', qty from trades) "
    "select input, round(avg(v) filter (where win), 6) as winners, round(avg(v) filter (where not win), 6) as losers, round(avg(v) filter (where win) - "
    "avg(v) filter (where not win), 6) as delta from u group by 1"
))
def agg_winner_loser_delta(spark, sf):
    t = d.trades(spark, sf).select((F.col("exit") > F.col("entry")).alias("win"), "score", F.col("qty").cast("double").alias("qty"))
    long = t.unpivot("win", ["score", "qty"], "input", "v")
    a, b = F.avg(F.when(F.col("win"), F.col("v"))), F.avg(F.when(~F.col("win"), F.col("v")))
    return long.groupBy("input").agg(F.round(a, 6).alias("winners"), F.round(b, 6).alias("losers"), F.round(a - b, 6).alias("delta"))


@query("distinct_on", with_views("bars") + " select distinct on (symbol) symbol, bar_date, close from bars order by symbol, bar_date desc")
def distinct_on(spark, sf):
    return store.latest(d.bars(spark, sf), ["symbol"], "bar_date", ["bar_date", "close"])


@query("win_row_number", with_views("bars") + (
    ", r as (select *, row_number() over (partition by symbol order by bar_date desc) as k from bars) "
    "select a.symbol, a.close as last_close, b.close as prev_close from r a left join r b on a.symbol = b.symbol and b.k = 2 where a.k = 1"
))
def win_row_number(spark, sf):
    r = d.bars(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_date")))).filter("k <= 2")
    return r.groupBy("symbol").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("last_close"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("prev_close"))


@query("win_max_partition", with_views("trades") + " select trade_id, max(trade_id) over (partition by symbol, side, entry_date) as winner from trades")
def win_max_partition(spark, sf):
    return d.trades(spark, sf).select("trade_id", F.max("trade_id").over(Window.partitionBy("symbol", "side", "entry_date")).alias("winner"))


@query("win_percent_rank", with_views("fundamentals") + " select symbol, 100 * percent_rank() over (order by market_cap) as pct from fundamentals where market_cap is not null")
def win_percent_rank(spark, sf):
    known = d.fundamentals(spark, sf).filter("market_cap is not null").select("symbol", "market_cap")
    return store.percent_ranked(known, "market_cap", "pct").select("symbol", "pct")


@query("sort_nulls_last", with_views("fundamentals") + " select symbol, market_cap, row_number() over (order by market_cap desc nulls last, symbol) as place from fundamentals")
def sort_nulls_last(spark, sf):
    ranked = store.numbered(d.fundamentals(spark, sf).select("symbol", "market_cap"), ["market_cap", "symbol"], "place", ascending=False)
    return ranked.select("symbol", "market_cap", F.col("place").cast("long").alias("place"))


@query("topk_limit", with_views("fundamentals") + " select symbol, market_cap from fundamentals where market_cap is not null order by market_cap desc, symbol limit 5")
def topk_limit(spark, sf):
    return d.fundamentals(spark, sf).filter("market_cap is not null").orderBy(F.desc("market_cap"), "symbol").limit(5).select("symbol", "market_cap")


@query("topk_by_priority", with_views("trades") + " select distinct on (symbol) symbol, exit_reason, exit_date, trade_id from trades order by symbol, list_position(['rule', 'target', 'stop', 'time'], exit_reason), exit_date desc, trade_id")
def topk_by_priority(spark, sf):
    order = F.struct(store.ordinal(F.col("exit_reason"), ["rule", "target", "stop", "time"]), -F.unix_date("exit_date"), "trade_id")
    best = F.min_by(F.struct("exit_reason", "exit_date", "trade_id"), order)
    return d.trades(spark, sf).groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*")


@query("topk_per_group", with_views("trades") + ", r as (select symbol, side, trade_id, score, row_number() over (partition by symbol, side order by score desc, trade_id) as k from trades) select symbol, side, trade_id, score from r where k <= 3")
def topk_per_group(spark, sf):
    k = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(F.desc("score"), "trade_id"))
    return d.trades(spark, sf).withColumn("k", k).filter("k <= 3").select("symbol", "side", "trade_id", "score")


@query("greedy_pick", with_views("trades", "sectors") + (
    ", a as (select trade_id, t.symbol, sector, score, row_number() over (partition by t.symbol order by score desc, trade_id) as k from trades t "
    "join sectors s on t.symbol = s.symbol where score >= 0.3), b as (select *, row_number() over (partition by sector order by score desc, trade_id) as c "
    "from a where k = 1) select trade_id, symbol, sector, score from b where c <= 2 order by score desc, trade_id limit 6"
))
def greedy_pick(spark, sf):
    return book(d.trades(spark, sf).join(d.sectors(spark, sf), "symbol"), "sector", least=0.3, per_cluster=2, most=6).select("trade_id", "symbol", "sector", "score")


def book(candidates: DataFrame, cluster: str, least: float, per_cluster: int, most: int, ident: str = "trade_id") -> DataFrame:
    """A book in score order: one candidate of a symbol, so many of a cluster, `most` in all."""
    best = [F.desc("score"), F.asc(ident)]
    one = candidates.filter(F.col("score") >= least).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(*best))).filter("k = 1")
    few = one.withColumn("c", F.row_number().over(Window.partitionBy(cluster).orderBy(*best))).filter(F.col("c") <= per_cluster)
    return few.orderBy(*best).limit(most).drop("k", "c")


@query("set_ops", with_views("membership", "watchlist") + (
    ", a as (select symbol from membership where left_date is null), b as (select distinct symbol from watchlist) select 'union' as op, symbol "
    "from (select symbol from a union select symbol from b) union all select 'intersect', symbol from (select symbol from a intersect select symbol from b) "
    "union all select 'except', symbol from (select symbol from a except select symbol from b)"
))
def set_ops(spark, sf):
    a, b = d.membership(spark, sf).filter("left_date is null").select("symbol"), d.watchlist(spark, sf).select("symbol").distinct()
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "symbol")
    return tag("union", a.union(b).distinct()).union(tag("intersect", a.intersect(b))).union(tag("except", a.exceptAll(b).distinct()))


@query("agg_cube", "select l_returnflag as flag, l_linestatus as status, count(*) as n, grouping(l_returnflag) as gf, grouping(l_linestatus) as gs from lineitem group by cube (l_returnflag, l_linestatus)")
def agg_cube(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return rows.cube("flag", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping("flag").cast("long").alias("gf"), F.grouping("status").cast("long").alias("gs"))
