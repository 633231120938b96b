"""Queries of articles, notes, calendars, insider records and watchlists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import fulltext, store
from tidemark.operators import text as x
from tidemark.plans.registry import query
from tidemark.sources import driver as d
from tidemark.sources import shared
from tidemark.sources.driver import with_views

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9à-ÿ]+')"


@query("fts_search", (
    f"with t as (select doc_id, {_TOKENS} as w from documents), "
    f"s as (select doc_id, len(list_filter(w, lambda x: x in ('that', 'was'))) / (1 + ln(len(w))) as score from t where list_contains(w, 'that') "
    f"and list_contains(w, 'was')) select doc_id, round(score, 8) as score from s"
))
def fts_search(spark, sf):
    return x.search(d.table(spark, sf, "documents"), "text", ["that", "was"]).select("doc_id", F.round("score", 8).alias("score"))


@query("search_notes", (
    f"with t as (select conv_id, turn, {_TOKENS} as w from conversations) select conv_id, turn, case "
    f"when list_position(w, 'with') > 0 then array_to_string(w[greatest(list_position(w, 'with') - 5, 1):greatest(list_position(w, 'with') - 5, 1) + 10], "
    f"' ') end as headline from t where list_contains(w, 'with')"
))
def search_notes(spark, sf):
    found = x.search(d.table(spark, sf, "conversations"), "text", ["with"])
    return found.select("conv_id", "turn", x.fragment(F.col("text"), "with").alias("headline"))


@query("fts_ranked", None)
def fts_ranked(spark, sf):
    """Articles that hold all stems of a query, by the closeness of its words, from an index of titles and bodies."""
    n = d.news(spark, sf)
    path = shared.folder(spark, "news-index")
    shared.delete_on_exit(spark, path)
    index = fulltext.build(n, ["article_id"], F.concat_ws(" ", "title", "body"), path)
    return fulltext.search(index, spark, "ontions and the reing").select("article_id", "n_words", F.round("rank", 8).alias("rank"))


@query("notes_headlines", None)
def notes_headlines(spark, sf):
    """Notes that hold a word in any form, with their rank and two fragments; only the notes that are found are read again."""
    notes = d.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    path = shared.folder(spark, "notes-index")
    shared.delete_on_exit(spark, path)
    index = fulltext.build(notes, ["conv_id", "turn"], F.col("text"), path)
    found = fulltext.search(index, spark, "things").join(notes, ["conv_id", "turn"])
    return fulltext.headlines(found, F.col("text"), "things", "headline").select("conv_id", "turn", F.round("rank", 8).alias("rank"), "headline")


@query("news_recent", with_views("news") + " select article_id, published_on from news where symbol = 'S4' order by published_on desc, article_id limit 20")
def news_recent(spark, sf):
    return d.news(spark, sf).filter("symbol = 'S4'").orderBy(F.desc("published_on"), "article_id").limit(20).select("article_id", "published_on")


@query("news_general", with_views("news") + (
    ", m as (select * from news where symbol in ('S2', 'S3') or list_has_any(tags, ['src9'])) select article_id from (select * from m union all select * "
    "from news where not exists (select 1 from m)) order by published_on desc, article_id limit 25"
))
def news_general(spark, sf):
    n = d.news(spark, sf)
    matched = n.filter(F.col("symbol").isin("S2", "S3") | F.arrays_overlap("tags", F.array(F.lit("src9"))))
    none = matched.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").drop("n")
    return matched.unionByName(n.join(F.broadcast(none))).orderBy(F.desc("published_on"), "article_id").limit(25).select("article_id")


@query("news_alerts", with_views("news") + " select article_id from news where list_contains(tags, 'de') and article_id not in (select article_id from news where doc_id % 3 = 0)")
def news_alerts(spark, sf):
    n = d.news(spark, sf)
    return n.filter(F.array_contains("tags", "de")).join(n.filter("doc_id % 3 = 0").select("article_id"), "article_id", "left_anti").select("article_id")


@query("news_normalise", (
    "with r as (select 'https://n/' || cast(doc_id % 300 as varchar) as link, substr(text, 1, 40) as title, substr(text, 1, 500) as snippet, 'S' || "
    "cast(doc_id % 7 as varchar) as s, lang, doc_id as seen from documents) "
    "select substr(sha256(link), 1, 32) as article_id, arg_min(title, seen) as title, arg_min(snippet, seen) as snippet, list_sort(list(distinct s)) as "
    "symbols, list_sort(list(distinct lang)) as tags from r group by link"
))
def news_normalise(spark, sf):
    docs = d.table(spark, sf, "documents")
    k = F.col("doc_id")
    raw = docs.select(F.concat(F.lit("https://n/"), (k % 300).cast("string")).alias("link"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), F.array(F.concat(F.lit("s"), (k % 7).cast("string"), F.lit(".US"))).alias("symbols"), F.array("lang").alias("tags"), k.alias("seen"))
    return x.normalised_news(raw)


@query("parse_times", (
    "with r as (select doc_id, timestamp '2003-04-05 06:07:08' + to_days(cast(doc_id % 500 as integer)) as t from documents) select doc_id, case doc_id % 4 "
    "when 0 then t when 1 then t when 2 then date_trunc('day', t)::timestamp end as at from r"
))
def parse_times(spark, sf):
    k = F.col("doc_id")
    t = F.expr("timestamp_ntz'2003-04-05 06:07:08' + make_dt_interval(cast(doc_id % 500 as int))")
    text = F.when(k % 4 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 4 == 2, F.date_format(t, "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return d.table(spark, sf, "documents").select("doc_id", x.parsed_time(text).cast("timestamp_ntz").alias("at"))


#: What each name of the test tables is, by the rule: no patterns here, so that the lists are checked against it.
_IMPORTANCE = """case when name in ('FOMC Statement', 'CPI YoY', 'Nonfarm Payrolls', 'Unemployment Rate', 'PPI', 'Core PCE Price Index') then 'high'
   when name in ('GDP Growth Rate', 'JOLTS Job Openings', 'Retail Sales MoM', 'Michigan Consumer Sentiment', 'ISM Services PMI') then 'medium' else 'low' end"""


@query("classify_importance", with_views("economic_events") + f" select event_id, name, {_IMPORTANCE} as importance from economic_events")
def classify_importance(spark, sf):
    return d.economic_events(spark, sf).select("event_id", "name", x.importance(F.col("name")).alias("importance"))


@query("upcoming_events", with_views("economic_events") + (
    f" select event_id, event_at from economic_events where event_at >= timestamp '2024-01-10' and event_at < timestamp '2024-01-17' and country = 'US' "
    f"and list_position(['low', 'medium', 'high'], {_IMPORTANCE}) >= 2 order by event_at, event_id limit 50"
))
def upcoming_events(spark, sf):
    e = d.economic_events(spark, sf).withColumn("importance", x.importance(F.col("name")))
    window = (F.col("event_at") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("event_at") < F.lit("2024-01-17").cast("timestamp_ntz"))
    floor = store.ordinal(F.col("importance"), ["low", "medium", "high"]) >= 2
    return e.filter(window & (F.col("country") == "US") & floor).orderBy("event_at", "event_id").limit(50).select("event_id", "event_at")


@query("filter_ordinal_enum", with_views("economic_events") + f" select country, count(*) as n from economic_events where {_IMPORTANCE} = 'high' group by 1")
def filter_ordinal_enum(spark, sf):
    e = d.economic_events(spark, sf).withColumn("importance", x.importance(F.col("name")))
    return e.filter(store.ordinal(F.col("importance"), ["low", "medium", "high"]) >= 3).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("next_earnings", with_views("earnings") + " select symbol, min(report_date) as next_report, cast(min(report_date) - date '1999-05-05' as integer) as days from earnings where report_date >= date '1999-05-05' group by 1")
def next_earnings(spark, sf):
    day = F.lit("1999-05-05").cast("date")
    return d.earnings(spark, sf).filter(F.col("report_date") >= day).groupBy("symbol").agg(F.min("report_date").alias("next_report"), F.datediff(F.min("report_date"), day).alias("days"))


@query("earnings_in_window", with_views("earnings") + " select symbol, report_date from earnings where symbol in ('S1', 'S2', 'S5') and report_date between date '1999-05-05' and date '1999-05-19' order by report_date, symbol")
def earnings_in_window(spark, sf):
    e = d.earnings(spark, sf).filter(F.col("symbol").isin("S1", "S2", "S5") & F.col("report_date").between("1999-05-05", "1999-05-19"))
    return e.orderBy("report_date", "symbol").select("symbol", "report_date")


@query("earnings_revisions", with_views("earnings") + (
    " select symbol, report_date, case when estimate is not null or actual is not null then coalesce(actual, 0) - coalesce(estimate, 0) end as net, (actual "
    "- estimate) * 100 / nullif(abs(estimate), 0) as surprise_pct from earnings"
))
def earnings_revisions(spark, sf):
    return d.earnings(spark, sf).select("symbol", "report_date", x.net_revisions(F.col("actual"), F.col("estimate")).alias("net"), x.change_pct(F.col("actual"), F.col("estimate")).alias("surprise_pct"))


INSIDER = with_views("insider") + (
    ", ins as (select upper(split_part(code, '.', 1)) as symbol, filed_on, transaction_code, coalesce(shares * price, value) as worth, l_orderkey, "
    "l_linenumber from insider where transaction_code in ('P', 'S'))"
)


@query("insider_normalise", INSIDER + " select symbol, filed_on, transaction_code, worth from ins")
def insider_normalise(spark, sf):
    return x.insider(d.insider(spark, sf)).select("symbol", "filed_on", "transaction_code", "worth")


@query("insider_net_buys", INSIDER + (
    " select symbol, round(coalesce(sum(worth) filter (where transaction_code = 'P'), 0) - coalesce(sum(worth) filter (where transaction_code = 'S'), 0), "
    "4) as net, count(*) > 0 as has_activity from ins where filed_on >= date '2001-01-01' group by 1"
))
def insider_net_buys(spark, sf):
    i = x.insider(d.insider(spark, sf)).filter(F.col("filed_on") >= F.lit("2001-01-01").cast("date"))
    side = lambda c: F.coalesce(F.sum(F.when(F.col("transaction_code") == c, F.col("worth"))), F.lit(0.0))
    return i.groupBy("symbol").agg(F.round(side("P") - side("S"), 4).alias("net"), (F.count(F.lit(1)) > 0).alias("has_activity"))


@query("insider_recent", INSIDER + " select symbol, filed_on, worth, l_orderkey, l_linenumber from ins where symbol = 'S2' order by filed_on desc, worth desc nulls last, l_orderkey, l_linenumber limit 25")
def insider_recent(spark, sf):
    i = x.insider(d.insider(spark, sf)).filter("symbol = 'S2'")
    return i.orderBy(F.desc("filed_on"), F.desc_nulls_last("worth"), "l_orderkey", "l_linenumber").limit(25).select("symbol", "filed_on", "worth", "l_orderkey", "l_linenumber")


@query("get_fundamentals", with_views("fundamentals") + " select symbol, market_cap, pe_ratio from fundamentals where symbol = 'S4'")
def get_fundamentals(spark, sf):
    f = d.fundamentals(spark, sf).filter("symbol = 'S4'")
    return f.select("symbol", "market_cap", store.number(F.get_json_object("payload", "$.Highlights.PERatio")).alias("pe_ratio"))


@query("bulk_add_symbols", (
    "with c as (select c_custkey as id, 'S' || cast(c_custkey % 10 as varchar) || ', aa;9bad  S' || cast(c_custkey % 10 as varchar) || ' BRK.B' as line "
    "from customer), p as (select id, unnest(regexp_split_to_array(line, '[\\s,;]+')) as raw, generate_subscripts(regexp_split_to_array(line, '[\\s,;]+'), "
    "1) as pos from c), f as (select id, upper(raw) as symbol, min(pos) as pos from p where raw <> '' group by 1, 2) "
    "select id, cast(row_number() over (partition by id "
    "order by pos) as integer) as place, symbol, regexp_matches(symbol, '^[A-Z][A-Z0-9.\\-]{0,9}$') as valid from f"
))
def bulk_add_symbols(spark, sf):
    s = F.concat(F.lit("S"), (F.col("c_custkey") % 10).cast("string"))
    lines = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(s, F.lit(", aa;9bad  "), s, F.lit(" BRK.B")).alias("line"))
    return x.added_symbols(lines, "id", "line")


WATCH = with_views("watchlist", "bars") + (
    ", lb as (select symbol, arg_max(close, bar_date) as close, max(bar_date) as last_date from bars group by 1), wi as (select w.*, close, case direction "
    "when 'above' then close >= target_price when 'below' then close <= target_price else false end as met from watchlist w left join lb using (symbol))"
)


def _items(spark, sf):
    last = store.latest(d.bars(spark, sf), ["symbol"], "bar_date", ["close"])
    items = d.watchlist(spark, sf).join(last, "symbol", "left")
    return items.withColumn("met", x.target_met(F.col("direction"), F.col("close"), F.col("target_price")))


@query("watchlist_items", WATCH + " select item_id, list_name, symbol, close, met, (close - target_price) / target_price * 100 as pct from wi")
def watchlist_items(spark, sf):
    return _items(spark, sf).select("item_id", "list_name", "symbol", "close", "met", ((F.col("close") - F.col("target_price")) / F.col("target_price") * 100).alias("pct"))


@query("watchlist_alerts", WATCH + " select item_id, symbol, close, format('{} is {} its target', symbol, direction) as subject from wi where alert_enabled and coalesce(met, false)")
def watchlist_alerts(spark, sf):
    fired = _items(spark, sf).filter(F.col("alert_enabled") & F.coalesce("met", F.lit(False)))
    return fired.select("item_id", "symbol", "close", F.format_string("%s is %s its target", "symbol", "direction").alias("subject"))


@query("notes_revisions", (
    "with n as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as previous from conversations) "
    "select conv_id, turn, length(text) as size, previous is not null and previous <> text as changed from n"
))
def notes_revisions(spark, sf):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    n = d.table(spark, sf, "conversations").withColumn("previous", before)
    return n.select("conv_id", "turn", F.length("text").cast("long").alias("size"), (F.col("previous").isNotNull() & (F.col("previous") != F.col("text"))).alias("changed"))


@query("latest_session", (
    "with e as (select event_id, ts - interval 5 hour as local from events), "
    "f as (select event_id, cast(local as date) as day, isodow(local) as w, hour(local) as h from e) select event_id, case when w <= 5 "
    "and h >= 18 then day else day - cast(case w when 1 then 3 when 7 then 2 else 1 end as integer) end as session, cast(case "
    "when date '2024-02-01' > day then (select count(*) from range(cast(day + 1 as timestamp), timestamp '2024-02-02', interval 1 day) r(x) "
    "where isodow(x) <= 5) else 0 end as integer) as weekdays from f"
))
def latest_session(spark, sf):
    at = F.col("ts").cast("timestamp")
    day = F.to_date(F.from_utc_timestamp(at, "America/New_York"))
    return d.table(spark, sf, "events").select("event_id", x.latest_session(at).alias("session"), x.weekdays_since(day, F.lit("2024-02-01").cast("date")).alias("weekdays"))


@query("jsonable", with_views("trades") + """ select trade_id, '{"id":' || cast(trade_id as varchar) || ',"side":"' || side || '","tags":["' || exit_reason || '"]}' as doc from trades""")
def jsonable(spark, sf):
    return d.trades(spark, sf).select("trade_id", F.to_json(F.struct(F.col("trade_id").alias("id"), "side", F.array("exit_reason").alias("tags"))).alias("doc"))


@query("latest_trend", with_views("earnings") + " select symbol, arg_max(estimate, report_date) as estimate, max(report_date) as report_date from earnings where report_date <= date '2000-01-01' group by 1")
def latest_trend(spark, sf):
    e = d.earnings(spark, sf).filter(F.col("report_date") <= F.lit("2000-01-01").cast("date"))
    return store.latest(e, ["symbol"], "report_date", ["estimate", "report_date"])
