"""Articles, notes, calendars, insider records, symbols and watchlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; no stemming."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9à-ÿ]+"), F.lit(0))


def search(docs: DataFrame, text: str, words: list[str]) -> DataFrame:
    """docs that hold all words, with score: occurrences of the words over 1 + ln(number of words), highest first by score."""
    asked = sorted({w.lower() for w in words})
    df = docs.withColumn("__t", tokens(F.col(text)))
    hits = F.size(F.filter("__t", lambda w: w.isin(asked)))
    all_there = F.size(F.array_except(F.array(*[F.lit(w) for w in asked]), F.col("__t"))) == 0
    return df.filter(all_there).withColumn("score", hits / (1 + F.ln(F.size("__t").cast("double")))).drop("__t")


def fragment(text: Column, word: str, around: int = 5) -> Column:
    """The words around the first occurrence of a word, as a headline."""
    t = tokens(text)
    at = F.array_position(t, word).cast("int")
    return F.when(at > 0, F.array_join(F.slice(t, F.greatest(at - around, F.lit(1)), F.lit(2 * around + 1)), " "))


def normalised_news(raw: DataFrame) -> DataFrame:
    """article_id, title, snippet, symbols, tags of raw items (link, title, body, symbols, tags, seen): one row for each link.

    Symbols lose the exchange suffix; lists are merged and sorted; text comes from the item seen first.
    """
    item = raw.select(F.substring(F.sha2("link", 256), 1, 32).alias("article_id"), "title", F.substring("body", 1, 500).alias("snippet"), F.transform("symbols", lambda s: F.upper(F.regexp_replace(s, r"(?i)\.us$", ""))).alias("symbols"), "tags", "seen")
    merged = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    first = F.min_by(F.struct("title", "snippet"), F.struct("seen", "title", "snippet"))
    return item.groupBy("article_id").agg(first.alias("f"), merged("symbols").alias("symbols"), merged("tags").alias("tags")).select("article_id", "f.*", "symbols", "tags")


def parsed_time(text: Column) -> Column:
    """A time from any of the formats that feeds use; null for others."""
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


#: Names that make an economic event matter; a high pattern counts before a medium one.
HIGH = ("cpi", "core cpi", "core pce", "pce", "ppi", "nonfarm payroll", "non-farm payroll", "unemployment rate", "fomc", "federal funds", "fed funds", "interest rate decision", "interest rate")
MEDIUM = (
    "ism", "pmi", "retail sales", "gdp", "jolts", "initial jobless claims", "continuing jobless claims", "consumer confidence", "consumer sentiment", "michigan",
    "durable goods", "industrial production", "housing starts", "existing home sales", "new home sales", "trade balance", "factory orders",
)


def importance(name: Column) -> Column:
    """high, medium or low; null and empty names are low."""
    low = F.lower(name)
    has = lambda words: low.rlike("|".join(words))
    return F.when(has(HIGH), "high").when(has(MEDIUM), "medium").otherwise("low")


def net_revisions(up: Column, down: Column) -> Column:
    """up - down with null as 0; null where both are."""
    return F.when(up.isNotNull() | down.isNotNull(), F.coalesce(up, F.lit(0)) - F.coalesce(down, F.lit(0)))


def change_pct(now: Column, then: Column) -> Column:
    return F.try_divide((now - then) * 100, F.abs(then))


def insider(raw: DataFrame) -> DataFrame:
    """raw with symbol and worth; only purchases and sales. worth = shares * price, else the value that came with it."""
    own = raw.filter(F.col("transaction_code").isin("P", "S"))
    return own.withColumns({"symbol": F.upper(F.split("code", r"\.")[0]), "worth": F.coalesce(F.col("shares") * F.col("price"), F.col("value"))})


SYMBOL = r"^[A-Z][A-Z0-9.\-]{0,9}$"


def added_symbols(lines: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, symbol, valid: the distinct entries of a text, split at white space, commas and semicolons, in their order."""
    parts = lines.select(key, F.posexplode(F.split(F.trim(F.col(text)), r"[\s,;]+")).alias("at", "raw")).filter("raw <> ''")
    firsts = parts.withColumn("symbol", F.upper("raw")).groupBy(key, "symbol").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return firsts.select(key, place.alias("place"), "symbol", F.col("symbol").rlike(SYMBOL).alias("valid"))


def target_met(direction: Column, close: Column, target: Column) -> Column:
    return F.when(direction == "above", close >= target).when(direction == "below", close <= target).otherwise(False)


def latest_session(at: Column) -> Column:
    """The last finished weekday session at a UTC time: today from 18:00 in New York, else the weekday before; no holidays."""
    local = F.from_utc_timestamp(at, "America/New_York")
    day = F.to_date(local)
    done = (F.weekday(day) < 5) & (F.hour(local) >= 18)
    back = F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1)
    return F.when(done, day).otherwise(F.date_sub(day, back))


def weekdays_since(start: Column, end: Column) -> Column:
    """Weekdays after start up to end."""
    return F.when(end > start, F.size(F.filter(F.sequence(F.date_add(start, 1), F.when(end > start, end).otherwise(F.date_add(start, 1))), lambda x: F.weekday(x) < 5))).otherwise(0)
