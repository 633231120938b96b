"""Market-wide reads: regime scores, equal-weight sectors, breadth, drawdowns and calendar effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import clip, rank_average

#: One series has one window; it is short (one row for each day), whatever the number of symbols.
SERIES = ("series", "bar_date")


def by_series():
    return Window.partitionBy("series").orderBy("bar_date")


def rows(n: int):
    return by_series().rowsBetween(-(n - 1), 0)


def mean(c: str, n: int) -> Column:
    w = rows(n)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def calm_score(c: str, n: int = 252) -> Column:
    """1 - the rolling percentile rank: high when the series is low against its year."""
    return 1 - rank_average(c, n, by_series())


def trend_score(df: DataFrame, c: str = "close") -> DataFrame:
    """df with trend_score in [0, 1]: place against SMA 200 and its 20-row slope."""
    df = df.withColumn("__s", mean(c, 200))
    then = F.lag("__s", 20).over(by_series())
    pos, slope = clip((F.col(c) - F.col("__s")) / F.col("__s") / 0.05), clip((F.col("__s") - then) / then / 0.02)
    return df.withColumn("trend_score", clip(0.5 + 0.25 * (pos + slope), 0.0)).drop("__s")


def breadth_score(df: DataFrame, equal: str, weighted: str) -> DataFrame:
    """df with breadth_score in [0, 1]: SMA 20 of the ratio of an equal-weight to a weighted series against its SMA 200."""
    df = df.withColumn("__r", F.col(equal) / F.col(weighted)).withColumns({"__a": mean("__r", 20), "__b": mean("__r", 200)})
    return df.withColumn("breadth_score", 0.5 + 0.5 * clip((F.col("__a") - F.col("__b")) / F.col("__b") / 0.05)).drop("__r", "__a", "__b")


def credit_stress(df: DataFrame, c: str) -> DataFrame:
    """df with credit_stress: the spread is in the top 15% of its year and above its value 5 rows ago; unknown: false."""
    rising = F.col(c) > F.lag(c, 5).over(by_series())
    return df.withColumn("__rank", rank_average(c, 252, by_series())).withColumn("credit_stress", F.coalesce((F.col("__rank") > 0.85) & rising, F.lit(False))).drop("__rank")


def zscore(c: str, n: int = 252) -> Column:
    w = rows(n)
    dev = F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))
    return F.when(F.count(c).over(w) == n, F.try_divide(F.col(c) - F.avg(c).over(w), dev))


#: Weights of the composite: fixed values.
WEIGHTS = {"vol_score": 0.40, "trend_score": 0.25, "breadth_score": 0.20, "credit_score": 0.15}


def composite() -> Column:
    """Weighted mean of the components that are there; null where none is."""
    total = sum((F.coalesce(w * F.col(c), F.lit(0.0)) for c, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in WEIGHTS.items()), F.lit(0.0))
    return F.try_divide(total, weight)


def label(adx: Column, close: Column, sma200: Column) -> Column:
    up = F.when(close > sma200, "trending_up").otherwise("trending_down")
    return F.when(adx > 25, up).when(adx < 18, "choppy").otherwise("transitioning")


def regime_factor(affinity: Column, score: Column, stress: Column) -> Column:
    """Position scale: the strategy's affinity, by half to full with the composite, halved under credit stress."""
    return affinity * F.coalesce(0.5 + 0.5 * score, F.lit(1.0)) * F.when(stress, 0.5).otherwise(1.0)


# Sectors


def sector_code(name: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def panel_returns(bars: DataFrame) -> DataFrame:
    """symbol, bar_date, ret: the return since the panel's previous date; null where the symbol has no bar on it."""
    days = bars.select("bar_date").distinct()
    previous = days.withColumn("panel_before", F.lag("bar_date").over(Window.orderBy("bar_date")))
    own = Window.partitionBy("symbol").orderBy("bar_date")
    df = bars.select("symbol", "bar_date", "close", F.lag("bar_date").over(own).alias("own_before"), F.lag("close").over(own).alias("pc"))
    joined = df.join(F.broadcast(previous), "bar_date")  # one row for each trading day
    return joined.select("symbol", "bar_date", F.when(F.col("own_before") == F.col("panel_before"), F.col("close") / F.col("pc") - 1).alias("ret"))


def sector_returns(returns: DataFrame, sectors: DataFrame, least: int = 3) -> DataFrame:
    """sector, bar_date, ret, members: the mean over members with a return; null below `least` members."""
    joined = returns.join(sectors.filter("sector is not null"), "symbol").groupBy("sector", "bar_date").agg(F.avg("ret").alias("r"), F.count("ret").alias("members"))
    return joined.select("sector", "bar_date", F.when(F.col("members") >= least, F.col("r")).alias("ret"), "members")


def chained(returns: DataFrame, key: str = "sector", base: float = 100.0) -> DataFrame:
    """returns with level: base times the product of 1 + ret; a null return is flat."""
    w = Window.partitionBy(key).orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("level", base * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))


def breadth(bars: DataFrame, members: DataFrame, day: str, n: int = 200) -> DataFrame:
    """One row: members with n bars before the day, those above their mean, share and label."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_date")))
    recent = bars.filter(F.col("bar_date") < F.lit(day).cast("date")).join(members, "symbol", "left_semi").withColumn("k", k).filter(F.col("k") <= n)
    per = recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("avg"), F.max_by("close", "bar_date").alias("close")).filter(F.col("n") == n)
    out = per.agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("close") > F.col("avg")).alias("above"))
    pct = F.try_divide(100.0 * F.col("above"), F.col("eligible"))
    return out.select("eligible", "above", pct.alias("pct_above"), F.when(pct >= 70, "strong").when(pct >= 50, "healthy").when(pct >= 30, "weak").otherwise("poor").alias("label"))


# Calendar and drawdowns of one series: month_close has year, month, close


def month_closes(series: DataFrame) -> DataFrame:
    return series.groupBy(F.year("bar_date").alias("year"), F.month("bar_date").alias("month")).agg(F.max_by("close", "bar_date").alias("close"))


def seasonality(months: DataFrame, year: int, month: int, least: int = 3) -> DataFrame:
    """month, n, avg, median, best, worst, positives, first_year, last_year of past returns, without the current month."""
    r = F.col("close") / F.lag("close").over(Window.orderBy("year", "month")) - 1
    rets = months.withColumn("ret", r).filter(F.col("ret").isNotNull() & ~((F.col("year") == year) & (F.col("month") == month)))
    return rets.groupBy("month").agg(F.count("ret").alias("n"), F.avg("ret").alias("avg"), F.percentile("ret", F.lit(0.5)).alias("median"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.count_if(F.col("ret") > 0).alias("positives"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).filter(F.col("n") >= least)


def halloween(months: DataFrame) -> DataFrame:
    """season, n, avg, positive_rate: winters (October to April) against summers (April to October)."""
    a = months.filter("month = 4").select("year", F.col("close").alias("april"))
    o = months.filter("month = 10").select("year", F.col("close").alias("october"))
    winter = a.join(o.withColumn("year", F.col("year") + 1), "year").select(F.lit("winter").alias("season"), (F.col("april") / F.col("october") - 1).alias("ret"))
    summer = a.join(o, "year").select(F.lit("summer").alias("season"), (F.col("october") / F.col("april") - 1).alias("ret"))
    return winter.union(summer).groupBy("season").agg(F.count("ret").alias("n"), F.avg("ret").alias("avg"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_rate")).filter("n >= 3")


def january_barometer(months: DataFrame) -> DataFrame:
    """n, hits, rate: complete years whose sign is January's."""
    at = lambda m, name, shift=0: months.filter(F.col("month") == m).select((F.col("year") + shift).alias("year"), F.col("close").alias(name))
    years = at(12, "before", 1).join(at(1, "jan"), "year").join(at(12, "dec"), "year")
    hit = F.sign(F.col("jan") - F.col("before")) == F.sign(F.col("dec") - F.col("before"))
    return years.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("rate"))


def drawdowns(series: DataFrame) -> DataFrame:
    """series with peak, peak_date (the first day of the peak) and drawdown."""
    w = by_series().rowsBetween(Window.unboundedPreceding, 0)
    df = series.withColumn("peak", F.max("close").over(w))
    first = F.max_by("bar_date", F.struct("close", -F.unix_date("bar_date"))).over(w)
    return df.withColumns({"peak_date": first, "drawdown": F.col("close") / F.col("peak") - 1})


def corrections(drawn: DataFrame, t: float = 0.10) -> DataFrame:
    """series, start_date, end_date, depth of each spell below -t that ends when half of t is regained.

    A row enters (drawdown <= -t) or leaves (>= -t/2); the state of a row is the last of these marks.
    """
    mark = F.when(F.col("drawdown") <= -t, 1).when(F.col("drawdown") >= -t / 2, 0)
    w = by_series().rowsBetween(Window.unboundedPreceding, 0)
    df = drawn.withColumn("state", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)))
    start = (F.col("state") == 1) & (F.coalesce(F.lag("state").over(by_series()), F.lit(0)) == 0)
    df = df.withColumn("episode", F.sum(start.cast("int")).over(w)).filter("state = 1")
    return df.groupBy("series", "episode").agg(F.min("bar_date").alias("start_date"), F.max(F.when(F.col("drawdown") <= -t, F.col("bar_date"))).alias("end_date"), F.min("drawdown").alias("depth")).drop("episode")


def turn_of_month(day: Column) -> Column:
    """Is the day the last weekday of the month before its window, or one of the month's first four weekdays."""
    month = F.trunc(day, "month")
    weekdays = lambda a, b: F.size(F.filter(F.sequence(a, b), lambda x: F.weekday(x) < 5))
    end = F.last_day(day)
    last = F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))
    return (F.weekday(day) < 5) & ((weekdays(month, day) <= 4) | (day == last))


#: What the years of a presidential term are called, by (year - 2025) mod 4.
TERM = ("post_election", "midterm", "pre_election", "election")


def presidential(year: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in TERM]), (F.pmod(year - 2025, F.lit(4)) + 1).cast("int"))
