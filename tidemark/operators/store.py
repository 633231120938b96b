"""Table operations: upserts by natural key, as-of and interval joins, latest values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of equal key. Of several new rows with one key the greatest in all columns wins."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    order = [F.desc("__v"), *[F.desc_nulls_last(c) for c in old.columns if c not in keys]]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return both.withColumn("__r", first).filter("__r = 1").select(*old.columns)


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join by key; new values replace old ones where they are not null."""
    columns = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(fresh, keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def without_orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """children whose parent exists."""
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def adjusted(bars: DataFrame) -> DataFrame:
    """bars with split-adjusted prices and volume, and the raw ones as *_raw.

    factor = adj_close / close if close > 0 and both are there, else 1; the close becomes adj_close where that is there.
    """
    raw = bars.select("*", *[F.col(c).alias(f"{c}_raw") for c in ("open", "high", "low", "close", "volume")])
    f = F.when((F.col("close") > 0) & F.col("adj_close").isNotNull(), F.col("adj_close") / F.col("close")).otherwise(F.lit(1.0))
    return (
        raw.withColumn("__f", f)
        .withColumns({c: F.col(c) * F.col("__f") for c in ("open", "high", "low")})
        .withColumns({"close": F.coalesce("adj_close", "close_raw"), "volume": F.try_divide(F.col("volume"), F.col("__f"))})
        .drop("__f")
    )


def latest(df: DataFrame, keys: list[str], order: Column | str, columns: list[str]) -> DataFrame:
    """The row of greatest order of each key: a plain aggregate, no sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order)).alias("l")).select(*keys, *[F.col(f"l.{c}") for c in columns])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """left with the values of right's last row at or before `on` (forward: its first row at or after it).

    Union and one window: one shuffle by key, linear in the rows. right has at most one row for each key
    and `on`; a tie counts unless strict.
    """
    own = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    other = right.select(*keys, on, F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    both = own.unionByName(other, allowMissingColumns=True)
    tie = F.col("__side") if not strict else -F.col("__side")
    order = [F.desc(on), tie] if forward else [F.asc(on), tie]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return seen.select(*left.columns, *[F.col(f"__seen.{v}").alias(v) for v in values])


def in_interval(facts: DataFrame, intervals: DataFrame, keys: list[str], on: str, start: str, end: str) -> DataFrame:
    """Rows of facts for which some interval [start, end) of their key holds `on`; a null end is open. Each row once."""
    spans = intervals.select(*keys, start, end)
    held = (F.col(start) <= F.col(on)) & (F.col(end).isNull() | (F.col(end) > F.col(on)))
    matches = reduce(lambda a, b: a & b, [facts[k] == spans[k] for k in keys])
    return facts.join(spans, matches & held, "left_semi")


def fits(value: Column, precision: int, scale: int) -> Column:
    """value rounded to scale, or null where it is not finite or needs more than precision digits."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 10.0 ** (precision - scale))
    return F.when(ok, F.round(value, scale))


def number(text: Column) -> Column:
    """A number from text; '', 'NA', 'None', 'NaN' and other text give null, '0' stays 0."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x), x)


def ordinal(value: Column, order: list[str]) -> Column:
    """Place of value in order, from 1; 0 for others."""
    return F.array_position(F.array(*[F.lit(o) for o in order]), value)


def _parts(df: DataFrame, key: str, ascending: bool, parts: int) -> Column:
    """The range, from 0, of each row's key: cut at keys of least hash, some thousand of which the driver holds. Null: -1 or the last."""
    share = min(1.0, 8 * parts / max(df.count(), 1))
    sample = df.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 31)) <= int(share * (1 << 31)))).select(key).distinct().limit(16 * parts).collect()
    keys = sorted(r[0] for r in sample)
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    below = sum(((F.col(key) >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    return F.coalesce(below if ascending else -below, F.lit(len(cuts) + 1))


def numbered(df: DataFrame, order: list[str], name: str, ascending: bool = True, parts: int = 32) -> DataFrame:
    """df with a number from 1 in the order of its columns `order` (the first ascending or descending, the others
    ascending; nulls of the first last), without one task for all rows: ranges are numbered by themselves and shifted
    by the sizes of those before."""
    part = _parts(df, order[0], ascending, parts)
    first = F.asc_nulls_last(order[0]) if ascending else F.desc_nulls_last(order[0])
    dealt = df.withColumn("__part", part)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sizes = dealt.groupBy(F.col("__part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(first, *order[1:])
    return dealt.join(F.broadcast(shift), "__part").withColumn(name, F.row_number().over(inside) + F.col("__before")).drop("__part", "__before")


def percent_ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with 100 times the percent rank of its column `key` (not null): the share of other rows with a lesser value."""
    counted = numbered(df.groupBy(key).agg(F.count(F.lit(1)).alias("__c")), [key], "__k")
    # Rows with a lesser value: a running sum over the distinct values, again by ranges.
    total = df.count()
    part = F.floor((F.col("__k") - 1) / 4096)
    within = Window.partitionBy("__p").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    ranged = counted.withColumn("__p", part)
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__p").agg(F.sum("__c").alias("__s")).withColumn("__b", F.coalesce(F.sum("__s").over(ahead), F.lit(0))).drop("__s")
    rank = ranged.join(sums, "__p").withColumn("__r", F.coalesce(F.sum("__c").over(within), F.lit(0)) + F.col("__b"))
    return df.join(rank.select(key, "__r"), key).withColumn(name, 100 * F.col("__r") / F.lit(float(max(total - 1, 1)))).drop("__r")
