"""Tables that are kept up to date by what has changed: merges by partition, a ledger of changes, a continuous aggregate.

A table is a parquet folder with a partition for each year of its day. A merge compares what came with the years
that it touches, and rewrites (Spark's dynamic partition overwrite) only those in which a row differs. The pairs
of symbol and week whose bars have changed go to a ledger folder, a batch for each merge; weekly bars are made anew
for these pairs only. A batch leaves the ledger after the aggregate has it, so whatever is interrupted can be run again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.sources import shared


@dataclass(frozen=True)
class Table:
    """A folder of rows with unique `keys`, in partitions by the year of the date column `day`."""

    path: str
    keys: tuple[str, ...]
    day: str

    def exists(self, spark: SparkSession) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("year")

    def years(self, spark: SparkSession, years: list[int]) -> DataFrame:
        """The rows of some years: no other partition is read."""
        return spark.read.parquet(self.path).filter(F.col("year").isin(years)).drop("year")

    def _write(self, rows: DataFrame, label: str | None) -> None:
        # Staged first: a partition can't be read while it is replaced. Without a label, rows don't read the table.
        dated = rows.withColumn("year", F.year(self.day))
        staged = shared.written(dated, label) if label else dated
        dealt = staged.repartition("year", *[k for k in self.keys if k != self.day])
        dealt.sortWithinPartitions(*self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(self.path)


def _years(rows: DataFrame, day: str) -> list[int]:
    return sorted(r[0] for r in rows.select(F.year(day)).filter(F.col(day).isNotNull()).distinct().collect())


def merge(table: Table, new: DataFrame) -> DataFrame:
    """Upserts new into the table and returns the keys of the rows that are new or differ, as a written table.

    Rows without a key or day are left out. Of several new rows with one key, the greatest in all columns counts. A
    merge of what is there already rewrites nothing and returns no rows.
    """
    spark = new.sparkSession
    keys = list(table.keys)
    came = shared.written(store.upsert(new.limit(0), new.dropna(subset=keys), keys), "came")
    years = _years(came, table.day)
    if not table.exists(spark):  # all rows are new: nothing to compare or to keep
        if years:
            table._write(came, None)
        return came.select(*keys)
    there = table.years(spark, years)
    there = there.select(*came.columns)
    values = [c for c in came.columns if c not in keys]
    old = there.select(*keys, F.struct(*[F.col(c) for c in values]).alias("__old"))
    differs = F.col("__old").isNull() | ~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__old.{c}")) for c in values], F.lit(True))
    changed = shared.written(came.join(old, keys, "left").filter(differs).select(*came.columns), "changed")
    touched = _years(changed, table.day)
    if touched:
        kept = there.filter(F.year(table.day).isin(touched)).join(changed.select(*keys), keys, "left_anti")
        table._write(kept.unionByName(changed), "merged")
    return changed.select(*keys)


def week_of(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.date_trunc("week", day).cast("date")


def log_changes(ledger: str, changed: DataFrame, batch: int) -> None:
    """Notes the weeks of changed bars (symbol, bar_date) as a batch of the ledger; a batch that is there is replaced."""
    weeks = changed.select("symbol", week_of(F.col("bar_date")).alias("week")).distinct()
    weeks.write.mode("overwrite").parquet(f"{ledger}/batch={batch:09d}")


def weekly(bars: DataFrame) -> DataFrame:
    """symbol, week (its Monday), open, high, low, close, adj_close, volume."""
    first, last = F.min_by, F.max_by
    return bars.groupBy("symbol", week_of(F.col("bar_date")).alias("week")).agg(
        first("open", "bar_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close", "bar_date").alias("close"), last("adj_close", "bar_date").alias("adj_close"), F.sum("volume").alias("volume")
    )


def refresh_weekly(bars: Table, weeks: Table, ledger: str, spark: SparkSession) -> DataFrame:
    """Brings weekly bars up to the ledger and empties it; returns the keys of the weeks that differ."""
    root = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    batches = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=")]
    noted = spark.read.schema("symbol string, week date, batch int").parquet(ledger)
    pairs = shared.written(noted.select("symbol", "week").distinct(), "weeks")
    # A week may lie in two years.
    years = sorted({y for r in pairs.select(F.year("week"), F.year(F.date_add("week", 6))).distinct().collect() for y in r})
    own = bars.years(spark, years).withColumn("week", week_of(F.col("bar_date"))).join(pairs, ["symbol", "week"], "left_semi").drop("week")
    changed = merge(weeks, weekly(own))
    for batch in batches:
        fs.delete(batch, True)
    return changed


def backfill_from(have: DataFrame, start: str, overlap: int = 5) -> DataFrame:
    """symbol, fetch_from: where a symbol's history (symbol, bar_date) is to be fetched from: `overlap` days before its last bar, `start` at the earliest."""
    last = have.groupBy("symbol").agg(F.max("bar_date").alias("last"))
    return last.select("symbol", F.greatest(F.lit(start).cast("date"), F.date_sub("last", overlap)).alias("fetch_from"))


def backfill(table: Table, provider: DataFrame, start: str, overlap: int = 5) -> DataFrame:
    """Merges what the provider (bars of all symbols) has from each symbol's last bar less `overlap` days on; symbols without
    bars come from `start` on. Returns the changed keys."""
    spark = provider.sparkSession
    since = F.lit(start).cast("date")
    if not table.exists(spark):
        return merge(table, provider.filter(F.col("bar_date") >= since))
    known = backfill_from(table.read(spark).select("symbol", "bar_date"), start, overlap)
    return merge(table, provider.join(known, "symbol", "left").filter(F.col("bar_date") >= F.coalesce("fetch_from", since)).drop("fetch_from"))
