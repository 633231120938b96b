"""The signal ledger: what each scan of a strategy and day has found, replaced run by run, and deleted with what follows from it.

A run is a partition (strategy, day) of a parquet folder: one row of the run itself, then its signals. A replay writes
whole partitions (Spark's dynamic partition overwrite), so it may be repeated; a day without signals still has its
run's row, so that older signals of that day go. Outcomes of signals lie in a folder of the same partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import shared

COLUMNS = ("symbol", "score", "entry", "stop", "qty", "status", "reason", "place")


@dataclass(frozen=True)
class Ledger:
    """signals: the folder of runs; outcomes: that of what came of their signals; version: that of the strategies' rules."""

    signals: str
    outcomes: str
    version: str = "1"

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.parquet(self.signals).filter(F.col("kind") == kind)


def run_id(strategy, day, version: str):
    """The same for each replay of a run."""
    return F.substring(F.sha2(F.concat_ws("|", strategy, day.cast("string"), F.lit(version)), 256), 1, 32)


def replay(ledger: Ledger, scanned: DataFrame, days: DataFrame, strategies: list[str]) -> None:
    """Writes the runs of some strategies on some days (day) from a scan of all dates (strategy, symbol, bar_date, ...).

    One pass over the scan, which is written once: runs are counted from what it found. A run's partition is replaced as a whole, other partitions are left alone.
    """
    runs = days.select("day").distinct().select(F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"), "day")
    asked = scanned.filter(F.col("strategy").isin(strategies)).withColumnRenamed("bar_date", "day").join(F.broadcast(days.select("day").distinct()), "day", "left_semi")  # some days
    found = shared.written(asked.select("strategy", "day", F.lit("signal").alias("kind"), *COLUMNS), "runs")
    counts = found.groupBy("strategy", "day").agg(F.count_if(F.col("status") == "new").alias("n_pass"), F.count_if(F.col("status") == "rejected").alias("n_reject"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    heads = runs.join(counts, ["strategy", "day"], "left").select("strategy", "day", F.lit("run").alias("kind"), zero("n_pass"), zero("n_reject"))
    rows = found.unionByName(heads, allowMissingColumns=True).withColumn("run_id", run_id(F.col("strategy"), F.col("day"), ledger.version))
    rows.repartition("strategy", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "day").parquet(ledger.signals)


def missing(ledger: Ledger, spark: SparkSession, days: DataFrame, strategies: list[str]) -> DataFrame:
    """strategy, day of the runs that the ledger doesn't have."""
    runs = days.select("day").distinct().select(F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"), "day")
    return runs.join(ledger.read(spark, "run").select("strategy", "day"), ["strategy", "day"], "left_anti")


def note_outcomes(ledger: Ledger, outcomes: DataFrame) -> None:
    """Writes what came of signals (strategy, day, symbol, ...), run by run."""
    shared.written(outcomes, "outcomes").repartition("strategy", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "day").parquet(ledger.outcomes)


def delete(ledger: Ledger, spark: SparkSession, strategy: str, first: date, last: date) -> int:
    """Removes the runs of a strategy from `first` to `last`, their outcomes first, and returns how many partitions went.

    Both bounds are needed: nothing removes a whole ledger.
    """
    if first is None or last is None or first > last:
        raise ValueError("a first day and a last one that isn't before it")
    gone = 0
    for folder in (ledger.outcomes, ledger.signals):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/strategy={strategy}")
        fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            continue
        for part in fs.listStatus(root):
            name = part.getPath().getName()
            if name.startswith("day=") and first <= date.fromisoformat(name[4:]) <= last:
                fs.delete(part.getPath(), True)
                gone += 1
    return gone


def freshness(ledger: Ledger, spark: SparkSession) -> DataFrame:
    """strategy, latest (day of its last run), n_runs."""
    return ledger.read(spark, "run").groupBy("strategy").agg(F.max("day").alias("latest"), F.count(F.lit(1)).alias("n_runs"))
