"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows of an Arrow batch; with texts of up to some 100 KB a batch stays within tens of MB.
BATCH_ROWS = 1024
#: A key is hot with more than 1/SHARES of all rows, and more than HOT of them.
SHARES, HOT = 2048, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that Python workers hold few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one where the session names none, with a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete_on_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors lose nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def row_numbers() -> Iterator[int]:
    """Numbers that differ between all rows of a job and come out alike when a task runs again."""
    n = TaskContext.get().partitionId() << 33
    while True:
        yield n
        n += 1


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no column of that name, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_keys(df: DataFrame, keys: list[str]) -> list[tuple]:
    """(*key, shares) of the hot keys, fewer than SHARES of them: a share holds as many rows as a key that is not hot may."""
    most = max(HOT, df.count() // SHARES)
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return [(*[r[k] for k in keys], -(-r["n"] // most)) for r in found.collect() if all(r[k] is not None for k in keys)]


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """big joined to small by keys, where no task gets all of big's rows of a hot key.

    Rows of hot keys are dealt over the key's shares, and small's rows of that key are copied once for
    each share; only the names of the hot keys, fewer than SHARES, are broadcast. `hot` may name them, else
    big is read twice, so pass a written table or a cheap one. Null keys of big match nothing, as in any join.
    """
    hot = hot_keys(big, keys) if hot is None else hot
    if not hot:
        return big.join(small, keys, how)
    shares, share = fresh(big, "__shares"), fresh(big, "__share")
    types = {f.name: f.dataType for f in big.select(*keys).schema}
    schema = StructType([StructField(k, types[k]) for k in keys] + [StructField(shares, LongType())])
    names = F.broadcast(big.sparkSession.createDataFrame(hot, schema))
    one = F.coalesce(shares, F.lit(1))
    dealt = big.join(names, keys, "left").withColumn(share, F.pmod(F.monotonically_increasing_id(), one)).drop(shares)
    copies = small.join(names, keys, "left").withColumn(share, F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop(shares)
    return dealt.join(copies, [*keys, share], how).drop(share)


def numbered(df: DataFrame, keys: list[str], by: Column, name: str, parts: int = 1024) -> DataFrame:
    """Adds a gapless number from 0 within keys, without a task that holds all rows of a key.

    The rows of a key are spread over `parts` hash parts by `by`; each part is numbered on its own (ties
    by nothing else: equal rows are interchangeable) and shifted by the sizes of the parts before it. The
    table of sizes has at most keys x parts rows. df is read twice, so pass a written table.
    """
    sub, at, before = fresh(df, "__part"), fresh(df, "__at"), fresh(df, "__before")
    tagged = df.withColumn(sub, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    sizes = tagged.groupBy(*keys, sub).agg(F.count(F.lit(1)).alias(before))
    ahead = Window.partitionBy(*keys).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, sub, F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(*keys, sub).orderBy(by)
    return (
        tagged.withColumn(at, F.row_number().over(inside) - 1)
        .join(offsets, [*keys, sub])
        .withColumn(name, (F.col(at) + F.col(before)).cast("long"))
        .drop(sub, at, before)
    )
