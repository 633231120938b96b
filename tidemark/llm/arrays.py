"""Sorted arrays of 64-bit keys in the shared folder, written by Spark tasks and memory-mapped by Python workers.

A key's high bits name its shard. Each shard is written by one task, in key order, as one plain file for the
keys and one for each value; readers map the files and search them, so what a worker holds is what the pages
that it touches hold, whatever the size of the arrays.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: The primes and the seed of the 64-bit hash that Spark's xxhash64 is.
P1, P2, P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
P4, P5, SEED = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5), np.uint64(42)
#: Shards for each partition of a shuffle: many, so that partitions get like numbers of them.
SHARDS_A_PARTITION = 8


def hashed(*columns: np.ndarray) -> np.ndarray:
    """What F.xxhash64 gives for long columns without nulls, as int64."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]), SEED)
        for c in columns:
            h = h + P5 + np.uint64(8)
            h ^= turn(c.astype(np.int64).view(np.uint64) * P2, 31) * P1
            h = turn(h, 27) * P1 + P4
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def mounted(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, as a path of the file system: memory maps need the shared folder to be mounted."""
    base = common.shared_dir(spark)
    if re.match(r"(?!file:)\w[\w+.-]+:", base):
        raise ValueError(f"arrays are memory-mapped, so spark.checkpoint.dir must be a mounted folder (file:), not {base}")
    path = re.sub(r"^file:/*", "/", base) + f"/tidemark/{label}-{uuid.uuid4().hex}"
    os.makedirs(path)
    common.delete_on_exit(spark, f"file://{path}")
    return path


def sharded(spark: SparkSession) -> int:
    """How many bits name a shard."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) * SHARDS_A_PARTITION - 1, 1).bit_length()


def shard(key: Column, bits: int) -> Column:
    return F.shiftright(key, 64 - bits).cast("int")


def dealt(rows: DataFrame, key: Column, bits: int) -> DataFrame:
    """rows with the shard of their key, all of a shard in one partition; later groups by shard and more need no exchange.

    The shard is made again behind the exchange, so it isn't moved.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, shard(key, bits)).withColumn("shard", shard(key, bits))


@dataclass(frozen=True)
class Arrays:
    """Where sorted arrays are: `types` has the name and type of each value."""

    path: str
    bits: int
    types: tuple[tuple[str, str], ...]

    def writer(self):
        """A function over batches sorted by (shard, key) that writes them and returns nothing."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(self)
            for batch in batches:
                out.add({n: batch.column(n).to_numpy() for n in ("shard", "key", *dict(self.types))})
            out.end()
            yield from ()

        return run

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which keys are there, and their values (0 where they aren't)."""
        there, values = np.zeros(len(keys), bool), {n: np.zeros(len(keys), t) for n, t in self.types}
        order = np.argsort(keys)
        asked = keys[order]
        at = asked >> np.int64(64 - self.bits)
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)] if len(at) else []
        for a, b in zip(cuts, cuts[1:]):
            own = _mapped(self, int(at[a]))
            if own is None:
                continue
            place = np.searchsorted(own["key"], asked[a:b])
            hit = own["key"][np.minimum(place, len(own["key"]) - 1)] == asked[a:b]
            rows = order[a:b][hit]
            there[rows] = True
            for n, out in values.items():
                out[rows] = own[n][place[hit]]
        return there, values


class Writer:
    """Writes rows that come sorted by (shard, key). A task that runs again writes the same files again; each comes to its name when it is whole."""

    def __init__(self, arrays: Arrays):
        self.arrays, self.now, self.files, self.mark = arrays, None, {}, uuid.uuid4().hex

    def add(self, columns: dict[str, np.ndarray]) -> None:
        shards, types = columns["shard"], dict(self.arrays.types)
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)] if len(shards) else []
        for a, b in zip(cuts, cuts[1:]):
            if int(shards[a]) != self.now:
                self.end()
                self.now = int(shards[a])
                self.files = {n: open(f"{self.arrays.path}/{self.now}.{n}.{self.mark}", "wb") for n in ("key", *types)}
            for name, f in self.files.items():
                f.write(np.ascontiguousarray(columns[name][a:b], dtype=types.get(name, "i8")).tobytes())

    def end(self) -> None:
        for name, f in self.files.items():
            f.close()
            os.replace(f.name, f"{self.arrays.path}/{self.now}.{name}")
        self.files = {}


@lru_cache(maxsize=4096)
def _mapped(arrays: Arrays, number: int) -> dict[str, np.ndarray] | None:
    path = f"{arrays.path}/{number}"
    if not os.path.exists(f"{path}.key"):
        return None
    return {n: np.memmap(f"{path}.{n}", dtype=t, mode="r") for n, t in (("key", "i8"), *arrays.types)}


def written(rows: DataFrame, label: str, types: tuple[tuple[str, str], ...] = ()) -> Arrays:
    """rows (key long, unique, and the values that `types` names) as sorted arrays."""
    spark = rows.sparkSession
    arrays = Arrays(mounted(spark, label), sharded(spark), types)
    columns = ["shard", "key", *dict(types)]
    keyed = dealt(rows.select("key", *dict(types)), F.col("key"), arrays.bits).select(*columns).sortWithinPartitions("shard", "key")
    keyed.mapInArrow(arrays.writer(), keyed.schema).write.format("noop").mode("overwrite").save()
    return arrays
