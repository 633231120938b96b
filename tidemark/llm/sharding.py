"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """A shard's score for a key: -weight / ln(u), where u in (0, 1) comes from 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return F.lit(-float(weight)) / F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52)))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of greatest score; ties go to the smaller number. A shard of weight 0 gets nothing."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    # greatest() compares structs field by field: the score, then the smaller shard.
    best = [F.struct(score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in live]
    return (-(F.greatest(*best) if len(best) > 1 else best[0]).getField("i")).cast("int")


def assign(df: DataFrame, key: str, weights: list[float] | int = 8) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 within the shard).

    Key and weights alone decide the shard: with one more shard a key stays or goes to the new one. A
    null key counts as the empty string. Repeated rows get slots of their own. An empty table returns
    no rows. Slots follow a hash of the key, then all columns; rows that agree in all columns are
    interchangeable.
    """
    weights = [1.0] * weights if isinstance(weights, int) else [float(w) for w in weights]
    if any(not math.isfinite(w) or w < 0 for w in weights):
        raise ValueError("weights are finite and not negative")
    sharded = common.materialize(df.withColumn("shard", shard_of(F.col(key), weights)), "shards")
    return common.numbered(sharded, ["shard"], F.struct(*[F.col(c) for c in [key, *[c for c in df.columns if c != key]]]), "slot")
