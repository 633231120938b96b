"""Packing into length buckets of least padding.

Dynamic programming over the global histogram of lengths places the borders; within a bucket, documents
form batches that fill a budget of padded tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Ranges of ends that one numpy step of the dynamic programming splits; no result depends on it.
STEP = 8192


def word_tokens(text: Column) -> Column:
    """Words and punctuation marks of a text, counted without splitting it: null and empty texts have 0."""
    plain = F.coalesce(text, F.lit(""))
    return (F.regexp_count(plain, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))).cast("long")


def best_borders(lengths: Sequence[int] | np.ndarray, counts: Sequence[int] | np.ndarray, buckets: int) -> list[int]:
    """The upper lengths of at most `buckets` buckets with least padding in all; ties: fewer buckets.

    Divide and conquer over the columns of the cost matrix: the best split point never moves left as the
    end moves right. O(buckets * n * log n) for n distinct lengths; all ranges of a level are split at once.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.float64)
    c = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    t = np.concatenate([[0.0], np.cumsum(size * np.asarray(counts, np.float64))])

    def cost(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Padding of one bucket with the lengths starts..ends-1."""
        return size[ends - 1] * (c[ends] - c[starts]) - (t[ends] - t[starts])

    every = np.arange(1, n + 1)
    best = np.concatenate([[0.0], cost(np.zeros(n, np.int64), every)])
    choices, totals = [np.zeros(n + 1, np.int32)], [best[n]]
    for _ in range(1, min(buckets, n)):
        now, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int32)
        now[0] = 0.0
        work = [np.array([[1], [n], [0], [n]])]
        while work:
            lo, hi, a, b = work.pop()
            mid = (lo + hi) // 2
            widths = np.minimum(mid - 1, b) - a + 1
            heads = np.cumsum(widths) - widths
            starts = np.arange(int(widths.sum())) + np.repeat(a - heads, widths)
            both = best[starts] + cost(starts, np.repeat(mid, widths))
            least = np.minimum.reduceat(both, heads)
            hit = np.flatnonzero(both == np.repeat(least, widths))
            at = starts[hit[np.searchsorted(hit, heads)]]
            now[mid], choice[mid] = least, at
            below = np.concatenate([np.array([lo, mid - 1, a, at]), np.array([mid + 1, hi, at, b])], axis=1)
            below = below[:, below[0] <= below[1]]
            work += [below[:, i : i + STEP] for i in range(0, below.shape[1], STEP)]
        best = now
        choices.append(choice)
        totals.append(best[n])
    k, end, out = int(np.argmin(totals)), n, []
    while end > 0:
        out.append(int(lengths[end - 1]))
        end = int(choices[k][end]) if k > 0 else 0
        k -= 1
    return out[::-1]


def pack(df: DataFrame, length: str, key: str, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """df with bucket (int, from 0), bucket_length (padded length), batch (long, from 0 in its bucket), place (in the batch).

    A batch has as many documents as fill the budget of padded tokens, one at least, so a document longer
    than the budget is a batch of its own; no document is cut or dropped. Null and negative lengths count
    as 0. Equal lengths share a bucket. The borders are those of least padding over all distinct lengths,
    which the driver holds: d of them take some d * d / 2 tokens at least, so a trillion tokens have at
    most 1.5 million. An empty table returns no rows. Columns of df with the names of new ones are
    replaced. Rows that agree in key and length are interchangeable.
    """
    new = ["bucket", "bucket_length", "batch", "place"]
    df = df.drop(*new)
    size, row = common.fresh(df, "__len"), common.fresh(df, "__row")
    df = df.withColumn(size, F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)))
    df = common.materialize(df, "lengths")
    histogram = df.groupBy(F.col(size).alias("l")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("l")
    borders = best_borders(histogram.column("l").to_numpy(), histogram.column("n").to_numpy(), buckets)
    if not borders:
        borders = [0]
    in_bucket = F.lit(0)
    for upper in borders[:-1]:
        in_bucket = in_bucket + (F.col(size) > upper).cast("int")
    placed = df.withColumn("bucket", in_bucket).withColumn("bucket_length", F.element_at(F.lit(borders).cast("array<long>"), F.col("bucket") + 1))
    # Parts by key and length: equal rows differ in nothing that matters.
    rows = common.numbered(placed, ["bucket"], F.struct(F.col(key), F.col(size)), row)
    fits = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1)).cast("long")
    return rows.withColumn("batch", F.floor(F.col(row) / fits).cast("long")).withColumn("place", (F.col(row) % fits).cast("long")).drop(row, size)
