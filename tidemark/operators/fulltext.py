"""Full-text search over a positional index that is kept as a table.

The index has a row for each stem and document: the positions of the stem's words, as steps from one to the next.
Rows lie in a partition for each bucket of stems, sorted by stem, and a frequent stem's rows are dealt over several
files: a search reads the files of its own stems' buckets, and in them the row groups that may hold these stems.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from tidemark.operators.stems import STOP, stem
from tidemark.operators.text import tokens

#: Buckets of stems, and files that the rows of one stem may lie in.
BUCKETS, SPREAD = 64, 8
#: Fixed values of the rank: a word's weight, the reach of two words, and the sum of 1 / i^2.
WEIGHT, REACH, LIMIT = 0.1, 100, 1.64493406685
#: Words as operators.text.tokens finds them in a lower-case text, and the characters of texts whose words a task holds at once, but for a longer text.
WORD, TOGETHER = re.compile(r"[a-z0-9à-ÿ]+"), 500_000
#: Fixed values of a headline: fragments, and their words at most and at least.
FRAGMENTS, MOST, LEAST = 2, 15, 5


@F.pandas_udf(ArrayType(StructType().add("stem", StringType()).add("at", ArrayType(IntegerType()))))
def places(words: pd.Series, at: pd.Series) -> pd.Series:
    """The stems of a document's words, each with its places in order; each worker remembers the stems that it has found."""

    def of(ws, ps) -> list[dict]:
        found: dict[str, list[int]] = {}
        for w, p in zip(ws, ps):
            found.setdefault(stem(w), []).append(int(p))
        return [{"stem": s, "at": ps} for s, ps in found.items()]

    return pd.Series([of(ws, ps) for ws, ps in zip(words, at)])


@dataclass(frozen=True)
class Index:
    """A folder of postings: bucket, stem, the id columns, n_words, steps."""

    path: str
    ids: tuple[str, ...]

    def postings(self, spark: SparkSession, stems: list[str]) -> DataFrame:
        """The rows of some stems, with their positions from 1."""
        buckets = sorted({zlib.crc32(s.encode()) % BUCKETS for s in stems})
        rows = spark.read.parquet(self.path).filter(F.col("bucket").isin(buckets) & F.col("stem").isin(stems))
        # Steps add up to positions.
        at = F.aggregate("steps", F.array().cast("array<int>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + s)))
        return rows.select(*self.ids, "stem", "n_words", at.alias("positions"))


def _postings(schema: pa.Schema):
    """Rows of the schema (the id columns, n_words, stem, __at) from rows of the id columns and a lower-case text, some TOGETHER characters of texts at a time.

    Words without stop words: these count as places, too.
    """

    def made(batch: pa.RecordBatch, first: int, texts: list[str]) -> pa.RecordBatch:
        words = [WORD.findall(t) for t in texts]
        kept = [[(w, p) for p, w in enumerate(ws, 1) if w not in STOP] for ws in words]
        found = places.func(pd.Series([[w for w, _ in k] for k in kept]), pd.Series([[p for _, p in k] for k in kept]))
        each = [x for xs in found for x in xs]
        own = pa.array(np.repeat(np.arange(first, first + len(texts)), [len(xs) for xs in found]), pa.int64())
        n_words = np.repeat([len(ws) for ws in words], [len(xs) for xs in found])
        ends = np.cumsum([0, *[len(x["at"]) for x in each]])
        at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([p for x in each for p in x["at"]], pa.int32()))
        ids = [batch.column(c).take(own) for c in schema.names[:-3]]
        return pa.RecordBatch.from_arrays([*ids, pa.array(n_words, pa.int32()), pa.array([x["stem"] for x in each], pa.string()), at], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, size = 0, [], 0
            for i, t in enumerate(batch.column("__text")):
                t = t.as_py() or ""
                if texts and size + len(t) > TOGETHER:
                    yield made(batch, first, texts)
                    first, texts, size = i, [], 0
                texts.append(t)
                size += len(t)
            if texts:
                yield made(batch, first, texts)

    return run


def build(docs: DataFrame, ids: list[str], text: Column, path: str) -> Index:
    """Writes the index of docs, whose rows the columns `ids` tell apart. Rows of one id are one document; null texts have no words.

    Stems are made and a document's places of each are put together where the texts are read, a bounded piece of texts at a time; one
    shuffle deals them out by bucket and document, and one sort by stem is the order of the files. Only where ids are repeated, a window brings their rows together.
    """
    repeated = docs.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    lowered = docs.select(*ids, F.lower(text).alias("__text"))
    schema = StructType([lowered.schema[c] for c in ids]).add("n_words", IntegerType()).add("stem", StringType()).add("__at", ArrayType(IntegerType()))
    each = lowered.mapInArrow(_postings(to_arrow_schema(schema)), schema)
    bucket = (F.crc32(F.col("stem").cast("binary")) % BUCKETS).cast("int")
    own_file = F.pmod(F.xxhash64(*ids), F.lit(SPREAD)).alias("__file")
    rows = each.select(bucket.alias("bucket"), "stem", *ids, own_file, "n_words", "__at").repartition("bucket", "__file")
    if repeated:
        same = Window.partitionBy("bucket", "stem", *ids, "__file").orderBy("n_words")
        whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.select("*", F.row_number().over(same).alias("__k"), F.max("n_words").over(whole).alias("__n"), F.collect_list("__at").over(whole).alias("__all")).filter("__k = 1")
        rows = rows.withColumns({"__at": F.array_sort(F.flatten("__all")), "n_words": F.col("__n")})
    else:
        rows = rows.sortWithinPartitions("bucket", "stem", *ids)
    steps = F.transform("__at", lambda p, i: p - F.when(i > 0, F.get(F.col("__at"), i - 1)).otherwise(0))
    sorted_rows = rows.select("bucket", "stem", *ids, "n_words", steps.alias("steps"))
    sorted_rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return Index(path, tuple(ids))


def asked(query: str) -> list[str]:
    """The stems of a query's words, without stop words."""
    return sorted({stem(w) for w in WORD.findall(query.lower()) if w not in STOP})


def _near(a: np.ndarray, b: np.ndarray) -> float:
    """What is left of 1 after all pairs of places of two words; pairs farther apart than REACH weigh next to nothing."""
    low, high = np.searchsorted(b, a - REACH), np.searchsorted(b, a + REACH, "right")
    rest = 1.0
    for p, i, j in zip(a, low, high):
        far = np.abs(b[i:j] - p)
        far = far[far > 0]
        rest *= float(np.prod(1 - WEIGHT * np.sqrt(1 / (1.005 + 0.05 * np.exp(far / 1.5 - 2)))))
    return rest


def rank(positions: list[np.ndarray]) -> float:
    """A document's rank from the sorted positions of each asked stem: by closeness of the words, of one word by its occurrences."""
    if len(positions) == 1:
        return float(np.sum(WEIGHT / np.arange(1, len(positions[0]) + 1) ** 2.0)) / LIMIT
    rest = 1.0
    for i, a in enumerate(positions):
        for b in positions[:i]:
            rest *= _near(a, b)
    return 1 - rest


@F.pandas_udf(DoubleType())
def ranked(positions: pd.Series) -> pd.Series:
    return positions.map(lambda lists: rank([np.asarray(p["positions"], np.int64) for p in lists]))


def search(index: Index, spark: SparkSession, query: str) -> DataFrame:
    """The ids of the documents that hold all of the query's stems, with n_words and rank. A query of stop words finds nothing."""
    stems = asked(query)
    rows = index.postings(spark, stems or [""])
    found = rows.groupBy(*index.ids).agg(F.sort_array(F.collect_list(F.struct("stem", "positions"))).alias("__p"), F.max("n_words").alias("n_words"))
    return found.filter(F.size("__p") == max(len(stems), 1)).select(*index.ids, "n_words", ranked("__p").alias("rank"))


def fragments(words: list[str], stems: set[str]) -> str:
    """Up to two fragments of 5 to 15 words with most of the asked stems, the earliest of equal ones, found words in <b>."""
    hits = [i for i, w in enumerate(words) if w not in STOP and stem(w) in stems]
    spans: list[tuple[int, int]] = []
    for _ in range(FRAGMENTS):
        best = None
        for i in hits:
            if any(a <= i < b for a, b in spans):
                continue
            inside = [k for k in hits if i <= k < i + MOST]
            low = max([0, i - (MOST - (inside[-1] - i + 1)) // 2, *[b for _, b in spans if b <= i]])
            high = min([len(words), low + MOST, *[a for a, _ in spans if a > i]])
            found = len({stem(words[k]) for k in inside if k < high})
            if best is None or found > best[0]:
                best = (found, low, high)
        if best and (best[2] - best[1] >= min(LEAST, len(words))):
            spans.append(best[1:])
    marked = lambda i: f"<b>{words[i]}</b>" if i in hits else words[i]
    hits = set(hits)
    return " ... ".join(" ".join(marked(i) for i in range(a, b)) for a, b in sorted(spans))


def headlines(found: DataFrame, text: Column, query: str, name: str) -> DataFrame:
    """found with the fragments of its texts as the column `name`: only texts that were found are read."""
    stems = set(asked(query))
    made = F.pandas_udf(lambda words: words.map(lambda ws: fragments(list(ws), stems)), StringType())
    return found.withColumn(name, made(tokens(text)))
