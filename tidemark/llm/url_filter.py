"""URL rules as nested intervals over reversed-host keys, matched by one sorted sweep.

A rule is a host and a path prefix; it fits its host, all subdomains, and paths that start with its own.
With the labels of hosts reversed, "this host and all subdomains" is one interval of keys, and intervals
nest or are disjoint. Rule starts and URL keys, one for each URL, are dealt into ranges, sorted, and swept
with a stack of the hosts that are open; each holds its path prefixes as a sorted list with the next
shorter prefix of each, so a URL asks each open host once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: The ranges are cut at quantiles of so many sampled keys.
SAMPLE = 20_000
#: Stands between reversed host and path in a key.
CUT = "\x01"


def host_of(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, with A-Z in lower case; '' without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


class _Host:
    """An open host: its key, and its path prefixes in order, each with the longest other one that starts it."""

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.shorter, self.open = key, [], [], [], []

    def add(self, path: str, rule: str, action: str) -> None:
        """Paths come in order; of equal ones the first counts."""
        while self.open and not path.startswith(self.paths[self.open[-1]]):
            self.open.pop()
        if self.open and self.paths[self.open[-1]] == path:
            return
        self.shorter.append(self.open[-1] if self.open else -1)
        self.open.append(len(self.paths))
        self.paths.append(path), self.rules.append((rule, action))

    def longest(self, path: str) -> int:
        """The number of the longest prefix of path, or -1."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.shorter[at]
        return at


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, key, kind, path, action: rules (0) before URLs (1) of a key. Keeps the hosts that are open."""
    part, stack = None, []
    for batch in batches:
        ids, rules, actions = [], [], []
        for p, key, kind, path, row, rule, action in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind", "path", "row", "rule", "action"))):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not (stack and stack[-1].key == key):
                    stack.append(_Host(key))
                stack[-1].add(path, rule, action)
                continue
            best, size = None, (-1, -1)
            for host in stack:
                if (at := host.longest(path)) >= 0 and (found := (len(host.key) + len(host.paths[at]), len(host.key))) > size:
                    best, size = host.rules[at], found
            if best:
                ids.append(row), rules.append(best[0]), actions.append(best[1])
        yield pa.RecordBatch.from_pydict({"row": pa.array(ids, pa.string()), "rule": pa.array(rules, pa.string()), "action": pa.array(actions, pa.string())})


def _cuts(keys: DataFrame, parts: int) -> list[str]:
    """Sorted borders between the ranges, from the keys of least hash: the same for any partitioning."""
    total = keys.count()
    share = min(1.0, SAMPLE / max(total, 1))
    limit = int(share * (1 << 31))
    sample = sorted(r.key for r in keys.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 31)) <= limit).select("key").collect())
    return sorted(sample[len(sample) * i // parts] for i in range(1, parts)) if sample else []


def _dealt(cuts: list[str]):
    """Adds the part of each key. Equal borders mark a hot key, whose rows are spread over their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low_high = [_span(cuts, k, k) for k in batch.column("key").to_pylist()]
            parts = [a + (s % (b - a + 1)) for (a, b), s in zip(low_high, batch.column("salt").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column("key"), batch.column("path"), batch.column("row")], names=["part", "key", "path", "row"])

    return run


def _span(cuts: list[str], low: str, high: str) -> tuple[int, int]:
    """First and last part that may hold keys from low to high."""
    first = bisect_right(cuts, low)
    while first > 0 and cuts[first - 1] == low:
        first -= 1
    return first, bisect_right(cuts, high)


def _copied(cuts: list[str]):
    """A rule goes to every part that its interval touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, path, rule, action in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "rule", "action"))):
                first, last = _span(cuts, key, key + "\U0010ffff")
                out += [(p, key, path, rule, action) for p in range(first, last + 1)]
            columns = list(zip(*out)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["part", "key", "path", "rule", "action"])

    return run


def match(urls: DataFrame, rules: DataFrame, row: str, parts: int | None = None) -> DataFrame:
    """row, rule, action: the longest rule that fits each URL; rows without one don't return.

    urls has the key `row` (one for each URL) with host and path; rules has host, path, action. The
    longest rule is that of most characters in host and path together, ties to the longer host. Rules
    with null or empty host or null action take no part; a null path fits all. Of equal rules the smaller
    action wins. A URL is one key, however many labels its host has. A task holds the rules of the hosts
    that are open at one place.
    """
    spark = urls.sparkSession
    common.tune(spark)
    # Each label of a key ends with a dot, so a host's key starts those of its subdomains and no others.
    start = F.concat(reversed_host(F.col("host")), F.lit("."))
    asked = urls.filter("host <> ''").select(F.col(row).cast("string").alias("row"), F.concat(start, F.lit(CUT), F.col("path")).alias("key"), "path")
    asked = common.materialize(asked, "url-keys")
    wanted = (
        rules.filter("host <> '' and action is not null")
        .select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy(start.alias("key"), "path", F.concat("host", "path").alias("rule"))
        .agg(F.min("action").alias("action"))
    )
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = _cuts(asked, parts)
    keyed = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(1 << 20)).cast("int")).mapInArrow(_dealt(cuts), "part int, key string, path string, row string")
    placed = wanted.mapInArrow(_copied(cuts), "part int, key string, path string, rule string, action string")
    none = F.lit(None).cast("string")
    both = keyed.select("part", "key", F.lit(1).alias("kind"), "path", "row", none.alias("rule"), none.alias("action")).unionByName(placed.select("part", "key", F.lit(0).alias("kind"), "path", none.alias("row"), "rule", "action"))
    return both.repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "path", "action").mapInArrow(_sweep, "row string, rule string, action string")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for each row of pages: the longest fitting rule's action, else `default`.

    Null urls and urls without :// have the empty host and path, no rule, and the default verdict.
    Rows of equal host and path are judged once, so a hot url costs one key. Repeated rows and null keys stay.
    """
    seen = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    targets = seen.select("host", "path").distinct().withColumn("id", F.concat("host", F.lit("\x02"), "path"))
    found = match(targets, rules, "id")
    out = common.spread_join(seen.withColumn("id", F.concat("host", F.lit("\x02"), "path")), found.withColumnRenamed("row", "id"), ["id"], "left")
    return out.select(key, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
