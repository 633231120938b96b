"""Byte-level BPE encoding and decoding by rank files.

A minimal perfect hash resolves pre-tokens that are whole entries of the vocabulary; other pre-tokens are
merged with a heap over linked bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from tidemark.llm import common

#: A worker keeps the ids of so many pre-tokens, then starts anew.
CACHE = 400_000
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys fill the slots 0 to n - 1.

    Keys are dealt into buckets; from the largest bucket on, each gets the first displacement that sends
    its keys to free slots. Buckets of one key name their slot directly (negative numbers).
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // 3)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        free = np.ones(self.n, bool)
        singles = []
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                singles.append((bucket, members[0][1]))
                continue
            d = 0
            while True:
                d += 1
                slots = {self._slot(h, d) for h, _ in members}
                if len(slots) == len(members) and all(free[s] for s in slots):
                    break
            self.shift[bucket] = d
            for h, key in members:
                free[s := self._slot(h, d)] = False
                self.keys[s] = key
        for (bucket, key), s in zip(singles, np.flatnonzero(free).tolist()):
            self.shift[bucket] = -s - 1
            self.keys[s] = key

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 7) ^ (d * 0x9E3779B97F4A7C15)) & _MASK
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
        return (x >> 20) % self.n

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 for a string that is none of the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return s if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of least rank, leftmost first, merges until none is left.

    A heap entry holds rank, start and end of a pair in one integer; end[i] links a token to the next one.
    """
    n, rank = len(piece), ranks.get
    if n < 2:
        return [ranks[piece]] if n else []
    bits = n.bit_length()
    low, twice = (1 << bits) - 1, 2 * bits
    end, before = list(range(1, n + 2)), list(range(-1, n))
    heap = [(r << twice) | (i << bits) | (i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        k = top & low
        i = (top >> bits) & low
        j = end[i]
        if j <= i or j >= k or end[j] != k:
            continue  # one side has merged meanwhile
        end[i] = k
        end[j] = 0
        if k < n:
            before[k] = i
            z = end[k]
            if (r := rank(piece[i:z])) is not None:
                heappush(heap, (r << twice) | (i << bits) | z)
        p = before[i]
        if p >= 0 and (r := rank(piece[p:k])) is not None:
            heappush(heap, (r << twice) | (p << bits) | k)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes texts and decodes ids by one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.by_id = np.full(max(self.ranks.values(), default=-1) + 1, None, object)
        self.by_id[list(self.ranks.values())] = list(self.ranks)
        self.whole = PerfectHash(list(self.ranks))
        self.rank_of = [self.ranks[k] for k in self.whole.keys]
        self.split = regex.compile(pattern).findall
        self.known = _Known(self)

    def ids(self, pre_token: str) -> tuple[int, ...]:
        raw = pre_token.encode("utf-8", "replace")
        slot = self.whole.slot(raw)
        return (self.rank_of[slot],) if slot >= 0 else tuple(merge(raw, self.ranks))

    def encode(self, text: str) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.age()
        return list(chain.from_iterable(map(known.__getitem__, self.split(text))))

    def unknown(self, flat: np.ndarray) -> np.ndarray:
        """Which ids have no token."""
        held = np.append(np.array([t is not None for t in self.by_id], bool), False)
        return ~held[np.where((flat < 0) | (flat >= len(self.by_id)), len(self.by_id), flat)]

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        tokens = self.by_id[flat].tolist()
        return [b"".join(tokens[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class _Known(dict):
    """Ids of the pre-tokens seen lately: what was not asked for during a whole generation is forgotten."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, pre_token: str) -> tuple[int, ...]:
        ids = self.old.get(pre_token) or self.codec.ids(pre_token)
        if len(pre_token) <= 64:
            self[pre_token] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df without its text column, with the column `out`: the text's ids, array<int>.

    Ids follow the rank file at `path`, each match of `pattern` by itself, without special tokens. Null
    and empty texts get an empty array. Every row stays, in any number of copies; no shuffle.
    """
    common.tune(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, out)]
    own = common.fresh(df, "__text")
    src = df.select(*kept, F.col(text).alias(own))
    schema = src.drop(own).schema.add(out, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for batch in batches:
            flat, ends = [], [0]
            for t in common.texts_of(batch, own):
                flat += of.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], names=[*kept, out])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column `out`: the bytes of its ids, binary; null where ids are null or one of them is null or unknown."""
    columns = [c for c in df.columns if c != out]
    schema = df.select(*columns).schema.add(out, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for batch in batches:
            lists = batch.column(ids)
            sizes = np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)])
            flat, ends = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False), np.cumsum(sizes)
            bad = of.unknown(flat)
            wrong = np.diff(np.concatenate([[0], np.cumsum(bad)])[ends]) > 0
            some = min(of.ranks.values(), default=0)
            raw = of.decode(np.where(bad, some, flat) if bad.any() else flat, ends)
            rows = pa.array(raw, pa.binary(), mask=lists.is_null().to_numpy(zero_copy_only=False) | wrong)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), rows], names=[*columns, out])

    return df.select(*columns).mapInArrow(run, schema)
