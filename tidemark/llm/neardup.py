"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Documents of equal words are one node, whatever their number: equal are those whose words have one
   128-bit hash (XXH3 over the characters, word for word).
2. Document frequencies of all shingles are counted over all documents. A shingle weighs
   ln(1 + documents / frequency), times how often the text has it. Copies of a text raise the frequencies of all that
   they share, so that a few edited words would outweigh it, the more the larger the group: the rarer quarter of a text's
   shingles weighs as the shingle at that quarter does (texts of similarity 0.8 share more than three quarters). Frequencies are moved as sorted pieces of
   shingles, not as a row for each, and kept as sorted arrays (see arrays.py), which the tasks map; a node's shingles carry theirs. Without `full_idf`, a shingle weighs
   ln(1 + RARE) at most: only shingles in more than 1/RARE of the documents then need their frequency; they are
   at most RARE times the mean number of shingles of a document, which no growth of the corpus raises, and go
   to every task.
3. Each node gets BANDS x ROWS consistent weighted samples; nodes that agree in a band are candidates.
4. In each band bucket, members are compared with one leader, the one that shares most buckets with
   others; linked nodes form components. A group of n copies so costs about n comparisons.
5. Where members of a bucket then fall into several components, all members outside the bucket's largest
   component meet all members, block by block: a task gets the shingles of two blocks, of bounded size and
   rows, multiplies them as matrices in tiles and returns links between components, as a forest. So no link
   between components of a bucket is lost, and the cost is members times members outside.
6. A comparison is the exact weighted Jaccard similarity of two documents' shingles.

Hot keys (a bucket, a leader, a component, a group of copies) are dealt over several tasks: see
common.spread_join and PER_COPY.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays, common, grams

SIMILAR = 0.8
#: A pair of similarity 0.8 agrees in some band with probability 1 - (1 - 0.8^3)^10 = 0.999.
BANDS, ROWS = 10, 3
#: Without the full idf, shingles in more than 1/RARE of the documents are frequent; rarer ones all weigh ln(1 + RARE), in smaller corpora ln(1 + documents).
RARE = 512
#: A task of the frequency counts reads so many documents or so many bytes, whichever gives more tasks.
LEAST_DOCUMENTS, LEAST_BYTES = 2048, 16 << 20
#: Documents after which such a task forgets the shingles that can't be frequent.
STRETCH = 8192
#: Shingles that a task of the full frequencies counts together, and those of a piece that it hands on at most: 1,024 pieces, some 50 MB, are a batch.
TOGETHER, PIECE = 4_000_000, 4096
#: Comparisons that one copy of a leader's shingles serves, about.
PER_COPY = 1000
#: Shingles and rows of a block of step 5 at most, about; rows and columns of its matrices.
BLOCK, BLOCK_ROWS, TILE, COLUMNS = 300_000, 1024, 1024, 2048
_BITS = np.uint64(12)  # a shingle's hash has 64 - 12 bits; the others hold the text's place in its chunk
_HASH = 52


class Shingles:
    """The distinct shingles of each text of a chunk: text, hash (52 bits), times; sorted by text and hash."""

    def __init__(self, texts: list[str]):
        t = grams.Texts([x.lower() for x in texts])
        starts, ends = t.words()
        text, words = t.text_of(starts), t.hashes(starts, ends)
        n_words = np.bincount(text, minlength=t.n)
        h, first = grams.windows(words, text)
        owner = text[first]
        #: 16 bytes, equal for texts of equal words; None for texts without words.
        self.key = _keys(t, starts, ends, n_words)
        # Texts of one to four words have one shingle: all of them.
        short = np.flatnonzero((n_words < grams.SHINGLE) & (n_words > 0))
        whole = np.frombuffer(b"".join(self.key[i][:8] for i in short), np.uint64)
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
        packed, self.times = np.unique((owner.astype(np.uint64) << (np.uint64(64) - _BITS)) | (h >> _BITS), return_counts=True)
        self.text = (packed >> (np.uint64(64) - _BITS)).astype(np.int64)
        self.hash = (packed & ((np.uint64(1) << (np.uint64(64) - _BITS)) - np.uint64(1))).astype(np.int64)
        self.n = t.n


def _keys(t: grams.Texts, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray) -> list[bytes | None]:
    codes, inside = t.codes.copy(), np.zeros(len(t.codes) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    kept = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    codes[ends], kept[ends] = 32, True  # each word ends with a blank
    cut = np.concatenate([[0], np.cumsum(kept)])[np.append(t.starts, len(codes))]
    raw = memoryview(codes[kept].tobytes())
    return [xxhash.xxh3_128_digest(raw[4 * a : 4 * b]) if n else None for a, b, n in zip(cut[:-1].tolist(), cut[1:].tolist(), n_words.tolist())]


class Weights:
    """TF-IDF weights: ln(documents / frequency), where rare shingles count as in 1/RARE of the documents."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray, rest: float):
        self.hashes, self.rest = hashes, rest
        self.by_code = np.append(rest, idf)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each shingle among the frequent ones, from 1; 0 of others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)

    def idf(self, codes: np.ndarray) -> np.ndarray:
        return self.by_code[codes]

    def own(self, codes: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        """What one occurrence of each shingle weighs."""
        return self.idf(codes)

    def of(self, hashes: np.ndarray, times: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        return self.own(self.codes(hashes), text) * times


class FullWeights:
    """TF-IDF weights: ln(1 + documents / frequency), of the rarer quarter of a text's shingles by the frequency at that quarter; the
    documents of each shingle that more than one has are looked up."""

    def __init__(self, frequencies: arrays.Arrays, documents: int):
        self.frequencies, self.documents = frequencies, documents

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """In how many documents each shingle is."""
        there, found = self.frequencies.find(hashes << np.int64(64 - _HASH))
        return np.where(there, found["n"], 1).astype(np.int32)

    def idf(self, codes: np.ndarray) -> np.ndarray:
        return np.log1p(self.documents / codes)

    def own(self, codes: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        """What one occurrence of each shingle weighs in its text; text: sorted numbers, or none for the shingles of one text."""
        starts = [0] if text is None else np.flatnonzero(np.diff(text, prepend=-1))
        floored = codes.copy()
        for a, b in zip(starts, [*starts[1:], len(codes)]):
            at = (b - a) // 4
            if at:
                np.maximum(codes[a:b], np.partition(codes[a:b], at)[at], out=floored[a:b])
        return self.idf(floored)

    def of(self, hashes: np.ndarray, times: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        return self.own(self.codes(hashes), text) * times


def _all_frequencies(bits: int):
    """The shingles of some TOGETHER and in how many documents each is, as sorted pieces of one shard (see arrays.py): keys of 8
    bytes, counts of 4. documents: how many of these documents have words, in the first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]) << np.int64(64 - _HASH), return_counts=True)
            parts.clear()
            shards, counts = keys >> np.int64(64 - bits), counts.astype(np.int32)
            starts = np.union1d(np.arange(0, len(keys), PIECE), np.flatnonzero(np.diff(shards)) + 1).astype(np.int64)
            ends = np.append(starts[1:], len(keys))
            for at in range(0, len(starts), common.BATCH_ROWS):
                cut = list(zip(starts[at : at + common.BATCH_ROWS].tolist(), ends[at : at + common.BATCH_ROWS].tolist()))
                columns = {
                    "shard": pa.array(shards[starts[at : at + common.BATCH_ROWS]], pa.int64()),
                    "keys": pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()),
                    "counts": pa.array([counts[a:b].tobytes() for a, b in cut], pa.binary()),
                    "documents": pa.array([0 if at or k else n for k in range(len(cut))], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for _, texts in grams.chunks(common.texts_of(batch)):
                s = Shingles(texts)
                parts.append(s.hash)
                n += sum(k is not None for k in s.key)
                if sum(map(len, parts)) >= TOGETHER:
                    yield from flush()
                    n = 0
        if parts:
            yield from flush()

    return run


def _summed(found: arrays.Arrays):
    """Writes the shingles of more than one document; pieces come sorted by shard, and a task holds those of one shard. Returns sums of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, held, documents = arrays.Writer(found), None, [], 0

        def flush():
            keys, counts = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
            n = np.add.reduceat(counts.astype(np.int64), first)
            keys, n = keys[first][n > 1], n[n > 1]
            out.add({"shard": np.full(len(keys), now), "key": keys, "n": n})

        for batch in batches:
            documents += sum(batch.column("documents").to_pylist())
            for shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "counts"))):
                if held and shard != now:
                    flush()
                now = shard
                held.append((np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int32)))
        if held:
            flush()
        out.end()
        yield pa.RecordBatch.from_pydict({"n": pa.array([documents], pa.int64())})

    return run


def weights_of(documents: DataFrame) -> FullWeights:
    """IDF weights over all documents by the frequencies of all shingles: a shuffle of each task's distinct shingles, as sorted pieces."""
    spark = documents.sparkSession
    found = arrays.Arrays(arrays.mounted(spark, "frequencies"), arrays.sharded(spark), (("n", "i8"),))
    pieces = _few_tasks(documents.select("text")).mapInArrow(_all_frequencies(found.bits), "shard long, keys binary, counts binary, documents long")
    dealt = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard")
    total = dealt.mapInArrow(_summed(found), "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    return FullWeights(found, total)


def _few_tasks(texts: DataFrame) -> DataFrame:
    """texts in tasks of LEAST_DOCUMENTS or LEAST_BYTES, not more of them than there were."""
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return texts.coalesce(max(1, size.n // LEAST_DOCUMENTS, size.bytes // LEAST_BYTES))


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """65,536 draws of Gamma(2, 1), and their logarithms, in mixed order."""
    rng = np.random.default_rng(2010)
    r = -np.log1p(-rng.random(1 << 16)) - np.log1p(-rng.random(1 << 16))
    return r.astype(np.float32), np.log(r).astype(np.float32)


def bands(s: Shingles, weights: np.ndarray) -> np.ndarray:
    """BANDS hashes for each text of s; texts without shingles get zeros."""
    out = np.zeros((s.n, BANDS), np.uint64)
    if not len(s.hash):
        return out.view(np.int64)
    r_of, log_of = _draws()
    present, first = np.unique(s.text, return_index=True)
    sizes = np.diff(np.append(first, len(s.text)))
    log_w = np.log(weights).astype(np.float32)
    base = s.hash.astype(np.uint64)
    low = np.uint64(0xFFFF)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            x = grams.mixed(base + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
            r = r_of[x & low]
            beta = ((x >> np.uint64(32)) & low).astype(np.float32) / np.float32(65536)
            t = np.floor(log_w / r + beta)
            log_a = log_of[(x >> np.uint64(16)) & low] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(log_a, first)
            hit = np.flatnonzero(log_a == np.repeat(least, sizes))
            _, at = np.unique(s.text[hit], return_index=True)
            pick = hit[at]
            sample = grams.mixed(base[pick] * grams.BASE + t[pick].astype(np.int64).astype(np.uint64))
            band = k // ROWS
            out[present, band] = out[present, band] * grams.STEP + sample
    return grams.mixed(out).view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets of hashes."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(wa[i], wb[j]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def _local_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task's documents the shingles that may be in 1/(2 RARE) of them, and the number of documents (hash -1).

    Lossy counting: after every STRETCH documents, what can't have come once in each such stretch goes, so a
    shingle that stays has lost at most one count a stretch. At the end goes what, with that loss, is not in
    more than 1/(2 RARE) of the documents: so no shingle loses more than that share by any task.
    """
    held, counts, slack = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts, n, stretch = [], 0, 0

    def settled():
        h, c = np.unique(np.concatenate([held, *parts]), return_counts=True)
        old = np.searchsorted(h, held)
        c[old] += counts - 1
        d = np.full(len(h), stretch)
        d[old] = slack
        return h, c, d

    for batch in batches:
        for _, texts in grams.chunks(common.texts_of(batch)):
            s = Shingles(texts)
            parts.append(s.hash)
            n += sum(k is not None for k in s.key)
            if n // STRETCH > stretch:
                h, c, d = settled()
                keep = c + d > n // STRETCH
                held, counts, slack = h[keep], c[keep], d[keep]
                parts, stretch = [], n // STRETCH
    h, c, d = settled()
    keep = (c + d) * (2 * RARE) > n
    yield pa.RecordBatch.from_pydict({"hash": pa.array(np.append(h[keep], -1)), "n": pa.array(np.append(c[keep], n))})


def _exact_frequencies(candidates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = candidates.value
        counts = np.zeros(len(wanted) + 1, np.int64)
        for batch in batches:
            for _, texts in grams.chunks(common.texts_of(batch)):
                h = Shingles(texts).hash
                if len(wanted):
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    counts += np.bincount(at[wanted[at] == h], minlength=len(counts))
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"hash": pa.array(wanted[hit]), "n": pa.array(counts[hit])})

    return run


def limited_weights_of(documents: DataFrame) -> Weights:
    """IDF weights over all documents, at most ln(1 + RARE).

    A shingle in 1/RARE of all documents loses at most 1/(2 RARE) of all by what tasks prune; so a first
    pass finds all that may be frequent, at most 2 RARE times the mean number of shingles of a document,
    and a second one counts those exactly.
    """
    spark = documents.sparkSession
    texts = _few_tasks(documents.select("text"))
    found = common.materialize(texts.mapInArrow(_local_frequencies, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "frequencies")
    total = (found.filter("hash = -1").first() or {"n": 0})["n"] or 0
    rest = float(np.log1p(min(RARE, max(total, 1))))
    if total < 2:
        return Weights(np.zeros(0, np.int64), np.zeros(0), rest)
    likely = found.filter(F.col("hash") != -1).filter(F.col("n") >= max(2.0, total / (2 * RARE)))
    sent = spark.sparkContext.broadcast(np.sort(likely.select("hash").toArrow().column("hash").to_numpy()))
    exact = texts.mapInArrow(_exact_frequencies(sent), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") > total / RARE).toArrow().sort_by("hash")
    return Weights(exact.column("hash").to_numpy(), np.log1p(total / exact.column("n").to_numpy()), rest)


def _signed(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts_of(batch)
            keys, rows = [], []
            for _, part in grams.chunks(texts):
                s = Shingles(part)
                keys += s.key
                rows.append(bands(s, weights.value.of(s.hash, s.times, s.text)))
            flat = np.concatenate(rows).ravel()
            signature = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pick"), pa.array(keys, pa.binary()), signature], names=["doc_id", "pick", "key", "bands"])

    return run


VECTOR = "node long, hashes binary, times binary, codes binary"


def _vectors(weights):
    """node, hashes (8 bytes each), times and what their weights are found by (4 bytes each): one document of each node comes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, hashes, times, codes = batch.column("node").to_pylist(), [], [], []
            for _, part in grams.chunks(common.texts_of(batch)):
                s = Shingles(part)
                own = weights.value.codes(s.hash)
                cut = np.searchsorted(s.text, np.arange(len(part) + 1))
                for a, b in zip(cut[:-1], cut[1:]):
                    hashes.append(s.hash[a:b].tobytes())
                    times.append(s.times[a:b].astype(np.int32).tobytes())
                    codes.append(own[a:b].tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "hashes": pa.array(hashes, pa.binary()), "times": pa.array(times, pa.binary()), "codes": pa.array(codes, pa.binary())})

    return run


def _verified(weights, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = lambda r, s: (np.frombuffer(r[f"{s}_hashes"], np.int64), weights.value.own(np.frombuffer(r[f"{s}_codes"], np.int32)) * np.frombuffer(r[f"{s}_times"], np.int32))
        for batch in batches:
            left, right = [], []
            known: tuple = (None, None, None)
            for r in batch.to_pylist():
                if known[0] != r["a"]:
                    known = (r["a"], *side(r, "a"))
                if similarity(*known[1:], *side(r, "b")) >= similar:
                    left.append(r["a"]), right.append(r["b"])
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) of every node that links name, by least-label spreading.

    Each round takes the least label of a node and its neighbours, then jumps to that label's own label;
    all of it distributed, each round written to the shared folder.
    """
    edges = common.materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).filter("u <> v").distinct(), "edges")
    hubs = common.hot_keys(edges, ["v"])
    labels = common.materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component")), "labels")
    while True:
        seen = common.spread_join(edges, labels.withColumnsRenamed({"node": "v"}), ["v"], hot=hubs).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        near = common.materialize(labels.join(seen, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component")), "labels")
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        after = common.materialize(common.spread_join(near, jump, ["component"], "left").select("node", "before", F.least("component", "beyond").alias("component")), "labels")
        labels = after.select("node", "component")
        if not after.filter("before <> component").limit(1).count():
            return labels


def _pick(doc_id: Column, text: Column) -> Column:
    """Equal for rows that agree in id and text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _classed(documents: DataFrame, similar: float, full_idf: bool = True) -> DataFrame:
    """doc_id, pick, component, class_id, class_size, n_links for each row; component is null for texts without words."""
    spark = documents.sparkSession
    common.tune(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _pick(F.col("doc_id"), F.col("text")).alias("pick"), "text")
    weights = spark.sparkContext.broadcast(weights_of(docs) if full_idf else limited_weights_of(docs))
    signed = common.materialize(docs.mapInArrow(_signed(weights), "doc_id long, pick string, key binary, bands array<long>"), "signatures")
    keyed = signed.filter("key is not null")
    nodes = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("pick").alias("pick"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    # Written once, so a node keeps its number.
    nodes = common.materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    alike = common.materialize(members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = common.materialize(common.spread_join(members, alike, ["band", "value"], hot=_large(alike, members)), "shared")
    large = _large(alike, shared)
    central = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = shared.join(central, "node").groupBy("band", "value").agg(F.max_by("node", F.struct("weight", "node")).alias("lead"), F.first("n").alias("n"))
    leaders = common.materialize(leaders, "leaders")
    copies = leaders.groupBy("lead").agg(F.ceil(F.sum("n") / PER_COPY).cast("int").alias("copies"))
    texts = common.spread_join(docs.select("pick", "text"), nodes.join(central, "node").select("node", "pick"), ["pick"], hot=common.hot_keys(keyed, ["pick"]))
    vectors = common.materialize(texts.select("node", "text").mapInArrow(_vectors(weights), VECTOR).dropDuplicates(["node"]), "vectors")
    led = leaders.join(copies, "lead").select("band", "value", "lead", "copies")
    share = F.pmod(F.xxhash64("node"), "copies").cast("int")
    pairs = common.spread_join(shared, led, ["band", "value"], hot=large).filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"), share.alias("share")).distinct()
    links = common.materialize(_links(pairs, copies, vectors, weights, similar), "links")
    joined = components(links)
    more = common.materialize(_block_links(shared, joined, vectors, weights, similar, large), "links")
    if more.limit(1).count():
        joined = _merged(joined, more)
    both = links.union(more)
    degrees = both.union(both.select("b", "a")).distinct().groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    own = nodes.select("node", "key", "doc_id", "n").join(joined, "node", "left").join(degrees, "node", "left")
    own = common.materialize(own.withColumns({"component": F.coalesce("component", "node"), "n_links": F.coalesce("n_links", F.lit(0))}), "members")
    sizes = own.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = common.materialize(common.spread_join(own.select("key", "component", "n_links"), sizes, ["component"]), "classes")
    found = common.spread_join(keyed.select("doc_id", "pick", "key"), named, ["key"]).select("doc_id", "pick", "component", "class_id", "class_size", "n_links")
    one, none = (F.lit(x).cast("long") for x in (1, 0))
    blank = signed.filter("key is null").select("doc_id", "pick", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id"), one.alias("class_size"), none.alias("n_links"))
    return found.unionByName(blank)


def _large(buckets: DataFrame, rows: DataFrame) -> list[tuple]:
    """The hot keys of rows, from the sizes of their buckets."""
    most = max(common.HOT, rows.count() // common.SHARES)
    return [(r.band, r.value, -(-r.n // most)) for r in buckets.filter(F.col("n") > most).collect()]


def classes(documents: DataFrame, similar: float = SIMILAR, full_idf: bool = True) -> DataFrame:
    """doc_id, class_id, class_size, n_links for each row of documents (doc_id long, text).

    class_id is the least doc_id of the class, class_size its number of rows; n_links says with how many different
    texts the row's text has been compared and found similar: to them its class is proven (copies aren't counted,
    nor pairs that no comparison was needed for). Without full_idf, a shingle's idf is ln(1 + RARE) at most. Documents are in one class
    if a chain of links joins them: equal words, or weighted Jaccard similarity of their five-word shingles
    of `similar` or more among candidates of step 3. Words are split by white space, in lower case,
    without the signs around them (a word of signs only stays). Texts of one to four words have one
    shingle; null and blank texts are classes of their own. Rows with a null or repeated doc_id take part
    like all others; a null doc_id stays null, and a class of such rows only has class_id null.
    Repeated rows are copies. An empty table returns no rows. A doc_id that is no number fails.
    """
    return _classed(documents, similar, full_idf).select("doc_id", "class_id", "class_size", "n_links")


def keep(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of documents for each class, with the columns of documents as they are.

    The row of least doc_id stays (null ids last), of those the one whose text has the least MD5; of rows
    that agree in both, any one. Null and blank texts all stay: each is a class of its own.
    """
    rows = common.materialize(_classed(documents, similar), "rows")
    texts = rows.filter("component is not null").groupBy("component", "pick").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    first = texts.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "pick", "n")).alias("x")).select("x.pick", "x.n", "component")
    blank = rows.filter("component is null").select("pick").distinct().select("pick", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("component"))
    pick, n, component = (common.fresh(documents, c) for c in ("__pick", "__n", "__component"))
    chosen = common.materialize(first.unionByName(blank).withColumnsRenamed({"pick": pick, "n": n, "component": component}), "chosen")
    marked = documents.withColumn(pick, _pick(F.col("doc_id"), F.col("text")))
    found = common.spread_join(marked, chosen, [pick], hot=common.hot_keys(rows, ["pick"]))
    once = found.filter(F.col(n) == 1)
    if chosen.filter(F.col(n) > 1).limit(1).count():
        once = once.unionByName(found.filter(F.col(n) > 1).dropDuplicates([component]))
    return once.select(*documents.columns)


def _links(pairs: DataFrame, copies: DataFrame, vectors: DataFrame, weights, similar: float) -> DataFrame:
    """The pairs a, b, share that are similar enough: each share of a leader's pairs has a copy of its shingles."""
    side = lambda s: vectors.select(F.col("node").alias(s), F.col("hashes").alias(f"{s}_hashes"), F.col("times").alias(f"{s}_times"), F.col("codes").alias(f"{s}_codes"))
    shares = copies.select(F.col("lead").alias("a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("share"))
    return pairs.join(side("b"), "b").join(shares.join(side("a"), "a"), ["a", "share"]).drop("share").mapInArrow(_verified(weights, similar), "a long, b long")


def _block_links(shared: DataFrame, joined: DataFrame, vectors: DataFrame, weights, similar: float, large: list[tuple] | None = None) -> DataFrame:
    """a, b: links between components of the buckets that hold several, all of them but for cycles."""
    # Keys and sizes are dealt into blocks first; the shingles join them last.
    sizes = vectors.select("node", (F.octet_length("hashes") / 8).alias("size"))
    placed = shared.select("band", "value", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sizes, "node")
    placed = common.materialize(placed, "placed")
    parts = placed.groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    per = parts.groupBy("band", "value").agg(F.max(F.struct("n", "component", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    blocks = lambda size, n: F.ceil(F.greatest(size / BLOCK, n / BLOCK_ROWS, F.lit(1))).cast("int")
    per = per.select("band", "value", F.col("main.component").alias("main"), blocks(F.col("size") - F.col("main.size"), F.col("n") - F.col("main.n")).alias("outer"), blocks(F.col("main.size"), F.col("main.n")).alias("inner"))
    rest = common.spread_join(placed, per, ["band", "value"], hot=large)
    # Blocks 0 to outer - 1 hold the members outside the largest component, the next ones its own.
    outside = F.col("component") != F.col("main")
    code = F.xxhash64("node", "band")
    rest = rest.withColumn("block", F.when(outside, F.pmod(code, "outer")).otherwise(F.col("outer") + F.pmod(code, "inner")).cast("int"))
    # Each block outside meets every block, itself included; those of the largest component don't meet each other.
    last = F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    meets = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = common.materialize(rest.withColumn("pair", F.explode(meets)).select("band", "value", "pair.i", "pair.j", "block", "node", "component"), "dealt")
    return dealt.join(vectors, "node").groupBy("band", "value", "i", "j").applyInArrow(_compared(weights, similar), "a long, b long").distinct()


def _expanded(table: pa.Table, weights: Weights | FullWeights) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(row, token, value) of all shingles, one for each time that a text has them, and the rows' shingles and weights.

    The products of two rows' roots of values add up to what the rows share, or to more where a shingle weighs differently in them.
    """
    rows, tokens, values, texts = [], [], [], []
    codes = table.column("codes").to_pylist() if "codes" in table.column_names else [None] * len(table)
    for k, (h, t, c) in enumerate(zip(table.column("hashes").to_pylist(), table.column("times").to_pylist(), codes)):
        h, t = np.frombuffer(h, np.int64), np.frombuffer(t, np.int32)
        c = weights.codes(h) if c is None else np.frombuffer(c, np.int32)
        own = weights.own(c)
        texts.append((h, own * t))
        w = np.where(t > 1, weights.idf(c), own)
        while len(h):
            tokens.append(h), values.append(w), rows.append(np.full(len(h), k))
            more = t > 1
            # The n-th time of a shingle is a token of its own, so that products of zeros and ones count the lesser number.
            h, w, t = h[more] + (1 << 53), w[more], t[more] - 1
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return join(rows, np.int64), join(tokens, np.int64), join(values, np.float64), texts


def _compared(weights, similar: float):
    def run(group: pa.Table) -> pa.Table:
        # Rows of block i meet those of block j; where i = j, each tile meets the rows from its own on.
        group = group.sort_by("block")
        nodes, labels, block = (np.asarray(group.column(c)).copy() for c in ("node", "component", "block"))
        n, first = len(nodes), int(np.searchsorted(block, block[0], "right"))
        within = group.column("i")[0] == group.column("j")[0]
        rows, tokens, values, texts = _expanded(group, weights.value)
        totals = np.array([w.sum() for _, w in texts])
        _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
        common_ = times[column] > 1  # what only one text has adds nothing to a product
        rows, values = rows[common_], values[common_]
        _, column = np.unique(column[common_], return_inverse=True)
        order = np.argsort(column, kind="stable")
        rows, values, column = rows[order], np.sqrt(values[order]), column[order]

        def dense(a: int, b: int, start: int, low: int, high: int) -> np.ndarray:
            """The entries a..b-1 of rows low..high-1 as a matrix, columns from start."""
            part = np.zeros((high - low, COLUMNS))
            at = np.flatnonzero((rows[a:b] >= low) & (rows[a:b] < high)) + a
            part[rows[at] - low, column[at] - start] = values[at]
            return part

        out = []
        for top in range(0, n if within else first, TILE):
            end = min(top + TILE, n if within else first)
            low = top if within else first
            shared = np.zeros((end - top, n - low))
            for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                a, b = np.searchsorted(column, [start, start + COLUMNS])
                shared += dense(a, b, start, top, end) @ dense(a, b, start, low, n).T
            alike = shared >= (similar - 1e-12) * (totals[top:end, None] + totals[None, low:] - shared)
            for r in np.flatnonzero((alike & (labels[top:end, None] != labels[None, low:])).any(axis=1)):
                near = np.flatnonzero(alike[r]) + low
                for i in near[labels[near] != labels[top + r]]:
                    if labels[i] != labels[top + r] and similarity(*texts[top + r], *texts[i]) >= similar:
                        out.append((int(nodes[top + r]), int(nodes[i])))
                        labels[labels == labels[i]] = labels[top + r]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the links between components are components of their own."""
    of = lambda s: links_.join(joined.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")), s, "left").withColumn(f"c{s}", F.coalesce(f"c{s}", s))
    links_ = links
    links_ = of("a")
    links_ = of("b")
    over = components(links_.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("top"))
    new = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(joined, "node", "left_anti").select("node", F.col("node").alias("component"))
    return common.materialize(joined.select("node", "component").union(new).join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
