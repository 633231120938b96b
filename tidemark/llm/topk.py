"""Exact top-k by inner product: global score histograms locate each query's kth score.

Every pass scores all candidates against all queries, block by block. A query keeps an interval that
holds its kth best score; a histogram over the interval, summed over all blocks, names the bin to look
into next. When the kth score is known, one more pass keeps the scores above it, and of the scores equal
to it as many of the smallest ids as are missing.

A pass moves each block of candidates once for each block of queries. Components that fit into 8 bits take
one byte, and each serves QUERIES products where it arrives, so the scoring outweighs the moving.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

BINS = 256
#: Rows of a block of candidates, and of queries; queries that are scored at once.
CANDIDATES, QUERIES, TILE = 2048, 8192, 1024
#: Tables of counts, one for a block of queries, that a task holds before it passes them on.
HELD = 8


def quantized(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """key, v array<long>: floor(scale * x) of each component; rows with null or non-finite parts are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fits = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(fits).select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(finite).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _packed(df: DataFrame, rows: int, block: str) -> DataFrame:
    """Blocks of about `rows` vectors of one length: dim, block, ids, values (long, little-endian).

    df's rows must come in the same order whenever a task runs again: a written table or a scan of files.
    """
    n = max(1, -(-df.count() // rows))

    def pack(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("id"))
        values = np.asarray(group.column("v").combine_chunks().flatten())
        low, high = (values.min(), values.max()) if len(values) else (0, 0)
        kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        return pa.table({"dim": group.column("dim")[:1], block: group.column(block)[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "kind": pa.array([kind]), "values": pa.array([values.astype(kind).tobytes()], pa.binary())})

    # Dealt by the number of the row, not its id: rows that repeat an id go to different blocks.
    dealt = df.select(F.size("v").alias("dim"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias(block), "id", "v")
    return dealt.groupBy("dim", block).applyInArrow(pack, f"dim int, {block} int, ids binary, kind string, values binary")


def _matrix(kind: str, raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where all sums are exact there, else in 64-bit integers."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    if top < 2**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _cells(batches: Iterator[pa.RecordBatch]):
    """By tiles of each pair of blocks: row, first query of the tile, query ids, state, candidate ids, scores, own (mask)."""
    for batch in batches:
        for r in batch.to_pylist():
            every, cids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
            state = np.array(r["state"], np.int64).reshape(-1, 3)  # query id and two numbers: as the query block is sorted
            q, c = _matrix(r["q_kind"], r["q_values"], r["dim"]), _matrix(r["c_kind"], r["c_values"], r["dim"])
            order = np.argsort(cids, kind="stable")
            for top in range(0, len(every), TILE):
                here = slice(top, top + TILE)
                qids, s = every[here], _scores(q[here], c)
                left, right = np.searchsorted(cids, qids, "left", sorter=order), np.searchsorted(cids, qids, "right", sorter=order)
                own = np.zeros(s.shape, bool)
                for i in np.flatnonzero(right > left):
                    own[i, order[left[i] : right[i]]] = True
                yield r, top, qids, state[here], cids, s, own


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple] = {}

    def flush():
        for qids, counts in held.values():
            i, b = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(qids[i]), "bin": pa.array(b.astype(np.int32)), "n": pa.array(counts[i, b].astype(np.int64))})
        held.clear()

    for r, top, qids, state, _, s, own in _cells(batches):
        low, span = state[:, 1], state[:, 2]
        at = s - low[:, None]
        bins = at // ((span - 1) // BINS + 1)[:, None]
        i, j = np.nonzero((at >= 0) & (at < span[:, None]) & ~own)
        if (key := (r["dim"], r["qb"], top)) not in held:
            if len(held) >= HELD * QUERIES // TILE:
                yield from flush()
            held[key] = (qids, np.zeros((len(qids), BINS), np.int32))
        held[key][1].__iadd__(np.bincount(i * BINS + bins[i, j], minlength=len(qids) * BINS).reshape(-1, BINS).astype(np.int32))
    yield from flush()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, qids, state, cids, s, own in _cells(batches):
        kth, ties = state[:, 1], state[:, 2]
        i, j = np.nonzero((s > kth[:, None]) & ~own)
        rows, columns = [i], [j]
        order = np.argsort(cids, kind="stable")
        equal = (s[:, order] == kth[:, None]) & ~own[:, order]
        first = equal & (np.cumsum(equal, axis=1) <= ties[:, None])
        i, j = np.nonzero(first)
        rows, columns = np.concatenate([*rows, i]), np.concatenate([*columns, order[j]])
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(qids[rows]), "vec_id": pa.array(cids[columns]), "score": pa.array(s[rows, columns])})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates by integer inner product.

    Both sides have id long, v array<long> (see quantized). A candidate with the query's own id takes no
    part; ties go to the smaller id; a query with fewer than k candidates returns all of them. Vectors
    meet only vectors of their own length. Query ids are taken once each: of several rows of one query id
    that whose vector has the least hash. candidates is a written table or a scan of files; repeated candidate rows return as often as they come. Empty sides return no rows. Scores beyond
    64 bits are outside the contract.
    """
    spark = queries.sparkSession
    common.tune(spark)
    # Written before it is dealt out: rows of a shuffle may come in another order when a task runs again.
    queries = common.materialize(queries.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v")), "asked")
    c = common.materialize(_packed(candidates, CANDIDATES, "cb"), "candidates").select("dim", "cb", F.col("ids").alias("c_ids"), F.col("kind").alias("c_kind"), F.col("values").alias("c_values"))
    q = common.materialize(_packed(queries, QUERIES, "qb"), "queries").select("dim", "qb", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("values").alias("q_values"))
    members = common.materialize(_members(q), "query-states")
    blocks = (q.agg(F.max("qb")).first()[0] or 0) + 1
    pairs = common.materialize(c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dim", "cb", "qb"), "pairs")

    def grid(state: DataFrame) -> DataFrame:
        """state: query_id, dim, qb, at, a, b. One row for each pair of blocks, dealt over all tasks."""
        packed = state.groupBy("dim", "qb").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "query_id", "a", "b"))), lambda s: F.array(s.query_id, s.a, s.b))).alias("state"))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        side = q.join(packed, ["dim", "qb"])
        return pairs.join(side, ["dim", "qb"]).join(c, ["dim", "cb"]).repartition(tasks, "qb", "cb")

    bound = candidates.select(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("s")).agg(F.max("s")).first()[0] or 0.0
    reach = F.ceil(F.sqrt(F.col("norm2") * F.lit(bound)) * 1.000001 + 1).cast("long")
    state = members.select("query_id", "dim", "qb", "at", (-reach).alias("low"), (2 * reach + 1).alias("span"), F.lit(k).cast("long").alias("left"), F.lit(False).alias("done"))
    while True:
        state = common.materialize(state, "states")
        if not state.filter("not done").limit(1).count():
            break
        counts = grid(state.withColumnsRenamed({"low": "a", "span": "b"})).mapInArrow(_histograms, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        placed = counts.withColumn("upto", F.sum("n").over(above)).join(state.select("query_id", "left"), "query_id")
        # The first bin from above with enough scores, or the lowest one where all together are too few.
        located = placed.groupBy("query_id").agg(
            F.max(F.when(F.col("upto") >= F.col("left"), F.struct("bin", "n", "upto"))).alias("hit"),
            F.min(F.struct("bin", "n", "upto")).alias("last"),
        )
        width = F.floor((F.col("span") - 1) / BINS) + 1
        over = F.col("done") | F.col("hit").isNull()
        state = state.join(located.select("query_id", F.coalesce("hit", "last").alias("hit")), "query_id", "left").select(
            "query_id",
            "dim",
            "qb",
            "at",
            F.when(over, F.col("low")).otherwise(F.col("low") + F.col("hit.bin") * width).alias("low"),
            F.when(over, F.col("span")).otherwise(width).cast("long").alias("span"),
            F.when(over, F.col("left")).otherwise(F.least("left", "hit.upto") - (F.col("hit.upto") - F.col("hit.n"))).alias("left"),
            (over | (width == 1)).alias("done"),
        )
    kept = grid(state.withColumnsRenamed({"low": "a", "left": "b"})).mapInArrow(_kept, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _members(q: DataFrame) -> DataFrame:
    """query_id, dim, qb, at (place in its block), norm2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["q_ids"], np.int64)
                v = _matrix(r["q_kind"], r["q_values"], r["dim"]).astype(np.float64)
                n = len(ids)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids), "dim": pa.array(np.full(n, r["dim"], np.int32)), "qb": pa.array(np.full(n, r["qb"], np.int32)), "at": pa.array(np.arange(n, dtype=np.int32)), "norm2": pa.array((v * v).sum(axis=1))})

    return q.mapInArrow(run, "query_id long, dim int, qb int, at int, norm2 double")
