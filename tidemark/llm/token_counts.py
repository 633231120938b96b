"""Token counts without token ids.

A byte-level BPE never merges across the borders of its pre-tokens, so a text has as many tokens as its
pre-tokens have pieces. Each distinct pre-token of the corpus is counted once; a document's count is the
sum over its pre-token frequencies.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The broadcast dictionary holds so many pre-tokens at most; those of more bytes than HOT_BYTES by their MD5.
HOT_PIECES, HOT_BYTES = 200_000, 64


@lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer

    return Splitter(Tokenizer.from_file(path), json.load(open(path, encoding="utf-8")))


def load(path: str):
    return _loaded(path)


class Splitter:
    """Splits texts into special tokens and pre-tokens, and counts the pieces of a pre-token."""

    def __init__(self, tokenizer, spec: dict):
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers without normalizer or prefix space are supported")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that strip or match single words are not supported")
        self.tokenizer = tokenizer
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        # Letters that both Unicode tables class alike; other texts go to the library's own pre-tokenizer.
        self.plain = regex.compile(r"[^\x00-ʯ‐-‧€]")

    def pre_tokens(self, text: str) -> tuple[int, list[str]]:
        """Count of special tokens, and the pre-tokens of all else."""
        if self.special is None or not self.special.search(text):
            return 0, self._split(text)
        parts = self.special.split(text)
        return len(parts) - 1, [p for part in parts for p in self._split(part)]

    def _split(self, text: str) -> list[str]:
        if not self.plain.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pre_tokens, add_special_tokens=False)]


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, found = load(path), Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"piece": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
            found.clear()
            return out

        for batch in batches:
            for text in common.texts_of(batch):
                found.update(splitter.pre_tokens(text)[1])
            if len(found) > 400_000:
                yield flush()
        yield flush()

    return run


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = load(path)
        for batch in batches:
            counts = splitter.pieces(batch.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=["piece", "n", "pieces"])

    return run


def _name(piece: str) -> str:
    """What the dictionary calls a pre-token; none that stands for itself is so short and starts with a null character."""
    raw = piece.encode()
    return piece if len(raw) <= HOT_BYTES else "\x00" + hashlib.md5(raw).hexdigest()


def _per_document(path: str, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known, number = load(path), hot.value, common.row_numbers()
        for batch in batches:
            rows, ids, sizes, sums, keys = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch)):
                row = next(number)
                total, tokens = splitter.pre_tokens(text)
                for piece, n in Counter(tokens).items():
                    # A character has 4 bytes at most.
                    if (k := known.get(piece if len(piece) <= HOT_BYTES // 4 else _name(piece))) is not None:
                        total += n * k
                    else:
                        rows.append(row), ids.append(None), sizes.append(None), sums.append(n), keys.append(piece)
                # The document's own row: its key is no pre-token, and no two rows share it.
                rows.append(row), ids.append(doc), sizes.append(len(text.encode("utf-8", "replace"))), sums.append(total), keys.append(f"\x00{row}")
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n": pa.array(sums, pa.int64()), "piece": pa.array(keys, pa.string())})

    return run


def _hot_threshold(pieces: DataFrame) -> int:
    """The least frequency that at most HOT_PIECES pre-tokens reach, from a histogram over powers of 2^(1/8)."""
    level = F.floor(F.log2("n") * 8).alias("level")
    rows = pieces.groupBy(level).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).collect()
    threshold, total = 1 << 62, 0
    for r in sorted(rows, key=lambda r: -r.level):
        total += r.c
        if total > HOT_PIECES:
            break
        threshold = r.least
    return threshold


def count_tokens(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens per row of documents, by the byte-level BPE file at `path` (.json).

    Null and empty texts have 0 bytes and 0 tokens; special strings inside texts count as one token, which
    is the library's default. Repeated rows each return a row; a null doc_id stays null. Texts of any
    length are counted whole. An empty table returns no rows. Other columns are ignored.

    Two passes over the texts: one for corpus-wide frequencies of pre-tokens, one that sums. The most
    frequent pre-tokens (at most HOT_PIECES, long ones by their MD5) are summed where the text is read; the
    others, each of them rare, are joined by key, so no key of the join is hot.
    """
    spark = documents.sparkSession
    common.tune(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = docs.select("text").mapInArrow(_frequencies(path), "piece string, n long")
    distinct = seen.groupBy("piece").agg(F.sum("n").alias("n"))
    counted = common.materialize(distinct.mapInArrow(_piece_counts(path), "piece string, n long, pieces long"), "pieces")
    least = _hot_threshold(counted)
    is_hot = F.col("n") >= least
    name = F.when(F.octet_length("piece") <= HOT_BYTES, F.col("piece")).otherwise(F.concat(F.lit("\x00"), F.md5(F.col("piece").cast("binary"))))
    hot = spark.sparkContext.broadcast({r.piece: r.pieces for r in counted.filter(is_hot).select(name.alias("piece"), "pieces").collect()})
    rows = docs.mapInArrow(_per_document(path, hot), "row long, doc_id long, n_bytes long, n long, piece string")
    joined = rows.join(counted.filter(~is_hot).select("piece", "pieces"), "piece", "left")
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
        .drop("row")
    )
