"""Phrase collocations: grams of one to four words, counted per language, scored and freed of parts of longer phrases.

A phrase of `least` occurrences has parts of as many, so grams are exploded length by length: the pairs of words
first, by their hashes; then only such longer grams whose parts may be frequent. That is exact: hashes choose
what is counted (two grams of one hash are both counted), the counts themselves are of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import arrays, common, grams

#: The characters between words, and those that end a piece; phrases lie within pieces.
GAPS, STOPS = "\x20\x09", ".,;:!?\x0a\x0b\x0c\x0d"
#: The language of texts without one.
NO_LANG = "und"
#: Grams that a task puts together before it hands their counts on.
TOGETHER = 1_000_000
#: Characters that are read together: the more, the fewer times a phrase is put into words.
READ = 1_000_000
#: Rows of a batch that a task hands on: what both sides of it hold at once.
ROWS_OUT = 65_536
#: Parts by which the first phrases of a language are found.
PARTS = 256


class Pieces:
    """The words of some texts in a row: hashes, the piece that each is in, its text and that text's language."""

    def __init__(self, texts: list[str], langs: list[int]):
        self.lowered = grams.Lowered(texts, GAPS + STOPS)
        self.starts, self.ends = self.lowered.words()
        self.words = self.lowered.hashes(self.starts, self.ends).view(np.int64)
        stop = np.zeros(len(self.lowered.codes), bool)
        for low, high in grams.gap_ranges(STOPS):
            stop |= (self.lowered.codes >= low) & (self.lowered.codes <= high)
        self.piece = np.cumsum(stop)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.text = self.lowered.text_of(self.starts)
        self.langs = np.array(langs, np.int64)[self.text]

    def grams(self, size: int, begins: np.ndarray | None = None) -> np.ndarray:
        """First words of the grams of `size` words; those of `begins` (of one word less) that go on as another of them."""
        n = max(len(self.words) - size + 1, 0)
        if begins is None:
            return np.flatnonzero(self.piece[:n] == self.piece[size - 1 :])
        begun = np.zeros(len(self.words) + 1, bool)
        begun[begins] = True
        return begins[begun[begins + 1] & (begins < n)] if len(begins) else begins

    def keys(self, begins: np.ndarray, size: int) -> np.ndarray:
        return arrays.hashed(self.langs[begins], *[self.words[begins + i] for i in range(size)])


@lru_cache(maxsize=4096)
def _language(lang: str) -> int:
    """A number for a language."""
    return int(arrays.hashed(np.frombuffer(lang.encode().ljust(8 * (len(lang.encode()) // 8 + 1), b"\0"), np.int64)).sum())


def _read(batch: pa.RecordBatch) -> Iterator[tuple[Pieces, list[str]]]:
    all_langs = [lang or NO_LANG for lang in batch.column("lang").to_pylist()]
    for first, texts in grams.chunks(common.texts_of(batch), characters=READ):
        langs = all_langs[first : first + len(texts)]
        yield Pieces(texts, [_language(lang) for lang in langs]), langs


def _frequent(pieces: Pieces, known: list[arrays.Arrays]) -> list[np.ndarray]:
    """First words of the grams of 2, 3, ... words that `known` has, each in the grams of one word less on both sides."""
    out, begins = [], None
    for size, found in enumerate(known, 2):
        begins = pieces.grams(size, begins)
        keys, same = np.unique(pieces.keys(begins, size), return_inverse=True)
        begins = begins[found.find(keys)[0][same]] if len(begins) else begins
        out.append(begins)
    return out


def _hashes(known: list[arrays.Arrays]):
    """Hashes and counts of the grams of one word more than the last of `known`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(keys), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + ROWS_OUT]), pa.array(n[at : at + ROWS_OUT])], names=["key", "n"])

        for batch in batches:
            for pieces, _ in _read(batch):
                begins = _frequent(pieces, known)[-1] if known else None
                size = len(known) + 2
                held.append(pieces.keys(pieces.grams(size, begins), size))
                if sum(map(len, held)) > TOGETHER:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _phrases(known: list[arrays.Arrays], longest: int):
    """Rows (lang, phrase, size, n): all words, the frequent grams, those of `longest` words whose parts are frequent; size 0 sums up all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces, langs in _read(batch):
                _, first, word = np.unique(pieces.words, return_index=True, return_inverse=True)
                strings = pieces.lowered.strings(pieces.starts[first], pieces.ends[first])
                begins = [np.arange(len(word)), *_frequent(pieces, known)]
                begins.append(pieces.grams(longest, begins[-1] if known else None))
                for size, b in enumerate(begins, 1):
                    _, at, n = np.unique(pieces.keys(b, size), return_index=True, return_counts=True)
                    for low in range(0, max(len(at), 1), ROWS_OUT):
                        own = b[at[low : low + ROWS_OUT]]
                        parts = [map(strings.__getitem__, word[own + i].tolist()) for i in range(size)]
                        yield rows(langs, pieces.text[own], list(map(" ".join, zip(*parts))), size, n[low : low + ROWS_OUT])
                text, n = np.unique(pieces.text, return_counts=True)
                yield rows(langs, text, [""] * len(text), 0, n)

    def rows(langs: list[str], text: np.ndarray, phrase: list[str], size: int, n: np.ndarray) -> pa.RecordBatch:
        named = pa.array(list(map(langs.__getitem__, text.tolist())), pa.string())
        return pa.RecordBatch.from_arrays([named, pa.array(phrase, pa.string()), pa.array(np.full(len(text), size, np.int32)), pa.array(n)], names=["lang", "phrase", "size", "n"])

    return run


def counted(documents: DataFrame, longest: int = 4, least: int = 30) -> DataFrame:
    """lang, phrase, size, n: grams of 1 to `longest` words with n >= least occurrences in their language; size 0 counts all words.

    documents has text and lang; null texts are empty, null languages `und`. What a gram of `longest` words needs is
    known from the lengths before: one pass over the texts for each length from 2 to longest.
    """
    spark = documents.sparkSession
    common.tune(spark)
    docs = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known: list[arrays.Arrays] = []
    for size in range(2, longest):
        rows = docs.mapInArrow(_hashes(known), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        known.append(arrays.written(rows.filter(F.col("n") >= least), f"grams{size}"))
    rows = docs.mapInArrow(_phrases(known, longest), "lang string, phrase string, size int, n long")
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0))


def collocations(documents: DataFrame, longest: int = 4, least: int = 30, first: int = 2000, share: int = 80) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    a counts the phrase, l and r the parts of its worst cut (ties: the earliest), n all words of the language; score is
    floor(2000000 a / (l + r)), in decimals. Phrases that lie in a longer one with `share` percent of their occurrences
    go: a longer phrase's middles are at least as frequent as it is, so extensions by one word tell. `first` phrases are
    kept by score, a, and the phrase's bytes. Empty texts and tables give no rows; other columns are ignored.

    Prefixes and suffixes may be shared by many phrases: their joins spread hot keys. The first phrases are found
    in parts of each language, then among those of all parts.
    """
    counts = common.materialize(counted(documents, longest, least), "grams")
    words = counts.filter("size = 0").select("lang", F.col("n").alias("__n"))
    phrases = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    cut = phrases.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    both = cut.select("*", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice(parts, F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("right"))
    both = common.materialize(both, "cuts")
    known = counts.filter("size > 0")
    both = common.spread_join(both, known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    both = common.spread_join(both, known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumns({"__a": wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), "__sum": wide("l") + wide("r")}).withColumn("score", F.expr("__a div __sum"))
    worst = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.score")

    longer = phrases.filter("size > 2").select("lang", "a", F.explode(F.array(*[F.array_join(F.slice(parts, F.lit(i), F.col("size") - 1), " ") for i in (1, 2)])).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("a").alias("__longer"))
    within = wide("__longer") * 100 >= wide("a") * share
    alone = worst.join(held, ["lang", "phrase"], "left").filter(~F.coalesce(within, F.lit(False))).drop("__longer")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = alone.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*best))).filter(F.col("rank") <= first).drop("__part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("__n").alias("n"), "score")
