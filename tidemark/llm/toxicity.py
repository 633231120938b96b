"""Toxicity by a weighted lexicon of word stems, matched by one Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and accents to plain letters, digits to the letters they
stand for, white space to single blanks. The lexicon is learned from labelled rows by covering: stems that
mark many of the toxic texts come first, and the next round looks only at toxic texts that no stem explains
yet, so words that merely ride along in copies of one text stay out. A stem is a word's beginning of STEM
letters, or a whole word that has fewer or more letters than any such beginning.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from tidemark.llm import common

#: Letters of other scripts that look like these, and signs that stand for letters.
HOMOGLYPHS = {"a": "аαɑ@4", "b": "ьβ", "c": "сϲ", "d": "ԁ", "e": "еεҽ3", "g": "ɡ", "h": "һ", "i": "іιı1", "j": "ј", "k": "кκ", "l": "ӏⅼ", "m": "м", "n": "ո", "o": "оοσ0", "p": "рρ", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ"}
#: Without any label these stems are the lexicon.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting")
#: Stems inside these phrases don't count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "pathetic fallacy", "stupid question")
#: Labelled rows that learning reads, about; letters of a stem that is no whole word; ends the stem of a whole word.
MOST_ROWS, STEM, WHOLE = 16_384, (4, 14), " "
#: Rounds of covering end when so small a share of the toxic texts is left without a stem.
LEFT = 0.01
#: A stem is so many times as frequent in toxic texts as in clean ones.
LIFT = 30
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _folding() -> dict[int, str]:
    table = {}
    for i in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(i))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            table[i] = base[0].lower()
    for i in range(0xFF21, 0xFF5B):
        table[i] = unicodedata.normalize("NFKC", chr(i)).lower()
    table |= {ord(c): letter for letter, signs in HOMOGLYPHS.items() for c in signs}
    marks = [i for i in range(0x300, 0x3000) if unicodedata.category(chr(i)) == "Mn"]
    return table | dict.fromkeys((*marks, *range(0xFE20, 0xFE30), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))


def fold(text: str) -> str:
    return " ".join(text.lower().translate(_folding()).split())


def stems_of(folded: str) -> set[str]:
    """The stems that a folded text has."""
    low, high = STEM
    words = set(_WORD.findall(folded))
    return {w[:k] for w in words for k in range(low, min(len(w), high) + 1)} | {w + WHOLE for w in words if not low <= len(w) <= high}


@dataclass(frozen=True)
class Model:
    """stems: (stem, weight); half: the length-normalised weight that scores one half."""

    stems: tuple[tuple[str, float], ...]
    half: float
    exceptions: tuple[str, ...] = EXCEPTIONS


@lru_cache(maxsize=4)
def _automaton(model: Model):
    import ahocorasick

    found = ahocorasick.Automaton()
    for stem, weight in model.stems:
        word = stem.removesuffix(WHOLE)
        found.add_word(word, (len(word), weight, stem.endswith(WHOLE)))
    for phrase in map(fold, model.exceptions):
        if not found.exists(phrase):
            found.add_word(phrase, (len(phrase), None, False))
    if len(found):
        found.make_automaton()
    return found


def raw(model: Model, text: str) -> tuple[float, int]:
    """The weight of a text's matches over its length norm, and the number of matches.

    A match starts at the start of a word, that of a whole word also ends where the word does, and none lies
    within an exception phrase. Of the matches at one place the heaviest counts.
    """
    automaton = _automaton(model)
    if not text or not len(automaton):
        return 0.0, 0
    folded, hits, spared = fold(text), [], []
    for end, (size, weight, whole) in automaton.iter(folded):
        start = end - size + 1
        if start and folded[start - 1].isalpha():
            continue
        if whole and end + 1 < len(folded) and folded[end + 1].isalpha():
            continue
        (spared if weight is None else hits).append((start, end, weight))
    # Of the phrases that start at a place or before it, the one that reaches farthest decides.
    spared.sort()
    starts, reach = [a for a, _, _ in spared], []
    for _, b, _ in spared:
        reach.append(max(b, reach[-1] if reach else b))
    best: dict[int, float] = {}
    for start, end, weight in hits:
        at = bisect_right(starts, start)
        if not at or reach[at - 1] < end:
            best[start] = max(weight, best.get(start, 0.0))
    return sum(best.values()) / (1 + (folded.count(" ") + 1) / 200) ** 0.25, len(best)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(stems: frozenset):
    """Counts of stems in toxic texts that no known stem explains, and in clean texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(common.texts_of(batch), batch.column("toxic").to_pylist()):
                found = stems_of(fold(text))
                if not label:
                    clean.update(found)
                    clean[""] += 1
                elif stems.isdisjoint(found):
                    toxic.update(found)
                    toxic[""] += 1
        keys = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict({"stem": pa.array(keys, pa.string()), "a": pa.array([toxic[k] for k in keys], pa.int64()), "b": pa.array([clean[k] for k in keys], pa.int64())})

    return run


def _chosen(rows: list, total_a: int, total_b: int) -> list[tuple[str, float]]:
    """The stems of a round with their weights: of a chain of beginnings the longest equally wide one."""
    out: dict = {}
    widest, extended = Counter(), defaultdict(set)  # by beginning: of the stems taken that extend it
    for r in sorted(rows, key=lambda r: (-len(r.stem), r.stem)):  # longer stems first: a shorter one stays only if it is clearly wider than what extends it
        if widest[r.stem] >= 0.95 * r.a:
            continue
        for x in extended[r.stem]:
            out.pop(x, None)
        out[r.stem] = r
        for k in range(1, len(r.stem)):
            widest[r.stem[:k]] = max(widest[r.stem[:k]], r.a)
            extended[r.stem[:k]].add(r.stem)
    return [(r.stem, math.log(((r.a + 0.5) / (total_a + 1)) / ((r.b + 0.5) / (total_b + 1)))) for r in out.values()]


def learn(documents: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, most: int = MOST_ROWS) -> Model:
    """A model from labelled texts outside the held-out fold.

    labels: doc_id, toxic (0/1; null: no label). At most about `most` labelled rows are read, those of
    least hash of their id, whatever the size of the table. Without usable labels, or where no stem is
    significant, the seed lexicon stands in. A round takes all significant stems at least half as wide as
    its widest; what the driver holds is bounded by the words of the rows that are read.
    """
    spark = documents.sparkSession
    common.tune(spark)
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    share = min(1.0, most / max(1, usable.count()))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(share * (1 << 31))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # The sample's size is bounded by `most`, give or take the hash.
    texts = common.materialize(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "labelled")
    stems: dict[str, float] = {}
    all_toxic = 0
    while True:
        counted = common.materialize(texts.mapInArrow(_features(frozenset(stems)), "stem string, a long, b long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "stems")
        totals = counted.filter("stem = ''").first()
        if totals is None or not totals.a or not totals.b or totals.a < LEFT * all_toxic:
            break
        all_toxic = all_toxic or totals.a
        tests = counted.count()
        # Log-likelihood ratio of the stem's rate in toxic texts against its rate in all texts.
        rate = F.col("a") / (F.col("a") + F.col("b"))
        base = totals.a / (totals.a + totals.b)
        evidence = 2 * (F.col("a") * F.log(rate / base) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - rate) / (1 - base))).otherwise(0.0))
        lift = (F.col("a") / totals.a) / ((F.col("b") + 1) / totals.b)
        good = counted.filter("stem <> ''").filter((F.col("a") >= 3) & (rate > base)).filter((lift >= LIFT) & (evidence >= 2 * math.log(tests / 0.01)))
        widest = good.agg(F.max("a")).first()[0] or 0
        fresh = _chosen(good.filter(F.col("a") >= 0.5 * widest).collect(), totals.a, totals.b)
        fresh = [(s, w) for s, w in fresh if s not in stems]
        if not fresh:
            break
        stems |= dict(fresh)
    if not stems:
        return Model(tuple((fold(s), 4.0) for s in SEED), 4.0, exceptions)
    model = Model(tuple(sorted(stems.items())), 1.0, exceptions)
    return Model(model.stems, _half(texts, model), exceptions)


def _half(texts: DataFrame, model: Model) -> float:
    """Places the threshold where F1 on the labelled rows is best, halfway down to the next lower value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [round(raw(model, t)[0], 2) for t in common.texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.float64()), "toxic": batch.column("toxic")})

    rows = texts.mapInArrow(run, "x double, toxic int").groupBy("x").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(((r.x, r.a, r.n) for r in rows), reverse=True)
    positives, best, hits, taken, at = sum(a for _, a, _ in rows), -1.0, 0, 0, rows[0][0]
    for i, (x, a, n) in enumerate(rows):
        hits, taken = hits + a, taken + n
        if x > 0 and (f1 := 2 * hits / max(1, taken + positives)) > best:
            below = rows[i + 1][0] if i + 1 < len(rows) else 0.0
            best, at = f1, (x + below) / 2
    return max(at, 1e-6) * (1 - THRESHOLD) / THRESHOLD


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with toxicity (double, 0 to 1) and toxic_matches (int); columns of these names are replaced.

    The weight of all matches, over a length norm, w, becomes w / (w + half). Null and empty texts score
    0. Whole texts are read; every row stays; no shuffle.
    """
    common.tune(documents.sparkSession)
    df = documents.drop("toxicity", "toxic_matches")
    schema = StructType(list(df.schema)).add("toxicity", DoubleType()).add("toxic_matches", IntegerType())
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [raw(model, t) for t in common.texts_of(batch, text)]
            scores = [w / (w + model.half) for w, _ in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([n for _, n in found], pa.int32())], names=[*names, "toxicity", "toxic_matches"])

    return df.mapInArrow(run, schema)


def keep(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that score below the threshold, with the columns of documents as they are."""
    model = learn(documents, labels)
    scored = score(documents.select(F.struct("*").alias("__row"), F.col("text").alias("__text")), model, "__text")
    return scored.filter(F.col("toxicity") < threshold).select("__row.*")
