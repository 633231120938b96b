"""Quality rules with certified cutoffs.

Base rules reject outright. For all other texts a score in [0, 1] is learned on a quarter of the labelled
rows; on the others, the holdout, exact binomial bounds decide which cutoffs reject at most a stated share of
good texts, in each stratum by itself. A stratum's cutoffs are tested in a fixed order, from the strictest
down, until one fails: a cutoff is only tested after all stricter ones have passed, so the order needs no
correction. The strata do (Bonferroni), but only those that have enough good texts to pass at all. Among the
certified cutoffs of a stratum the one that errs least on the holdout is used; a stratum without a certified
cutoff rejects nothing beyond the base rules. The bound takes the texts of the holdout as drawn independently
of those that the score was learned from: equal texts are on one side, but near copies may be on both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import common, grams

#: Share of good texts that a stratum may lose, and the chance that any stratum loses more.
RISK, DELTA = 0.02, 0.05
#: One of so many labelled texts teaches the score, the others are the holdout.
TAUGHT = 4
#: Bins of a signal, cutoffs of the score.
BINS, CUTOFFS = 16, 64
#: So many cutoffs are broadcast at most; more are joined by a shuffle.
BROADCAST = 65_536
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_distinct")
_SPACE = np.array([0x20, 9, 10, 11, 12, 13], np.uint32)
_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], np.uint32)


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    for first, part in grams.chunks(texts):
        t = grams.Texts(part)
        here = slice(first, first + len(part))
        in_word = ~np.isin(t.codes, _SPACE)
        starts, ends = t.spans(in_word)
        text = t.text_of(starts)
        words = t.hashes(starts, ends)
        out["n_words"][here] = np.bincount(text, minlength=t.n)
        out["word_chars"][here] = t.per_text(in_word)
        out["n_symbols"][here] = t.per_text(np.isin(t.codes, _SYMBOLS))
        out["n_upper"][here] = t.per_text((t.flags & grams.UPPER) > 0)
        out["n_letters"][here] = t.per_text((t.flags & grams.LETTER) > 0)
        out["n_bangs"][here] = t.per_text(t.codes == ord("!"))
        out["n_distinct"][here] = _distinct(text, words, t.n)
        # Lines: what stands between newlines; only those with a word count.
        line_ends = np.flatnonzero(t.codes == 10)
        line_starts = np.concatenate([[0], line_ends[:-1] + 1])
        real = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_text, lines = t.text_of(line_starts[real]), t.hashes(line_starts[real], line_ends[real])
        n_lines = np.bincount(line_text, minlength=t.n)
        out["n_lines"][here] = n_lines
        out["n_dup_lines"][here] = n_lines - _distinct(line_text, lines, t.n)
        out["n_repeat_words"][here] = _repeated(words, text, t.n)
    return out


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, text))
    a, b = text[order], hashes[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.bincount(a[new], minlength=n)


def _repeated(words: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Words that stand in a window which its text holds twice or more."""
    h, first = grams.windows(words, text)
    owner = text[first]
    order = np.lexsort((h, owner))
    a, b = owner[order], h[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(a), bool)
    twice[1:] |= same
    twice[:-1] |= same
    # Cover the words of these windows: +1 where one starts, -1 behind its end.
    edge = np.zeros(len(words) + 1, np.int64)
    at = first[order[twice]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + grams.SHINGLE, -1)
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=n)


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents without its text column, with the COUNTS and text_hash (long); columns of these names are replaced."""
    common.tune(documents.sparkSession)
    kept = [c for c in documents.columns if c not in (text, "text_hash", *COUNTS)]
    own = common.fresh(documents, "__text")
    src = documents.select(*kept, F.xxhash64(text).alias("text_hash"), F.col(text).alias(own))
    kept.append("text_hash")
    schema = StructType(list(src.drop(own).schema))
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(common.texts_of(batch, own))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[c]) for c in COUNTS)], names=[*kept, *COUNTS])

    return src.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def signals() -> dict[str, Column]:
    """Shares in [0, 1] from the COUNTS."""
    c = lambda name: F.col(name).cast("double")
    some = lambda name: F.greatest(c(name), F.lit(1.0))
    return {
        "symbols": c("n_symbols") / some("word_chars"),
        "upper": c("n_upper") / some("n_letters"),
        "bangs": F.least(c("n_bangs") / some("n_words") / 2, F.lit(1.0)),
        "dup_lines": c("n_dup_lines") / some("n_lines"),
        "repeats": c("n_repeat_words") / some("n_words"),
        "letters": c("n_letters") / some("word_chars"),
        "word_length": F.least(c("word_chars") / some("n_words") / 16, F.lit(1.0)),
        "distinct": c("n_distinct") / some("n_words"),
    }


def _bin(x: Column, n: int) -> Column:
    return F.least(F.floor(x * n), F.lit(n - 1)).cast("int")


def upper_bound(failures: int, trials: int, alpha: float) -> float:
    """Exact (Clopper-Pearson) upper bound at level alpha on a rate, from failures in trials."""
    if trials == 0 or failures >= trials:
        return 1.0
    i = np.arange(failures + 1)
    choose = np.array([math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) for k in i.tolist()])
    low, high = failures / trials, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = np.exp(choose + i * math.log(p) + (trials - i) * math.log1p(-p)).sum() if 0 < p < 1 else 0.0
        low, high = (p, high) if tail > alpha else (low, p)
    return high


def least_good(strata: int, risk: float = RISK, delta: float = DELTA) -> int:
    """How many good texts a stratum needs at least to have a cutoff certified, when so many strata are tested: none of them may be lost then."""
    return math.ceil(math.log(delta / max(1, strata)) / math.log1p(-risk))


def tested(sizes: list[int], risk: float = RISK, delta: float = DELTA) -> int:
    """How many strata, with so many good texts each, are tested: as many of the largest as can all pass."""
    sizes = sorted(sizes, reverse=True)
    return max([k for k, n in enumerate(sizes, 1) if n >= least_good(k, risk, delta)], default=0)


def cutoff(good: np.ndarray, bad: np.ndarray, strata: int, risk: float = RISK, delta: float = DELTA) -> int | None:
    """The cutoff of one of `strata` strata (a bin of the score: texts in it or above go), from its counts by bin, or None."""
    alpha = delta / max(1, strata)
    lost, caught, n = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1], int(good.sum())
    sure: list[int] = []
    for c in range(CUTOFFS - 1, 0, -1):
        if upper_bound(int(lost[c]), n, alpha) > risk:
            break
        sure.append(c)
    gain = {c: int(caught[c]) - 2 * int(lost[c]) for c in sorted(sure) if caught[c] > 0}
    if not gain:
        return None
    best = [c for c in gain if gain[c] == max(gain.values())]
    return best[len(best) // 2]


def _cutoffs(strata: int, risk: float, delta: float):
    """For the histogram of one stratum (stratum, good, at, n): its stratum and cutoff, if it has one."""

    def run(group: pa.Table) -> pa.Table:
        counts = np.zeros((2, CUTOFFS), np.int64)
        np.add.at(counts, (np.asarray(group.column("good")), np.asarray(group.column("at"))), np.asarray(group.column("n")))
        found = cutoff(counts[1], counts[0], strata, risk, delta)
        return pa.table({"stratum": group.column("stratum").slice(0, found is not None), "at": pa.array([found][: found is not None], pa.int32())})

    return run


@dataclass(frozen=True)
class Rules:
    """What fit() learned: counts of (signal, bin, good), of all good and bad texts, and cutoffs by stratum (stratum, at)."""

    table: dict
    total: dict
    chosen: DataFrame

    def apply(self, measured: DataFrame, stratum: str = "lang") -> DataFrame:
        """measured with badness (double, 0 to 1), cutoff (double or null), base_failed, kept."""
        named, prefix = signals(), "__"
        while {c.lower() for c in measured.columns} & {prefix + s for s in named}:
            prefix += "_"
        level, name = common.fresh(measured, "__level"), common.fresh(measured, "__stratum")
        binned = measured.withColumns({prefix + s: _bin(x, BINS) for s, x in named.items()}).withColumn("badness", _badness(self.table, self.total, list(named), prefix))
        limits = self.chosen.select(F.col("stratum").alias(name), (F.col("at") / CUTOFFS).alias("cutoff"))
        if limits.count() <= BROADCAST:
            limits = F.broadcast(limits)
        joined = binned.withColumn(level, _level(stratum)).join(limits, F.col(level) == F.col(name), "left")
        below = F.col("cutoff").isNull() | (_bin(F.col("badness"), CUTOFFS) < F.round(F.col("cutoff") * CUTOFFS))
        out = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & below)
        return out.drop(level, name, *[prefix + s for s in named])


def _level(stratum: str) -> Column:
    return F.coalesce(F.col(stratum).cast("string"), F.lit(""))


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> Rules:
    """Rules from measured rows (with text_hash) and labels: doc_id, quality (1 good, 0 bad; null: no label).

    All labelled rows count, copies of one text once. With no labels, one class only, or too few to
    certify a cutoff, no stratum has a cutoff.
    """
    named = signals()
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias(key)).agg(F.max((F.col("quality") > 0).cast("int")).alias("__good"))
    judged = rows.filter(~base_failed()).join(known, key)
    picked = judged.select("text_hash", "__good", _level(stratum).alias("stratum"), *[_bin(x, BINS).alias(s) for s, x in named.items()])
    # One row for each text; the hash of the text decides its side.
    once = common.materialize(picked.groupBy("text_hash").agg(F.max("__good").alias("good"), F.min("stratum").alias("stratum"), *[F.min(s).alias(s) for s in named]), "labelled-signals")
    first = F.pmod(F.col("text_hash"), F.lit(TAUGHT)) == 0
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("bin")) for s in named])).alias("x")
    counted = once.filter(first).select("good", each).groupBy("x.signal", "x.bin", "good").agg(F.count(F.lit(1)).alias("n"))
    table = {(r.signal, r.bin, r.good): r.n for r in counted.collect()}
    total = {g: sum(n for (s, _, h), n in table.items() if h == g and s == "symbols") for g in (0, 1)}
    badness = _badness(table, total, list(named))
    held = once.filter(~first).groupBy("stratum", "good", _bin(badness, CUTOFFS).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    held = common.materialize(held, "held-out")
    # Strata of too few good texts are not tested; how many are may not follow from how their tests end.
    sizes = held.filter("good = 1").groupBy("stratum").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_good(1, risk, delta))
    strata = _tested(sizes, risk, delta)
    held = held.join(sizes.filter(F.col("n") >= least_good(max(strata, 1), risk, delta)).select("stratum"), "stratum", "left_semi")
    chosen = held.groupBy("stratum").applyInArrow(_cutoffs(strata, risk, delta), "stratum string, at int")
    return Rules(table, total, common.materialize(chosen, "cutoffs"))


def _tested(sizes: DataFrame, risk: float, delta: float) -> int:
    """tested() for a table (stratum, n) of any length: sizes of one number are one row, of at most as many as a size has values."""
    counts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n"))
    before, most = 0, 0
    for n, k in counts.toLocalIterator():
        # Of k strata of one size the first j pass together with all larger ones while n suffices for before + j.
        fit = int(delta * math.exp(min(-n * math.log1p(-risk), 60.0)))
        most = max(most, min(before + k, fit) if fit > before else 0)
        before += k
    return most


def judge(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """documents (doc_id, text, lang) without text, with the COUNTS, text_hash, badness, cutoff, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Null languages are one stratum. Rows with
    null or repeated ids stay. Columns of documents named like new ones are replaced.
    """
    rows = common.materialize(measure(documents.drop("badness", "cutoff", "base_failed", "kept")), "quality")
    return fit(rows, labels, risk=risk, delta=delta).apply(rows)


def keep(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that judge() keeps, with the columns of documents as they are."""
    own = documents.select("doc_id", "text", "lang")
    rules = fit(common.materialize(measure(own), "quality"), labels)
    return rules.apply(measure(documents.select(F.struct("*").alias("__row"), "text", "lang"))).filter("kept").select("__row.*")


def _badness(table: dict, total: dict, names: list[str], prefix: str = "") -> Column:
    """Sum of the log ratios of bad to good texts in the signals' bins, as a share in (0, 1)."""
    logit = F.lit(0.0)
    for s in names:
        bad, good = ([(table.get((s, b, g), 0) + 0.5) / (total[g] + 0.5 * BINS) for b in range(BINS)] for g in (0, 1))
        ratios = [math.log(x / y) for x, y in zip(bad, good)]
        logit = logit + F.element_at(F.array(*[F.lit(x) for x in ratios]), F.col(prefix + s) + 1)
    return 1 / (1 + F.exp(-logit / 2))
