import math
import random
import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "ti") for c in ("nu", "pel", "dor", "g")]


def corpus(n, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(12, 60))]
        toxic, good = int(r.random() < 0.2), int(r.random() < 0.8)
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zorgle", "Zorgling", "frumpo", "FRUMPOS"]))
        if not good:
            words = [w + r.choice(["###", "%%%"]) for w in words]
        docs.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(3000)
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folding_undoes_disguises():
    assert toxicity.fold("ІdіОt") == "idiot" and toxicity.fold("1d10t") == "idiot" and toxicity.fold("Ｉｄｉｏｔ") == "idiot" and toxicity.fold("mo\u200bron") == "moron" and toxicity.fold("naïve") == "naive"


def test_learned_stems_classify_the_held_out_fold(spark, tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    assert {s[:4] for s, _ in model.stems} == {"zorg", "frum"}
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out(labels["doc_id"]))
    assert scored.filter("(toxicity >= 0.3) <> (toxic = 1)").count() == 0 and scored.count() > 500


def test_exceptions_word_starts_and_edges(spark):
    model = toxicity.Model((("trash", 5.0),), 5.0, ("trash can",))
    rows = [(1, "you are trash"), (2, "put it in the trash can"), (3, "putrash"), (4, None), (5, ""), (6, "trash can and trash"), (7, "tr4sh " + "word " * 50000)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, toxicity double")
    got = {r.doc_id: (r.toxicity, r.toxic_matches) for r in toxicity.score(df, model).collect()}
    assert got[1][0] > 0.3 and got[2] == got[3] == got[4] == got[5] == (0.0, 0) and got[6][1] == 1 and 0 < got[7][0] < got[1][0]


def naive(model, text):
    """(weight, matches) by trying every stem and phrase at every place."""
    t = toxicity.fold(text or "")
    inside = set()
    for phrase in map(toxicity.fold, model.exceptions):
        for m in range(len(t)):
            if t.startswith(phrase, m) and not (m and t[m - 1].isalpha()):
                inside |= {(a, b) for a in range(m, m + len(phrase)) for b in range(a, m + len(phrase))}
    best = {}
    for stem, w in model.stems:
        word = stem.strip()
        for m in range(len(t)):
            if t.startswith(word, m) and not (m and t[m - 1].isalpha()) and not (stem.endswith(" ") and t[m + len(word) : m + len(word) + 1].isalpha()) and (m, m + len(word) - 1) not in inside:
                best[m] = max(best.get(m, 0), w)
    return sum(best.values()) / (1 + (t.count(" ") + 1) / 200) ** 0.25 if t else 0.0, len(best)


def test_matches_equal_a_naive_matcher():
    r = random.Random(8)
    model = toxicity.Model((("trash", 5.0), ("trashy", 7.0), ("as ", 2.0), ("stup", 3.0), ("idiot", 4.0)), 5.0, ("trash can", "can trash can", "stupid question", "as trash"))
    pieces = ["trash", "trash  can", "can", "trashy", "as", "asp", "stupid", "question", "tr4sh\ncan", "ídi̇ot", "1d10t", "x", "\u00a0", "as!", "strash"]
    for _ in range(400):
        text = r.choice(["", " "]).join([r.choice(pieces) + r.choice([" ", "", "\t", ", "]) for _ in range(r.randint(0, 12))])
        got, want = toxicity.raw(model, text), naive(model, text)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9, text


def test_many_exceptions_take_linear_time():
    import time

    model = toxicity.Model((("trash", 5.0),), 5.0, ("trash can",))
    start = time.time()
    assert toxicity.raw(model, "trash can trash " * 40_000)[1] == 40_000
    assert time.time() - start < 5


def test_combining_marks_and_short_words(spark):
    assert toxicity.fold("i\u0301di\u0300ot  \n x") == "idiot x"
    assert toxicity.stems_of("ab abcde " + "q" * 20) == {"ab ", "abcd", "abcde", "q" * 20 + " "} | {"q" * k for k in range(4, 15)}
    docs = spark.createDataFrame([(i, f"some words here {'zut' if i % 5 == 0 else 'fine'} number n{i % 97}") for i in range(600)], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int"))
    assert [s for s, _ in model.stems] == ["zut "]


def test_a_naive_learner_finds_the_same_stems(spark, tables):
    """One round of covering after another over plain Python lists."""
    docs, labels = tables
    rows = docs.join(labels, "doc_id").filter(~toxicity.held_out(docs["doc_id"])).select("text", "toxic").collect()
    stems, first = {}, None
    while True:
        sets = [(toxicity.stems_of(toxicity.fold(r.text)), r.toxic) for r in rows]
        toxic, clean = [s for s, t in sets if t and not stems.keys() & s], [s for s, t in sets if not t]
        first = first or len(toxic)
        if not toxic or len(toxic) < 0.01 * first:
            break
        a, b = Counter(x for s in toxic for x in s), Counter(x for s in clean for x in s)
        base, good = len(toxic) / (len(toxic) + len(clean)), {}
        for x, n in a.items():
            rate = n / (n + b[x])
            evidence = 2 * (n * math.log(rate / base) + (b[x] * math.log((1 - rate) / (1 - base)) if b[x] else 0))
            if n >= 3 and rate > base and (n / len(toxic)) / ((b[x] + 1) / len(clean)) >= 30 and evidence >= 2 * math.log((len(a | b) + 1) / 0.01):
                good[x] = n
        wide = {x: n for x, n in good.items() if n >= 0.5 * max(good.values())}
        new = [x for x, n in wide.items() if x not in stems and not any(y != x and y.startswith(x) and m >= 0.95 * n for y, m in wide.items())]
        new = [x for x in new if not any(y != x and x.startswith(y) for y in new)]
        if not new:
            break
        stems |= {x: math.log(((a[x] + 0.5) / (len(toxic) + 1)) / ((b[x] + 0.5) / (len(clean) + 1))) for x in new}
    got = dict(toxicity.learn(docs, labels).stems)
    assert got.keys() == stems.keys() and all(abs(got[s] - stems[s]) < 1e-9 for s in stems)


def test_no_labels_fall_back_to_the_seeds(spark):
    docs = spark.createDataFrame([(1, "what an idiot"), (2, "hello"), (None, "x")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert "idiot" in dict(model.stems)
    assert toxicity.keep(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int")).count() == 2
    assert toxicity.keep(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_counts_equal_brute_force():
    r = random.Random(5)
    texts = ["", " \n\t", "one", "a\nb\na\n\na", "x " * 400, "\u00a0 \u2003wide\x0bspace\x0c", "αβ 😀 " * 30, "a b c d e a b c d e", "same line\nsame line\r\nsame line", "#*$%&|<>"]
    texts += [" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) + r.choice(["", "\n", "\nq"]) for _ in range(300)] + ["w%d " % (i % 7) * 3 for i in range(50)] + ["lorem ipsum dolor sit amet " * 20000]
    found = quality.counts(texts)
    got = list(zip(*(found[c].tolist() for c in quality.COUNTS[:5])))
    assert got == [brute(t) for t in texts]


def test_upper_bound_is_exact():
    for k, n, alpha in ((0, 50, 0.05), (3, 100, 0.01), (10, 400, 0.001)):
        p = quality.upper_bound(k, n, alpha)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - alpha) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0


def test_cutoffs_need_enough_good_texts():
    few, many = np.zeros(64, np.int64), np.zeros(64, np.int64)
    few[0], many[0] = 50, 5000
    bad = np.zeros(64, np.int64)
    bad[60] = 40
    assert quality.cutoff(few, bad, 2) is None and quality.cutoff(many, bad, 2) is not None
    assert quality.cutoff(many, np.zeros(64, np.int64), 1) is None
    mixed = many.copy()
    mixed[60] = 400  # too many good texts would go
    assert (quality.cutoff(mixed, bad, 1) or 64) > 60
    assert quality.cutoff(many, bad, 10**45) is None  # more strata, stricter bounds


def test_strata_that_can_pass_are_counted(spark):
    for sizes in ([], [100], [149], [400, 300, 217, 210], [183, 183, 183], [149] * 5, [1000] * 3 + [20] * 50, [150, 148], [10**6, 40_000, 300]):
        most = quality.tested(sizes)
        assert all(0.98 ** sorted(sizes)[-most] <= 0.05 / most for _ in range(1 if most else 0))
        df = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "stratum string, n long")
        assert quality._tested(df, quality.RISK, quality.DELTA) == most
    assert quality.tested([217] * 4) == 4 and quality.tested([148]) == 0 and quality.tested([183, 183, 183]) == 2


def test_verdicts(spark, tables):
    docs, labels = tables
    judged = quality.judge(docs, labels).join(labels, "doc_id").filter("not base_failed")
    assert judged.filter("quality = 1 and not kept").count() <= 0.02 * judged.filter("quality = 1").count()
    assert judged.filter("quality = 0 and kept").count() == 0
    assert sorted(r.doc_id for r in quality.keep(docs, labels).collect()) == sorted(r.doc_id for r in quality.judge(docs, labels).filter("kept").collect())


def test_lines_of_a_regular_kind_are_told_apart():
    for n in (256, 1024, 4096):
        a, b = ("".join("ab"[bin(i).count("1") & 1 ^ flip] for i in range(n)) for flip in (0, 1))
        assert quality.counts([f"{a}\n{b}"])["n_dup_lines"].tolist() == [0] and quality.counts([f"{a}\n{a}\n{b}"])["n_dup_lines"].tolist() == [1]


def brute_kept(docs, labels):
    """doc_id -> kept and the cutoffs, by the whole method over plain Python lists: bins, sides, scores, bounds, cutoffs."""
    rows = quality.measure(docs).join(labels.select("doc_id", "quality"), "doc_id", "left").select("*", *[quality._bin(x, quality.BINS).alias(f"bin_{s}") for s, x in quality.signals().items()]).collect()
    names = list(quality.signals())
    failed = {r.doc_id for r in rows if r.n_words < 10 or r.n_repeat_words * 5 > r.n_words}
    by_text = {}
    for r in rows:
        if r.doc_id not in failed and r.quality is not None:
            good, lang, bins = by_text.get(r.text_hash, (0, None, None))
            by_text[r.text_hash] = (max(good, int(r.quality > 0)), min(lang or r.lang, r.lang), [r[f"bin_{s}"] for s in names])
    fit = [v for h, v in by_text.items() if h % 4 == 0]
    n = {g: sum(v[0] == g for v in fit) for g in (0, 1)}
    times = Counter((v[0], s, b) for v in fit for s, b in zip(names, v[2]))

    def place(bins):
        logit = sum(math.log(((times[0, s, b] + 0.5) / (n[0] + 8)) / ((times[1, s, b] + 0.5) / (n[1] + 8))) for s, b in zip(names, bins))
        return min(int(64 / (1 + math.exp(-logit / 2))), 63)

    held = [(v[1], v[0], place(v[2])) for h, v in by_text.items() if h % 4]
    sizes, limit = Counter(x for x, g, _ in held if g), {}
    # As many of the largest strata as could all pass without a loss.
    strata = max([k for k, (_, n) in enumerate(sizes.most_common(), 1) if 0.98**n <= 0.05 / k], default=0)
    for lang in [x for x, n in sizes.items() if strata and 0.98**n <= 0.05 / strata]:
        good, bad = ([p for x, g, p in held if x == lang and g == want] for want in (1, 0))
        sure = {}
        for c in range(63, 0, -1):
            lost, caught = sum(p >= c for p in good), sum(p >= c for p in bad)
            # The bound is at most 2% where so few losses are that unlikely at a rate of 2%.
            if sum(comb(len(good), k) * 0.02**k * 0.98 ** (len(good) - k) for k in range(lost + 1)) > 0.05 / strata:
                break
            if caught:
                sure[c] = caught - 2 * lost
        best = sorted(c for c in sure if sure[c] == max(sure.values()))
        if best:
            limit[lang] = best[len(best) // 2]
    return {r.doc_id: r.doc_id not in failed and place([r[f"bin_{s}"] for s in names]) < limit.get(r.lang, 64) for r in rows}, limit


def test_verdicts_equal_brute_force(spark, tables):
    want, limit = brute_kept(*tables)
    assert {r.doc_id: r.kept for r in quality.judge(*tables).collect()} == want and limit


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 7), (None, "a b c d e f g h i j k", "en", 8), (2, "", "en", 9), (2, "", "en", 9)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(None, None), (1, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 1
    assert quality.keep(docs, labels).columns == docs.columns and quality.keep(docs, labels).first().n_words == 8
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_columns_with_the_names_of_helpers_stay(spark, tables):
    docs, labels = tables
    odd = {c: F.lit(i) for i, c in enumerate(("__text", "__level", "__stratum", "__symbols", "__badness"))}
    got = quality.judge(docs.withColumns(odd), labels)
    assert {r.doc_id: r.kept for r in got.collect()} == {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert [got.first()[c] for c in odd] == list(range(5))
