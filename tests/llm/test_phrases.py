import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests import parity
from tidemark.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=4, least=30, first=2000, share=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] < share * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:first], 1))


def of(spark, rows, types="text string, lang string", **k):
    df = phrases.collocations(spark.createDataFrame(rows, types), **k)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def made(seed, texts=120, words=12):
    r = random.Random(seed)
    known = ["New", "york", "CITY", "é", "Éa", "of", "the", "a\xa0b", "x\x1fy", "[z]+", "%", "\\1"][:words]
    rows = [(None, "en"), ("", None), (" .,\t", "de"), ("hapax", "fr")]
    for _ in range(texts):
        t = "".join(r.choice(known) + r.choice([" "] * 8 + ["\t", "  ", ". ", "\n", "!?", ", "]) for _ in range(r.randint(0, 60)))
        rows.append((t.replace("New york", "New York City") if r.random() < 0.5 else t, r.choice(["en", "en", "de", "und", None])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_collocations_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(phrases, "READ", 500)
    monkeypatch.setattr(phrases, "TOGETHER", 200)
    rows = made(seed)
    want = brute(rows, least=4)
    assert len(want) > 50
    assert of(spark, rows, least=4) == want


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_other_lengths_and_limits(spark, longest):
    rows = made(7, 80, 6)
    assert of(spark, rows, longest=longest, least=5, first=17, share=60) == brute(rows, longest, 5, 17, 60)


def test_ties_repeats_and_one_hot_word(spark, monkeypatch):
    monkeypatch.setattr(phrases.common, "HOT", 3)
    monkeypatch.setattr(phrases.common, "SHARES", 8)
    rows = [("the the the the the the", "en")] * 40 + [(f"the w{i} x{i}", "en") for i in range(30)] * 30
    assert of(spark, rows) == brute(rows)


def test_empty_tables_and_extra_columns(spark):
    assert of(spark, []) == []
    assert of(spark, [(None, None), ("", "en"), ("one", "en")]) == []
    rows = made(3)
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("phrase", "n", "size", "__n", "score")})
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == brute(rows)


def test_very_long_text(spark):
    rows = [("a b c d, " * 300_000, "en"), ("a b", "en")]
    assert of(spark, rows) == brute(rows)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    parity.compare(queries.op12_collocations(spark, sf), parity.connect(sf), queries.OP12_SQL)


def test_a_task_holds_few_grams_at_once(monkeypatch):
    """Within a batch of many texts, too: what is put together is handed on before it is more than TOGETHER and a piece."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "TOGETHER", 100)
    monkeypatch.setattr(phrases, "READ", 200)
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 50})
    out = list(phrases._hashes([])(iter([batch])))
    assert sum(b.column("n").to_numpy().sum() for b in out) == 50 * 19
    assert max(b.num_rows for b in out) <= 100 + 2 * 19
