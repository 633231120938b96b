import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tests import parity
from tidemark.llm import queries, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(int(c / 20) * 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in kids[s])
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def of(spark, rows, types="conv_id long, turn long, role string, text string"):
    df = trie.prefix_trie(spark.createDataFrame(rows, types))
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda x: x[:2])


def random_rows(seed, convs=90, words="ab"):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-45, 400), convs):
        for t in range(r.randint(1, 6)):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "user", None]), r.choice([None, "", *words, "x y", "\tü  x\n"])))
    return rows + rows[:7]


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_brute_force(spark, seed):
    rows = random_rows(seed) + [(None, 1, "user", "lost")]
    assert of(spark, rows) == brute(rows)


def test_trie_of_copies_long_conversations_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHAIN", 7)
    monkeypatch.setattr(trie, "BLOCK", 5)
    monkeypatch.setattr(trie, "IDS", 3)
    long = [(c, t, "user", f"turn {t} " * (t % 3)) for c in (40, 60, 80, 100) for t in range(60)]
    copies = [(c, t, "user", f"copy {t}") for c in range(1000, 1200) for t in range(4)]
    rows = long + copies + [(7, 0, "user", "short")] + random_rows(5, 30)
    assert of(spark, rows) == brute(rows)


def test_hot_classes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(trie.common, "HOT", 5)
    monkeypatch.setattr(trie.common, "SHARES", 8)
    rows = [(c, t, "user", f"same {t}" if t < 4 else f"own {c}") for c in range(0, 1600, 20) for t in range(6)]
    assert of(spark, rows) == brute(rows)


def test_trie_of_empty_and_single_tables(spark):
    assert of(spark, []) == []
    assert of(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(7, 0, "user", "a")], [(0, 0, None, None)]):
        assert of(spark, rows) == brute(rows)


def test_extra_columns_are_ignored(spark):
    rows = random_rows(3, 20)
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn long, role string, text string, depth int, `key` string")
    assert sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=lambda x: x[:2]) == brute(rows)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    parity.compare(queries.op11_prefix_trie(spark, sf), parity.connect(sf), queries.OP11_SQL)
