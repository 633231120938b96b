import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, grams
from tidemark.llm import neardup as nd


def family(r, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, most)):
            words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randint(30, 120))) for _ in range(150)]
    for n, most in ((60, 3), (40, 12), (25, 6)):
        out += family(r, [r.choice(vocabulary) for _ in range(150)], n, most)
    out += [out[3]] * 30 + [out[4].upper() + "!!"] + ["one two three", "One, two three.", "a b", "???", "???", "!!", "", " ", None]
    footer = " all rights reserved by the owners of this very long standing footer line of text"
    return out + [" ".join(r.choice(vocabulary) for _ in range(20)) + footer for _ in range(60)]


def brute(spark, docs, texts):
    w = nd.weights_of(docs)
    vectors, keys = [], []
    for t in texts:
        s = nd.Shingles([t or ""])
        vectors.append((s.hash, w.of(s.hash, s.times)))
        keys.append(s.key[0])
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if keys[a] and keys[b] and (keys[a] == keys[b] or nd.similarity(*vectors[a], *vectors[b]) >= 0.8):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_classes_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, node long, band string").repartition(5)
    got = {r.doc_id: (r.class_id, r.class_size) for r in nd.classes(docs).collect()}
    want = brute(spark, docs, texts)
    assert {i: c for i, (c, _) in got.items()} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(n == sizes[c] for c, n in got.values())


def templates(r, n):
    """Short texts of one template with one word changed, for all of them or for some."""
    base = [f"t{i}" for i in range(30)]
    return [" ".join(f"c{i % 7}" if k == 12 else f"u{i % 40}" if k == 25 else w for k, w in enumerate(base)) + (f" e{r.randrange(9)}" if i % 3 else "") for i in range(n)]


def test_blocks_of_short_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 20)
    texts = templates(random.Random(5), 240)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in nd.classes(docs).collect()} == brute(spark, docs, texts)


def test_blocks_are_bounded_by_rows_too(spark, monkeypatch):
    monkeypatch.setattr(nd, "_compared", lambda *_: lambda t: pa.table({"a": pa.array([t.num_rows]), "b": pa.array([0])}))
    n = 9000
    shared = spark.range(n).select(F.lit(0).alias("band"), F.lit(0).cast("long").alias("value"), F.col("id").alias("node"))
    joined = shared.select("node", F.col("node").alias("component")).limit(0)
    vectors = spark.range(n).select(F.col("id").alias("node"), F.lit(bytearray(26 * 8)).alias("hashes"), F.lit(bytearray(26 * 4)).alias("times"))
    groups = [r.a for r in nd._block_links(shared, joined, vectors, None, 0.8).collect()]
    # Before, 9,000 rows of 26 shingles were one square of 9,000 x 9,000.
    assert len(groups) > 1 and max(groups) < 2 * 4096


@pytest.mark.parametrize("blocks", [1, 2])
def test_a_pair_of_blocks_needs_no_square_of_its_rows(blocks):
    class Sent:
        value = nd.Weights(np.zeros(0, np.int64), np.zeros(0), 1.0)

    n, r = 6000, np.random.default_rng(3)
    own = r.integers(100, 1 << 40, n)
    hashes = [np.sort(np.append(np.arange(20) + 1000 * (i % 3000), own[i])).astype(np.int64).tobytes() for i in range(n)]
    group = pa.table({"i": [0] * n, "j": [blocks - 1] * n, "block": [i * blocks // n for i in range(n)], "node": list(range(n)), "component": list(range(n)), "hashes": hashes, "times": [np.ones(21, np.int32).tobytes()] * n})
    tracemalloc.start()
    links = nd._compared(Sent, 0.8)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(links["a"].to_pylist(), links["b"].to_pylist())) == [(i, i + 3000) for i in range(3000)]
    assert peak < 500e6  # one matrix of 6,000 x 6,000 is 288 MB, and there were several


def test_null_ids_repeated_rows_and_empty_tables(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (9, "something else entirely with words"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id, r.class_size) for r in nd.classes(docs).collect() if r.class_id is not None)
    assert got == [(False, 5, 5, 3), (False, 5, 5, 3), (False, 9, 9, 1), (True, 0, 5, 3)]
    assert nd.classes(docs.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in nd.classes(docs).collect()) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2)]


def test_null_ids_are_linked_too(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join(words[:50] + ["other"] + words[51:])
    for ids in ((1, None), (None, None)):
        docs = spark.createDataFrame(list(zip(ids, (" ".join(words), near))), "doc_id long, text string")
        assert [r.class_size for r in nd.classes(docs).collect()] == [2, 2]


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_regular_texts_stay_apart(spark, n):
    texts = [" ".join(("foo", "bar")[b ^ flip] for b in thue_morse(n)) for flip in (0, 1)]
    a, b = nd.Shingles(texts).key
    assert a != b and nd.Shingles([texts[0].upper() + " ."]).key[0] != a and nd.Shingles([texts[0].replace(" ", "\n\t")]).key[0] == a
    t = grams.Texts(["".join("ab"[b ^ flip] for b in thue_morse(n)) for flip in (0, 1)])
    assert len(set(t.hashes(*t.words()).tolist())) == 2


def test_spans_longer_than_a_piece(monkeypatch):
    t = grams.Texts(["abc de " * 20, "abcdefghij" * 3, "x"])
    want = t.hashes(*t.words())
    monkeypatch.setattr(grams, "_CHUNK", 7)
    assert (t.hashes(*t.words()) == want).all()


def test_keep_takes_one_row_of_each_class(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    kept = lambda rows: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r["__n"]) for r in nd.keep(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, __n long")).collect()))
    assert [x[:3] for x in kept([(1, a), (1, b)])] == [(False, 1, a), (False, 1, b)]
    assert [x[:3] for x in kept([(1, a), (2, a), (2, b)])] == [(False, 1, a), (False, 2, b)]
    assert [x[:3] for x in kept([(None, a), (None, a), (None, b), (7, b)])] == [(False, 7, b), (True, 0, a)]
    assert kept([(3, a), (3, a), (4, None), (4, None), (None, ""), (5, " ")])[0][:3] == (False, 3, a)
    assert len(kept([(3, a), (3, a), (4, None), (4, None), (None, ""), (5, " ")])) == 5


def test_hot_keys_are_dealt_without_changing_results(spark, texts, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    monkeypatch.setattr(nd, "PER_COPY", 7)
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, t) for i, t in enumerate(texts)] + [(None, texts[3])] * 20, "doc_id long, text string")
    got = {}
    for r in nd._classed(docs, 0.8).collect():
        got.setdefault(r.component, set()).add(r.pick)
    every = texts + [texts[3]] * 20
    groups = {}
    for i, c in brute(spark, docs, every).items():
        if (every[i] or "").strip():
            groups.setdefault(c, set()).add(i)
    blank = got.pop(None)
    assert sorted(map(len, groups.values()))[-4:] and len(got) == len(groups) and len(blank) >= 2
    assert sum(r.class_size for r in nd.classes(docs).collect() if r.class_size > 1) == sum(len(g) ** 2 for g in groups.values() if len(g) > 1)


def test_no_frequent_shingle_is_forgotten(monkeypatch):
    """Shingles just above the threshold, spread evenly or all at the end, over tasks of several stretches."""
    monkeypatch.setattr(nd, "RARE", 8)
    monkeypatch.setattr(nd, "STRETCH", 64)
    n = 640
    for place in (lambda k: k * n // 90, lambda k: n - 1 - k, lambda k: k):
        texts = [" ".join(f"own{i}x{j}" for j in range(6)) for i in range(n)]
        for k in range(90):  # 90 of 640 is more than 1/8
            texts[place(k)] += " a b c d e"
        batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 50]}) for i in range(0, n, 50)]
        (out,) = nd._local_frequencies(iter(batches))
        found = dict(zip(out.column("hash").to_pylist(), out.column("n").to_pylist()))
        frequent = nd.Shingles(["a b c d e"]).hash[0]
        assert found[-1] == n and 90 - n / 16 <= found[frequent] <= 90 and len(found) < 20 * 6 + n


def test_samples_agree_as_often_as_weights_overlap():
    a, b = "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n q r"
    hits = total = 0
    for i in range(300):
        s = nd.Shingles([" ".join(f"{w}{i}" for w in t.split()) for t in (a, b)])
        one = nd.Weights(np.zeros(0, np.int64), np.zeros(0), 2.0)
        w = one.of(s.hash, s.times)
        x = nd.bands(s, w)
        hits, total = hits + int((x[0] == x[1]).sum()), total + nd.BANDS
    j = 10 / 14
    assert abs(hits / total - j**nd.ROWS) < 0.05


def test_components_of_chains_and_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in nd.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_rare_shingles_weigh_by_their_own_frequency(spark):
    texts = [f"own{i} a{i} b{i} c{i} d{i}" for i in range(1200)] + ["p q r s t"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for t, n in ((texts[0], 1), (texts[-1], 2)):
        s = nd.Shingles([t])
        assert np.allclose(nd.weights_of(docs).of(s.hash, s.times), np.log1p(len(texts) / n))


def test_frequencies_are_moved_as_pieces_of_shards(monkeypatch):
    """A piece for each shard (more of large shards), not a row for each shingle; a shingle's counts over all pieces are its documents."""
    monkeypatch.setattr(nd, "TOGETHER", 20_000)
    monkeypatch.setattr(nd, "PIECE", 500)
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(200)) for _ in range(400)] + ["", None]
    batches = [pa.RecordBatch.from_pydict({"text": texts[a : a + 50]}) for a in range(0, len(texts), 50)]
    monkeypatch.setattr(nd.grams, "_CHUNK", 10_000)  # so that several stretches are counted
    rows = [x for b in nd._all_frequencies(3)(iter(batches)) for x in b.to_pylist()]
    counts, moved = {}, 0
    for x in rows:
        keys, n = np.frombuffer(x["keys"], np.int64), np.frombuffer(x["counts"], np.int32)
        assert len(keys) == len(n) <= 500 and (np.diff(keys) > 0).all() and (keys >> np.int64(61) == x["shard"]).all()
        moved += len(keys)
        for k, c in zip(keys.tolist(), n.tolist()):
            counts[k] = counts.get(k, 0) + c
    want = {}
    for t in texts:
        for h in set(nd.Shingles([t or ""]).hash.tolist()):
            want[h] = want.get(h, 0) + 1
    assert counts == {int(np.int64(h) << np.int64(12)): n for h, n in want.items()} and max(want.values()) > 1
    assert sum(x["documents"] for x in rows) == 400 and len(rows) < moved / 50


def test_near_copies_in_a_large_group_are_found(spark):
    """Copies make what they share frequent; the few edited words of each must not outweigh it."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(300):
        words = list(base)
        for k in (20, 90, 160):
            words[k + r.randrange(20)] = f"edit{i}x{k}"
        texts.append(" ".join(words))
    texts += [" ".join(f"o{i}x{k}" for k in range(20)) for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    w = nd.weights_of(docs)
    a, b = (nd.Shingles([t]) for t in texts[:2])
    assert nd.similarity(a.hash, w.idf(w.codes(a.hash)), b.hash, w.idf(w.codes(b.hash))) < 0.75 and nd.similarity(a.hash, w.of(a.hash, a.times), b.hash, w.of(b.hash, b.times)) > 0.8
    sizes = {row.doc_id: row.class_size for row in nd.classes(docs).collect()}
    assert all(n == (301 if i < 301 else 1) for i, n in sizes.items())


def test_blocks_link_by_the_exact_similarity(spark):
    """Shingles that weigh differently in two texts: the products of roots are only a bound."""
    r = np.random.default_rng(4)
    hashes = [np.sort(r.choice(40, 30, replace=False)).astype(np.int64) for _ in range(120)]
    times = [r.integers(1, 4, 30).astype(np.int32) for _ in hashes]
    codes = [r.integers(1, 60, 30).astype(np.int32) for _ in hashes]

    class Sent:
        value = nd.FullWeights(None, 100)

    n, raw = len(hashes), lambda parts: [x.tobytes() for x in parts]
    # Other texts' frequencies differ here, so that weights do.
    codes = [np.where(h < 30, 50 - h, c).astype(np.int32) for h, c in zip(hashes, codes)]
    group = pa.table({"i": [0] * n, "j": [0] * n, "block": [0] * n, "node": list(range(n)), "component": list(range(n)), "hashes": raw(hashes), "times": raw(times), "codes": raw(codes)})
    weights = [Sent.value.own(c) * t for c, t in zip(codes, times)]
    like = {(a, b) for a, b in combinations(range(n), 2) if nd.similarity(hashes[a], weights[a], hashes[b], weights[b]) >= 0.55}
    links = nd._compared(Sent, 0.55)(group)
    got = set(zip(links["a"].to_pylist(), links["b"].to_pylist()))

    def parts(pairs):
        top = list(range(n))
        for a, b in sorted(pairs) * n:
            top[a] = top[b] = min(top[a], top[b])
        return top

    assert got and {(min(p), max(p)) for p in got} <= like and parts(got) == parts(like)
