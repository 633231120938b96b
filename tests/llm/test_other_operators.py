import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import parity
from tidemark.llm import chat, common, packing, queries, sharding, topk, url_filter

# Top-k


def test_of_repeated_query_ids_the_vector_of_least_hash_counts(spark):
    rows = [(0, [1, 0]), (0, [0, 1]), (1, [3, 0]), (2, [0, 5])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    first = df.filter("id = 0").orderBy(F.xxhash64("v")).first().v
    (best,) = topk.top_k(df.filter("id = 0"), df.filter("id > 0"), 1).collect()
    assert (best.vec_id, best.score) == ((1, 3) if list(first) == [1, 0] else (2, 5))


def brute_top_k(rows, k):
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % 20 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in v if c != q and len(a) == len(b)))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("case", ["many", "ties", "few", "large"])
def test_top_k_equals_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "TILE", 3)
    r = random.Random(3)
    rows = {
        "many": [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(700)] + [(1001, None), (1002, [1.0, None] * 4), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, [0.1] * 8), (1005, []), (1020, [0.5] * 5), (1021, [0.25] * 5)],
        "ties": [(i, [0.5, -0.25]) for i in range(500)] + [(600 + i, [0.25, 0.5]) for i in range(41)],
        "few": [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (3, [0.0, 0.0])],
        "large": [(i, [r.uniform(-1e5, 1e5) for _ in range(3)]) for i in range(100)],
    }[case]
    df = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 64)
    got = sorted(tuple(x) for x in topk.top_k(df.filter(F.col("id") % 20 == 0), df, 20).collect())
    assert got == brute_top_k(rows, 20)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v array<long>")
    assert topk.top_k(df, df, 20).count() == 0


# Sharding


def brute_shard(key, weights):
    def score(i, w):
        u = (int(hashlib.md5(f"{key}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -w / math.log(u)

    return max((score(i, w), -i) for i, w in enumerate(weights) if w > 0)[1] * -1


def test_shards(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(4000)] + [(None, "n"), (7, "t7"), (7, "t7")], "doc_id long, slot string")
    df = df.withColumnRenamed("slot", "text")
    got = sharding.assign(df, "doc_id", 8).collect()
    assert all(r.shard == brute_shard("" if r.doc_id is None else r.doc_id, [1.0] * 8) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    grown = {r.doc_id: r.shard for r in sharding.assign(df, "doc_id", 9).collect()}
    moved = [r for r in got if grown[r.doc_id] != r.shard]
    assert moved and all(grown[r.doc_id] == 8 for r in moved) and len(moved) < len(got) / 5


def test_weights_and_edges(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    counts = {r.shard: r["count"] for r in sharding.assign(df, "k", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and 2.7 < counts[1] / counts[0] < 3.3
    assert sharding.assign(df.limit(0), "k", 8).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(df, "k", [0.0])
    with pytest.raises(ValueError):
        sharding.assign(df, "k", [1.0, float("nan")])


def test_crc_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit("hello").cast("binary"))).first()[0] == zlib.crc32(b"hello")


# URL rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", None, "block"), ("a.org", "/fr/x", "allow"), (None, "/", "block")]
URLS = [
    "http://example.net/en/1", "http://www.EXAMPLE.net/de/1", "https://net/", "https://net", "ftp://x.net?q=/", "http://notnet/", "http://example.com/de/", "http://example.com/den", "http://b.a.org/fr/xy#z",
    "http://a.org", "http://a.org/fr/", "http://xa.org/fr/?a", "no scheme", "", None, "x://", "http:///path", "a://b://c.net/d", "http://user@h.net:80/p", "http://exämple.net/en/", "http://example.net./en/", "http://x.net/a\nb",
]


def brute_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + (p or "")), len(h), h + (p or ""), a) for h, p, a in RULES if h and host and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("parts", [1, 7])
def test_rules_equal_brute_force(spark, parts, monkeypatch):
    rows = [(i, u, "v") for i, u in enumerate(URLS)] + [(1000 + i, "http://hot.example.net/en/same", "v") for i in range(500)] + [(None, URLS[0], "v"), (0, URLS[0], "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = sorted((tuple(r) for r in url_filter.judge(pages, rules).collect()), key=str)
    assert got == sorted(((i, *brute_judge(u)) for i, u, _ in rows), key=str)


def test_rules_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    assert tuple(url_filter.judge(pages, none).first()) == (1, "a.net", "/", None, "allow")
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(RULES, none.schema)).count() == 0


def test_many_nested_rules(spark):
    r = random.Random(2)
    rules = list({(".".join(r.choice("abc") for _ in range(r.randint(1, 4))), "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 4)))): None for _ in range(300)})
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in rules]
    urls = [(i, "http://" + ".".join(r.choice("abc") for _ in range(r.randint(1, 5))) + "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 6)))) for i in range(800)]
    got = {x.page_id: x.rule for x in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    for i, u in urls:
        host, _, path = u[7:].partition("/")
        fits = [(len(h + p), len(h), h + p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == max(fits, default=(0, 0, None))[2]


def test_long_hosts_and_deep_rules(spark):
    host = ".".join(["a"] * 8000)
    rules = [(".".join(["a"] * n), "/" * (n % 3), "block") for n in range(1, 40)]
    pages = spark.createDataFrame([(1, f"http://{host}//x"), (2, "http://" + "." * 100_000 + "/"), (3, "http://a.a/")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {1: ".".join(["a"] * 39), 2: None, 3: "a/"}  # of two of 77 characters that of the longer host


def test_hot_urls_are_dealt_without_changing_results(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    pages = spark.createDataFrame([(i, URLS[8] if i % 2 else f"http://x{i}.net/") for i in range(200)], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(pages, spark.createDataFrame(RULES, "host string, path string, action string")).collect()}
    assert got == {i: "a.org/fr/x" if i % 2 else "net/" for i in range(200)}


# Packing


def brute_padding(lengths, counts, k):
    n = len(lengths)
    best = math.inf
    for m in range(min(k, n)):
        for cuts in combinations(range(1, n), m):
            borders, total = [*cuts, n], 0
            for a, b in zip([0, *borders[:-1]], borders):
                total += sum((lengths[b - 1] - x) * c for x, c in zip(lengths[a:b], counts[a:b]))
            best = min(best, total)
    return best


def test_borders_are_optimal():
    r = random.Random(4)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 200), r.randint(1, 9)))
        counts = [r.randint(1, 50) for _ in lengths]
        k = r.randint(1, 5)
        borders = packing.best_borders(lengths, counts, k)
        padding = sum((min(b for b in borders if b >= x) - x) * c for x, c in zip(lengths, counts))
        assert len(borders) <= k and borders[-1] == lengths[-1] and padding == brute_padding(lengths, counts, k)


def test_batches(spark):
    r = random.Random(6)
    rows = [(i, min(int(r.paretovariate(1.1) * 20), 5000), "b") for i in range(3000)] + [(None, 7, "b"), (5, None, "b"), (5, -3, "b"), (9, 100_000, "b"), (9, 100_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, n long, batch string")
    out = packing.pack(df, "n", "doc_id", buckets=6, budget=8192).collect()
    assert len(out) == len(rows) and len({r.bucket for r in out}) <= 6
    batches = {}
    for x in out:
        assert max(x.n or 0, 0) <= x.bucket_length
        batches.setdefault((x.bucket, x.batch), []).append(x)
    for (b, _), members in batches.items():
        assert sorted(m.place for m in members) == list(range(len(members)))
        assert len(members) * members[0].bucket_length <= 8192 or len(members) == 1
    for b in {b for b, _ in batches}:
        numbers = sorted(n for c, n in batches if c == b)
        sizes = [len(batches[b, n]) for n in numbers]
        assert numbers == list(range(len(numbers))) and len(set(sizes[:-1])) <= 1


def test_packing_of_nothing_and_many_lengths(spark, monkeypatch):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "n", "doc_id").count() == 0
    monkeypatch.setattr(packing, "STEP", 50)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") * 7).alias("n"))
    assert packing.pack(df, "n", "doc_id", buckets=4).filter("n > bucket_length").count() == 0


def test_one_long_text_leaves_the_borders_of_least_padding(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP", 50)
    lengths = [*range(1, 301), 5_000_000]
    counts = [1 + (7 * x) % 5 for x in lengths]
    df = spark.createDataFrame([(i, x) for i, (x, c) in enumerate((x, c) for x, c in zip(lengths, counts) for _ in range(c))], "doc_id long, n long")
    got = packing.pack(df, "n", "doc_id", buckets=4).agg(F.sum(F.col("bucket_length") - F.col("n"))).first()[0]
    c, t = [0], [0]
    for x, k in zip(lengths, counts):
        c.append(c[-1] + k), t.append(t[-1] + x * k)
    best = [0] + [math.inf] * len(lengths)
    for _ in range(4):
        best = [0] + [min(best[i] + lengths[j - 1] * (c[j] - c[i]) - (t[j] - t[i]) for i in range(j)) for j in range(1, len(best))]
    assert got == best[-1]


def test_the_query_packs_with_least_padding(spark, tmp_path):
    r = random.Random(9)
    texts = ["word " * min(int(r.paretovariate(1.2) * 3), 400) for _ in range(300)] + [None, "", "one, two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_packing(spark, str(tmp_path)).collect()
    lengths = [len(re.findall(r"\w+|[^\w\s]", t or "")) for t in texts]
    assert {x.doc_id: x.n_tokens for x in out} == dict(enumerate(lengths))
    sizes, best = sorted(set(lengths)), {}

    def least(i, k):
        """Padding of the sizes from i on in k buckets, by trying every next border."""
        if i == len(sizes):
            return 0
        if not k:
            return math.inf
        if (i, k) not in best:
            best[i, k] = min(sum((sizes[j] - x) for x in lengths if sizes[i] <= x <= sizes[j]) + least(j + 1, k - 1) for j in range(i, len(sizes)))
        return best[i, k]

    assert sum(x.bucket_length - x.n_tokens for x in out) == least(0, 16)


def test_word_tokens(spark):
    df = spark.createDataFrame([("Hello, world!",), ("",), (None,), ("naïve  2 b's",)], "t string")
    assert [r[0] for r in df.select(packing.word_tokens(F.col("t"))).collect()] == [4, 0, 0, 5]


# Chat

COLUMNS = "conv_id long, turn long, role string, text string"


def plain(line):
    return " ".join(line.lower().split())


def parts(text):
    """(depth, set of line numbers, said) of every passage and line of a text."""
    found, run, before = [], None, None
    for at, raw in enumerate((text or "").split("\n")):
        marks = re.match(r"[ \t]*(?:>[ \t]*)+", raw)
        depth, line = (marks.group().count(">"), raw[marks.end() :]) if marks else (0, raw)
        if not line.strip():
            run = before = None
            continue
        if run is None or depth != before:
            run, before = [depth, set(), []], depth
            found.append(run)
        run[1].add(at), run[2].append(line)
        found.append((depth, {at}, [line]))
    return [(d, ats, plain(" ".join(ls))) for d, ats, ls in found]


def brute_link(rows):
    """turn-level links, bodies and reading order of messages (conv_id, turn, role, text), by loops over all of them."""
    out, replies = [], {}
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    for c, t, _, text in known:
        said, gone = {}, set()
        for d, ats, what in parts(text):
            if d:
                origin = min((u for k, u, _, other in known if k == c and any(x == 0 and w == what for x, _, w in parts(other))), default=None)
                if origin is not None and origin < t:
                    gone |= ats
                    said[d, what] = origin
        replies.setdefault((c, t), []).append((said, gone, text))
    up = {}
    for key, many in replies.items():
        votes = Counter((d, origin) for said, _, _ in many for (d, _), origin in said.items())
        if votes:
            up[key] = min(votes, key=lambda x: (x[0], -votes[x], -x[1]))[1]

    def path(c, t):
        return path(c, up[c, t]) + [t] if (c, t) in up else [t]

    for c, t, role, text in rows:
        gone = next((g for _, g, x in replies.get((c, t), []) if x == text), set())
        body = "\n".join(line for i, line in enumerate((text or "").split("\n")) if i not in gone).strip(" \t\r\n")
        way = path(c, t) if (c, t) in replies else [t]
        out.append((c, t, role, text, body, up.get((c, t)), way, hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def sound(linked):
    return Counter((r.conv_id, r.turn, r.role, r.text, r.body, r.reply_to, r.thread_turn, r.reply_depth, r.position) for r in linked.collect())


def expected(rows):
    found, out = brute_link(rows), Counter()
    for c in {r[0] for r in rows}:
        mine = sorted((x for x in found if x[0] == c), key=lambda x: ([(p is not None, p or 0) for p in x[6]], x[2] is not None, x[2] or "", x[7]))
        for i, (conv, t, role, text, body, to, way, _) in enumerate(mine):
            out[conv, t, role, text, body, to, way[0], len(way) - 1, i] += 1
    return out


def threads(seed, n):
    """Messages that quote each other at several depths, with both line ends, code and quotes of nothing."""
    r = random.Random(seed)
    rows = []
    for c in range(4):
        texts = []
        for t in range(n):
            lines = [f"c{c} says thing {r.randrange(12)}" if r.random() < 0.3 else f"line {c} {t} {i}" for i in range(r.randint(1, 3))]
            if texts and r.random() < 0.8:
                quoted = [f"{r.choice(['>', '> ', ' >'])}{line}" if r.random() < 0.9 else line for line in r.choice(texts).replace("\r", "").split("\n")]
                lines = quoted + ([""] if r.random() < 0.5 else []) + lines
            if r.random() < 0.3:
                lines += [">>> print(1)", "> nobody said so", ">", "a > b"]
            texts.append(r.choice(["\n", "\n", "\r\n"]).join(lines))
            rows.append((c, t, r.choice(["user", "bot", None]), texts[-1]))
    return rows


CASES = {
    "by hand": [
        (1, 0, "user", "Hello all.\nHow are you?"), (1, 1, "bot", "I am fine."), (1, 2, "user", "> Hello all.\n> How  are YOU?\n\nGood too."), (1, 3, "bot", ">> Hello all.\n>> How are you?\n> Good too.\nGreat!"),
        (1, 4, "user", "> never said\nWhat?"), (1, 5, "bot", "> I am fine.\nStill?"), (2, 0, "user", "> I am fine."), (2, 1, "user", None), (None, 3, "user", "> x"), (3, None, "user", ""), (1, 1, "bot", "I am fine."),
    ],
    "line ends and code": [(1, 0, "a", "hello there my friend"), (1, 1, "b", "> hello there my friend\r\nyes"), (1, 2, "a", "run this:\n>>> print(1)\n1"), (1, 3, "b", "if a\n> b then c"), (1, 4, None, "> hello there my friend"), (1, 4, "c", "> yes\nno")],
    "many": threads(1, 40),
    "one long chain": [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(300)],
    "a star with branches": [(1, 0, "u", "root")] + [(1, i, "u", f"> {'root' if i % 3 else f'word {i - 1 - i % 2}'}\nword {i}") for i in range(1, 200)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_links_equal_brute_force_and_sql(spark, case, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    spark.createDataFrame(CASES[case], COLUMNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    linked = chat.link(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    assert sound(linked) == expected(CASES[case])
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    parity.compare(linked, con, queries.OP6_SQL)


def test_bodies_keep_what_nobody_said(spark):
    out = {r.turn: r.body for r in chat.link(spark.createDataFrame(CASES["line ends and code"], COLUMNS)).collect() if r.turn != 4}
    assert out == {0: "hello there my friend", 1: "yes", 2: "run this:\n>>> print(1)\n1", 3: "if a\n> b then c"}


def test_conversations_in_parts_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, "keep", "own") for r in CASES["many"]], COLUMNS + ", body string, __key string")
    linked = chat.link(df)
    assert {r["__key"] for r in linked.collect()} == {"own"}
    rows = chat.conversations(linked, 16).collect()
    assert len(rows) == 4 * 3 and all([t.position for t in r.turns] == list(range(16 * r.part, min(16 * r.part + 16, 40))) for r in rows)
    assert chat.link(spark.createDataFrame([], COLUMNS)).count() == 0
