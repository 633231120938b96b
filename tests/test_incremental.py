"""Merges by partition, the weekly aggregate, corporate actions, full-text search and boosted trees against brute force."""

import glob
import math
import os
import random
import re
from collections import defaultdict
from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import actions, boosting, fulltext, incremental, models
from tidemark.operators.stems import STOP, stem

BAR = "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume long"


def bars_of(symbols, days, seed=0, start=date(1999, 11, 1)):
    r = random.Random(seed)
    return [(s, start + timedelta(days=i), *[float(r.randrange(50, 150)) for _ in range(4)], None if r.random() < 0.1 else 1.0, r.randrange(1000)) for s in symbols for i in range(days)]


def written_years(path):
    return {os.path.basename(os.path.dirname(p)): os.path.getmtime(p) for p in glob.glob(f"{path}/year=*/*.parquet")}


def test_merge_rewrites_only_years_that_differ(spark, tmp_path):
    table = incremental.Table(str(tmp_path / "bars"), ("symbol", "bar_date"), "bar_date")
    rows = bars_of("AB", 800)
    assert incremental.merge(table, spark.createDataFrame(rows, BAR)).count() == 1600
    before = written_years(table.path)
    assert set(before) == {"year=1999", "year=2000", "year=2001", "year=2002"}
    assert incremental.merge(table, spark.createDataFrame(rows, BAR)).count() == 0
    assert written_years(table.path) == before
    new = [(*rows[100][:7], rows[100][7] + 1), rows[101], ("C", date(2000, 5, 5), 1.0, 2.0, 0.5, 1.5, None, 7), ("C", None, 1.0, 2.0, 0.5, 1.5, None, 7), (None, date(1999, 1, 1), 1.0, 2.0, 0.5, 1.5, None, 7)]
    changed = {tuple(r) for r in incremental.merge(table, spark.createDataFrame(new, BAR)).collect()}
    assert changed == {rows[100][:2], ("C", date(2000, 5, 5))}
    after = written_years(table.path)
    assert {y for y in after if after[y] != before.get(y)} == {"year=2000"}
    want = {r[:2]: r for r in rows} | {r[:2]: r for r in new[:3]}
    assert {tuple(r) for r in table.read(spark).select(*[c.split()[0] for c in BAR.split(", ")]).collect()} == set(want.values())


def test_a_replayed_backfill_leaves_the_same_table_and_weeks(spark, tmp_path):
    table = incremental.Table(str(tmp_path / "bars"), ("symbol", "bar_date"), "bar_date")
    weeks = incremental.Table(str(tmp_path / "weeks"), ("symbol", "week"), "week")
    ledger = str(tmp_path / "ledger")
    rows = bars_of("AB", 100)
    incremental.log_changes(ledger, incremental.backfill(table, spark.createDataFrame(rows[:80] + rows[100:190], BAR), "1990-01-01"), 0)
    incremental.refresh_weekly(table, weeks, ledger, spark)
    provider = spark.createDataFrame([(*r[:7], r[7] + 1) for r in rows] + bars_of("C", 10), BAR)
    results = []
    for batch in (1, 2):
        changed = incremental.backfill(table, provider, "1990-01-01")
        incremental.log_changes(ledger, changed, batch)
        refreshed = incremental.refresh_weekly(table, weeks, ledger, spark)
        results.append((changed.count(), refreshed.count(), sorted(map(str, table.read(spark).collect())), sorted(map(str, weeks.read(spark).collect()))))
    assert results[0][0] == 26 + 16 + 10 and results[1][:2] == (0, 0) and results[0][2:] == results[1][2:]
    assert results[1][3] == sorted(map(str, incremental.weekly(table.read(spark)).select(*weeks.read(spark).columns).collect()))
    assert not glob.glob(f"{ledger}/batch=*")
    # A crash before the ledger is emptied: the batch is there still and is done again.
    incremental.log_changes(ledger, provider.select("symbol", "bar_date"), 3)
    assert incremental.refresh_weekly(table, weeks, ledger, spark).count() == 0


def test_actions_chain_exactly_whatever_their_order(spark):
    bars = [("A", date(2000, 1, d), float(c), float(c) + 1, float(c) - 1, float(c), 100) for d, c in ((3, 90), (4, 99), (5, 33), (6, 30), (7, 10))]
    frame = spark.createDataFrame(bars, "symbol string, bar_date date, open double, high double, low double, close double, volume long")
    rows = [
        ("A", date(2000, 1, 5), "split", 3.0, None), ("A", date(2000, 1, 6), "cash_div", None, 3.0), ("A", date(2000, 1, 7), "split", 3.0, None), ("A", date(2000, 1, 7), "cash_div", None, 10.0),
        ("A", date(2000, 1, 4), "split", None, None), ("A", date(2000, 1, 3), "cash_div", None, 5.0), ("A", date(2000, 1, 6), "split", -1.0, None), ("B", date(2000, 1, 6), "split", 2.0, None),
    ]
    made = spark.createDataFrame(rows, "symbol string, ex_date date, kind string, ratio double, amount double")
    factors = {(r.symbol, r.ex_date.day): (r.factor, r.split) for r in actions.chain(made, frame).collect()}
    f7 = Fraction(1, 3) * (1 - Fraction(10, 30))
    f6 = f7 * (1 - Fraction(3, 33))
    assert factors == {("A", 7): (float(f7), float(Fraction(1, 3))), ("A", 6): (float(f6), 1 / 3), ("A", 5): (float(f6 / 3), 1 / 9), ("A", 4): (float(f6 / 3), 1 / 9), ("A", 3): (float(f6 / 3), 1 / 9), ("B", 6): (0.5, 0.5)}
    out = {r.bar_date.day: (r.close, r.volume, r.close_raw) for r in actions.adjusted(frame, actions.chain(made, frame)).collect()}
    assert out[7] == (10.0, 100.0, 10.0) and out[6] == (30 * float(f7), 100 / (1 / 3), 30.0) and out[3] == (90 * float(f6 / 3), 100 / (1 / 9), 90.0)


def test_a_late_action_adjusts_only_bars_before_it(spark, tmp_path):
    bars = spark.createDataFrame(bars_of("AB", 900), BAR).drop("adj_close")
    first = [("A", date(2001, 6, 1), "split", 2.0, None)]
    late = [("A", date(2000, 6, 1), "split", 3.0, None)]
    make = lambda rows: spark.createDataFrame(rows, "symbol string, ex_date date, kind string, ratio double, amount double")
    table = incremental.Table(str(tmp_path / "adjusted"), ("symbol", "bar_date"), "bar_date")
    incremental.merge(table, actions.adjusted(bars, actions.chain(make(first), bars)))
    before = written_years(table.path)
    changed = actions.readjust(table, bars, make(first + late), make(late))
    assert changed.agg(F.min("symbol"), F.max("symbol"), F.max("bar_date")).first()[:] == ("A", "A", date(2000, 5, 31))
    after = written_years(table.path)
    assert {y for y in after if after[y] != before[y]} == {"year=1999", "year=2000"}
    whole = actions.adjusted(bars, actions.chain(make(first + late), bars))
    assert sorted(map(str, table.read(spark).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


PUBLISHED = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consistency": "consist", "consistently": "consist", "consolation": "consol",
    "consolatory": "consolatori", "consolingly": "consol", "conspicuous": "conspicu", "conspiracy": "conspiraci", "conspirators": "conspir", "constables": "constabl", "constancy": "constanc",
    "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "kneeling": "kneel", "knightly": "knight", "knitting": "knit", "knives": "knive", "knocked": "knock",
    "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "luxuriating": "luxuri", "hopping": "hop", "hoping": "hope", "bed": "bed", "by": "by", "say": "say", "cry": "cri",
    "rational": "ration", "relational": "relat", "hopefulness": "hope", "generously": "generous", "communities": "communiti", "dying": "die", "skies": "sky", "news": "news", "inning": "inning", "proceed": "proceed",
    "happy": "happi", "agreed": "agre", "feed": "feed", "plotted": "plot", "controlling": "control", "rolled": "roll", "adoption": "adopt", "probate": "probat", "formative": "format", "electricity": "electr",
}


def test_stems_are_the_published_ones():
    assert {w: stem(w) for w in PUBLISHED} == PUBLISHED


def test_search_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    words = ["markets", "market", "marketing", "falls", "falling", "the", "and", "rates", "rate", "x1", "über"]
    texts = [None, "", "The and"] + [" ".join(r.choice(words) + r.choice(["", ",", "."]) for _ in range(r.randint(1, 300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    index = fulltext.build(docs, ["id"], F.col("body"), str(tmp_path / "index"))

    def brute(query):
        stems = sorted({stem(w) for w in query.lower().split() if w not in STOP})
        out = {}
        for i, t in enumerate(texts):
            at = defaultdict(list)
            for p, w in enumerate(re.findall(r"[a-z0-9à-ÿ]+", (t or "").lower()), 1):
                if w not in STOP:
                    at[stem(w)].append(p)
            if stems and all(at[s] for s in stems):
                if len(stems) == 1:
                    out[i] = sum(0.1 / k**2 for k in range(1, len(at[stems[0]]) + 1)) / 1.64493406685
                else:
                    rest = 1.0
                    for a in range(len(stems)):
                        for b in range(a):
                            for p in at[stems[a]]:
                                for q in at[stems[b]]:
                                    d = abs(p - q)
                                    rest *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
                    out[i] = 1 - rest
        return out

    for query in ("market", "falling markets", "the RATE of x1 market", "über", "absent", "the and"):
        got = {r.id: r["rank"] for r in fulltext.search(index, spark, query).collect()}
        assert got == pytest.approx(brute(query), abs=1e-9)
    plan = index.postings(spark, ["market"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:80] and "stem" in plan.split("PushedFilters")[1][:120]
    assert fulltext.build(docs.limit(0), ["id"], F.col("body"), str(tmp_path / "none")) is not None


def test_fragments_mark_words_of_all_forms():
    words = "one two three four five six seven eight nine ten eleven twelve thirteen markets fell and market rates rose again".split()
    got = fulltext.fragments(words, {"market", "rate"})
    assert "<b>markets</b>" in got and "<b>market</b> <b>rates</b>" in got and len(got.split()) <= 32
    assert fulltext.fragments(["market"], {"market"}) == "<b>market</b>"
    assert fulltext.fragments(["x"] * 40, {"market"}) == ""
    far = ["market"] + ["x"] * 60 + ["rate"]
    assert fulltext.fragments(far, {"market", "rate"}).count(" ... ") == 1


def brute_trees(x, y, cuts, p):
    """The same booster over lists, row by row."""
    bins = [[sum(c < v for c in cuts[f]) for f, v in enumerate(row)] for row in x]
    won = sum(y)
    w = [(len(y) - won) / won if t else 1.0 for t in y]
    margin, trees = [0.0] * len(y), []
    for _ in range(p.trees):
        gh = []
        for m, t, k in zip(margin, y, w):
            q = 1 / (1 + np.exp(-np.float64(m)))
            gh.append((int(np.rint((q - t) * k * boosting.SCALE)), int(np.rint(q * (1 - q) * k * boosting.SCALE))))

        def value(rows):
            return -p.step * (sum(gh[i][0] for i in rows) / boosting.SCALE) / (sum(gh[i][1] for i in rows) / boosting.SCALE + p.penalty)

        def score(rows):
            return (sum(gh[i][0] for i in rows) / boosting.SCALE) ** 2 / (sum(gh[i][1] for i in rows) / boosting.SCALE + p.penalty)

        tree, level = [[0, 0, -1, -1, value(range(len(y)))]], [(0, list(range(len(y))))]
        for _ in range(p.depth):
            following = []
            for node, rows in level:
                best = None
                for f in range(len(cuts)):
                    for b in range(boosting.BINS - 1):
                        left = [i for i in rows if bins[i][f] <= b]
                        right = [i for i in rows if bins[i][f] > b]
                        if min(sum(gh[i][1] for i in s) for s in (left, right)) < p.least_weight * boosting.SCALE:
                            continue
                        gain = score(left) + score(right) - score(rows)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, f, b, left, right)
                if best:
                    tree[node][:4] = [best[1], best[2], len(tree), len(tree) + 1]
                    for s in best[3:]:
                        following.append((len(tree), s))
                        tree.append([0, 0, -1, -1, value(s)])
            level = following
        trees.append(tuple(map(tuple, tree)))
        for i, b in enumerate(bins):
            at = 0
            while tree[at][2] >= 0:
                at = tree[at][2] if b[tree[at][0]] <= tree[at][1] else tree[at][3]
            margin[i] += tree[at][4]
    return tuple(trees)


def test_trees_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BINS", 8)
    monkeypatch.setattr(boosting, "TASK_ROWS", 40)
    monkeypatch.setattr(boosting, "BLOCKS", 2)
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    r = random.Random(2)
    x = [(r.random(), float(r.randrange(3)), 1.0) for _ in range(150)]
    y = [int(a + 0.3 * b + r.gauss(0, 0.3) > 0.9) for a, b, _ in x]
    df = spark.createDataFrame([(*a, t) for a, t in zip(x, y)] + [(0.5, 1.0, 1.0, None)], "a double, b double, c double, label int")
    p = boosting.Params(trees=5, depth=3, step=0.3, least_weight=2.0)
    model = boosting.fit(df, ["a", "b", "c"], p)
    assert model.cuts[2] == ()
    want = brute_trees(x, y, model.cuts, p)
    assert [[n[:4] for n in t] for t in model.trees] == [[n[:4] for n in t] for t in want]
    assert np.allclose([n[4] for t in model.trees for n in t], [n[4] for t in want for n in t])
    assert boosting.Model.from_json(model.to_json()) == model
    monkeypatch.setattr(boosting, "TASK_ROWS", 1000)  # one task grows them all
    alone = boosting.fit(df, ["a", "b", "c"], p)
    assert [[n[:4] for n in t] for t in alone.trees] == [[n[:4] for n in t] for t in model.trees]
    assert np.allclose([n[4] for t in alone.trees for n in t], [n[4] for t in model.trees for n in t], rtol=1e-12)
    scored = boosting.score(model, df).collect()
    assert all(0 <= s.p_win <= 1 for s in scored)
    with pytest.raises(ValueError):
        boosting.score(model, df.drop("b"))
    with pytest.raises(boosting.TooFewRows):
        boosting.fit(df.limit(50), ["a"])


def test_only_the_lighter_of_two_sides_is_added_up():
    r = np.random.default_rng(3)
    columns = r.integers(0, boosting.BINS, (3, 4000)).astype(np.uint8)
    label = columns[0] + columns[1] + r.normal(0, 20, 4000) > 64
    g, h = boosting.derivatives(np.zeros(4000), label, np.ones(4000))
    asked = []

    def histograms(tree, nodes):
        asked.append(len(nodes))
        return boosting._block(tree, nodes, boosting.BINS, columns, g, h)

    tree = boosting.grown(histograms, boosting.Params())
    assert asked == [1, 1, 2, 4] and len(tree) > 20


def test_training_labels_end_before_the_newer_rows(spark):
    rows = [(s, date(2000, 1, 1) + timedelta(days=i)) for s in "AB" for i in range(100)]
    df = models.with_reach(spark.createDataFrame(rows, "symbol string, bar_date date"))
    older, newer = models.split(df, "bar_date", 0.2, "reach")
    cut = newer.agg(F.min("bar_date")).first()[0]
    assert older.agg(F.max("reach")).first()[0] < cut and older.agg(F.max("bar_date")).first()[0] == cut - timedelta(days=21)


def test_bars_are_made_again_of_changed_files(spark, tmp_path):
    from tidemark.sources import driver

    lines = lambda q: spark.createDataFrame([(1, 1, 1, 5, q, date(2000, 1, 3))], "l_orderkey long, l_suppkey long, l_linenumber int, l_partkey long, l_quantity double, l_shipdate date")
    for q in (3.0, 4.0):
        lines(q).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        for _ in range(2):
            assert [r.volume for r in driver.bars(spark, str(tmp_path)).collect()] == [1000 * int(q)]


def test_passes_start_from_the_scores_after_the_tree_before(spark, monkeypatch):
    """A pass follows no tree: before, that of each level followed all trees since the scores were last kept."""
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    monkeypatch.setattr(boosting, "WRITE_EVERY", 3)
    r = random.Random(8)
    rows = spark.createDataFrame([(a := float(r.randrange(20)), float(r.randrange(20)), int(r.random() < a / 20)) for _ in range(400)], "a double, b double, label int")
    seen, whole = [], boosting._histograms

    def spied(data, *args):
        seen.append((len(args[0]), data.collect()))
        return whole(data, *args)

    monkeypatch.setattr(boosting, "_histograms", spied)
    model = boosting.fit(rows, ["a", "b"], boosting.Params(7, 2, 0.3, 1.0, 1.0, 10))
    done = -1
    for tree, chunks in seen:
        done += tree == 0
        assert sum(len(c[1]) for c in chunks) == 400
        for columns, _, margin in chunks:
            assert (margin == boosting.margins(model.trees[:done], columns.T)).all()
    assert done == 6 and len(seen) == 14
