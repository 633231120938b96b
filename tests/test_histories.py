"""The signal ledger, change logs in tables and streams, versions of models, and portfolio filters against brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, changelog, ledger, model_store, portfolio
from tidemark.streaming import bars as st

SCAN = "strategy string, symbol string, bar_date date, score double, entry double, stop double, qty long, status string, reason string, place int"


def scan_of(spark, rows):
    return spark.createDataFrame([(s, x, d, 1.0, 2.0, 1.0, 5, "new" if ok else "rejected", None if ok else "earnings", 1 if ok else None) for s, x, d, ok in rows], SCAN)


def test_replays_replace_runs_and_deletes_cascade(spark, tmp_path):
    kept = ledger.Ledger(str(tmp_path / "signals"), str(tmp_path / "outcomes"))
    days = [date(2000, 1, i) for i in range(1, 7)]
    asked = spark.createDataFrame([(d,) for d in days], "day date")
    first = [("a", "X", days[0], True), ("a", "Y", days[0], False), ("b", "X", days[1], True), ("a", "X", days[2], True), ("a", "Z", date(1999, 1, 1), True)]
    signals = lambda: sorted((r.strategy, r.symbol, r.day, r.status) for r in kept.read(spark, "signal").collect())
    for _ in range(2):
        ledger.replay(kept, scan_of(spark, first), asked, ["a", "b"])
        assert signals() == sorted((s, x, d, "new" if ok else "rejected") for s, x, d, ok in first[:4])
        runs = {(r.strategy, r.day): (r.n_pass, r.n_reject, r.run_id) for r in kept.read(spark, "run").collect()}
        assert len(runs) == 12 and runs["a", days[0]][:2] == (1, 1) and runs["b", days[5]][:2] == (0, 0) and len({x[2] for x in runs.values()}) == 12
    # The rules have changed: one day's signals are gone, other days and strategies stay.
    ledger.replay(kept, scan_of(spark, []), asked.filter(F.col("day") == days[0]), ["a"])
    assert signals() == [("a", "X", days[2], "new"), ("b", "X", days[1], "new")]
    more = spark.createDataFrame([(d,) for d in [days[0], date(2000, 2, 1)]], "day date")
    assert [tuple(r) for r in ledger.missing(kept, spark, more, ["b"]).collect()] == [("b", date(2000, 2, 1))]
    ledger.note_outcomes(kept, kept.read(spark, "signal").select("strategy", "day", "symbol", F.lit(1.5).alias("pnl")))
    assert ledger.delete(kept, spark, "a", days[2], days[4]) == 4  # three runs and the outcomes of one
    assert signals() == [("b", "X", days[1], "new")] and [r.strategy for r in spark.read.parquet(kept.outcomes).collect()] == ["b"]
    assert {r.strategy: (r.latest, r.n_runs) for r in ledger.freshness(kept, spark).collect()} == {"a": (days[5], 3), "b": (days[5], 6)}
    for bad in ((None, days[0]), (days[0], None), (days[1], days[0])):
        with pytest.raises(ValueError):
            ledger.delete(kept, spark, "a", *bad)


class Note:
    """What a note's operations do, without the machine."""

    def __init__(self):
        self.there, self.revision, self.value, self.last = False, 0, None, None

    def do(self, seq, op, value):
        late = self.last is not None and seq <= self.last
        self.last = seq if self.last is None else max(seq, self.last)
        why = "out_of_order" if late else "unknown_operation" if op not in ("create", "update", "delete") else None
        if why is None and (op == "create") == self.there:
            why = f"{op}_when_{'there' if self.there else 'absent'}"
        if why is None:
            self.there, self.revision = op != "delete", self.revision + 1
            self.value = self.value if value is None else value
        return (seq, op, why is None, why, "there" if self.there else "absent", self.revision, self.value)


def random_log(seed, n=300):
    r = random.Random(seed)
    return [(r.randrange(12), i if r.random() > 0.1 else max(0, i - r.randrange(9)), r.choice(["create", "update", "update", "delete", "odd"]), r.choice([None, "x", "y"])) for i in range(n)]


LOG = "key long, seq long, op string, value string"


def test_a_log_folds_like_a_note(spark):
    rows = random_log(1) + [(None, 1, "create", "lost"), (3, None, "create", "lost")]
    want = []
    for k in range(12):
        note = Note()
        want += [(k, *note.do(*x[1:])) for x in sorted((x for x in rows if x[0] == k and x[1] is not None), key=lambda x: (x[1], x[2], x[3] or ""))]
    got = [tuple(r) for r in changelog.folded(spark.createDataFrame(rows, LOG), changelog.NOTES, "key").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {"out_of_order", "unknown_operation", "create_when_there", "delete_when_absent", None} <= {x[4] for x in want}
    current = {r.key: (r.state, r.revision) for r in changelog.current(spark.createDataFrame(got, f"key long, {changelog.OUT}"), "key", "absent").collect()}
    ends = {}
    for x in want:
        ends[x[0]] = x
    assert current == {k: (x[5], x[6]) for k, x in ends.items() if x[5] == "there"}


def test_a_stream_folds_like_the_table(spark, tmp_path):
    rows = [(k, i, op, v) for i, (k, _, op, v) in enumerate(random_log(2, 120))]
    for a in range(0, 120, 40):
        spark.createDataFrame(rows[a : a + 40], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.landed(spark, str(tmp_path / "in"), spark.createDataFrame([], LOG).schema)
    out = st.run_to_end(changelog.folded_stream(stream, changelog.NOTES, "key"), str(tmp_path / "state"), str(tmp_path / "out"))
    want = changelog.folded(spark.createDataFrame(rows, LOG), changelog.NOTES, "key")
    assert sorted(map(str, out.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_targets_fire_once_and_paper_positions_close_once():
    rows, _ = changelog.TARGETS.fold([(i, op, None) for i, op in enumerate(["fire", "set", "fire", "fire", "rearm", "fire", "clear", "set"])], "none", 0, None, None)
    assert [x[3] for x in rows] == ["fire_when_none", None, None, "fire_when_fired", None, None, None, None] and rows[-1][4] == "armed"
    rows, after = changelog.PAPER.fold([(i, op, v) for i, (op, v) in enumerate([("close", "1"), ("open", "10"), ("mark", None), ("close", "12"), ("close", "13"), ("open", "9")])], "absent", 0, None, None)
    assert [x[3] for x in rows] == ["close_when_absent", None, None, None, "close_when_closed", "open_when_closed"] and after == ("closed", 3, 5, "12")


def test_models_have_versions_and_refuse_other_inputs(spark, tmp_path):
    folder = str(tmp_path / "models")
    one, two = (boosting.Model(("a", "b"), ((0.5,), ()), (((0, 0, 1, 2, 0.0), (0, 0, -1, -1, -x), (0, 0, -1, -1, x)),)) for x in (1.0, 2.0))
    assert model_store.versions(spark, folder) == []
    with pytest.raises(ValueError):
        model_store.load(spark, folder)
    assert [model_store.save(spark, folder, m, {"auc": 0.6}) for m in (one, two)] == [1, 2]
    assert model_store.versions(spark, folder) == [1, 2] and model_store.load(spark, folder) == two and model_store.load(spark, folder, 1) == one
    assert model_store.describe(spark, folder, 1)["metrics"] == {"auc": 0.6}
    rows = spark.createDataFrame([(0.2, 1.0), (0.9, None)], "a double, b double")
    low, high = (r.p_win for r in model_store.score(spark, folder, rows, ["a", "b"]).orderBy("a").collect())
    assert (low, high) == (pytest.approx(0.1192, abs=1e-4), pytest.approx(0.8808, abs=1e-4))
    for other in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(model_store.Skew):
            model_store.score(spark, folder, rows, other)


def test_holdings_and_filters_as_of_each_day(spark):
    r, first = random.Random(4), date(2000, 1, 3)
    day = lambda i: first + timedelta(days=i)
    trades = [(f"S{r.randrange(30)}", day(a := r.randrange(90)), None if r.random() < 0.1 else day(a + r.randrange(0, 12)), 1000.0 * r.randrange(1, 60)) for _ in range(90)]
    days = [day(i) for i in range(0, 100) if i % 7 < 5]
    held = portfolio.held(spark.createDataFrame(trades, "symbol string, entry_date date, exit_date date, notional double"), spark.createDataFrame([(d,) for d in days], "day date"))
    want = {}
    for d in days:
        for s, a, b, n in trades:
            if a <= d and (b is None or d < b):
                k, m = want.get((d, s), (0, 0.0))
                want[d, s] = (k + 1, m + n)
    assert {(x.day, x.symbol): (x.positions, x.notional) for x in held.collect()} == want

    sectors = {f"S{i}": (None if i % 9 == 0 else f"sector{i % 3}") for i in range(30)}
    equity = [(day(i), 1e6 - (200_000.0 if 60 <= i < 63 else 0)) for i in range(0, 100, 3)]
    earnings = [("S1", day(20)), ("S2", day(50)), ("S2", day(53))]
    signals = [(f"S{r.randrange(30)}", r.choice(days), float(r.randrange(10, 60)), r.randrange(10, 3000)) for _ in range(400)] + [("S1", days[9], 10.0, 10)]
    signals = sorted(set(signals))
    volumes = [(f"S{i}", d, 1e5 if i % 5 == 0 else 1e7) for i in range(30) for d in days if i != 7]
    out = portfolio.filtered(
        spark.createDataFrame(signals, "symbol string, bar_date date, entry double, qty long"), held, spark.createDataFrame(list(sectors.items()), "symbol string, sector string"),
        spark.createDataFrame(equity, "as_of_date date, equity double"), spark.createDataFrame(earnings, "symbol string, report_date date"), spark.createDataFrame(volumes, "symbol string, bar_date date, adv double"),
    )
    adv = {(s, d): v for s, d, v in volumes}

    def brute(s, d, entry, qty):
        worth, now = entry * qty, max(x for x in equity if x[0] <= d)[1]
        peak = max(x[1] for x in equity if x[0] <= d)
        mine = {k[1]: v for k, v in want.items() if k[0] == d}
        if (peak - now) / peak > 0.15:
            return "drawdown"
        if s in mine:
            return "already_held"
        if any(x == s and 0 <= (e - d).days <= 7 for x, e in earnings):
            return "earnings"
        if sum(k for k, _ in mine.values()) >= 15:
            return "max_positions"
        if worth / now > 0.08:
            return "position_size"
        if sectors[s] and (sum(n for x, (_, n) in mine.items() if sectors[x] == sectors[s]) + worth) / now > 0.25 or not sectors[s] and worth / now > 0.25:
            return "sector"
        return "liquidity" if (s, d) in adv and worth / adv[s, d] > 0.05 else None

    got = sorted(tuple(x) for x in out.collect())
    assert got == sorted(((*x, brute(*x)) for x in signals))
    assert {x[4] for x in got} == {"drawdown", "already_held", "earnings", "max_positions", "position_size", "sector", "liquidity", None}
