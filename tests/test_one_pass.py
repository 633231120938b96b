"""Work that grows with the bars is done once: no second pass, exchange or moving window beside the grouped map by symbol."""

import glob
import math
import os
import statistics
import tracemalloc
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.operators import actions, fulltext, incremental, ledger, trading
from tidemark.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_replay_scans_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    day = date(2000, 1, 3)
    rows = [("x", f"S{i}", day, 0.5, 10.0, 9.0, 5, "new" if i % 2 else "rejected", None, i) for i in range(6)]
    schema = "strategy string, symbol string, bar_date date, score double, entry double, stop double, qty long, status string, reason string, place int"
    scanned = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    kept = ledger.Ledger(f"{tmp_path}/signals", f"{tmp_path}/outcomes")
    ledger.replay(kept, scanned, spark.createDataFrame([(day,), (day + timedelta(days=1),)], "day date"), ["x"])
    assert seen.value == len(rows)
    assert {(r.day, r.n_pass, r.n_reject) for r in kept.read(spark, "run").collect()} == {(day, 3, 3), (day + timedelta(days=1), 0, 0)}
    assert kept.read(spark, "signal").count() == len(rows)


def test_model_inputs_need_no_window(spark):
    """Returns, deviations, labels and reaches come with the grouped map; what is there already is not made again."""
    days = [date(2000, 1, 3) + timedelta(days=i) for i in range(80)]
    closes = [100.0 + (i * 7 % 11) + (i > 70) * 3 - (i > 74) * 30 for i in range(80)]
    rows = [("A", d, c, c + 1, c - 1, c, i + 1, 50.0, 50.0, 2.0, None) for i, (d, c) in enumerate(zip(days, closes))]
    rows += [("B", d, 10.0, 10.0, 10.0, 10.0, i + 1, 50.0, 50.0, 2.0, None) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, rn int, rsi14 double, rsi2 double, atr14 double, signal_score double")
    regime = spark.createDataFrame([], "bar_date date, label string, composite double, credit_stress boolean")
    made = trading.ml_features(bars, regime)
    assert "Window" not in plan_of(made)
    at = {(r.symbol, r.rn): r for r in made.collect()}
    assert abs(at["A", 80].ret63 - (closes[79] / closes[16] - 1)) < 1e-12 and at["A", 60].ret63 == 0.0
    logs = [math.log(closes[i] / closes[i - 1]) for i in range(75, 80)]
    assert abs(at["A", 80].vol5 - statistics.stdev(logs) * 252**0.5) < 1e-12
    assert at["B", 80].vol5 == 0.20 and at["B", 80].closeness == 1.0 and at["A", 4].closeness == 0.85
    labelled = ta.with_recursive(bars, ["barrier_25_20_20", "reach20"])
    want = trading.triple_barrier(bars, F.col("close") - 2.5 * F.col("atr14"), F.col("close") + 2.0 * F.col("atr14"))
    assert {(r.symbol, r.rn, r.barrier_25_20_20) for r in labelled.collect()} == {(r.symbol, r.rn, r.label) for r in want.collect()}
    reach = {(r.symbol, r.rn): r.reach20 for r in labelled.collect()}
    assert reach["A", 1] == days[20] and reach["B", 70] == days[79]


def test_ratchets_read_the_bars_once(spark):
    """No join of positions with bars, and steps beyond a symbol's last bar don't exist; unknown levels leave the stop."""
    days = [date(2000, 1, 3) + timedelta(days=i) for i in range(20)]
    rows = [("A", d, 10.0 + i, 9.0 if i in (0, 12, 19) else None, None if i == 9 else 8.0 + i) for i, d in enumerate(days)] + [("B", days[0], 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, bar_date date, close double, stop double, lev double")
    got = trading.ratcheted(df, F.col("lev"), 4, 12)
    assert "Join" not in plan_of(got) and "Window" not in plan_of(got)
    want = [(days[1], days[5], 13.0, 13.0), (days[1], days[9], None, 13.0), (days[1], days[13], 21.0, 21.0), (days[13], days[17], 25.0, 25.0)]
    assert sorted((r.entry_date, r.bar_date, r.level, r.stop) for r in got.collect()) == want


def test_volatility_ranks_need_no_exchange(spark):
    df = QUERIES["compute_volatility"](spark, SMALL)
    assert "Exchange" not in plan_of(df) and "Window" not in plan_of(df)


def test_signals_need_no_exchange(spark):
    for name in ("sig_momentum52", "sig_rsi2"):
        df = QUERIES[name](spark, SMALL)
        assert "Exchange" not in plan_of(df) and "Window" not in plan_of(df)


def test_postings_are_put_together_where_texts_are_read(spark, tmp_path):
    """A stem of a document is one row before the shuffle; rows of one id are still one document."""
    got = fulltext.places.func(pd.Series([["things", "thing", "other"], []]), pd.Series([[1, 4, 7], []]))
    assert list(got) == [[{"stem": "thing", "at": [1, 4]}, {"stem": "other", "at": [7]}], []]
    docs = spark.createDataFrame([(1, "things red thing"), (1, "blue thing x1 x2 x3"), (2, None), (3, "red")], "id long, text string")
    index = fulltext.build(docs, ["id"], F.col("text"), f"{tmp_path}/index")
    rows = {(r.stem, r.id): (r.n_words, r.positions) for r in index.postings(spark, ["thing", "red"]).collect()}
    assert rows == {("thing", 1): (5, [1, 2, 3]), ("red", 1): (3, [2]), ("red", 3): (1, [1])}


def test_words_of_a_batch_are_held_in_bounded_pieces(spark, tmp_path):
    """A batch of many documents is taken piece by piece, with the same postings; a worker held all its words before (1.7 GB for 10,000 documents)."""
    docs = [(i, " ".join(f"word{(i * 7 + k) % 900}s" for k in range(400))) for i in range(3000)] + [(3000, None)]
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int32()), ("stem", pa.string()), ("__at", pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in docs], "__text": [t for _, t in docs]})
    seen, rows = {}, 0
    tracemalloc.start()
    for piece in fulltext._postings(schema)(iter([batch])):
        rows += piece.num_rows
        seen |= {(piece["id"][k].as_py(), piece["stem"][k].as_py()): piece["__at"][k].as_py() for k in (0, piece.num_rows - 1)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 * 400 and len(seen) > 20 and seen[0, "word0"] == [1] and peak < 200e6
    same = spark.createDataFrame(docs[:40], "id long, text string").repartition(3)
    index = fulltext.build(same, ["id"], F.col("text"), f"{tmp_path}/index")
    files = [pq.read_table(part, partitioning=None).column("stem").to_pylist() for part in glob.glob(f"{tmp_path}/index/*/*.parquet")]
    assert sum(map(len, files)) == 40 * 400 and all(stems == sorted(stems) for stems in files)
    assert index.postings(spark, ["word7"]).filter("id = 1").first()["positions"] == [1]


def test_adjusted_bars_are_not_moved_to_their_actions(spark, tmp_path):
    """Steps meet the bars as arrays, not in a sorted union; a first merge writes the table without staging it twice."""
    days = [date(2000, 1, 3) + timedelta(days=i) for i in range(6)]
    bars = spark.createDataFrame([(s, d, *[8.0] * 4, 100) for s in "AB" for d in days], "symbol string, bar_date date, open double, high double, low double, close double, volume long")
    steps = spark.createDataFrame([("A", days[2], 0.25, 0.5), ("A", days[4], 0.5, 1.0)], "symbol string, ex_date date, factor double, split double")
    got = actions.adjusted(bars, steps)
    assert "Union" not in plan_of(got) and "Window" not in plan_of(got)
    assert [r.close for r in got.filter("symbol = 'A'").orderBy("bar_date").collect()] == [2.0, 2.0, 4.0, 4.0, 8.0, 8.0]
    assert {(r.close, r.volume, r.factor) for r in got.filter("symbol = 'B'").collect()} == {(8.0, 100.0, 1.0)}
    base = spark.conf.get("spark.checkpoint.dir") + "/tidemark"
    before = set(os.listdir(base)) if os.path.exists(base) else set()
    table = incremental.Table(f"{tmp_path}/table", ("symbol", "bar_date"), "bar_date")
    assert incremental.merge(table, got).count() == 12 and table.read(spark).count() == 12
    assert len(set(os.listdir(base)) - before) == 1
    assert incremental.merge(table, got).count() == 0


def test_keys_of_a_deduplicated_stream_lie_on_disk(spark):
    base = spark.conf.get("spark.checkpoint.dir") + "/tidemark"
    before = set(glob.glob(f"{base}/stream-*"))
    assert QUERIES["stream_dedupe"](spark, SMALL).count() > 0
    (own,) = set(glob.glob(f"{base}/stream-*")) - before
    assert glob.glob(f"{own}/state/state/**/*.zip", recursive=True)
