import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests import parity
from tests.llm.test_near_dedup import brute
from tests.llm.test_toxicity_quality import brute_kept, corpus, naive
from tidemark.llm import common, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    parity.compare(queries.QUERIES[name](spark, SF), parity.connect(SF), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def planted():
    """Documents with toxic and bad ones, exact and near copies, repeated and null ids; ids of labelled rows are unique."""
    r = random.Random(12)
    docs, labels = corpus(2500, 12)
    texts = [(i, t, lang) for i, t, lang in docs]
    for i in range(0, 60, 2):
        words = texts[i][1].split()
        words += [f"tail{i}x{k}" for k in range(60)]
        long = " ".join(words)
        near = long.replace(f"tail{i}x30", "other")
        texts += [(10_000 + i, long, "en"), (10_001 + i, near, "en"), (None, long + ".", "en"), (20_000, near + " and one word more", "de")]
    for _ in range(3):
        texts += [(None, None, "en"), (20_001, "", "en"), (20_002, "a short clean text of ten words with nothing wrong", None)]
    r.shuffle(texts)
    return texts, labels


def test_stages_equal_brute_force(spark, tmp_path):
    texts, labels = planted()
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labelled = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))

    model = toxicity.learn(docs, labelled)
    one = common.materialize(stages["toxicity"](spark, docs, tmp_path), "one")
    spared = [x for x in rows(docs) if (w := naive(model, x[2])[0]) / (w + model.half) < 0.3]
    assert one.columns == docs.columns and rows(one) == spared and len(spared) < len(texts)

    # The verdict needs a key of its own for each row here.
    two = common.materialize(stages["quality rules"](spark, one, tmp_path), "two")
    keyed = one.withColumn("n", F.monotonically_increasing_id()).cache()
    own = keyed.select(F.col("n").alias("doc_id"), "text", "lang")
    judged, _ = brute_kept(own, keyed.join(labelled, "doc_id").select(F.col("n").alias("doc_id"), "quality"))
    good = [(r.doc_id is None, r.doc_id or 0, r.text or "") for r in keyed.collect() if judged[r.n]]
    assert two.columns == docs.columns and rows(two) == sorted(good) and len(good) < len(spared)

    three = common.materialize(stages["near-dedup"](spark, two, tmp_path), "three")
    kept = rows(two)
    groups = brute(spark, two, [t for _, _, t in kept])
    least = {}
    for i, c in groups.items():
        key = (*kept[i][:2], hashlib.md5(kept[i][2].encode()).hexdigest())
        least[c] = min(least.get(c, (key, i)), (key, i))
    assert three.columns == docs.columns and rows(three) == sorted(kept[i] for _, i in least.values()) and len(least) < len(kept) - 30

    count = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter((x[1], len(count.encode(x[2], add_special_tokens=False).ids)) for x in rows(three))
    four = stages["packing"](spark, three, tmp_path).collect()
    assert Counter((r.doc_id or 0, r.n_tokens) for r in four) == lengths
    sizes = Counter(n for _, n in lengths.elements())
    borders = packing.best_borders(sorted(sizes), [sizes[x] for x in sorted(sizes)], 16)
    assert all(r.bucket_length == min(b for b in borders if b >= r.n_tokens) for r in four)
    done = Counter((r.doc_id, r.n_tokens, r.bucket) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert done == Counter((r.doc_id, r.n_tokens, r.bucket) for r in four)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
