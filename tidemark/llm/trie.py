"""The prefix trie of conversations, by partition refinement.

All conversations start as one class. Turn by turn, each class of two or more different conversations is split
by its members' next turn; a class with one conversation left retires, and its remaining turns are a chain of
nodes with one child each. Sums over subtrees are folded back from the deepest split to the root.

Equal conversations are one member with a number of copies, so a class of copies retires like any other. The
number of Spark rounds is the number of turns that two *different* conversations have in common at most, not
the length of any conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Words are runs of other characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of one family begin alike: conversation c - c % FAMILY lends its first turns, fewer than HEADS.
FAMILY, HEADS = 20, 4
#: Nodes of a chain that one task makes at a time, ids that one row holds, and turns that are summed together.
CHAIN, IDS, BLOCK = 4096, 16_384, 4096


def lent(conv_id: Column) -> Column:
    """How many first turns a conversation takes over from its family's first one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the rebuilt conversations.

    turns: conv_id, depth (from 1), key (of role and text), words. lengths: conv_id, len, for each conv_id of the
    table, also where no turn is left. Turns are ordered by turn (null first), then role and text, so repeated turns
    have an order; null role and text are empty. Rows without a conv_id belong to no conversation.

    One range shuffle orders all turns; they are numbered inside their range and shifted by the ranges before, so
    a long conversation may lie in many tasks.
    """
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text)
    order = ["conv_id", "turn", "role", "text"]
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = common.materialize(
        sorted_rows.select("conv_id", F.monotonically_increasing_id().alias("at"), key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns"
    )
    placed = placed.withColumn("range", F.shiftright("at", 33))
    spans = placed.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("range")
    spans = spans.withColumns({"total": F.sum("n").over(Window.partitionBy("conv_id")), "before": F.sum("n").over(ahead) - F.col("n"), "lent": lent(F.col("conv_id"))}).drop("n")
    spans = common.materialize(spans, "spans")
    number = (F.col("at") - F.col("first") + F.col("before") + 1).alias("number")
    place = ["conv_id", "range"]  # never hot: a range is what one task wrote

    firsts = spans.filter((F.col("conv_id") % FAMILY == 0) & (F.col("before") < HEADS - 1))
    heads = placed.filter(F.col("conv_id") % FAMILY == 0).join(firsts, place).select("conv_id", number, "key", "words").filter(F.col("number") < HEADS)
    bases = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("number", "key", "words"))).alias("heads"))
    # A base has FAMILY conversations at most (twice as many around 0).
    known = spans.filter("before = 0").select("conv_id", "total", "lent", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(bases, "base", "left")
    taken = F.coalesce(F.slice("heads", F.lit(1), F.col("lent").cast("int")), F.array().cast("array<struct<number:bigint,key:binary,words:bigint>>"))
    known = known.select("conv_id", "lent", taken.alias("heads"), F.greatest(F.col("total") - F.col("lent"), F.lit(0)).alias("own"))
    known = common.materialize(known.withColumn("len", F.col("own") + F.size("heads")), "known")

    shifted = spans.select(*place, "first", "before").join(known.select("conv_id", "lent", F.size("heads").alias("taken")), "conv_id")
    own = placed.join(shifted, place).select("*", number).filter("number > lent")
    own = own.select("conv_id", (F.col("number") - F.col("lent") + F.col("taken")).alias("depth"), "key", "words")
    begun = known.select("conv_id", F.explode("heads").alias("h")).select("conv_id", F.col("h.number").alias("depth"), "h.key", "h.words")
    # By depth, so that a round finds its turns by the files' statistics.
    turns = own.union(begun).repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id")
    return common.materialize(turns, "rebuilt"), known.select("conv_id", "len")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (first, conv_id) rows as rows of joined ids, IDS of them at most."""
    out: list[tuple[int, int, str]] = []
    for batch in batches:
        pairs = zip(batch.column("first").to_pylist(), batch.column("conv_id").to_pylist())
        for first, ids in groupby(pairs, lambda p: p[0]):
            own = [i for _, i in ids]
            out += [(first, own[k], ",".join(map(str, own[k : k + IDS]))) for k in range(0, len(own), IDS)]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))], names=["first", "at", "ids"])
        out = []


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (first, at, ids) rows as one hash for each first; what is kept is the state of one hash."""
    now, state, done = None, None, []
    for batch in batches:
        for first, ids in zip(batch.column("first").to_pylist(), batch.column("ids").to_pylist()):
            if first != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = first, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"first": pa.array([d[0] for d in done], pa.int64()), "sha": pa.array([d[1] for d in done], pa.string())})
        done = []
    if now is not None:
        yield pa.RecordBatch.from_pydict({"first": pa.array([now], pa.int64()), "sha": pa.array([state.hexdigest()], pa.string())})


def _groups(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, hashes): each distinct conversation with its smallest id, length, copies; and the hashes of the ids of those with copies."""
    own = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "key")).alias("a"), F.bit_xor(F.xxhash64("key", "depth")).alias("b"))
    marked = common.materialize(lengths.join(own, "conv_id", "left").select("conv_id", "len", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "marked")
    same = ["len", "a", "b"]
    members = common.materialize(marked.groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")), "members")
    many = members.filter("copies > 1").select(*same, F.col("conv_id").alias("first"))
    copies = common.spread_join(marked, many, same).select("first", "conv_id")
    pieces = copies.repartitionByRange("first", "conv_id").sortWithinPartitions("first", "conv_id").mapInArrow(_joined, "first long, at long, ids string")
    hashes = pieces.repartition("first").sortWithinPartitions("first", "at").mapInArrow(_hashed, "first long, sha string")
    return members.select("conv_id", "len", "copies"), common.materialize(hashes, "hashes")


def _chains(turns: DataFrame, retired: DataFrame) -> DataFrame:
    """Nodes (conv_id, depth, start, parent, n_convs, len, saved) of the retired members, from depth `start` to their last turn."""
    part = F.explode(F.sequence(F.floor(F.col("start") / CHAIN).cast("long"), F.floor(F.col("len") / CHAIN).cast("long"))).alias("part")
    low, high = F.greatest("start", F.col("part") * CHAIN), F.least("len", F.col("part") * CHAIN + CHAIN - 1)
    # Chains of one copy save nothing; those of more copies sum their words up from the end, block by block.
    plain = retired.filter("copies = 1").select("*", part).repartition("conv_id", "part").select("*", F.explode(F.sequence(low, high)).alias("depth")).withColumn("saved", F.lit(0).cast("long"))
    kept = common.spread_join(turns.select("conv_id", "depth", "words"), retired.filter("copies > 1"), ["conv_id"]).filter("depth >= start")
    kept = kept.withColumn("block", F.floor(F.col("depth") / BLOCK))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    sums = kept.groupBy("conv_id", "block").agg(F.sum("words").alias("w")).select("conv_id", "block", (F.sum("w").over(behind) - F.col("w")).alias("later"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = kept.join(sums, ["conv_id", "block"]).withColumn("saved", (F.col("copies") - 1) * (F.sum("words").over(inside) + F.col("later")))
    columns = ["conv_id", "depth", "start", "parent", F.col("copies").alias("n_convs"), "len", "saved"]
    return plain.select(*columns).union(summed.select(*columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, one row for each node: conv_id (its smallest member), depth, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations has conv_id, turn, role, text; other columns are ignored. Rows without a conv_id take no part; a
    table without others has no nodes, not even a root. Null role and text are empty. Repeated turns are turns of
    their own, in the order of role and text. Conversations of no turns end at the root.

    A class is named by its smallest member. Members of a hot class are dealt over several tasks (`common.spread_join`);
    all else is an aggregate with partial sums or a join by unique keys. Each round is written to the shared folder.
    """
    common.tune(conversations.sparkSession)
    turns, lengths = rebuilt(conversations)
    members, hashes = _groups(turns, lengths)
    root = members.agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.max(F.when(F.col("len") == 0, F.col("conv_id"))).alias("ender")).filter("conv_id is not null")
    root = common.materialize(root.select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"), "ender"), "root")
    top = root.first()

    active = members.filter("len > 0").withColumn("parent", F.lit(top and top.conv_id).cast("long"))
    levels, most, depth = [root], max(common.HOT, members.count() // common.SHARES), 0
    while True:
        depth += 1
        step = common.materialize(turns.filter(F.col("depth") == depth).drop("depth").join(active, "conv_id"), "step")
        classes = step.groupBy("parent", "key").agg(
            F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.count(F.lit(1)).alias("m"), F.max("words").alias("words"), F.max("len").alias("len"), F.max(F.when(F.col("len") == depth, F.col("conv_id"))).alias("ender")
        )
        classes = common.materialize(classes, "classes")
        levels.append(classes)
        if classes.filter("m > 1").isEmpty():
            break
        hot = [(r.parent, r.key, -(-r.m // most)) for r in classes.filter(F.col("m") > most).select("parent", "key", "m").collect()]
        named = classes.filter("m > 1").select(F.col("parent"), "key", F.col("conv_id").alias("name"))
        active = common.spread_join(step.filter(F.col("len") > depth), named, ["parent", "key"], hot=hot).select("conv_id", "len", "copies", F.col("name").alias("parent"))

    retired = [c.filter("m = 1").select("conv_id", F.lit(i).cast("long").alias("start"), "parent", "len", F.col("n_convs").alias("copies")) for i, c in enumerate(levels) if i]
    alone = retired[0]
    for r in retired[1:]:
        alone = alone.union(r)
    chains = common.materialize(_chains(turns, alone), "chains")

    # Back from the deepest split: what children hand to their parents.
    ended = F.col("depth") == F.col("len")
    nodes = chains.select("conv_id", "depth", F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(ended, F.col("conv_id")).alias("ender"))
    heads = chains.filter("depth = start").select("parent", "depth", F.lit(1).cast("long").alias("leaves"), "saved")
    below = None
    for i in range(len(levels) - 2, -1, -1):
        split = levels[i] if i == 0 else levels[i].filter("m > 1")
        children = heads.filter(F.col("depth") == i + 1).select("parent", "leaves", "saved")
        if below is not None:
            children = children.union(below.select(F.col("parent_conv_id").alias("parent"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        given = children.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        own = split.select("conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", "words", "ender").join(given, "conv_id", "left")
        below = common.materialize(
            own.select("conv_id", F.lit(i).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                       F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "ender"), "folded"
        )
        nodes = nodes.union(below)
    sha = F.coalesce("sha", F.sha2(F.coalesce(F.col("ender").cast("string"), F.lit("")).cast("binary"), 256))
    out = nodes.join(hashes.withColumnRenamed("first", "ender"), "ender", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
