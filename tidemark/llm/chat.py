"""Quotation linking: reply-ordered conversations without quotes, with DataFrame functions only.

Lines that start with > marks are quotes of that depth. Runs of lines of one depth, cut at blank lines,
are passages; passages and their lines are normalised and hashed. What a message quotes is joined to the
first message of its conversation that says it, and taken out of its body; a quote that nobody said before
stays. Replies form trees, and each conversation is read tree by tree, a reply after what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

_MARKS = r"^[ \t]*(?:>[ \t]*)+"


def normalised(text: Column) -> Column:
    """Lower case, white space as single blanks, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def lines(texts: DataFrame) -> DataFrame:
    """key, at (line number), depth (quote marks at its start), line (without them), blank; texts: key, text."""
    split = texts.select("key", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    marks = F.regexp_extract("raw", _MARKS, 0)
    parsed = split.select("key", "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("depth"), F.regexp_replace("raw", _MARKS, "").alias("line"))
    return parsed.withColumn("blank", F.trim(F.regexp_replace("line", r"\s+", " ")) == "")


def units(texts: DataFrame) -> DataFrame:
    """key, depth, hash of every passage and line, and the numbers of the lines that say it (ats; none at depth 0).

    The lines of one text are numbered by one task.
    """
    by_line = Window.partitionBy("key").orderBy("at")
    rows = lines(texts)
    cut = (F.col("depth") != F.lag("depth").over(by_line)) | F.col("blank") | F.lag("blank").over(by_line)
    runs = rows.withColumn("run", F.sum(F.coalesce(cut.cast("int"), F.lit(0))).over(by_line.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("blank"))
    told = F.array_sort(F.collect_list(F.struct("at", "line")))
    passages = runs.groupBy("key", "depth", "run").agg(told.alias("x")).select("key", "depth", F.array_join("x.line", " ").alias("said"), F.col("x.at").alias("ats"))
    both = passages.union(runs.select("key", "depth", F.col("line").alias("said"), F.array("at").alias("ats")))
    hashed = both.select("key", "depth", F.sha2(normalised(F.col("said")), 256).alias("hash"), F.when(F.col("depth") > 0, F.col("ats")).otherwise(F.array().cast("array<int>")).alias("ats"))
    return hashed.groupBy("key", "depth", "hash").agg(F.flatten(F.collect_list("ats")).alias("ats"))


def link(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with body, reply_to, thread_turn, reply_depth, position, rendered.

    body: the text without the quoted lines whose passage, or that themselves, an earlier message of the
    conversation said; all other lines stay, those that start with > too. reply_to: the turn of the earlier
    message that first says what this one quotes at its least linked depth; with several such messages the
    one that most quotes point to, ties to the later turn; null without one. thread_turn: the turn that the
    chain of replies starts from; reply_depth: the length of that chain. position: gapless from 0 in the
    conversation: threads by their first turn, in a thread each message before its replies and these, with
    all that answers them, by turn; rows of one turn by role and text. rendered: role and body as a chat
    turn. Lines end with \\n or \\r\\n. Null and empty texts have an empty body. Null conv_id or turn: the
    message is never linked. Rows that repeat conversation and turn each stay and are linked alike. Other
    columns stay, unless they are named like new ones.
    """
    new = ["body", "reply_to", "thread_turn", "reply_depth", "position", "rendered"]
    df = messages.drop(*new)
    ident, code, shown = common.fresh(df, "__id"), common.fresh(df, "__key"), common.fresh(df, "__body")
    # Written once, with a number for each row: what follows moves keys, and the texts come back at the end.
    keyed = common.materialize(df.withColumns({code: F.sha2(F.coalesce("text", F.lit("")), 256), ident: F.monotonically_increasing_id()}), "messages")
    thin = keyed.select(F.col(ident).alias("id"), "conv_id", "turn", "role", F.col(code).alias("key"))
    quoting = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^[ \t]*>")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    # Only conversations in which someone quotes are looked into; equal texts are parsed once.
    asked = keyed.filter(known & quoting).select("conv_id").distinct()
    active = keyed.filter(known).select("conv_id", "turn", F.col(code).alias("key"), "text").join(asked, "conv_id", "left_semi")
    texts = common.materialize(active.groupBy("key").agg(F.first("text").alias("text")), "texts")
    parsed = common.materialize(units(texts), "units")
    places = common.materialize(active.select("conv_id", "turn", "key").distinct(), "places")
    said = common.materialize(common.spread_join(places, parsed, ["key"]), "said")
    origins = said.filter("depth = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quotes = said.filter("depth > 0").select("conv_id", "turn", "key", "depth", "hash", "ats")
    found = common.materialize(common.spread_join(quotes, origins, ["conv_id", "hash"]).filter("origin < turn"), "quotes")
    votes = found.groupBy("conv_id", "turn", "depth", "origin").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("depth"), "n", "origin")).alias("reply_to"))
    threads = common.materialize(_roots(common.materialize(best, "replies")), "threads")
    placed = thin.join(threads.join(_places(threads), ["conv_id", "turn"], "full"), ["conv_id", "turn"], "left")
    placed = placed.withColumns({"thread_turn": F.coalesce("thread_turn", "turn"), "reply_depth": F.coalesce("reply_depth", F.lit(0)).cast("int")})
    placed = _positions(placed).select(F.col("id").alias(ident), "reply_to", "thread_turn", "reply_depth", "position")
    bodies = thin.join(_bodies(found, texts), ["conv_id", "turn", "key"]).select(F.col("id").alias(ident), F.col("body").alias(shown))
    full = keyed.join(placed, ident).join(bodies, ident, "left").withColumn("body", F.btrim(F.coalesce(shown, "text", F.lit("")), F.lit(" \t\r\n")))
    return full.withColumn("rendered", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"))).select(*df.columns, *new)


def conversations(linked: DataFrame, most: int = 4096) -> DataFrame:
    """conv_id, part, turns: each conversation of link() as a row of turns in order of position.

    turns holds position, turn, role, reply_to, reply_depth and body. A conversation of more than `most`
    messages goes on in parts 1, 2, ..., so no row is larger than so many messages.
    """
    turn = F.struct("position", "turn", "role", "reply_to", "reply_depth", "body")
    parts = linked.withColumn("part", F.floor(F.col("position") / most))
    return parts.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _bodies(found: DataFrame, texts: DataFrame) -> DataFrame:
    """conv_id, turn, key, body of every message with a linked quote: its text without those lines."""
    message = ["conv_id", "turn", "key"]
    gone = found.select(*message, F.explode("ats").alias("at")).distinct()
    linked = common.materialize(found.select(*message).distinct(), "linked")
    rows = common.spread_join(linked, texts, ["key"]).select(*message, F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    left = rows.join(gone, [*message, "at"], "left_anti")
    bodies = left.groupBy(*message).agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "raw")))["raw"], "\n").alias("body"))
    return linked.join(bodies, message, "left").select(*message, F.coalesce("body", F.lit("")).alias("body"))


def _roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread_turn, reply_depth by doubling: each round joins a message to its ancestor's ancestor."""
    state = replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread_turn"), F.lit(1).alias("reply_depth"))
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("above"), F.col("reply_depth").alias("more"))
        after = common.materialize(common.spread_join(state, up, ["conv_id", "thread_turn"], "left"), "roots")
        state = after.select("conv_id", "turn", "reply_to", F.coalesce("above", "thread_turn").alias("thread_turn"), (F.col("reply_depth") + F.coalesce("more", F.lit(0))).alias("reply_depth"))
        if not after.filter("above is not null").limit(1).count():
            return state


def _places(threads: DataFrame) -> DataFrame:
    """conv_id, turn, behind: how many messages of its thread a message and those that come after it are, in preorder.

    A walk around each tree enters and leaves every message once. The steps of a walk are a linked list; by
    doubling, each step learns how many messages are entered from it on. No step has two predecessors, so no
    join has a hot key, and the rounds are the logarithm of the longest walk.
    """
    spark = threads.sparkSession
    tops = threads.select("conv_id", F.col("thread_turn").alias("turn")).distinct().withColumn("parent", F.lit(None).cast("long"))
    nodes = threads.select("conv_id", "turn", F.col("reply_to").cast("long").alias("parent")).unionByName(tops)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    replies = common.materialize(nodes.filter("parent is not null").repartitionByRange(parts, "conv_id", "parent", "turn").withColumn("part", F.spark_partition_id()), "siblings")
    # The next sibling: in the same part, or the first one of the group's next part.
    near = F.lead("turn").over(Window.partitionBy("conv_id", "parent", "part").orderBy("turn"))
    heads = replies.groupBy("conv_id", "parent", "part").agg(F.min("turn").alias("head"))
    heads = heads.select("conv_id", "parent", "part", F.lead("head").over(Window.partitionBy("conv_id", "parent").orderBy("part")).alias("far")).filter("far is not null")
    siblings = replies.withColumn("near", near).join(heads, ["conv_id", "parent", "part"], "left").select("conv_id", "turn", F.coalesce("near", "far").alias("sibling"))
    children = replies.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    known = nodes.join(children, ["conv_id", "turn"], "left").join(siblings, ["conv_id", "turn"], "left")
    step = lambda leaves, n, to, to_leaves: F.struct(F.lit(leaves).alias("leaves"), F.lit(n).cast("long").alias("behind"), to.alias("to"), to_leaves.alias("to_leaves"))
    enter = step(False, 1, F.coalesce("child", "turn"), F.col("child").isNull())
    leave = step(True, 0, F.coalesce("sibling", "parent"), F.col("sibling").isNull())
    state = known.select("conv_id", "turn", F.explode(F.array(enter, leave)).alias("x")).select("conv_id", "turn", "x.*")
    while True:
        state = common.materialize(state, "walk")
        if not state.filter("to is not null").limit(1).count():
            return state.filter("not leaves").select("conv_id", "turn", "behind")
        ahead = state.select("conv_id", F.col("turn").alias("to"), F.col("leaves").alias("to_leaves"), F.col("behind").alias("more"), F.col("to").alias("beyond"), F.col("to_leaves").alias("beyond_leaves"))
        moved = state.filter("to is not null").join(ahead, ["conv_id", "to", "to_leaves"])
        moved = moved.select("conv_id", "turn", "leaves", (F.col("behind") + F.col("more")).alias("behind"), F.col("beyond").alias("to"), F.col("beyond_leaves").alias("to_leaves"))
        state = moved.unionByName(state.filter("to is null"))


def _positions(df: DataFrame) -> DataFrame:
    """Numbers the messages of each conversation: dealt by range, so a long conversation has many tasks."""
    spark = df.sparkSession
    order = ["thread_turn", F.desc("behind"), "turn", "role", "key"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = common.materialize(df.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    # A conversation starts in one part; only those that go on in others need a shift.
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("conv_id", "part", F.sum("n").over(ahead).alias("before")).filter("before > 0").withColumnsRenamed({"conv_id": "conv", "part": "at"})
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("at"))
    numbered = dealt.join(shift, same, "left")
    return numbered.withColumn("position", (F.row_number().over(inside) - 1 + F.coalesce("before", F.lit(0))).cast("long"))
