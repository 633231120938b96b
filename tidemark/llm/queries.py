"""The queries op1 to op13: thin calls of the operators over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, common, neardup, ngram_lm, packing, phrases, quality, sharding, token_counts, topk, toxicity, trie, url_filter

RANKS = "byte_bpe_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels")))
    score = F.col("toxicity")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(common.table(spark, sf_dir, "conversations"))


#: Quotes are parsed, linked and ordered here as the operator does; paths of turns stand for the walk around each tree.
OP6_SQL = r"""
with recursive m as (select *, coalesce(text, '') as full_text, sha256(coalesce(text, '')) as k from conversations),
asked as (select distinct conv_id from m where conv_id is not null and turn is not null and regexp_matches(full_text, '(?m)^[ \t]*>')),
active as (select distinct conv_id, turn, k from m where turn is not null and conv_id in (select conv_id from asked)),
texts as (select distinct k, full_text from m where k in (select k from active)),
raws as (select k, unnest(string_split(full_text, chr(10))) as raw, generate_subscripts(string_split(full_text, chr(10)), 1) as num from texts),
parsed as (select k, num, raw, length(regexp_replace(regexp_extract(raw, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) as depth,
                  trim(lower(regexp_replace(regexp_replace(raw, '^[ \t]*(?:>[ \t]*)+', ''), '[ \t\n\r\f\x0B]+', ' ', 'g'))) as line from raws),
cuts as (select *, case when depth <> lag(depth) over w or line = '' or lag(line) over w = '' then 1 else 0 end as cut from parsed window w as (partition by k order by num)),
runs as (select *, sum(cut) over (partition by k order by num) as run from cuts),
passages as (select k, run, trim(regexp_replace(string_agg(line, ' ' order by num), ' +', ' ', 'g')) as said from runs where line <> '' group by k, run),
units as (select r.k, r.depth, p.said, r.num from runs r join passages p using (k, run) where line <> '' union select k, depth, line, num from runs where line <> ''),
said as (select conv_id, turn, k, depth, said, num from active join units using (k)),
origins as (select conv_id, said, min(turn) as origin from said where depth = 0 group by conv_id, said),
found as (select s.*, origin from said s join origins o on s.conv_id = o.conv_id and s.said = o.said where depth > 0 and origin < turn),
votes as (select conv_id, turn, depth, origin, count(distinct (k, said)) as n from found group by all),
best as (select conv_id, turn, origin as reply_to from votes qualify row_number() over (partition by conv_id, turn order by depth, n desc, origin desc) = 1),
tree as (select distinct conv_id, turn, cast(null as bigint) as reply_to, [turn] as path from m where turn is not null and not exists (select 1 from best b where b.conv_id = m.conv_id and b.turn = m.turn)
         union all
         select b.conv_id, b.turn, b.reply_to, list_append(t.path, b.turn) from best b join tree t on b.conv_id = t.conv_id and b.reply_to = t.turn),
gone as (select distinct conv_id, turn, k, num from found),
left_over as (select g.conv_id, g.turn, g.k, string_agg(raw, chr(10) order by r.num) filter (where x.num is null) as body
              from (select distinct conv_id, turn, k from gone) g join raws r using (k) left join gone x on x.conv_id = g.conv_id and x.turn = g.turn and x.k = g.k and x.num = r.num
              group by all),
placed as (select m.*, t.reply_to, t.path, trim(case when l.k is null then full_text else coalesce(l.body, '') end, ' ' || chr(9) || chr(10) || chr(13)) as body
           from m left join tree t on m.conv_id is not distinct from t.conv_id and m.turn = t.turn left join left_over l on m.conv_id = l.conv_id and m.turn = l.turn and m.k = l.k)
select conv_id, turn, role, text, body, reply_to, coalesce(path[1], turn) as thread_turn, cast(coalesce(len(path) - 1, 0) as integer) as reply_depth,
       row_number() over (partition by conv_id order by path nulls first, role nulls first, k) - 1 as position, '<|' || coalesce(role, '') || '|>' || chr(10) || body as rendered
from placed
"""


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.materialize(topk.quantized(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64), "vectors")
    return topk.top_k(vectors.filter(F.col("id") % 20 == 0), vectors, 20)


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

SHARDS = 8


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sharded = sharding.assign(sized, "doc_id", SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP9_SQL = r"""
with u as (
  select page_id, url, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules(h, p, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select page_id, host, path, r.h || r.p as rule, action,
             row_number() over (partition by page_id order by length(r.h || r.p) desc nulls last) as rn
      from h left join rules r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from m where rn = 1
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", packing.word_tokens(F.col("text")).alias("n_tokens"))
    return packing.pack(docs, "n_tokens", "doc_id", buckets=16, budget=65_536)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(common.table(spark, sf_dir, "conversations"))


#: The CRC of each byte comes from its definition; nodes are prefixes under a hash, and each subtree is summed along its members' paths.
OP11_SQL = r"""
with recursive bits as (select i, i as c, 0 as k from range(256) t(i)
         union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by i) as crc from bits where k = 8),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as num,
             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null),
c as (select conv_id, xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda d: cast(ascii(d) as bigint)),
                                      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) % 4 as h
      from (select distinct conv_id from t), tab),
r0 as (select c.conv_id, num, k, words from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and num <= h
       union all select conv_id, num + 1000000, k, words from c join t using (conv_id) where num > h),
r as (select conv_id, row_number() over (partition by conv_id order by num) as depth, k, words from r0),
p0 as (select conv_id, depth, words, md5(string_agg(k, ',') over (partition by conv_id order by depth rows unbounded preceding)) as p from r
       union all select conv_id, 0, 0, '' from c),
p as (select *, lag(p) over (partition by conv_id order by depth) as up, depth = max(depth) over (partition by conv_id) as ends from p0),
n as (select depth, p, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
             sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from p group by depth, p),
k as (select depth - 1 as depth, up as p, count(*) as n_children from n where depth > 0 group by all),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (depth, p)),
s as (select a.depth, a.p, sum(cast(n_children = 0 as int)) as n_leaves, sum((n_convs - 1) * m.words) as saved
      from m join p a on a.conv_id = m.conv_id and a.depth <= m.depth group by all)
select m.conv_id, m.depth, b.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, m.ends_sha256
from m join s using (depth, p) left join n b on b.depth = m.depth - 1 and b.p = m.up
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.table(spark, sf_dir, "documents").select("text", "lang"))


#: All grams as strings; what lies in a longer candidate is looked for by the words themselves.
OP12_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, list_filter(string_split_regex(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') as w from d),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from p, range(1, 5) t(k)),
f as (select lang, k, phrase, count(*) as n from g group by all),
t as (select lang, sum(n) as n from f where k = 1 group by 1),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1 and n >= 30),
cuts as (select lang, phrase, a, i, array_to_string(w[:i], ' ') as x, array_to_string(w[i + 1:], ' ') as y from c, range(1, 4) t(i) where i < k),
s as (select cuts.*, l.n as l, r.n as r, cast(2000000 as hugeint) * a // (l.n + r.n) as score from cuts
      join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, i) = 1),
k as (select * from b where not exists (select 1 from c where c.lang = b.lang and len(c.w) > len(string_split(b.phrase, ' ')) and 100 * c.a >= 80 * b.a and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, rank, phrase, a, l, r, cast(t.n as bigint) as n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k) join t using (lang) where rank <= 2000
"""


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = ngram_lm.held_out(F.col("doc_id"))
    scored = ngram_lm.score(docs, ngram_lm.train(docs.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_near_dedup": op5_near_dedup,
    "op6_chat": op6_chat,
    "op7_top_k": op7_top_k,
    "op8_sharding": op8_sharding,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_lm_score": op13_lm_score,
}
ORACLE_SQL = {"op6_chat": OP6_SQL, "op7_top_k": OP7_SQL, "op9_url_filter": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_collocations": OP12_SQL}
