"""The registered queries opN_<name>: each operator over its whole table, and the
digest columns that its result is compared by; SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restate.llm import chat_format, decontaminate, hard_negatives, knn, language_id, lexical, ngram_join, packing, quality, secret_scan, token_files, toxicity, url_filter
from restate.llm.common import held_out, scratch, store, table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_token_files(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = language_id.fit(docs.where(~held_out("doc_id")))
    return language_id.identify(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
with rules(r_host, r_path, action) as (values ('com','/','allow'), ('example.com','/en/','block'),
  ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
rest as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, url, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
best as (select p.url, max(struct_pack(n := length(r_host || r_path), h := length(r_host), a := action, r := r_host || r_path)) as b
  from (select distinct url, host, path from parts) p join rules
  on (p.host = r_host or ends_with(p.host, '.' || r_host)) and starts_with(p.path, r_path) group by p.url)
select page_id, host, path, b.r as rule, coalesce(b.a, 'allow') as verdict
from parts left join best on parts.url = best.url
"""

def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


OP5_SQL = r"""
with texts as (select 'd' as k, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
split as materialized (select k, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts),
items as (select id, w, least(len(w), 13) as n from split where k = 'b' and len(w) > 0),
windows as materialized (select id, n, array_to_string(w[i:i + n - 1], ' ') as t from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from items)),
places as (select id, n, i, array_to_string(w[i:i + n - 1], ' ') as t
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from split, (select distinct n from windows) where k = 'd' and len(w) >= n)),
found as materialized (select p.id, p.i, p.n, w.id as item from places p join windows w on p.t = w.t and p.n = w.n),
hit as (select id, count(distinct x) as n_hit from (select id, unnest(range(i, i + n)) as x from found) group by id),
named as (select id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct id, item::varchar as item from found) group by id)
select s.id as doc_id, len(s.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(s.w) as contaminated
from split s left join hit on s.id = hit.id left join named on s.id = named.id where k = 'd'
"""

def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out("doc_id"))
    model = quality.fit(docs.where(~held_out("doc_id")), labels)
    return quality.judge(docs, model, labels).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "host", "path", "host_rate", "path_rate", "quality", "rejected")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = packing.token_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packing.pack(lengths).withColumnRenamed("id", "doc_id")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_EXTRA_ID, OP9_EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(OP9_EXTRA_ID, i, role, OP9_EXTRA_TEXT) for i, role in enumerate(("user", "assistant"))],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = store(chat_format.chains(rows), "chat-messages")
    formatted = chat_format.format_paths(messages, chat_format.reply_paths(messages))
    read = chat_format.read_back(formatted)
    ids = messages.where(F.col("node") == 1).select(F.col("tree").alias("i_tree"), F.col("c_id").alias("conv_id"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.join(ids, F.col("tree") == F.col("i_tree")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length(role) + 4 + 2 + 9)::bigint as formatted_chars
from rows group by conv_id
"""


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.similar_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP10_SQL = r"""
with recursive words as materialized (select doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') as w
  from documents),
sets as materialized (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from words),
grams as materialized (select doc_id, len(s) as n, unnest(s) as g from sets),
same as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as k
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as materialized (select x, y from same where 100 * k >= 85 * (nx + ny - k)),
edges as materialized (select x, y from links union select y, x from links),
reach(x, y) as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
select doc_id, len(s)::bigint as n_shingles, coalesce(least(doc_id, (select min(y) from reach where reach.x = sets.doc_id)), doc_id) as component_id
from sets
"""


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with texts as (select 'd' as k, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
split as materialized (select k, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts),
query as materialized (select id as item_id, t, count(*) as reps from (select id, unnest(w) as t from split where k = 'b') group by id, t),
size as (select count(*) as n_docs, sum(len(w))::bigint as total from split where k = 'd' and len(w) > 0),
held as materialized (select id as doc_id, n, t, count(*) as tf
  from (select id, len(w) as n, unnest(w) as t from split where k = 'd') where t in (select t from query) group by id, n, t),
weight as (select t, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, size group by t),
scored as (select item_id, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // total)))))::bigint as score
  from query join weight using (t) join held using (t), size group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 20
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), count("novel"),
                        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


OP13_SQL = r"""
with rows as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label, list_dot_product(a.v, r.v)::bigint as score
  from rows a join rows r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
  and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
qualify rank <= 5
"""
