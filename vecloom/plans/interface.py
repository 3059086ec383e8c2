"""Queries through the request interface and through SQL, and remaining column operations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..api import Api
from ..functions.embed import HashingEmbedder, embed_texts, with_prefix
from ..functions.sql import register
from ..functions.text import post_url
from ..operators.reduce import explained, fit_pca, sequence_ranges
from ..operators.search import Corpus, batch_knn
from ..session import settle
from .base import SQL, config, first_query, vectors
from .registry import Registry, Tables

QUERIES = Registry()
DIMS = 256


def _text_api(t: Tables) -> Api:
    """The documents as posts: their id is post, author and permlink."""
    embed = HashingEmbedder(DIMS)
    docs = t.documents.filter("text is not null").select(F.col("doc_id").cast("int").alias("post_id"), F.col("text"), F.col("source"), F.col("n_chars").cast("int").alias("n"))
    vec = settle(embed_texts(docs.select("post_id", with_prefix("passage: ", "text").alias("text")), "text", embed).select("post_id", F.lit(0).alias("chunk_number"), "embedding", F.col("post_id").alias("sync_seq")), "text-vectors")
    posts = docs.select(F.col("post_id").alias("id"), F.col("post_id").alias("author_id"), F.col("post_id").alias("permlink_id"), F.lit(0).alias("counter_deleted"))
    accounts = docs.select(F.col("post_id").alias("id"), F.concat(F.lit("writer-"), "post_id").alias("name"))
    links = docs.select(F.col("post_id").alias("id"), F.concat(F.lit("p"), "post_id").alias("permlink"))
    data = docs.select("post_id", F.col("n").alias("number_of_tokens"), F.lit(0).alias("last_vectors_block"))
    c = Corpus(vec, posts, data, None, accounts, links)
    return Api(c, config(dims=DIMS, sync_uuid="own", max_visible_sync_seq=2**31 - 1), embed, docs.select("post_id", F.col("source").alias("title"), F.col("text").alias("body")), t.sync_chains, data.limit(0).select("post_id", F.col("last_vectors_block").alias("sync_seq")))


def _rows(t: Tables, found: list) -> DataFrame:
    return t.spark.createDataFrame([(i, json.dumps(x, sort_keys=True)) for i, x in enumerate(found)], "position int, answer string")


@QUERIES.query("api_posts_search")
def api_posts_search(t: Tables) -> DataFrame:
    return _rows(t, _text_api(t).posts_search("the night gardener waits for the last tram", 80, 30, 5))


@QUERIES.query("api_posts_similar")
def api_posts_similar(t: Tables) -> DataFrame:
    api = _text_api(t)
    first = api.corpus.vectors.agg(F.min("post_id")).first()[0]
    return _rows(t, api.posts_similar(f"writer-{first}", f"p{first}", 80, 30, 5))


@QUERIES.query("api_authors_search")
def api_authors_search(t: Tables) -> DataFrame:
    return _rows(t, list(_text_api(t).authors_search("der alte Bäcker backt Roggenbrot", 10)))


@QUERIES.query("api_posts_by_ids")
def api_posts_by_ids(t: Tables) -> DataFrame:
    api = _text_api(t)
    some = [r.post_id for r in api.bodies.orderBy("post_id").select("post_id").limit(3).collect()]
    asked = [{"author": f"writer-{i}", "permlink": f"p{i}"} for i in reversed(some)] + [{"author": "nobody", "permlink": "x"}]
    return _rows(t, api.posts_by_ids_query(json.dumps(asked), 40))


@QUERIES.query("api_sync_chains")
def api_sync_chains(t: Tables) -> DataFrame:
    return _rows(t, _text_api(t).sync_chains())


@QUERIES.query("api_chain_order", "select 0::bigint as at, 'own' as sync_uuid union all select row_number() over (order by priority, sync_uuid), sync_uuid from sync_chains")
def api_chain_order(t: Tables) -> DataFrame:
    """The chains as the interface lists them: its own first."""
    return t.spark.createDataFrame([(i, c["sync_uuid"]) for i, c in enumerate(_text_api(t).sync_chains())], "at long, sync_uuid string")


@QUERIES.query(
    "api_posts_by_ids_order",
    "select (row_number() over (order by doc_id desc) - 1)::bigint as at, 'writer-' || doc_id as author, substr(text, 1, 40) as body from (select * from documents where text is not null order by doc_id limit 3) union all select 3, null, null",
)
def api_posts_by_ids_order(t: Tables) -> DataFrame:
    """Posts in the order asked for, null for one that isn't there."""
    found = [json.loads(r.answer) for r in api_posts_by_ids(t).orderBy("position").collect()]
    return t.spark.createDataFrame([(i, p and p["author"], p and p["body"]) for i, p in enumerate(found)], "at long, author string, body string")


# Topics of the relevance set.
TOPICS = ("rye bread with honey", "late tomatoes on a slope", "carved wooden spoons", "letters about rain", "the last tram under the bridge", "a diary of birds", "broken lanterns in a workshop", "blue glass by the harbour")


@QUERIES.query("ev06_relevance")
def ev06(t: Tables) -> DataFrame:
    """The nearest post of every topic, as a link: one batch search for all topics."""
    api = _text_api(t)
    asked = t.spark.createDataFrame([(i, "query: " + q, q) for i, q in enumerate(TOPICS)], "id int, text string, query string")
    q = embed_texts(asked, "text", api.embed)
    hits = batch_knn(q, api.corpus.vectors, 1, ["id"], ["post_id"])
    names = api.corpus.accounts.join(api.corpus.permlinks, "id")
    return hits.join(asked.select(F.col("id").alias("q_id"), "query"), "q_id").join(names.withColumnRenamed("id", "post_id"), "post_id").select("query", "rank", post_url("https://posts.example", "name", "permlink").alias("link"))


# -- SQL callers -----------------------------------------------------------------------------------------------
@QUERIES.query("udf_sql_functions", "with " + SQL + " select post_id, chunk_number, round(list_cosine_distance(e, (select e from q)), 6) as d, round(-list_inner_product(e[1:16], e[1:16]), 5) as p from pv")
def udf_sql(t: Tables) -> DataFrame:
    register(t.spark)
    vectors(t).createOrReplaceTempView("vecloom_pv")
    q = ", ".join(f"{x!r}D" for x in first_query(t)[1])
    return t.spark.sql(f"select post_id, chunk_number, round(cosine_distance(cast(embedding as array<double>), array({q})), 6) d, round(negative_inner_product(subvector(cast(embedding as array<double>), 1, 16), subvector(cast(embedding as array<double>), 1, 16)), 5) p from vecloom_pv")


@QUERIES.query("udf_chunk_post")
def udf_chunk_post(t: Tables) -> DataFrame:
    register(t.spark)
    t.documents.createOrReplaceTempView("vecloom_docs")
    return t.spark.sql("select d.doc_id, c.* from vecloom_docs d, lateral chunk_post(d.text, 64, 0.15D, 'passage: ', 10) c")


# -- column operations -----------------------------------------------------------------------------------------
@QUERIES.query("flt11_membership", "select post_id, chunk_number from posts_vectors where post_id in (select id from hive_posts where counter_deleted > 0)")
def flt11(t: Tables) -> DataFrame:
    return t.posts_vectors.join(t.hive_posts.filter("counter_deleted > 0").select(F.col("id").alias("post_id")), "post_id", "left_semi").select("post_id", "chunk_number")


@QUERIES.query("flt12_clamps", "select post_id, greatest(least(number_of_tokens, 300), 100) as clamped, nullif(last_vectors_block, -1) as block, coalesce(number_of_tokens, 0) as tokens, case when number_of_tokens >= 75 then 'kept' else 'short' end as kind from post_data")
def flt12(t: Tables) -> DataFrame:
    n = F.col("number_of_tokens")
    return t.post_data.select("post_id", F.greatest(F.least(n, F.lit(300)), F.lit(100)).alias("clamped"), F.nullif("last_vectors_block", F.lit(-1)).alias("block"), F.coalesce(n, F.lit(0)).alias("tokens"), F.when(n >= 75, "kept").otherwise("short").alias("kind"))


@QUERIES.query("jn14_one_row_relation", "select p.id, s.top from hive_posts p, (select max(sync_seq) top from posts_vectors) s")
def jn14(t: Tables) -> DataFrame:
    top = t.posts_vectors.agg(F.max("sync_seq").alias("top"))
    return t.hive_posts.select("id").join(F.broadcast(top), F.lit(True))  # one row


@QUERIES.query("ag12_answers_in_order", "select author_id, id // 1024 as part, list(permlink_id order by id) as links from hive_posts group by 1, 2")
def ag12(t: Tables) -> DataFrame:
    """collect_list drops nulls, so values travel in structs; in parts by range of the unique id, so that no list outgrows 1024."""
    packed = t.hive_posts.groupBy("author_id", F.floor(F.col("id") / 1024).cast("int").alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "permlink_id"))).alias("l"))
    return packed.select("author_id", "part", F.transform("l", lambda x: x["permlink_id"]).alias("links"))


@QUERIES.query("ag15_post_headers", "select post_id, block_num, max(token_count) as tokens from tmp_chunks group by 1, 2")
def ag15(t: Tables) -> DataFrame:
    return t.tmp_chunks.groupBy("post_id", "block_num").agg(F.max("token_count").alias("tokens"))


@QUERIES.query("ag18_sequence_ranges", "with " + SQL + ", r as (select min(sync_seq) a, max(sync_seq) z, ceil((max(sync_seq) - min(sync_seq) + 1) / 8)::int s from pv) select (a + i * s)::int as first, least(a + (i + 1) * s - 1, z)::int as last from r, range(8) t(i) where a + i * s <= z")
def ag18(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(sequence_ranges(vectors(t), 8), "first int, last int")


@QUERIES.query("ag17_explained_variance")
def ag17(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(explained(fit_pca(vectors(t), 16)[1].tolist()), "component int, share double, total double")


@QUERIES.query(
    "wn06_served_names",
    "select p.block_num, a.name as author, k.permlink, arg_max(p.id, (p.counter_deleted = 0)::int::bigint * 10000000000 + p.id) as post_id from hive_posts p join hive_accounts a on a.id = p.author_id join hive_permlink_data k on k.id = p.permlink_id group by 1, 2, 3",
)
def wn06(t: Tables) -> DataFrame:
    from ..operators.rebase import prefer_live

    rows = t.hive_posts.join(t.hive_accounts.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id").join(t.hive_permlink_data.select(F.col("id").alias("permlink_id"), "permlink"), "permlink_id")
    return prefer_live(rows, ["block_num", "author", "permlink"])


@QUERIES.query("st01_all_names", "select author, permlink from legacy_vectors_raw union select author, permlink from embeddingupdate")
def st01(t: Tables) -> DataFrame:
    return t.legacy_vectors_raw.select("author", "permlink").union(t.embeddingupdate.select("author", "permlink")).distinct()


@QUERIES.query("st02_metric_rows", "select 'posts' as metric, count(*) as n from hive_posts union all select 'accounts', count(*) from hive_accounts union all select 'permlinks', count(*) from hive_permlink_data")
def st02(t: Tables) -> DataFrame:
    one = lambda n, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("metric"), "n")
    return one("posts", t.hive_posts).unionByName(one("accounts", t.hive_accounts)).unionByName(one("permlinks", t.hive_permlink_data))


@QUERIES.query("sf15_string_parts", "select id, split_part(name, '-', 1) as head, replace(name, '.', '_') as flat, regexp_extract(name, '([0-9]+)', 1) as digits, lower(name) as small from hive_accounts")
def sf15(t: Tables) -> DataFrame:
    return t.hive_accounts.select("id", F.split_part("name", F.lit("-"), F.lit(1)).alias("head"), F.replace("name", F.lit("."), F.lit("_")).alias("flat"), F.regexp_extract("name", "([0-9]+)", 1).alias("digits"), F.lower("name").alias("small"))


@QUERIES.query("xf01_identities", "select id, true as valid from hive_accounts")
def xf01(t: Tables) -> DataFrame:
    return t.hive_accounts.select("id", F.uuid().rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("valid"))
