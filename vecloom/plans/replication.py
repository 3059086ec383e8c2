"""Queries of ingestion, the change feed and the rebase."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import name_of, trimmed
from ..functions.text import chunk_counters, chunk_posts
from ..functions.vectors import to_text
from ..operators import feed, rebase, store
from ..operators.index import InvertedFile
from ..operators.diff import current
from ..session import SharedFiles, settle, workspace
from ..sources.files import StatusLine, read_dump, read_status, write_dump, write_status
from .base import SQL, config, metadata, vectors
from .registry import Registry, Tables

QUERIES = Registry()

# -- ingestion -------------------------------------------------------------------------------------------------
_RANGE = """r as (
  select id post_id, greatest(block_num, block_num_created) block from hive_posts
  where (root_id = id or root_id = 0) and (block_num_created between 80000050 and 80000350 or block_num between 80000050 and 80000350))"""


def _range(t: Tables) -> DataFrame:
    return store.posts_in_range(t.hive_posts, 80000050, 80000350)


@QUERIES.query("in01_posts_in_range", f"with {_RANGE} select post_id, block from r")
def in01(t: Tables) -> DataFrame:
    return _range(t)


@QUERIES.query("ag01_ordered_ids", f"with {_RANGE} select coalesce(list(post_id order by block, post_id), []) as post_ids from r")
def ag01(t: Tables) -> DataFrame:
    return store.ordered_ids(_range(t))


@QUERIES.query(
    "wn08_tasks",
    f"with {_RANGE}, n as (select *, ((row_number() over (order by block, post_id) - 1) // 100)::int task from r) "
    "select task, min(block) as first_block, max(block) as last_block, list(post_id order by block, post_id) as post_ids from n group by task",
)
def wn08(t: Tables) -> DataFrame:
    return store.tasks(_range(t), 100)


# A batch over the store: posts of the range, those of fewer than 150 tokens without chunks; the others' vectors come back unchanged.
_BATCH = f"""
with {SQL}, {_RANGE},
pre as (select r.post_id, block block_num, coalesce(number_of_tokens, 0) token_count from r left join pd using (post_id)),
nv as (select post_id, chunk_number, e from pv where post_id in (select post_id from pre where token_count >= 150)),
num as (select *, exists (select 1 from nv where nv.post_id = pre.post_id) had from pre),
s as (select *, (10000000 + row_number() over (order by had, post_id))::int sync_seq from num),
mk as (select id post_id, (1000000 + id)::int sync_seq from hive_posts where counter_deleted > 0),"""


def _deleted(t: Tables) -> DataFrame:
    """Delete markers of posts that are gone."""
    return t.hive_posts.filter("counter_deleted > 0").select(F.col("id").alias("post_id"), (F.col("id") + 1_000_000).alias("sync_seq"))


def _ends(rows: DataFrame) -> DataFrame:
    """Vectors by their first and last number."""
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 5)
    return rows.select("post_id", "chunk_number", "sync_seq", at(1).alias("first"), at(-1).alias("last"))


def _batch(t: Tables, ranged: DataFrame) -> store.Tables:
    now = store.Tables(metadata(t), vectors(t), _deleted(t))
    pre = ranged.join(metadata(t), "post_id", "left").select("post_id", F.col("block").alias("block_num"), F.coalesce("number_of_tokens", F.lit(0)).alias("token_count"))
    new = now.vectors.join(pre.filter("token_count >= 150"), "post_id", "left_semi").select("post_id", "chunk_number", "embedding")
    return store.store_embeddings(now, pre, new, 10_000_000)


@QUERIES.query(
    "in02_store_vectors",
    _BATCH + """o as (select post_id, chunk_number, sync_seq, e from pv where post_id not in (select post_id from pre) union all select nv.post_id, nv.chunk_number, s.sync_seq, e from nv join s using (post_id))
select post_id, chunk_number, sync_seq, round(e[1], 5) + 0.0 as first, round(e[64], 5) + 0.0 as last from o""",
)
def in02_vectors(t: Tables) -> DataFrame:
    return _ends(_batch(t, _range(t)).vectors)


@QUERIES.query(
    "in02_store_markers",
    _BATCH + """o as (select * from mk union all select post_id, sync_seq from s where not had or exists (select 1 from pv where pv.post_id = s.post_id)) select post_id, sync_seq from o""",
)
def in02_markers(t: Tables) -> DataFrame:
    return _batch(t, _range(t)).markers


@QUERIES.query(
    "in02_store_metadata",
    _BATCH + """o as (select * from pd where post_id not in (select post_id from pre) union all select post_id, token_count, block_num from s) select post_id, number_of_tokens, last_vectors_block from o""",
)
def in02_metadata(t: Tables) -> DataFrame:
    return _batch(t, _range(t)).post_data


# The same over the whole chain: the range from the lowest to the highest block of the table.
_ALL = """r as (
  select id post_id, greatest(block_num, block_num_created) block from hive_posts
  where (root_id = id or root_id = 0) and (block_num_created is not null or block_num is not null))"""


def _all(t: Tables) -> DataFrame:
    first, last = t.hive_posts.agg(F.min(F.least("block_num", "block_num_created")), F.max(F.greatest("block_num", "block_num_created"))).collect()[0]
    return store.posts_in_range(t.hive_posts, first, last)


@QUERIES.query("in01_posts_all_blocks", f"with {_ALL} select post_id, block from r")
def in01_all(t: Tables) -> DataFrame:
    return _all(t)


@QUERIES.query(
    "wn08_tasks_all_blocks",
    f"with {_ALL}, n as (select *, ((row_number() over (order by block, post_id) - 1) // 100)::int task from r) "
    "select task, min(block) as first_block, max(block) as last_block, list(post_id order by block, post_id) as post_ids from n group by task",
)
def wn08_all(t: Tables) -> DataFrame:
    return store.tasks(_all(t), 100)


@QUERIES.query(
    "in02_store_vectors_all_blocks",
    _BATCH.replace(_RANGE, _ALL) + """o as (select post_id, chunk_number, sync_seq, e from pv where post_id not in (select post_id from pre) union all select nv.post_id, nv.chunk_number, s.sync_seq, e from nv join s using (post_id))
select post_id, chunk_number, sync_seq, round(e[1], 5) + 0.0 as first, round(e[64], 5) + 0.0 as last from o""",
)
def in02_all(t: Tables) -> DataFrame:
    return _ends(_batch(t, _all(t)).vectors)


@QUERIES.query("in03_visible_seq", f"with {SQL}, mk as (select max(1000000 + id) m from hive_posts where counter_deleted > 0) select greatest(coalesce((select max(sync_seq) from pv), 0), coalesce((select m from mk), 0))::int as max_visible_sync_seq")
def in03(t: Tables) -> DataFrame:
    return store.visible_seq(vectors(t), _deleted(t))


@QUERIES.query(
    "ag06_batch_stats",
    """with pre as (select distinct post_id, coalesce(token_count, 0) tc from (select post_id, max(token_count) token_count from tmp_chunks group by 1)),
c as (select distinct post_id, chunk_number from tmp_chunks where length(trim(chunk_text)) > 0)
select count_if(post_id not in (select post_id from c))::int as discarded_posts, count_if(post_id in (select post_id from c))::int as processed_posts,
coalesce(sum(tc) filter (post_id in (select post_id from c)), 0)::int as total_tokens, (select count(*) from c)::int as embedding_chunks from pre""",
)
def ag06(t: Tables) -> DataFrame:
    pre = t.tmp_chunks.groupBy("post_id").agg(F.coalesce(F.max("token_count"), F.lit(0)).alias("token_count"))
    return store.batch_stats(pre, t.tmp_chunks.filter(F.length(F.trim("chunk_text")) > 0).select("post_id", "chunk_number").distinct())


def _texts(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("int").alias("post_id"), F.col("source").alias("title"), F.col("text").alias("body"), (F.col("doc_id") % 1000).cast("int").alias("block_num"))


@QUERIES.query("tx06_prepared_chunks")
def tx06(t: Tables) -> DataFrame:
    return store.prepare_chunks(_texts(t), config(tokens_per_chunk=128)).chunks


@QUERIES.query("tx06_prepared_posts")
def tx06_pre(t: Tables) -> DataFrame:
    return store.prepare_chunks(_texts(t), config(tokens_per_chunk=128)).pre


@QUERIES.query("tx05_chunk_counters")
def tx05(t: Tables) -> DataFrame:
    return chunk_counters(chunk_posts(t.documents, "doc_id", "text", 40, 0.15, "passage: "))


# -- feed ------------------------------------------------------------------------------------------------------
_FEED = f"""
with {SQL}, rows_ as (select distinct sync_seq, post_id from pv),
mk as (select max(sync_seq) sync_seq, post_id from posts_vectors group by post_id having min(sync_seq) < max(sync_seq) union select 1000000 + id, id from hive_posts where counter_deleted > 0),
a as (select * from rows_ where sync_seq > 100 and sync_seq <= {{top}} order by sync_seq, post_id limit {{n}}),
b as (select * from mk where sync_seq > 100 and sync_seq <= {{top}} order by sync_seq, post_id limit {{n}}),
ops as (select coalesce(a.sync_seq, b.sync_seq) sync_seq, coalesce(a.post_id, b.post_id) post_id,
  case when a.post_id is not null and b.post_id is not null then 'update' when a.post_id is not null then 'insert' else 'delete' end op
  from a full join b on a.sync_seq = b.sync_seq and a.post_id = b.post_id order by 1, 2 limit {{n}})"""


def _markers(t: Tables) -> DataFrame:
    """One under the current number of every post that had rows before, and those of deleted posts."""
    again = t.posts_vectors.groupBy("post_id").agg(F.min("sync_seq").alias("a"), F.max("sync_seq").alias("sync_seq")).filter("a < sync_seq")
    return again.select("sync_seq", "post_id").unionByName(_deleted(t))


@QUERIES.query("cf02_page_ops", _FEED.format(top=2_000_000, n=1000) + " select sync_seq, post_id, op from ops")
def cf02(t: Tables) -> DataFrame:
    v = vectors(t)
    return feed.page_ops(v, _markers(t), 100, 1000, 2_000_000)


@QUERIES.query(
    "cf01_embedding_updates",
    _FEED.format(top=900, n=500) + """, m as (
  select ops.*, ha.name author, k.permlink, pd.number_of_tokens, pd.last_vectors_block from ops join hive_posts hp on hp.id = ops.post_id
  join hive_accounts ha on ha.id = hp.author_id join hive_permlink_data k on k.id = hp.permlink_id join pd on pd.post_id = ops.post_id)
select sync_seq, op, author, permlink, number_of_tokens, last_vectors_block, (select count(*) from pv where pv.post_id = m.post_id and pv.sync_seq = m.sync_seq)::int as n_vectors,
  coalesce((select list(round(e[1], 5) order by chunk_number) from pv where pv.post_id = m.post_id and pv.sync_seq = m.sync_seq), []) as firsts from m""",
)
def cf01(t: Tables) -> DataFrame:
    v = vectors(t)
    names = feed.names_of_posts(t.hive_posts, t.hive_accounts, t.hive_permlink_data)
    page = feed.embedding_updates(v, _markers(t), metadata(t), names, config(sync_uuid="own", max_visible_sync_seq=900), 100, 500, "own")
    firsts = F.transform("embeddings", lambda v: F.round(F.element_at(v, 1).cast("double"), 5))
    return page.withColumns({"n_vectors": F.size("embeddings"), "firsts": firsts}).drop("embeddings")


@QUERIES.query(
    "ag13_vectors_per_op",
    f"with {SQL} select sync_seq, post_id, list(round(e[1], 5) + 0.0 order by chunk_number) as firsts from pv group by 1, 2",
)
def ag13(t: Tables) -> DataFrame:
    packed = vectors(t).groupBy("sync_seq", "post_id").agg(F.sort_array(F.collect_list(F.struct("chunk_number", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("x")))).alias("l"))
    return packed.select("sync_seq", "post_id", F.transform("l", lambda x: x["x"]).alias("firsts"))


@QUERIES.query(
    "cf05_chains",
    "select row_number() over (order by case when priority = 10 then 0 else 1 end, priority, sync_uuid)::int as position, sync_uuid, priority, llm, tokens_per_chunk from sync_chains",
)
def cf05(t: Tables) -> DataFrame:
    own, others = t.sync_chains.filter("priority = 10"), t.sync_chains.filter("priority <> 10")
    return feed.chain_list(own, others).select("position", "sync_uuid", "priority", "llm", "tokens_per_chunk")


@QUERIES.query(
    "cf04_settings",
    "select 'own' as sync_uuid, 'embed-small' as llm, 64::bigint as embedding_dimensionality, 'passage: ' as document_prefix, 'query: ' as query_prefix, 512::bigint as tokens_per_chunk, "
    "0.15::double as overlap_amount, 75::bigint as min_token_threshold, 40::bigint as max_embeddings_per_post, 0::bigint as skipped_op_count",
)
def cf04(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([{k: v for k, v in feed.sync_settings(config(sync_uuid="own", llm="embed-small", max_embeddings_per_post=40)).items()}])


# Operations of another chain, in normal form, resolved to local posts.
_OPS = r"""
nm as (
  select lower(trim(a.name)) author, lower(trim(k.permlink)) permlink, arg_max(p.id, (coalesce(p.counter_deleted, 1) = 0)::int::bigint * 10000000000 + p.id) post_id
  from hive_posts p join hive_accounts a on a.id = p.author_id join hive_permlink_data k on k.id = p.permlink_id group by 1, 2),
ops as (
  select distinct sync_seq, regexp_replace(lower(trim(author, E' \t\n\r')), '^@', '') author, regexp_replace(lower(trim(permlink, E' \t\n\r')), '^@', '') permlink,
    lower(trim(op, E' \t\n\r')) op, number_of_tokens, last_vectors_block, len(embeddings) chunks from embeddingupdate
  where sync_seq is not null and author is not null and permlink is not null and op is not null),
res as (select ops.*, nm.post_id from ops left join nm using (author, permlink))"""


def _resolved(t: Tables) -> DataFrame:
    from ..operators.diff import post_of_name

    ops = t.embeddingupdate.select("sync_seq", name_of("author").alias("author"), name_of("permlink").alias("permlink"), trimmed("op").alias("op"), "number_of_tokens", "last_vectors_block", "embeddings")
    ops = ops.na.drop(subset=["sync_seq", "author", "permlink", "op"])
    return feed.resolve_ops(ops, post_of_name(t.hive_posts, t.hive_accounts, t.hive_permlink_data))


@QUERIES.query("cf09_unresolved", f"with {_OPS} select sync_seq, author, permlink, op, count(*) as n from res where post_id is null group by all")
def cf09(t: Tables) -> DataFrame:
    lost = feed.unresolved(_resolved(t)).select("sync_seq", "author", "permlink", "op", "number_of_tokens", "last_vectors_block", F.size("embeddings").alias("chunks")).distinct()
    return lost.groupBy("sync_seq", "author", "permlink", "op").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.query(
    "cf08_applied",
    f"""with {_OPS}, w as (select post_id, max(sync_seq) sync_seq from res where post_id is not null group by 1)
select w.post_id, w.sync_seq, max((op <> 'delete')::int) = 1 as put from res join w using (post_id, sync_seq) group by 1, 2""",
)
def cf08(t: Tables) -> DataFrame:
    empty = lambda ddl: t.spark.createDataFrame([], ddl)
    data, kept, marks = feed.apply_ops(empty("post_id int, number_of_tokens int, last_vectors_block int"), empty("post_id int, chunk_number int, embedding array<float>, sync_seq int"), empty("post_id int, sync_seq int"), _resolved(t))
    gone = marks.withColumn("put", F.lit(False))
    last = _resolved(t).filter("post_id is not null").groupBy("post_id").agg(F.max("sync_seq").alias("sync_seq"))
    return data.select("post_id").join(last, "post_id").join(gone, ["post_id", "sync_seq"], "left").select("post_id", "sync_seq", F.coalesce("put", F.lit(True)).alias("put"))


@QUERIES.query(
    "cf08_vectors",
    f"""with {_OPS.replace("len(embeddings) chunks", "embeddings")}, w as (select post_id, max(sync_seq) sync_seq from res where post_id is not null group by 1),
x as (select distinct post_id, sync_seq, embeddings from res join w using (post_id, sync_seq) where op <> 'delete' and embeddings is not null),
y as (select post_id, sync_seq, generate_subscripts(embeddings, 1) i, unnest(embeddings)::double[] e from x)
select post_id, (i - 1)::int as chunk_number, sync_seq, round(e[1], 5) + 0.0 as first, round(e[-1], 5) + 0.0 as last from y""",
)
def cf08_vectors(t: Tables) -> DataFrame:
    """The vectors that all operations leave."""
    return _ends(feed.ops_change(_resolved(t)).vectors)


@QUERIES.query(
    "cf11_offsets",
    f"""with {_OPS}, d as (select distinct sync_seq, author, permlink, op, post_id, last_vectors_block from res)
select max(sync_seq) as last_seq, max(last_vectors_block) filter (post_id is not null) as last_block, count_if(post_id is null) as skipped_ops, count_if(post_id is not null and op <> 'delete') as inserts, count_if(post_id is not null and op = 'delete') as deletes from d""",
)
def cf11(t: Tables) -> DataFrame:
    rows = settle(_resolved(t).select("sync_seq", "author", "permlink", "op", "post_id", "last_vectors_block").distinct(), "resolved")
    s = feed.advance(feed.FeedState(), rows)
    return t.spark.createDataFrame([(s.last_seq, s.last_block, s.skipped_ops, s.inserts, s.deletes)], "last_seq int, last_block int, skipped_ops long, inserts long, deletes long")


@QUERIES.query("cf07_last_seq", f"with {SQL} select greatest((select max(sync_seq) from pv), (select max(1000000 + id) from hive_posts where counter_deleted > 0)) as last_seq")
def cf07(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(feed.last_seq(vectors(t), _markers(t)),)], "last_seq int")


@QUERIES.query("src07_feed_pull")
def src07(t: Tables) -> DataFrame:
    """Operations written as JSON pages and pulled again through the data source."""
    from ..sources.feed import COLUMNS, FeedSource

    path = workspace(t.spark, "pages")
    v = vectors(t)
    page = feed.embedding_updates(v, _markers(t), metadata(t), feed.names_of_posts(t.hive_posts, t.hive_accounts, t.hive_permlink_data), config(sync_uuid="own", max_visible_sync_seq=10_000_000), 0, 1000, "own")
    page.select(*COLUMNS).write.json(path, ignoreNullFields=False)
    t.spark.dataSource.register(FeedSource)
    return t.spark.read.format("vecloom_feed").option("folder", SharedFiles(t.spark, path).uri()).option("page_size", "200").load().drop("embeddings")


# -- rebase ----------------------------------------------------------------------------------------------------
_DUMP = f"""
with {SQL},
lo as (select regexp_replace(lower(trim(author, E' \\t\\n\\r')), '^@', '') author, regexp_replace(lower(trim(permlink, E' \\t\\n\\r')), '^@', '') permlink, chunk_number, sync_seq, try_cast(nullif(trim(embedding), '') as float[])::double[] v from legacy_vectors_raw),
dv as (select distinct author, permlink, chunk_number, sync_seq, v from lo join (select author, permlink, max(sync_seq) sync_seq from lo group by 1, 2) using (author, permlink, sync_seq)
  where len(v) = 64 and list_sum(list_transform(v, lambda x: abs(x))) > 0),
fo as (select distinct sync_seq, regexp_replace(lower(trim(author, E' \\t\\n\\r')), '^@', '') author, regexp_replace(lower(trim(permlink, E' \\t\\n\\r')), '^@', '') permlink, lower(trim(op, E' \\t\\n\\r')) op, number_of_tokens, last_vectors_block
  from embeddingupdate where sync_seq is not null and author is not null and permlink is not null),
dd as (select distinct author, permlink, sync_seq from fo where op = 'delete'),
dp as (select author, permlink, max(number_of_tokens) number_of_tokens, max(last_vectors_block) last_vectors_block from fo group by 1, 2),
dr as (select distinct a.name author, k.permlink from hive_posts p join hive_accounts a on a.id = p.author_id join hive_permlink_data k on k.id = p.permlink_id
  where (p.root_id = p.id or p.root_id = 0) and p.counter_deleted = 0 and p.block_num_created < 80000300),
an as (select author, permlink from dv union select author, permlink from dd union select author, permlink from dp union select author, permlink from dr),
nm as (select a.name author, k.permlink, arg_max(p.id, (p.counter_deleted = 0)::int::bigint * 10000000000 + p.id) post_id from hive_posts p join hive_accounts a on a.id = p.author_id join hive_permlink_data k on k.id = p.permlink_id group by 1, 2),
na as (select an.*, nm.post_id from an left join nm using (author, permlink)),
ov as (select post_id, chunk_number, v, sync_seq from dv join na using (author, permlink) where post_id is not null),
od as (select post_id, sync_seq from dd join na using (author, permlink) where post_id is not null),
op_ as (select post_id, number_of_tokens, last_vectors_block from dp join na using (author, permlink) where post_id is not null),
oc as (select post_id, count(*) o from ov group by 1), nc as (select post_id, count(*) n from pv group by 1),
pairs as (select ov.post_id, ov.chunk_number, round(list_cosine_distance(ov.v, pv.e), 9) dist from ov join oc using (post_id) join nc using (post_id) left join pv on pv.post_id = ov.post_id and pv.chunk_number = ov.chunk_number where o = n),
ms as (select post_id, 'gone' reason from oc where post_id not in (select post_id from nc) union all select post_id, 'new' from nc where post_id not in (select post_id from oc)
  union all select post_id, 'rechunked' from oc join nc using (post_id) where o <> n union all select distinct post_id, 'rechunked' from pairs where dist is null or dist > 0.001),
sq as (select post_id, reason, (20000000 + row_number() over (order by post_id))::int sync_seq from ms)"""


def _dump(t: Tables) -> rebase.Dump:
    by = ["author", "permlink"]
    from ..functions.vectors import from_text, usable

    old = t.legacy_vectors_raw.select(name_of("author").alias("author"), name_of("permlink").alias("permlink"), "chunk_number", from_text("embedding").alias("v"), "sync_seq")
    old = current(old.na.drop(subset=by), by).filter(usable(F.col("v"), 64)).select(*by, "chunk_number", to_text(F.col("v").cast("array<float>")).alias("embedding"), "sync_seq").distinct()
    ops = t.embeddingupdate.select("sync_seq", name_of("author").alias("author"), name_of("permlink").alias("permlink"), trimmed("op").alias("op"), "number_of_tokens", "last_vectors_block").na.drop(subset=["sync_seq", *by])
    roots = (
        t.hive_posts.filter(((F.col("root_id") == F.col("id")) | (F.col("root_id") == 0)) & (F.col("counter_deleted") == 0) & (F.col("block_num_created") < 80000300))
        .join(t.hive_accounts.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id")
        .join(t.hive_permlink_data.select(F.col("id").alias("permlink_id"), "permlink"), "permlink_id")
    )
    return rebase.Dump(
        old, ops.filter("op = 'delete'").select(*by, "sync_seq").distinct(),
        ops.groupBy(*by).agg(F.max("number_of_tokens").alias("number_of_tokens"), F.max("last_vectors_block").alias("last_vectors_block")), roots.select(*by).distinct(),
    )


def _old(t: Tables) -> tuple[rebase.Dump, rebase.Old]:
    d = _dump(t)
    o = rebase.resolve(d, t.hive_posts, t.hive_accounts, t.hive_permlink_data)
    o.vectors = settle(o.vectors, "old-vectors")
    return d, o


@QUERIES.query(
    "rb04_resolve_metrics",
    _DUMP + """ select 'old_vector_rows' as metric, (select count(*) from dv) as n union all select 'old_vector_rows_resolved', (select count(*) from ov)
union all select 'old_posts_with_vectors', (select count(distinct (author, permlink)) from dv)
union all select 'old_posts_with_vectors_unresolved', (select count(*) from na where post_id is null and (author, permlink) in (select (author, permlink) from dv))
union all select 'old_delete_markers_unresolved', (select count(*) from dd join na using (author, permlink) where post_id is null)
union all select 'old_root_posts', (select count(*) from dr) union all select 'old_root_posts_missing_here', (select count(*) from dr join na using (author, permlink) where post_id is null)
union all select 'new_root_posts_missing_in_old', (select count(*) from hive_posts p join hive_accounts a on a.id = p.author_id join hive_permlink_data k on k.id = p.permlink_id
  where (p.root_id = p.id or p.root_id = 0) and p.counter_deleted = 0 and p.block_num_created <= 80000400 and not exists (select 1 from dr where dr.author = a.name and dr.permlink = k.permlink))""",
)
def rb04(t: Tables) -> DataFrame:
    d, o = _old(t)
    return rebase.resolve_metrics(d, o, t.hive_posts, t.hive_accounts, t.hive_permlink_data, 80000400)


@QUERIES.query("rb04_unresolved", _DUMP + " select author, permlink, (author, permlink) in (select (author, permlink) from dv) as had_vectors from na where post_id is null")
def rb04_unresolved(t: Tables) -> DataFrame:
    return _old(t)[1].unresolved


@QUERIES.query("rb05_diff_counts", _DUMP + " select reason, count(*) as posts from ms group by 1 union all select 'total', count(*) from ms union all select 'unchanged', count(*) from oc where post_id not in (select post_id from ms)")
def rb05(t: Tables) -> DataFrame:
    _, o = _old(t)
    return rebase.diff_counts(o.vectors, rebase.merge_set(o.vectors, vectors(t)))


@QUERIES.query(
    "rb05_histogram",
    _DUMP + """ select case when dist is null then '0 chunk missing' when dist <= 1e-6 then '1 <= 1e-6' when dist <= 1e-5 then '2 <= 1e-5' when dist <= 1e-4 then '3 <= 1e-4'
when dist <= 1e-3 then '4 <= 1e-3' when dist <= 1e-2 then '5 <= 1e-2' when dist <= 1e-1 then '6 <= 1e-1' else '7 > 1e-1' end as bucket, count(*) as chunk_pairs from pairs group by 1""",
)
def rb05_histogram(t: Tables) -> DataFrame:
    _, o = _old(t)
    return rebase.histogram(rebase.chunk_pairs(o.vectors, vectors(t)))


def _merged(t: Tables) -> tuple[rebase.Old, DataFrame, store.Tables]:
    _, o = _old(t)
    now = store.Tables(metadata(t), vectors(t), vectors(t).limit(0).select("post_id", "sync_seq"))
    seqs = settle(rebase.merge_seqs(rebase.merge_set(o.vectors, now.vectors), 20_000_000), "merge-seqs")
    return o, seqs, rebase.build_merged(o, now, seqs, None)


@QUERIES.query(
    "rb06_merged_vectors",
    _DUMP + ", o as (select post_id, chunk_number, sync_seq, v e from ov where post_id not in (select post_id from sq) union all select pv.post_id, pv.chunk_number, sq.sync_seq, e from pv join sq using (post_id)) select post_id, chunk_number, sync_seq, round(e[1], 5) + 0.0 as first, round(e[64], 5) + 0.0 as last from o",
)
def rb06_vectors(t: Tables) -> DataFrame:
    return _ends(_merged(t)[2].vectors)


@QUERIES.query("rb06_merged_markers", _DUMP + " select post_id, sync_seq from od union all select post_id, sync_seq from sq where reason in ('gone', 'rechunked')")
def rb06_markers(t: Tables) -> DataFrame:
    return _merged(t)[2].markers


_DATA = """, keep as (select * from op_ where post_id not in (select post_id from sq)),
chg as (select sq.post_id, coalesce(pd.number_of_tokens, l.number_of_tokens, 0) number_of_tokens, coalesce(pd.last_vectors_block, l.last_vectors_block, -1) last_vectors_block from sq left join pd using (post_id) left join op_ l on l.post_id = sq.post_id),
al as (select * from keep union all select * from chg),
rf as (select post_id from ov where post_id not in (select post_id from sq) union select post_id from pv join sq using (post_id) union select post_id from od union select post_id from sq where reason in ('gone', 'rechunked'))
select post_id, number_of_tokens, last_vectors_block from al union all select post_id, 0, -1 from rf where post_id not in (select post_id from al)"""


@QUERIES.query("rb06_merged_metadata", _DUMP + _DATA)
def rb06_metadata(t: Tables) -> DataFrame:
    return _merged(t)[2].post_data


_METRICS = (
    _DUMP + _DATA.replace("\nselect post_id, number_of_tokens, last_vectors_block from al", ",\nmd as (select post_id, number_of_tokens, last_vectors_block from al") + "),\n"
    "mv as (select post_id, chunk_number from ov where post_id not in (select post_id from sq) union all select post_id, chunk_number from pv join sq using (post_id)),\n"
    "mm as (select post_id from od union all select post_id from sq where reason in ('gone', 'rechunked'))\n"
    "select 'merge_ops' as metric, count(*) as n from sq union all select 'first_merge_seq', 20000001 union all select 'last_merge_seq', 20000000 + count(*) from sq "
    "union all select 'merged_vector_rows', count(*) from mv union all select 'merged_posts_with_vectors', count(distinct post_id) from mv "
    "union all select 'merged_delete_markers', count(*) from mm union all select 'merged_post_data_rows', count(*) from md"
)


@QUERIES.query("rb06_merge_metrics", _METRICS)
def rb06_metrics(t: Tables) -> DataFrame:
    _, seqs, tables = _merged(t)
    return rebase.merge_metrics(tables, seqs, 20_000_000)


@QUERIES.query("rb10_verify", "select unnest(['identity', 'visible', 'head', 'count', 'dense', 'kinds', 'end', 'posts', 'chain', 'search', 'index', 'cleaned']) as check, true as ok")
def rb10(t: Tables) -> DataFrame:
    """The whole rebase: dump to CSV and back, resolve, diff, merge, swap, and the checks by replaying the feed."""
    path = workspace(t.spark, "rebase")
    d = _dump(t)
    write_dump(d, f"{path}/dump")
    write_status(t.spark, f"{path}/dump", StatusLine("old-uuid", 20_000_000, 3, 80000400))
    d, line = read_dump(t.spark, f"{path}/dump"), read_status(t.spark, f"{path}/dump")
    state = rebase.RebaseState().identity(line.sync_uuid, line.tail_seq, line.skipped, line.block)
    o = rebase.resolve(d, t.hive_posts, t.hive_accounts, t.hive_permlink_data)
    o.vectors = settle(o.vectors, "old-vectors")
    state = state.to("resolved")
    now = store.Tables(metadata(t), settle(vectors(t), "now"), t.spark.createDataFrame([], "post_id int, sync_seq int"))
    seqs = settle(rebase.merge_seqs(rebase.merge_set(o.vectors, now.vectors), line.tail_seq), "merge-seqs")
    state = state.to("diffed")
    rebase.guard(state, o, config())
    merged = rebase.build_merged(o, now, seqs, None)
    merged.vectors = settle(merged.vectors, "merged")
    state = state.to("tables_built", merge_count=seqs.count())
    rebase.check_unique(merged)
    index, stats = InvertedFile.build(merged.vectors.select("post_id", "chunk_number", "embedding"), f"{path}/index", 8)
    state = state.to("indexes_built")
    s = store.Store(t.spark, f"{path}/store")
    state = rebase.swap(s, merged, state)
    live, status = s.tables(), s.status()
    ops = feed.page_ops(live.vectors, live.markers, line.tail_seq, state.merge_count + 1, status.max_visible_sync_seq)
    beyond = feed.page_ops(live.vectors, live.markers, status.max_visible_sync_seq, 10, 2**31 - 1).count()
    found = index.probe(list(live.vectors.filter("embedding is not null").first().embedding), 2).limit(5).count()
    checks = rebase.verify(ops, seqs, o, live, state, status.sync_uuid, status.max_visible_sync_seq, line.sync_uuid, beyond, found)
    kept = live.vectors.count()
    state = rebase.cleanup(s, state, [f"{path}/dump"])
    checks += [("index", stats.rows == kept, f"{stats.rows} of {kept}"), ("cleaned", not SharedFiles(t.spark, path).exists("dump"), state.phase)]
    return t.spark.createDataFrame([(name, ok) for name, ok, _ in checks], "check string, ok boolean")
