"""Queries of the general data-pipeline operators: incremental processing, change log, diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.changelog import ChangeLog, feed_changes
from ..operators.diff import vector_diff
from ..operators.incremental import done_runs, due_posts, post_states
from ..session import workspace
from .registry import Registry, Tables

QUERIES = Registry()

#: Edge white space for DuckDB's trim, as in functions.names.EDGE.
_WS = r"E' \t\n\r\x0b\x0c 　'"


def _name(col: str) -> str:
    return f"regexp_replace(lower(trim({col}, {_WS})), '^@', '')"


P1 = """
with last as (
  select run_id, max(struct_pack(r := reported_at, c := consumer, a := after_seq, l := last_seq, ab := after_block, lb := last_block, s := status)) m
  from sync_runs where consumer is not null group by run_id),
ok as (select m.c c, m.a a, m.l l, m.ab ab, m.lb lb from last where lower(trim(m.s)) = 'done'),
state as (
  select post_id, max(seq) seq, max(blk) blk from (
    select post_id, sync_seq seq, null::int blk from posts_vectors
    union all select post_id, null, last_vectors_block from post_data where last_vectors_block >= 0)
  where post_id is not null group by post_id),
who as (select distinct consumer from sync_runs where consumer is not null)
select consumer, post_id from who, state
where (seq is not null and not exists (select 1 from ok where ok.c = consumer and seq > a and seq <= l))
   or (blk is not null and not exists (select 1 from ok where ok.c = consumer and blk > ab and blk <= lb))
"""


def _as_of_last_run(t: Tables) -> tuple[DataFrame, DataFrame]:
    """posts_vectors and post_data as they stood at the end of the last successful run of any consumer."""
    upto = done_runs(t.sync_runs).agg(F.max("last_seq").alias("seq"), F.max("last_block").alias("block")).collect()[0]  # one row
    return t.posts_vectors.filter(F.col("sync_seq") <= (upto.seq or 0)), t.post_data.filter(F.col("last_vectors_block") <= (upto.block or 0))


@QUERIES.query("p1_found", P1)
def p1_found(t: Tables) -> DataFrame:
    """The state is kept as of the last successful run and then brought up to date, as in every run of a consumer: only the
    partitions that have got records since are recomputed."""
    path = workspace(t.spark, "p1")
    post_states(t.spark, *_as_of_last_run(t), path)
    return due_posts(t.spark, t.posts_vectors, t.post_data, t.sync_runs, path)


@QUERIES.query(
    "p1_recomputed",
    """
with r as (select arg_max(struct_pack(l := last_seq, b := last_block, s := status), struct_pack(r := reported_at, c := consumer, a := after_seq, l := last_seq, ab := after_block, lb := last_block, s := status)) m
  from sync_runs where consumer is not null group by run_id),
u as (select coalesce(max(m.l), 0) seq, coalesce(max(m.b), 0) block from r where lower(trim(m.s)) = 'done'),
p as (select 'as of the last run' step, post_id, 1 k from posts_vectors, u where sync_seq <= seq union all select 'as of the last run', post_id, 1 from post_data, u where last_vectors_block between 0 and block
  union all select s, post_id, k from (values ('now', 2), ('again', 3)) x(s, k), (select post_id from posts_vectors union all select post_id from post_data where last_vectors_block >= 0))
select step, count(distinct post_id) posts, k = 1 as all_partitions, k < 3 as some_partitions from p where post_id is not null group by step, k
""",
)
def p1_recomputed(t: Tables) -> DataFrame:
    """(step, posts, all_partitions, some_partitions): posts in the derived table after each of three refreshes, and whether
    all partitions with rows or any were recomputed."""
    path, rows = workspace(t.spark, "p1r"), []
    for step, sources in (("as of the last run", _as_of_last_run(t)), ("now", (t.posts_vectors, t.post_data)), ("again", (t.posts_vectors, t.post_data))):
        table, kept = post_states(t.spark, *sources, path)
        rows.append((step, table.count(), len(kept.changed) == kept.filled, bool(kept.changed)))
    return t.spark.createDataFrame(rows, "step string, posts long, all_partitions boolean, some_partitions boolean")


P2 = f"""
with f as (
  select sync_seq, {_name("author")} author, {_name("permlink")} permlink, lower(trim(op, {_WS})) op, number_of_tokens, last_vectors_block
  from embeddingupdate),
l as (
  select author, permlink, max(struct_pack(s := sync_seq, p := op <> 'delete', n := number_of_tokens, b := last_vectors_block)) m from f
  where sync_seq is not null and author is not null and permlink is not null and op in ('insert', 'update', 'delete') group by 1, 2)
"""


def _log(t: Tables, name: str, payload: str = "") -> ChangeLog:
    from pyspark.sql.types import StructType

    log = ChangeLog(t.spark, workspace(t.spark, name), ["author", "permlink"], "sync_seq", StructType.fromDDL(payload) if payload else None)
    log.append(feed_changes(t.embeddingupdate), F.coalesce(F.date_format("received_at", "yyyyMMdd"), F.lit("undated")))
    return log


@QUERIES.query("p2_found", P2 + "select author, permlink, m.s as sync_seq from l where m.p")
def p2_found(t: Tables) -> DataFrame:
    return _log(t, "p2").merged().select("author", "permlink", F.col("sync_seq").cast("int").alias("sync_seq"))


@QUERIES.query("p2_compacted", P2 + "select author, permlink, m.s as sync_seq, m.n as number_of_tokens, m.b as last_vectors_block from l where m.p")
def p2_compacted(t: Tables) -> DataFrame:
    log = _log(t, "p2c", "number_of_tokens int, last_vectors_block int")
    log.compact("base")
    return log.merged().select("author", "permlink", F.col("sync_seq").cast("int").alias("sync_seq"), "number_of_tokens", "last_vectors_block")


_USABLE = "len({v}) = 64 and list_sum(list_transform({v}, lambda x: abs(x))) > 0"
P6 = f"""
with nm as (
  select {_name("a.name")} author, {_name("k.permlink")} permlink, arg_max(p.id, (coalesce(p.counter_deleted, 1) = 0)::int::bigint * 10000000000 + p.id) post_id
  from hive_posts p join hive_accounts a on a.id = p.author_id join hive_permlink_data k on k.id = p.permlink_id group by 1, 2),
lo as (
  select {_name("author")} author, {_name("permlink")} permlink, chunk_number, sync_seq, try_cast(nullif(trim(embedding), '') as double[]) v from legacy_vectors_raw),
o as (
  select distinct author, permlink, chunk_number, sync_seq, case when {_USABLE.format(v="v")} then v end v
  from lo join (select author, permlink, max(sync_seq) sync_seq from lo group by 1, 2) using (author, permlink, sync_seq)),
n as (
  select distinct author, permlink, chunk_number, sync_seq, case when {_USABLE.format(v="embedding")} then embedding::double[] end v
  from posts_vectors join (select post_id, max(sync_seq) sync_seq from posts_vectors group by 1) using (post_id, sync_seq) join nm using (post_id)),
j as (
  select coalesce(o.author, n.author) author, coalesce(o.permlink, n.permlink) permlink, coalesce(o.chunk_number, n.chunk_number) chunk_number,
    o.author is null lo, n.author is null ln, o.sync_seq so, n.sync_seq sn, o.v vo, n.v vn
  from o full join n on o.author = n.author and o.permlink = n.permlink and o.chunk_number = n.chunk_number)
select author, permlink, chunk_number, 'only_old' as what from j where ln
union all select author, permlink, chunk_number, 'only_new' from j where lo
union all select author, permlink, chunk_number, 'sync_seq' from j where not lo and not ln and so <> sn
union all select author, permlink, chunk_number, 'embedding' from j
  where not lo and not ln and ((vo is null) <> (vn is null) or list_cosine_distance(vo, vn) > 0.001)
"""


@QUERIES.query("p6_found", P6)
def p6_found(t: Tables) -> DataFrame:
    return vector_diff(t.legacy_vectors_raw, t.posts_vectors, t.hive_posts, t.hive_accounts, t.hive_permlink_data)
