"""Relations that several queries share, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..functions.vectors import usable
from ..operators.diff import current
from ..operators.search import Corpus
from .registry import Tables

DIMS, SLICE, COMPONENTS = 64, 16, 16

#: pv: current usable vectors, once each; pd: metadata, one row a post; mute: who mutes whom.
SQL = """
pv as (
  select distinct v.post_id, v.chunk_number, v.embedding::double[] e, v.sync_seq
  from posts_vectors v join (select post_id, max(sync_seq) sync_seq from posts_vectors group by post_id) m using (post_id, sync_seq)
  where len(v.embedding) = 64 and list_sum(list_transform(v.embedding, lambda x: abs(x))) > 0),
pd as (select post_id, max(number_of_tokens) number_of_tokens, max(last_vectors_block) last_vectors_block from post_data group by post_id),
mute as (select length(name) - 8 observer_id, id muted_id from hive_accounts where length(name) between 9 and 12),
q as (select post_id, e from pv order by post_id, chunk_number limit 1)"""


def vectors(t: Tables) -> DataFrame:
    """Current usable vectors, once each. Rows of a post are current under one sync_seq, so grouping by that too needs no
    shuffle of its own after the join that finds them."""
    rows = current(t.posts_vectors, ["post_id"]).filter(usable(F.col("embedding").cast("array<double>"), DIMS))
    return rows.groupBy("post_id", "sync_seq", "chunk_number").agg(F.max("embedding").alias("embedding")).select("post_id", "chunk_number", "embedding", "sync_seq")


def metadata(t: Tables) -> DataFrame:
    return t.post_data.groupBy("post_id").agg(F.max("number_of_tokens").alias("number_of_tokens"), F.max("last_vectors_block").alias("last_vectors_block"))


def muted(t: Tables) -> DataFrame:
    """Observers 1 to 4 mute the accounts with names of 9 to 12 characters."""
    return t.hive_accounts.filter("length(name) between 9 and 12").select((F.length("name") - 8).alias("observer_id"), F.col("id").alias("muted_id"))


def corpus(t: Tables) -> Corpus:
    """The tables as they are: searches find the current rows themselves, on distances instead of vectors."""
    return Corpus(t.posts_vectors, t.hive_posts, metadata(t), muted(t), t.hive_accounts, t.hive_permlink_data, versions=True)


def first_keys(t: Tables, n: int) -> list[tuple[int, int]]:
    """(post_id, chunk_number) of the first current usable vectors."""
    narrow = t.posts_vectors.filter(usable(F.col("embedding").cast("array<double>"), DIMS)).select("post_id", "chunk_number", "sync_seq")
    rows = current(narrow, ["post_id"], top=t.posts_vectors).select("post_id", "chunk_number").distinct()
    return [tuple(r) for r in rows.orderBy("post_id", "chunk_number").limit(n).collect()]


def vectors_of(t: Tables, keys: list[tuple[int, int]]) -> list[list[float]]:
    """Current vectors of a few posts, in order."""
    some = current(t.posts_vectors.filter(F.col("post_id").isin(sorted({p for p, _ in keys}))), ["post_id"])
    found = {(r.post_id, r.chunk_number): list(r.embedding) for r in some.filter(usable(F.col("embedding").cast("array<double>"), DIMS)).select("post_id", "chunk_number", "embedding").collect()}
    return [found[k] for k in keys]


def first_vectors(t: Tables, n: int) -> list[list[float]]:
    return vectors_of(t, first_keys(t, n))


def first_query(t: Tables) -> tuple[int, list[float]]:
    """The lowest post and the vector of its lowest chunk: the reference vector of the searches."""
    keys = first_keys(t, 1)
    return keys[0][0], vectors_of(t, keys)[0]


def config(**changes) -> Config:
    return Config(dims=DIMS).with_(**changes)
