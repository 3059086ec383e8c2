"""The change feed: pages of operations, chains and settings, and their consumption."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import Config
from .store import Change, Tables, applied


def page_ops(vectors: DataFrame, markers: DataFrame, after_seq: int, page_size: int, max_visible: int) -> DataFrame:
    """(sync_seq, post_id, op): the first operations behind after_seq.

    Both inputs are limited before they are joined, and the join is limited again. Rows and marker of one sequence
    are an update, rows alone an insert, a marker alone a delete.
    """
    span = lambda df: df.filter((F.col("sync_seq") > after_seq) & (F.col("sync_seq") <= max_visible)).select("sync_seq", "post_id").distinct().orderBy("sync_seq", "post_id").limit(page_size)
    rows, gone = span(vectors).withColumn("_v", F.lit(True)), span(markers).withColumn("_d", F.lit(True))
    op = F.when(F.col("_v").isNotNull() & F.col("_d").isNotNull(), "update").when(F.col("_v").isNotNull(), "insert").otherwise("delete")
    return rows.join(gone, ["sync_seq", "post_id"], "full").select("sync_seq", "post_id", op.alias("op")).orderBy("sync_seq", "post_id").limit(page_size)


def names_of_posts(posts: DataFrame, accounts: DataFrame, permlinks: DataFrame) -> DataFrame:
    """(post_id, author, permlink)"""
    return (
        posts.select(F.col("id").alias("post_id"), "author_id", "permlink_id")
        .join(accounts.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id")
        .join(permlinks.select(F.col("id").alias("permlink_id"), "permlink"), "permlink_id")
        .select("post_id", "author", "permlink")
    )


def embedding_updates(vectors: DataFrame, markers: DataFrame, post_data: DataFrame, names: DataFrame, config: Config, after_seq: int, page_size: int, sync_uuid: str) -> DataFrame:
    """A page of the feed with names, metadata and the chunk vectors in order (empty for deletes).

    Metadata is joined after the limit, so an operation without it shortens the page. Another chain's uuid is refused.
    """
    if sync_uuid != config.sync_uuid:
        raise ValueError("sync_uuid mismatch: this is another chain; local vectors must be dropped before syncing from it")
    ops = page_ops(vectors, markers, after_seq, page_size, config.max_visible_sync_seq)
    meta = ops.join(names, "post_id").join(post_data.select("post_id", "number_of_tokens", "last_vectors_block"), "post_id")
    span = (F.col("sync_seq") > after_seq) & (F.col("sync_seq") <= config.max_visible_sync_seq)
    packed = (
        vectors.filter(span).join(ops.select("sync_seq", "post_id"), ["sync_seq", "post_id"], "left_semi")
        .groupBy("sync_seq", "post_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_number", "embedding"))), lambda x: x["embedding"]).alias("embeddings"))
    )
    out = meta.join(packed, ["sync_seq", "post_id"], "left")
    return out.select("sync_seq", "op", "author", "permlink", "number_of_tokens", "last_vectors_block", F.coalesce("embeddings", F.array().cast("array<array<float>>")).alias("embeddings")).orderBy("sync_seq")


def feed_headers(config: Config, current_block: int) -> dict[str, str]:
    return {"X-Current-Block-Num": str(current_block), "X-Skipped-Op-Count": str(config.skipped_op_count + config.upstream_skipped_op_count)}


# Settings that nodes of one chain share, in the order they are reported.
SETTING_KEYS = ("llm", "embedding_dimensionality", "document_prefix", "query_prefix", "tokens_per_chunk", "overlap_amount", "min_token_threshold", "max_embeddings_per_post")


def sync_settings(config: Config) -> dict[str, Any]:
    """What a downstream node must share with this one."""
    return {
        "sync_uuid": config.sync_uuid, "llm": config.llm, "embedding_dimensionality": config.dims, "document_prefix": config.document_prefix, "query_prefix": config.query_prefix,
        "tokens_per_chunk": config.tokens_per_chunk, "overlap_amount": config.overlap_amount, "min_token_threshold": config.min_token_threshold,
        "max_embeddings_per_post": config.max_embeddings_per_post, "skipped_op_count": config.skipped_op_count + config.upstream_skipped_op_count,
    }


def chain_list(own: DataFrame, foreign: DataFrame) -> DataFrame:
    """The own chain first, then the others by priority and uuid; position counts from 1. A handful of rows."""
    columns = [c for c in foreign.columns if c in own.columns]
    both = own.select(*columns, F.lit(0).alias("_own")).unionByName(foreign.select(*columns, F.lit(1).alias("_own")))
    w = W.orderBy("_own", F.when(F.col("_own") == 1, F.col("priority")), "sync_uuid")
    return both.withColumn("position", F.row_number().over(w).cast("int")).drop("_own")


def _agree(a: Any, b: Any, tolerance: float) -> bool:
    """Are two settings the same? Fractions, which chains send in single precision, within the tolerance."""
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return abs(a - b) <= tolerance
    return a == b


def config_mismatches(local: Mapping[str, Any], chain: Mapping[str, Any], tolerance: float = 1e-6) -> list[str]:
    """Settings in which a chain disagrees with the local node; a setting that one side leaves out is null there."""
    return [key for key in SETTING_KEYS if not _agree(local.get(key), chain.get(key), tolerance)]


def select_chain(chains: Iterable[Mapping[str, Any]], local: Mapping[str, Any], known_uuid: str | None = None) -> Mapping[str, Any]:
    """The chain to follow: the known one if its settings still agree, otherwise the first that agrees."""
    chains = list(chains)
    if not chains:
        raise LookupError("the server offers no chain")
    if known_uuid:
        mine = next((c for c in chains if c["sync_uuid"] == known_uuid), None)
        if mine is None:
            raise LookupError(f"chain {known_uuid} is no longer offered")
        if bad := config_mismatches(local, mine):
            raise ValueError(f"settings of chain {known_uuid} changed: {', '.join(bad)}")
        return mine
    for chain in chains:
        if not config_mismatches(local, chain):
            return chain
    raise LookupError("no chain has these settings")


# -- consumption ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class FeedState:
    """Where a consumer stands."""

    last_seq: int = 0
    last_block: int = 0
    skipped_ops: int = 0
    upstream_skipped: int = 0
    inserts: int = 0
    deletes: int = 0


def last_seq(vectors: DataFrame, markers: DataFrame, visible_floor: int = 0) -> int:
    """The highest sequence stored, at least the floor that was published."""
    top = vectors.agg(F.max("sync_seq").alias("m")).unionByName(markers.agg(F.max("sync_seq").alias("m"))).agg(F.max("m").alias("m")).collect()[0].m
    return max(top or 0, visible_floor)


def resolve_ops(ops: DataFrame, name_to_post: DataFrame) -> DataFrame:
    """Operations with post_id, null where the local node has no such post. Names are compared in lower case."""
    return ops.join(name_to_post.select("author", "permlink", "post_id"), ["author", "permlink"], "left")


def unresolved(resolved: DataFrame) -> DataFrame:
    """Operations to be counted and kept aside (policy skip) or refused (policy exit)."""
    return resolved.filter(F.col("post_id").isNull())


def ready(resolved_or_ops: DataFrame, dependency_head: int) -> bool:
    """May the page be applied? Not before the dependency has reached every block it names; deletes don't wait."""
    need = resolved_or_ops.filter(F.col("op") != "delete").agg(F.max("last_vectors_block").alias("m")).collect()[0].m
    return need is None or need <= dependency_head


def upstream_gap(state: FeedState, advertised: int) -> int:
    """New gaps upstream; the known count never falls."""
    return max(0, advertised - state.upstream_skipped)


def ops_change(ops: DataFrame) -> Change:
    """What resolved operations do.

    Only the last operation of a post counts (highest sync_seq, a put before a delete), found without its vectors. It
    replaces the metadata and all vectors; a delete leaves a marker, an insert or update doesn't. Operations without a post
    are passed over, repeated ones count once.
    """
    mine = ops.filter(F.col("post_id").isNotNull()).withColumns({"_put": F.col("op") != "delete", "_h": F.xxhash64("embeddings")})
    by = ["sync_seq", "_put", "_h"]
    last = mine.groupBy("post_id").agg(F.max(F.struct(*by, "number_of_tokens", "last_vectors_block")).alias("o")).select("post_id", "o.*")
    whole = mine.filter("_put").select("post_id", *by, "embeddings").join(last.filter("_put").select("post_id", *by), ["post_id", *by])
    put = whole.groupBy("post_id", *by).agg(F.first("embeddings").alias("embeddings")).select("post_id", F.posexplode("embeddings").alias("chunk_number", "embedding"), "sync_seq")
    return Change(
        last.select("post_id"), last.select("post_id", "number_of_tokens", "last_vectors_block"), put.select("post_id", "chunk_number", "embedding", "sync_seq"), last.filter("not _put").select("post_id", "sync_seq"),
    )


def apply_ops(post_data: DataFrame, vectors: DataFrame, markers: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New (post_data, vectors, markers) after ``ops_change``."""
    t = applied(Tables(post_data, vectors, markers), ops_change(ops))
    return t.post_data, t.vectors, t.markers


def advance(state: FeedState, resolved: DataFrame, advertised_skips: int | None = None) -> FeedState:
    """The sequence moves past all operations, skipped ones included; the block only past resolved ones."""
    found = F.col("post_id").isNotNull()
    gone = F.col("op") == "delete"
    r = resolved.agg(
        F.max("sync_seq").alias("seq"), F.max(F.when(found, F.col("last_vectors_block"))).alias("block"), F.count_if(~found).alias("skipped"),
        F.count_if(found & gone).alias("deletes"), F.count_if(found & ~gone).alias("inserts"),
    ).collect()[0]
    return FeedState(
        max(state.last_seq, r.seq or 0), max(state.last_block, r.block or 0), state.skipped_ops + r.skipped,
        max(state.upstream_skipped, advertised_skips or 0), state.inserts + r.inserts, state.deletes + r.deletes,
    )
