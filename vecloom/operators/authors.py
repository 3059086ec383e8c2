"""Authors of a topic: every near chunk of an author adds one over the root of its rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import AUTHOR_FACTOR, MAX_AUTHORS, MAX_EXHAUSTIVE, Config, Debug, ann_candidates, clamp, gate
from .search import Corpus, hide_muted, measured, nearest_chunks, rounded_distance, stored_form


def score_authors(chunks: DataFrame, limit: int) -> DataFrame:
    """(rank, author_id, similarity, score) from (author_id, post_id, chunk_number, similarity).

    Chunks are ranked, not posts, and all of an author's chunks count. similarity is the author's best distance.
    chunks are bounded by the candidate limit, so the ranking may run in one partition.
    """
    numbered = chunks.withColumn("_rn", F.row_number().over(W.orderBy("similarity", "post_id", "chunk_number")))
    scores = numbered.groupBy("author_id").agg(F.min("similarity").alias("similarity"), F.round(F.sum(1.0 / F.sqrt("_rn")), 6).alias("score"))
    top = scores.orderBy(F.desc("score"), "author_id").limit(limit)
    return top.select(F.row_number().over(W.orderBy(F.desc("score"), "author_id")).cast("int").alias("rank"), "author_id", "similarity", "score")


def thematic_authors(corpus: Corpus, query: Sequence[float], config: Config, limit: int = 1, observer: int = 0, debug: Debug | None = None) -> DataFrame:
    """The best authors near a vector in any of the four modes. Chunks without a post or metadata don't count."""
    debug = gate(config, debug)
    limit = clamp(limit, 1, MAX_AUTHORS)
    candidates = ann_candidates(limit, AUTHOR_FACTOR, config, debug)
    if debug.exhaustive:
        posts = corpus.posts.select(F.col("id").alias("post_id"), "author_id")
        top = measured(corpus, corpus.vectors, similarity=rounded_distance("embedding", stored_form(query, config))).join(posts, "post_id")
        top = top.orderBy("similarity", "post_id", "chunk_number").limit(min(candidates, MAX_EXHAUSTIVE))
        data = corpus.post_data.select("post_id", "number_of_tokens")
        if config.min_token_search_threshold > 0:
            data = data.filter(F.col("number_of_tokens") >= config.min_token_search_threshold)
        return score_authors(hide_muted(top.join(data.select("post_id"), "post_id", "left_semi"), corpus.muted, observer), limit)
    return score_authors(nearest_chunks(corpus, query, config, candidates, observer, extra=["author_id"]), limit)


def named(authors: DataFrame, accounts: DataFrame) -> DataFrame:
    return authors.join(accounts.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id")
