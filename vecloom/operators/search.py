"""Vector retrieval: posts near a vector, a text or a post.

A search takes the nearest C chunks that pass the filters, keeps the best chunk of each post and ranks the
posts. The distance is worked out while the vectors are read, and from there on only post, chunk and distance move: no
vector is shuffled. Distances are doubles rounded to 6 decimals before anything is ordered; ties go to the smaller post and chunk; NaN
(zero or missing vectors) comes last. The candidate limit is a distributed top-k, so everything after it works on at most
50 000 rows and a window over one partition is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import MAX_EXHAUSTIVE, MAX_POSTS, POST_FACTOR, Config, Debug, ann_candidates, clamp, gate
from ..functions.names import name_of
from ..functions.vectors import as_double, cosine_distance_to, subvector
from .diff import current


@dataclass
class Corpus:
    """The tables a search reads. reduced and matrix serve the projected mode.

    versions: vectors (and reduced) come as delivered, with repeated rows, unusable vectors and rows of earlier versions
    of a post, told apart by sync_seq; searches then look at usable vectors of current rows, each once.
    """

    vectors: DataFrame
    posts: DataFrame
    post_data: DataFrame
    muted: DataFrame | None = None
    accounts: DataFrame | None = None
    permlinks: DataFrame | None = None
    reduced: DataFrame | None = None
    matrix: Sequence[Sequence[float]] | None = None
    versions: bool = False


def rounded_distance(vec: Column | str, query: Sequence[float]) -> Column:
    return F.round(cosine_distance_to(vec, query), 6)


def stored_form(query: Sequence[float], config: Config) -> list[float]:
    """The query in the precision in which vectors are stored."""
    return np.asarray(query, np.float16 if config.store_half else np.float64).astype(np.float64).tolist()


def root_post() -> Column:
    """A post that opens a thread."""
    return (F.col("root_id") == F.col("id")) | (F.col("root_id") == 0)


def hide_muted(rows: DataFrame, muted: DataFrame | None, observer: int, author: str = "author_id") -> DataFrame:
    """Rows of authors the observer hasn't muted; observer 0 sees all."""
    if not observer or muted is None:
        return rows
    mine = muted.filter(F.col("observer_id") == observer).select(F.col("muted_id").alias(author)).distinct()
    return rows.join(mine, author, "left_anti")


def measured(corpus: Corpus, table: DataFrame, **distances: Column) -> DataFrame:
    """(post_id, chunk_number, distances) of every vector of a table, without the vector."""
    if not corpus.versions:
        return table.select("post_id", "chunk_number", *[d.alias(n) for n, d in distances.items()])
    vec = "embedding" if "embedding" in table.columns else "reduced_embedding"
    good = F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + F.abs(F.coalesce(x, F.lit(float("nan")))))
    rows = table.filter((good > 0) & ~F.isnan(good) & (good < float("inf"))) if vec == "embedding" else table
    narrow = rows.select("post_id", "chunk_number", "sync_seq", *[d.alias(n) for n, d in distances.items()])
    now = current(narrow, ["post_id"], top=corpus.vectors)
    best = now.groupBy("post_id", "sync_seq", "chunk_number").agg(F.min(F.struct(*distances)).alias("_m"))
    return best.select("post_id", "chunk_number", *[F.col(f"_m.{n}").alias(n) for n in distances])


def eligible(corpus: Corpus, rows: DataFrame, config: Config, observer: int = 0, exclude: int | None = None) -> DataFrame:
    """Measured chunks of known posts with metadata that pass the token, post and mute filters."""
    data = corpus.post_data.select("post_id", "number_of_tokens")
    if config.min_token_search_threshold > 0:
        data = data.filter(F.col("number_of_tokens") >= config.min_token_search_threshold)
    if exclude is not None:
        rows = rows.filter(F.col("post_id") != exclude)
    posts = hide_muted(corpus.posts.select(F.col("id").alias("post_id"), "author_id"), corpus.muted, observer)
    return rows.join(posts, "post_id").join(data.select("post_id"), "post_id", "left_semi")


def best_chunks(rows: DataFrame) -> DataFrame:
    """The nearest chunk of each post."""
    w = W.partitionBy("post_id").orderBy("similarity", "chunk_number")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """Numbers the nearest ``limit`` posts. rows are bounded by the candidate limit."""
    top = rows.orderBy("similarity", "post_id").limit(limit)
    return top.select(F.row_number().over(W.orderBy("similarity", "post_id")).cast("int").alias("similarity_order"), "similarity", "post_id", "chunk_number")


def nearest_chunks(corpus: Corpus, query: Sequence[float], config: Config, candidates: int, observer: int = 0, exclude: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """(post_id, chunk_number, similarity, extra): the nearest candidates, reranked exactly in the reduced modes.

    slice: candidates by the first reduced_dims numbers; the whole vector is in the same row, so both distances come from one
    reading. pca: candidates by the stored projection, rerank by reading the vectors once more beside the candidates, whose number
    is the bound of what is broadcast. The candidates' own chunks are reranked, other chunks of their posts aren't looked at.
    """
    keys = ["post_id", "chunk_number", *extra]
    query = stored_form(query, config)
    near = lambda rows, d: eligible(corpus, rows, config, observer, exclude).orderBy(d, "post_id", "chunk_number").limit(candidates)
    if config.reduction_mode == "pca":
        if corpus.reduced is None or corpus.matrix is None:
            raise ValueError("the projected mode needs reduced vectors and the matrix")
        reduced_query = [float(np.dot(row, query)) for row in np.asarray(corpus.matrix, float)]
        found = near(measured(corpus, corpus.reduced, _d=rounded_distance("reduced_embedding", reduced_query)), "_d").select(*keys)
        ids = found.select("post_id", "chunk_number")
        some = corpus.vectors.join(F.broadcast(ids), ["post_id", "chunk_number"], "left_semi")
        whole = measured(replace(corpus, vectors=some), some, similarity=rounded_distance("embedding", query))
        return found.join(whole, ["post_id", "chunk_number"]).select(*keys, "similarity")
    if config.reduction_mode == "slice":
        k = config.reduced_dims
        rows = measured(corpus, corpus.vectors, _d=rounded_distance(subvector("embedding", 1, k), list(query)[:k]), similarity=rounded_distance("embedding", query))
        return near(rows, "_d").select(*keys, "similarity")
    return near(measured(corpus, corpus.vectors, similarity=rounded_distance("embedding", query)), "similarity").select(*keys, "similarity")


def nearest_posts(corpus: Corpus, query: Sequence[float], config: Config, limit: int = 1000, exclude: int | None = None, observer: int = 0, debug: Debug | None = None) -> DataFrame:
    """(similarity_order, similarity, post_id, chunk_number); similarity is a cosine distance, smaller is nearer.

    limit counts posts while candidates count chunks, so fewer than limit posts may come out.
    """
    debug = gate(config, debug)
    limit = clamp(limit, 1, MAX_POSTS)
    if debug.exhaustive:
        return exhaustive_posts(corpus, query, config, limit, exclude, observer)
    found = nearest_chunks(corpus, query, config, ann_candidates(limit, POST_FACTOR, config, debug), observer, exclude)
    return ranked(best_chunks(found), limit)


def exhaustive_posts(corpus: Corpus, query: Sequence[float], config: Config, limit: int, exclude: int | None = None, observer: int = 0) -> DataFrame:
    """The limit comes before the filters here, so filtered chunks aren't replaced by farther ones."""
    top = measured(corpus, corpus.vectors, similarity=rounded_distance("embedding", stored_form(query, config)))
    top = top.orderBy("similarity", "post_id", "chunk_number").limit(min(limit * 10, MAX_EXHAUSTIVE))
    return ranked(best_chunks(eligible(corpus, top, config, observer, exclude)), limit)


def page_of_posts(corpus: Corpus, query: Sequence[float], config: Config, limit: int = 10, exclude: int | None = None, observer: int = 0, after_post: int | None = None) -> DataFrame:
    """The next ``limit`` posts behind ``after_post`` in the ranking of all posts; ranks start at 1 again.

    Posts are reduced to their best chunk before the continuation is looked up; the start post itself never comes out,
    an unknown one gives an empty page. The token threshold applies after that. The position of the start post is one
    row, so a page is a range filter on (distance, post) and a top-k: no ranking of the whole corpus.
    """
    open_config, query = config.with_(min_token_search_threshold=0), stored_form(query, config)
    rows = eligible(corpus, measured(corpus, corpus.vectors, similarity=rounded_distance("embedding", query)), open_config, observer, exclude)
    best = rows.groupBy("post_id").agg(F.min(F.struct("similarity", "chunk_number")).alias("b")).select("post_id", "b.similarity", "b.chunk_number")
    if after_post is not None:
        start = best.filter(F.col("post_id") == after_post).select(F.col("similarity").alias("_s"), F.col("post_id").alias("_p"))
        best = best.join(F.broadcast(start), (F.col("similarity") > F.col("_s")) | ((F.col("similarity") == F.col("_s")) & (F.col("post_id") > F.col("_p")))).drop("_s", "_p")
    if config.min_token_search_threshold > 0:
        low = corpus.post_data.filter(F.col("number_of_tokens") < config.min_token_search_threshold).select("post_id")
        best = best.join(low, "post_id", "left_anti")
    return ranked(best, clamp(limit, 1, MAX_POSTS))


def posts_of(corpus: Corpus, names: Sequence[tuple[str, str]]) -> list[int | None]:
    """For each name the live post with the highest id, else a deleted one; none if there is no such post. One job for all.

    Accounts and permlinks are looked up first, so the posts are read with filters on their ids.
    """
    wanted = [(a.strip().lower().removeprefix("@"), p.strip().lower().removeprefix("@")) for a, p in names]
    if not wanted:
        return []
    spark = corpus.posts.sparkSession
    asked = F.broadcast(spark.createDataFrame(sorted(set(wanted)), "_author string, _permlink string"))  # a request's names
    some = lambda df, name, own: df.select(F.col("id").alias(f"{own}_id"), name_of(name).alias(f"_{own}")).join(asked.select(f"_{own}").distinct(), f"_{own}", "left_semi")
    rows = corpus.posts.join(some(corpus.accounts, "name", "author"), "author_id").join(some(corpus.permlinks, "permlink", "permlink"), "permlink_id").join(asked, ["_author", "_permlink"])
    best = rows.groupBy("_author", "_permlink").agg(F.max(F.struct((F.coalesce("counter_deleted", F.lit(1)) == 0).alias("live"), "id")).alias("b"))
    found = {(r._author, r._permlink): r.id for r in best.select("_author", "_permlink", "b.id").collect()}
    return [found.get(w) for w in wanted]


def post_id_of(corpus: Corpus, author: str, permlink: str) -> int | None:
    return posts_of(corpus, [(author, permlink)])[0]


def first_vector(corpus: Corpus, post_id: int) -> list[float]:
    """The vector of a post's lowest chunk."""
    mine = corpus.vectors.filter(F.col("post_id") == post_id)
    if corpus.versions:
        mine = current(mine, ["post_id"])
    rows = mine.filter(F.size("embedding") > 0).agg(F.min_by("embedding", "chunk_number").alias("v")).collect()
    if not rows or rows[0].v is None:
        raise LookupError(f"post {post_id} has no vector")
    return list(rows[0].v)


def nearest_to_post(corpus: Corpus, author: str, permlink: str, config: Config, limit: int = 1000, observer: int = 0) -> DataFrame:
    """Posts near an existing post, itself excluded."""
    post = post_id_of(corpus, author, permlink)
    if post is None:
        raise LookupError(f"no post {author}/{permlink}")
    return nearest_posts(corpus, first_vector(corpus, post), config, limit, post, observer)


def nearest_to_text(corpus: Corpus, text: str, embed: Callable[[Sequence[str]], np.ndarray], config: Config, limit: int = 1000, observer: int = 0) -> DataFrame:
    """Posts near a text; the query prefix goes before it."""
    return nearest_posts(corpus, embed([config.query_prefix + text])[0].tolist(), config, limit, None, observer)


def batch_knn(queries: DataFrame, corpus: DataFrame, k: int, query_key: Sequence[str], key: Sequence[str], vec: str = "embedding", exclude_self: bool = False, block: int = 2048, block_rows: int = 20_000) -> DataFrame:
    """(q_<query_key>, key, distance, rank): k nearest rows of the corpus for each query row, exactly.

    The queries are dealt into blocks and the corpus into chunks; each block meets each chunk in one matrix product, which
    keeps the k best of each query, and the chunks' lists are merged. Nothing is broadcast, and a task holds one
    block and one chunk. Zero and missing vectors have no neighbours and are none.
    """
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in query_key], as_double(vec).alias("_v")).filter("size(_v) > 0")
    c = corpus.select(*key, as_double(vec).alias("_v")).filter("size(_v) > 0")
    blocks = max(1, -(-q.count() // block))
    chunks = max(1, -(-c.count() // block_rows))
    qb = q.withColumn("_b", F.pmod(F.xxhash64(*[f"q_{x}" for x in query_key]), F.lit(blocks)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    cb = c.withColumn("_c", F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    qk, ck = [f"q_{x}" for x in query_key], list(key)
    fields = [f"{x} {q.schema[x].dataType.simpleString()}" for x in qk] + [f"{x} {c.schema[x].dataType.simpleString()}" for x in ck]

    def unit(t: pa.Table) -> np.ndarray:
        x = np.asarray(t.column("_v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        n = np.sqrt((x * x).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            return x / n[:, None]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], left.schema.field(n).type if n in qk else right.schema.field(n).type) for n in qk + ck} | {"distance": pa.array([], pa.float64())})
        d = np.round(1 - unit(left) @ unit(right).T, 6) + 0.0
        if exclude_self:
            same = np.ones(d.shape, bool)
            for x, y in zip(qk, ck):
                same &= np.asarray(left.column(x))[:, None] == np.asarray(right.column(y))[None, :]
            d[same] = np.nan
        order = np.lexsort([np.asarray(right.column(y)) for y in reversed(ck)])
        d = d[:, order]
        kk = min(k, d.shape[1])
        pick = np.argsort(d, axis=1, kind="stable")[:, :kk]
        i = np.repeat(np.arange(len(d)), kk)
        j = pick.ravel()
        dist = d[i, j]
        ok = ~np.isnan(dist)
        i, j, dist = i[ok], order[j[ok]], dist[ok]
        return pa.table({n: left.column(n).take(pa.array(i)) for n in qk} | {n: right.column(n).take(pa.array(j)) for n in ck} | {"distance": pa.array(dist)})

    pairs = qb.groupBy("_b", "_c").cogroup(cb.groupBy("_b", "_c")).applyInArrow(meet, ", ".join([*fields, "distance double"]))
    w = W.partitionBy(*qk).orderBy("distance", *ck)
    return pairs.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
