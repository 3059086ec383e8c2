"""Queries of retrieval, author ranking, reduction and recall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..config import Debug
from ..functions.embed import HashingEmbedder, embed_texts, with_prefix
from ..operators.authors import thematic_authors
from ..operators.index import InvertedFile
from ..operators.recall import recall_table, sample_queries
from ..operators.reduce import fit_pca, matrix_rows, project_all
from ..operators.search import Corpus, batch_knn, first_vector, nearest_posts, nearest_to_post, nearest_to_text, page_of_posts
from ..session import settle, workspace
from ..functions.vectors import usable
from .base import COMPONENTS, DIMS, SLICE, SQL, config, corpus, first_query, first_vectors, vectors
from .registry import Registry, Tables

QUERIES = Registry()


def _matrix(t: Tables) -> np.ndarray:
    """The first vectors serve as the rows of a fixed projection."""
    return np.array(first_vectors(t, COMPONENTS))


def _reduced(t: Tables) -> Corpus:
    """With the projection of every usable vector, worked out while the table is read."""
    c = corpus(t)
    c.matrix = _matrix(t)
    good = t.posts_vectors.filter(usable(F.col("embedding").cast("array<double>"), DIMS))
    c.reduced = project_all(good, c.matrix).select("post_id", "chunk_number", "reduced_embedding", "sync_seq")
    return c


_ELIGIBLE = """
el as (
  select pv.*, hp.author_id from pv join hive_posts hp on hp.id = pv.post_id join pd on pd.post_id = pv.post_id
  where {tokens} and {exclude} and not exists (select 1 from mute where observer_id = {observer} and muted_id = hp.author_id))"""
_FINISH = """
best as (select *, row_number() over (partition by post_id order by similarity, chunk_number) n from cand)
select row_number() over (order by similarity, post_id)::int as similarity_order, similarity, post_id, chunk_number
from best where n = 1 order by similarity, post_id limit {limit}"""


def _sql(candidates: str, limit: int = 20, tokens: str = "true", exclude: str = "true", observer: int = 0) -> str:
    return "with " + SQL + "," + _ELIGIBLE.format(tokens=tokens, exclude=exclude, observer=observer) + "," + candidates + "," + _FINISH.format(limit=limit)


_FULL = "cand as (select post_id, chunk_number, author_id, round(list_cosine_distance(e, (select e from q)), 6) similarity from el order by 4, 1, 2 limit {n})"
_SLICE = f"""
near as (select *, round(list_cosine_distance(e[1:{SLICE}], (select e[1:{SLICE}] from q)), 6) d from el order by d, post_id, chunk_number limit {{n}}),
cand as (select post_id, chunk_number, author_id, round(list_cosine_distance(e, (select e from q)), 6) similarity from near)"""
_PCA = f"""
mat as (select list(e order by post_id, chunk_number) m from (select * from pv order by post_id, chunk_number limit {COMPONENTS})),
qr as (select list_transform(m, lambda r: list_inner_product(r, e)) v from mat, q),
red as (select el.*, list_transform(list_transform(m, lambda r: list_inner_product(r, e)), lambda x: x::float::double) r from el, mat),
near as (select *, round(list_cosine_distance(r, (select v from qr)), 6) d from red order by d, post_id, chunk_number limit {{n}}),
cand as (select post_id, chunk_number, author_id, round(list_cosine_distance(e, (select e from q)), 6) similarity from near)"""


@QUERIES.query("rt01_full_mode", _sql(_FULL.format(n=1000), 20, "pd.number_of_tokens >= 100", "pv.post_id <> (select post_id from q)", 2))
def rt01(t: Tables) -> DataFrame:
    c = corpus(t)
    post, vec = first_query(t)
    return nearest_posts(c, vec, config(min_token_search_threshold=100), 20, post, 2)


@QUERIES.query("rt02_pca_mode", _sql(_PCA.format(n=100), 20, observer=1))
def rt02(t: Tables) -> DataFrame:
    c = _reduced(t)
    return nearest_posts(c, first_query(t)[1], config(reduction_mode="pca", reduced_dims=COMPONENTS, minimum_candidates=100), 20, None, 1)


@QUERIES.query("rt03_slice_mode", _sql(_SLICE.format(n=100), 20, observer=1))
def rt03(t: Tables) -> DataFrame:
    c = corpus(t)
    return nearest_posts(c, first_query(t)[1], config(reduction_mode="slice", reduced_dims=SLICE, minimum_candidates=100), 20, None, 1)


_EXHAUSTIVE = """
with {base}, top as (select post_id, chunk_number, round(list_cosine_distance(e, (select e from q)), 6) similarity from pv order by 3, 1, 2 limit 200),
cand as (
  select top.* from top join hive_posts hp on hp.id = top.post_id join pd on pd.post_id = top.post_id
  where top.post_id <> (select post_id from q) and not exists (select 1 from mute where observer_id = 3 and muted_id = hp.author_id)),"""


@QUERIES.query("rt04_exhaustive_mode", _EXHAUSTIVE.format(base=SQL) + _FINISH.format(limit=20))
def rt04(t: Tables) -> DataFrame:
    c = corpus(t)
    post, vec = first_query(t)
    return nearest_posts(c, vec, config(allow_debugging=True), 20, post, 3, Debug(exhaustive=True))


_PAGED = """
with {base}, el as (
  select pv.* from pv join hive_posts hp on hp.id = pv.post_id where exists (select 1 from pd where pd.post_id = pv.post_id) and not exists (select 1 from mute where observer_id = 1 and muted_id = hp.author_id)),
d as (select post_id, chunk_number, round(list_cosine_distance(e, (select e from q)), 6) similarity from el),
b as (select *, row_number() over (partition by post_id order by similarity, chunk_number) n from d),
r as (select *, row_number() over (order by similarity, post_id) rn from b where n = 1)
select row_number() over (order by rn)::int as similarity_order, similarity, post_id, chunk_number from r where rn > 5 order by rn limit 10"""


@QUERIES.query("rt05_next_page", _PAGED.format(base=SQL))
def rt05(t: Tables) -> DataFrame:
    c = corpus(t)
    vec = first_query(t)[1]
    start = page_of_posts(c, vec, config(), 5, None, 1).orderBy(F.desc("similarity_order")).first()
    return page_of_posts(c, vec, config(), 10, None, 1, start.post_id)


@QUERIES.query("rt06_text_search")
def rt06(t: Tables) -> DataFrame:
    embed = HashingEmbedder(256)
    docs = t.documents.select(F.col("doc_id").cast("int").alias("post_id"), F.lit(0).alias("chunk_number"), with_prefix("passage: ", "text").alias("text")).filter("text is not null")
    posts = t.documents.select(F.col("doc_id").cast("int").alias("id"), F.lit(1).alias("author_id"))
    data = t.documents.select(F.col("doc_id").cast("int").alias("post_id"), F.col("n_chars").cast("int").alias("number_of_tokens"))
    c = Corpus(embed_texts(docs, "text", embed).select("post_id", "chunk_number", "embedding"), posts, data)
    return nearest_to_text(c, "the night gardener waits for the last tram", embed, config(dims=256), 20)


@QUERIES.query("rt07_similar_to_post", _sql(_FULL.format(n=1000), 20, exclude="pv.post_id <> (select post_id from q)", observer=2))
def rt07(t: Tables) -> DataFrame:
    c = corpus(t)
    post = first_query(t)[0]
    return nearest_posts(c, first_vector(c, post), config(), 20, post, 2)


@QUERIES.query("rt07_similar_by_name")
def rt07_name(t: Tables) -> DataFrame:
    c = corpus(t)
    live = vectors(t).join(t.hive_posts.filter("counter_deleted = 0").select(F.col("id").alias("post_id"), "author_id", "permlink_id"), "post_id").orderBy("post_id").limit(1)
    who = live.join(t.hive_accounts.select(F.col("id").alias("author_id"), "name"), "author_id").join(t.hive_permlink_data.select(F.col("id").alias("permlink_id"), "permlink"), "permlink_id").first()
    return nearest_to_post(c, who.name, who.permlink, config(), 20)


_AUTHORS = """,
rk as (select *, row_number() over (order by similarity, post_id, chunk_number) rn from cand),
sc as (select author_id, min(similarity) similarity, round(sum(1 / sqrt(rn)), 6) score from rk group by 1)
select row_number() over (order by score desc, author_id)::int as rank, author_id, similarity, score from sc order by score desc, author_id limit 10"""


def _authors_sql(cand: str, observer: int) -> str:
    return "with " + SQL + "," + _ELIGIBLE.format(tokens="true", exclude="true", observer=observer) + "," + cand + _AUTHORS


@QUERIES.query("rt08_authors_full", _authors_sql(_FULL.format(n=1000), 2))
def rt08(t: Tables) -> DataFrame:
    c = corpus(t)
    return thematic_authors(c, first_query(t)[1], config(), 10, 2)


@QUERIES.query("rt08_authors_slice", _authors_sql(_SLICE.format(n=200), 0))
def rt08_slice(t: Tables) -> DataFrame:
    c = corpus(t)
    return thematic_authors(c, first_query(t)[1], config(reduction_mode="slice", reduced_dims=SLICE, minimum_candidates=200), 10)


@QUERIES.query("rt08_authors_pca", _authors_sql(_PCA.format(n=200), 1))
def rt08_pca(t: Tables) -> DataFrame:
    c = _reduced(t)
    return thematic_authors(c, first_query(t)[1], config(reduction_mode="pca", reduced_dims=COMPONENTS, minimum_candidates=200), 10, 1)


@QUERIES.query(
    "rt08_authors_exhaustive",
    "with " + SQL + """, el as (select pv.*, hp.author_id from pv join hive_posts hp on hp.id = pv.post_id),
top as (select post_id, chunk_number, author_id, round(list_cosine_distance(e, (select e from q)), 6) similarity from el order by 4, 1, 2 limit 300),
cand as (select top.* from top where exists (select 1 from pd where pd.post_id = top.post_id) and not exists (select 1 from mute where observer_id = 2 and muted_id = author_id))""" + _AUTHORS,
)
def rt08_exhaustive(t: Tables) -> DataFrame:
    c = corpus(t)
    return thematic_authors(c, first_query(t)[1], config(allow_debugging=True, minimum_candidates=1), 10, 2, Debug(candidates=300, exhaustive=True))


_KNN = """
with {base}, s as (select a.post_id qp, a.chunk_number qc, b.post_id, b.chunk_number, round(list_cosine_distance(a.e, b.e), 6) distance
  from pv a, pv b where a.post_id % 50 = 0 and not (a.post_id = b.post_id and a.chunk_number = b.chunk_number)),
r as (select *, row_number() over (partition by qp, qc order by distance, post_id, chunk_number) rank from s)
select qp as q_post_id, qc as q_chunk_number, post_id, chunk_number, distance, rank::int as rank from r where rank <= 10"""


@QUERIES.query("jn17_batch_knn", _KNN.format(base=SQL))
def jn17(t: Tables) -> DataFrame:
    v = settle(vectors(t).select("post_id", "chunk_number", "embedding"), "knn")
    key = ("post_id", "chunk_number")
    return batch_knn(v.filter("post_id % 50 = 0"), v, 10, key, key, exclude_self=True)


_RECALL = """
with {base}, a as (select * from pv where post_id % 50 = 0),
ex as (select *, row_number() over (partition by qp, qc order by d, post_id, chunk_number) rank from (
  select a.post_id qp, a.chunk_number qc, b.post_id, b.chunk_number, round(list_cosine_distance(a.e, b.e), 6) d from a, pv b where not (a.post_id = b.post_id and a.chunk_number = b.chunk_number))),
ap as (select *, row_number() over (partition by qp, qc order by d, post_id, chunk_number) rank from (
  select a.post_id qp, a.chunk_number qc, b.post_id, b.chunk_number, round(list_cosine_distance(a.e[1:16], b.e[1:16]), 6) d from a, pv b where not (a.post_id = b.post_id and a.chunk_number = b.chunk_number))),
k as (select unnest([1, 5, 10, 20]) k), c as (select unnest([null, 100]) c),
g as (select k, c from k, c), n as (select count(*) n from (select distinct qp, qc from ex where rank <= 20))
select case when c is null then 'top_k' else 'within_c' end as measure, k, c, round((select count(*) from ex join ap using (qp, qc, post_id, chunk_number) where ex.rank <= k and ap.rank <= coalesce(c, k)) / (k * (select n from n)), 6) as recall from g"""


@QUERIES.query("ev05_recall", _RECALL.format(base=SQL))
def ev05(t: Tables) -> DataFrame:
    v = settle(vectors(t).select("post_id", "chunk_number", "embedding"), "recall")
    short = v.select("post_id", "chunk_number", F.slice("embedding", 1, 16).alias("embedding"))
    key = ("post_id", "chunk_number")
    exact = batch_knn(v.filter("post_id % 50 = 0"), v, 20, key, key, exclude_self=True)
    near = batch_knn(short.filter("post_id % 50 = 0"), short, 100, key, key, exclude_self=True)
    return recall_table(exact, near, cs=(100,))


@QUERIES.query("ev03_sample_queries")
def ev03(t: Tables) -> DataFrame:
    return sample_queries(vectors(t), 100, 42).select("post_id", "chunk_number")


@QUERIES.query("ev01_pca_fit")
def ev01(t: Tables) -> DataFrame:
    matrix, shares = fit_pca(vectors(t), COMPONENTS)
    rows = [(i, v, float(s)) for (i, v), s in zip(matrix_rows(matrix), shares)]
    return t.spark.createDataFrame(rows, "row_idx int, row_vec array<double>, share double")


@QUERIES.query(
    "ev02_project_all",
    "with " + SQL + f""", mat as (select list(e order by post_id, chunk_number) m from (select * from pv order by post_id, chunk_number limit {COMPONENTS})),
p as (select post_id, chunk_number, list_transform(m, lambda r: list_inner_product(r, e)) y from pv, mat)
select post_id, chunk_number, len(y)::int as components, round(y[1] / sqrt(list_inner_product(y, y)), 4) as first, round(y[{COMPONENTS}] / sqrt(list_inner_product(y, y)), 4) as last from p""",
)
def ev02(t: Tables) -> DataFrame:
    y = project_all(vectors(t), _matrix(t), normalise=True)
    at = lambda i: F.round(F.element_at("reduced_embedding", i).cast("double"), 4)
    return y.select("post_id", "chunk_number", F.size("reduced_embedding").alias("components"), at(1).alias("first"), at(-1).alias("last"))


PROBES = 10  # of 16 cells; recall@20 against brute force is in the README


@QUERIES.query("rt11_index_probe")
def rt11(t: Tables) -> DataFrame:
    c = corpus(t)
    post, vec = first_query(t)
    index, _ = InvertedFile.build(vectors(t), workspace(t.spark, "ivf"), 16)
    c.vectors, c.versions = index.probe(vec, PROBES).drop("cell"), False
    return nearest_posts(c, vec, config(), 20, post)


@QUERIES.query("rt11_index_stats")
def rt11_stats(t: Tables) -> DataFrame:
    _, s = InvertedFile.build(vectors(t), workspace(t.spark, "ivf"), 16)
    return t.spark.createDataFrame([(s.rows, s.cells, s.largest, s.fit_seconds, s.write_seconds)], "rows long, cells long, largest long, fit_seconds double, write_seconds double")
