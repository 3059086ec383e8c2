"""Retrieval, paging, authors, kNN, reduction, recall, index."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.config import Config, Debug, ann_candidates
from vecloom.functions import vectors as vf
from vecloom.functions.embed import HashingEmbedder, Retrying, embed_texts, in_order, to_half
from vecloom.operators.authors import thematic_authors
from vecloom.operators.index import InvertedFile
from vecloom.operators.recall import recall_table, sample_queries
from vecloom.operators.reduce import explained, fit_pca, project_all, sequence_ranges
from vecloom.operators.search import Corpus, batch_knn, first_vector, nearest_posts, nearest_to_post, nearest_to_text, page_of_posts, post_id_of

DIMS = 8
CFG = Config(dims=DIMS, minimum_candidates=20)


def distance(a, b):
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(1 - sum(x * y for x, y in zip(a, b)) / n, 6) if n else math.nan


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(1)
    vec = {(p, c): [rnd.gauss(0, 1) for _ in range(DIMS)] for p in range(30) for c in range(rnd.randint(1, 3))}
    vec[(29, 0)] = [0.0] * DIMS
    vec[(5, 0)] = vec[(4, 0)]
    return {k: np.float32(v).tolist() for k, v in vec.items()}


@pytest.fixture(scope="module")
def corpus(spark, data):
    return Corpus(
        spark.createDataFrame([(p, c, v, 1) for (p, c), v in data.items()], "post_id int, chunk_number int, embedding array<float>, author_id int"),
        spark.createDataFrame([(p, p % 5, p, 0 if p != 3 else 1) for p in range(30)], "id int, author_id int, permlink_id int, counter_deleted int"),
        spark.createDataFrame([(p, p * 10) for p in range(29)], "post_id int, number_of_tokens int"),
        spark.createDataFrame([(7, 2), (7, 2), (8, 1)], "observer_id int, muted_id int"),
        spark.createDataFrame([(a, f"ann{a}") for a in range(5)], "id int, name string"),
        spark.createDataFrame([(p, f"p{p}") for p in range(30)], "id int, permlink string"),
    )


def brute(data, q, limit, candidates, tokens=0, exclude=None, mute=()):
    rows = sorted((distance(v, q), p, c) for (p, c), v in data.items() if p < 29 and p * 10 >= tokens and p != exclude and p % 5 not in mute)[:candidates]
    best = {}
    for d, p, c in rows:
        best.setdefault(p, (d, p, c))
    return sorted(best.values())[:limit]


def rows(df):
    return [(r.similarity, r.post_id, r.chunk_number) for r in sorted(df.collect(), key=lambda r: r.similarity_order)]


def test_full_mode_with_filters(corpus, data):
    q = data[(4, 0)]
    got = nearest_posts(corpus, q, CFG.with_(min_token_search_threshold=40), 6, 9, 7)
    assert rows(got) == brute(data, q, 6, 30, 40, 9, (2,))
    assert [r.similarity_order for r in got.orderBy("similarity_order").collect()] == list(range(1, 7))


def test_ties_and_limits(corpus, data):
    got = rows(nearest_posts(corpus, data[(4, 0)], CFG, 1000))
    assert got[0][1:] == (4, 0) and got[1][1:] == (5, 0) and len(got) <= 29


def test_zero_query_gives_nan_distances(corpus):
    assert all(math.isnan(d) for d, _, _ in rows(nearest_posts(corpus, [0.0] * DIMS, CFG, 3)))


def test_slice_and_pca_rerank_exactly(corpus, data):
    q = data[(4, 0)]
    cut = nearest_posts(corpus, q, CFG.with_(reduction_mode="slice", reduced_dims=4, minimum_candidates=1000), 10)
    assert rows(cut) == brute(data, q, 10, 1000)
    m = np.eye(4, DIMS)
    corpus.reduced, corpus.matrix = project_all(corpus.vectors.drop("author_id"), m).select("post_id", "chunk_number", "reduced_embedding"), m
    got = nearest_posts(corpus, q, CFG.with_(reduction_mode="pca", reduced_dims=4, minimum_candidates=1000), 10)
    assert rows(got) == brute(data, q, 10, 1000)
    few = rows(nearest_posts(corpus, q, CFG.with_(reduction_mode="pca", reduced_dims=4, minimum_candidates=5), 1, debug=None))
    assert few[0][1] == 4


def test_exhaustive_limits_before_it_filters(corpus, data):
    q = data[(4, 0)]
    dbg = CFG.with_(allow_debugging=True)
    got = rows(nearest_posts(corpus, q, dbg, 1, None, 7, Debug(exhaustive=True)))
    top = sorted((distance(v, q), p, c) for (p, c), v in data.items() if not math.isnan(distance(v, q)))[:10]
    want = [x for x in top if x[1] < 29 and x[1] % 5 != 2][:1]
    assert got == want
    with pytest.raises(PermissionError):
        nearest_posts(corpus, q, CFG, 1, debug=Debug(exhaustive=True))


def test_pages_continue_and_end(corpus, data):
    q = data[(6, 0)]
    first = rows(page_of_posts(corpus, q, CFG, 5))
    rest = rows(page_of_posts(corpus, q, CFG, 10, after_post=first[1][1]))
    assert rest[:3] == first[2:]
    assert len(rows(page_of_posts(corpus, q, CFG, 1000))) == 29
    assert rows(page_of_posts(corpus, q, CFG, 5, after_post=12345)) == []


def test_candidate_maths():
    c = Config(minimum_candidates=1000)
    assert [ann_candidates(n, 5, c) for n in (1, 1000, 20000)] == [1000, 5000, 50000]
    assert ann_candidates(1, 5, c.with_(allow_debugging=True), Debug(candidates=4000)) == 4000
    for bad in ({"reduction_mode": "odd"}, {"reduction_mode": "pca"}, {"overlap_amount": 1.0}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config(max_embeddings_per_post=0).max_embeddings_per_post is None


def test_names_first_vector_and_similar(corpus, data):
    assert post_id_of(corpus, " @ANN0", "p5") == 5 and post_id_of(corpus, "ann0", "p6") is None
    assert first_vector(corpus, 4) == data[(4, 0)]
    assert rows(nearest_to_post(corpus, "ann4", "p4", CFG, 3))[0][1:] == (5, 0)
    for bad in (("nobody", "p4"), ("ann4", "none")):
        with pytest.raises(LookupError):
            nearest_to_post(corpus, *bad, CFG, 3)
    with pytest.raises(LookupError):
        first_vector(corpus, 999)


def test_text_search_adds_the_prefix(corpus):
    seen = []

    def embed(texts):
        seen.extend(texts)
        return np.ones((len(texts), DIMS))

    nearest_to_text(corpus, "rain", embed, CFG, 3).count()
    assert seen == ["query: rain"]


def test_author_scores(corpus, data):
    q = data[(4, 0)]
    got = {r.author_id: (r.rank, r.similarity, r.score) for r in thematic_authors(corpus, q, CFG.with_(minimum_candidates=1000), 100).collect()}
    chunks = sorted((distance(v, q), p, c) for (p, c), v in data.items() if p < 29)
    score, best = {}, {}
    for i, (d, p, _) in enumerate(chunks, 1):
        score[p % 5] = score.get(p % 5, 0) + 1 / math.sqrt(i)
        best.setdefault(p % 5, d)
    order = sorted(score, key=lambda a: (-round(score[a], 6), a))
    assert got == {a: (i, best[a], round(score[a], 6)) for i, a in enumerate(order, 1)}


def test_batch_knn_against_brute_force(spark, corpus, data):
    key = ("post_id", "chunk_number")
    got = batch_knn(corpus.vectors.filter("post_id % 10 = 0"), corpus.vectors, 4, key, key, exclude_self=True, block=2, block_rows=15)
    mine = {}
    for r in got.collect():
        mine.setdefault((r.q_post_id, r.q_chunk_number), []).append((r.distance, r.post_id, r.chunk_number))
    for q in [k for k in data if k[0] % 10 == 0]:
        want = sorted((distance(v, data[q]), *k) for k, v in data.items() if k != q and k != (29, 0))[:4]
        assert sorted(mine[q]) == want
    empty = corpus.vectors.limit(0)
    assert batch_knn(empty, corpus.vectors, 3, key, key).count() == 0 and batch_knn(corpus.vectors, empty, 3, key, key).count() == 0


def test_recall_by_hand(spark):
    q = "q_post_id int, q_chunk_number int, post_id int, chunk_number int, rank int"
    exact = [(1, 0, p, 0, r) for r, p in enumerate([10, 11, 12, 13, 14], 1)] + [(2, 0, 20, 0, 1)]
    near = [(1, 0, p, 0, r) for r, p in enumerate([11, 10, 99, 98, 14], 1)]
    got = {(r.measure, r.k, r.c): r.recall for r in recall_table(spark.createDataFrame(exact, q), spark.createDataFrame(near, q), (1, 5), (5,)).collect()}
    assert got == {("top_k", 1, None): 0.0, ("top_k", 5, None): 0.3, ("within_c", 1, 5): 0.5, ("within_c", 5, 5): 0.3}


def test_samples_are_the_same_every_time(corpus):
    a = [tuple(r) for r in sample_queries(corpus.vectors, 5, 3).select("post_id", "chunk_number").collect()]
    assert a == [tuple(r) for r in sample_queries(corpus.vectors.repartition(7), 5, 3).select("post_id", "chunk_number").collect()]


def test_pca_and_ranges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, 0, v.tolist(), i + 5) for i, v in enumerate(x)], "post_id int, chunk_number int, embedding array<float>, sync_seq int")
    m, shares = fit_pca(df, 3)
    assert m.shape == (3, 6) and explained(shares)[1][2] > 0.999
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs((m[:2] * axes).sum(1)), 1, atol=1e-4)
    r = sequence_ranges(df, 3)
    assert r[0][0] == 5 and r[-1][1] == 204 and all(a[1] + 1 == b[0] for a, b in zip(r, r[1:]))
    assert sequence_ranges(df.limit(0), 3) == []


def test_projection_keeps_nulls_and_zeros(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "id int, embedding array<float>")
    got = {r.id: r.reduced_embedding for r in project_all(df, np.array([[3.0, 4.0]]), True).collect()}
    assert got == {1: [1.0], 2: None, 3: [0.0], 4: None}


def test_index_holds_every_row_and_probes_well(spark, path, corpus, data):
    index, stats = InvertedFile.build(corpus.vectors.drop("author_id"), path + "/ivf", 4)
    assert stats.rows == len(data)
    near = index.probe(data[(4, 0)], 1)
    assert (4, 0) in {(r.post_id, r.chunk_number) for r in near.collect()}
    assert index.probe(data[(4, 0)], 4).count() == len(data) - 1  # the zero vector is apart


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.d for r in df.select(vf.cosine_distance("a", "b").alias("d")).collect()]
    assert got[0] == 1.0 and all(math.isnan(x) for x in got[1:])
    texts = spark.createDataFrame([("[1, -2.5e-1,3]",), ("",), (None,), ("[]",), ("[1,x]",)], "s string")
    assert [r.v for r in texts.select(vf.from_text("s").alias("v")).collect()] == [[1.0, -0.25, 3.0], None, None, [], [1.0, None]]
    flags = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([1.0],), (None,), ([float("nan"), 1.0],)], "v array<double>")
    assert [r.u for r in flags.select(vf.usable(F.col("v"), 2).alias("u")).collect()] == [True, False, False, False, False]


def test_embedders(spark):
    e = HashingEmbedder(16)
    assert np.allclose(np.linalg.norm(e(["a b c"]), axis=1), 1) and not e([""]).any()
    got = embed_texts(spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, t string"), "t", e, 2).collect()
    assert got[0].embedding == got[2].embedding and got[1].embedding is None
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return np.ones((len(texts), 2))

    assert Retrying(flaky, wait=0)(["x"]).shape == (1, 2) and len(calls) == 3
    with pytest.raises(ValueError):
        Retrying(lambda t: np.ones((1, 2)))(["a", "b"])
    assert in_order([{"index": 1, "embedding": "b"}, {"index": 0, "embedding": "a"}]) == ["a", "b"]
    half = to_half(spark.createDataFrame([([0.1, 1.0],), (None,)], "v array<float>"), "v").collect()
    assert half[0].v == [float(np.float16(0.1)), 1.0] and half[1].v is None


def test_half_precision_queries_meet_half_precision_vectors(spark):
    """A node that stores halves finds a stored vector at distance 0."""
    from vecloom.functions.embed import to_half

    rows = spark.createDataFrame([(1, 0, [0.1234567, 0.7654321]), (2, 0, [0.9, 0.1])], "post_id int, chunk_number int, embedding array<float>")
    posts = spark.createDataFrame([(1, 1), (2, 1)], "id int, author_id int")
    data = spark.createDataFrame([(1, 5), (2, 5)], "post_id int, number_of_tokens int")
    c = Corpus(to_half(rows, "embedding"), posts, data)
    got = nearest_posts(c, [0.1234567, 0.7654321], Config(dims=2, store_half=True), 2).collect()
    assert [r.post_id for r in got] == [1, 2] and got[0].similarity == 0


def test_no_search_shuffles_a_vector(spark, tmp_path):
    """The plans of every mode and of the page: no exchange carries an embedding."""
    import re as _re

    from vecloom.operators.authors import thematic_authors
    from vecloom.operators.search import page_of_posts

    rows = [(i, c, [float(i), 1.0, float(c), 2.0], i) for i in range(1, 30) for c in range(2)]
    spark.createDataFrame(rows, "post_id int, chunk_number int, embedding array<float>, sync_seq int").write.parquet(f"{tmp_path}/v")
    spark.createDataFrame([(i, 0, [1.0, float(i)], i) for i in range(1, 30)], "post_id int, chunk_number int, reduced_embedding array<float>, sync_seq int").write.parquet(f"{tmp_path}/r")
    posts = spark.createDataFrame([(i, i % 3) for i in range(1, 30)], "id int, author_id int")
    data = spark.createDataFrame([(i, 5) for i in range(1, 30)], "post_id int, number_of_tokens int")
    muted = spark.createDataFrame([(1, 2)], "observer_id int, muted_id int")
    for versions in (False, True):
        c = Corpus(spark.read.parquet(f"{tmp_path}/v"), posts, data, muted, reduced=spark.read.parquet(f"{tmp_path}/r"), matrix=[[1, 0, 0, 0], [0, 1, 0, 0]], versions=versions)
        q = [1.0, 2.0, 3.0, 4.0]
        small = Config(dims=4, minimum_candidates=5)
        found = [
            nearest_posts(c, q, small, 5, 1, 1), nearest_posts(c, q, small.with_(reduction_mode="slice", reduced_dims=2), 5, None, 1), nearest_posts(c, q, small.with_(reduction_mode="pca", reduced_dims=2), 5, None, 1),
            page_of_posts(c, q, small, 5, None, 1, 7), thematic_authors(c, q, small, 3, 1),
        ]
        for df in found:
            assert df.count() > 0
            plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            for part in plan.split("\n\n"):
                if _re.match(r"\(\d+\) (Broadcast)?Exchange", part):
                    assert "embedding" not in part, part


def test_an_index_is_built_once_within_its_memory(spark, path):
    from vecloom.operators.index import InvertedFile

    rng = np.random.default_rng(3)
    rows = [(i, 0, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "post_id int, chunk_number int, embedding array<float>")
    cfg = Config(dims=4)
    index, stats = InvertedFile.ensure(df, path, cfg, memory=100 * 8 * 4)  # 100 vectors: two cells
    assert stats.rows == 200 and stats.cells == 2 and stats.size > 0 and stats.rows_per_second > 0
    again, built = InvertedFile.ensure(df.limit(0), path, cfg)
    assert built is None and np.allclose(again.centroids, index.centroids) and again.probe(rows[0][2], 2).count() == 200
    short, stats = InvertedFile.ensure(df, path, cfg.with_(reduction_mode="slice", reduced_dims=2), cells=3)
    assert stats.cells == 3 and short.path != index.path and short.centroids.shape == (3, 2)
