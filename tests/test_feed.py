"""Feed, store, replication, rebase, streams, API."""

import json
import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.api import Api, fresh
from vecloom.config import Config
from vecloom.functions.embed import HashingEmbedder
from vecloom.operators import feed, rebase, store
from vecloom.operators.search import Corpus
from vecloom.sources.feed import FeedSource
from vecloom.sources.files import StatusLine, find_matrix, load_matrix, read_csv, save_matrix, write_csv
from vecloom.streaming.ingest import Ingest
from vecloom.streaming.replicate import NotReady, Replica

CFG = Config(dims=4, tokens_per_chunk=24, min_token_threshold=4, document_prefix="")
LOCAL = {"llm": "m", "embedding_dimensionality": 4, "document_prefix": "p", "query_prefix": "q", "tokens_per_chunk": 512, "overlap_amount": 0.15, "min_token_threshold": 75, "max_embeddings_per_post": None}


# -- chains ----------------------------------------------------------------------------------------------------
def chain(uuid, **changes):
    return {"sync_uuid": uuid, **LOCAL, **changes}


def test_select_chain():
    assert feed.select_chain([chain("a", llm="x"), chain("b"), chain("c")], LOCAL)["sync_uuid"] == "b"
    assert feed.select_chain([chain("a", overlap_amount=0.15 + 5e-7)], LOCAL)["sync_uuid"] == "a"
    assert feed.select_chain([chain("a"), chain("b")], LOCAL, "b")["sync_uuid"] == "b"
    for chains, known, error in (([], None, LookupError), ([chain("a", llm="x")], None, LookupError), ([chain("a")], "z", LookupError), ([chain("a", tokens_per_chunk=1)], "a", ValueError)):
        with pytest.raises(error):
            feed.select_chain(chains, LOCAL, known)
    assert feed.config_mismatches(LOCAL, chain("a", llm="x", min_token_threshold=1, overlap_amount=0.2)) == ["llm", "overlap_amount", "min_token_threshold"]


# -- store and feed --------------------------------------------------------------------------------------------
def posts(spark, rows):
    return spark.createDataFrame(rows, "post_id int, title string, body string, block_num int")


LONG = "The old baker paints the wall. The night gardener waits for rain. "


def test_history_of_three_posts_and_convergence(spark, path):
    s = store.Store(spark, path + "/s")
    e = HashingEmbedder(4)
    s.ingest(posts(spark, [(1, "t", LONG * 3, 10), (2, "t", LONG, 11), (3, None, "short", 12)]), CFG, e, 12)
    t = s.tables()
    assert {r.post_id for r in t.vectors.collect()} == {1, 2} and [(r.post_id, r.sync_seq) for r in t.markers.collect()] == [(3, 1)]
    assert s.status().max_visible_sync_seq == 3 and s.status().last_block == 12
    s.ingest(posts(spark, [(1, "t", LONG, 20), (2, "t", "gone", 21)]), CFG, e, 21)
    t = s.tables()
    names = spark.createDataFrame([(i, "ann", f"p{i}") for i in (1, 2, 3)], "post_id int, author string, permlink string")
    cfg = CFG.with_(sync_uuid="u", max_visible_sync_seq=s.status().max_visible_sync_seq)
    page = feed.embedding_updates(t.vectors, t.markers, t.post_data, names, cfg, 0, 100, "u").collect()
    assert [(r.sync_seq, r.op, r.permlink, len(r.embeddings) > 0) for r in page] == [(1, "delete", "p3", False), (4, "delete", "p2", False), (5, "update", "p1", True)]
    with pytest.raises(ValueError):
        feed.embedding_updates(t.vectors, t.markers, t.post_data, names, cfg, 0, 100, "other")
    one = feed.embedding_updates(t.vectors, t.markers, t.post_data, names, cfg, 1, 1, "u").collect()
    assert [r.sync_seq for r in one] == [4]
    # a replica that applies the feed ends with the same vectors, whatever the page size
    r = store.Store(spark, path + "/r")
    rep = Replica(r, lambda: names.union(spark.createDataFrame([(9, "x", "y")], names.schema)))
    seq, batch = 0, 0
    while ops := feed.embedding_updates(t.vectors, t.markers, t.post_data, names, cfg, seq, 2, "u").collect():
        rep.batch(spark.createDataFrame(ops, "sync_seq int, op string, author string, permlink string, number_of_tokens int, last_vectors_block int, embeddings array<array<float>>"), batch)
        seq, batch = ops[-1].sync_seq, batch + 1
    key = lambda df: sorted((x.post_id, x.chunk_number, tuple(x.embedding), x.sync_seq) for x in df.collect())
    assert key(r.tables().vectors) == key(t.vectors) and rep.state.last_seq == 5
    rep.batch(spark.createDataFrame(page, "sync_seq int, op string, author string, permlink string, number_of_tokens int, last_vectors_block int, embeddings array<array<float>>"), 99)
    assert key(r.tables().vectors) == key(t.vectors)


OPS = "sync_seq int, op string, author string, permlink string, number_of_tokens int, last_vectors_block int, embeddings array<array<float>>"


def test_missing_posts_and_admission(spark, path):
    names = spark.createDataFrame([(1, "ann", "p1")], "post_id int, author string, permlink string")
    ops = spark.createDataFrame([(7, "insert", "ann", "p1", 9, 100, [[1.0]]), (8, "insert", "bob", "x", 9, 900, [[1.0]]), (9, "delete", "ann", "p1", 9, 9999, [])], OPS)
    with pytest.raises(LookupError):
        Replica(store.Store(spark, path + "/a"), lambda: names, "exit").batch(ops, 0)
    with pytest.raises(NotReady):
        Replica(store.Store(spark, path + "/b"), lambda: names, head=lambda: 500).batch(ops, 0)
    r = Replica(store.Store(spark, path + "/c"), lambda: names, head=lambda: 900, aside=path + "/lost")
    r.batch(ops, 0)
    assert (r.state.last_seq, r.state.skipped_ops, r.state.inserts, r.state.deletes, r.state.last_block) == (9, 1, 1, 1, 9999)
    assert spark.read.parquet(path + "/lost").count() == 1 and r.store.tables().vectors.count() == 0
    assert feed.upstream_gap(feed.FeedState(upstream_skipped=3), 5) == 2 and feed.upstream_gap(feed.FeedState(upstream_skipped=3), 1) == 0


def test_a_restarted_replica_counts_on_and_nothing_twice(spark, path):
    names = spark.createDataFrame([(1, "ann", "p1")], "post_id int, author string, permlink string")
    pages = [[(1, "insert", "bob", "x", 9, 10, [[1.0]]), (2, "insert", "ann", "p1", 9, 11, [[1.0]])], [(3, "insert", "bob", "y", 9, 12, [[1.0]]), (4, "update", "ann", "p1", 9, 13, [[2.0]])]]
    replica = lambda: Replica(store.Store(spark, path + "/s"), lambda: names)
    for i, page in enumerate([*pages, pages[0], pages[1]]):  # the last two are delivered again
        replica().batch(spark.createDataFrame(page, OPS), i)
    r = replica()
    assert (r.state.last_seq, r.state.skipped_ops, r.state.inserts, r.store.status().skipped_op_count) == (4, 2, 2, 2)
    assert [(x.sync_seq, list(x.embedding)) for x in r.store.tables().vectors.collect()] == [(4, [2.0])]


def test_a_write_costs_its_own_size_and_runs_are_merged(spark, path):
    """Against the same changes applied to whole tables; the large first run is rewritten only when the others have grown."""
    s, rnd = store.Store(spark, path, max_runs=3), np.random.default_rng(5)
    ids = lambda xs: spark.createDataFrame([(int(x),) for x in xs], "post_id int")
    want, seq = {}, 0
    for step in range(9):
        touched = range(400) if step == 0 else sorted(set(rnd.integers(0, 420, 6).tolist()))
        rows, marks = [], []
        for p in touched:
            seq += 1
            want[p] = []
            if step and rnd.random() < 0.3:
                marks.append((p, seq))
            else:
                want[p] = [(p, c, [float(x) for x in rnd.integers(0, 9, 16)], seq) for c in range(3)]
                rows += want[p]
        data = spark.createDataFrame([(p, step, seq) for p in touched], "post_id int, number_of_tokens int, last_vectors_block int")
        before = s.files.size("vectors")
        s.append(store.Change(ids(touched), data, spark.createDataFrame(rows, "post_id int, chunk_number int, embedding array<float>, sync_seq int"), spark.createDataFrame(marks, "post_id int, sync_seq int")))
        runs = s.status().runs
        assert len(runs) <= 3 and s.status().max_visible_sync_seq == seq
        if 0 < step <= 2:
            assert s.files.size("vectors") - before < runs[0][1] / 4
        t = s.tables()
        assert sorted(tuple(r) for r in t.vectors.collect()) == sorted(r for rs in want.values() for r in rs)
        assert {r.post_id for r in t.post_data.collect()} == set(want) and t.post_data.count() == len(want)
    assert runs[0][0] == 1
    s.max_runs = 0
    while len(s.status().runs) > 1:
        s.max_runs = 1
        s.tidy()
    assert s.tables().vectors.count() == sum(map(len, want.values()))


def test_tasks_and_sequences_are_dense(spark):
    rows = spark.createDataFrame([(i, i // 7) for i in range(250)], "post_id int, block int")
    got = {r.task: r for r in store.tasks(rows, 100).collect()}
    assert [len(got[i].post_ids) for i in range(3)] == [100, 100, 50] and got[1].post_ids == list(range(100, 200)) and got[1].first_block == 14
    pre = rows.select("post_id", F.col("block").alias("block_num"), F.lit(5).alias("token_count"))
    some = rows.filter("post_id % 2 = 0").select("post_id")
    seqs = [r.sync_seq for r in store.assign_seqs(pre, some, 100).orderBy("had", "post_id").collect()]
    assert seqs == list(range(101, 351))


def test_stop_rules_and_ranges():
    s = store.Status()
    assert store.must_stop(s, 5, None) is None and store.must_stop(s, 5, 5) and store.must_stop(store.Status(continue_processing=False), 1, None)
    assert store.must_stop(s, 1, None, "live", "massive") and store.stage(1, 1000) == "massive" and store.stage(950, 1000) == "live"
    assert store.block_ranges(1, 2500) == [(1, 1000), (1001, 2000), (2001, 2500)]


def test_identity_is_kept(spark, path):
    s = store.Store(spark, path)
    assert s.identity("a") == "a" and s.identity("b") == "a" and s.update(continue_processing=False).continue_processing is False


# -- streams ---------------------------------------------------------------------------------------------------
def test_streams(spark, path):
    folder = path.removeprefix("file://") + "/in"
    os.makedirs(folder)
    for i in (1, 2):
        with open(f"{folder}/{i}.json", "w") as f:
            f.write(json.dumps({"post_id": i, "title": "t", "body": LONG, "block_num": i}) + "\n")
    s = store.Store(spark, path + "/store")
    stream = spark.readStream.schema("post_id int, title string, body string, block_num int").option("maxFilesPerTrigger", 1).json(folder)
    Ingest(s, CFG, HashingEmbedder(4)).writer(stream, path + "/ck").start().awaitTermination(120)
    t = s.tables()
    assert {r.post_id for r in t.vectors.collect()} == {1, 2} and s.status().last_block == 2
    names = spark.createDataFrame([(1, "ann", "p1"), (2, "ann", "p2")], "post_id int, author string, permlink string")
    page = feed.embedding_updates(t.vectors, t.markers, t.post_data, names, CFG.with_(sync_uuid="u", max_visible_sync_seq=99), 0, 10, "u")
    pages = path.removeprefix("file://") + "/pages"
    os.makedirs(pages)
    with open(f"{pages}/0.json", "w") as f:
        json.dump([r.asDict(True) for r in page.collect()], f)
    spark.dataSource.register(FeedSource)
    r = Replica(store.Store(spark, path + "/replica"), lambda: names)
    q = r.writer(spark.readStream.format("vecloom_feed").option("folder", pages).option("page_size", "1").load(), path + "/ck2").start()
    try:
        for _ in range(60):
            if r.state.last_seq >= 2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert {x.post_id for x in r.store.tables().vectors.collect()} == {1, 2}


@pytest.mark.parametrize("asked", [False, True])
def test_a_stopped_stream_resumes_without_losing_posts(spark, path, asked):
    folder = path.removeprefix("file://") + "/in"
    os.makedirs(folder)
    for i in (1, 2, 3):
        with open(f"{folder}/{i}.json", "w") as f:
            f.write(json.dumps({"post_id": i, "title": "t", "body": LONG, "block_num": i}) + "\n")
        os.utime(f"{folder}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    s = store.Store(spark, path + "/store")
    if asked:
        s.update(continue_processing=False)

    def run(stop_at):
        stream = spark.readStream.schema("post_id int, title string, body string, block_num int").option("maxFilesPerTrigger", 1).json(folder)
        Ingest(s, CFG, HashingEmbedder(4), stop_at).writer(stream, path + "/ck").start().awaitTermination(120)

    with pytest.raises(Exception, match="stop requested" if asked else "block limit reached"):
        run(1)
    assert s.status().last_block == (0 if asked else 1)
    s.update(continue_processing=True)
    run(None)
    assert {r.post_id for r in s.tables().vectors.collect()} == {1, 2, 3} and s.status().last_block == 3


# -- rebase ----------------------------------------------------------------------------------------------------
def test_rebase(spark, path):
    hp = spark.createDataFrame([(i, i, 1, i, 5, 5, 0) for i in range(1, 7)], "id int, root_id int, author_id int, permlink_id int, block_num int, block_num_created int, counter_deleted int")
    acc, links = spark.createDataFrame([(1, "ann")], "id int, name string"), spark.createDataFrame([(i, f"p{i}") for i in range(1, 7)], "id int, permlink string")
    text = lambda *v: str(list(map(float, v)))
    old = [("ann", "p1", 0, text(1, 0), 1), ("ann", "p2", 0, text(1, 0), 2), ("ann", "p3", 0, text(1, 0), 3), ("ann", "p3", 1, text(0, 1), 3), ("ann", "p9", 0, text(1, 1), 4), ("ann", "p5", 0, text(1, 0), 5)]
    d = rebase.Dump(
        spark.createDataFrame(old, "author string, permlink string, chunk_number int, embedding string, sync_seq int"), spark.createDataFrame([("ann", "p4", 6)], "author string, permlink string, sync_seq int"),
        spark.createDataFrame([("ann", f"p{i}", i, 100 + i) for i in (1, 2, 3, 5)], "author string, permlink string, number_of_tokens int, last_vectors_block int"), spark.createDataFrame([], "author string, permlink string"),
    )
    o = rebase.resolve(d, hp, acc, links)
    m = {r.metric: r.n for r in rebase.resolve_metrics(d, o, hp, acc, links, 10).collect()}
    assert m["old_vector_rows"] == 6 and m["old_vector_rows_resolved"] == 5 and m["old_posts_with_vectors_unresolved"] == 1 and m["new_root_posts_missing_in_old"] is None
    new = spark.createDataFrame([(1, 0, [1.0, 0.0], 9), (2, 0, [0.0, 1.0], 9), (3, 0, [1.0, 0.0], 9), (6, 0, [1.0, 0.0], 9)], "post_id int, chunk_number int, embedding array<float>, sync_seq int")
    now = store.Tables(spark.createDataFrame([(2, 22, 222), (6, 66, 666)], "post_id int, number_of_tokens int, last_vectors_block int"), new, spark.createDataFrame([], "post_id int, sync_seq int"))
    merged = rebase.merge_set(o.vectors, new)
    assert {(r.post_id, r.reason) for r in merged.collect()} == {(2, "rechunked"), (3, "rechunked"), (5, "gone"), (6, "new")}
    assert {r.bucket: r.chunk_pairs for r in rebase.histogram(rebase.chunk_pairs(o.vectors, new)).collect()} == {"1 <= 1e-6": 1, "7 > 1e-1": 1}
    assert {r.reason: r.posts for r in rebase.diff_counts(o.vectors, merged).collect()} == {"rechunked": 2, "gone": 1, "new": 1, "total": 4, "unchanged": 1}
    state = rebase.RebaseState()
    with pytest.raises(RuntimeError):
        rebase.guard(state, o, CFG)
    with pytest.raises(RuntimeError):
        rebase.guard(state.identity("old", 3, 0, 1), o, CFG)
    state = state.identity("old", 10, 7, 1)
    with pytest.raises(RuntimeError):
        rebase.guard(state, o, CFG.with_(reduction_mode="pca", reduced_dims=2))
    rebase.guard(state, o, CFG)
    seqs = rebase.merge_seqs(merged, 10)
    assert [(r.post_id, r.sync_seq) for r in seqs.orderBy("post_id").collect()] == [(2, 11), (3, 12), (5, 13), (6, 14)]
    t = rebase.build_merged(o, now, seqs, None)
    rebase.check_unique(t)
    assert {(r.post_id, r.chunk_number, r.sync_seq) for r in t.vectors.collect()} == {(1, 0, 1), (2, 0, 11), (3, 0, 12), (6, 0, 14)}
    assert {(r.post_id, r.sync_seq) for r in t.markers.collect()} == {(4, 6), (2, 11), (3, 12), (5, 13)}
    assert {(r.post_id, r.number_of_tokens, r.last_vectors_block) for r in t.post_data.collect()} == {(1, 1, 101), (2, 22, 222), (3, 3, 103), (5, 5, 105), (6, 66, 666), (4, 0, -1)}
    s = store.Store(spark, path)
    with pytest.raises(RuntimeError):
        rebase.swap(s, t, state)
    state = rebase.swap(s, t, state.to("indexes_built", merge_count=4))
    live, st = s.tables(), s.status()
    ops = feed.page_ops(live.vectors, live.markers, 10, 5, st.max_visible_sync_seq)
    checks = rebase.verify(ops, seqs, o, live, state, st.sync_uuid, st.max_visible_sync_seq, "old", 0, 1)
    assert len(checks) == 10 and all(ok for _, ok, _ in checks), checks
    with pytest.raises(RuntimeError):
        state.to("diffed")


# -- files -----------------------------------------------------------------------------------------------------
def test_files(spark, path, tmp_path):
    (tmp_path / "e.csv").write_bytes(b"")
    assert read_csv(spark, f"{path}/e.csv", "a int, b string").count() == 0
    assert str(StatusLine.parse("u|1|2|3\n")) == "u|1|2|3"
    with pytest.raises(ValueError):
        StatusLine.parse("u|1")
    for ext in (".npy", ".json", ".json.gz"):
        save_matrix(np.eye(2, 3), f"{tmp_path}/m{ext}")
        assert load_matrix(f"{tmp_path}/m{ext}").shape == (2, 3)
    assert find_matrix("m", [str(tmp_path)]).endswith("m.npy")
    with pytest.raises(FileNotFoundError):
        find_matrix("none", [str(tmp_path)])


# -- API -------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def api(spark):
    e = HashingEmbedder(16)
    texts = {1: "red fox in the snow", 2: "blue fox in the rain", 3: "rye bread with honey"}
    vec = spark.createDataFrame([(i, 0, e(["passage: " + x])[0].tolist(), i) for i, x in texts.items()], "post_id int, chunk_number int, embedding array<float>, sync_seq int")
    c = Corpus(
        vec, spark.createDataFrame([(i, i, i, 0) for i in texts], "id int, author_id int, permlink_id int, counter_deleted int"), spark.createDataFrame([(i, 5, 7) for i in texts], "post_id int, number_of_tokens int, last_vectors_block int"),
        spark.createDataFrame([(1, 2)], "observer_id int, muted_id int"), spark.createDataFrame([(i, f"ann{i}") for i in texts], "id int, name string"), spark.createDataFrame([(i, f"p{i}") for i in texts], "id int, permlink string"),
    )
    chains = spark.createDataFrame([("b", 20, "x"), ("a", 20, "x"), ("c", 10, None)], "sync_uuid string, priority int, base_url string")
    return Api(c, Config(dims=16, sync_uuid="own", max_visible_sync_seq=9, skipped_op_count=2, upstream_skipped_op_count=3), e, spark.createDataFrame([(i, f"t{i}", x) for i, x in texts.items()], "post_id int, title string, body string"), chains, spark.createDataFrame([], "post_id int, sync_seq int"))


def test_api(api):
    got = api.posts_search("red fox in the snow", truncate=7, result_limit=3, full_posts=1)
    assert got[0]["permlink"] == "p1" and got[0]["body"] == "red fox" and set(got[1]) == {"author", "permlink"} and len(got) == 3
    assert [p["permlink"] for p in api.posts_search("red fox in the snow", observer="ANN1")][:1] == ["p1"] and len(api.posts_search("fox", observer="ann1")) == 2
    assert [p["permlink"] for p in api.posts_similar("ann1", "p1", result_limit=1)] == ["p2"]
    assert api.authors_search("rye bread", 1) == ["ann3"]
    assert [p and p["permlink"] for p in api.posts_by_ids([{"author": "ann3", "permlink": "p3"}, {"author": "x", "permlink": "y"}, {"author": "ann1", "permlink": "p1"}])] == ["p3", None, "p1"]
    assert api.posts_by_ids_query('[{"author": "ann2", "permlink": "p2"}]', 4)[0]["body"] == "blue"
    assert [c["sync_uuid"] for c in api.sync_chains()] == ["own", "c", "a", "b"]
    assert api.sync_settings()["skipped_op_count"] == 5 and api.version() == "unspecified"
    ops, head = api.embedding_updates(0, 2, "own", 77)
    assert [o["op"] for o in ops] == ["insert", "insert"] and head == {"X-Current-Block-Num": "77", "X-Skipped-Op-Count": "5"}
    assert api.sync_status(5, datetime(2024, 1, 2, 3, 4, 5)) == {"last_block_num": 5, "last_block_time": "2024-01-02T03:04:05"} and api.sync_status(5, None)["last_block_time"] is None
    assert "/posts/search" in api.openapi()["paths"] and fresh(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1)) and not fresh(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 2))


@pytest.mark.parametrize(("call", "error"), [
    (lambda a: a.posts_search("x", result_limit=0), ValueError), (lambda a: a.posts_search("x", full_posts=51), ValueError), (lambda a: a.posts_search("x", observer="nobody"), LookupError),
    (lambda a: a.posts_similar("ann1", "zz"), LookupError), (lambda a: a.posts_by_ids([]), ValueError), (lambda a: a.posts_by_ids([{}]), ValueError), (lambda a: a.posts_by_ids_query("[", 1), ValueError),
    (lambda a: a.posts_by_ids_query("{}"), ValueError), (lambda a: a.sync_status(1, None, ready=False), RuntimeError), (lambda a: a.embedding_updates(0, 1, "zz"), ValueError),
])
def test_api_refuses(api, call, error):
    with pytest.raises(error):
        call(api)


def test_nobody_found_is_an_object(api, spark):
    empty = Api(Corpus(api.corpus.vectors.limit(0), api.corpus.posts, api.corpus.post_data, api.corpus.muted, api.corpus.accounts, api.corpus.permlinks), api.config, api.embed, api.bodies)
    assert empty.authors_search("x") == {} and empty.posts_search("x") == []


def test_csv_gives_every_string_back(spark, path):
    odd = ["x", " Bob ", "\tann", "d\n", "\r", "a\rb", "\r\nc\r\n", "", None, " ", '"', '""', 'a"b', ",", "a,b", "\\", "\\n", "\u2028", "\u00a0"]
    given = [(a, b, 1) for a in odd for b in odd] + [(None, None, None)]
    df = spark.createDataFrame(given, "a string, b string, n int")
    write_csv(df.coalesce(1), f"{path}/odd.csv")
    back = [tuple(r) for r in read_csv(spark, f"{path}/odd.csv", "a string, b string, n int").collect()]
    assert sorted(back, key=repr) == sorted(given, key=repr)


def test_block_loop(spark, path):
    """Waits for its first block, takes ranges far from the head and single blocks near it, stops and goes on."""
    from vecloom.streaming.driver import BlockLoop

    chain_ = spark.createDataFrame([(1, 1, 12, 12, LONG), (2, 0, 18, 18, LONG), (3, 1, 19, 19, LONG), (4, 4, 31, 14, "short")], "id int, root_id int, block_num int, block_num_created int, body string")
    heads, slept, taken = [9, 9, 30], [], []
    s = store.Store(spark, path)
    loop = BlockLoop(s, CFG, HashingEmbedder(4), lambda: chain_, lambda: chain_.select(F.col("id").alias("post_id"), F.lit("t").alias("title"), "body"), lambda: heads[0], first_block=10, stop_at=28, size=10, near=5)
    step = loop.step
    loop.step = lambda a, z: (taken.append((a, z)), step(a, z))
    assert loop.run(sleep=lambda n: (slept.append(n), heads.pop(0))) == "block limit reached"
    assert slept == [3.0, 3.0] and taken == [(10, 19), (20, 28)] and s.status().last_block == 28
    assert {r.post_id for r in s.tables().vectors.collect()} == {1, 2} and {r.post_id for r in s.tables().post_data.collect()} == {1, 2, 4}
    s.update(continue_processing=False)
    assert loop.run() == "stop requested"
    s.update(continue_processing=True)
    loop.stop_at = None
    heads[0] = 31
    assert loop.run() == "head reached" and taken[2:] == [(29, 29), (30, 30), (31, 31)] and s.status().last_block == 31
