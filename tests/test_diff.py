"""Hierarchical diff of two copies."""

import random

from pyspark.sql import functions as F

from vecloom.operators.diff import differences, leaf_sums, mismatched, vector_diff

SIDE = "k int, a int, b string"


def diff(spark, old, new, per_leaf=2):
    f = {n: (F.col(n), lambda x, y: ~x.eqNullSafe(y)) for n in ("a", "b")}
    out = differences(spark.createDataFrame(old, SIDE), spark.createDataFrame(new, SIDE), ["k"], f, per_leaf=per_leaf)
    return sorted((r.k, r.what) for r in out.collect())


def test_against_brute_force(spark):
    rnd = random.Random(3)
    old = {i: (rnd.choice([1, 2, None]), rnd.choice(["x", None])) for i in range(300)}
    new = {i: v for i, v in old.items() if rnd.random() > 0.05}
    for i in rnd.sample(sorted(new), 20):
        new[i] = (rnd.choice([1, 2, None]), rnd.choice(["x", None]))
    new |= {1000 + i: (1, "n") for i in range(5)}
    want = []
    for k in old.keys() | new.keys():
        if k not in new:
            want.append((k, "only_old"))
        elif k not in old:
            want.append((k, "only_new"))
        else:
            want += [(k, n) for i, n in enumerate("ab") if old[k][i] != new[k][i]]
    assert diff(spark, [(k, *v) for k, v in old.items()], [(k, *v) for k, v in new.items()]) == sorted(want)


def test_equal_and_empty_sides(spark):
    rows = [(i, i, "x") for i in range(20)]
    assert diff(spark, rows, rows[::-1]) == []
    assert diff(spark, [], []) == []
    assert diff(spark, [(1, None, None)], []) == [(1, "only_old")]


def test_only_mismatched_ranges_are_compared(spark):
    from vecloom.functions.names import row_hash

    side = lambda rows: spark.createDataFrame(rows, SIDE).withColumns({"_key": row_hash("k"), "_row": row_hash("k", "a", "b")})
    old = [(i, i, "x") for i in range(200)]
    new = [*old[:-1], (199, 0, "x")]
    sums = leaf_sums(side(old), side(new), 12)
    for fan in (3, 5, 12):
        assert mismatched(sums, 12, fan).count() == 1
    alone = leaf_sums(side(old), side(old[:0]), 12)
    assert mismatched(alone, 12).count() == alone.count() and mismatched(leaf_sums(side(old), side(old), 12), 12).count() == 0


def test_fields_are_fetched_for_differing_rows_only(spark):
    """The test of a field sees rows whose canonical values differ; null against a value differs without it."""
    side = lambda rows: spark.createDataFrame(rows, "k int, c int")
    old, new = [(i, i) for i in range(50)] + [(90, None), (91, None)], [(i, i + (i % 10 == 0)) for i in range(50)] + [(90, 1), (91, None)]
    asked = {}

    def fetch(name, rows):
        got = [r.k for r in rows.collect()]
        asked[name] = sorted(got)
        return spark.createDataFrame([(k, float(k)) for k in got for _ in range(2)], "k int, v double")

    out = differences(side(old), side(new), ["k"], {"v": (F.col("c"), lambda a, b: a >= 20)}, fetch, 4)
    assert sorted((r.k, r.what) for r in out.collect()) == [(20, "v"), (30, "v"), (40, "v"), (90, "v")]
    assert asked == {"old": [0, 10, 20, 30, 40], "new": [0, 10, 20, 30, 40]}


def test_vectors_under_names(spark):
    vec = lambda *x: [float(v) for v in [*x, *[0] * (64 - len(x))]]
    text = lambda v: str(v)
    posts = spark.createDataFrame([(1, 10, 20, 0), (2, 10, 20, 1), (3, 10, 21, 2), (4, 10, 21, 3), (5, 11, 20, 0)], "id int, author_id int, permlink_id int, counter_deleted int")
    accounts = spark.createDataFrame([(10, "ann"), (11, "bob")], "id int, name string")
    links = spark.createDataFrame([(20, "p"), (21, "q")], "id int, permlink string")
    new = [(1, 0, vec(1, 2), 5), (1, 0, vec(1, 2), 5), (1, 1, vec(0), 5), (1, 2, vec(3), 5), (1, 7, vec(9), 4), (2, 9, vec(1), 9), (4, 0, vec(1), 8), (5, 0, vec(1, 1), 2), (5, 1, None, 2)]
    old = [(" @Ann", "P", 0, text(vec(1.0000001, 2)), 5), ("ann", "p\n", 1, "[]", 5), ("ann", "p", 2, text(vec(0, 3)), 5), ("ann", "p", 3, text(vec(1)), 5), ("ann", "p", 8, text(vec(1)), 1), ("ann", "q", 0, text(vec(1)), 7), ("bob", "p", 0, "x", 2), (None, "p", 0, "[1]", 2), ("eve", "p", 0, "", 1)]
    got = vector_diff(spark.createDataFrame(old, "author string, permlink string, chunk_number int, embedding string, sync_seq int").withColumn("v", F.lit(1)), spark.createDataFrame(new, "post_id int, chunk_number int, embedding array<float>, sync_seq int"), posts, accounts, links)
    assert sorted(tuple(r) for r in got.collect()) == [("ann", "p", 2, "embedding"), ("ann", "p", 3, "only_old"), ("ann", "q", 0, "sync_seq"), ("bob", "p", 0, "embedding"), ("bob", "p", 1, "only_new"), ("eve", "p", 0, "only_old")]


def test_noise_below_the_threshold_is_no_difference(spark):
    rnd = random.Random(5)
    posts = spark.createDataFrame([(i, 10, i, 0) for i in range(40)], "id int, author_id int, permlink_id int, counter_deleted int")
    accounts, links = spark.createDataFrame([(10, "ann")], "id int, name string"), spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id int, permlink string")
    vecs = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(40)]
    far = {3, 17, 30}
    old = []
    for i, v in enumerate(vecs):
        w = [x + rnd.gauss(0, 0.5) if i in far else round(x, 4) for x in v]
        old.append(("ann", f"p{i}", 0, "[" + ", ".join(f"{x:.6e}" for x in w) + "]", 1))
    got = vector_diff(spark.createDataFrame(old, "author string, permlink string, chunk_number int, embedding string, sync_seq int"), spark.createDataFrame([(i, 0, v, 1) for i, v in enumerate(vecs)], "post_id int, chunk_number int, embedding array<float>, sync_seq int"), posts, accounts, links)
    assert {r.permlink for r in got.collect()} == {f"p{i}" for i in far}
