"""Fingerprinted refresh and the posts due to consumers."""

import random

import pytest
from pyspark.sql import functions as F

from vecloom.operators.incremental import PartitionedRefresh, due_posts

RUNS = "run_id int, consumer string, after_seq int, last_seq int, after_block int, last_block int, status string, reported_at string"


def total(some):
    return some["a"].groupBy("part", "k").agg(F.sum("v").alias("v"))


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v int")


def test_only_changed_partitions_are_recomputed(spark, path):
    r = PartitionedRefresh(spark, path, 8)
    rows = [(i, i) for i in range(40)]
    first = r.refresh({"a": table(spark, rows)}, "k", total)
    assert len(r.changed) == 8 and {(x.k, x.v) for x in first.collect()} == set(rows)
    again = r.refresh({"a": table(spark, rows[::-1])}, "k", total)
    assert r.changed == [] and again.count() == 40
    rows[3] = (3, 99)
    third = r.refresh({"a": table(spark, rows)}, "k", total)
    assert len(r.changed) == 1 and {(x.k, x.v) for x in third.collect()} == set(rows)


def test_vanished_partitions_go_and_nulls_are_told_apart(spark, path):
    r = PartitionedRefresh(spark, path, 4)
    r.refresh({"a": table(spark, [(1, 1), (2, 2), (3, 3)])}, "k", total)
    left = r.refresh({"a": table(spark, [(2, 2)])}, "k", total)
    assert [(x.k, x.v) for x in left.collect()] == [(2, 2)]
    r.refresh({"a": table(spark, [(2, None)])}, "k", total)
    assert len(r.changed) == 1
    assert r.refresh({"a": table(spark, [(None, 5)])}, "k", total).count() == 0


def test_a_partition_whose_derived_rows_all_vanish_goes(spark, path):
    positive = lambda some: total({"a": some["a"].filter("v > 0")})
    r = PartitionedRefresh(spark, path, 4)
    r.refresh({"a": table(spark, [(1, 1), (2, 2), (3, 3)])}, "k", positive)
    left = r.refresh({"a": table(spark, [(1, -1), (2, 2), (3, 3)])}, "k", positive)
    assert {(x.k, x.v) for x in left.collect()} == {(2, 2), (3, 3)}
    assert r.refresh({"a": table(spark, [(1, -1), (2, -2), (3, -3)])}, "k", positive).count() == 0


def test_partitions_follow_the_size_and_an_outgrown_table_is_rebuilt(spark, path):
    class Small(PartitionedRefresh):
        ROWS, LEAST = 10, 2

    rows = [(i, i) for i in range(400)]
    r = Small(spark, path)
    assert r.refresh({"a": table(spark, rows[:20])}, "k", total).count() == 20 and r.buckets == 2
    assert r.refresh({"a": table(spark, rows[:60])}, "k", total).count() == 60 and r.buckets == 2
    assert {(x.k, x.v) for x in r.refresh({"a": table(spark, rows)}, "k", total).collect()} == set(rows) and r.buckets == 64
    again = Small(spark, path)
    assert again.refresh({"a": table(spark, rows)}, "k", total).count() == 400 and again.buckets == 64 and again.changed == []
    assert sorted(n for n in r.files.names() if n.startswith("data")) == [r._layout()]


def test_a_failed_run_is_done_again(spark, path):
    r = PartitionedRefresh(spark, path, 4)
    r.refresh({"a": table(spark, [(1, 1)])}, "k", total)

    def broken(some):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        r.refresh({"a": table(spark, [(1, 2)])}, "k", broken)
    # data written but not the fingerprints: as if the driver had died in between
    total({"a": table(spark, [(1, 7)]).withColumn("part", r.part(F.col("k")))}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{r._layout()}")
    out = r.refresh({"a": table(spark, [(1, 2)])}, "k", total)
    assert [(x.k, x.v) for x in out.collect()] == [(1, 2)]


def brute(vectors, posts, runs):
    last = {}
    for r in runs:
        key = (r[7] or "",) + tuple((x is not None, x) for x in r[1:7])
        if r[1] is not None and (r[0] not in last or key > last[r[0]][0]):
            last[r[0]] = (key, r)
    done = [r for _, r in last.values() if (r[6] or "").strip().lower() == "done"]
    seq, block = {}, {}
    for p, s in vectors:
        if p is not None and s is not None:
            seq[p] = max(seq.get(p, s), s)
    for p, b in posts:
        if p is not None and b is not None and b >= 0:
            block[p] = max(block.get(p, b), b)
    out = set()
    for c in {r[1] for r in runs if r[1] is not None}:
        mine = [r for r in done if r[1] == c]
        for p in seq.keys() | block.keys():
            a = p in seq and not any(r[2] is not None and r[3] is not None and r[2] < seq[p] <= r[3] for r in mine)
            b = p in block and not any(r[4] is not None and r[5] is not None and r[4] < block[p] <= r[5] for r in mine)
            if a or b:
                out.add((c, p))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_due_posts_against_brute_force(spark, path, seed):
    rnd = random.Random(seed)
    maybe = lambda x: None if rnd.random() < 0.1 else x
    vectors = [(maybe(rnd.randint(1, 30)), maybe(rnd.randint(1, 200))) for _ in range(80)]
    posts = [(maybe(rnd.randint(1, 40)), maybe(rnd.choice([-1, rnd.randint(0, 90)]))) for _ in range(60)]
    runs = []
    for i in range(25):
        a, b = rnd.randint(0, 200), rnd.randint(0, 90)
        c = rnd.choice(["x", "y", "z", None])
        for k in range(rnd.randint(1, 3)):
            runs.append((i, c, maybe(a), a + 40, maybe(b), b + 15, rnd.choice(["done", "DONE", "running", "failed"]), maybe(f"2024-01-0{rnd.randint(1, 9)}")))
    runs += runs[:5]
    got = due_posts(spark, spark.createDataFrame(vectors, "post_id int, sync_seq int").withColumn("cell", F.lit(1)), spark.createDataFrame(posts, "post_id int, last_vectors_block int"), spark.createDataFrame(runs, RUNS), path, 4, width=16, cells=5)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(vectors, posts, runs)


def test_due_posts_of_empty_tables(spark, path):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    args = empty("post_id int, sync_seq int"), empty("post_id int, last_vectors_block int")
    assert due_posts(spark, *args, empty(RUNS), path, 4).count() == 0
    one = spark.createDataFrame([(1, "c", 0, 9, 0, 9, "failed", "2024")], RUNS)
    assert due_posts(spark, spark.createDataFrame([(5, 3)], "post_id int, sync_seq int"), args[1], one, path, 4).collect()[0].post_id == 5
