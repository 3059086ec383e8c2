"""Log-structured merge of change runs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from vecloom.operators import changelog
from vecloom.operators.changelog import ChangeLog, feed_changes

CHANGES = "k string, seq long, put boolean, v int"


def log(spark, path):
    return ChangeLog(spark, path, ["k"], "seq", T.StructType.fromDDL("v int"), buckets=4)


def state(changes):
    last = {}
    for k, s, p, v in changes:
        if None not in (k, s, p):
            key = (s, p, (v is not None, v))
            if k not in last or key > last[k]:
                last[k] = key
    return {(k, s, v[1]) for k, (s, p, v) in last.items() if p}


def rows(df):
    return {(r.k, r.seq, r.v) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_in_any_order_and_compaction(spark, path, seed):
    rnd = random.Random(seed)
    maybe = lambda x: None if rnd.random() < 0.05 else x
    changes = [(maybe(f"k{rnd.randint(0, 20)}"), maybe(rnd.randint(1, 60)), maybe(rnd.random() < 0.7), maybe(rnd.randint(0, 3))) for _ in range(200)]
    changes += rnd.sample(changes, 40)
    rnd.shuffle(changes)
    one = log(spark, path)
    one.append(spark.createDataFrame(changes[:90], CHANGES), "a")
    one.append(spark.createDataFrame(changes[90:], CHANGES).withColumn("run", F.lit("clash")), "b")
    assert rows(one.merged()) == state(changes)
    one.compact("base")
    assert one.live() == ["base"] and rows(one.merged()) == state(changes)
    more = [("k1", 1000, False, None), ("new", 1001, True, 5), ("k2", 0, False, 1)]
    one.append(spark.createDataFrame(more, CHANGES), "c")
    assert rows(log(spark, path).merged()) == state([*[(k, s, True, v) for k, s, v in state(changes)], *more])


def test_a_late_put_of_a_deleted_key_stays_hidden_after_compaction(spark, path):
    one = log(spark, path)
    one.append(spark.createDataFrame([("a", 90, True, 1), ("b", 5, True, 2)], CHANGES), "r1")
    one.append(spark.createDataFrame([("a", 100, False, None)], CHANGES), "r2")
    one.compact("base")
    one.append(spark.createDataFrame([("a", 90, True, 1), ("a", 99, True, 3)], CHANGES), "r3")
    assert rows(one.merged()) == {("b", 5, 2)}
    one.compact("base2")
    one.append(spark.createDataFrame([("a", 90, True, 1)], CHANGES), "r4")
    assert rows(one.merged()) == {("b", 5, 2)}
    one.append(spark.createDataFrame([("a", 101, True, 4)], CHANGES), "r5")
    assert rows(one.merged()) == {("a", 101, 4), ("b", 5, 2)}


def test_the_merge_needs_no_shuffle(spark, path):
    one = log(spark, path)
    one.append(spark.createDataFrame([("a", 1, True, 1)], CHANGES), "r1")
    one.append(spark.createDataFrame([("a", 2, True, 2)], CHANGES), "r2")
    assert "Exchange" not in one.merged()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("label", ["r2", None])
def test_a_batch_that_died_is_invisible_and_removed(spark, path, label):
    one = log(spark, path)
    one.append(spark.createDataFrame([("a", 1, True, 9)], CHANGES), F.col("v").cast("string"))
    one._publish, kept = lambda *_: (_ for _ in ()).throw(RuntimeError("lost")), one._publish
    with pytest.raises(RuntimeError):  # written under a label that is live, never published
        one.append(spark.createDataFrame([("a", 9, False, 9), ("c", 9, True, 9)], CHANGES), label or F.col("v").cast("string"))
    one._publish = kept
    assert rows(one.merged()) == rows(log(spark, path).merged()) == {("a", 1, 9)}
    one.append(spark.createDataFrame([("b", 2, True, 2)], CHANGES), "r2")
    assert rows(one.merged()) == {("a", 1, 9), ("b", 2, 2)} and len(one.files.names("runs")) == 2
    with pytest.raises(ValueError):
        one.append(spark.createDataFrame([("b", 2, True, 2)], CHANGES), "r2")


def test_compaction_under_one_name_again(spark, path):
    one = log(spark, path)
    for i in range(3):
        one.append(spark.createDataFrame([(f"k{i}", i, True, i), ("k", i, True, i)], CHANGES), f"r{i}")
        one.compact("base")
        assert one.live() == ["base"] and rows(one.merged()) == {*((f"k{j}", j, j) for j in range(i + 1)), ("k", i, i)}


def test_compaction_by_itself_keeps_few_runs(spark, path):
    """Small runs are merged with small ones; a large one is left alone until they have grown; buckets double when full."""
    one = ChangeLog(spark, path, ["k"], "seq", T.StructType.fromDDL("v int"), buckets=2, max_runs=3)
    one.append(spark.range(5000).selectExpr("concat('x', id) k", "id seq", "true put", "int(id) v"), "large")
    large = one.runs()[0].id
    for i in range(5):
        one.append(spark.createDataFrame([("a", i, i != 4, i), (f"b{i}", i, True, i)], CHANGES), f"r{i}")
        assert len(one.runs()) <= 3
    assert large in {r.id for r in one.runs()} and one.merged().count() == 5005
    changelog.BUCKET_BYTES, kept = 10_000, changelog.BUCKET_BYTES
    try:
        one.compact()
    finally:
        changelog.BUCKET_BYTES = kept
    assert one._manifest()[0] > 2 and one.merged().count() == 5005 and one.merged(tombstones=True).count() == 5006


def test_streams_are_merged_block_by_block():
    """Against a dict, over streams of uneven blocks; no more than a block a stream is held."""
    rnd = random.Random(3)
    schema = pa.schema([("k", pa.string()), ("n", pa.int32()), ("seq", pa.int64()), ("put", pa.bool_()), ("v", pa.list_(pa.float32()))])
    want, streams = {}, []
    for _ in range(7):
        rows_ = {}
        for _ in range(rnd.randint(0, 300)):
            rows_[rnd.choice("abßあ𝄞"), rnd.randint(0, 60)] = (rnd.randint(0, 5), rnd.random() < 0.6, rnd.choice([None, [], [1.0], [1.0, None], [0.5, 2.0]]))
        for key, r in rows_.items():
            if key not in want or (r[:2], changelog._rank(r[2])) > (want[key][:2], changelog._rank(want[key][2])):
                want[key] = r
        flat = [(*k, *r) for k, r in sorted(rows_.items(), key=lambda x: (x[0][0].encode(), x[0][1]))]
        cuts = sorted({0, len(flat), *(rnd.randint(0, len(flat)) for _ in range(5))})
        parts = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in flat[a:b]], schema) for a, b in zip(cuts, cuts[1:])]
        streams.append(iter(parts))
    got = [tuple(r.values()) for t in changelog.merge_streams(streams, ["k", "n"], "seq") for r in t.to_pylist()]
    assert [g[:2] for g in got] == sorted(want, key=lambda k: (k[0].encode(), k[1])) and {g[:2]: g[2:] for g in got} == want


def test_empty(spark, path):
    one = log(spark, path)
    assert one.merged().count() == 0
    one.append(spark.createDataFrame([], CHANGES), "r1")
    assert one.merged().count() == 0


def test_feed_changes_reads_names_and_ops(spark):
    rows_ = spark.createDataFrame([(" @Ann\n", "X ", "INSERT\n"), ("ann", "x", " delete"), ("b", "y", "odd"), (None, "y", None)], "author string, permlink string, op string")
    assert [(r.author, r.permlink, r.put) for r in feed_changes(rows_).collect()] == [("ann", "x", True), ("ann", "x", False), ("b", "y", None), (None, "y", None)]
