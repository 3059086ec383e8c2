"""Queries over whole tables, and the recall of the index they probe."""

import numpy as np

import __spark_entry__
from vecloom.operators.index import InvertedFile
from vecloom.plans import retrieval
from vecloom.plans.base import vectors
from vecloom.plans.registry import Tables


def test_all_blocks_reach_every_root_post(spark):
    folder = "/root/testdata/sf0.01"
    posts = spark.read.parquet(f"{folder}/hive_posts.parquet").filter("(root_id = id or root_id = 0) and coalesce(block_num, block_num_created) is not null")
    want = {r.id for r in posts.select("id").collect()}
    q = __spark_entry__.queries()
    assert {r.post_id for r in q["in01_posts_all_blocks"](spark, folder).collect()} == want
    assert {p for r in q["wn08_tasks_all_blocks"](spark, folder).collect() for p in r.post_ids} == want


def test_index_probes_find_nine_of_ten_neighbours(spark, path):
    index, _ = InvertedFile.build(vectors(Tables(spark, "/root/testdata/sf0.1")), path + "/ivf", 16)
    rows = spark.read.parquet(index.path).filter("cell >= 0").select("post_id", "embedding", "cell").collect()
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cell, asked = np.array([r.cell for r in rows]), np.flatnonzero(np.array([r.post_id % 50 == 0 for r in rows]))
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    probed = np.argsort(-(x[asked] @ index.centroids.T), axis=1, kind="stable")[:, : getattr(retrieval, "PROBES", 8)]
    found = np.mean([np.isin(cell[t], p).mean() for t, p in zip(np.argsort(-s, axis=1)[:, :20], probed)])
    assert found >= 0.9
