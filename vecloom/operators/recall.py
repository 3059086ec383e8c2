"""Recall of an approximate search against the exact one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

KEY = ("post_id", "chunk_number")


def sample_queries(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, but the same for the same seed whatever the partitioning: the first by a seeded hash."""
    return vectors.orderBy(F.xxhash64(F.lit(seed), *KEY), *KEY).limit(n)


def recall_table(exact: DataFrame, approximate: DataFrame, ks: Sequence[int] = (1, 5, 10, 20), cs: Sequence[int] = (100, 500, 1000)) -> DataFrame:
    """(measure, k, c, recall): mean share of the exact top k found in the approximate top k, and in its top c.

    Both inputs: (q_post_id, q_chunk_number, post_id, chunk_number, rank). Shares are of k even where a query has fewer
    true neighbours. Queries are those of the exact side.
    """
    q = ["q_post_id", "q_chunk_number"]
    hits = exact.select(*q, *KEY, F.col("rank").alias("re")).join(approximate.select(*q, *KEY, F.col("rank").alias("ra")), [*q, *KEY], "left")
    cells = [(k, None) for k in ks] + [(k, c) for k in ks for c in cs if c >= k]
    per = hits.groupBy(*q).agg(*[(F.count_if((F.col("re") <= k) & (F.col("ra") <= (c or k))) / F.lit(float(k))).alias(f"m{i}") for i, (k, c) in enumerate(cells)])
    means = per.agg(*[F.round(F.avg(f"m{i}"), 6).alias(f"m{i}") for i in range(len(cells))])
    rows = [F.struct(F.lit("top_k" if c is None else "within_c").alias("measure"), F.lit(k).alias("k"), F.lit(c).cast("int").alias("c"), F.col(f"m{i}").alias("recall")) for i, (k, c) in enumerate(cells)]
    return means.select(F.inline(F.array(*rows)))


def overlap(a: DataFrame, b: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """(by, common): how many different items of a group both sides have; 0 for groups of both without any.

    Joined by item, not as lists, so a group of any size is spread over many tasks.
    """
    left, right = (df.select(*by, item).distinct() for df in (a, b))
    both = left.filter(F.col(item).isNotNull()).join(right, [*by, item], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    groups = left.select(*by).distinct().join(right.select(*by).distinct(), list(by), "left_semi")
    return groups.join(both, list(by), "left").select(*by, F.coalesce("_n", F.lit(0)).cast("int").alias("common"))
