"""Processing only new or changed records.

A derived table is kept in step with its sources partition by partition. Every partition of the key
space has a fingerprint (row count and additive row hashes of the columns that matter); a run computes the
fingerprints, recomputes only the partitions where they differ from those of the last successful run,
replaces each of them atomically by dynamic partition overwrite, and stores the fingerprints last. A run that
dies before that leaves the old fingerprints, so the next run does the same partitions again: nothing is skipped,
nothing is repeated.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.names import additive, row_hash
from ..session import SharedFiles

PART = "part"


class PartitionedRefresh:
    """Keeps ``path/data`` in step with its sources.

    buckets: partitions of the key space; bounds the fingerprint table and the list of changed partitions. By default the first
    refresh takes one for every ROWS source rows, and a refresh whose sources have outgrown them by GROWN rebuilds
    the table with more. Rows with a null key belong to no partition and are ignored. Empty sources give an empty table.
    After a refresh ``changed`` lists the partitions that were recomputed, and ``filled`` counts those with source rows.
    """

    ROWS = 1 << 16
    GROWN = 8
    LEAST, MOST = 64, 1 << 16

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self._given = spark, path.rstrip("/"), buckets
        self.files = SharedFiles(spark, self.path)
        self.buckets = buckets or self.LEAST
        self.changed: list[int] = []
        self.filled = 0

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def fingerprints(self, sources: Mapping[str, DataFrame], key: str) -> DataFrame:
        """(source, part, n, lo, hi): at most buckets rows a source, combined before the shuffle."""
        out = None
        for name, df in sources.items():
            rows = df.filter(F.col(key).isNotNull()).select(self.part(F.col(key)).alias(PART), row_hash(*df.columns).alias("h"))
            prints = rows.groupBy(PART).agg(*additive(F.col("h"))).select(F.lit(name).alias("source"), PART, "n", "lo", "hi")
            out = prints if out is None else out.unionByName(prints)
        return out

    def _state(self) -> dict:
        """What the last successful refresh left: its number of partitions and their fingerprints."""
        names = [n for n in self.files.names("state") if n.endswith(".json")]
        return json.loads(self.files.read(f"state/{names[-1]}")) if names else {}

    def _keep(self, prints: Mapping[tuple[str, int], tuple[int, int, int]]) -> None:
        names = [n for n in self.files.names("state") if n.endswith(".json")]
        version = int(names[-1][:-5]) + 1 if names else 0
        self.files.write(f"state/{version:09d}.json", json.dumps({"buckets": self.buckets, "prints": [[*k, *v] for k, v in prints.items()]}))
        for old in names[:-1]:
            self.files.delete(f"state/{old}")

    def _layout(self) -> str:
        """Folder of the table under its present number of partitions; a rebuild begins a new one."""
        return f"data-{self.buckets:06d}"

    def _fitting(self, rows: int) -> int:
        return min(self.MOST, max(self.LEAST, 1 << math.ceil(math.log2(max(1, rows / self.ROWS)))))

    def _prints(self, sources: Mapping[str, DataFrame], key: str) -> dict[tuple[str, int], tuple[int, int, int]]:
        return {(r.source, r.part): (r.n, r.lo, r.hi) for r in self.fingerprints(sources, key).collect()}  # bounded by buckets

    def refresh(self, sources: Mapping[str, DataFrame], key: str, transform: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
        """Recomputes changed partitions and returns the whole derived table.

        transform gets the sources' rows of the changed partitions, each with a column ``part`` that it must keep.
        """
        last = self._state()
        self.buckets = self._given or last.get("buckets", self.LEAST)
        now = self._prints(sources, key)
        rows = sum(n for n, _, _ in now.values())
        if not self._given and rows > (self.GROWN if last else 1) * self.ROWS * self.buckets and self.buckets < self.MOST:
            self.buckets = self._fitting(rows)
            now = self._prints(sources, key)
        self.filled = len({p for _, p in now})
        data = self._layout()
        before = {(s, p): tuple(v) for s, p, *v in last.get("prints", [])} if last.get("buckets") == self.buckets else {}
        self.changed = sorted({k[1] for k in now.keys() | before.keys() if now.get(k) != before.get(k)})
        if self.changed:
            some = {}
            for name, df in sources.items():
                rows = df.withColumn(PART, self.part(F.col(key))).filter(F.col(key).isNotNull())
                some[name] = rows if len(self.changed) == self.buckets else rows.filter(F.col(PART).isin(self.changed))
            held = {p: self.files.names(f"{data}/{PART}={p}") for p in self.changed}
            out = transform(some).hint("rebalance", F.col(PART))  # large partitions are written by several tasks, small ones together
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.path}/{data}")
            for p, files in held.items():
                if files and self.files.names(f"{data}/{PART}={p}") == files:  # no row was written, so nothing was replaced
                    self.files.delete(f"{data}/{PART}={p}")
            self._keep(now)
            for old in self.files.names():
                if old.startswith("data-") and old != data:
                    self.files.delete(old)
        if not any(n.startswith(PART + "=") for n in self.files.names(data)):
            return transform({n: d.withColumn(PART, F.lit(0)).limit(0) for n, d in sources.items()})
        return self.spark.read.parquet(f"{self.path}/{data}")


def last_report(runs: DataFrame, run: str = "run_id", by: str = "reported_at") -> DataFrame:
    """One row per run, that of its last report; equal times are settled by the other columns, null times come first."""
    rest = [c for c in runs.columns if c not in (run, by)]
    last = runs.groupBy(run).agg(F.max(F.struct(by, *rest)).alias("_r"))
    return last.select(run, "_r.*")


def uncovered(ranges: DataFrame, owners: DataFrame, owner: str, lo: str, hi: str, least: Column, most: Column, cells: int = 256) -> DataFrame:
    """(owner, first, last): the stretches of least..most that no range (lo, hi] of the owner covers.

    Worked out in ``cells`` equal parts of least..most, so that an owner with a third of all ranges is spread over many tasks, while
    a range counts at most once a part however wide it is. A stretch is cut where a part ends. least and most: one-row
    scalar expressions held by ``owners`` rows.
    """
    width = F.ceil((F.col("_z") - F.col("_a") + 1) / F.lit(cells)).cast("long")
    bounds = owners.select(owner, least.alias("_a"), most.alias("_z")).filter("_a is not null").withColumn("_w", width)
    cell = lambda c: F.floor((c - F.col("_a")) / F.col("_w")).cast("long")
    begin = F.col("_a") + F.col("cell") * F.col("_w")
    grid = bounds.select("*", F.explode(F.sequence(F.lit(0), cell(F.col("_z")))).alias("cell"))
    stop = F.least(begin + F.col("_w"), F.col("_z") + 1)
    ends = grid.select(owner, "cell", begin.alias("begin"), stop.alias("s"), stop.alias("e"))
    clipped = (
        ranges.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(hi) > F.col(lo)))
        .select(owner, (F.col(lo).cast("long") + 1).alias("s"), F.col(hi).cast("long").alias("e"))
        .distinct()
        .join(bounds, owner)
        .withColumns({"s": F.greatest("s", "_a"), "e": F.least("e", "_z")})
        .filter("s <= e")
        .withColumn("cell", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e")))))
        .select(owner, "cell", begin.alias("begin"), F.greatest("s", begin).alias("s"), F.least("e", begin + F.col("_w") - 1).alias("e"))
        .distinct()
    )
    w = W.partitionBy(owner, "cell").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    until = F.coalesce(F.max("e").over(w), F.col("begin") - 1)
    return clipped.unionByName(ends).withColumn("first", until + 1).withColumn("last", F.col("s") - 1).filter("first <= last").select(owner, "first", "last")


def post_states(spark: SparkSession, vectors: DataFrame, posts: DataFrame, path: str, buckets: int | None = None) -> tuple[DataFrame, PartitionedRefresh]:
    """(post_id, seq, block): highest sync_seq and last block of each post, kept below ``path``, and what kept it."""
    sources = {
        "vectors": vectors.select("post_id", "sync_seq"),
        "posts": posts.select("post_id", "last_vectors_block"),
    }

    def state(some: dict[str, DataFrame]) -> DataFrame:
        seqs = some["vectors"].groupBy(PART, "post_id").agg(F.max("sync_seq").cast("long").alias("seq"))
        blocks = some["posts"].filter("last_vectors_block >= 0").groupBy(PART, "post_id").agg(F.max("last_vectors_block").cast("long").alias("block"))
        return seqs.join(blocks, [PART, "post_id"], "full").select("post_id", "seq", "block", PART)

    kept = PartitionedRefresh(spark, path, buckets)
    return kept.refresh(sources, "post_id", state), kept


def done_runs(runs: DataFrame) -> DataFrame:
    """The runs whose last report says done."""
    known = runs.filter(F.col("consumer").isNotNull()).select("run_id", "consumer", "after_seq", "last_seq", "after_block", "last_block", "status", "reported_at")
    return last_report(known).filter(F.lower(F.trim("status")) == "done")


def due_posts(spark: SparkSession, vectors: DataFrame, posts: DataFrame, runs: DataFrame, path: str, buckets: int | None = None, width: int = 4096, cells: int = 256) -> DataFrame:
    """(consumer, post_id) still owed to each consumer.

    The state of the posts (highest sync_seq, last block) is a derived table kept by PartitionedRefresh; what
    the successful runs of a consumer leave uncovered is joined to it. Null ids and consumers are ignored, a run
    with a null bound covers nothing there, repeated rows count once, other columns are not read. width: values that meet
    in one key of that join, which makes a row for each such key of a gap, so it costs what it finds.
    """
    table, _ = post_states(spark, vectors, posts, path, buckets)
    limits = table.agg(F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    owners = runs.filter(F.col("consumer").isNotNull()).select("consumer").distinct().join(F.broadcast(limits), F.lit(True))  # limits is one row
    done = done_runs(runs)
    due = None
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    for value, lo, hi, a, z in (("seq", "after_seq", "last_seq", "s0", "s1"), ("block", "after_block", "last_block", "b0", "b1")):
        gaps = uncovered(done, owners, "consumer", lo, hi, F.col(a), F.col(z), cells).withColumn("cell", F.explode(F.sequence(cell("first"), cell("last"))))
        posts_at = table.filter(F.col(value).isNotNull()).select("post_id", F.col(value).alias("v"), cell(value).alias("cell"))
        hit = posts_at.join(gaps, "cell").filter("v between first and last").select("consumer", "post_id")
        due = hit if due is None else due.unionByName(hit)
    return due.distinct()
