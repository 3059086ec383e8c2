"""Ingestion: from block ranges over chunks and vectors to a versioned store.

A batch is a pure function of the old tables and the new chunks: a change, that is the posts it touches and their new rows.
Plain Parquet has no MERGE, so a change is written as a run beside the older ones, in proportion to its own size, and reading passes over
rows of posts that a later run touches. Runs of similar size are merged from time to time. A pointer file that names the live runs is
replaced last; readers see whole versions only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import Config
from ..functions.embed import Embedder, embed_texts, to_half
from ..functions.text import chunk_posts, clean, post_text
from ..schemas import DELETED, POST_DATA, POSTS_VECTORS
from ..session import SharedFiles
from .search import root_post


def posts_in_range(posts: DataFrame, first: int, last: int) -> DataFrame:
    """(post_id, block) of root posts created or edited in the block range, block being the later of both."""
    touched = F.col("block_num_created").between(first, last) | F.col("block_num").between(first, last)
    return posts.filter(root_post() & touched).select(F.col("id").alias("post_id"), F.greatest("block_num", "block_num_created").alias("block"))


def ordered_ids(ranged: DataFrame) -> DataFrame:
    """One row, one array: the ids by block and id; the empty array for no posts. For ranges of bounded size."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("block", "post_id"))), lambda x: x["post_id"])
    return ranged.agg(F.coalesce(ids, F.array().cast("array<int>")).alias("post_ids"))


def tasks(ranged: DataFrame, size: int = 100) -> DataFrame:
    """(task, first_block, last_block, post_ids): posts dealt into tasks of a fixed size in block order.

    The position of a post is worked out without a window over all posts or blocks: counts per block are added up in cells of
    4096 blocks, the cells' counts one row a cell, and posts are numbered within their block.
    """
    counts = ranged.groupBy("block").agg(F.count(F.lit(1)).alias("c")).withColumn("_cell", F.floor(F.col("block") / 4096))
    cells = counts.groupBy("_cell").agg(F.sum("c").alias("_sum"))
    above = cells.select("_cell", (F.sum("_sum").over(W.orderBy("_cell")) - F.col("_sum")).alias("_above"))
    within = F.sum("c").over(W.partitionBy("_cell").orderBy("block")) - F.col("c")
    before = counts.withColumn("_within", within).join(above, "_cell").select("block", (F.col("_above") + F.col("_within")).alias("_before"))
    numbered = ranged.withColumn("_n", F.row_number().over(W.partitionBy("block").orderBy("post_id"))).join(before, "block")
    placed = numbered.withColumn("task", F.floor((F.col("_before") + F.col("_n") - 1) / size).cast("int"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("block", "post_id"))), lambda x: x["post_id"])
    return placed.groupBy("task").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"), ids.alias("post_ids"))


SCHEMAS = {"post_data": POST_DATA, "vectors": POSTS_VECTORS, "markers": DELETED, "touched": "post_id int"}


@dataclass
class Prepared:
    """pre: (post_id, block_num, token_count) of all posts; chunks: (post_id, chunk_number, chunk_text, token_count, block_num) of those that pass."""

    pre: DataFrame
    chunks: DataFrame


def prepare_chunks(posts: DataFrame, config: Config, tokenizer_path: str | None = None) -> Prepared:
    """posts: (post_id, title, body, block_num). The chunker sees a threshold of 0 and the real one is applied after it,
    so that posts edited below it still drive deletions."""
    text = posts.select("post_id", "block_num", clean(post_text("title", "body")).alias("text"))
    done = chunk_posts(text, "post_id", "text", config.tokens_per_chunk, config.overlap_amount, config.document_prefix, 0, config.max_embeddings_per_post, tokenizer_path)
    pre = done.join(posts.select("post_id", "block_num"), "post_id")
    kept = pre.filter((F.col("token_count") >= config.min_token_threshold) & (F.size("chunks") > 0))
    chunks = kept.select("post_id", F.posexplode("chunks").alias("chunk_number", "chunk_text"), "token_count", "block_num")
    return Prepared(pre.select("post_id", "block_num", F.coalesce("token_count", F.lit(0)).alias("token_count")), chunks)


@dataclass
class Tables:
    post_data: DataFrame
    vectors: DataFrame
    markers: DataFrame


@dataclass
class Change:
    """What a batch does: touched posts (post_id) lose their metadata and vectors and get these; markers are added."""

    touched: DataFrame
    post_data: DataFrame
    vectors: DataFrame
    markers: DataFrame


def applied(now: Tables, change: Change) -> Tables:
    """The tables after a change."""
    without = lambda df: df.join(change.touched, "post_id", "left_anti")
    return Tables(
        without(now.post_data.select("post_id", "number_of_tokens", "last_vectors_block")).unionByName(change.post_data),
        without(now.vectors.select("post_id", "chunk_number", "embedding", "sync_seq")).unionByName(change.vectors),
        now.markers.select("post_id", "sync_seq").unionByName(change.markers).distinct(),
    )


def assign_seqs(pre: DataFrame, with_chunks: DataFrame, start: int) -> DataFrame:
    """(post_id, block_num, token_count, had, sync_seq): one number a post after ``start``, dense and deterministic: empties first, then the others, by post."""
    had = with_chunks.select("post_id").distinct().withColumn("had", F.lit(True))
    flagged = pre.join(had, "post_id", "left").withColumn("had", F.coalesce("had", F.lit(False)))
    # numbers in two steps so that no window sees the whole batch: counts per cell, then ranks within it
    cell = F.floor(F.col("post_id") / 4096)
    counts = flagged.groupBy("had", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("had", "_cell", (F.sum("c").over(W.orderBy("had", "_cell")) - F.col("c")).alias("_before"))
    ranked = flagged.withColumn("_cell", cell).withColumn("_n", F.row_number().over(W.partitionBy("had", "_cell").orderBy("post_id")))
    return ranked.join(before, ["had", "_cell"]).select("post_id", "block_num", "token_count", "had", (F.lit(start) + F.col("_before") + F.col("_n")).cast("int").alias("sync_seq"))


def embedding_change(now: Tables, pre: DataFrame, new_vectors: DataFrame, start: int) -> Change:
    """A batch of posts. pre: (post_id, block_num, token_count); new_vectors: (post_id, chunk_number, embedding).

    Posts without chunks lose their vectors and get a marker with a number of their own; for the others the rows are
    replaced, and a marker under the same number says that there were rows before. A repeated batch replaces its own result.
    """
    numbered = assign_seqs(pre, new_vectors, start)
    rows = new_vectors.join(numbered.select("post_id", "sync_seq"), "post_id").select("post_id", "chunk_number", "embedding", "sync_seq")
    empty = numbered.filter("not had").select("post_id", "sync_seq")
    changed = numbered.filter("had").join(now.vectors.select("post_id"), "post_id", "left_semi").select("post_id", "sync_seq")
    data = numbered.select("post_id", F.col("token_count").alias("number_of_tokens"), F.col("block_num").alias("last_vectors_block"))
    return Change(numbered.select("post_id"), data, rows, empty.unionByName(changed))


def store_embeddings(now: Tables, pre: DataFrame, new_vectors: DataFrame, start: int) -> Tables:
    """New tables after ``embedding_change``."""
    return applied(now, embedding_change(now, pre, new_vectors, start))


def batch_stats(pre: DataFrame, chunks: DataFrame) -> DataFrame:
    """(discarded_posts, processed_posts, embedding_chunks, total_tokens)"""
    had = chunks.select("post_id").distinct().withColumn("had", F.lit(True))
    flags = pre.join(had, "post_id", "left")
    some = flags.agg(
        F.count_if(F.col("had").isNull()).cast("int").alias("discarded_posts"), F.count_if("had").cast("int").alias("processed_posts"),
        F.coalesce(F.sum(F.when(F.col("had"), F.col("token_count"))), F.lit(0)).cast("int").alias("total_tokens"),
    )
    return some.join(F.broadcast(chunks.agg(F.count(F.lit(1)).cast("int").alias("embedding_chunks"))), F.lit(True)).select("discarded_posts", "processed_posts", "embedding_chunks", "total_tokens")


def visible_seq(vectors: DataFrame, markers: DataFrame) -> DataFrame:
    """One row: the highest number stored anywhere, 0 for an empty store."""
    top = vectors.agg(F.max("sync_seq").alias("m")).unionByName(markers.agg(F.max("sync_seq").alias("m")))
    return top.agg(F.coalesce(F.max("m"), F.lit(0)).cast("int").alias("max_visible_sync_seq"))


@dataclass(frozen=True)
class Status:
    """The mutable part of a node: where it stands. Written last, so what it names is complete.

    runs: (number, bytes) of the live runs, oldest first. feed_seq, inserts, deletes: what has been applied of a feed.
    """

    version: int = 0
    runs: tuple[tuple[int, int], ...] = ()
    feed_seq: int = 0
    inserts: int = 0
    deletes: int = 0
    max_visible_sync_seq: int = 0
    last_block: int = 0
    sync_uuid: str = ""
    skipped_op_count: int = 0
    upstream_skipped_op_count: int = 0
    continue_processing: bool = True
    schema_hash: str = ""
    runtime_hash: str = ""


NAMES = ("post_data", "vectors", "markers", "touched")
MAX_RUNS = 12
RATIO = 2  # an older run joins a merge of newer ones up to this multiple of their size
KEPT = 5  # versions whose runs stay for readers that are still at work


class Store:
    """Runs below a shared folder, {post_data,vectors,markers,touched}/run=<N>, and status files of which the last names the live ones.

    One writer at a time. max_runs: more live runs than that are merged after a write.
    """

    def __init__(self, spark: SparkSession, path: str, max_runs: int = MAX_RUNS):
        self.spark, self.path, self.max_runs = spark, path.rstrip("/"), max_runs
        self.files = SharedFiles(spark, self.path)

    def _read_status(self, name: str) -> Status:
        held = json.loads(self.files.read(f"status/{name}"))
        return Status(**{**held, "runs": tuple((n, size) for n, size in held["runs"])})

    def status(self) -> Status:
        names = [n for n in self.files.names("status") if n.endswith(".json")]
        return self._read_status(names[-1]) if names else Status()

    def _publish(self, status: Status) -> Status:
        names = [n for n in self.files.names("status") if n.endswith(".json")]
        number = int(names[-1][:-5]) + 1 if names else 0
        self.files.write(f"status/{number:09d}.json", json.dumps(asdict(status)))
        for old in names[: 1 - KEPT]:
            self.files.delete(f"status/{old}")
        kept = {n for s in [*names[1 - KEPT :], f"{number:09d}.json"] for n, _ in self._read_status(s).runs}
        for name in NAMES:
            for folder in self.files.names(name):
                if folder.startswith("run=") and int(folder[4:]) not in kept:
                    self.files.delete(f"{name}/{folder}")
        return status

    def update(self, **changes: Any) -> Status:
        return self._publish(replace(self.status(), **changes))

    def _rows(self, name: str, runs: Sequence[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{SCHEMAS[name]}, run int").parquet(*[f"{self.path}/{name}/run={n}" for n in runs])

    def _visible(self, runs: Sequence[int]) -> Change:
        """What the runs come to together: rows of the last run that touches their post, and all that they touch."""
        later = self._rows("touched", runs)
        last = later.groupBy("post_id").agg(F.max("run").alias("_last"))
        live = lambda df: df.join(last, "post_id", "left").filter(F.col("_last").isNull() | (F.col("run") >= F.col("_last"))).drop("run", "_last")
        one = len(runs) == 1
        data, vectors = self._rows("post_data", runs), self._rows("vectors", runs)
        return Change(later.select("post_id").distinct(), data.drop("run") if one else live(data), vectors.drop("run") if one else live(vectors), self._rows("markers", runs).select("post_id", "sync_seq").distinct())

    def tables(self) -> Tables:
        runs = [n for n, _ in self.status().runs]
        if not runs:
            empty = lambda ddl: self.spark.createDataFrame([], ddl)
            return Tables(empty(POST_DATA), empty(POSTS_VECTORS), empty(DELETED))
        now = self._visible(runs)
        return Tables(now.post_data, now.vectors, now.markers)

    def _write_run(self, number: int, change: Change) -> tuple[int, int]:
        """Rows sorted by sync_seq, so that a page of the feed reads few row groups."""
        sort = {"vectors": ["sync_seq", "post_id", "chunk_number"], "markers": ["sync_seq"]}
        for name in NAMES:
            df = getattr(change, name)
            if name in sort:
                df = df.repartitionByRange(F.col("sync_seq")).sortWithinPartitions(*sort[name])
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/run={number}")
        return number, self.files.size(f"vectors/run={number}")

    def _commit(self, change: Change, older: Sequence[tuple[int, int]], **status: Any) -> Status:
        now = self.status()
        number = now.version + 1
        run = self._write_run(number, change)
        top = visible_seq(self._rows("vectors", [number]), self._rows("markers", [number])).collect()[0][0]
        seq = max(top, now.max_visible_sync_seq, status.pop("max_visible_sync_seq", 0))
        return self._publish(replace(now, version=number, runs=(*older, run), max_visible_sync_seq=seq, **status))

    def write(self, tables: Tables, **status: Any) -> Status:
        """Replaces the whole content."""
        nothing = self.spark.createDataFrame([], "post_id int")
        return self._commit(Change(nothing, tables.post_data, tables.vectors, tables.markers), (), **status)

    def append(self, change: Change, **status: Any) -> Status:
        """Adds a change as a run; writes in proportion to it."""
        self._commit(change, self.status().runs, **status)
        self.tidy()
        return self.status()

    def tidy(self) -> bool:
        """With more than max_runs live runs, the newest are merged, and with them every older one of at most RATIO times
        their size: each row is so rewritten about log(size) times."""
        runs = self.status().runs
        if len(runs) <= self.max_runs:
            return False
        at = self.max_runs - 1
        while at and runs[at - 1][1] <= RATIO * sum(size for _, size in runs[at:]):
            at -= 1
        merged = self._visible([n for n, _ in runs[at:]])
        if at == 0:
            merged.touched = merged.touched.limit(0)  # nothing older is left to be passed over
        self._commit(merged, runs[:at])
        return True

    def ingest(self, posts: DataFrame, config: Config, embed: Embedder, last_block: int, tokenizer_path: str | None = None) -> Status:
        """A batch of posts (post_id, title, body, block_num): prepare, embed, store, publish.

        The vectors are written once before numbers are given, so a retried task can't embed twice into one snapshot.
        """
        from ..session import settle

        prepared = prepare_chunks(posts, config, tokenizer_path)
        pre = settle(prepared.pre, "pre")
        vectors = embed_texts(prepared.chunks, "chunk_text", embed).select("post_id", "chunk_number", "embedding")
        vectors = settle(to_half(vectors, "embedding") if config.store_half else vectors, "vectors")
        status = self.status()
        return self.append(embedding_change(self.tables(), pre, vectors, status.max_visible_sync_seq), last_block=max(last_block, status.last_block))

    def identity(self, fresh: str) -> str:
        """The node's uuid: kept if there is one, else the fresh one."""
        now = self.status()
        return now.sync_uuid or self._publish(replace(now, sync_uuid=fresh)).sync_uuid


def stage(current_block: int, head_block: int, near: int = 100) -> str:
    """massive while far behind the head, live at it."""
    return "live" if head_block - current_block <= near else "massive"


def must_stop(status: Status, current_block: int, stop_at: int | None, stage_wanted: str | None = None, stage_now: str | None = None) -> str | None:
    """Why processing must pause before the next range, if it must."""
    if not status.continue_processing:
        return "stop requested"
    if stop_at is not None and current_block >= stop_at:
        return "block limit reached"
    if stage_wanted and stage_now and stage_wanted != stage_now:
        return "stage changed"
    return None


def block_ranges(first: int, last: int, size: int = 1000) -> list[tuple[int, int]]:
    return [(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]
