"""Rebase of a node's regenerated vectors onto the history of an older chain.

The older chain comes as dumps by name. They are resolved to local posts, compared with the local vectors, and merged:
untouched posts keep their old rows and numbers, changed ones get consecutive numbers behind the old tail. A small state object
enforces the order of the steps; the swap is the store's pointer file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import Config
from ..functions.vectors import cosine_distance, from_text
from ..session import SharedFiles
from .search import root_post
from .store import Store, Tables

# The phases of a rebase, in order.
PHASES = ("staging", "resolved", "diffed", "tables_built", "indexes_built", "swapped", "cleaned")


@dataclass(frozen=True)
class RebaseState:
    phase: str = "staging"
    old_uuid: str | None = None
    old_tail_seq: int | None = None
    old_skipped: int = 0
    old_block: int | None = None
    freeze_block: int | None = None
    merge_count: int = 0

    def expect(self, phase: str) -> None:
        if self.phase != phase:
            raise RuntimeError(f"the rebase is in phase {self.phase}, this step needs {phase}")

    def to(self, phase: str, **changes: object) -> RebaseState:
        if PHASES.index(phase) < PHASES.index(self.phase):
            raise RuntimeError(f"the rebase can't go back from {self.phase} to {phase}")
        return replace(self, phase=phase, **changes)

    def identity(self, uuid: str, tail: int, skipped: int, block: int) -> RebaseState:
        """Who the old chain is; only while its dumps are staged or later resolved, never after the merge."""
        if PHASES.index(self.phase) >= PHASES.index("tables_built"):
            raise RuntimeError("the old identity can't change after the merge")
        return replace(self, old_uuid=uuid, old_tail_seq=tail, old_skipped=skipped, old_block=block)


@dataclass
class Dump:
    """The old chain by name: vectors (embedding as text), delete markers, metadata, root posts."""

    vectors: DataFrame
    deleted: DataFrame
    post_data: DataFrame
    root_posts: DataFrame


@dataclass
class Old:
    """The old chain by local post id."""

    names: DataFrame
    unresolved: DataFrame
    vectors: DataFrame
    deleted: DataFrame
    post_data: DataFrame


def prefer_live(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the posts of one name the live one with the highest id, else the deleted one with the highest id."""
    best = rows.groupBy(*by).agg(F.max(F.struct((F.col("counter_deleted") == 0).alias("live"), F.col("id").alias("id"))).alias("b"))
    return best.select(*by, F.col("b.id").alias("post_id"))


def all_names(dump: Dump) -> DataFrame:
    """Every name of the four dumps once."""
    some = None
    for df in (dump.vectors, dump.deleted, dump.post_data, dump.root_posts):
        n = df.select("author", "permlink")
        some = n if some is None else some.union(n)
    return some.distinct()


def resolve(dump: Dump, posts: DataFrame, accounts: DataFrame, permlinks: DataFrame) -> Old:
    named = (
        posts.join(accounts.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id")
        .join(permlinks.select(F.col("id").alias("permlink_id"), "permlink"), "permlink_id")
    )
    names = all_names(dump).join(prefer_live(named, ["author", "permlink"]), ["author", "permlink"], "left")
    had = dump.vectors.select("author", "permlink").distinct().withColumn("had_vectors", F.lit(True))
    lost = names.filter("post_id is null").select("author", "permlink").join(had, ["author", "permlink"], "left").withColumn("had_vectors", F.coalesce("had_vectors", F.lit(False)))
    found = names.filter("post_id is not null")
    by = ["author", "permlink"]
    return Old(
        names, lost,
        dump.vectors.join(found, by).select("post_id", "chunk_number", from_text("embedding").cast("array<float>").alias("embedding"), "sync_seq"),
        dump.deleted.join(found, by).select("post_id", "sync_seq"),
        dump.post_data.join(found, by).select("post_id", "number_of_tokens", "last_vectors_block"),
    )


def resolve_metrics(dump: Dump, old: Old, posts: DataFrame, accounts: DataFrame, permlinks: DataFrame, freeze_block: int) -> DataFrame:
    """(metric, n): eight counts; new_root_posts_missing_in_old is null when no root posts were dumped."""
    lost = old.names.filter("post_id is null").select("author", "permlink")
    by = ["author", "permlink"]
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    here = (
        posts.filter(root_post() & (F.col("counter_deleted") == 0) & (F.col("block_num_created") <= freeze_block))
        .join(accounts.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id")
        .join(permlinks.select(F.col("id").alias("permlink_id"), "permlink"), "permlink_id")
    )
    missing = here.join(dump.root_posts.select(*by).distinct(), by, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    listed = dump.root_posts.agg(F.count(F.lit(1)).alias("c"))
    parts = [  # fixed values: names of the counts
        one("old_vector_rows", dump.vectors),
        one("old_vector_rows_resolved", old.vectors),
        dump.vectors.agg(F.countDistinct("author", "permlink").alias("n")).select(F.lit("old_posts_with_vectors").alias("metric"), "n"),
        one("old_posts_with_vectors_unresolved", old.unresolved.filter("had_vectors")),
        one("old_delete_markers_unresolved", dump.deleted.join(lost, by, "left_semi")),
        one("old_root_posts", dump.root_posts),
        one("old_root_posts_missing_here", dump.root_posts.join(lost, by, "left_semi")),
        missing.join(F.broadcast(listed), F.lit(True)).select(F.lit("new_root_posts_missing_in_old").alias("metric"), F.when(F.col("c") > 0, F.col("n")).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunk_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(post_id, chunk_number, dist) of posts with equal chunk counts on both sides; dist is null where the chunk is absent here."""
    n = lambda df, name: df.groupBy("post_id").agg(F.count(F.lit(1)).alias(name))
    equal = n(old, "o").join(n(new, "n"), "post_id").filter("o = n").select("post_id")
    a = old.join(equal, "post_id", "left_semi").select("post_id", "chunk_number", F.col("embedding").alias("va"))
    b = new.select("post_id", "chunk_number", F.col("embedding").alias("vb"), F.lit(True).alias("here"))
    return a.join(b, ["post_id", "chunk_number"], "left").select("post_id", "chunk_number", F.when(F.col("here"), F.round(cosine_distance("va", "vb"), 9)).alias("dist"))


def merge_set(old: DataFrame, new: DataFrame, far: float = 0.001) -> DataFrame:
    """(post_id, reason): gone, new, or rechunked (another count, a chunk absent, or a distance above ``far``)."""
    n = lambda df, name: df.groupBy("post_id").agg(F.count(F.lit(1)).alias(name))
    counts = n(old, "o").join(n(new, "n"), "post_id", "full")
    reason = F.when(F.col("n").isNull(), "gone").when(F.col("o").isNull(), "new").when(F.col("o") != F.col("n"), "rechunked")
    plain = counts.select("post_id", reason.alias("reason")).filter("reason is not null")
    moved = chunk_pairs(old, new).filter(F.col("dist").isNull() | (F.col("dist") > far)).select("post_id").distinct()
    return plain.unionByName(moved.withColumn("reason", F.lit("rechunked")))


# Bucket names and upper bounds of the distance histogram.
BUCKETS = (("1 <= 1e-6", 1e-6), ("2 <= 1e-5", 1e-5), ("3 <= 1e-4", 1e-4), ("4 <= 1e-3", 1e-3), ("5 <= 1e-2", 1e-2), ("6 <= 1e-1", 1e-1))


def histogram(pairs: DataFrame) -> DataFrame:
    """(bucket, chunk_pairs) by distance, bounds included."""
    bucket: Column = F.when(F.col("dist").isNull(), "0 chunk missing")
    for name, upper in BUCKETS:
        bucket = bucket.when(F.col("dist") <= upper, name)
    return pairs.groupBy(bucket.otherwise("7 > 1e-1").alias("bucket")).agg(F.count(F.lit(1)).alias("chunk_pairs"))


def diff_counts(old: DataFrame, merged: DataFrame) -> DataFrame:
    """(reason, posts): a row per reason, ``total``, and ``unchanged`` old posts (another population, so no rollup)."""
    total = merged.agg(F.count(F.lit(1)).alias("posts")).select(F.lit("total").alias("reason"), "posts")
    same = old.select("post_id").distinct().join(merged.select("post_id"), "post_id", "left_anti").agg(F.count(F.lit(1)).alias("posts")).select(F.lit("unchanged").alias("reason"), "posts")
    return merged.groupBy("reason").agg(F.count(F.lit(1)).alias("posts")).unionByName(total).unionByName(same)


def merge_seqs(merged: DataFrame, tail: int) -> DataFrame:
    """(post_id, reason, sync_seq): consecutive numbers behind the tail in post order.

    Counts per cell of post ids give each cell its first number, so no window sees the whole set.
    """
    cell = F.floor(F.col("post_id") / 4096)
    counts = merged.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("_cell", (F.sum("c").over(W.orderBy("_cell")) - F.col("c")).alias("_before"))
    ranked = merged.withColumn("_cell", cell).withColumn("_n", F.row_number().over(W.partitionBy("_cell").orderBy("post_id")))
    return ranked.join(before, "_cell").select("post_id", "reason", (F.lit(tail) + F.col("_before") + F.col("_n")).cast("int").alias("sync_seq"))


def guard(state: RebaseState, old: Old, config: Config) -> None:
    """Refuses a merge without identity, in the projected mode, or with a tail below the dump."""
    if state.old_uuid is None or state.old_tail_seq is None:
        raise RuntimeError("the identity of the old chain isn't set")
    if config.reduction_mode == "pca":
        raise RuntimeError("a rebase doesn't support projected vectors: they would have to be rebuilt")
    top = old.vectors.agg(F.max("sync_seq").alias("m")).unionByName(old.deleted.agg(F.max("sync_seq").alias("m"))).agg(F.max("m").alias("m")).collect()[0].m or 0
    if state.old_tail_seq < top:
        raise RuntimeError(f"the tail {state.old_tail_seq} is below the dump's highest sync_seq {top}: the dump is newer than its status line")


def build_merged(old: Old, now: Tables, seqs: DataFrame, freeze_block: int | None) -> Tables:
    """The merged tables. Metadata prefers local rows, then old ones, then a stub; every referenced post gets a row."""
    ids = seqs.select("post_id")
    keep = old.post_data.join(ids, "post_id", "left_anti").select("post_id", "number_of_tokens", "last_vectors_block")
    mine = now.post_data.select("post_id", F.col("number_of_tokens").alias("t1"), F.col("last_vectors_block").alias("b1"))
    theirs = old.post_data.select("post_id", F.col("number_of_tokens").alias("t2"), F.col("last_vectors_block").alias("b2"))
    changed = ids.join(mine, "post_id", "left").join(theirs, "post_id", "left").select(
        "post_id", F.coalesce("t1", "t2", F.lit(0)).alias("number_of_tokens"), F.coalesce("b1", "b2", F.lit(-1 if freeze_block is None else freeze_block)).alias("last_vectors_block")
    )
    data = keep.unionByName(changed)
    vectors = old.vectors.join(ids, "post_id", "left_anti").select("post_id", "chunk_number", "embedding", "sync_seq").unionByName(
        now.vectors.drop("sync_seq").join(seqs.select("post_id", "sync_seq"), "post_id").select("post_id", "chunk_number", "embedding", "sync_seq")
    )
    markers = old.deleted.select("post_id", "sync_seq").unionByName(seqs.filter(F.col("reason").isin("gone", "rechunked")).select("post_id", "sync_seq"))
    named = vectors.select("post_id").union(markers.select("post_id")).distinct()
    stubs = named.join(data.select("post_id"), "post_id", "left_anti").select("post_id", F.lit(0).alias("number_of_tokens"), F.lit(-1).alias("last_vectors_block"))
    return Tables(data.unionByName(stubs), vectors, markers)


def merge_metrics(tables: Tables, seqs: DataFrame, tail: int) -> DataFrame:
    """(metric, n) of the merge."""
    one = lambda name, col, df: df.agg(col.cast("long").alias("n")).select(F.lit(name).alias("metric"), "n")
    count = F.count(F.lit(1))
    parts = [
        one("merge_ops", count, seqs), one("first_merge_seq", F.lit(tail + 1) + count * 0, seqs), one("last_merge_seq", F.lit(tail) + count, seqs),
        one("merged_vector_rows", count, tables.vectors), one("merged_posts_with_vectors", F.countDistinct("post_id"), tables.vectors),
        one("merged_delete_markers", count, tables.markers), one("merged_post_data_rows", count, tables.post_data),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_unique(tables: Tables) -> None:
    """The keys that the merged tables must keep."""
    for name, df, key in (("post_data", tables.post_data, ["post_id"]), ("vectors", tables.vectors, ["post_id", "chunk_number"]), ("markers", tables.markers, ["sync_seq"])):
        if df.groupBy(*key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"merged {name} repeats a key {key}")


def swap(store: Store, tables: Tables, state: RebaseState) -> RebaseState:
    """Publishes the merged tables under the old chain's identity by replacing the pointer."""
    state.expect("indexes_built")
    store.write(tables, sync_uuid=state.old_uuid, skipped_op_count=state.old_skipped, upstream_skipped_op_count=0)
    store.update(max_visible_sync_seq=state.old_tail_seq + state.merge_count)
    return state.to("swapped")


def verify(ops: DataFrame, seqs: DataFrame, old: Old, tables: Tables, state: RebaseState, sync_uuid: str, max_visible: int, first_chain: str | None = None, beyond: int = 0, found: int | None = None) -> list[tuple[str, bool, str]]:
    """(check, ok, detail).

    identity: the node has the old uuid; visible, head: it shows the sequence up to old tail and merge operations, and stands there;
    count, dense, kinds: what it serves behind the old tail are the merge operations, numbered without a gap, each of the
    kind its reason asks for; end: nothing comes after them; posts: as many posts with vectors as follow from the old ones; chain: the
    old uuid leads the list; search: the merged table can be searched. ops: (sync_seq, post_id, op) served behind the
    old tail; beyond: operations served after the last; found: rows a search returns.
    """
    expected = state.old_tail_seq + state.merge_count
    m = ops.agg(F.count(F.lit(1)).alias("n"), F.min("sync_seq").alias("a"), F.max("sync_seq").alias("z"), F.countDistinct("sync_seq").alias("d")).collect()[0]
    kind = F.create_map(F.lit("gone"), F.lit("delete"), F.lit("new"), F.lit("insert"), F.lit("rechunked"), F.lit("update"))
    fit = ops.join(seqs, ["post_id", "sync_seq"]).filter(F.col("op") == kind[F.col("reason")]).count()
    was = old.vectors.select("post_id").distinct()
    want = was.subtract(seqs.filter("reason = 'gone'").select("post_id")).union(seqs.filter("reason = 'new'").select("post_id")).distinct().count()
    have = tables.vectors.select("post_id").distinct().count()
    n = state.merge_count
    dense = n == 0 or (m.a == state.old_tail_seq + 1 and m.z == expected and m.d == n)
    return [
        ("identity", sync_uuid == state.old_uuid, str(sync_uuid)),
        ("visible", max_visible == expected, f"{max_visible} of {expected}"),
        ("head", max_visible >= expected, str(max_visible)),
        ("count", m.n == n, f"{m.n} of {n}"),
        ("dense", dense, f"{m.a} to {m.z}"),
        ("kinds", fit == n, f"{fit} of {n}"),
        ("end", beyond == 0, str(beyond)),
        ("posts", want == have, f"{have} of {want}"),
        ("chain", first_chain in (None, state.old_uuid), str(first_chain)),
        ("search", found is None or found >= 1, str(found)),
    ]


def cleanup(store: Store, state: RebaseState, staging: Sequence[str]) -> RebaseState:
    """Removes what the rebase staged (paths of folders) once the swapped tables have proven themselves."""
    state.expect("swapped")
    for path in staging:
        SharedFiles(store.spark, path).delete("")
    return state.to("cleaned")
