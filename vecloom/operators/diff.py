"""Differences between two copies of a data set.

Both sides are keyed; the 64-bit hashes of the keys span one common key space, which a tree of ranges divides, down to
leaves of a few dozen rows whatever the size. Every leaf has an additive checksum a side, and as checksums add up, those of all
ranges above follow from them. The tree is walked from the top: only the parts of a range whose checksums
differ are looked at on the next level, and only rows in the mismatched leaves are compared, first by hashes of their
fields and then by the fields themselves. Long fields stay where they are until a single row of them is needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import additive, name_of, row_hash
from ..functions.vectors import as_double, dot, from_text, norm, usable
from ..session import settle

FAN = 8  # bits of the key space that one level of the tree divides
PER_LEAF = 32  # rows
BROADCAST = 100_000  # rows of keys and hashes, some 20 MB
#: fields: name -> (canonical column that enters the checksums, test of two values that says they differ; none: unequal canonical values do)
Fields = dict[str, tuple[Column, Callable[[Column, Column], Column] | None]]


def node(bits: int) -> Column:
    """The range of the key space with 2**bits ranges that holds a row."""
    return F.shiftrightunsigned(F.col("_key"), 64 - bits)


def leaf_sums(old: DataFrame, new: DataFrame, bits: int) -> DataFrame:
    """(leaf, old, new): the checksums of both sides of each leaf that has rows, null for a side without any there."""
    sums = []
    for side, other, df in (("old", "new", old), ("new", "old", new)):
        one = df.groupBy(node(bits).alias("leaf")).agg(*additive(F.col("_row"))).select("leaf", F.struct("n", "lo", "hi").alias(side))
        sums.append(one.withColumn(other, F.lit(None).cast(one.schema[side].dataType)))
    both = sums[0].unionByName(sums[1])
    return both.groupBy("leaf").agg(*[F.max(side).alias(side) for side in ("old", "new")])  # a leaf is in each side once


def mismatched(sums: DataFrame, bits: int, fan: int = FAN) -> DataFrame:
    """(leaf): leaves whose checksums differ, found by dividing mismatched ranges level by level."""
    found, above = None, 0
    for at in [*range(fan, bits, fan), bits]:
        rows = sums.withColumn("node", F.shiftrightunsigned("leaf", bits - at))
        if found is not None:
            rows = rows.withColumn("parent", F.shiftrightunsigned("node", at - above)).join(found.withColumnRenamed("node", "parent"), "parent", "left_semi")
        total = rows.groupBy("node").agg(*[F.sum(f"{side}.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in ("n", "lo", "hi")])
        differ = [~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in ("n", "lo", "hi")]
        found = total.filter(differ[0] | differ[1] | differ[2]).select("node")
        above = at
    return found.withColumnRenamed("node", "leaf")


def differences(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Fields, fetch: Callable[[str, DataFrame], DataFrame] | None = None, per_leaf: int = PER_LEAF) -> DataFrame:
    """One row per key missing on a side (``only_old``, ``only_new``) and per differing field (its name).

    Equal canonical values must imply that the test of a field is false; a null one is a missing value, which differs
    from any other without a test. Keys must be unique on each side and not null. Two empty sides have no differences.
    fetch: gets "old" or "new" and rows of that side (all its columns) whose canonical values differ, and gives back keys and the
    tested fields; a row may come several times. Without it the sides hold the tested fields themselves.

    Both prepared sides are written to the shared folder, since sums and comparison read them; with ``fetch`` they are narrow.
    """
    sides = []
    for name, df in (("old", old), ("new", new)):
        canon = {f"_c_{f}": F.when(c.isNotNull(), row_hash(c)) for f, (c, _) in fields.items()}
        side = df.withColumns({"_key": row_hash(*keys), **canon})
        sides.append(settle(side.withColumn("_row", row_hash("_key", *canon)), f"diff-{name}"))
    size = max(s.count() for s in sides)
    bits = min(48, max(1, math.ceil(math.log2(max(1, size / per_leaf)))))
    sums = settle(leaf_sums(*sides, bits), "diff-sums")  # about size / per_leaf rows
    leaf = settle(mismatched(sums, bits), "diff-leaves")
    if 2 * leaf.count() <= sums.count():  # where most leaves differ, going through them saves nothing
        sides = [s.withColumn("leaf", node(bits)).join(leaf, "leaf", "left_semi").drop("leaf") for s in sides]
    a, b = (s.withColumn("_in", F.lit(True)).alias(n) for s, n in zip(sides, "ab"))
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("_key", *keys)], "full").filter(~F.col("a._row").eqNullSafe(F.col("b._row")))
    here = F.col("a._in") & F.col("b._in")
    differs = {f: here & ~F.col(f"a._c_{f}").eqNullSafe(F.col(f"b._c_{f}")) for f in fields}
    missing = {f: F.col(f"a._c_{f}").isNull() | F.col(f"b._c_{f}").isNull() for f in fields}
    tested = [f for f, (_, test) in fields.items() if test is not None]
    deep = tested if fetch else []
    what = [F.when(F.col("b._in").isNull(), F.lit("only_old")), F.when(F.col("a._in").isNull(), F.lit("only_new"))]
    for f, (_, test) in fields.items():
        if f in deep:
            what.append(F.when(differs[f] & missing[f], F.lit(f)))
        else:
            what.append(F.when(differs[f] & ((missing[f] | test(F.col(f"a.{f}"), F.col(f"b.{f}"))) if test else F.lit(True)), F.lit(f)))
    some = lambda cols: F.explode(F.filter(F.array(*cols), lambda x: x.isNotNull())).alias("what")
    if not deep:
        return both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], some(what))
    columns = lambda side, df: F.when(F.col(f"{side}._in"), F.struct(*[F.col(f"{side}.{c}").alias(c) for c in df.columns])).alias(f"_{side}")
    again = F.coalesce(F.array_contains(F.array(*[differs[f] & ~missing[f] for f in deep]), True), F.lit(False)).alias("_again")
    rows = settle(both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], F.array(*what).alias("_what"), again, columns("a", old), columns("b", new)), "diff-rows")
    first = rows.select(*keys, F.explode(F.filter("_what", lambda x: x.isNotNull())).alias("what"))
    open_ = rows.filter("_again")
    small = open_.count() <= BROADCAST  # counted, so the bound is proven; beyond it both sides are shuffled
    held = lambda df: F.broadcast(df) if small else df
    x, y = (fetch(name, held(open_.select(f"_{side}.*"))).alias(side) for name, side in (("old", "a"), ("new", "b")))
    pairs = x.join(y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    second = pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], some([F.when(fields[f][1](F.col(f"a.{f}"), F.col(f"b.{f}")), F.lit(f)) for f in deep])).distinct()
    return first.unionByName(second)


# -- vectors under names -------------------------------------------------------------------------------------
def post_of_name(posts: DataFrame, accounts: DataFrame, permlinks: DataFrame) -> DataFrame:
    """(author, permlink, post_id): the post a name stands for, live before deleted, then the highest id."""
    best = F.max(F.struct((F.coalesce(F.col("counter_deleted"), F.lit(1)) == 0).alias("live"), F.col("id").alias("id"))).alias("best")
    pairs = posts.groupBy("author_id", "permlink_id").agg(best)
    names = (
        pairs.join(accounts.select(F.col("id").alias("author_id"), name_of("name").alias("author")), "author_id")
        .join(permlinks.select(F.col("id").alias("permlink_id"), name_of("permlink").alias("permlink")), "permlink_id")
    )
    return names.groupBy("author", "permlink").agg(F.max("best").alias("best")).select("author", "permlink", F.col("best.id").alias("post_id"))


def current(rows: DataFrame, keys: Sequence[str], seq: str = "sync_seq", top: DataFrame | None = None) -> DataFrame:
    """Rows with the highest seq of their key, looked up in ``top`` where rows are only some of its rows.

    The maximum is combined map-side, so a hot key costs no window.
    """
    top = (rows if top is None else top).groupBy(*keys).agg(F.max(seq).alias(seq))
    return rows.join(top, [*keys, seq])


def vector_diff(legacy: DataFrame, vectors: DataFrame, posts: DataFrame, accounts: DataFrame, permlinks: DataFrame, dims: int = 64, far: float = 0.001, per_leaf: int = PER_LEAF) -> DataFrame:
    """(author, permlink, chunk_number, what) between the old copy (vectors as text, by name) and the new one (by post id).

    Names are compared in normal form; of a key repeated with different content the row with the greater sequence, a usable
    vector and the greater hash counts; rows with a null name, chunk or sync_seq are no rows. Unusable vectors
    (absent, wrong width, not numbers, all zero) are equal to each other.

    In the checksums a vector stands for its unit vector in steps of sqrt(1.6 far / dims), small enough that two
    vectors in one cell are always nearer than ``far``, so noise of the text format seldom spoils a range and no
    difference is lost. Which rows are current, and all sums, are worked out on hashes taken while the tables are read;
    vectors are read once more for the rows whose cells differ.
    """
    step = (2 * far * 0.8 / dims) ** 0.5
    keys = ["author", "permlink", "chunk_number"]

    def hashed(rows: DataFrame, vec: Column, *others: str) -> DataFrame:
        """Without the vector: ``cell``, the hash of its cell (null: unusable), and ``exact``, that of its numbers."""
        v = rows.withColumn("_v", vec).withColumn("_v", F.when(usable(F.col("_v"), dims), F.col("_v")))
        width = F.array_repeat(norm(F.col("_v")) * F.lit(step), dims)  # once a row; inside the lambda it would be worked out for every number
        cell = F.zip_with("_v", width, lambda x, w: F.floor(x / w + 0.5))
        return v.select(*others, "chunk_number", F.col("sync_seq").cast("long").alias("sync_seq"), F.when(F.col("_v").isNotNull(), F.xxhash64(cell)).alias("cell"), F.xxhash64("_v").alias("exact"))

    def one(rows: DataFrame, *others: str) -> DataFrame:
        m = F.max(F.struct("sync_seq", F.col("cell").isNotNull().alias("u"), "exact", "cell", *others)).alias("m")
        return rows.groupBy(*keys, "sync_seq").agg(m).select(*keys, *[f"m.{c}" for c in ("sync_seq", "exact", "cell", *others)])

    names = post_of_name(posts, accounts, permlinks)
    texts = legacy.select(name_of("author").alias("author"), name_of("permlink").alias("permlink"), "chunk_number", "embedding", "sync_seq").na.drop(subset=[*keys, "sync_seq"])
    arrays = vectors.select("post_id", "chunk_number", "embedding", "sync_seq").na.drop(subset=["post_id", "chunk_number", "sync_seq"])
    old = one(current(hashed(texts, from_text("embedding"), "author", "permlink"), ["author", "permlink"]))
    new = one(current(hashed(arrays, as_double("embedding"), "post_id"), ["post_id"]).join(names, "post_id"), "post_id")

    def fetch(side: str, rows: DataFrame) -> DataFrame:
        source, on, vec = (texts, keys, from_text("embedding")) if side == "old" else (arrays, ["post_id", "chunk_number"], as_double("embedding"))
        found = source.withColumn("sync_seq", F.col("sync_seq").cast("long")).join(rows, [*on, "sync_seq"])
        return found.withColumn("embedding", vec).filter(F.xxhash64("embedding") == F.col("exact")).select(*keys, "embedding")

    def far_apart(a: Column, b: Column) -> Column:
        return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b)) > far

    return differences(old, new, keys, {"sync_seq": (F.col("sync_seq"), None), "embedding": (F.col("cell"), far_apart)}, fetch, per_leaf)
