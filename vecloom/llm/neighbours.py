"""Most similar vectors for every vector, by cross-polytope hashing.

Exact copies are collapsed to classes first. A unit vector is pseudo-rotated (three rounds of random signs and a
fast Hadamard transform) and hashed to the nearest signed axis; each of a few independent tables holds it in that bucket and is
probed in the bucket of the second nearest axis as well. A bucket too large is compared in blocks, so none is capped. One so
large that blocks would cost more copies is divided by a few independent further hashes, each probed in the same two axes, so
that a pair of the bucket meets in one of the parts about as surely as a pair meets in one of the tables. In a bucket 4-bit sketches with a known error select candidates
without losing a pair; only those are reranked with the whole vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.diff import current
from ..session import settle

LEVELS = 5  # hashes a bucket code holds at most; how deep a bucket is divided follows from its size
SUBS = 4  # independent divisions of a bucket
SHRINK = 2  # times that division must lessen the comparisons within a bucket
DIVIDE = 2 * SUBS  # blocks a row is copied to at most before division, which makes 2 * SUBS copies, is cheaper


class Buckets:
    """A set of buckets (table, code) with a number each, held as sorted arrays: looked up a block of codes at a time."""

    def __init__(self, found: dict[tuple[int, int], int] | None = None):
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_table: dict[int, list[tuple[int, int]]] = {}
        for (t, code), n in (found or {}).items():
            by_table.setdefault(t, []).append((code, n))
        for t, pairs in by_table.items():
            codes, numbers = np.array(sorted(pairs), np.int64).T
            self.held[t] = codes.copy(), numbers.copy()

    def __bool__(self) -> bool:
        return bool(self.held)

    def get(self, table: int, code: np.ndarray, default: int) -> np.ndarray:
        """The number of each code's bucket, or the default where it isn't in the set."""
        if table not in self.held:
            return np.full(len(code), default, np.int64)
        codes, numbers = self.held[table]
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where(codes[at] == code, numbers[at], default)


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(np.float32(n))


class CrossPolytope:
    """tables x LEVELS x SUBS pseudo-rotations. The transform of a block of rows is one product with the Hadamard matrix a round."""

    def __init__(self, dims: int, tables: int, seed: int = 7):
        self.dims, self.tables = dims, tables
        self.width = 1 << max(1, (dims - 1).bit_length())
        rng = np.random.default_rng(seed)
        draw = lambda levels: rng.choice(np.array([-1, 1], np.float32), (SUBS, tables, levels, 3, self.width))
        self.signs = np.concatenate([draw(3), draw(max(0, LEVELS - 3))], axis=2)  # deeper levels change nothing in the first
        self.h = _hadamard(self.width)

    def axes(self, unit: np.ndarray, table: int, level: int, second: bool = False, sub: int = 0) -> np.ndarray:
        """Nearest signed axis of each row, or the second nearest."""
        x = unit
        if self.width > self.dims:
            x = np.pad(x, ((0, 0), (0, self.width - self.dims)))
        for round_ in range(3):
            x = (x * self.signs[sub, table, level, round_]) @ self.h
        size = np.abs(x)
        best = size.argmax(1)
        if second:
            size[np.arange(len(x)), best] = -1
            best = size.argmax(1)
        return (best + self.width * (x[np.arange(len(x)), best] < 0)).astype(np.int64)

    def paths(self, unit: np.ndarray, table: int, divided: list[Buckets], probe: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
        """(rows, bucket codes, depth, home) of one table; probe: also where a hash takes the second nearest axis.

        divided: the buckets of each level that are divided. A row goes on into all SUBS divisions of its bucket.
        """

        def step(rows: np.ndarray, code: np.ndarray, level: int, home: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
            deeper = divided[level].get(table, code, 0) > 0 if level < len(divided) else np.zeros(len(code), bool)
            if not deeper.all():
                yield rows[~deeper], code[~deeper], level, home
            if deeper.any():
                rows, code = rows[deeper], code[deeper]
                for sub in range(SUBS):
                    for second in (False, True)[: 1 + probe]:
                        axis = self.axes(unit[rows], table, level + 1, second, sub)
                        yield from step(rows, (code * SUBS + sub) * (2 * self.width) + axis, level + 1, home and not second)

        for second in (False, True)[: 1 + probe]:
            yield from step(np.arange(len(unit)), self.axes(unit, table, 0, second), 0, not second)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def sketch(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4 bits a number: (packed bytes, step of each row, norm of what the sketch loses)."""
    step = np.abs(unit).max(1) / 8
    q = np.clip(np.floor(unit / step[:, None]) + 8, 0, 15).astype(np.uint8)
    lost = np.sqrt((((q - 7.5) * step[:, None] - unit) ** 2).sum(1))
    if q.shape[1] % 2:
        q = np.pad(q, ((0, 0), (0, 1)))
    return q[:, ::2] << 4 | q[:, 1::2], step.astype(np.float32), (lost + 1e-5).astype(np.float32)


def unsketch(packed: np.ndarray, step: np.ndarray, dims: int) -> np.ndarray:
    q = np.empty((len(packed), packed.shape[1] * 2), np.float32)
    q[:, ::2], q[:, 1::2] = packed >> 4, packed & 15
    return (q[:, :dims] - 7.5) * step[:, None]


def candidates_in_bucket(home: np.ndarray, blk: np.ndarray, ident: np.ndarray, x: np.ndarray, lost: np.ndarray, floor: float, k: int, same: bool, most: int | None, rows: int = 512) -> tuple[np.ndarray, np.ndarray] | None:
    """Index pairs (home row, other row) that may be k-nearest of either with similarity >= floor; none if there are more than ``most``.

    x: vectors or their sketches, lost: what they lose. Similarities are bounded from both sides, so a pair is dropped only if
    it is surely below the floor or surely behind k others of both its rows within the bucket.
    """
    n = len(x)
    norm = np.sqrt((x * x).sum(1))
    left = np.flatnonzero(home)
    j = np.arange(n)
    out_i, out_j, total = [], [], 0
    for at in range(0, len(left), rows):
        i = left[at : at + rows]
        est = x[i] @ x.T
        slack = lost[i][:, None] + norm[i][:, None] * lost[None, :] + np.float32(1e-5)
        ok = est + slack >= floor
        ok &= ~home[None, :] | (j[None, :] > i[:, None])  # each pair of home rows once
        ok &= ident[i][:, None] != ident[None, :]
        if not same:
            ok &= blk[i][:, None] != blk[None, :]  # in a divided bucket only across the two blocks
        a, b = np.nonzero(ok)
        if len(a) > 4 * k * len(i):  # dense: drop what is surely behind k others of both
            e, s = est[a, b], slack[a, b]
            a, b = _front(i[a], b, e - s, e + s, k)
        else:
            a = i[a]
        out_i.append(a)
        out_j.append(b)
        total += len(a)
        if most is not None and total > most:
            return None
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _front(i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keeps pairs that may be among the k first of their row or of their column."""
    keep = np.zeros(len(i), bool)
    for ids in (i, j):
        order = np.lexsort((-low, ids))
        s = ids[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        kth = low[order][first + np.minimum(size, k) - 1]
        kth[size < k] = -2
        keep[order] |= high[order] >= np.repeat(kth, size) - 2e-6
    return i[keep], j[keep]


def classes(rows: DataFrame, vec: str) -> DataFrame:
    """Adds the class of exact copies: 96 bits of hash of the vector."""
    return rows.withColumns({"c1": F.xxhash64(vec), "c2": F.hash(vec)})


def near_classes(reps: DataFrame, raw: DataFrame, dims: int, floor: float, k: int, tables: int, cap: int) -> DataFrame:
    """(a1, a2, b1, b2): candidate pairs of different classes.

    reps: (c1, c2, embedding), one row a class. raw: the same columns, copies included; only the sizes of buckets are
    estimated from it, so that sizing needs no shuffle of vectors.
    """
    cp = CrossPolytope(dims, tables)
    below_one = SUBS * 2 * cp.width

    def count(level: int, divided: list[Buckets]) -> dict[tuple[int, int], int]:
        """Classes in each bucket of a level above the cap; below the first level only in buckets that may be divided."""
        held = raw.sparkSession.sparkContext.broadcast(divided)  # rows / cap buckets a table and level at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit = _unit(_matrix(batch.column(1), dims))
                for t in range(tables):
                    for rows, code, depth, _ in cp.paths(unit, t, held.value, False):
                        if depth == level:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(code), batch.column(0).take(pa.array(rows))], ["t", "code", "c1"])

        got = raw.select("c1", "embedding").mapInArrow(run, "t int, code long, c1 long").groupBy("t", "code").agg(F.approx_count_distinct("c1").alias("n")).filter(F.col("n") > cap)
        return {(r.t, r.code): r.n for r in got.collect()}  # at most tables * SUBS ** level * classes / cap entries

    divided: list[Buckets] = []
    blocks: list[Buckets] = []  # of the buckets above the cap that aren't divided
    over = count(0, [])
    while over:
        big = {b: 1 for b, n in over.items() if n > DIVIDE * cap} if len(divided) + 1 < LEVELS else {}
        parts = count(len(divided) + 1, [*divided, Buckets(big)]) if big else {}
        work = dict.fromkeys(big, 0)
        for (t, code), n in parts.items():
            if (t, code // below_one) in work:
                work[t, code // below_one] += n * n
        through = {b: 1 for b in big if SHRINK * work[b] < over[b] ** 2}  # a mass that no hash divides stays in blocks
        divided.append(Buckets(through))
        blocks.append(Buckets({b: -(-n // cap) for b, n in over.items() if b not in through}))
        over = {(t, code): n for (t, code), n in parts.items() if (t, code // below_one) in through}
    layout = reps.sparkSession.sparkContext.broadcast((divided, blocks))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(2), dims))
            packed, step, lost = sketch(unit)
            c1 = np.asarray(batch.column(0))
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            divided, blocks = layout.value
            for t in range(tables):
                for row, code, depth, home in cp.paths(unit, t, divided, True):
                    key = (code * LEVELS + depth) * tables + t
                    blk = np.zeros(len(row), np.int32)
                    bi, bj = blk, blk
                    if depth < len(blocks) and blocks[depth]:
                        parts = blocks[depth].get(t, code, 1)
                        own = np.repeat((c1[row].astype(np.uint64) % parts.astype(np.uint64)).astype(np.int32), parts)
                        other = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.int32)
                        row, key = np.repeat(row, parts), np.repeat(key, parts)
                        blk, bi, bj = own, np.minimum(own, other), np.maximum(own, other)
                    for at in range(0, len(row), 1 << 16):
                        s = slice(at, at + (1 << 16))
                        take = pa.array(row[s])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[s]), pa.array(bi[s]), pa.array(bj[s]), pa.array(blk[s]), pa.array(np.full(len(take), home)), batch.column(0).take(take), batch.column(1).take(take), bits.take(take), pa.array(step).take(take), pa.array(lost).take(take)],
                            ["key", "bi", "bj", "blk", "home", "c1", "c2", "bits", "step", "lost"],
                        )

    names = ["a1", "a2", "b1", "b2", "key", "bi", "bj", "blk", "home"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def pairs_of(table: pa.Table, x: np.ndarray, lost: np.ndarray, most: int | None) -> pa.Table | None:
        get = lambda n: np.asarray(table.column(n).to_numpy(zero_copy_only=False))
        c1, c2 = get("c1"), get("c2")
        got = candidates_in_bucket(get("home"), get("blk"), c1, x, lost, floor, k, bool((get("bi") == get("bj")).all()), most)
        if got is None:
            return None
        i, j = got
        swap = (c1[i] > c1[j]) | ((c1[i] == c1[j]) & (c2[i] > c2[j]))
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        return pa.table({"a1": c1[a], "a2": c2[a], "b1": c1[b], "b2": c2[b]})

    def compare(table: pa.Table) -> pa.Table:
        """Candidate pairs by sketch; of a bucket too dense for sketches its rows instead, to be compared by their vectors."""
        table = table.combine_chunks()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        step, lost = (np.asarray(table.column(n).to_numpy()) for n in ("step", "lost"))
        got = pairs_of(table, unsketch(bits, step, dims), lost, 8 * k * table.num_rows)
        if got is None:
            nothing = pa.nulls(table.num_rows)
            cols = [table.column("c1"), table.column("c2"), nothing, nothing, *[table.column(n) for n in ("key", "bi", "bj", "blk", "home")]]
        else:
            cols = [*got.columns, *[pa.nulls(got.num_rows)] * 5]
        return pa.table([c.cast(t) for c, t in zip(cols, types)], names)

    def compare_whole(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _unit(_matrix(table.column("embedding").combine_chunks(), dims))
        return pairs_of(table, x, np.zeros(len(x), np.float32), None)

    rows = reps.select("c1", "c2", "embedding").mapInArrow(emit, "key long, bi int, bj int, blk int, home boolean, c1 long, c2 int, bits binary, step float, lost float")
    kinds = "a1 long, a2 int, b1 long, b2 int"
    out = rows.groupBy("key", "bi", "bj").applyInArrow(compare, f"{kinds}, key long, bi int, bj int, blk int, home boolean")
    out = settle(out, "near-candidates")  # two readers below, whose filters would else be pushed into two runs of compare
    dense = out.filter("key is not null").select(F.col("a1").alias("c1"), F.col("a2").alias("c2"), "key", "bi", "bj", "blk", "home").join(reps, ["c1", "c2"])
    whole = dense.groupBy("key", "bi", "bj").applyInArrow(compare_whole, kinds)
    return out.filter("key is null").select("a1", "a2", "b1", "b2").unionByName(whole).distinct()


def nearest(rows: DataFrame, ids: tuple[str, str], vec: str, dims: int = 64, k: int = 10, floor: float = 0.9, tables: int = 3, cap: int = 4096) -> DataFrame:
    """(ids, n_ids..., similarity, rank): up to k nearest of each row among those with similarity >= floor.

    rows: unique by ids, vectors usable. Similarity is the cosine in double precision, rounded to 6 decimals; ties go to
    the smaller ids; a row isn't its own neighbour. Copies of a vector are one class: all its members share the list of the
    k + 1 first candidates of the class, in which a class is stood for by its k + 1 smallest members, so a class of any size
    costs its size. Fewer than two rows give an empty result. tables, cap: recall and bucket size.
    """
    raw = classes(rows.select(*ids, F.col(vec).alias("embedding")), "embedding")
    return nearest_members(raw.select(*ids, "c1", "c2"), raw.groupBy("c1", "c2").agg(F.first("embedding").alias("embedding")), raw, ids, dims, k, floor, tables, cap)


def nearest_members(members: DataFrame, reps: DataFrame, raw: DataFrame, ids: tuple[str, str], dims: int, k: int, floor: float, tables: int, cap: int) -> DataFrame:
    """``nearest`` on (ids, c1, c2) of the rows and (c1, c2, embedding) of their classes. raw: (c1, embedding) for sizing."""
    p, c = ids
    found = near_classes(reps, raw, dims, floor, k + 1, tables, cap)
    va = reps.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("embedding").alias("va"))
    vb = reps.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("embedding").alias("vb"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(4), dims).astype(np.float64), _matrix(batch.column(5), dims).astype(np.float64)
            s = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            s = np.round(s, 6)
            keep = pa.array(np.flatnonzero(s >= floor))
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(keep) for n in range(4)], pa.array(s).take(keep)], ["a1", "a2", "b1", "b2", "s"])

    pairs = found.join(va, ["a1", "a2"]).join(vb, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "va", "vb")
    pairs = settle(pairs.mapInArrow(exact, "a1 long, a2 int, b1 long, b2 int, s double"), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), "s"))
    first = members.withColumn("_n", F.row_number().over(W.partitionBy("c1", "c2").orderBy(p, c))).filter(F.col("_n") <= k + 1)
    targets = first.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col(p).alias("tp"), F.col(c).alias("tc"), "_n")
    copies = targets.filter("_n > 1").select(F.col("b1").alias("a1"), F.col("b2").alias("a2")).distinct().withColumns({"b1": F.col("a1"), "b2": F.col("a2"), "s": F.lit(1.0)})
    lists = both.unionByName(copies).join(targets, ["b1", "b2"]).select("a1", "a2", "s", "tp", "tc")
    lists = lists.withColumn("_r", F.row_number().over(W.partitionBy("a1", "a2").orderBy(F.desc("s"), "tp", "tc"))).filter(F.col("_r") <= k + 1)
    lists = lists.groupBy("a1", "a2").agg(F.sort_array(F.collect_list(F.struct("_r", "s", "tp", "tc"))).alias("l"))
    mine = members.join(lists, (F.col("c1") == F.col("a1")) & (F.col("c2") == F.col("a2")))
    others = F.slice(F.filter("l", lambda x: ~((x["tp"] == F.col(p)) & (x["tc"] == F.col(c)))), 1, k)
    return mine.select(p, c, F.posexplode(others).alias("_k", "x")).select(p, c, F.col("x.tp").alias(f"n_{p}"), F.col("x.tc").alias(f"n_{c}"), F.col("x.s").alias("similarity"), (F.col("_k") + 1).alias("rank"))


def near_pairs(vectors: DataFrame, dims: int = 64, k: int = 10, floor: float = 0.9, tables: int = 3, cap: int = 4096) -> DataFrame:
    """(post_a, chunk_a, post_b, chunk_b), smaller first: pairs of at least ``floor`` of which one is among the k nearest of the other.

    Only current rows (highest sync_seq of the post) with usable vectors count, one per post and chunk; of different vectors
    under one post, chunk and sync_seq the one with the greater hash. Which rows are current is settled on hashes
    of the vectors; the vectors themselves are shuffled once, by class.
    """
    from ..functions.vectors import usable

    rows = vectors.select("post_id", "chunk_number", "embedding", "sync_seq").na.drop(subset=["post_id", "chunk_number", "sync_seq"])
    raw = classes(rows.filter(usable(F.col("embedding"), dims)), "embedding")
    now = current(raw.select("post_id", "chunk_number", "sync_seq", "c1", "c2"), ["post_id"], top=rows)
    members = now.groupBy("post_id", "chunk_number").agg(F.max(F.struct("c1", "c2")).alias("m")).select("post_id", "chunk_number", "m.c1", "m.c2")
    reps = raw.groupBy("c1", "c2").agg(F.first("embedding").alias("embedding")).join(members.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi")
    near = nearest_members(members, reps, raw, ("post_id", "chunk_number"), dims, k, floor, tables, cap)
    less = (F.col("post_id") < F.col("n_post_id")) | ((F.col("post_id") == F.col("n_post_id")) & (F.col("chunk_number") < F.col("n_chunk_number")))
    pick = lambda x, y: F.when(less, F.col(x)).otherwise(F.col(y))
    return near.select(
        pick("post_id", "n_post_id").alias("post_a"), pick("chunk_number", "n_chunk_number").alias("chunk_a"),
        pick("n_post_id", "post_id").alias("post_b"), pick("n_chunk_number", "chunk_number").alias("chunk_b"),
    ).distinct()
