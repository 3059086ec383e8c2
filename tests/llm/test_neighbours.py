"""Most similar vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import neighbours
from vecloom.llm.neighbours import Buckets, CrossPolytope, near_pairs, nearest, sketch, unsketch

SCHEMA = "post_id int, chunk_number int, embedding array<float>"


def brute(ids, x, k, floor):
    x = np.asarray(x, np.float32).astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    s = np.round(x @ x.T / np.outer(n, n), 6)
    out = {}
    for i in range(len(x)):
        c = sorted((-s[i, j], ids[j]) for j in range(len(x)) if j != i and s[i, j] >= floor)[:k]
        if c:
            out[ids[i]] = [(b, -a) for a, b in c]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.post_id, r.chunk_number), []).append((r.rank, (r.n_post_id, r.n_chunk_number), r.similarity))
    return {k: [(b, s) for _, b, s in sorted(v)] for k, v in out.items()}


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = [*base, *(base[i % 20] + rng.normal(size=16) * 0.2 for i in range(120)), *[base[0]] * 15, *[base[1] * 3] * 2]
    return [(i // 2, i % 2) for i in range(len(x))], np.float32(x)


def make(spark, cloud):
    return spark.createDataFrame([(p, c, v.tolist()) for (p, c), v in zip(*cloud)], SCHEMA)


def recall(got, want):
    hits = sum(len({b for b, _ in got.get(k, [])} & {b for b, _ in v}) for k, v in want.items())
    return hits / sum(map(len, want.values()))


def test_against_brute_force_with_copies_and_ties(spark, cloud):
    want = brute(*cloud, 5, 0.8)
    got = found(nearest(make(spark, cloud).withColumn("c1", F.lit("clash")), ("post_id", "chunk_number"), "embedding", 16, 5, 0.8, tables=12))
    assert recall(got, want) > 0.98
    same = [k for k in want if {b for b, _ in got.get(k, [])} == {b for b, _ in want[k]}]
    assert all(got[k] == want[k] for k in same)


@pytest.mark.parametrize("cap", [4, 12, 40])
def test_divided_buckets_lose_no_copies_and_little_recall(spark, cloud, cap):
    want = brute(*cloud, 5, 0.8)
    got = found(nearest(make(spark, cloud), ("post_id", "chunk_number"), "embedding", 16, 5, 0.8, tables=12, cap=cap))
    assert recall(got, want) > 0.9
    copies = cloud[0][180:195]
    assert all(len(got[k]) == 5 and {s for _, s in got[k]} == {1.0} for k in copies)


def test_a_mass_of_nearly_equal_vectors_is_compared_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.float32(np.ones(16) + rng.normal(size=(90, 16)) * 1e-3)
    ids = [(i, 0) for i in range(90)]
    want = brute(ids, x, 3, 0.9)
    got = found(nearest(make(spark, (ids, x)), ("post_id", "chunk_number"), "embedding", 16, 3, 0.9, tables=2, cap=20))
    assert recall(got, want) > 0.95


def test_sketches_bound_what_they_lose():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(50, 10)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    packed, step, lost = sketch(u)
    v = unsketch(packed, step, 10)
    assert (np.linalg.norm(u - v, axis=1) <= lost).all() and packed.shape == (50, 5)


def test_rotations_keep_length_and_axes_are_signed():
    cp = CrossPolytope(10, 2)
    x = np.eye(10, dtype=np.float32)
    a, b = cp.axes(x, 0, 0), cp.axes(x, 0, 0, True)
    assert (a != b).all() and a.max() < 2 * cp.width and (cp.axes(-x, 0, 0) != a).all()


def test_buckets_are_looked_up_by_table():
    held = Buckets({(0, 5): 3, (0, 900): 7, (2, 5): 4})
    assert held.get(0, np.array([900, 4, 5, 1000]), 1).tolist() == [7, 1, 3, 1] and held.get(1, np.array([5]), 1).tolist() == [1]
    assert held and not Buckets() and held.get(2, np.array([], np.int64), 1).tolist() == []


def test_current_usable_pairs(spark):
    e = lambda *v: [float(x) for x in [*v, *[0] * (4 - len(v))]]
    rows = [(1, 0, e(1), 5), (1, 0, e(1), 5), (2, 0, e(1, 0.1), 3), (2, 1, e(2), 3), (3, 0, e(1), 1), (3, 1, e(0, 1), 2), (4, 0, None, 9), (4, 1, e(0), 9), (5, 0, [1.0], 1), (6, 0, e(1), None), (None, 0, e(1), 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", sync_seq int").withColumn("s", F.lit(1))
    got = sorted(tuple(r) for r in near_pairs(df, 4, tables=8).collect())
    assert got == [(1, 0, 2, 0), (1, 0, 2, 1), (2, 0, 2, 1)]
    assert near_pairs(df.limit(0), 4).count() == 0


def hard_pairs(n=1500):
    """Pairs (i, n + i) at a cosine of just above 0.9."""
    x, z = np.random.default_rng(8).normal(size=(2, n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return np.float32(np.concatenate([x, 0.901 * x + np.sqrt(1 - 0.901**2) * z]))


@pytest.mark.parametrize("cap, levels", [(4096, 3), (8, 1), (2, 2), (1, 3)])
def test_recall_holds_at_every_depth_with_the_parameters_of_production(spark, monkeypatch, cap, levels):
    """Cap 8 compares buckets in blocks, the smaller ones divide them once and twice, whatever it gains."""
    for name, value in (("DIVIDE", 1), ("SHRINK", 0), ("LEVELS", levels)) if cap < 4096 else ():
        monkeypatch.setattr(neighbours, name, value, raising=False)
    x = hard_pairs()
    ids = [(i, 0) for i in range(len(x))]
    share = recall(found(nearest(make(spark, (ids, x)), ("post_id", "chunk_number"), "embedding", cap=cap)), brute(ids, x, 10, 0.9))
    print(f"recall with cap {cap}: {share:.4f}")
    assert share > 0.97


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_pairs_meet_as_surely_in_divided_buckets(depth):
    """Every bucket is divided, those of single rows too."""
    x, cp, divided = hard_pairs(600), CrossPolytope(64, 3), []
    for level in range(depth):
        divided.append(Buckets({(t, c): 1 for t in range(3) for _, code, d, _ in cp.paths(x, t, divided, True) if d == level for c in code.tolist()}))
    met = np.zeros(600, bool)
    for t in range(3):
        at = {}
        for rows, code, d, home in cp.paths(x, t, divided, True):
            assert d == depth
            for r, c in zip(rows.tolist(), code.tolist()):
                at.setdefault(c, []).append((r, home))
        for held in at.values():
            for r, home in held:
                met[r % 600] |= any(s == (r + 600) % 1200 and (home or h) for s, h in held)
    print(f"met at depth {depth}: {met.mean():.4f}")
    assert met.mean() > 0.96
