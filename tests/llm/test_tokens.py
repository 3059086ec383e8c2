"""Corpus encoding and packing."""

import base64
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vecloom.llm.bpe import MergeReplay, encode_corpus, vocabulary_path
from vecloom.llm.packing import group_report, pack, plan, tier_report

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def replay():
    return MergeReplay(vocabulary_path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_published_one():
    from vecloom.llm import bpe

    assert bpe.PATTERN == P.PATTERN


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aab \n'st<|>endofx", max_size=120)))
def test_equal_to_a_word_by_word_encoder(replay, oracle, text):
    text = text.encode("utf-8", "ignore").decode()
    assert replay.encode([text])[0] == oracle.encode_ordinary(text)


def test_hard_texts(replay, oracle):
    texts = ["", None, "<|endoftext|>", "a" * 5000, "ab" * 3000, "ABCD" * 2000, "日本語 한국어 العربية 👩‍🌾", "  \n\n\t x  ", "don't WE'LL", "0123456789" * 50, "aaaa aaaa aaab"]
    assert replay.encode(texts) == [oracle.encode_ordinary(t) if t else [] for t in texts]


def test_rows(spark, oracle):
    df = spark.createDataFrame([(1, "Hello there"), (1, "Hello there"), (None, "x"), (2, None), (3, ""), (4, "y" * 300_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df).collect()), key=repr)
    assert got == sorted([(k, oracle.encode_ordinary(t) if t else []) for k, t in [(1, "Hello there"), (1, "Hello there"), (None, "x"), (2, None), (3, ""), (4, "y" * 300_000)]], key=repr)
    assert {r.n_tokens for r in encode_corpus(df.filter("doc_id in (2, 3)"), count_only=True).collect()} == {0}
    assert encode_corpus(df.limit(0)).count() == 0


def laid(runs):
    """({window: {size: items}}, {window: tier}, {window: container}) of a plan."""
    inside, tier, at = {}, {}, {}
    for r in runs:
        for k in range(r.k0, r.k1):
            w = r.window + (k - r.k0 + r.skip) // r.each
            held = inside.setdefault(w, {})
            held[r.size] = held.get(r.size, 0) + 1
            c = r.container + (w + r.shift) // r.windows
            assert tier.setdefault(w, r.host_tier) == r.host_tier and at.setdefault(w, c) == c
    return inside, tier, at


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=40), st.sampled_from([(100,), (100, 50, 25), (64, 10)]))
def test_plans_place_every_item_once(histogram, tiers):
    runs, n = plan(histogram, 100, tiers)
    for s, c in histogram.items():
        ranks = sorted((r.k0, r.k1) for r in runs if r.size == s)
        assert ranks[0][0] == 0 and ranks[-1][1] == c and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    inside, tier, at = laid(runs)
    fill = {}
    for w, held in inside.items():
        used = sum(s * c for s, c in held.items())
        assert used <= tier[w] and tier[w] in {*tiers, 100}
        fill[at[w]] = fill.get(at[w], 0) + used
    assert set(fill) == set(range(n)) and all(v <= 100 for v in fill.values())
    assert sum(2 * v <= 100 for v in fill.values()) <= 1  # two containers half empty would have been one
    fits = [-(-sum(c for s, c in histogram.items() if s > 100 // (k + 1)) // k) for k in range(1, 10)]  # at most k of such a size go into one
    assert n >= max(-(-sum(s * c for s, c in histogram.items()) // 100), *fits)
    assert len(runs) <= 12 * (len(histogram) + 1)


def test_tiers_shape_the_plan():
    """Long windows are filled from shorter tiers, full windows of every tier stay together and share containers, the rest
    is laid into containers by itself."""
    tiers = (2048, 1024, 512, 256)
    histogram = {1500: 3, 600: 4, 500: 3, 424: 4, 300: 2, 212: 1, 48: 3}
    runs, n = plan(histogram, 2048, tiers)
    inside, tier, at = laid(runs)
    by_tier = {t: sorted(sorted(h.items()) for w, h in inside.items() if tier[w] == t) for t in tiers}
    assert by_tier[2048][:3] == [[(48, 1), (500, 1), (1500, 1)]] * 3 and by_tier[1024] == [[(424, 1), (600, 1)]] * 4 and by_tier[512] == [[(212, 1), (300, 1)]]
    assert n == 3 + 2 + 1 and len({at[w] for w in at if tier[w] == 1024}) == 2
    flat = laid(plan(histogram, 2048, (2048,))[0])[0].values()
    assert [(424, 1), (600, 1)] not in [sorted(h.items()) for h in flat]
    rnd = random.Random(9)
    mix = {}
    for _ in range(20000):
        s = min(2048, int(rnd.lognormvariate(5, 1.2)) + 1)
        mix[s] = mix.get(s, 0) + 1
    assert plan(mix, 2048, tiers)[1] <= 1.005 * sum(s * c for s, c in mix.items()) / 2048 + 1


def test_packing_rows(spark):
    rnd = random.Random(2)
    rows = [(i, 7) for i in range(400)] + [(400 + i, rnd.randint(0, 60)) for i in range(300)] + [(900, 257), (901, 50), (902, None), (903, 0), (903, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("container", F.lit("clash"))
    out = pack(df, "doc_id", "n_tokens", 50, (50, 25), salts=3, containers_per_step=10).collect()
    assert len(out) == len(rows) + 5 + sum(1 for _, n in rows if n is not None and 50 < n <= 60)
    size, whole = {}, {}
    for r in out:
        size.setdefault(r.container, []).append(r)
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
    assert all(sum(r.n_tokens for r in rs) <= 50 for rs in size.values())
    for rs in size.values():
        at = 0
        for r in sorted((r for r in rs if r.n_tokens), key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_tokens
    assert all(whole[k] == sum(n or 0 for d, n in rows if d == k) for k, _ in rows)
    total = sum(n or 0 for _, n in rows)
    assert len(size) <= -(-total // 50) * 1.03 + 1
    load, tiers = {}, {}
    for r in out:
        load[r.step_group] = load.get(r.step_group, 0) + r.n_tokens
        if r.n_tokens:
            assert r.tier <= r.host_tier and r.n_tokens <= r.host_tier
            key = r.host_tier, r.step_group
            tiers[key] = tiers.get(key, 0) + r.n_tokens
    for t in {t for t, _ in tiers}:
        mine = [v for (x, _), v in tiers.items() if x == t]
        assert max(mine) - min(mine) <= 0.35 * max(load.values())
    assert max(load.values()) - min(load.values()) <= 0.35 * max(load.values())
    packed = pack(df, "doc_id", "n_tokens", 50, (50, 25), containers_per_step=10)
    windows = {(r.host_tier, r.window): 0 for r in packed.collect() if r.window is not None}
    report = {r.host_tier: r for r in tier_report(packed).collect()}
    assert {t: r.windows for t, r in report.items()} == {t: sum(k[0] == t for k in windows) for t in (50, 25)}
    assert sum(r.tokens for r in report.values()) == total == sum(r.tokens for r in group_report(packed).collect()) and report[50].fillers > 0 and report[25].fillers == 0
    assert pack(df.limit(0), "doc_id", "n_tokens", 50).count() == 0
    nothing = pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens int"), "doc_id", "n_tokens", 50).collect()
    assert {(r.doc_id, r.container) for r in nothing} == {(1, 0), (2, 0)}
