"""Pieces under a limit."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vecloom.llm.pieces import cut, split_oversized, token_count

TOKEN = re.compile("[฀-๿぀-ヿ㐀-鿿가-힯]|[^฀-๿぀-ヿ㐀-鿿가-힯 \t\r\n 　]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab ", "c. ", "한", "\n", "D. ", "字。", "x,", " ", "\n\n", "ก"]), max_size=200), st.integers(1, 40), st.integers(0, 50))
def test_limits_overlap_and_cover(parts, limit, overlap):
    text = "".join(parts)
    spans = [m.span() for m in TOKEN.finditer(text)]
    got = cut(text, limit, overlap)
    if not spans:
        assert got == []
        return
    o = max(0, min(overlap, limit - 1))
    at = 0
    for i, (a, b, n) in enumerate(got):
        inside = [s for s in spans if a <= s[0] and s[1] <= b]
        assert len(inside) == n <= limit
        assert a == spans[at][0]
        at += n - o
    assert got[-1][1] == spans[-1][1] and at + o == len(spans)
    if len(spans) <= limit:
        assert len(got) == 1
    else:
        least = 1 + -(-(len(spans) - limit) // (limit - o))
        assert least <= len(got) <= least + 1


def test_cuts_snap_to_the_strongest_boundary():
    text = " ".join(["w"] * 9) + ". " + "A " + " ".join(["w"] * 8) + "."
    assert [text[a:b] for a, b, _ in cut(text, 10, 0)] == [" ".join(["w"] * 9) + ".", "A " + " ".join(["w"] * 8) + "."][:1] + [text[text.index("A ") :].strip()]
    two = ("a b c d e. F g.\n\n" + "H i j k l m n.").strip()
    assert two[: cut(two, 8, 0)[0][1]].endswith("g.")


def test_a_text_without_any_boundary():
    assert [n for _, _, n in cut("字" * 95, 10, 2)] and max(n for _, _, n in cut("字" * 95, 10, 2)) <= 10


def test_rows(spark):
    rows = [(1, "a b c d e f", 4, 0.25), (1, "a b c d e f", 4, 0.25), (2, "a b", 4, 0.5), (3, None, 4, 0.5), (4, "a b c", None, 0.5), (5, "a b c", 2, None), (6, "", 1, 0.0), (7, "a b c", 0, 0.0), (8, "한글 漢字", 3, 5.0)]
    df = spark.createDataFrame(rows, "k int, t string, lim int, share float").withColumn("piece", F.lit("clash"))
    got = {}
    for r in split_oversized(df, ["k"], "t", "lim", "share").collect():
        got.setdefault(r.k, []).append((r.piece_no, r.n_pieces, r.n_tokens, r.piece))
    assert sorted(got) == [1, 5, 8]
    assert sorted(got[1]) == [(0, 2, 4, "a b c d"), (1, 2, 3, "d e f")] or sum(n for _, _, n, _ in got[1]) == 7
    assert all(n <= 3 for _, _, n, _ in got[8]) and len(got[5]) == 2
    assert split_oversized(df.limit(0), ["k"], "t", "lim", "share").count() == 0
    counts = [r.n for r in df.select("k", token_count("t").alias("n")).orderBy("k").collect()]
    assert counts == [6, 6, 2, None, 3, 3, 0, 3, 4]
