"""Oversized texts cut into pieces under a token limit, at natural boundaries, with overlap.

Balanced targets: the least number of pieces that can hold the text gives equally long target pieces, each
target cut snaps to the strongest boundary near it, and a piece is added when a limit would be broken.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .sentences import sentence_ends

# Characters that are tokens by themselves, and white space.
SINGLE = r"฀-๿぀-ヿ㐀-鿿가-힯"
SPACE = r" \t\r\n 　"
TOKEN = f"[{SINGLE}]|[^{SINGLE}{SPACE}]+"
_TOKEN = regex.compile(TOKEN)

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = 5, 4, 3, 2, 1
_CLAUSE = frozenset(",;:，、；：،؛—–)]}）」』»”")


def token_count(text: Column | str) -> Column:
    """Tokens of a text, counted in the JVM; null for null."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN))


def _strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary before each token (index 0 unused)."""
    out = [0] * len(spans)
    for i in range(1, len(spans)):
        a, b = spans[i - 1][1], spans[i][0]
        if b > a:
            gap = text[a:b]
            breaks = gap.count("\n") or gap.count("\r")
            out[i] = PARAGRAPH if breaks > 1 else LINE if breaks else WORD
        if out[i] < CLAUSE and text[a - 1] in _CLAUSE:
            out[i] = CLAUSE
    starts = [s for s, _ in spans]
    for end in sentence_ends(text):
        i = bisect_left(starts, end)
        if 0 < i < len(out) and out[i] < SENTENCE:
            out[i] = SENTENCE
    return out


def _place(n: int, total: int, limit: int, overlap: int, strength: list[int], reach: int) -> list[int] | None:
    """Cuts (token indices) of n pieces, or none if a limit fails."""
    cuts: list[int] = []
    start = 0
    for i in range(1, n):
        left = n - i
        lo = max(start + overlap + 1, total - left * (limit - overlap))
        hi = min(start + limit, total - 1)
        if lo > hi:
            return None
        target = min(max(round(i * (total - overlap) / n) + overlap, lo), hi)
        near = range(max(lo, target - reach), min(hi, target + reach) + 1)
        best = max(near, key=lambda c: (strength[c], -abs(c - target)))
        if strength[best] < SENTENCE:
            wide = max(range(lo, hi + 1), key=lambda c: (strength[c], -abs(c - target)))
            if strength[wide] > max(strength[best], WORD) or strength[best] == 0:
                best = wide
        cuts.append(best)
        start = best - overlap
    return cuts if total - start <= limit else None


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece, offsets in code points; one piece for a text within the limit.

    Consecutive pieces share exactly ``overlap`` tokens (at most limit - 1). Blank texts have no piece.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)]
    total = len(spans)
    if not total:
        return []
    overlap = max(0, min(overlap, limit - 1))
    if total <= limit:
        return [(spans[0][0], spans[-1][1], total)]
    strength = _strengths(text, spans)
    least = 1 + -(-(total - limit) // (limit - overlap))
    cuts = None
    n = least
    while cuts is None:
        cuts = _place(n, total, limit, overlap, strength, max(1, limit // 6))
        if cuts is not None and n == least and any(strength[c] == 0 for c in cuts):
            more = _place(n + 1, total, limit, overlap, strength, max(1, limit // 6))
            if more is not None and sum(strength[c] == 0 for c in more) < sum(strength[c] == 0 for c in cuts):
                cuts = more
        n += 1
    out, start = [], 0
    for c in [*cuts, total]:
        out.append((spans[start][0], spans[c - 1][1], c - start))
        start = c - overlap
    return out


def split_oversized(rows: DataFrame, keys: list[str], text: str, limit: str, share: str) -> DataFrame:
    """(keys, piece_no, n_pieces, start, end, n_tokens, piece) of every text with more tokens than its limit.

    limit: column with the row's limit; null or below 1 is no limit. share: column with the overlap as a share of the
    limit, null is none; the overlap in tokens is rounded and at most limit - 1. Null, empty and blank texts
    have no tokens and no rows; repeated rows count once; other columns are dropped. Sizes are counted in the JVM,
    so only oversized texts reach Python.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    big = (
        rows.select(*keys, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("_share"))
        .filter("_text is not null and _limit >= 1")
        .filter(token_count("_text") > F.col("_limit"))
        .withColumn("_overlap", F.least(F.greatest(F.round(F.col("_share") * F.col("_limit")).cast("int"), F.lit(0)), F.col("_limit") - 1))
        .select(*keys, "_text", "_limit", "_overlap")
        .distinct()
    )
    n = len(keys)
    schema = f"{kinds}, piece_no int, n_pieces int, start int, end int, n_tokens int, piece string"
    names = [*keys, "piece_no", "n_pieces", "start", "end", "n_tokens", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                index, cols = [], [[] for _ in range(6)]
                for i, (t, lim, o) in enumerate(zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), part.column(n + 2).to_pylist())):
                    pieces = cut(t, lim, o)
                    for k, (a, b, size) in enumerate(pieces):
                        index.append(i)
                        for col, v in zip(cols, (k, len(pieces), a, b, size, t[a:b])):
                            col.append(v)
                take = pa.array(index, pa.int32())
                kept = [part.column(k).take(take) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.int32()) for c in cols[:5]], pa.array(cols[5], pa.string())], names)

    return big.mapInArrow(run, schema)
