"""Normal form of names (author, permlink) and row hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that count as surrounding white space of a name or an operation.
EDGE = r"^[\s 　]+|[\s 　]+$"


def trimmed(col: Column | str) -> Column:
    """Lower case without surrounding white space (of any kind, line breaks included)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, EDGE, ""))


def name_of(col: Column | str) -> Column:
    """``trimmed`` without a leading ``@``; null stays null."""
    return F.regexp_replace(trimmed(col), r"^@", "")


def row_hash(*cols: Column | str) -> Column:
    """64-bit hash of a row that tells nulls apart (xxhash64 alone skips them)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*cs, *[c.isNull() for c in cs])


def additive(h: Column) -> list[Column]:
    """Count and two 32-bit halves summed apart: an order-free checksum that cannot overflow below 2^31 rows."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("hi"),
    ]
