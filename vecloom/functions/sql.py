"""The engine's functions for SQL callers.

Scalar ones are SQL functions that Spark inlines into the plan, so they stay in the JVM; the chunker is a table function.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import Chunker, strip_html, tokenizer, unescape_html

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate({a}, 0D, (s, x) -> s + x * x))"

SCALARS = {
    "inner_product(a array<double>, b array<double>) returns double": _DOT.format(a="a", b="b"),
    "negative_inner_product(a array<double>, b array<double>) returns double": "-" + _DOT.format(a="a", b="b"),
    "vector_norm_l2(a array<double>) returns double": _NORM.format(a="a"),
    "cosine_distance(a array<double>, b array<double>) returns double": (
        f"case when size(a) <> size(b) or coalesce({_NORM.format(a='a')} * {_NORM.format(a='b')}, 0D) = 0 then double('NaN') "
        f"else 1 - {_DOT.format(a='a', b='b')} / nullif({_NORM.format(a='a')} * {_NORM.format(a='b')}, 0D) end"
    ),
    "subvector(a array<double>, start int, n int) returns array<double>": "slice(a, start, n)",
    "normal_name(s string) returns string": r"regexp_replace(lower(regexp_replace(s, '^\\s+|\\s+$', '')), '^@', '')",
    "language_guess(s string) returns string": r"case when s rlike '[\\uAC00-\\uD7AF]' then 'ko' when s rlike '[\\u3040-\\u30FF]' then 'ja' when s rlike '[\\u4E00-\\u9FFF]' then 'zh' when s is not null then 'en' end",
}


class ChunkPost:
    """chunk_post(text, max_tokens, overlap, prefix, threshold): one row a chunk; none for null, blank and too short texts."""

    def eval(self, text: str, max_tokens: int, overlap: float, prefix: str, threshold: int) -> Iterator[tuple]:
        if not text or not text.strip():
            return
        done = Chunker(tokenizer(None), max_tokens, float(overlap), prefix or "").chunk(text)
        if done.token_count >= threshold:
            for i, c in enumerate(done.chunks):
                yield i, c, done.token_count


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark.sql`` in this session."""
    for head, body in SCALARS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    spark.udf.register("strip_html", strip_html)
    spark.udf.register("unescape_html", unescape_html)
    spark.udtf.register("chunk_post", udtf(ChunkPost, returnType="chunk_number int, chunk_text string, token_count int"))
