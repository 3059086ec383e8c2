"""Queries of the text and vector operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import Registry, Tables
from .bpe import encode_corpus, token_bytes
from .languages import document_languages, fit, relabelled
from .neighbours import near_pairs
from .packing import group_report, pack, tier_report
from .pieces import split_oversized, token_count
from .sentences import split_sentences

QUERIES = Registry()

P3 = r"""
select distinct post_id, chunk_number
from tmp_chunks t join sync_chains c on c.sync_uuid = t.sync_uuid
where len(regexp_extract_all(chunk_text, '[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]|[^\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF} \t\r\n\x{00A0}\x{3000}]+')) > tokens_per_chunk
"""


def _pieces(t: Tables) -> DataFrame:
    limits = t.sync_chains.select("sync_uuid", "tokens_per_chunk", "overlap_amount")
    rows = t.tmp_chunks.select("post_id", "chunk_number", "chunk_text", "sync_uuid").join(limits, "sync_uuid")
    return split_oversized(rows, ["post_id", "chunk_number"], "chunk_text", "tokens_per_chunk", "overlap_amount")


@QUERIES.query("p3_found", P3)
def p3_found(t: Tables) -> DataFrame:
    return _pieces(t).filter("n_pieces > 1").select("post_id", "chunk_number").distinct()


@QUERIES.query("p3_pieces")
def p3_pieces(t: Tables) -> DataFrame:
    return _pieces(t)


P3_TOKENS = P3[P3.index("len(") : P3.index(" > ")]


@QUERIES.query(
    "p3_kept",
    P3.replace("distinct post_id, chunk_number", f"distinct post_id, chunk_number, {P3_TOKENS}::bigint as tokens, true as within, true as overlapping"),
)
def p3_kept(t: Tables) -> DataFrame:
    """Tokens of the chunks that were cut (each counted once), whether all pieces are within the limit, and whether
    consecutive pieces share the tokens they must."""
    limits = t.sync_chains.select("sync_uuid", "tokens_per_chunk", "overlap_amount")
    rules = t.tmp_chunks.select("post_id", "chunk_number", "sync_uuid").distinct().join(limits, "sync_uuid")
    shared = F.least(F.greatest(F.round(F.coalesce(F.col("overlap_amount").cast("double"), F.lit(0.0)) * F.col("tokens_per_chunk")).cast("int"), F.lit(0)), F.col("tokens_per_chunk") - 1)
    chunk = _pieces(t).filter("n_pieces > 1").groupBy("post_id", "chunk_number").agg(F.sum("n_tokens").alias("sum"), F.max("n_tokens").alias("most"), F.count(F.lit(1)).alias("n"), F.sum(token_count("piece")).alias("read"))
    rows = chunk.join(rules, ["post_id", "chunk_number"])
    return rows.select(
        "post_id", "chunk_number", (F.col("sum") - (F.col("n") - 1) * shared).cast("long").alias("tokens"), (F.col("most") <= F.col("tokens_per_chunk")).alias("within"), (F.col("read") == F.col("sum")).alias("overlapping")
    ).distinct()


@QUERIES.query("p4_found")
def p4_found(t: Tables) -> DataFrame:
    return split_sentences(t.tmp_chunks, ["post_id", "chunk_number"], "chunk_text")


#: What Python's strip takes away, for DuckDB's rtrim.
_BLANK = "'" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "'"


@QUERIES.query("p4_last", f"select distinct post_id, chunk_number, length(rtrim(chunk_text, {_BLANK}))::int as last_end from tmp_chunks where length(rtrim(chunk_text, {_BLANK})) > 0")
def p4_last(t: Tables) -> DataFrame:
    """End of the last sentence of every chunk: no text is left behind it."""
    return split_sentences(t.tmp_chunks, ["post_id", "chunk_number"], "chunk_text").groupBy("post_id", "chunk_number").agg(F.max("sent_end").alias("last_end"))


P5 = """
with m as (select post_id, max(sync_seq) sync_seq from posts_vectors group by 1),
v as (select distinct post_id p, chunk_number c, embedding::double[] e from posts_vectors join m using (post_id, sync_seq)
  where len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
s as (select a.p ap, a.c ac, b.p bp, b.c bc, round(list_cosine_similarity(a.e, b.e), 6) s from v a, v b where (a.p, a.c) <> (b.p, b.c)),
r as (select ap, ac, bp, bc, row_number() over (partition by ap, ac order by s desc, bp, bc) n from s where s >= 0.9)
select distinct least((ap, ac), (bp, bc))[1] as post_a, least((ap, ac), (bp, bc))[2] as chunk_a, greatest((ap, ac), (bp, bc))[1] as post_b, greatest((ap, ac), (bp, bc))[2] as chunk_b
from r where n <= 10
"""


@QUERIES.query("p5_found", P5)
def p5_found(t: Tables) -> DataFrame:
    return near_pairs(t.posts_vectors)


@QUERIES.query("p7_ids")
def p7_ids(t: Tables) -> DataFrame:
    return encode_corpus(t.documents)


@QUERIES.query("p7_bytes", "select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes from documents")
def p7_bytes(t: Tables) -> DataFrame:
    """(doc_id, n_bytes): bytes that the ids of a document stand for, which are those of its text."""
    return token_bytes(encode_corpus(t.documents))


def _packed(t: Tables) -> DataFrame:
    return pack(encode_corpus(t.documents, count_only=True), "doc_id", "n_tokens")


@QUERIES.query("p8_packed")
def p8_packed(t: Tables) -> DataFrame:
    return _packed(t)


@QUERIES.query("p8_tiers")
def p8_tiers(t: Tables) -> DataFrame:
    return tier_report(_packed(t))


@QUERIES.query("p8_groups")
def p8_groups(t: Tables) -> DataFrame:
    return group_report(_packed(t))


@QUERIES.query(
    "p8_kept",
    "select doc_id, greatest(1, ceil(coalesce(length(text), 0) / 2048))::bigint as pieces, coalesce(length(text), 0)::bigint as size, true as fits, true as in_place from documents",
)
def p8_kept(t: Tables) -> DataFrame:
    """The same packing by code points: pieces and size of every document, whether its containers are within their capacity
    and whether nothing in them overlaps."""
    packed = pack(t.documents.select("doc_id", F.length("text").alias("n")), "doc_id", "n")
    ends = F.col("offset") + F.col("n_tokens")
    load = packed.groupBy("container").agg(F.sum("n_tokens").alias("_sum"), F.max(ends).alias("_end"))  # equal where pieces lie end to end
    rows = packed.join(load, "container")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("size"), F.bool_and(F.col("_sum") <= 2048).alias("fits"), F.bool_and((F.col("_sum") == F.col("_end")) | (F.col("n_tokens") == 0)).alias("in_place"),
    )


@QUERIES.query("p9_found")
def p9_found(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", "lang")
    return relabelled(t.spark, docs).select("doc_id", "seg_no", "lang")


@QUERIES.query("p9_languages")
def p9_languages(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", "lang")
    return document_languages(t.spark, docs, fit(docs)).select("doc_id", "seg_no", "lang", "confidence", "sentences")
