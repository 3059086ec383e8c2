"""Schemas (DDL) of the owned tables and of the exchanged records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

POST_DATA = "post_id int, number_of_tokens int, last_vectors_block int"
POSTS_VECTORS = "post_id int, chunk_number int, embedding array<float>, sync_seq int"
REDUCED_VECTORS = "post_id int, chunk_number int, reduced_embedding array<float>"
REDUCING_MATRIX = "row_idx int, row_vec array<float>"
DELETED = "post_id int, sync_seq int"
SYNC_CHAINS = (
    "sync_uuid string, priority int, base_url string, llm string, embedding_dimensionality int, document_prefix string, query_prefix string, "
    "tokens_per_chunk int, overlap_amount float, min_token_threshold int, max_embeddings_per_post int, skipped_op_count int, note string"
)
FEED = "sync_seq int, op string, author string, permlink string, number_of_tokens int, last_vectors_block int, embeddings array<array<float>>"
SIMILAR = "similarity_order int, similarity double, post_id int, chunk_number int"
OLD_VECTORS = "author string, permlink string, chunk_number int, embedding string, sync_seq int"
OLD_DELETED = "author string, permlink string, sync_seq int"
OLD_POST_DATA = "author string, permlink string, number_of_tokens int, last_vectors_block int"
OLD_ROOT_POSTS = "author string, permlink string"


def check_dims(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """Fails at run time on a vector of another width; nulls pass."""
    size = F.size(column)
    return vectors.withColumn(column, F.when(F.col(column).isNull() | (size == dims), F.col(column)).otherwise(F.raise_error(F.format_string("vector of width %d, expected %d", size, F.lit(dims)))))
