"""Dimensionality reduction: fit, project, slice."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F


def fit_pca(vectors: DataFrame, components: int, sample: int | None = 1_000_000, key: Sequence[str] = ("post_id", "chunk_number"), column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(matrix of components x dims, explained share of each) from at most ``sample`` vectors, the first by hash of the key.

    The covariance is summed on the executors; only dims x dims numbers reach the driver.
    """
    rows = vectors.filter(F.col(column).isNotNull())
    if sample is not None:
        rows = rows.orderBy(F.xxhash64(*key), *key).limit(sample)
    from pyspark.ml.feature import PCA

    model = PCA(k=components, inputCol="_x", outputCol="_y").fit(rows.select(array_to_vector(F.col(column).cast("array<double>")).alias("_x")))
    return model.pc.toArray().T, np.asarray(model.explainedVariance.toArray())


def explained(shares: Sequence[float]) -> list[tuple[int, float, float]]:
    """(component, share, cumulative share), counted from 1."""
    total = np.cumsum(shares)
    return [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(shares, total))]


def matrix_rows(matrix: np.ndarray) -> list[tuple[int, list[float]]]:
    return [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]


def matrix_of(table: DataFrame) -> np.ndarray:
    """The matrix of a (row_idx, row_vec) table; at most dims x dims numbers."""
    return np.array([r.row_vec for r in table.orderBy("row_idx").collect()], np.float64)


def project_all(vectors: DataFrame, matrix: np.ndarray, normalise: bool = False, column: str = "embedding", out: str = "reduced_embedding") -> DataFrame:
    """Adds M.v of every vector in one matrix product a batch; null for null and for vectors of another width.

    Always the positive projection, without centring. normalise: to length 1, a zero result stays zero.
    """
    m = np.asarray(matrix, np.float64)
    names = vectors.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            ok = np.asarray(col.value_lengths().fill_null(-1)) == m.shape[1]
            good = col.filter(pa.array(ok))
            y = np.asarray(good.flatten(), np.float64).reshape(-1, m.shape[1]) @ m.T
            if normalise:
                n = np.sqrt((y * y).sum(1, keepdims=True))
                y = y / np.where(n == 0, 1, n)
            offsets = np.r_[0, np.cumsum(ok * m.shape[0])].astype(np.int32)
            got = pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.astype(np.float32).ravel()), mask=pa.array(~ok)) if len(ok) else pa.array([], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{schema}, {out} array<float>")


def sequence_ranges(vectors: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Inclusive sync_seq ranges of equal width that cover the table; empty for an empty table."""
    r = vectors.agg(F.min("sync_seq").alias("a"), F.max("sync_seq").alias("z")).collect()[0]
    if r.a is None:
        return []
    step = -(-(r.z - r.a + 1) // parts)
    return [(a, min(a + step - 1, r.z)) for a in range(r.a, r.z + 1, step)]
