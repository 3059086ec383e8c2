"""An inverted-file layout for approximate search: vectors partitioned by their nearest centroid.

The centroid is a partition column, so a search that probes the p nearest centroids reads only their folders.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..functions.vectors import usable
from ..session import SharedFiles


@dataclass(frozen=True)
class IndexStats:
    rows: int
    cells: int
    largest: int
    fit_seconds: float
    write_seconds: float
    size: int = 0

    @property
    def rows_per_second(self) -> float:
        return self.rows / max(self.fit_seconds + self.write_seconds, 1e-9)


def index_name(mode: str, half: bool, dims: int) -> str:
    """Name of the layout for a mode: full, sliced or projected vectors, whole or half precision."""
    base = {"none": "posts_vectors", "slice": f"posts_vectors_slice_{dims}", "pca": f"posts_vectors_reduced_{dims}"}[mode]
    return base + ("_half" if half else "") + "_ivf"


class InvertedFile:
    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, column: str = "embedding"):
        self.spark, self.path, self.centroids, self.column = spark, path.rstrip("/"), centroids, column

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int, sample: int = 100_000, column: str = "embedding", key: Sequence[str] = ("post_id", "chunk_number"), seed: int = 1) -> tuple[InvertedFile, IndexStats]:
        """Centroids are fitted on at most ``sample`` vectors; every row is indexed. Unusable vectors go to cell -1."""
        from pyspark.ml.clustering import KMeans

        spark = vectors.sparkSession
        began = time.time()
        width = len(vectors.filter(F.col(column).isNotNull()).select(column).first()[0])
        some = vectors.filter(usable(F.col(column), width)).orderBy(F.xxhash64(*key), *key).limit(sample)
        model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10, featuresCol="_x").fit(some.select(array_to_vector(F.col(column).cast("array<double>")).alias("_x")))
        centroids = np.array(model.clusterCenters())
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        fitted = time.time()
        own = cls(spark, path, centroids, column)
        own.assign(vectors).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(own.path)  # a large cell is written by several tasks
        sizes = spark.read.parquet(own.path).groupBy("cell").count().agg(F.sum("count").alias("n"), F.count("*").alias("c"), F.max("count").alias("m")).collect()[0]
        return own, IndexStats(sizes.n or 0, sizes.c, sizes.m or 0, fitted - began, time.time() - fitted, SharedFiles(spark, own.path).size(""))

    @classmethod
    def ensure(cls, vectors: DataFrame, root: str, config: Config, cells: int | None = None, memory: int = 1 << 30) -> tuple[InvertedFile, IndexStats | None]:
        """The index of a mode below ``root``, built if it isn't there; the second value only for one that was built.

        cells: by default the root of the row count, 4096 at most. memory: bytes that the sample of the fit may take; the sample (a million vectors at most)
        is as large as they allow, and where even 40 vectors a cell don't fit there are fewer cells. The description that
        makes an index known is written last, so one whose build died is built anew.
        """
        column = "reduced_embedding" if config.reduction_mode == "pca" else "embedding"
        dims = config.reduced_dims if config.reduction_mode != "none" else config.dims
        files = SharedFiles(vectors.sparkSession, f"{root.rstrip('/')}/{index_name(config.reduction_mode, config.store_half, dims)}")
        path = f"{root.rstrip('/')}/{index_name(config.reduction_mode, config.store_half, dims)}/cells"
        if files.exists("index.json"):
            return cls(vectors.sparkSession, path, np.array(json.loads(files.read("index.json"))), column), None
        if config.reduction_mode == "slice":
            vectors = vectors.withColumn(column, F.slice(column, 1, dims))
        sample = max(1, min(1_000_000, memory // (8 * dims)))
        cells = max(1, min(cells or min(4096, math.isqrt(max(1, vectors.count()))), sample // 40 or 1))
        own, stats = cls.build(vectors, path, cells, sample, column)
        files.write("index.json", json.dumps(own.centroids.tolist()))
        return own, stats

    def assign(self, vectors: DataFrame) -> DataFrame:
        c, at, names = self.centroids, vectors.columns.index(self.column), vectors.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = b.column(at)
                ok = np.asarray(col.value_lengths().fill_null(-1)) == c.shape[1]
                x = np.asarray(col.filter(pa.array(ok)).flatten(), np.float64).reshape(-1, c.shape[1])
                cell = np.full(b.num_rows, -1, np.int32)
                best = (x @ c.T).argmax(1) if len(x) else np.empty(0, np.int64)
                best[~(np.abs(x).sum(1) > 0)] = -1
                cell[ok] = best
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*names, "cell"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
        return vectors.mapInArrow(run, f"{schema}, cell int")

    def probe(self, query: Sequence[float], n: int) -> DataFrame:
        """The rows of the n cells nearest to the query: partition pruning, no filter on rows."""
        cells = np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable")[:n]
        return self.spark.read.parquet(self.path).filter(F.col("cell").isin([int(x) for x in cells]))
