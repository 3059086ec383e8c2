"""Files the engine reads and writes besides Parquet."""

from __future__ import annotations

import gzip
import json
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import to_text
from ..operators.rebase import Dump
from ..schemas import OLD_DELETED, OLD_POST_DATA, OLD_ROOT_POSTS, OLD_VECTORS
from ..session import SharedFiles

SPACE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
EMPTY = "\ue000empty\ue000"  # stands for a quoted empty string while a file is read
DUMPS = {"old_vectors": OLD_VECTORS, "old_deleted": OLD_DELETED, "old_post_data": OLD_POST_DATA, "old_root_posts": OLD_ROOT_POSTS}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; arrays as ``[x,y,...]``. Quotes are doubled, nulls empty, and empty strings quoted; white space stays."""
    flat = df.select(*[to_text(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').option("lineSep", "\n").options(**SPACE).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header by a fixed schema, lines ending in LF; an empty (0-byte) file or folder is an empty table. Only an unquoted empty field is null."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("emptyValue", EMPTY).option("lineSep", "\n").option("multiLine", True).options(**SPACE).csv(path)
    return rows.select(*[F.when(F.col(f.name) == EMPTY, "").otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in rows.schema.fields])


def write_dump(dump: Dump, folder: str) -> None:
    for name, df in zip(DUMPS, (dump.vectors, dump.deleted, dump.post_data, dump.root_posts)):
        write_csv(df, f"{folder}/{name}.csv")


def read_dump(spark: SparkSession, folder: str) -> Dump:
    return Dump(*[read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in DUMPS.items()])


@dataclass(frozen=True)
class StatusLine:
    """``uuid|tail|skipped|block``"""

    sync_uuid: str
    tail_seq: int
    skipped: int
    block: int

    @classmethod
    def parse(cls, line: str) -> StatusLine:
        parts = line.strip().split("|")
        if len(parts) != 4:
            raise ValueError(f"not a status line: {line!r}")
        return cls(parts[0], *map(int, parts[1:]))

    def __str__(self) -> str:
        return f"{self.sync_uuid}|{self.tail_seq}|{self.skipped}|{self.block}"


def write_status(spark: SparkSession, folder: str, line: StatusLine) -> None:
    SharedFiles(spark, folder).write("old_status.txt", str(line) + "\n")


def read_status(spark: SparkSession, folder: str) -> StatusLine:
    return StatusLine.parse(SharedFiles(spark, folder).read("old_status.txt"))


# -- matrices --------------------------------------------------------------------------------------------------
def matrix_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, row_vec) of a JSON array of rows in one file."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<array<float>>").alias("m"))
    return rows.select(F.posexplode("m").alias("row_idx", "row_vec"))


def load_matrix(path: str) -> np.ndarray:
    """A projection matrix from .json, .json.gz or .npy; components x dims."""
    if path.endswith(".npy"):
        m = np.load(path, allow_pickle=False)
    elif path.endswith(".json.gz"):
        with gzip.open(path, "rt") as f:
            m = np.array(json.load(f))
    elif path.endswith(".json"):
        with open(path) as f:
            m = np.array(json.load(f))
    else:
        raise ValueError(f"unknown matrix format: {path}")
    if m.ndim != 2 or not m.size:
        raise ValueError(f"not a matrix: {path}")
    return m.astype(np.float64)


def save_matrix(matrix: np.ndarray, path: str) -> None:
    if path.endswith(".npy"):
        np.save(path, matrix)
    else:
        opener = gzip.open if path.endswith(".gz") else open
        with opener(path, "wt") as f:
            json.dump(np.asarray(matrix).tolist(), f)


def find_matrix(name: str, folders: list[str]) -> str:
    """The first existing file of that name, extensions included; no network."""
    for folder in ["", *folders]:
        for ext in ("", ".npy", ".json", ".json.gz"):
            path = os.path.join(folder, name + ext)
            if os.path.isfile(path):
                return path
    raise FileNotFoundError(name)


# -- recall files ----------------------------------------------------------------------------------------------
def write_neighbours(neighbours: DataFrame, path: str) -> None:
    """One JSON object a query: its name and chunk, and its neighbours in order. neighbours: q_author, q_permlink, q_chunk_number, author, permlink, chunk_number, distance, rank."""
    one = F.struct("rank", "author", "permlink", "chunk_number", "distance")
    rows = neighbours.groupBy("q_author", "q_permlink", "q_chunk_number").agg(F.sort_array(F.collect_list(one)).alias("n"))
    rows.select(
        F.struct(F.col("q_author").alias("author"), F.col("q_permlink").alias("permlink"), F.col("q_chunk_number").alias("chunk_number")).alias("query"),
        F.transform("n", lambda x: x.dropFields("rank")).alias("neighbors"),
    ).write.mode("overwrite").json(path)


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    schema = "query struct<author string, permlink string, chunk_number int>, neighbors array<struct<author string, permlink string, chunk_number int, distance double>>"
    rows = spark.read.schema(schema).json(path).select("query.*", F.posexplode("neighbors").alias("i", "x"))
    return rows.select(*[F.col(c).alias(f"q_{c}") for c in ("author", "permlink", "chunk_number")], "x.*", (F.col("i") + 1).alias("rank"))


def float16_blobs(rows: DataFrame, column: str) -> DataFrame:
    """Little-endian half-precision bytes back to arrays of floats."""
    names = rows.columns
    at = names.index(column)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            vecs = [None if x is None else np.frombuffer(x, "<f2").astype(np.float32).tolist() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(vecs, pa.list_(pa.float32())), *b.columns[at + 1 :]], names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {'array<float>' if f.name == column else f.dataType.simpleString()}" for f in rows.schema.fields))
