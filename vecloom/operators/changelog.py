"""A log-structured table: a stream of inserts, updates and deletes turned into the current state.

Change batches are appended as runs. A run holds the last operation of each key in the batch, sorted by key,
deletes as tombstones, one file a hash bucket of the key. Reading is a k-way merge: a task opens the files of its
bucket in all live runs as sorted streams, and a heap of the streams says how far all of them have been read, so only one
block a stream is in memory, nothing is shuffled and nothing is sorted but the rows that meet. The operation with the highest sequence wins
and tombstones fall away. Compaction merges runs of similar size into one whenever there are too many, and keeps the
last tombstone of a key, which hides lower puts that arrive later. Which runs are live stands in a manifest
that is replaced atomically; every run has a folder of its own that is written once, so a batch that died
half-way is invisible.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.names import name_of, trimmed
from ..session import SharedFiles, ship

BUCKET = "_bucket"
LABEL = "_label"
BLOCK = 8192  # rows of a stream held at once
PER_BUCKET = 1 << 18  # rows of the first batch a bucket is meant to hold
BUCKET_BYTES = 1 << 28  # a full compaction divides buckets that have grown beyond
RATIO = 2  # a run joins a compaction of smaller ones up to this multiple of their size


@dataclass(frozen=True)
class Run:
    """A live run: its folder below ``runs``, the label it was appended under, and its size in bytes."""

    id: str
    label: str
    size: int


class ChangeLog:
    """The log at ``path``.

    keys: key columns; seq: the sequence that orders changes; payload: further columns the state keeps.
    Contract of a change row: the keys, ``seq``, ``put`` (true: put in place, false: remove) and the payload. Rows
    with a null key, seq or put change nothing. Repeated rows and any order of arrival give the same state. Of two
    rows with one key and sequence a put beats a removal (an update that is delivered as removal and insert under one
    sequence), further ties are settled by the greater payload. Other columns are not read. An empty log is an empty table.

    buckets: tasks of a merge; by default as many as the first batch asks for, and a full compaction doubles them when the
    table has outgrown them. max_runs: more live runs than that are compacted after an append. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], seq: str, payload: T.StructType | None = None, key_types: dict[str, str] | None = None, buckets: int | None = None, max_runs: int = 16):
        self.spark, self.path, self.keys, self.seq, self.max_runs, self._buckets = spark, path.rstrip("/"), list(keys), seq, max_runs, buckets
        self.payload = list((payload or T.StructType()).fields)
        types = key_types or {}
        own = [f"`{k}` {types.get(k, 'string')}" for k in self.keys] + [f"`{seq}` bigint", "put boolean"]
        self.schema = T.StructType.fromDDL(", ".join(own + [f"`{f.name}` {f.dataType.simpleString()}" for f in self.payload]))
        self.files = SharedFiles(spark, self.path)

    # -- manifest -------------------------------------------------------------------------------------------
    def _manifests(self) -> list[str]:
        return [n for n in self.files.names("manifest") if n.endswith(".json")]

    def _manifest(self, name: str | None = None) -> tuple[int, list[Run]]:
        name = name or (self._manifests() or [None])[-1]
        if name is None:
            return 0, []
        held = json.loads(self.files.read(f"manifest/{name}"))
        return held["buckets"], [Run(**r) for r in held["runs"]]

    def runs(self) -> list[Run]:
        return self._manifest()[1]

    def live(self) -> list[str]:
        """Labels of the live runs."""
        return sorted(r.label for r in self.runs())

    def _publish(self, buckets: int, runs: Sequence[Run]) -> None:
        names = self._manifests()
        version = int(names[-1][:-5]) + 1 if names else 0
        self.files.write(f"manifest/{version:09d}.json", json.dumps({"buckets": buckets, "runs": [asdict(r) for r in runs]}))
        for old in names[:-1]:
            self.files.delete(f"manifest/{old}")

    def _sweep(self) -> None:
        """Removes runs that neither the live manifest nor the one before it names: its readers may still be at work."""
        kept = {r.id for n in self._manifests()[-2:] for r in self._manifest(n)[1]}
        for batch in self.files.names("runs"):
            if not any(k.startswith(batch + "/") for k in kept):
                self.files.delete(f"runs/{batch}")
                continue
            for folder in self.files.names(f"runs/{batch}"):
                if folder.startswith(LABEL) and f"{batch}/{folder}" not in kept:
                    self.files.delete(f"runs/{batch}/{folder}")

    # -- writing --------------------------------------------------------------------------------------------
    def _last(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """The winning change per key: combined map-side, so a hot key costs one row a task."""
        names = [f.name for f in self.payload]
        best = rows.groupBy(*by).agg(F.max(F.struct(self.seq, "put", *names)).alias("_m"))
        return best.select(*by, F.col("_m").getField(self.seq).alias(self.seq), F.col("_m.put").alias("put"), *[F.col("_m").getField(n).alias(n) for n in names])

    def _write(self, rows: DataFrame, buckets: int, shuffle: bool = True) -> list[Run]:
        """Writes rows with a label as runs of a new batch folder, one file sorted by key a run and bucket."""
        batch = uuid.uuid4().hex[:12]
        placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int"))
        if shuffle:
            placed = placed.repartition(buckets, BUCKET)
        placed.sortWithinPartitions(LABEL, BUCKET, *self.keys).write.option("maxRecordsPerFile", 0).partitionBy(LABEL, BUCKET).parquet(f"{self.path}/runs/{batch}")
        folders = [f for f in self.files.names(f"runs/{batch}") if f.startswith(LABEL)]
        return [Run(f"{batch}/{f}", f[len(LABEL) + 1 :], self.files.size(f"runs/{batch}/{f}")) for f in folders]

    def append(self, changes: DataFrame, run: Column | str) -> list[str]:
        """Adds a batch. run: the label of its run, or an expression that tells the runs of a larger batch apart.

        What batches left that died before they were published is removed first. A label that is live is refused, so a
        batch delivered again under its label isn't written twice; once compaction has taken it in, another copy changes
        nothing but costs its size. The runs of an expression are new ones every time.
        """
        buckets, before = self._manifest()
        one = isinstance(run, str)
        if one and run in {r.label for r in before}:
            raise ValueError(f"run {run!r} is already published")
        self._sweep()
        rows = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], (F.lit("one") if one else F.coalesce(run.cast("string"), F.lit("none"))).alias(LABEL))
        rows = rows.na.drop(subset=[*self.keys, self.seq, "put"])
        if not buckets:
            buckets = self._buckets or max(16, 1 << math.ceil(math.log2(max(1, rows.count() / PER_BUCKET))))
        made = self._write(self._last(rows, [LABEL, *self.keys]), buckets)
        self._publish(buckets, [*before, *([replace(r, label=run) for r in made] if one else made)])
        self.tidy()
        return self.live()

    def _compact(self, runs: Sequence[Run], label: str, buckets: int) -> None:
        now, live = self._manifest()
        made = self._write(self._merge(runs, now, True).withColumn(LABEL, F.lit("one")), buckets, shuffle=buckets != now)
        self._publish(buckets, [*[r for r in live if r not in runs], *[replace(r, label=label) for r in made]])
        self._sweep()

    def compact(self, label: str = "compacted") -> list[str]:
        """Merges all live runs into one. Last tombstones stay: a lower put may still arrive late or again."""
        buckets, runs = self._manifest()
        if runs:
            while sum(r.size for r in runs) / buckets > BUCKET_BYTES:
                buckets *= 2
            self._compact(runs, label, buckets)
        return self.live()

    def tidy(self) -> bool:
        """Size-tiered compaction: with more than max_runs live runs the smallest are merged, and with them every next
        larger one of at most RATIO times their size. Each row is so rewritten about log(size) times."""
        buckets, runs = self._manifest()
        if len(runs) <= self.max_runs:
            return False
        runs = sorted(runs, key=lambda r: r.size)
        n = len(runs) - self.max_runs + 1
        while n < len(runs) and runs[n].size <= RATIO * sum(r.size for r in runs[:n]):
            n += 1
        label = f"compacted-{uuid.uuid4().hex[:6]}"
        if n == len(runs):
            self.compact(label)
        else:
            self._compact(runs[:n], label, buckets)
        return True

    # -- reading --------------------------------------------------------------------------------------------
    def merged(self, tombstones: bool = False, payload: bool = True) -> DataFrame:
        """The current state: one row per key in place, with tombstones also those that are gone (put is false).

        payload: also the payload columns; without them they aren't read.
        """
        buckets, runs = self._manifest()
        return self._merge(runs, buckets, tombstones, payload)

    def _merge(self, runs: Sequence[Run], buckets: int, tombstones: bool, payload: bool = True) -> DataFrame:
        kept = [f for f in self.schema.fields if payload or f not in self.payload]
        shown = T.StructType([f for f in kept if tombstones or f.name != "put"])
        if not runs:
            return self.spark.createDataFrame([], shown)
        ship(self.spark)
        arrow, keys, seq, read = to_arrow_schema(T.StructType(kept)), self.keys, self.seq, [f.name for f in kept]
        folders = [f"{self.files.uri()}/runs/{r.id}" for r in runs]
        show = shown.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket in batch.column(0).to_pylist():
                    streams = [blocks(path, fs, read) for folder in folders for fs, path in sorted_files(f"{folder}/{BUCKET}={bucket}")]
                    for table in merge_streams(streams, keys, seq):
                        if not tombstones:
                            table = table.filter(table.column("put"))
                        for part in table.select(show).cast(pa.schema([arrow.field(n) for n in show])).combine_chunks().to_batches():
                            yield part

        return self.spark.range(0, buckets, 1, buckets).mapInArrow(run, shown)


# -- k-way merge ---------------------------------------------------------------------------------------------
def sorted_files(folder: str) -> list[tuple[pafs.FileSystem, str]]:
    """The data files of a run in one bucket, each sorted by key; none if the run has no key there."""
    fs, path = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return [(fs, f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".parquet")]


def blocks(path: str, fs: pafs.FileSystem, columns: list[str]) -> Iterator[pa.RecordBatch]:
    with fs.open_input_file(path) as source:
        for block in pq.ParquetFile(source).iter_batches(BLOCK, columns=columns):
            if block.num_rows:
                yield block.select(columns)


class _Keys:
    """Key tuples of a block, looked up one at a time."""

    def __init__(self, block: pa.RecordBatch, keys: Sequence[str]):
        self.columns = [block.column(k) for k in keys]

    def __len__(self) -> int:
        return len(self.columns[0])

    def __getitem__(self, i: int) -> tuple[Any, ...]:
        return tuple(c[i].as_py() for c in self.columns)


def merge_streams(streams: Sequence[Iterator[pa.RecordBatch]], keys: Sequence[str], seq: str) -> Iterator[pa.Table]:
    """Streams sorted by key, each key once a stream, merged to one in order with the winning change of every key.

    The heap holds each stream's block under its last key. Up to the smallest of these every stream has been read, so that much can go out.
    """
    heap: list[tuple[tuple[Any, ...], int, pa.RecordBatch]] = []

    def advance(i: int) -> None:
        block = next(streams[i], None)
        if block is not None:
            heapq.heappush(heap, (_Keys(block, keys)[block.num_rows - 1], i, block))

    for i in range(len(streams)):
        advance(i)
    while heap:
        bound = heap[0][0]
        out, rest, read = [], [], []
        for last, i, block in heap:
            n = block.num_rows if last == bound else bisect_right(_Keys(block, keys), bound)
            if n:
                out.append(block.slice(0, n))
            if n < block.num_rows:
                rest.append((last, i, block.slice(n)))
            else:
                read.append(i)
        heap = rest
        heapq.heapify(heap)
        for i in read:
            advance(i)
        yield _winners(pa.Table.from_batches(out), keys, seq) if len(out) > 1 else pa.Table.from_batches(out)


def _winners(table: pa.Table, keys: Sequence[str], seq: str) -> pa.Table:
    order = pc.sort_indices(table, [*[(k, "ascending") for k in keys], (seq, "descending"), ("put", "descending")])
    column = lambda name: table.column(name).take(order).combine_chunks()
    n = table.num_rows
    differs = lambda c: pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    first, other = np.ones(n, bool), np.ones(n, bool)
    first[1:] = np.logical_or.reduce([differs(column(k)) for k in keys])
    other[1:] = first[1:] | differs(column(seq)) | differs(column("put"))
    order = order.to_numpy().copy()
    best = np.flatnonzero(first)
    rest = [c for c in table.column_names if c not in (*keys, seq, "put")]
    tied = best[best + 1 < n]
    for at in tied[~other[tied + 1]].tolist() if rest else ():  # equal sequences: the greater payload
        group = [at]
        while group[-1] + 1 < n and not other[group[-1] + 1]:
            group.append(group[-1] + 1)
        held = table.select(rest).take(pa.array(order[group])).to_pylist()
        order[at] = order[group[max(range(len(group)), key=lambda g: [_rank(held[g][c]) for c in rest])]]
    return table.take(pa.array(order[best]))


def _rank(v: Any) -> tuple[Any, ...]:
    """The order of values as in a maximum over structs: null lowest, NaN highest, arrays element by element."""
    if v is None:
        return (0,)
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, list):
        return (1, tuple(_rank(x) for x in v))
    return (2,) if isinstance(v, float) and v != v else (1, v)


def feed_changes(feed: DataFrame) -> DataFrame:
    """Operations as received, in the log's form: names in normal form, op without case and edge space.

    Unknown operations change nothing.
    """
    op = trimmed("op")
    return feed.withColumns({
        "author": name_of("author"),
        "permlink": name_of("permlink"),
        "put": F.when(op.isin("insert", "update"), True).when(op == "delete", False),
    })
