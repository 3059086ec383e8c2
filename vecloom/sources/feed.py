"""Live pull of a change feed as a Spark data source.

``spark.readStream.format("vecloom_feed")`` with the options url (a server's base address) or folder (operations as
JSON files of a shared folder, arrays or one a line, for tests and replays), sync_uuid, after_seq and page_size. The offset is the last sequence delivered.
"""

from __future__ import annotations

import json
import time
import urllib.request
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "sync_seq int, op string, author string, permlink string, number_of_tokens int, last_vectors_block int, embeddings array<array<float>>"
COLUMNS = ("sync_seq", "op", "author", "permlink", "number_of_tokens", "last_vectors_block", "embeddings")
# First and longest wait after a failed request, in seconds.
FIRST_WAIT, LONGEST_WAIT = 3, 60


@lru_cache(maxsize=2)
def _replayed(folder: str, seen: tuple[tuple[str, int], ...]) -> list[dict]:
    """All operations of a folder in order, read once as long as its files stay the same."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    ops: list[dict] = []
    for path, _ in seen:
        with fs.open_input_stream(path) as f:
            text = f.read().decode()
        ops += json.loads(text) if text.lstrip().startswith("[") else [json.loads(line) for line in text.splitlines() if line.strip()]
    return sorted(ops, key=lambda o: o["sync_seq"])


def replayed(folder: str) -> list[dict]:
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    fs, path = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return _replayed(folder, tuple(sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".json"))))


def pull(options: dict[str, str], after_seq: int, attempts: int = 5) -> list[tuple]:
    """One page of operations behind after_seq, in order."""
    size = int(options.get("page_size", "1000"))
    if folder := options.get("folder"):
        ops = replayed(folder)
        at = bisect_right(ops, after_seq, key=lambda o: o["sync_seq"])
        ops = ops[at : at + size]
    else:
        url = f"{options['url'].rstrip('/')}/embedding-updates?after_seq={after_seq}&page_size={size}&sync_uuid={options.get('sync_uuid', '')}"
        wait = FIRST_WAIT
        for attempt in range(attempts):
            try:
                with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
                    ops = json.load(r)
                break
            except OSError:
                if attempt == attempts - 1:
                    raise
                time.sleep(wait)
                wait = min(wait * 2, LONGEST_WAIT)
    return [tuple(o.get(c) for c in COLUMNS) for o in ops]


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"after_seq": int(self.options.get("after_seq", "0"))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = pull(self.options, start["after_seq"])
        return iter(rows), {"after_seq": rows[-1][0] if rows else start["after_seq"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["after_seq"]
        while at < end["after_seq"]:
            rows = [r for r in pull(self.options, at) if r[0] <= end["after_seq"]]
            if not rows:
                return
            yield from rows
            at = rows[-1][0]


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(int(self.options.get("after_seq", "0")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = partition.value
        while rows := pull(self.options, at):
            yield from rows
            at = rows[-1][0]


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecloom_feed"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))
