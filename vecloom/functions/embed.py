"""Vectors for texts through a pluggable embedder.

An embedder is any callable from a list of texts to a matrix of floats. The hashing embedder needs no model or
network and is the same on every machine.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

Embedder = Callable[[Sequence[str]], np.ndarray]
_WORD = re.compile(r"\w+")


class HashingEmbedder:
    """Signed feature hashing of words and word pairs, L2-normalised; a text without words gives the zero vector."""

    def __init__(self, dims: int):
        self.dims = dims

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, text in enumerate(texts):
            words = _WORD.findall(text.lower())
            for f in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(f)
                out[i, h % self.dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


class Retrying:
    """Repeats a call after IO errors, waiting twice as long each time up to ``longest`` seconds, and checks the count of the vectors.

    attempts: none for no end, as ingestion must not drop posts; searches bound it.
    """

    def __init__(self, embed: Embedder, attempts: int | None = 3, wait: float = 1.0, longest: float = 120.0):
        self.embed, self.attempts, self.wait, self.longest = embed, attempts, wait, longest

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        tried, wait = 0, self.wait
        while True:
            try:
                got = np.asarray(self.embed(texts))
                break
            except OSError:
                tried += 1
                if tried == self.attempts:
                    raise
                time.sleep(wait)
                wait = min(2 * wait, self.longest)
        if len(got) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(got)} vectors")
        return got


class EmbeddingService:
    """An embedding server over HTTP. It can be pickled, so every task talks to the server by itself.

    protocol: ``list`` posts {model, input, options} and gets {embeddings: [vector, ...]}; ``indexed`` posts
    {model, input} and gets {data: [{index, embedding}, ...]} in any order. Errors of the network and answers other than 200 are
    OSErrors, for ``Retrying`` to repeat. No texts need no request.
    """

    # The path of each protocol.
    PATHS = {"list": "/api/embed", "indexed": "/v1/embeddings"}

    def __init__(self, address: str, model: str, protocol: str = "list", options: Mapping[str, Any] | None = None, timeout: float = 300.0):
        self.url = address.rstrip("/") + self.PATHS[protocol]
        self.model, self.protocol, self.options, self.timeout = model, protocol, dict(options or {}), timeout

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        if not texts:
            return np.empty((0, 0), np.float32)
        asked: dict[str, Any] = {"model": self.model, "input": list(texts)}
        if self.options and self.protocol == "list":
            asked["options"] = self.options
        request = urllib.request.Request(self.url, json.dumps(asked).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            if answer.status != 200:
                raise OSError(f"answer {answer.status} of {self.url}")
            got = json.load(answer)
        rows = in_order(got.get("data", [])) if self.protocol == "indexed" else got.get("embeddings", [])
        return np.asarray(rows, np.float32).reshape(len(rows), -1)


def in_order(items: Sequence[dict]) -> list:
    """Vectors of a service's answer, put in the order of its ``index`` numbers."""
    return [x["embedding"] for x in sorted(items, key=lambda x: x["index"])]


def embed_texts(rows: DataFrame, text: str, embed: Embedder, batch: int = 100, out: str = "embedding") -> DataFrame:
    """Adds the vector of each text; null for null. The embedder gets batches, many tasks an executor overlap its waiting."""
    names = rows.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                texts = part.column(at).to_pylist()
                some = [t for t in texts if t is not None]
                vectors = iter(np.asarray(embed(some), np.float32).tolist()) if some else iter(())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {out} array<float>")


def with_prefix(prefix: str, text: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.col(text) if isinstance(text, str) else text)


def to_half(rows: DataFrame, column: str) -> DataFrame:
    """Values rounded through half precision, kept as floats."""
    names = rows.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            flat = np.asarray(col.flatten(), np.float32).astype(np.float16).astype(np.float32)
            size = np.asarray(col.value_lengths().fill_null(0))
            offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
            half = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=col.is_null()) if col.null_count else pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], half, *b.columns[at + 1 :]], names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {'array<float>' if f.name == column else f.dataType.simpleString()}" for f in rows.schema.fields))
