"""Byte-level BPE encoding of a whole corpus by merge replay.

Instead of merging word by word, the distinct words of a block of the corpus are laid out in one linked list of symbols
with an inverted index from every mergeable pair to its positions. Merges are then applied in rank order to all
positions at once, and only the neighbours of a merged symbol get new index entries. A text is the
concatenation of its words' ids, so nothing is shuffled: every task replays the merges over its own part of the corpus.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, functions as F

#: Words kept in a task's dictionary; beyond that it is emptied (bounds memory, changes no result).
MAX_KNOWN = 400_000
#: Longer words are not kept in the dictionary.
MAX_KEPT = 64


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; folder overrides the installed package."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed value: the split pattern that belongs to the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeReplay:
    """Encoder for one rank file (token bytes and rank per line); ranks are the ids."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: b for b, r in self.rank.items()}
        self.byte_id = [self.rank[bytes([i])] for i in range(256)]
        self.find = regex.compile(pattern).findall
        self._pair: dict[tuple[int, int], int | None] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def _merged(self, a: int, b: int) -> int | None:
        """The id that the pair merges to, if it does."""
        key = (a, b)
        try:
            return self._pair[key]
        except KeyError:
            if len(self._pair) > 2_000_000:
                self._pair.clear()
            r = self._pair[key] = self.rank.get(self.bytes_of[a] + self.bytes_of[b])
            return r

    def replay(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word: every merge in rank order over all words at once."""
        whole = [self.rank.get(w) for w in words]
        todo = [i for i, r in enumerate(whole) if r is None and words[i]]
        out: list[tuple[int, ...]] = [(r,) if r is not None else () for r in whole]
        if not todo:
            return out
        sym: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        starts: list[int] = []
        for i in todo:
            at, w = len(sym), words[i]
            starts.append(at)
            sym.extend(self.byte_id[c] for c in w)
            n = len(w)
            nxt.extend(range(at + 1, at + n))
            nxt.append(-1)
            prv.append(-1)
            prv.extend(range(at, at + n - 1))
        index: dict[int, list[int]] = {}
        merged = self._merged
        for i, j in enumerate(nxt):
            if j >= 0 and (r := merged(sym[i], sym[j])) is not None:
                index.setdefault(r, []).append(i)
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            r = heapq.heappop(ranks)
            places = index.pop(r, None)
            if not places:
                continue
            places.sort()
            for i in places:
                a = sym[i]
                j = nxt[i] if a >= 0 else -1
                if j < 0 or merged(a, sym[j]) != r:
                    continue
                sym[i], sym[j] = r, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    if (q := merged(r, sym[k])) is not None:
                        if q not in index:
                            index[q] = []
                            heapq.heappush(ranks, q)
                        index[q].append(i)
                h = prv[i]
                if h >= 0 and (q := merged(sym[h], r)) is not None:
                    if q not in index:
                        index[q] = []
                        heapq.heappush(ranks, q)
                    index[q].append(h)
        for i, at in zip(todo, starts):
            ids = []
            while at >= 0:
                ids.append(sym[at])
                at = nxt[at]
            out[i] = tuple(ids)
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of every text of a block; the empty list for null and empty texts."""
        split = [self.find(t) if t else () for t in texts]
        known, extra = self._known, {}
        new = {w for ws in split for w in ws} - known.keys()
        if new:
            words = list(new)
            for w, ids in zip(words, self.replay([w.encode("utf-8", "surrogatepass") for w in words])):
                (known if len(w) <= MAX_KEPT else extra)[w] = ids
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w] if w in known else extra[w]
            out.append(ids)
        if len(known) > MAX_KNOWN:
            known.clear()
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> MergeReplay:
    """One encoder a Python worker."""
    return MergeReplay(path)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, block: int = 512, count_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with count_only.

    Null and empty texts get the empty list (0). Repeated rows stay repeated, a null key stays null, other columns are
    not read. Only one Arrow batch is held at a time and it is encoded ``block`` texts at once, so very long texts cost their own size.
    """
    path = vocabulary_path(vocabulary, folder)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids = enc.encode(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                if count_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes)], [key, "n_tokens"])
                else:
                    offsets = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    flat = np.fromiter((x for one in ids for x in one), np.int32, int(offsets[-1]))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    return rows.mapInArrow(run, f"{key} {kind}, n_tokens int" if count_only else f"{key} {kind}, ids array<int>")


def token_bytes(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, n_bytes): bytes that the ids of each row stand for; 0 for no ids."""
    path = vocabulary_path(vocabulary, folder)
    rows = encoded.select(F.col(key).alias(key), F.col(ids).alias("_ids"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path).bytes_of
        size = np.zeros(max(held) + 1, np.int64)
        size[list(held)] = [len(b) for b in held.values()]
        for batch in batches:
            lists = batch.column(1)
            total = np.concatenate([[0], np.cumsum(size[np.asarray(lists.flatten())])])
            at = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total[at[1:]] - total[at[:-1]])], [key, "n_bytes"])

    return rows.mapInArrow(run, f"{key} {kind}, n_bytes long")
