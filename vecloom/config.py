"""Settings that change results, and the derived limits."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

MODES = ("none", "pca", "slice")

# Limits of the search interface.
MAX_POSTS, MAX_AUTHORS, MAX_FULL, MAX_CANDIDATES, MAX_EXHAUSTIVE = 1000, 100, 50, 50_000, 100_000
POST_FACTOR, AUTHOR_FACTOR = 5, 10


@dataclass(frozen=True)
class Config:
    """One node's settings. Values are folded into plans as literals."""

    dims: int = 768
    tokens_per_chunk: int = 512
    overlap_amount: float = 0.15
    document_prefix: str = "passage: "
    query_prefix: str = "query: "
    min_token_threshold: int = 75
    min_token_search_threshold: int = 0
    max_embeddings_per_post: int | None = None
    reduction_mode: str = "none"
    reduced_dims: int | None = None
    store_half: bool = False
    minimum_candidates: int = 1000
    allow_debugging: bool = False
    llm: str = ""
    sync_uuid: str = ""
    max_visible_sync_seq: int = 0
    skipped_op_count: int = 0
    upstream_skipped_op_count: int = 0

    def __post_init__(self) -> None:
        if self.reduction_mode not in MODES:
            raise ValueError(f"reduction_mode must be one of {MODES}")
        if self.reduction_mode != "none" and not 0 < (self.reduced_dims or 0) <= self.dims:
            raise ValueError("a reduced search needs 0 < reduced_dims <= dims")
        if not 0 <= self.overlap_amount < 1:
            raise ValueError("overlap_amount is a share below 1")
        if self.max_embeddings_per_post == 0:  # 0 stands for no limit
            object.__setattr__(self, "max_embeddings_per_post", None)

    def with_(self, **changes: Any) -> Config:
        return replace(self, **changes)


@dataclass(frozen=True)
class Debug:
    """Overrides of one request; refused unless the node allows debugging."""

    candidates: int | None = None
    factor: int | None = None
    exhaustive: bool = False

    @property
    def used(self) -> bool:
        return self.candidates is not None or self.factor is not None or self.exhaustive


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def ann_candidates(limit: int, factor: int, config: Config, debug: Debug | None = None) -> int:
    """Chunks looked at for ``limit`` results: a multiple of the limit, at most 50 000, at least the configured minimum."""
    debug = gate(config, debug)
    count = min(limit * (debug.factor or factor), MAX_CANDIDATES)
    if debug.candidates is not None:
        count = debug.candidates
    return max(count, config.minimum_candidates)


def gate(config: Config, debug: Debug | None) -> Debug:
    debug = debug or Debug()
    if debug.used and not config.allow_debugging:
        raise PermissionError("debugging options are disabled on this node")
    return debug
