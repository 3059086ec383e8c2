"""The ingestion loop: from the chain's blocks to the published store, range by range."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..functions.embed import Embedder
from ..operators.store import Store, must_stop, posts_in_range, stage


@dataclass
class BlockLoop:
    """posts: (id, root_id, block_num, block_num_created) of the chain; texts: (post_id, title, body); head: the chain's last block.

    Far behind the head ranges of ``size`` blocks are taken, near it single blocks. Everything a range yields is published
    with its last block, so a loop that died goes on behind the last whole range, skipping and repeating nothing. Edited
    posts come again with their new text.
    """

    store: Store
    config: Config
    embed: Embedder
    posts: Callable[[], DataFrame]
    texts: Callable[[], DataFrame]
    head: Callable[[], int]
    first_block: int = 1
    stop_at: int | None = None
    size: int = 1000
    near: int = 100
    tokenizer_path: str | None = None

    def next_range(self) -> tuple[int, int] | None:
        """The next blocks to take, none if the chain has no more yet or hasn't reached the first block."""
        head, first = self.head(), max(self.first_block, self.store.status().last_block + 1)
        if first > head:
            return None
        step = self.size if stage(first - 1, head, self.near) == "massive" else 1
        return first, min(first + step - 1, head, head if self.stop_at is None else self.stop_at)

    def step(self, first: int, last: int) -> None:
        """One range: its root posts with their texts are prepared, embedded, stored and published."""
        found = posts_in_range(self.posts(), first, last).select("post_id", F.col("block").alias("block_num"))
        rows = found.join(self.texts().select("post_id", "title", "body"), "post_id").select("post_id", "title", "body", "block_num")
        if rows.limit(1).count():
            self.store.ingest(rows, self.config, self.embed, last, self.tokenizer_path)
        else:
            self.store.update(last_block=last)

    def run(self, live: bool = False, idle: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> str:
        """Works until there is a reason to stop, which it returns: a stop was asked for, the block limit or (not live) the head is
        reached. Waits ``idle`` seconds where the chain has nothing new; before its first block that is so in either mode."""
        while True:
            status = self.store.status()
            if why := must_stop(status, status.last_block, self.stop_at):
                return why
            blocks = self.next_range()
            if blocks:
                self.step(*blocks)
            elif live or self.head() < self.first_block:
                sleep(idle)
            else:
                return "head reached"
