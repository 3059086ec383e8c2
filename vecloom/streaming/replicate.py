"""Replication: a change feed applied to a store, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.feed import FeedState, advance, ops_change, ready, resolve_ops, unresolved
from ..operators.store import Store
from ..session import settle


class NotReady(RuntimeError):
    """The dependency hasn't reached the page's blocks yet; the batch is to be tried again."""


@dataclass
class Replica:
    """names: (author, permlink, post_id) of local posts. missing: ``skip`` counts operations without a post and keeps them
    aside, ``exit`` refuses the batch. head: the dependency's current block, or none for no admission check.

    Where the replica stands is part of the store's status, which is replaced together with the tables: a restarted replica goes
    on from there, and operations it has applied already are passed over and not counted again.
    """

    store: Store
    names: Callable[[], DataFrame]
    missing: str = "skip"
    head: Callable[[], int] | None = None
    aside: str | None = None

    @property
    def state(self) -> FeedState:
        s = self.store.status()
        return FeedState(s.feed_seq, s.last_block, s.skipped_op_count, s.upstream_skipped_op_count, s.inserts, s.deletes)

    def batch(self, ops: DataFrame, batch_id: int) -> None:
        """Applies one page, in the order of its sequence numbers. Run again after a failure it changes nothing twice."""
        state = self.state
        ops = settle(ops.filter(F.col("sync_seq") > state.last_seq), "ops")
        if self.head is not None and not ready(ops, self.head()):
            raise NotReady("the dependency is behind this page")
        found = settle(resolve_ops(ops, self.names()), "resolved")
        lost = unresolved(found)
        if self.missing == "exit" and lost.limit(1).count():
            raise LookupError("an operation names a post this node doesn't have")
        if self.aside:
            lost.write.mode("overwrite").parquet(f"{self.aside}/batch={batch_id}")
        state = advance(state, found)
        self.store.append(
            ops_change(found), last_block=state.last_block, skipped_op_count=state.skipped_ops, feed_seq=state.last_seq,
            inserts=state.inserts, deletes=state.deletes, max_visible_sync_seq=state.last_seq,
        )

    def writer(self, feed: DataFrame, checkpoint: str) -> DataStreamWriter:
        return feed.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
