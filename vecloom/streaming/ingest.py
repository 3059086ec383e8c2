"""Ingestion of a stream of posts into the store, block range by block range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import Config
from ..functions.embed import Embedder
from ..operators.store import Store, must_stop


class Stopped(RuntimeError):
    """Processing must pause before this batch; its offsets aren't committed, so a resumed stream begins with it."""


@dataclass
class Ingest:
    """posts arrive as (post_id, title, body, block_num). The pipeline of a batch prepares, embeds and stores it, and publishes last."""

    store: Store
    config: Config
    embed: Embedder
    stop_at: int | None = None

    def batch(self, posts: DataFrame, batch_id: int) -> None:
        """The last version of a post in the batch counts. A redelivered batch replaces its own result. A stop refuses the batch."""
        status = self.store.status()
        why = must_stop(status, status.last_block, self.stop_at)
        if why:
            raise Stopped(why)
        last = posts.groupBy("post_id").agg(F.max_by(F.struct("title", "body", "block_num"), "block_num").alias("p")).select("post_id", "p.*")
        top = last.agg(F.max("block_num").alias("m")).collect()[0].m
        if top is not None:
            self.store.ingest(last, self.config, self.embed, top)

    def writer(self, posts: DataFrame, checkpoint: str, live: bool = False) -> DataStreamWriter:
        """massive: all that is there, then stop; live: keep running."""
        w = posts.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return w.trigger(processingTime="3 seconds") if live else w.trigger(availableNow=True)
