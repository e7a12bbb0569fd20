"""Keep a table of file versions, or a whole index, in step with an append-only change feed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.indexing import empty_index, load_index, update_index
from skein.session import cut
from skein.sources.store import BUCKETS, Change, current_version, pointers, publish, publish_changes


def latest_versions(changes: DataFrame, order: Sequence[str]) -> DataFrame:
    """The last version of every path by ``order``: an aggregate, so a path with most of the changes
    is one row per map task before the shuffle."""
    rest = [c for c in changes.columns if c != "file_path"]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return changes.groupBy("file_path").agg(last).select("file_path", *[F.col(f"_last.{c}").alias(c) for c in rest])


def _feed_of(batch: DataFrame, feed: str | None) -> str:
    """The given name, else the id of the streaming query, which a checkpoint keeps and a new checkpoint changes."""
    return feed or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def _already_done(spark, root: str, feed: str, batch_id: int) -> bool:
    same = (F.coalesce(F.col("feed"), F.lit("")) == feed) & (F.col("source_batch") == batch_id)
    return not pointers(spark, root).filter(same).isEmpty()


def apply_versions(root: str, order: Sequence[str], feed: str | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: merge a batch of ``file_path, content, <order>`` into the ``versions`` table.

    The order columns stay in the table, so a batch that arrives late does not undo a newer version.
    A replayed batch is known by its feed and id. Batch ids start anew with every checkpoint, so a feed is the
    streaming query of one checkpoint unless it is named. Only buckets of paths in the batch are read and written.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = _feed_of(batch, feed)
        if _already_done(spark, root, name, batch_id):
            return
        base = current_version(spark, root)
        if base is None:
            publish(root, {"versions": latest_versions(batch, order)}, source_batch=batch_id, feed=name, buckets=buckets)
            return
        newest = cut(latest_versions(batch, order), "feed")
        change = Change(newest.select(F.col("file_path").alias("key")), lambda old: latest_versions(old.unionByName(newest), order))
        publish_changes(spark, root, base, {"versions": change}, source_batch=batch_id, feed=name)

    return merge


def apply_to_index(root: str, order: Sequence[str], feed: str | None = None, **options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: update the index published below ``root`` with the changed files of a batch.

    Within a batch the last version of a path wins; batches are taken in feed order. ``options`` go to
    ``update_index``; ``feed`` is that of ``apply_versions``.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = _feed_of(batch, feed)
        if _already_done(spark, root, name, batch_id):
            return
        index = empty_index(spark) if current_version(spark, root) is None else load_index(spark, root)
        newest = cut(latest_versions(batch, order).select("file_path", F.col("content").cast("binary").alias("content")), "feed")
        update_index(index, newest, **options).publish(root, source_batch=batch_id, feed=name)

    return merge


def run_feed(changes: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> None:
    """Run ``body`` over a streaming ``changes`` DataFrame; by default until what is there is done."""
    writer = changes.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
