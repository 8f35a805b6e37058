"""Live mode: feeds dropped into a folder are merged batch by batch.

The file source remembers what it has read in the query's checkpoint, so only new files reach the
merge.  Each batch adds a folder with its new items only; a batch replayed after a failure rewrites
its own folder from the same earlier ones, which makes it safe to run twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutations import new_by_guid
from ..sources.feeds import ITEM_SCHEMA, merge_items


def item_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of merge-read items of every new feed file."""
    raw = spark.readStream.format("xml").option("rowTag", "item").schema(ITEM_SCHEMA).load(folder)
    return merge_items(raw.withColumn("feed_path", F.col("_metadata.file_path")), ["feed_path"])


def watch_feeds(spark: SparkSession, folder: str, store: str, checkpoint: str, once: bool = True):
    """Keep ``store`` up to date with the feeds in ``folder``; returns the running query."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        known = batch.limit(0)
        if batch_id:
            known = spark.read.parquet(store).filter(F.col("batch") < batch_id)
        fresh = new_by_guid(batch, known, ["feed_path", "guid"]).select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    writer = item_stream(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
