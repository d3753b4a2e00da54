"""A stream of node snapshots: each micro-batch is compared with the stored snapshot, which then becomes the new one.

An addition of this engine; the batch semantics are those of operators.incremental.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodegraph.operators.incremental import detect_changes
from lodegraph.operators.tables import last_wins, upsert

SNAPSHOT = "node_id string, content_hash string, rel_path string"


def apply_batch(spark: SparkSession, batch: DataFrame, store: str, epoch: int) -> None:
    """Write the changes of one batch and the next snapshot under their epoch, so a batch run again writes the same.

    A batch holds deliveries of (node_id, content_hash, rel_path, indexed_at); nodes it doesn't name are unchanged.
    """
    before = f"{store}/snapshot/epoch={epoch - 1}"
    exists = spark._jvm.org.apache.hadoop.fs.Path(before).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(before))
    old = spark.read.schema(SNAPSHOT).parquet(before) if exists else spark.createDataFrame([], SNAPSHOT)
    new = last_wins(batch, ["node_id"], "indexed_at").select("node_id", "content_hash", "rel_path")
    touched = old.join(new.select("node_id"), "node_id", "left_semi")
    detect_changes(touched, new).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{store}/changes/epoch={epoch}")
    upsert(old, new, ["node_id"]).write.mode("overwrite").parquet(f"{store}/snapshot/epoch={epoch}")


def start(stream: DataFrame, store: str, **options) -> StreamingQuery:
    """Run `apply_batch` on every micro-batch of a stream."""
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(lambda df, epoch: apply_batch(spark, df, store, epoch)).option("checkpointLocation", os.path.join(store, "checkpoint"))
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.trigger(availableNow=True).start()


def dedup_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event deliveries once each within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
