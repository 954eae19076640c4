"""ST1: score a stream of entity records with the batch scorecard code.

The same defaults -> validation -> score -> advice projection runs on a
``readStream`` source; it is stateless, so append mode needs no watermark.
Valid predictions and rejected records go to two sinks from one
``foreachBatch`` so each micro-batch is written exactly once per epoch
(idempotent overwrite of the epoch's folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shopcast.operators.scoring import prepare, score


def scored_stream(records: DataFrame, kind: str, key: str) -> DataFrame:
    """Streaming DataFrame of prediction records (valid rows only)."""
    ok, _ = prepare(records, kind)
    return score(ok, kind).select(key, "probability", "prediction", "label", "threshold", "recommendations")


def start_scoring(spark: SparkSession, source_dir: str, schema: T.StructType, kind: str, key: str,
                  out_dir: str, checkpoint_dir: str, available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start ST1 over parquet files arriving in ``source_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    records = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # two sinks from one micro-batch: read the batch once
        batch = batch.persist()
        try:
            ok, bad = prepare(batch, kind)
            (score(ok, kind).select(key, "probability", "prediction", "label", "threshold", "recommendations")
             .write.mode("overwrite").parquet(f"{out_dir}/predictions/epoch={epoch}"))
            (bad.withColumn("errors", F.array_join("errors", "|"))
                .write.mode("overwrite").parquet(f"{out_dir}/rejected/epoch={epoch}"))
        finally:
            batch.unpersist()

    writer = records.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
