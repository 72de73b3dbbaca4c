"""Incremental profiling of arriving datapoint files with Structured Streaming.

A query's features depend on that query alone, so each micro-batch of new
datapoints is profiled with the batch pipeline (``foreachBatch``) and written to its own
folder ``batch_id=n`` of the queries frame, which makes a retried batch harmless; corpus statistics are then read from that table. The stream's
progress lives in ``checkpoint_location`` (a shared folder on a cluster), so a
restarted or failed job resumes without reprocessing or losing files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import sqlfeatures

DATAPOINT_SCHEMA = T.StructType([
    T.StructField("datapoint_id", T.LongType()), T.StructField("dataset", T.StringType()),
    T.StructField("split", T.StringType()), T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("sql_query", T.StringType()),
])


def profile_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_location: str,
                   schema: T.StructType = DATAPOINT_SCHEMA, fmt: str = "json", available_now: bool = False):
    """Start a stream that appends the feature rows (Q31) of every new datapoint file to ``sink_dir``.

    Returns the StreamingQuery. ``available_now`` processes what is there and stops.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # a folder per batch, overwritten: a batch that is tried again leaves its rows once
        sqlfeatures.feature_rows(batch).write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
