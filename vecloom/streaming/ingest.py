"""Continuous checking and loading of rows into a split; an extension to the batch API."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.validate import conform, violations
from vecloom.schema import Schema


def source(spark: SparkSession, path: str, schema: Schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in path."""
    return spark.readStream.schema(schema.struct()).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


def ingest(stream: DataFrame, schema: Schema, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Adds valid rows to the folder accepted, and (pk, field, rule) of what others break to rejected.

    Each micro-batch is written to a folder of its own number, so that one that is run again replaces itself. It ends when
    all that is there has been read.
    """

    pk = schema.primary
    if pk is None:
        raise ValueError("a primary key tells rejected rows")

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            broken = violations(batch, schema)
            broken.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            good = batch.join(broken.select(F.col("pk").alias("_pk")).distinct(), F.col(f"`{pk.name}`").cast("string").eqNullSafe(F.col("_pk")), "left_anti")
            conform(good, schema).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
