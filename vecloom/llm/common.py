"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach.

    It is the session's spark.checkpoint.dir. Where a session has none, a folder of this machine is set in local mode, in
    which all executors are this machine; a cluster's session must name one.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), f"vecloom-{uuid.uuid4().hex}"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: its lineage ends, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow with a function that is set up once for each task."""

    def run(batches):
        step = start()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text_at: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batch, in pieces of about most_bytes of text, so that a worker's memory stays level."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def where_text(docs: DataFrame, text_col: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of docs, with all their columns, for whose text the function that start() makes says True; without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        judge = start()
        for batch in batches:
            for part in slices(batch, at):
                kept = part.filter(pa.array(judge(part.column(at).to_pylist()), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)


def row_key(*columns, seed: int = 0):
    """A seeded hash of the columns' values, nulls told apart: the same wherever and whenever a row is read."""
    own = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(F.lit(seed), *own, *(c.isNull() for c in own))


def drawn(docs: DataFrame, label, id_col: str, text_col: str, most: int, seed: int, most_labels: int = 256) -> DataFrame:
    """(id, label, text): at most `most` documents of each label, in a seeded order, of rows with a label and a text.

    label is a column of docs, or a frame (id, label) with one row an id. Of more than most_labels labels, those with the
    most documents are taken, ties in their order. Rows of the same id and text are one document. What is ranked holds no
    texts, and one row a document, folded before the shuffle; the texts of the chosen ones are then picked, and folded too.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([] if isinstance(label, DataFrame) else [label.alias("label")])).where("text is not null")
    keyed = keyed.withColumn("key", row_key("id", "text", seed=seed))
    if isinstance(label, DataFrame):
        offered = keyed.select("id", "key").distinct().join(label, "id").select("label", "key")
    else:
        offered = keyed.where("label is not null").select("label", "key").distinct()
    order = Window.partitionBy("label").orderBy("key")
    ranked = cut(offered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("label", "key"))
    labels = ranked.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_labels)
    few = ranked.join(F.broadcast(labels.select("label")), "label", "left_semi")  # at most `most` rows for each of most_labels
    picked = keyed.select("id", "text", "key").join(F.broadcast(few), "key")
    return picked.groupBy("label", "key").agg(F.first("id").alias("id"), F.first("text").alias("text")).select(F.col("id").cast("string").alias("id"), "label", "text")
