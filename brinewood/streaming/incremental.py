"""Incremental indexing as a stream of files: what a checkpoint has seen is never worked on again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def index_folder(
    spark: SparkSession, folder: str, schema: StructType, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, fmt: str = "parquet", errors: str | None = None
) -> StreamingQuery:
    """Work on every new file of a folder once and append what comes out to ``target``; ends when all is done.

    Each micro-batch replaces a folder of its own number, so a batch that is run again after a failure leaves no
    duplicates. ``work`` may give a column ``error``; such rows go to ``errors``, and the rest goes on.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        out = work(batch)
        if errors and "error" in out.columns:
            out = out.persist()
            out.where("error is not null").write.mode("overwrite").parquet(f"{errors}/batch={number}")
            out.where("error is null").drop("error").write.mode("overwrite").parquet(f"{target}/batch={number}")
            out.unpersist()
        else:
            out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
