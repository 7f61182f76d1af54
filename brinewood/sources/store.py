"""Tables that are kept: built once per state of their source and read from then on, in the folder that the cluster shares.

A kept table's name has a fingerprint of the source's files (paths, sizes, times of change), so a changed source is another
table and an unchanged one is never built again. A table that was begun and not ended has no mark of success
and is built anew.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one below the warehouse only where that is unset (tests, a laptop)."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of what lies at a path: every file's path, size and time of change; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    got = listed.agg(F.count(F.lit(1)).alias("n"), F.expr("coalesce(bit_xor(xxhash64(path, length, modificationTime)), 0)").alias("h")).first()
    return f"{got.n:x}-{got.h % 2**64:016x}"


def kept(spark: SparkSession, name: str, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` that ``build`` makes from what lies at ``path``, from the shared folder if it is there."""
    place = f"{shared_folder(spark)}/kept/{name}-{fingerprint(spark, path)}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(place)
    build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that only cut lineage used: Spark removes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
