"""Helpers that the operators share: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 50_000

#: What separates words in the contracts on whole texts: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, read through Spark so that any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) one below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, what is run (and cut) passes at most so many rows at a time to Python: rows that hold whole texts or sets are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that only cut lineage used: Spark removes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it; otherwise Spark shuffles both sides.

    ``df`` should be cut before, since it is counted when ``rows`` isn't given.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """How many words the whole text has; 0 for a null text."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def fold_of(key: str, parts: int) -> Column:
    """Remainder of the CRC-32 of a key written as text; null keys have the fold of the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def without(taken: list[str], *names: str) -> list[str]:
    """Names that don't clash with those taken: underscores go before a name until it is free."""
    low = {x.lower() for x in taken}
    out = []
    for x in names:
        while x.lower() in low:
            x = f"_{x}"
        low.add(x.lower())
        out.append(x)
    return out
