"""Files known by their content: hashes that are kept, so that a file is read once for each state it has had.

The table of hashes has a row per file and state (path, size, time of change). A folder is listed without reading contents; states that the table
doesn't know are found by an anti-join, only those files are read, in lots, and their hashes are appended. A file that was renamed
or copied is found again by its hash.

Cases: an empty folder gives an empty table; empty files are left out, as Spark's reader leaves them out; files that went are left out, since the listing leads; a file edited in place has another state and is read again; a run that
was broken off leaves whole lots, and the next one goes on from there; a file of ``LONG`` bytes or more is read in pieces; the paths of new files go through the driver (as Spark's own listing does), contents never.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.sources.store import shared_folder

STATE = ["path", "size", "modified"]
#: Files that one job reads.
LOT = 5_000
#: Bytes from which on a file isn't read as one value (Spark's reader refuses 2 GB) but in pieces, and names that Spark would unpack on the way.
LONG, PACKED = 1 << 29, r"(?i)\.(gz|bz2|zst|lz4|snappy|deflate|lzo|xz)$"


def listing(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """path, size, modified of the files below a folder, in any case of the suffix, hidden ones aside; no content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return raw.where(F.lower("path").endswith(suffix.lower()) & ~F.substring_index("path", "/", -1).rlike(r"^[._]"))


def known(spark: SparkSession, place: str) -> DataFrame:
    """path, size, modified, sha256 that were kept at ``place``."""
    try:
        return spark.read.parquet(place)
    except AnalysisException:
        return spark.createDataFrame([], "path string, size long, modified timestamp, sha256 string")


def content_hashes(spark: SparkSession, folder: str, suffix: str = "", place: str | None = None) -> DataFrame:
    """path, size, modified, sha256 of the files below a folder; only files in a state that ``place`` doesn't know are read."""
    place = place or f"{shared_folder(spark)}/kept/hashes"
    files = listing(spark, folder, suffix)
    in_pieces = (F.col("size") >= LONG) & ~F.col("path").rlike(PACKED)
    states = [*files.join(known(spark, place), STATE, "left_anti").select("path", "size", in_pieces.alias("long")).distinct().toLocalIterator()]
    new = [r.path for r in states if not r.long]
    for at in range(0, len(new), LOT):
        read = spark.read.format("binaryFile").load(new[at : at + LOT])
        read.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")).write.mode("append").parquet(place)
    for r in states:
        if r.long:
            own = files.where((F.col("path") == r.path) & (F.col("size") == r.size))
            own.withColumn("sha256", F.lit(hash_of_long(spark, r.path, r.size))).write.mode("append").parquet(place)
    return files.join(known(spark, place).dropDuplicates(STATE), STATE)


def hash_of_long(spark: SparkSession, path: str, size: int) -> str:
    """SHA-256 of a file that is too long for one value.

    Its bytes come in pieces between line feeds, read in splits and sorted by place; one task, since each step of the digest needs the one before, takes
    them in turn and holds a batch. The reader drops a mark of byte order and a last line feed: the size tells which were there, or that bytes are missing.
    """
    pieces = spark.read.option("lineSep", "\n").text(path)
    pieces = pieces.select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, plain, n = hashlib.sha256(codecs.BOM_UTF8), hashlib.sha256(), -1
        for b in batches:
            if b.num_rows:
                data = b"\n" * (n >= 0) + b"\n".join(b.column("value").to_pylist())
                n = max(n, 0) + len(data)
                marked.update(data)
                plain.update(data)
        missing = size - max(n, 0)
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{missing} of {size} bytes weren't read")
        digest = marked if missing >= 3 else plain
        digest.update(b"\n" * (missing % 3))
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["sha256"])

    return pieces.repartition(1).sortWithinPartitions("split", "at").select("value").mapInArrow(of, "sha256 string").first()[0]


def by_content(hashes: DataFrame) -> DataFrame:
    """sha256, file, n_files: the name a content goes by, the last of its paths, and how many files have it."""
    return hashes.groupBy(F.col("sha256")).agg(F.substring_index(F.max("path"), "/", -1).alias("file"), F.count(F.lit(1)).alias("n_files"))


def with_files(records: DataFrame, hashes: DataFrame, key: str = "hash") -> DataFrame:
    """``records`` with found: the name under which the folder has the file that a record was read from, by content; null if it isn't there."""
    names = by_content(hashes).select(F.col("sha256").alias("_sha"), F.col("file").alias("found"))
    return records.join(names, records[key] == F.col("_sha"), "left").drop("_sha")
