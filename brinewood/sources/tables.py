"""Sources and sinks: record folders, manifests, text lines, binary files, CSV of fixed columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brinewood.operators.catalog import first_wins, last_wins
from brinewood.operators.records import RECORD
from brinewood.sources.store import cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str, schema: StructType = RECORD) -> DataFrame:
    """Record documents, one JSON file each; files that can't be read are left out."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder}/*.json")
    return raw.where(F.col("_corrupt_record").isNull()).withColumn("path", F.input_file_name()).withColumn("hash", F.coalesce("hash", F.regexp_extract("path", r"([^/]+)\.json$", 1)))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest's rows by each of their files; of several rows for a file the last one counts."""
    rows = spark.read.schema(schema).json(path).withColumn("_at", F.monotonically_increasing_id())
    return last_wins(rows.withColumn("file", F.explode("files")), ["file"], ["_at"]).drop("_at", "files")


def files(spark: SparkSession, folder: str, suffix: str = "pdf", content: bool = False) -> DataFrame:
    """path, size, modified (and sha256 of the content) of files, in any case of the suffix, hidden folders left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    raw = raw.where(F.lower("path").endswith(f".{suffix.lower()}") & ~F.col("path").rlike(r"/\.[^/]+"))
    cols = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return raw.select(*cols, *([F.sha2("content", 256).alias("sha256")] if content else []))


def csv_field(c: Column) -> Column:
    """A value as one CSV field: quoted only where it has to be."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in columns])


def write_csv(df: DataFrame, path: str, crlf: bool = False) -> None:
    """CSV files with a header; ``crlf`` for line ends of two characters."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\r\n" if crlf else "\n").option("emptyValue", "").csv(path)


def write_records(df: DataFrame, path: str, key: str = "hash") -> None:
    """Records as a table of one partition per prefix of the key; only the partitions written are replaced."""
    df.withColumn("shard", F.substring(key, 1, 2)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def safe_name(c: Column) -> Column:
    """A file name: letters, digits, hyphens and underscores stay, anything else is a hyphen."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\-_]", "-")


def folders(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """kind, name: what one folder shows: the folders in it that hold such files at any depth, then its own files, by name whatever the case."""
    base = folder.rstrip("/")
    below = files(spark, base, suffix).select(F.substring_index(F.col("path"), f"{base}/", -1).alias("rel"))
    inside = below.where(F.col("rel").contains("/")).select(F.lit("folder").alias("kind"), F.substring_index("rel", "/", 1).alias("name")).distinct()
    own = below.where(~F.col("rel").contains("/")).select(F.lit("file").alias("kind"), F.col("rel").alias("name"))
    return inside.unionByName(own).orderBy(F.col("kind") == "file", F.lower("name"), "name")


def upsert_records(fresh: DataFrame, path: str, key: str = "hash") -> None:
    """Put whole records into a record table: those of known keys are replaced, the others stay.

    Only partitions (prefixes of the key) that fresh records fall into are read and written; of fresh records with one key the last by
    ``saved_at`` counts where there is such a column.
    """
    spark = fresh.sparkSession
    order = [F.desc("saved_at")] if "saved_at" in fresh.columns else [key]
    rows = cut(last_of(fresh, key, order).withColumn("shard", F.substring(key, 1, 2)))
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        old = None
    if old is not None:
        touched = old.join(rows.select("shard").distinct(), "shard", "left_semi").join(rows.select(key), key, "left_anti")
        rows = cut(rows.unionByName(touched, allowMissingColumns=True))  # what is read is about to be replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def last_of(rows: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stored_records(spark: SparkSession, path: str, hashes: list[str] | None = None, key: str = "hash") -> DataFrame | None:
    """Records of a record table, those of some keys if asked: only their partitions are read. None if there is no such table."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows if hashes is None else rows.where(F.col("shard").isin([h[:2] for h in hashes]) & F.col(key).isin(hashes))


def write_catalogue(entries: DataFrame, path: str) -> None:
    """Catalogue entries as JSON lines in the order of fundo and index (as text), each key once, the first in order of (source, pos)."""
    first_wins(entries, ["fundo", "series", "index"], ["source", "pos"]).drop("pos").orderBy("fundo", "index").write.mode("overwrite").json(path)
