"""Importance resampling towards a target distribution, scored without exploding documents.

Each document becomes an array of buckets, the CRC-32 of its word runs modulo ``buckets``, by higher-order functions.
The target (a benchmark) and the corpus are counted per bucket; a bucket's gain is the floor of 1,000 times the
log of the ratio of their smoothed frequencies. A document's weight adds up the gains of its buckets: an ``aggregate`` over
``element_at`` of one literal array. Weight plus a hash-seeded Gumbel draw is the score, and the highest scores are a
sample without replacement by importance.

Bucket arrays are kept once (two bytes a feature), so texts are read and matched once. Only counts are shuffled, a row per
bucket and task, and, for the ranks, the score and id of each document that may be drawn: these are sorted by ranges, and a
row's rank is its place in its range plus the rows of the ranges before. The driver sees the gains (as many as there are
buckets) and a count per range.

Cases: null and empty texts have no features, weight 0, and can't be drawn; ties of score go to the smaller doc_id (null
last, then as the table has them), and rows equal in all are drawn each by itself; a null doc_id draws as the
empty id; without a target all gains are what its smoothing says; an empty table gives an empty result; texts of any length
are counted whole. Only doc_id and text are read, so extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, text_of

#: Words: runs of digits, small letters and all that isn't ASCII, after lower-casing A-Z.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Values of the first eight hex digits of a SHA-256.
DRAWS = 4294967296


def words_of(text: str = "text") -> Column:
    """The words of the whole text, A-Z lower-cased; none for a null text."""
    return F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(WORDS), 0)


def buckets_of(words: Column, buckets: int, longest: int = 1) -> Column:
    """The bucket of every run of 1 to ``longest`` consecutive words."""
    width = "smallint" if buckets <= 1 << 15 else "int"
    bucket = lambda gram: (F.crc32(gram) % buckets).cast(width)
    runs = [F.transform(words, bucket)]

    def of(n: int) -> Column:
        last = F.size(words) - (n - 1)
        begins = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(*runs, *map(of, range(2, longest + 1)))


def featured(docs: DataFrame, buckets: int, longest: int = 1) -> DataFrame:
    """doc_id, n_words, features (the document's buckets, one for each run) of every row."""
    rows = docs.select("doc_id", words_of().alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), buckets_of(F.col("w"), buckets, longest).alias("features"))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, n over all rows of ``featured``; added up in each task before anything is shuffled."""
    return rows.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket from the counts (bucket, n) of both sides, smoothed by one a bucket; ``buckets`` numbers."""
    spark = corpus.sparkSession
    s, t = (x.select(F.col("bucket").cast("long").alias("id"), F.col("n").alias(k)) for x, k in ((corpus, "s"), (target, "t")))
    per = spark.range(buckets).join(s, "id", "left").join(t, "id", "left").na.fill(0, ["s", "t"])
    per = per.withColumns({"all_s": F.sum("s").over(Window.partitionBy()), "all_t": F.sum("t").over(Window.partitionBy())})
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    rows = per.select("id", F.floor(F.log(ratio) * 1000).alias("gain")).collect()
    return [r["gain"] for r in sorted(rows, key=lambda r: r["id"])]


def weight_of(features: Column, gain: list[int]) -> Column:
    """The sum of gains over an array of buckets; the gains are one literal, folded by the optimiser."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate(features, F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b.cast("int") + 1))


def noise(seed: int, doc_id: str = "doc_id") -> Column:
    """1,000 times a Gumbel draw, floored, that seed and id decide."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(DRAWS)
    return F.floor(F.log(-F.log(u)) * -1000)


def ranked(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``rows`` (doc_id, score) with rank among the floor(share of all) highest scores, null beyond."""
    in_order = cut(rows.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    placed = in_order.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted(placed.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    if not total:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    first = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    placed = placed.join(small_side(first, len(before)), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1)
    taken = total * share[0] // share[1]
    return placed.withColumn("rank", F.when(F.col("rank") <= taken, F.col("rank"))).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, least: int = 20, share: tuple[int, int] = (10, 100), seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; those with a rank are the sample.

    ``target`` has a column text. ``share`` of the documents with at least ``least`` words are drawn.
    """
    rows = cut(featured(docs, buckets, longest))
    gain = gains(bucket_counts(rows), bucket_counts(featured(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest)), buckets)
    rows = rows.select("doc_id", "n_words", F.size("features").cast("long").alias("n_features"), weight_of(F.col("features"), gain).alias("weight"))
    rows = cut(rows.withColumn("score", F.col("weight") + noise(seed)))
    drawn = ranked(rows.where(F.col("n_words") >= least), share)
    rest = rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
