"""Exact top-k search: tiled matrix products of queries and shards, partial selection, tree merging.

Vectors are quantised to integers, floor(256 * x); scores are integer inner products and exact. Candidates are
dealt into shards of bounded size by a hash of the row, and every query is sent to every shard: an equi-join on the shard,
in which a task holds the candidates of one shard and streams the queries past it in tiles, one matrix product per
tile. Of each product the best k + 1 per query stay (the query's own row may be among them), and the lists are merged in a
tree of windows, ``FAN`` shards at a time. Neither queries nor candidates ever come to the driver.

Cases: vectors that are null, or hold a null or non-finite component, take no part; a query only meets vectors of
its own length; ties go to the smaller vec_id (null last); repeated rows are candidates of their own, and a query
leaves out just one row equal to it, its own; fewer candidates than k give all there are. Scores that leave the
range of a long are clamped to it. Vectors of any length take part, long ones in smaller shards; an empty table
gives an empty result; only vec_id and embedding are read, so extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 256.0
#: Bytes of candidates, as doubles, that a shard has on average.
SHARD_BYTES = 64 << 20
#: Queries by candidates in one matrix product.
TILE_QUERIES, TILE_ROWS = 512, 4096
#: Partial lists that one step of the merge brings together.
FAN = 64


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (the floors of 256 x as doubles, which hold them exactly) and its hash, of vectors that take part."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    large = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    v = F.when(F.exists("embedding", lambda x: F.abs(x) >= 2.0**54), large).otherwise(scaled)  # doubles that large are whole
    rows = vectors.where(fine).select("vec_id", v.alias("vec"))
    return rows.select("vec_id", "vec", F.xxhash64("vec").alias("vec_hash"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row of scores, the columns of the k best, ties to the smaller id."""
    if scores.shape[1] > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    else:
        floor = np.full(scores.shape[0], -np.inf) if scores.dtype != object else scores.min(axis=1)
    out = []
    for row, low in zip(scores, floor, strict=True):
        at = np.flatnonzero(row >= low)
        out.append(at[np.lexsort((ids[at], -row[at]))[:k]])
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as int64: in doubles where these are exact, else with Python's integers, clamped."""
    most = (np.abs(q).max(initial=0.0)) * (np.abs(c).max(initial=0.0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    big = whole(q).reshape(q.shape) @ whole(c).reshape(c.shape).T
    return np.frompyfunc(lambda x: max(-(2**63) + 1, min(2**63 - 1, x)), 1, 1)(big).astype(np.int64)


class _Shard:
    """The candidates of one shard, by length of vector, in tiles."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.packed: dict[int, tuple[np.ndarray, ...]] | None = None

    def add(self, size: np.ndarray, vec: np.ndarray, begin: np.ndarray, *more: np.ndarray) -> None:
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            self.held.setdefault(d, []).append((vec[begin[own][:, None] + np.arange(d)] if d else np.zeros((own.size, 0)), *(x[own] for x in more)))

    def best(self, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(row of q, score, id, id is null, hash) of the k best candidates of each query in q."""
        if self.packed is None:
            self.packed = {d: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for d, parts in self.held.items()}
        if q.shape[1] not in self.packed:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool, np.int64))
        c, ids, none, hashes = self.packed[q.shape[1]]
        rows, scores, at = [], [], []
        for c0 in range(0, len(c), TILE_ROWS):
            s = _products(q, c[c0 : c0 + TILE_ROWS])
            for i, cols in enumerate(_best(s, ids[c0 : c0 + TILE_ROWS], k)):
                rows.append(np.full(cols.size, i))
                scores.append(s[i, cols])
                at.append(cols + c0)
        row, score, at_ = (np.concatenate(x) for x in (rows, scores, at))
        order = np.lexsort((ids[at_], -score, row))
        row, score, at_ = row[order], score[order], at_[order]
        first = np.searchsorted(row, row)  # where this query's list begins
        keep = np.arange(row.size) - first < k
        at_ = at_[keep]
        return row[keep], score[keep], ids[at_], none[at_], hashes[at_]


def _partial_lists(rows: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """(q, part, score, vec_id, vec_hash): the k best of every shard for every query."""
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "vec_hash"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("q"), "vec_id", "vec_hash", "vec")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "q", F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("vec_hash"), "vec")
    both = dealt.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", F.col("q").asc_nulls_first())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, _Shard()
        for b in batches:
            of, q_none = b.column("shard").to_numpy(zero_copy_only=False), b.column("q").is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (q_none[1:] != q_none[:-1]), [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = b.slice(lo, hi - lo)
                vec = part.column("vec")
                size = vec.value_lengths().to_numpy(zero_copy_only=False)
                flat = vec.flatten().to_numpy(zero_copy_only=False)
                begin = np.cumsum(size) - size
                if of[lo] != now:
                    now, shard = of[lo], _Shard()
                if q_none[lo]:
                    ids = part.column("vec_id")
                    shard.add(size, flat, begin, ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), part.column("vec_hash").to_numpy(zero_copy_only=False))
                    continue
                qids = part.column("q").to_numpy(zero_copy_only=False)
                for d in np.unique(size).tolist():
                    own = np.flatnonzero(size == d)
                    for k0 in range(0, own.size, TILE_QUERIES):
                        at = own[k0 : k0 + TILE_QUERIES]
                        row, score, ids, none, hashes = shard.best(flat[begin[at][:, None] + np.arange(d)] if d else np.zeros((at.size, 0)), k)
                        cols = [pa.array(qids[at][row]), pa.array(np.full(row.size, now, np.int32)), pa.array(score), pa.array(ids, mask=none), pa.array(hashes)]
                        yield pa.RecordBatch.from_arrays(cols, ["q", "part", "score", "vec_id", "vec_hash"])

    return both.mapInArrow(scan, "q long, part int, score long, vec_id long, vec_hash long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = cut(quantised(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")))
    queries = cut(rows.where(F.col("vec_id") % every == 0).withColumn("q", F.monotonically_increasing_id()))
    total = rows.agg(F.coalesce(F.sum(F.size("vec") * 8 + 32), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    found = _partial_lists(rows, queries, parts, k + 1)
    best = lambda *by: Window.partitionBy("q", *by).orderBy(F.desc("score"), F.col("vec_id").isNull(), "vec_id", "vec_hash")
    while parts > FAN:
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        found = found.withColumn("n", F.row_number().over(best("part"))).where(F.col("n") <= k + 1).drop("n")
        parts = -(-parts // FAN)
    found = found.withColumn("n", F.row_number().over(best())).where(F.col("n") <= k + 1)
    own = queries.select("q", F.col("vec_id").alias("query_id"), F.col("vec_hash").alias("own_hash"))
    found = found.join(own, "q").withColumn("same", (F.col("vec_id") == F.col("query_id")) & (F.col("vec_hash") == F.col("own_hash")))
    first = F.min(F.when(F.col("same"), F.col("n"))).over(Window.partitionBy("q"))
    found = found.withColumn("first", first).where(F.col("first").isNull() | (F.col("n") != F.col("first")))
    rank = F.when(F.col("n") > F.col("first"), F.col("n") - 1).otherwise(F.col("n"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
