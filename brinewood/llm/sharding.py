"""Sharding: a k-d tree over document metadata whose leaves are the shards.

Nodes split at a weighted median of bytes along their widest dimension, until there are as many
leaves as shards (or until leaves reach a target of bytes). Every coordinate is a function of the
text, so equal texts always fall into the same leaf; the hash of the text, as last coordinate,
settles ties, so that a cut passes between any two different texts.

Medians are found exactly and where the rows are: rows are counted into bins of the current range
of every node at once (pre-aggregated, so hot groups of copies shrink before the shuffle), a window
over the bins picks the one that holds the median, and the range narrows to it until the bin is
lighter than the tolerance or holds one key. What comes to the driver is a row per node.

Cases: a null text counts as empty (size 1, CRC-32 0); an empty table gives an empty result; rows
that are equal stay apart by their slots; a group of equal texts heavier than a shard stays whole,
and the other leaves share the rest; doc_id may be null; a very long text is one document of its size;
extra columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, text_of, without

DIMS = ("size", "chars", "lines")
#: Bits of a coordinate, and of the hash that stands behind it in a split key.
COORD_BITS, TIE_BITS = 24, 38
BINS = 1024
#: A median is close enough when its bin has at most this share of the node's bytes.
TOLERANCE = 0.0002
#: Rows per bucket in which slots are numbered.
SLOT_ROWS = 5000


def coordinates() -> dict[str, F.Column]:
    """Bytes + 1, CRC-32, hash, and one integer coordinate per dimension, all of a column text."""
    text = text_of()
    # A logarithmic scale with 2^18 steps per doubling keeps the order of values and evens out long tails.
    level = lambda c: F.least(F.floor(F.log2(c + F.lit(1.0)) * F.lit(2.0**18)).cast("long"), F.lit((1 << COORD_BITS) - 1))
    return {
        "size": F.octet_length(text).cast("long") + 1,
        "text_crc32": F.crc32(text.cast("binary")),
        "hash": F.xxhash64(text),
        "d_size": level(F.octet_length(text)),
        "d_chars": level(F.char_length(text)),
        "d_lines": level(F.regexp_count(text, F.lit("\n"))),
    }


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row per document: its id and ``coordinates``."""
    return docs.select("doc_id", *[c.alias(k) for k, c in coordinates().items()])


def _key(dim) -> F.Column:
    """Coordinate of the node's dimension, then the hash: what a split compares."""
    picked = F.lit(0).cast("long")
    for i, d in enumerate(DIMS):
        picked = F.when(dim == i, F.col(f"d_{d}")).otherwise(picked)
    return F.shiftleft(picked, TIE_BITS) + F.shiftrightunsigned(F.col("hash"), 64 - TIE_BITS)


def _cuts(rows: DataFrame, nodes: dict[int, tuple[float, float, int, int, int]]) -> dict[int, int]:
    """For nodes (share wanted left, weight, dimension, low, high) the largest key that goes left."""
    spark = rows.sparkSession
    state = {k: (share * weight, weight, dim, low, high) for k, (share, weight, dim, low, high) in nodes.items()}
    done: dict[int, int] = {}
    while state:
        ask = spark.createDataFrame([(k, *v) for k, v in state.items()], "node int, want double, weight double, dim int, low long, high long")
        step = F.ceil((F.col("high") - F.col("low") + 1) / F.lit(float(BINS))).cast("long")
        binned = (
            rows.join(F.broadcast(ask), "node").withColumn("key", _key(F.col("dim"))).where(F.col("key").between(F.col("low"), F.col("high")))
            .groupBy("node", "want", F.floor((F.col("key") - F.col("low")) / step).cast("long").alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
        )
        w = Window.partitionBy("node").orderBy("bin")
        summed = binned.withColumn("upto", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        hit = summed.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("bytes") < F.col("want")))
        for r in hit.groupBy("node").agg(F.min(F.struct("bin", "bytes", "first", "last", "upto")).alias("b")).collect():
            want, weight, dim, _, _ = state.pop(r.node)
            b = r.b
            if b.first == b.last or b.bytes <= TOLERANCE * weight:
                nearer = b.upto - want <= want - (b.upto - b.bytes)
                done[r.node] = b["last"] if nearer else b["first"] - 1
            else:
                state[r.node] = (want - (b.upto - b.bytes), weight, dim, b["first"], b["last"])
    return done


Level = list[tuple[int, int, int, int, int, int, int]]


def descend(rows: DataFrame, level: Level) -> DataFrame:
    """Move rows from their nodes to the children: one level of the tree, broadcast as a row per split node."""
    split = rows.sparkSession.createDataFrame(level, "node int, dim int, at long, lnode int, rnode int, lshard int, rshard int")
    left = _key(F.col("dim")) <= F.col("at")
    to = lambda now, a, b: F.when(F.col("at").isNull(), F.col(now)).when(left, F.col(a)).otherwise(F.col(b))
    moved = rows.join(F.broadcast(split), "node", "left")
    moved = moved.withColumns({"shard": to("shard", "lshard", "rshard"), "node": to("node", "lnode", "rnode")})
    return moved.select(*rows.columns)


def rooted(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"node": F.lit(0), "shard": F.lit(0)})


def kd_tree(rows: DataFrame, leaves: int) -> list[Level]:
    """Levels of splits of ``rows`` (of ``metadata``) that end in ``leaves`` leaves, numbered from 0.

    The driver holds one record per node, fewer than twice ``leaves``, which also bounds what is broadcast.
    """
    rows, levels = rooted(rows), []
    span, fresh, whole = {0: (0, leaves)}, 1, {}  # node: first shard, number of shards
    while any(n > 1 for _, n in span.values()):
        facts = rows.groupBy("node").agg(
            F.sum("size").alias("weight"), *[f(f"d_{d}").alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
        )
        ask: dict[int, tuple[float, float, int, int, int]] = {}
        for r in facts.collect():
            n = span.get(r.node, (0, 1))[1]
            if n > 1:
                wide = {i: r[f"hi_{d}"] - r[f"lo_{d}"] for i, d in enumerate(DIMS)}
                whole = whole or {i: max(1, x) for i, x in wide.items()}  # widths of the root
                dim = max(wide, key=lambda i: (wide[i] / whole[i], -i))
                low, high = r[f"lo_{DIMS[dim]}"] << TIE_BITS, ((r[f"hi_{DIMS[dim]}"] + 1) << TIE_BITS) - 1
                ask[r.node] = ((n // 2) / n, float(r.weight), dim, low, high)
        if not ask:
            break  # what is left to split holds no rows
        level: Level = []
        for k, at in _cuts(rows, ask).items():
            first, n = span.pop(k)
            level.append((k, ask[k][2], at, fresh, fresh + 1, first, first + n // 2))
            span[fresh], span[fresh + 1] = (first, n // 2), (first + n // 2, n - n // 2)
            fresh += 2
        span = {k: v for k, v in span.items() if k in {x for m in level for x in m[3:5]}}
        levels.append(level)
        rows = descend(rows, level)
    return levels


def leaves_for(total_bytes: int, target_bytes: int) -> int:
    """How many leaves bring each to at most about ``target_bytes``."""
    return max(1, math.ceil(total_bytes / max(1, target_bytes)))


def number_slots(rows: DataFrame, narrow: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with a slot, gapless from 0 in each shard; ``narrow`` has the same rows for counting.

    Rows are numbered in hashed buckets of about ``SLOT_ROWS``, and each bucket begins where the ones before it
    in its shard end; so no task ever holds a shard.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(max(1, math.ceil(n_rows / SLOT_ROWS)))).cast("int")
    per = narrow.groupBy("shard", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    begin = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = cut(per.select("shard", "bucket", F.coalesce(begin, F.lit(0)).cast("long").alias("begin")))
    within = Window.partitionBy("shard", "bucket").orderBy("hash", "doc_id")
    rows = rows.withColumn("bucket", bucket).withColumn("at", F.row_number().over(within).cast("long") - 1)
    return rows.join(small_side(per), ["shard", "bucket"]).withColumn("slot", F.col("begin") + F.col("at"))


def _placed(rows: DataFrame, narrow: DataFrame, n_shards: int, target_bytes: int | None) -> DataFrame:
    """``rows``, which have the columns of ``metadata``, with shard and slot; ``narrow``: the same rows, cut."""
    total = narrow.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    rows, narrow_ = rooted(rows), rooted(narrow)
    for level in kd_tree(narrow, leaves_for(total.b, target_bytes) if target_bytes else n_shards):
        rows, narrow_ = descend(rows, level), descend(narrow_, level)
    return number_slots(rows, narrow_, total.n)


def shards(docs: DataFrame, n_shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``) for every document.

    ``target_bytes`` sets the number of shards by the bytes that each should get.
    """
    rows = cut(metadata(docs))
    return _placed(rows, rows, n_shards, target_bytes).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """The documents with law, shard and slot, as a pipeline's last stage writes them.

    Columns of ``docs`` keep their names; where one is named as an added one, the added one is prefixed.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", *[c.alias(k) for k, c in coordinates().items()])
    law, shard, slot = without(docs.columns, "law", "shard", "slot")
    placed = _placed(rows, cut(metadata(docs)), n_shards, target_bytes)
    return placed.select("doc.*", F.lit("bytes").alias(law), F.col("shard").cast("int").alias(shard), F.col("slot").alias(slot))
