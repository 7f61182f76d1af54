"""Mixing sources to target weights, with DataFrame functions only.

Tokens are added up per source, targets are set from weights under a cap on repetition, and each document is taken
``floor(rate)`` times plus one Bernoulli copy whose probability is the fraction of the rate.

A document's draw is a hash of seed, doc_id and text read as a number in [0, 1). Draws are counted into ``DRAW_BINS`` bins
per source and class of sizes (``CLASSES`` to a doubling), and a document gets its copy if its bin is below the class's
cut. How many copies a class takes is its fraction, rounded along the classes of a source from a hash-seeded
start; the cut is the bin at which it has them, and the bin that it falls in is taken whole or not at all, by a draw
whose chance makes the expected number exact. Draws within a class are exchangeable, so each document's chance
is exactly the fraction, whatever its size, while sources of a few dozen documents come near their targets too,
up to the size of a document that outweighs them. What is shuffled and broadcast is a row per source, class and bin; documents never move.

Cases: a null text has no words; sources go by code point with null last; a source without words gets target 0
and rate 0, as do its documents; rows equal in doc_id and text draw alike; very long texts are one document
like any other; an empty table gives an empty result. Extra columns stay, also when they are named as
the added ones (these are then prefixed by underscores, see ``plan_columns``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, small_side, without

#: Bits of a draw; a double holds them exactly.
DRAW_BITS = 48
#: Bins of a class's draws, and classes of sizes to a doubling.
DRAW_BINS, CLASSES = 1024, 2
#: No source, and no document, is taken more often than this.
MOST_REPEATS = 3.0


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST_REPEATS) -> DataFrame:
    """Per source of ``sizes`` (source, size): source_size, weight, target and rate.

    Sources in code point order, null last, weigh by ``weights`` in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size, and the excess is shared again by weight until no
    target is above. The end of that process is known in closed form: with sources in order of
    cap/weight, the capped ones are a prefix, and the rest share what the prefix leaves. The windows
    without a partition see a row per source, never documents.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("weight", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("open", F.col("left") * F.col("weight") <= F.col("cap") * F.col("weight_left"))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "left", "weight_left"))).over(every))
    )
    share = F.col("first_open.left") * F.col("weight") / F.col("first_open.weight_left")
    target = F.when(F.col("first_open").isNull() | (F.col("cap") < share), F.col("cap")).otherwise(share)
    target = F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))
    return per.withColumn("target", target).select(
        "source", "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def plan_columns(docs: DataFrame) -> list[str]:
    """What ``mix_plan`` names its columns size, source_size, target, copies; prefixed if ``docs`` has such names."""
    return without(docs.columns, "size", "source_size", "target", "copies")


def draw(seed: int, *key: str) -> Column:
    """A number in [0, 1) that seed and key alone decide; nulls count as values."""
    bits = F.xxhash64(F.lit(seed), *[x for k in key for x in (F.col(k).isNull(), F.col(k))])
    return F.pmod(bits, F.lit(1 << DRAW_BITS)) / F.lit(float(1 << DRAW_BITS))


def _places(seed: int) -> dict[str, Column]:
    """Of a row with doc_id and text: its size, the class of that, and the bin of its draw."""
    size = n_words()
    return {"size": size, "class": F.coalesce(F.floor(F.log2(size + 1) * CLASSES).cast("int"), F.lit(0)), "bin": F.floor(draw(seed, "doc_id", "text") * DRAW_BINS).cast("int")}


def cuts(hist: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """source, class, source_size, target, rate and cut (bins below it get the extra copy) from ``hist`` (source, class, bin, n)."""
    t = targets.select(F.col("source").alias("of"), "source_size", "target", "rate")
    rows = hist.join(small_side(t), hist["source"].eqNullSafe(F.col("of"))).drop("of")
    upto = Window.partitionBy("source", "class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
    part, larger = F.col("rate") - F.floor("rate"), Window.partitionBy("of").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.groupBy(F.col("source").alias("of"), F.col("class").alias("level")).agg(F.sum("n").alias("all"))
    sums = sums.withColumn("so_far", F.sum("all").over(larger))
    rows = rows.join(small_side(cut(sums)), rows["source"].eqNullSafe(F.col("of")) & (F.col("class") == F.col("level")))
    steps = lambda n: F.floor(draw(seed + 1, "source") + n * part)
    want = steps(F.col("so_far")) - steps(F.col("so_far") - F.col("all"))
    rows = rows.where(((F.col("before") < want) & (want <= F.col("upto"))) | ((want == 0) & (F.col("before") == 0)))
    whole = draw(seed + 2, "source", "class") < (want - F.col("before")) / F.col("n")
    return rows.select("source", "class", "source_size", "target", "rate", (F.col("bin") + whole.cast("int")).alias("cut"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST_REPEATS, seed: int = 17) -> DataFrame:
    """``docs`` with each row's size in words, its source's size and target, and how many copies the mix takes."""
    size, source_size, target, copies = plan_columns(docs)
    at = _places(seed)
    hist = docs.select("source", *[c.alias(k) for k, c in at.items()]).groupBy("source", "class", "bin")
    hist = cut(hist.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    plan = cut(cuts(hist, cut(source_targets(hist.select("source", "size"), weights, most)), seed))
    key, level, bin_, rate, end = without([*docs.columns, size, source_size, target, copies], "k", "level", "bin", "rate", "end")
    names = {"source": key, "class": level, "source_size": source_size, "target": target, "rate": rate, "cut": end}
    plan = plan.select(*[F.col(a).alias(b) for a, b in names.items()])
    (own,) = without([*docs.columns, *plan.columns, size, copies, bin_], "own")
    rows = docs.withColumns({size: at["size"], own: at["class"], bin_: at["bin"]})
    rows = rows.join(small_side(plan), docs["source"].eqNullSafe(F.col(key)) & (F.col(own) == F.col(level)))
    rows = rows.withColumn(copies, (F.floor(rate) + (F.col(bin_) < F.col(end)).cast("long")).cast("long"))
    return rows.select(*docs.columns, size, source_size, target, copies)


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST_REPEATS, seed: int = 17) -> DataFrame:
    """The mixed table: the rows of ``docs``, each as often as its plan says, with the columns of ``docs``."""
    copies = plan_columns(docs)[3]
    plan = mix_plan(docs, weights, most, seed).where(F.col(copies) > 0)
    (one,) = without(plan.columns, "copy")
    return plan.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def mixed(docs: DataFrame) -> DataFrame:
    """The digest of the mix: doc_id, size, source_size, target, taken."""
    plan = mix_plan(docs.select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
