"""Retrieval quality: recall, margins, error rates, alignment, regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewood.functions.text import similarity

#: Fixed values.
RECALL_AT, NEAR_MARGIN, EPSILON = 10, 0.05, 0.02


def lev_error_rate(observed: Column, truth: Column) -> Column:
    """Edit distance over the truth's length (1 at least)."""
    return F.levenshtein(observed, truth) / F.greatest(F.length(truth), F.lit(1))


def ranks(hits: DataFrame, query: str, truth: str, candidate: str, score: str) -> DataFrame:
    """query, rank of the true candidate, its score, and the margin over the best wrong one."""
    w = Window.partitionBy(query).orderBy(F.desc(score), candidate)
    ranked = hits.withColumn("rank", F.row_number().over(w)).withColumn("_right", F.col(candidate) == F.col(truth))
    best_wrong = F.max(F.when(~F.col("_right"), F.col(score))).over(Window.partitionBy(query))
    return ranked.withColumn("margin", F.col(score) - F.coalesce(best_wrong, F.lit(0.0))).where("_right").select(query, F.col("rank").cast("long").alias("rank"), score, "margin")


def recall(ranked: DataFrame, total: int, at: int = RECALL_AT) -> DataFrame:
    """found, total, recall and the upper median rank, from the number of queries of each rank."""
    per = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.orderBy("rank"))  # one row per rank
    per = per.select("rank", "n", so_far.alias("_upto"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    found = F.coalesce(F.sum(F.when(F.col("rank") <= at, F.col("n"))), F.lit(0))
    middle = F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1, F.col("rank")))
    share = F.when(F.lit(total) > 0, found / F.lit(total))
    return per.agg(found.alias("found"), F.lit(total).cast("long").alias("total"), share.alias("recall"), middle.alias("median_rank"))


def margins(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.avg("margin").alias("mean_margin"), F.min("margin").alias("least_margin"), F.avg((F.col("margin") < NEAR_MARGIN).cast("double")).alias("near_share"))


def compare(before: DataFrame, after: DataFrame, key: list[str], value: str, epsilon: float = EPSILON) -> DataFrame:
    """How many keys improved and regressed by more than ``epsilon``, and the means."""
    both = before.select(*key, F.col(value).alias("b")).join(after.select(*key, F.col(value).alias("a")), key)
    d = F.col("a") - F.col("b")
    return both.agg(
        F.count_if(d > epsilon).alias("improved"), F.count_if(d < -epsilon).alias("regressed"), F.count(F.lit(1)).alias("compared"), F.avg("b").alias("mean_before"), F.avg("a").alias("mean_after")
    )


def best_offset(read: DataFrame, truth: DataFrame, key: list[str], pos: str, text: str, most: int) -> DataFrame:
    """key, shift, cost: the shift of read rows against true ones with the least summed error, the smallest of equals.

    True rows meet the read rows of every shift up to ``most`` through an equi-join on the shifted position.
    """
    shifted = truth.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("at", F.col(pos) + F.col("shift"))
    b = read.select(*key, F.col(pos).alias("at"), F.col(text).alias("_read"))
    both = shifted.join(b, [*key, "at"], "left")
    each = F.when(F.col("_read").isNull(), F.lit(1.0)).otherwise(lev_error_rate(F.col("_read"), F.col(text)))
    per = both.groupBy(*key, "shift").agg(F.round(F.sum(each), 6).alias("cost"))
    return per.groupBy(*key).agg(F.min(F.struct("cost", "shift")).alias("m")).select(*key, F.col("m.shift").cast("long").alias("shift"), F.col("m.cost").alias("cost"))


#: How far a name column and a number of rows may be off, and the similarity at which a search would find a name.
COLUMN_OFF, ROWS_OFF, LEAST_ROWS_OFF, FINDABLE = 0.03, 0.10, 2, 0.10


def golden(want: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """key, faults: what of a measured page (printed, left, right, rows) departs from what it should be; a page that isn't printed is only that."""
    names = ["printed", "left", "right", "rows"]
    both = want.select(*key, *[F.col(c).alias(f"w_{c}") for c in names]).join(got.select(*key, *[F.col(c).alias(f"g_{c}") for c in names]), key, "left")
    w, g = (lambda c: F.col(f"w_{c}")), (lambda c: F.col(f"g_{c}"))
    other = ~w("printed").eqNullSafe(g("printed"))
    far = lambda c: F.coalesce(F.abs(w(c) - g(c)) > COLUMN_OFF, F.lit(True))
    rows = F.coalesce(F.abs(w("rows") - g("rows")) > F.greatest(F.lit(float(LEAST_ROWS_OFF)), w("rows") * ROWS_OFF), F.lit(True))
    shape = F.array_compact(F.array(*[F.when(far(c), F.lit(c)) for c in ("left", "right")], F.when(rows, F.lit("rows"))))
    none = F.array().cast("array<string>")
    return both.select(*key, F.when(other, F.array(F.lit("printed"))).when(F.coalesce(w("printed"), F.lit(False)), shape).otherwise(none).alias("faults"))


def coverage(profile: DataFrame, bands: DataFrame, key: list[str], at: str = "at", ink: str = "ink") -> DataFrame:
    """key, inside, total, coverage: how much of a page's ink lies in its bands (top, bottom: from the first, before the second).

    Bands that overlap count a place once for each, as they do on the page; the join is on the key with a range inside.
    """
    total = profile.groupBy(*key).agg(F.sum(ink).cast("double").alias("total"))
    held = profile.join(bands, key).where((F.col(at) >= F.col("top")) & (F.col(at) < F.col("bottom"))).groupBy(*key).agg(F.sum(ink).cast("double").alias("inside"))
    both = total.join(held, key, "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    return both.select(*key, "inside", "total", F.when(F.col("total") > 0, F.round(F.col("inside") / F.col("total"), 4)).otherwise(F.lit(0.0)).alias("coverage"))


def flag_quality(rows: DataFrame, flagged: Column, bad: Column) -> DataFrame:
    """n, flagged, bad, both, precision and recall of a review flag."""
    f, b = F.coalesce(flagged, F.lit(False)), F.coalesce(bad, F.lit(False))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(f).alias("flagged"), F.count_if(b).alias("bad"), F.count_if(f & b).alias("both"))
    share = lambda c: F.when(F.col(c) > 0, F.round(F.col("both") / F.col(c), 6))
    return out.withColumns({"precision": share("flagged"), "recall": share("bad")})


def score(pairs: DataFrame, read: str, truth: str, error: Column | None = None) -> DataFrame:
    """rows, exact, findable and the mean error rate of readings against the truth; both folded. ``error``: another measure than edit distance."""
    pairs = pairs.withColumn("_read", F.coalesce(F.col(read), F.lit("")))
    each = pairs.withColumn("_e", lev_error_rate(F.col("_read"), F.col(truth)) if error is None else error)
    return each.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_e") == 0).alias("exact"), F.count_if(similarity(F.col(truth), F.col("_read")) >= FINDABLE).alias("findable"),
        F.round(F.avg("_e"), 3).alias("cer"),
    )


def best_match(truths: DataFrame, candidates: DataFrame, key: list[str], truth: str, candidate: str) -> DataFrame:
    """key, truth, match, error: of a key's candidates the one with the least error rate, the first in order of equals; without any, the empty text and 1."""
    both = truths.select(*key, truth).join(candidates.select(*key, F.col(candidate).alias("_c")), key, "left")
    e = F.when(F.col("_c").isNull(), F.lit(1.0)).otherwise(lev_error_rate(F.col("_c"), F.col(truth)))
    best = both.groupBy(*key, truth).agg(F.min(F.struct(e.alias("e"), F.coalesce("_c", F.lit("")).alias("c"))).alias("m"))
    return best.select(*key, truth, F.col("m.c").alias("match"), F.col("m.e").alias("error"))
