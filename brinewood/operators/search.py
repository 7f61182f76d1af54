"""Error-tolerant ranked search: gram index, similarity join, re-ranking and composition of tiers.

Similarity above zero needs a shared gram, so postings lose nothing: an index lists, per gram and block of lines, the places of the lines that
have it, clustered by gram. A query reads its own grams' rows and counts them per line, which with the line's number of grams gives the exact
Jaccard value; no text is read again. Many queries at once meet the lines in matrix products instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.functions.fuzzy import may_reach, ro_ratio
from brinewood.functions.text import fold, trigrams
from brinewood.sources.store import cut

#: Fixed values.
MIN_QUERY = 3
MIN_SCORE = 0.10
STRONG_NAME = 0.5
MATCH_BONUS, MISMATCH_PENALTY, GROUP_FLOOR = 0.6, 0.15, 0.85


def grams(rows: DataFrame, key: list[str], folded: str) -> DataFrame:
    """key, gram, n_grams: the distinct trigrams of every row (null: of the empty text) and how many it has."""
    rows = rows.select(*key, F.concat(F.lit("  "), F.coalesce(F.col(folded), F.lit("")), F.lit(" ")).alias("padded"))
    at = F.explode_outer(F.sequence(F.lit(1), F.greatest(F.length("padded") - 2, F.lit(1))))
    each = rows.select(*key, "padded", at.alias("at")).select(*key, F.substring(F.col("padded"), F.col("at"), F.lit(3)).alias("gram"))
    each = each.distinct()
    size = each.groupBy(*key).agg(F.count(F.lit(1)).alias("n_grams"))
    return each.join(size, key)


def similarity_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str, floor: float = MIN_SCORE) -> DataFrame:
    """lkey, rkey, name_score of all pairs of two ``grams`` tables with at least ``floor``.

    Rows whose sizes alone rule the floor out are dropped before they are counted.
    """
    a, b = left.select(lkey, "gram", F.col("n_grams").alias("na")), right.select(rkey, "gram", F.col("n_grams").alias("nb"))
    fits = (F.col("na") * floor <= F.col("nb")) & (F.col("nb") * floor <= F.col("na"))
    shared = a.join(b, "gram").where(fits).groupBy(lkey, rkey, "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    score = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return shared.select(lkey, rkey, score.alias("name_score")).where(F.col("name_score") >= floor)


def bonus(row_year: Column, year: Column, group_ratio: Column) -> Column:
    """How much a row's context agrees with the query; nothing said, nothing gained or lost."""
    by_year = F.when(row_year.isNotNull() & year.isNotNull(), F.when(row_year == year, F.lit(MATCH_BONUS)).otherwise(F.lit(-MISMATCH_PENALTY)))
    by_group = F.when(group_ratio >= GROUP_FLOOR, F.lit(MATCH_BONUS) * group_ratio)
    return F.coalesce(by_year, F.lit(0.0)) + F.coalesce(by_group, F.lit(0.0))


def ranked_score(name_score: Column, gain: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), name_score * (F.lit(1.0) + gain))), 3)


def folded_query(text: str, case: str = "upper") -> Column:
    return fold(F.lit(text), case)


def gram_codes(text: str) -> np.ndarray:
    """The distinct trigrams of a folded text, padded by two spaces before and one after, as sorted longs of three code points."""
    points = np.frombuffer(f"  {text} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def query_codes(spark: SparkSession, query: str) -> np.ndarray:
    """The grams of a query; none if it is too short to be recognised."""
    folded = spark.sql("VALUES (1)").select(folded_query(query).alias("q")).first().q
    return gram_codes(folded) if len(folded) >= MIN_QUERY else np.zeros(0, np.int64)


#: Lines whose postings stand together.
BLOCK_LINES = 8192


def postings(lines: DataFrame, key: list[str], text: str = "folded") -> DataFrame:
    """The index of ``lines``: gram, _block, _rows, and for each block one row without gram that has its lines' keys and n_grams as arrays.

    Lines go in blocks as they come; a row per gram and block lists the places in the block that have the gram, so an index has a row
    for many postings, two bytes or so for each. Ranges are of gram and block, so that a gram which most lines have is spread over as many partitions
    as it takes. Texts are read once: what the blocks give is cut before it is dealt into ranges.
    """
    rows = lines.select(*key, F.coalesce(F.col(text), F.lit("")).alias(text))
    kinds = {c: t for c, t in rows.dtypes if c in key}
    schema = ", ".join(["gram long", "_block long", "_rows array<int>", *(f"`{c}` array<{t}>" for c, t in kinds.items()), "n_grams array<int>"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_LINES):
                b = whole.slice(at, BLOCK_LINES)
                each = [gram_codes(t.as_py()) for t in b.column(text)]
                size = np.array([len(x) for x in each], np.int32)
                codes, place = np.concatenate(each), np.repeat(np.arange(b.num_rows, dtype=np.int32), size)
                order = np.argsort(codes, kind="stable")
                codes, place = codes[order], place[order]
                first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                none = lambda kind: pa.nulls(first.size, pa.list_(kind))
                held = pa.ListArray.from_arrays(pa.array(np.append(first, codes.size), pa.int32()), pa.array(place))
                cols = [pa.array(codes[first]), pa.array(np.full(first.size, block)), held, *(none(b.column(c).type) for c in kinds), none(pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "_block", "_rows", *kinds, "n_grams"])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                cols = [pa.nulls(1, pa.int64()), pa.array([block]), pa.nulls(1, pa.list_(pa.int32())), *(one(b.column(c)) for c in kinds), one(pa.array(size))]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "_block", "_rows", *kinds, "n_grams"])
                block += 1

    return cut(rows.mapInArrow(of, schema)).repartitionByRange("gram", "_block").sortWithinPartitions("gram", "_block")


def index_size(index: DataFrame) -> DataFrame:
    """postings, grams, lines of an index."""
    held = F.col("gram").isNotNull()
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.size(c))).cast("long"), F.lit(0).cast("long"))
    return index.agg(total(held, "_rows").alias("postings"), F.countDistinct("gram").alias("grams"), total(~held, "n_grams").alias("lines"))


def scored_postings(index: DataFrame, query: str, key: list[str], floor: float = MIN_SCORE) -> DataFrame:
    """key, name_score of the lines at or above the floor: the index is read at the query's grams only, and their places are counted."""
    codes = query_codes(index.sparkSession, query).tolist()
    lines = index.where("gram is null").select("_block", F.posexplode(F.arrays_zip(*key, "n_grams")).alias("_row", "_l")).select("_block", "_row", "_l.*")
    if not codes:
        return lines.select(*key, F.lit(0.0).alias("name_score")).where(F.lit(False))
    wanted = F.lit(False)
    for at in range(0, len(codes), 10):  # so many values are pushed down to the files as they are; of more only their range
        wanted = wanted | F.col("gram").isin(codes[at : at + 10])
    hits = index.where(wanted).select("_block", F.explode("_rows").alias("_row")).groupBy("_block", "_row").agg(F.count(F.lit(1)).alias("both"))
    hits = hits.where(F.col("both") >= max(1, math.ceil(floor * len(codes) - 1e-9))).join(lines, ["_block", "_row"])
    score = F.col("both") / (F.col("n_grams") + len(codes) - F.col("both"))
    return hits.select(*key, score.alias("name_score")).where(F.col("name_score") >= floor)


def best_hits(scored: DataFrame, key: list[str], limit: int | None = 50) -> DataFrame:
    """key, score: the best ``limit`` of scored rows, ties by the key; all of them for None."""
    out = scored.select(*key, F.round("name_score", 3).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), *key).limit(limit)


def search_lines(lines: DataFrame, query: str, key: list[str], limit: int | None = 50, floor: float = MIN_SCORE, text: str = "folded") -> DataFrame:
    """The rows of ``lines`` most like ``query``, without an index; an unrecognisable query gives none."""
    return best_hits(scored_lines(lines, query, key, floor, text), key, limit)


def scored_lines(lines: DataFrame, query: str, key: list[str], floor: float = MIN_SCORE, text: str = "folded") -> DataFrame:
    """key, name_score of the rows at or above the floor against one query: one scan, for lines that no index is kept of."""
    codes = query_codes(lines.sparkSession, query)
    return scored_batch([codes], lines.select(*key, text), key, floor, text).select(*key, "name_score") if len(codes) else lines.select(*key, F.lit(0.0).alias("name_score")).where(F.lit(False))


#: Grams of queries that are held against lines at a time, and cells (grams by queries, four bytes each) that a block's matrix has at most.
BLOCK_GRAMS, BLOCK_CELLS = 1 << 16, 1 << 24


def scored_batch(queries: list[np.ndarray], lines: DataFrame, key: list[str], floor: float = MIN_SCORE, text: str = "folded") -> DataFrame:
    """at, key, name_score: every line at or above the floor against each of a block of queries (sorted grams), ``at`` its place.

    The block goes to the executors, where the lines stay; shared grams of a batch of lines and all queries are one matrix product.
    """
    vocabulary = np.unique(np.concatenate(queries))
    asked = np.zeros((len(vocabulary), len(queries)), np.float32)
    for i, q in enumerate(queries):
        asked[np.searchsorted(vocabulary, q), i] = 1.0
    n_asked = asked.sum(axis=0)
    rows = lines.select(*key, F.coalesce(F.col(text), F.lit("")).alias(text))
    schema = ", ".join(["at int", *(f"`{c}` {t}" for c, t in rows.dtypes if c != text), "name_score double"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                held, sizes = np.zeros((b.num_rows, len(vocabulary)), np.float32), np.zeros(b.num_rows)
                for r, t in enumerate(b.column(text)):
                    codes = gram_codes(t.as_py())
                    sizes[r] = len(codes)
                    place = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
                    held[r, place[vocabulary[place] == codes]] = 1.0
                both = (held @ asked).astype(np.float64)
                score = both / (sizes[:, None] + n_asked[None, :] - both)
                r, q = np.nonzero((score >= floor) & (both > 0))
                row = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), *(b.column(c).take(row) for c in key), pa.array(score[r, q])], ["at", *key, "name_score"])

    return rows.mapInArrow(of, schema)


def search_many(queries: DataFrame, qkey: str, qtext: str, lines: DataFrame, key: list[str], floor: float = MIN_SCORE, text: str = "folded", most: int = 20_000) -> DataFrame:
    """qkey, key, name_score of all pairs of queries and lines at or above the floor; both texts are folded.

    Up to ``most`` queries, which are counted, go to the lines in blocks whose matrix has a bounded size, one scan per block; more are joined
    on grams.
    """
    if queries.count() > most:
        sides = [grams(queries, [qkey], qtext).withColumnRenamed(qkey, "_q"), grams(lines, key, text).withColumn("_k", F.struct(*key))]
        return similarity_join(*sides, "_q", "_k", floor).select(F.col("_q").alias(qkey), *[F.col(f"_k.{c}").alias(c) for c in key], "name_score")
    blocks: list[list[tuple]] = [[]]
    size = 0
    for r in queries.select(qkey, F.coalesce(F.col(qtext), F.lit("")).alias(qtext)).collect():  # at most ``most`` rows
        codes = gram_codes(r[qtext])
        grown = size + len(codes)
        if blocks[-1] and (grown > BLOCK_GRAMS or grown * (len(blocks[-1]) + 1) > BLOCK_CELLS):
            blocks.append([])
            size = 0
        size += len(codes)
        blocks[-1].append((r[qkey], codes))
    out = None
    for block in blocks:
        if not block:
            return lines.select(F.lit(None).cast(dict(queries.dtypes)[qkey]).alias(qkey), *key, F.lit(0.0).alias("name_score")).where(F.lit(False))
        ids = lines.sparkSession.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"at int, `{qkey}` {dict(queries.dtypes)[qkey]}")
        found = scored_batch([c for _, c in block], lines, key, floor, text).join(F.broadcast(ids), "at").select(qkey, *key, "name_score")
        out = found if out is None else out.unionByName(found)
    return out


def compose(scored: DataFrame, certain: DataFrame, identity: list[str], limit: int | None = 50) -> DataFrame:
    """Strong name hits, then certain rows not listed yet, then weak name hits."""
    named = scored.withColumn("tier", F.when(F.col("score") >= STRONG_NAME, F.lit(1)).otherwise(F.lit(3)))
    rest = certain.join(scored.select(*identity), identity, "left_anti").withColumn("tier", F.lit(2))
    both = named.unionByName(rest, allowMissingColumns=True)
    order = [F.col("tier"), F.when(F.col("tier") != 2, -F.col("score")), *[F.col(c) for c in identity]]
    return both if limit is None else both.orderBy(*order).limit(limit)


#: Letters that a term has at least to be held for a ship, and a query without it.
SHIP_TERM, REST_OF_QUERY = 4, 3


def ship_ratios(terms: DataFrame, ships: DataFrame, floor: float = GROUP_FLOOR) -> DataFrame:
    """term, ship, ratio of all pairs of distinct terms and ships whose folds are alike by at least ``floor``.

    Two texts that are alike by 0.85 share a padded trigram: what doesn't match is so little that a run of matches of two at an end or three
    inside must be left. So candidates come from an equi-join on grams, and the ratio is only asked about those.
    """
    a = terms.select("term").distinct().withColumn("_a", fold(F.col("term")))
    b = ships.select("ship").where(F.coalesce("ship", F.lit("")) != "").distinct().withColumn("_b", fold(F.col("ship")))
    grams_of = lambda c: F.explode(trigrams(F.col(c)))
    pairs = a.withColumn("_g", grams_of("_a")).join(b.withColumn("_g", grams_of("_b")), "_g").where(may_reach(F.col("_a"), F.col("_b"), floor)).select("term", "_a", "ship", "_b").distinct()
    return pairs.withColumn("ratio", ro_ratio("_a", "_b")).where(F.col("ratio") >= floor).select("term", "ship", "ratio")


def split_ships(queries: DataFrame, key: list[str], text: str, ships: DataFrame) -> DataFrame:
    """key, term, rest: the first term of a query that names a ship and leaves enough of a query, and the query without it.

    Queries that name none keep all of their text, with a null term.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    each = queries.select(*key, words.alias("_words")).select(*key, "_words", F.posexplode_outer("_words").alias("_at", "term"))
    rest = F.array_join(F.filter("_words", lambda w, i: i != F.col("_at")), " ")
    each = each.withColumn("_rest", rest).withColumn("_fits", (F.length("term") >= SHIP_TERM) & (F.length(fold(F.col("_rest"))) >= REST_OF_QUERY))
    named = ship_ratios(each.where("_fits").select("term"), ships).select("term").distinct().withColumn("_ship", F.lit(True))
    hit = each.join(named, "term", "left").where(F.col("_fits") & F.coalesce("_ship", F.lit(False)))
    first = hit.groupBy(*key).agg(F.min_by(F.struct("term", F.col("_rest").alias("rest")), "_at").alias("_f"))
    out = queries.select(*key, F.array_join(words, " ").alias("_all")).join(first, key, "left")
    return out.select(*key, F.col("_f.term").alias("term"), F.coalesce("_f.rest", "_all").alias("rest"))


def ship_bonus(rows: DataFrame, ship: str, terms: DataFrame) -> DataFrame:
    """``rows`` with group_ratio: how much a row's ship is like the best of the terms, null below the floor. Ships are compared once each."""
    best = ship_ratios(terms, rows.select(F.col(ship).alias("ship"))).groupBy("ship").agg(F.max("ratio").alias("group_ratio"))
    return rows.join(best.select(F.col("ship").alias("_ship"), "group_ratio"), F.col(ship) == F.col("_ship"), "left").drop("_ship")
