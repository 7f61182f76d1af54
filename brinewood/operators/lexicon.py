"""Name dictionaries: built from clean rows, queried for suggestions and doubts; greedy clusters of spellings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewood.functions.fuzzy import ro_ratio
from brinewood.functions.lexical import PRINTED_FLOOR, headings, near_any
from brinewood.functions.text import fold
from brinewood.sources.store import cut

#: Fixed values.
CLEAN_SCORE, SUGGEST_FLOOR, SUGGESTIONS, LENGTH_BAND = 0.95, 0.62, 4, 3
CLUSTER_FLOOR, REFUSED_FLOOR = 0.75, 0.85
#: Kinds of letters (with their counts) up to which the table of how rare they are is broadcast.
RARITIES = 50_000
TOKEN = r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'\-]{2,}$"


def build(words: DataFrame, word: str, refused: DataFrame | None = None, least: int = 1) -> DataFrame:
    """name, seen: folded tokens and how often they occur, without refused ones and rare ones."""
    names = words.where(F.col(word).rlike(TOKEN)).groupBy(F.upper(word).alias("name")).agg(F.count(F.lit(1)).alias("seen"))
    if refused is not None:
        names = names.join(refused.select(F.col("name")), "name", "left_anti")
    return names.where(F.col("seen") >= least)


def build_from_rows(rows: DataFrame, refused: tuple[str, ...] = (), captions: tuple[str, ...] = (), printed: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """name, seen: the names that an archive's own rows (name_raw, score, by_hand) give, counted.

    Only rows count that a person made or that were read with a clean score, and no headings. A word is left out that is near one of ``refused``
    (what people were, not who) or of ``printed`` (the form's own words); each distinct word is judged once.
    """
    clean = rows.where(F.coalesce("by_hand", F.lit(False)) | (F.coalesce("score", F.lit(0.0)) >= CLEAN_SCORE))
    if captions or printed:
        clean = clean.withColumn("_row", F.monotonically_increasing_id())
        caption = headings(clean, ["_row"], "name_raw", captions, printed).where("heading").select("_row")
        clean = clean.join(caption, "_row", "left_anti")
    words = clean.select(F.explode(F.split(F.trim("name_raw"), r"\s+")).alias("w")).where(F.col("w").rlike(TOKEN))
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("_low", fold(F.col("w"), "lower"))
    for near, floor in ((refused, REFUSED_FLOOR), (printed, PRINTED_FLOOR)):
        if near:
            counted = counted.where(~near_any(near, floor)(F.col("_low")))
    return counted.groupBy(fold(F.col("w"), compat=True).alias("name")).agg(F.sum("n").cast("long").alias("seen")).where(F.col("seen") >= least)


def letters_of(c: Column) -> Column:
    """A word's letters as tokens that can be counted: each with how often it has come before and now."""
    one = F.split(c, "")
    return F.transform(one, lambda x, i: F.concat(x, F.size(F.filter(F.slice(one, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def near_pairs(observed: DataFrame, names: DataFrame, floor: float, band: int | None = None) -> DataFrame:
    """observed, name: pairs of distinct words that may be alike by ratio; every pair of a ratio of ``floor`` or more is among them.

    A ratio can't be above twice the letters that both words have over the sum of their lengths, so t letters must be shared, and of a word of n letters any
    n - t + 2 hold two of them. Words are put under pairs of the rarest of their letters, for every length (within ``band``) that the other may have,
    and met by an equi-join; what shares fewer than t letters is dropped then, still without Python.
    """
    a, b = (x.select(F.col(c).alias("w")).where(F.length(c) > 0).distinct() for x, c in ((observed, "observed"), (names, "name")))
    seen = a.unionByName(b).distinct().select(F.explode(letters_of(F.col("w"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    n_tokens = (seen := cut(seen)).count()
    seen = F.broadcast(seen) if n_tokens <= RARITIES else seen
    need = F.ceil(F.round(F.lit(floor) * (F.col("own") + F.col("other")) / 2, 9)).cast("int")

    def keyed(words: DataFrame, name: str, first: str, second: str) -> DataFrame:
        each = words.select("w", F.explode(letters_of(F.col("w"))).alias("token")).join(seen, "token")
        rare = each.groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("t")).withColumn("own", F.size("t"))
        low, high = F.ceil(F.round(F.col("own") * floor / (2 - floor), 9)), F.floor(F.round(F.col("own") * (2 - floor) / floor, 9))
        if band is not None:
            low, high = F.greatest(low, F.col("own") - band), F.least(high, F.col("own") + band)
        rows = rare.withColumn("other", F.explode(F.sequence(F.greatest(low, F.lit(1)).cast("int"), F.greatest(high, low, F.lit(1)).cast("int")))).withColumn("need", need)
        rows = rows.where((F.col("need") >= 1) & (F.col("need") <= F.least("own", "other")))
        few = F.slice("t", F.lit(1), F.col("own") - F.col("need") + F.least("need", F.lit(2)))
        twos = F.flatten(F.transform(few, lambda x, i: F.transform(F.slice(few, i + 2, F.size(few)), lambda y: F.concat(x, F.lit(" "), y))))
        keys = F.explode(F.when(F.col("need") >= 2, twos).otherwise(few))
        return rows.select(F.col("w").alias(name), F.col("own").alias(first), F.col("other").alias(second), keys.alias("key"))

    both = keyed(a, "observed", "n_a", "n_b").join(keyed(b, "name", "n_a", "n_b").select("name", F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), "key"), ["n_a", "n_b", "key"])
    both = both.select("observed", "name", "n_a", "n_b").distinct()
    shared = F.size(F.array_intersect(letters_of(F.col("observed")), letters_of(F.col("name"))))
    return both.where(2 * shared >= F.round(F.lit(floor) * (F.col("n_a") + F.col("n_b")), 9)).select("observed", "name")


def suggest(observed: DataFrame, names: DataFrame, measure: str = "ratio", floor: float = SUGGEST_FLOOR, most: int = SUGGESTIONS) -> DataFrame:
    """observed, name, seen, score, rank: the best dictionary names for each distinct observed word, itself aside.

    Lengths differ by three at most. ``measure``: ratio (Ratcliff-Obershelp), over ``near_pairs``, or levenshtein (1 - distance / longer length), where each observed
    word goes to the seven lengths it may match.
    """
    if measure == "ratio":
        both = near_pairs(observed, names, floor, LENGTH_BAND).join(names, "name").withColumn("score", ro_ratio("observed", "name"))
    else:
        a = observed.select("observed").distinct().withColumn("len", F.explode(F.sequence(F.greatest(F.length("observed") - LENGTH_BAND, F.lit(1)), F.length("observed") + LENGTH_BAND)))
        both = a.join(names.withColumn("len", F.length("name")), "len").drop("len")
        both = both.withColumn("score", 1 - F.levenshtein("observed", "name") / F.greatest(F.length("observed"), F.length("name")))
    w = Window.partitionBy("observed").orderBy(F.desc("score"), F.desc("seen"), "name")
    hits = both.where((F.col("score") >= floor) & (F.col("observed") != F.col("name")))
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def doubtful(readings: DataFrame, key: list[str], text: str, names: DataFrame, measure: str = "ratio") -> DataFrame:
    """key, doubtful: whether no token of three letters or more is in the dictionary or near one of its names."""
    tokens = readings.select(*key, F.explode(F.split(F.upper(text), r"[^\p{L}'\-]+")).alias("observed")).where(F.length("observed") >= 3)
    exact = tokens.select("observed").distinct().join(names.select(F.col("name").alias("observed")), "observed", "left_semi")
    open_ = tokens.select("observed").distinct().join(exact, "observed", "left_anti")
    known = exact.unionByName(suggest(open_, names, measure, most=1).select("observed")).distinct().withColumn("known", F.lit(1))
    hits = tokens.join(known, "observed", "left").groupBy(*key).agg((F.max(F.coalesce("known", F.lit(0))) == 0).alias("doubtful"))
    return hits


def cluster(names: DataFrame, name: str = "name", seen: str = "seen", floor: float = CLUSTER_FLOOR, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """name, label, size: greedy groups of spellings; the longest come first and join the first group whose representative is near.

    A name is a representative if none of the earlier names near it is one. That is settled in rounds over the near pairs, cut after each: a name with a
    near earlier representative is none, one whose near earlier names are all settled as none is one. Rounds are as many as the longest chain of
    names of which each waits for the one before; no name is ever compared with all. The label is the member seen most, the first of equals.
    ``form``: what of a name is compared (folded, say), if not the name.

    Cases: null names take no part; repeated names add up; names of an empty form are near none; an empty table gives an empty result.
    """
    shown = F.col("name") if form is None else form(F.col("name"))
    distinct = cut(names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.sum(seen).cast("long").alias("seen")).withColumn("form", shown))
    place = lambda c: F.struct(-F.length(c), F.col(c))
    forms = distinct.select("form").distinct()
    near = near_pairs(forms.select(F.col("form").alias("observed")), forms.select(F.col("form").alias("name")), floor)
    near = cut(near.where(ro_ratio("observed", "name") >= floor).select(F.col("observed").alias("_late"), F.col("name").alias("_early")))
    late, early = (distinct.select(F.col("name").alias(c), F.col("form").alias(f)) for c, f in (("observed", "_late"), ("name", "_early")))
    edges = cut(near.join(late, "_late").join(early, "_early").where(place("name") < place("observed")).select("observed", "name"))
    waiting = edges.select(F.col("observed").alias("name")).distinct()
    heads = cut(distinct.select("name").join(waiting, "name", "left_anti"))
    open_ = edges
    while not open_.isEmpty():
        state = open_.join(heads.withColumn("_head", F.lit(True)), "name", "left").groupBy("observed").agg(F.max(F.coalesce("_head", F.lit(False))).alias("_near"))
        members = cut(state.where("_near").select("observed"))
        left = open_.join(members, "observed", "left_anti")  # of names not settled yet
        left = cut(left.join(members.select(F.col("observed").alias("name")), "name", "left_anti"))
        still = left.select("observed").distinct()
        fresh = open_.select("observed").distinct().join(members, "observed", "left_anti").join(still, "observed", "left_anti")
        heads = cut(heads.unionByName(fresh.select(F.col("observed").alias("name"))))
        open_ = left
    joined = edges.join(heads, "name").groupBy("observed").agg(F.min_by("name", place("name")).alias("head")).select(F.col("observed").alias("name"), "head")
    member = joined.unionByName(heads.select("name", F.col("name").alias("head"))).join(distinct.drop("form"), "name")
    group = member.groupBy("head").agg(F.min_by("name", F.struct(-F.col("seen"), place("name"))).alias("label"), F.sum("seen").alias("size"))
    return member.join(group, "head").select("name", "label", "size")


def review_reasons(confidence: Column, ditto_source: Column, unknown: Column, floor: float = 0.85) -> Column:
    """Why a row should be looked at: a low score, a surname inferred from position, a name nobody knows."""
    return F.array_compact(F.array(F.when(confidence < floor, F.lit("score")), F.when(ditto_source == "position", F.lit("inferido")), F.when(unknown, F.lit("desconhecido"))))


def load(spark: SparkSession, path: str) -> DataFrame:
    """name, seen of a stored dictionary (a JSON object of names and counts); one that isn't there is empty."""
    kind = "map<string, long>"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "name string, seen long")
    return raw.select(F.explode(F.from_json("value", kind)).alias("name", "seen"))


def scored(observed: DataFrame, names: DataFrame, measure: str = "ratio") -> DataFrame:
    """observed, score: how much of a name each distinct word is: 1 if it is in the dictionary, else its best suggestion's score, else 0."""
    words = observed.select("observed").distinct()
    near = suggest(words.where(F.length("observed") >= 3), names, measure, most=1).select("observed", "score")
    known = names.select(F.col("name").alias("observed"), F.lit(1.0).alias("_known"))
    both = words.join(known, "observed", "left").join(near, "observed", "left")
    return both.select("observed", F.coalesce("_known", "score", F.lit(0.0)).alias("score"))


def ranked(readings: DataFrame, key: list[str], words: str, names: DataFrame, measure: str = "ratio") -> DataFrame:
    """key, ranked: the readings of one word (an array) by how much of a name each is, those of equal scores in their order."""
    each = readings.select(*key, F.posexplode(words).alias("_at", "_word")).where(F.coalesce("_word", F.lit("")) != "").withColumn("observed", fold(F.col("_word"), compat=True))
    each = each.join(scored(each, names, measure), "observed")
    order = F.sort_array(F.collect_list(F.struct((-F.round("score", 3)).alias("s"), F.col("_at").alias("at"), F.col("_word").alias("word"))))
    out = each.groupBy(*key).agg(F.transform(order, lambda x: F.struct(x["word"].alias("word"), (-x["s"]).alias("score"))).alias("ranked"))
    return readings.select(*key).join(out, key, "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<struct<word: string, score: double>>")))
