"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts are read as words; numbers, names and units after numbers become typed placeholders. A capitalised word inside a
sentence is a name. One that opens a sentence, a line or a quotation may be one, so windows with such a word
come in both readings. Windows of ``WINDOW`` words are hashed as they stand and, where they hold a placeholder,
as templates, and joined with those of the benchmark. A template needs a literal word: one of placeholders only says
nothing and would be the hot key of the join. Template matches of one document and item on one diagonal (same distance between
the places) are one alignment, and its slots are consistent if benchmark values and the document's values go with each other
one to one throughout. An item is found where windows that stand as they are and consistent alignments
cover at least ``COVER`` of its words.

Items of two to four words are one window of that length, as they stand; documents are read in windows of such a length
only if the benchmark has such items. An item of one word is found as a whole document only.

The benchmark's windows are counted; up to ``BROADCAST_ROWS`` they are broadcast, so that documents
aren't shuffled at all, beyond that both sides are.

Cases: a null text counts as empty; items without words match nothing; repeated rows of documents are one pair with the item
(a filter drops them all); repeated items are pairs of their own if their ids differ; null ids are kept as null;
very long texts are read whole, and a window that a text repeats counts once; equally good alignments of a document are
one result; empty tables give empty results; only ids and texts are read, and a filter keeps extra columns whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side, text_of, without

WINDOW = 5
COVER = 0.8
#: Fixed list: units that stand after a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "h", "min", "hz", "w", "kw", "v", "a", "n", "j", "pa", "bar", "mph", "ft", "in", "lb", "oz",
    "inch", "inches", "feet", "yards", "miles", "pounds", "ounces", "meters", "metres", "kilometers", "kilometres", "grams", "kilograms", "liters", "litres",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent", "degrees", "dollars", "cents", "euros", "eur", "usd", "pence",
)
#: Before a word that is a name, and before one that may be.
_MARK, _MAYBE = "\x01", "\x02"
_CAPITAL = r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}])"
_INSIDE = r"\x02(?<=[\p{Ll},;:] \x02)"
_TOKEN = r"[\x01\x02]?\p{L}[\p{L}\p{N}]*|\p{N}+(?:[.,]\p{N}+)*"


def words(text: Column) -> Column:
    """Lower-cased words; a mark stands before those that are, or may be, names."""
    marked = F.regexp_replace(F.regexp_replace(text, _CAPITAL, _MAYBE), _INSIDE, _MARK)
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))


def _number(word: Column) -> Column:
    """Whether a word is a number; the pattern is only asked about words that begin beyond ASCII."""
    return F.when(word < ":", word >= "0").when(word < "\x80", F.lit(False)).otherwise(word.rlike(r"^\p{N}"))


def _kind(word: Column, before: Column) -> Column:
    """The placeholder that a word becomes in the strict reading, or null."""
    return F.when(word.startswith(_MARK), F.lit("<name>")).when(_number(word), F.lit("<number>")).when(F.coalesce(_number(before), F.lit(False)) & word.isin(*UNITS), F.lit("<unit>"))


def _hashes(at: Column, hashes: str, size: int, salt: int) -> Column:
    """Hash of ``size`` hashed words from a place on. ``hashes`` names a column: an expression would be computed for every window."""
    return F.xxhash64(F.lit(salt), *[F.get(F.col(hashes), at + k) for k in range(size)])


def _around(places: str, size: int) -> Column:
    """Where windows begin that hold one of the places."""
    n = F.size("w")
    each = F.transform(F.col(places), lambda m: F.sequence(F.greatest(m - (size - 1), F.lit(0)), F.least(m, n - size)))
    return F.array_distinct(F.flatten(each))


def windows(rows: DataFrame, size: int, short: list[int]) -> DataFrame:
    """One row per window of text: h (hash), pos (from 0; null for a window as it stands), n_words, and kept, the hashed words of a template window.

    Templates have ``size`` words. Windows as they stand have ``size``, or one of the lengths in ``short``, and come once per text.
    The explode is an outer one: for others Catalyst adds a filter on their size and pushes it below, where all
    of this is computed anew per word. What has no windows leaves a row with a null hash, which no join matches.
    Nothing but a template window carries words, and these hashed, so that a long text isn't copied into the rows of its windows.
    """
    rest = [c for c in rows.columns if c != "text"]
    rows = rows.withColumn("w", words(F.col("text"))).drop("text")
    before = lambda i: F.get(F.col("w"), i - 1)
    rows = rows.withColumns({"p": F.transform("w", lambda x: F.ltrim(x, F.lit(_MARK + _MAYBE))), "kind": F.transform("w", lambda x, i: _kind(x, before(i)))})
    somewhere = lambda c, test: F.filter(F.transform(c, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumns({"sure": somewhere("kind", lambda x: x.isNotNull()), "maybe": somewhere("w", lambda x: x.startswith(_MAYBE))})
    rows = rows.withColumn("hp", F.transform("p", lambda x: F.xxhash64(x)))
    slot = lambda kind, i: F.when(kind.isNotNull(), F.xxhash64(kind)).otherwise(F.get("hp", i))
    loose = F.transform("w", lambda x, i: F.when(x.startswith(_MAYBE), F.xxhash64(F.lit("<name>"))).otherwise(slot(F.get("kind", i), i)))
    rows = rows.withColumns({"hs": F.when(F.size("sure") > 0, F.transform("kind", slot)), "hl": F.when(F.size("maybe") > 0, loose)})
    none = F.lit(None).cast("array<long>")

    def plain(k: int) -> Column:
        each = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: _hashes(i, "hp", k, 0)))
        fits = (F.size("w") == 1) if k == 1 else (F.size("w") >= k)
        return F.when(fits, F.transform(each, lambda h: F.struct(h.alias("h"), F.lit(None).cast("int").alias("pos"), none.alias("kept"))))

    def filled(places: str, hashes: str) -> Column:
        kept = lambda i: F.array(*[F.get("hp", i + k) for k in range(size)])
        each = F.transform(_around(places, size), lambda i: F.struct(_hashes(i, hashes, size, 1).alias("h"), i.alias("pos"), kept(i).alias("kept")))
        return F.when((F.size("w") >= size) & (F.size(places) > 0), each)

    every = [plain(k) for k in [size, *short]] + [filled("sure", "hs"), filled("maybe", "hl")]
    rows = rows.select(*rest, F.size("w").alias("n_words"), F.array(*every).alias("every"))
    rows = rows.select(*rest, "n_words", F.explode_outer("every").alias("each"))
    rows = rows.select(*rest, "n_words", F.explode_outer("each").alias("x"))
    return rows.select(*rest, "n_words", "x.h", "x.pos", "x.kept")


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """h, item_id, item_words, bpos, and for template windows bkept, their hashed words. Items shorter than a window are one, as they stand."""
    rows = benchmark.select("item_id", text_of().alias("text")).withColumn("w", words(F.col("text"))).drop("text").where(F.size("w") > 0)
    n = F.size("w")
    before = lambda i: F.get(F.col("w"), i - 1)
    p = F.transform("w", lambda x: F.ltrim(x, F.lit(_MARK + _MAYBE)))
    rows = rows.withColumns({"p": p, "kind": F.transform("w", lambda x, i: _kind(x, before(i)))})
    rows = rows.withColumn("loose", F.transform("w", lambda x, i: F.when(x.startswith(_MAYBE), F.lit("<name>")).otherwise(F.get("kind", i))))
    rows = rows.withColumn("bpos", F.explode(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))))
    cut_ = lambda c: F.slice(c, F.col("bpos") + 1, size)
    rows = rows.select("item_id", n.alias("item_words"), "bpos", cut_("p").alias("p"), cut_("kind").alias("kind"), cut_("loose").alias("loose"))
    hashed = lambda salt, words_: F.xxhash64(F.lit(salt), *[F.xxhash64(F.get(words_, k)) for k in range(size)])
    as_long = F.lit(None).cast("long")
    for k in range(1, size):  # hashes of fewer words than a window
        as_long = F.when(F.size("p") == k, F.xxhash64(F.lit(0), *[F.xxhash64(F.get("p", j)) for j in range(k)])).otherwise(as_long)
    plain = rows.select(F.when(F.size("p") == size, hashed(0, F.col("p"))).otherwise(as_long).alias("h"), "item_id", "item_words", "bpos", F.lit(None).cast("array<long>").alias("bkept"))
    out = plain
    for c in ("kind", "loose"):
        slots = F.size(F.filter(c, lambda x: x.isNotNull()))
        told = rows.where((F.size("p") == size) & (slots > 0) & (slots < size))
        words_ = F.transform("p", lambda x, i: F.coalesce(F.get(F.col(c), i), x))  # noqa: B023
        out = out.unionByName(told.select(hashed(1, words_).alias("h"), "item_id", "item_words", "bpos", F.transform("p", lambda x: F.xxhash64(x)).alias("bkept")))
    return out.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, cover: float = COVER) -> DataFrame:
    """doc_id, text_hash, item_id, coverage, n_windows and n_slots for every document that holds a benchmark item."""
    keys = cut(benchmark_windows(benchmark, size))
    short = sorted(r.item_words for r in keys.where(F.col("item_words") < size).select("item_words").distinct().collect())  # lengths below a window
    rows = windows(docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text")), size, short)
    pair = F.arrays_zip(F.col("bkept").alias("b"), F.col("kept").alias("d"))
    hits = rows.join(small_side(keys), "h").select(
        "doc_id", "text_hash", "item_id", "item_words", "bpos", (F.col("pos") - F.col("bpos")).alias("diagonal"), F.when(F.col("kept").isNotNull(), pair).alias("slots")
    )
    # A diagonal has each place of the item once, so these sets are no longer than the item; windows as they stand have none.
    aligned = hits.groupBy("doc_id", "text_hash", "item_id", "item_words", "diagonal").agg(
        F.collect_set("bpos").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    values = lambda side: F.size(F.array_distinct(F.transform("slots", lambda x: x[side])))
    aligned = aligned.where((values("b") == F.size("slots")) & (values("d") == F.size("slots")))
    found = aligned.groupBy("doc_id", "text_hash", "item_id", "item_words").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"),
        F.max(F.size(F.filter("slots", lambda x: x["b"] != x["d"]))).alias("n_slots"),
    )
    spans = F.transform("places", lambda p: F.sequence(p, F.least(p + size, F.col("item_words")) - 1))
    covered = F.size(F.array_distinct(F.flatten(spans)))
    return found.select(
        "doc_id", "text_hash", "item_id", (covered / F.col("item_words")).alias("coverage"),
        F.size("places").cast("long").alias("n_windows"), F.col("n_slots").cast("long").alias("n_slots"),
    ).where(F.col("coverage") >= cover)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_windows, n_slots."""
    return leaks(docs, benchmark).drop("text_hash").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = cut(leaks(docs, benchmark).select("doc_id", "text_hash").distinct())
    a, b, h = without(docs.columns, "bad_id", "bad_text", "text_hash")
    rows = docs.withColumn(h, F.xxhash64(text_of()))
    bad = bad.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    return rows.join(small_side(bad), rows["doc_id"].eqNullSafe(F.col(a)) & (F.col(h) == F.col(b)), "left_anti").select(*docs.columns)
