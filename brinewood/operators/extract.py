"""Typed facts from form-like lines: labels and values, datelines, classification of forms, merging of records.

Lexicons (labels, marks, months) are parameters. Lines are rows (document, position, line); everything is
windows over a document's lines, and a field is null unless it is certain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewood.functions.text import clean_edges, fold, n_letters, plausible_year
from brinewood.sources.store import cut

#: Marks that make a form one kind or the other, and first lines that a dateline may be in.
FIRST_KIND_MARKS, SECOND_KIND_MARKS = 3, 2
DATELINE_LINES, DATELINE_SPAN = 10, 3
#: Texts that were judged, up to which they are broadcast.
SPELLINGS = 50_000


def lines_of(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, pos (from 0), line: a text's lines."""
    return docs.select(*key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))


def value_beside(lines: DataFrame, key: list[str], label: str, is_label: Column) -> DataFrame:
    """key and the value that belongs to a label: the tail of its line, else the line above, else the one below.

    ``label`` is a pattern whose first group is the tail; neighbours that are labels themselves don't count.
    The first line with the label decides.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    plain = F.when(~is_label & (F.trim("line") != ""), F.trim("line"))
    rows = lines.withColumn("_plain", plain).withColumn("_above", F.lag("_plain").over(w)).withColumn("_below", F.lead("_plain").over(w))
    hit = rows.where(F.col("line").rlike(label))
    tail = F.nullif(F.trim(F.regexp_extract("line", label, 1)), F.lit(""))
    value = F.coalesce(tail, F.col("_above"), F.col("_below"))
    return hit.groupBy(*key).agg(F.min_by(F.struct(value.alias("value")), "pos").alias("_v")).select(*key, F.col("_v.value").alias("value"))


def first_line(lines: DataFrame, key: list[str], wanted: Column, within: int | None = None) -> DataFrame:
    """key, pos, line of the first line that fits, among the first ``within``."""
    rows = lines.where(wanted) if within is None else lines.where(wanted & (F.col("pos") < within))
    return rows.groupBy(*key).agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"))


def mark_count(text: Column, marks: list[str]) -> Column:
    """How many of the marks occur in a folded text."""
    total = F.lit(0)
    for m in marks:
        total = total + F.contains(text, F.lit(m)).cast("int")
    return total


def form_kind(first: Column, second: Column, has_port: Column, has_head: Column) -> Column:
    """Which form a page is, by its marks: the first kind, the second, the second by its port and letterhead, or none."""
    return (
        F.when((first >= FIRST_KIND_MARKS) & (first >= second), F.lit("parte")).when(second >= SECOND_KIND_MARKS, F.lit("lista"))
        .when((second == 1) & has_port & has_head, F.lit("lista"))
    )


def dateline(lines: DataFrame, key: list[str], months: dict[str, int]) -> DataFrame:
    """key, day, month, year, arrival: the first month word in the first lines, a day before it, a year within three lines.

    The parts fail one by one; arrival is a date string only if all are certain.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    names = "|".join(sorted(months, key=len, reverse=True))
    low = F.lower(F.col("line"))
    near = F.concat_ws(" ", low, *[F.lead(low, k).over(w) for k in range(1, DATELINE_SPAN)])
    table = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    rows = lines.withColumn("_low", low).withColumn("_near", near)
    hit = rows.where((F.col("pos") < DATELINE_LINES) & F.col("_low").rlike(rf"\b({names})\b"))
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    hit = hit.withColumn("month", F.element_at(table, F.regexp_extract("_low", rf"\b({names})\b", 1)))
    hit = hit.withColumn("day", number(F.regexp_extract("_low", rf"\b(\d{{1,2}})\s+(?:de\s+|do\s+|of\s+)?(?:{names})\b", 1)))
    hit = hit.withColumn("year", plausible_year(number(F.regexp_extract("_near", r"\b(\d{4})\b", 1)), 1600, 2029))
    best = hit.groupBy(*key).agg(F.min_by(F.struct("day", "month", "year"), "pos").alias("_d")).select(*key, "_d.*")
    whole = F.col("day").between(1, 31) & F.col("year").isNotNull()
    return best.withColumn("arrival", F.when(whole, F.format_string("%04d-%02d-%02d", "year", "month", "day")))


def merge_records(rows: DataFrame, key: list[str], order: list[str], fields: list[str], year: str | None = None, year_source: str | None = None) -> DataFrame:
    """One record per key: each field's first non-null value in order; a printed year goes before a stamped one."""
    at = F.struct(*order)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    aggs = [first(c) for c in fields]
    if year and year_source:
        rank = F.when(F.col(year).isNotNull(), F.struct(F.when(F.col(year_source) == "printed", F.lit(0)).otherwise(F.lit(1)).alias("r"), *order))
        aggs += [F.min_by(F.col(year), rank).alias(year), F.min_by(F.col(year_source), rank).alias(year_source)]
    return rows.groupBy(*key).agg(*aggs)


def beside_fragments(labels: DataFrame, fragments: DataFrame, key: list[str], overlap: float = 0.25, slack: float = 0.2, besides: Column | None = None) -> DataFrame:
    """The nearest fragment to the right of each label on the same height; boxes are x0, y0, x1, y1 (the label's lx0, ly0, lx1, ly1).

    The join is an equi-join on the page and a range within it, and ``besides`` if there is more to hold.
    """
    a = labels.select(*key, F.col("label"), *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    both = a.join(fragments, key)
    shared = F.least("ly1", "y1") - F.greatest("ly0", "y0")
    fits = (shared >= F.lit(overlap) * (F.col("ly1") - F.col("ly0"))) & (F.col("x0") >= F.col("lx1") - F.lit(slack) * (F.col("lx1") - F.col("lx0")))
    fits = fits if besides is None else fits & besides
    return both.where(fits).groupBy(*key, "label").agg(F.min_by("text", F.struct("x0", "text")).alias("value"))


def words_with_months(lines: DataFrame, key: list[str], month: Callable[[Column], Column], within: int | None = None) -> DataFrame:
    """key, pos, at, word, folded, month of the words of lines that name a month; every distinct word is judged once.

    Distinct words are cut first: else the filter on what they name goes down past ``distinct``, and every word of every line is judged.
    """
    near = lines if within is None else lines.where(F.col("pos") < within)
    words = near.select(*key, "pos", F.posexplode(F.split("line", r"[^\p{L}\p{N}_]+")).alias("at", "word")).withColumn("folded", fold(F.col("word"), "lower", letters_only=True))
    known = cut(words.select("folded").distinct().where(F.length("folded") >= 3))
    known = cut(known.withColumn("month", month(F.col("folded"))).where("month is not null"))
    return words.join(F.broadcast(known) if known.count() <= SPELLINGS else known, "folded")  # few words are near a month's name


def dateline_near(lines: DataFrame, key: list[str], month: Callable[[Column], Column], joiners: tuple[str, ...] = ("de", "do")) -> DataFrame:
    """key, raw, day, month, year, arrival: as ``dateline``, for months that may be misread (``month``: a folded word's number, or null).

    Of the first lines the first counts that names a month and has four digits of a year behind a joiner within three lines. If the archive can't hold
    that year, only what stands there (raw) is kept.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    near = F.concat_ws(" ", "line", *[F.lead("line", k).over(w) for k in range(1, DATELINE_SPAN)])
    rows = lines.withColumn("_near", near)
    first = words_with_months(lines, key, month, DATELINE_LINES).groupBy(*key, "pos").agg(F.min_by("month", "at").alias("month"), F.min("at").alias("_at"))
    hit = rows.join(first, [*key, "pos"]).withColumn("_words", F.split("line", r"[^\p{L}\p{N}_]+"))
    before = lambda n: F.when(F.col("_at") >= n, F.get("_words", F.col("_at") - n))
    day = F.when(fold(before(1), "lower").isin(*joiners) & (F.col("_at") >= 2), before(2)).otherwise(before(1))
    day = F.nullif(F.regexp_replace(day, r"\P{Nd}", ""), F.lit(""))
    digits = F.regexp_replace(F.regexp_extract("_near", rf"(?i){joiners[0]}\s*(\d{{2}}[\s.,]*\d{{0,2}})\b", 1), r"\D", "")
    hit = hit.where(F.length(digits) == 4).withColumn("year", plausible_year(digits.cast("int"))).withColumn("day", F.when(F.length(day) <= 2, day).cast("int"))
    sure = F.col("year").isNotNull()
    parts = F.struct(
        clean_edges(F.substring("_near", 1, 60)).alias("raw"), F.when(sure & F.col("day").between(1, 31), F.col("day")).alias("day"), F.when(sure, F.col("month")).alias("month"), "year",
    )
    best = hit.groupBy(*key).agg(F.min_by(parts, "pos").alias("_d")).select(*key, "_d.*")
    return best.withColumn("arrival", F.when(F.col("day").isNotNull(), F.format_string("%04d-%02d-%02d", "year", "month", "day")))


def entered_near(lines: DataFrame, key: list[str], entered: str, month: Callable[[Column], Column], joiner: str = "de") -> DataFrame:
    """key, raw, day, month, year, arrival: as ``entered_date``, for months that may be misread and joiners that run into the words around them."""
    w = Window.partitionBy(*key).orderBy("pos")
    pattern = rf"(?i){entered}\s*((\S{{1,3}})\s*{joiner}\s*(\p{{L}}{{3,12}})\s*{joiner}\s*(\d{{2}}\s*\d{{0,2}}))"
    near = F.concat_ws(" ", "line", F.lead("line").over(w))
    group = lambda i: F.regexp_extract("_near", pattern, i)
    hit = lines.withColumn("_near", near).where(F.col("_near").rlike(pattern))
    digits = F.regexp_replace(group(4), r"\s+", "")
    parts = F.struct(
        clean_edges(group(1)).alias("raw"), F.when(group(2).rlike(r"^\d{1,2}$"), group(2)).cast("int").alias("day"), fold(group(3), "lower", letters_only=True).alias("word"),
        plausible_year(F.when(F.length(digits) == 4, digits).cast("int")).alias("year"),
    )
    best = cut(hit.groupBy(*key).agg(F.min_by(parts, "pos").alias("_d")).select(*key, "_d.*"))
    best = best.join(best.select("word").distinct().withColumn("month", month(F.col("word"))), "word").drop("word")
    whole = F.col("day").between(1, 31) & F.col("month").isNotNull() & F.col("year").isNotNull()
    return best.withColumn("arrival", F.when(whole, F.format_string("%04d-%02d-%02d", "year", "month", "day")))


#: Fixed value: how high a line of fragments is, in pixels.
LINE_HEIGHT = 30


def fragment_lines(fragments: DataFrame, key: list[str]) -> DataFrame:
    """key, pos, line: fragments (text, x0, y0) as lines in the order the page reads: by bands of ``LINE_HEIGHT``, then from left to right. Empty ones aside."""
    w = Window.partitionBy(*key).orderBy(F.rint(F.col("y0") / LINE_HEIGHT), "x0", "y0", "text")
    rows = fragments.where(F.trim("text") != "")
    return rows.select(*key, (F.row_number().over(w) - 1).alias("pos"), F.trim("text").alias("line"))


def positional(fragments: DataFrame, key: list[str], label: str, plausible: Callable[[Column], Column]) -> DataFrame:
    """key, value: what stands against a printed label on the page, going by place and not by reading order.

    Of the fragments that carry the label (a pattern whose first group is the tail), from the top, the first counts that has a plausible tail or else a
    plausible fragment beside it: the nearest to the right on the same height. ``plausible``: a text, or null if it is no value.
    """
    boxes = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    labels = fragments.where(F.col("text").rlike(label)).withColumn("label", F.struct("y0", "x0", "text"))
    tail = plausible(clean_edges(F.regexp_extract("text", label, 1)))
    values = fragments.where(plausible(F.col("text")).isNotNull()).select(*key, *boxes, "text")
    itself = F.col("x0").eqNullSafe(F.col("lx0")) & F.col("y0").eqNullSafe(F.col("ly0")) & (F.col("x1") == F.col("lx1")) & (F.col("y1") == F.col("ly1"))
    near = beside_fragments(labels.select(*key, "label", *boxes), values, key, besides=~itself)
    found = labels.select(*key, "label", tail.alias("_tail")).join(near, [*key, "label"], "left")
    found = found.withColumn("value", F.coalesce("_tail", clean_edges(F.col("value")))).where(F.col("value").isNotNull())
    return found.groupBy(*key).agg(F.min_by("value", "label").alias("value"))


def value_above(lines: DataFrame, key: list[str], label: str, is_label: Column, skip: Column | None = None) -> DataFrame:
    """key and the nearest line above the first line with the label that has a value: not empty, no label itself, not what ``skip`` says."""
    value = clean_edges(F.trim("line"))
    told = F.lit(False) if skip is None else F.coalesce(value == skip, F.lit(False))
    first = lines.where(F.col("line").rlike(label)).groupBy(*key).agg(F.min("pos").alias("_at"))
    above = lines.withColumn("_value", value).withColumn("_other", is_label | told).join(first, key).where("pos < _at and not _other and _value <> ''")
    return above.groupBy(*key).agg(F.max_by("_value", "pos").alias("value"))


#: What opens and closes a quotation.
QUOTES_OPEN, QUOTES_CLOSE = "\"'“”«‘’„", "\"'“”»‘’"


def quoted_line(lines: DataFrame, key: list[str], refused: tuple[str, ...] = ()) -> DataFrame:
    """key, value: the first line that is nothing but a quoted name, its closing quotation mark there or not; folded names in ``refused`` aside."""
    t = F.trim("line")
    inner = clean_edges(F.trim(F.translate(t, QUOTES_OPEN + QUOTES_CLOSE, "")))
    opens = F.lit(QUOTES_OPEN).contains(F.substring(t, 1, 1)) & (t != "")
    within = F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
    plain = within == F.translate(within, QUOTES_OPEN + QUOTES_CLOSE, "")  # no mark but at the ends
    hit = lines.where(opens & plain & (n_letters(inner) >= 2)).withColumn("_value", inner)
    hit = hit.where(~fold(F.col("_value"), "lower").isin(*refused)) if refused else hit
    return hit.groupBy(*key).agg(F.min_by("_value", "pos").alias("value"))


def entered_date(lines: DataFrame, key: list[str], entered: str, months: dict[str, int], joiner: str = "de", least: int = 1880, most: int = 1935) -> DataFrame:
    """key, raw, day, month, year, arrival: a date behind the words for entering, on one line or run on to the next.

    The parts are read one by one and fail one by one: a month that isn't a name, a day that isn't a number, a year of other than four digits,
    which may stand apart, or out of range. arrival is a date only if all are certain; raw is what stands there.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    near = F.concat_ws(" ", "line", F.lead("line").over(w))
    pattern = rf"(?i){entered}\s+((\S+)\s+{joiner}\s+(\S+)\s+{joiner}\s+(\d(?:\s*\d)*))"
    group = lambda i: F.regexp_extract("_near", pattern, i)
    hit = lines.withColumn("_near", near).where(F.col("_near").rlike(pattern))
    table = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    digits = F.regexp_replace(group(4), r"\s+", "")
    parts = F.struct(
        clean_edges(group(1)).alias("raw"), F.when(group(2).rlike(r"^\d{1,2}$"), group(2)).cast("int").alias("day"), F.try_element_at(table, fold(group(3), "lower")).alias("month"),
        plausible_year(F.when(F.length(digits) == 4, digits).cast("int"), least, most).alias("year"),
    )
    best = hit.groupBy(*key).agg(F.min_by(parts, "pos").alias("_d")).select(*key, "_d.*")
    whole = F.col("day").between(1, 31) & F.col("month").isNotNull() & F.col("year").isNotNull()
    return best.withColumn("arrival", F.when(whole, F.format_string("%04d-%02d-%02d", "year", "month", "day")))
