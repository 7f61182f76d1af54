"""Voyage records from form text: one record per page, folded over a document's pages.

``Lexicon`` holds all words the rules look for; nothing of a language is built in. A page is one of two forms or none,
told by its marks; each field is read from where its label is, by place on the page if the page's fragments are given, else from the label's line or
its neighbours; it is refused unless plausible, and null otherwise. What a text can be (a ship, a nationality, a month) is judged once per
distinct text, not per page.

Cases: null and empty texts are no forms; a page with fragments is read from these alone; of equal candidates the one further up counts; a page's rows may stand in any
order; columns besides the key and the text (or box) are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewood.functions import text as t
from brinewood.functions.lexical import FLAG_FLOOR, FORM_FLOOR, flag_words, month_number, near_any, near_text, strip_leading_marks
from brinewood.operators import extract
from brinewood.sources.store import cut

#: Fixed values.
MOST_SHIP_CHARS, LEAST_SHIP_WORD, PORT_LINES, HEAD_LINES, LEAST_HEAD, LETTERHEAD_FLOOR = 40, 5, 8, 6, 8, 0.85
#: Fixed patterns: a footnote's mark, a quoted name, one whose closing mark is lost, and signs before a ship's name.
FOOTNOTE, QUOTED, QUOTED_OPEN, BEFORE_SHIP = r"^[(\[]?\d{1,2}[)\]]?$", r"[\"“”]\s*([^\"“”]{2,40}?)\s*[\"“”]", r"^\s*[\"“”]\s*(\p{L}[\p{L}\p{N}_'’\- ]{2,30})\s*$", r"^[()\[\]{}·.,\-— ]+"
#: Fixed patterns of lines that stand where a letterhead stands: a long number, a notation in parts, the number of a form.
LONG_NUMBER, DOTTED, FORM_NUMBER = r"\d{4,}", r"([\p{L}\p{N}_]{1,5}\.){3,}", r"(?i)^(n|no|num|mod|modelo)\b.*\d"


@dataclass(frozen=True)
class Lexicon:
    """Marks of either form, labels (patterns whose first group is the value), months, nationalities and the form's own words."""

    parte_marks: tuple[str, ...]
    lista_marks: tuple[str, ...]
    ship_label: str
    origin_label: str
    landed_label: str
    months: tuple[tuple[str, int], ...]
    flags: tuple[str, ...] = ()
    form_words: tuple[str, ...] = ()
    #: What a place's name is made of, and how long it is.
    place: str = r"^\p{L}[\p{L}.' ]*$"
    place_chars: tuple[int, int] = (3, 24)
    not_head: tuple[str, ...] = ()
    #: A second label that a ship may stand beside, the words for entering, what joins the parts of a date, and ports, which are no companies.
    list_label: str = ""
    entered: str = ""
    joiners: tuple[str, ...] = ("de", "do")
    ports: tuple[str, ...] = ()

    def month(self) -> Callable[[Column], Column]:
        """A folded word's month, if it is near the name of one."""
        return month_number(tuple(tuple(name for name, n in self.months if n == k) for k in range(1, 13)))


def judged(values: DataFrame, lex: Lexicon) -> DataFrame:
    """value, flag, flagged, month, ship, rest of every distinct ``value``.

    ship is the value if it can be a ship's name; rest the same of what follows the nationalities and footnotes it begins with, which are flag. flagged says that
    the whole is a nationality, month which month it is.
    """
    v = cut(values.where("value <> ''").select("value").distinct())  # once for all that follows: the values are read off the lines
    v = v.withColumn("_whole", t.fold(F.col("value"), "lower", letters_only=True))
    each = v.select("value", F.posexplode(F.split("value", r"\s+")).alias("_i", "_w")).withColumn("_f", t.fold(F.col("_w"), "lower", letters_only=True))
    words = each.select("_f").unionByName(v.select(F.col("_whole").alias("_f"))).distinct()
    words = words.withColumn("_flag", near_any(lex.flags, FLAG_FLOOR, 4)(F.col("_f"))).withColumn("_form", F.col("_flag") | near_any(lex.form_words, FORM_FLOOR, 3)(F.col("_f")))
    words = cut(words.withColumn("_month", lex.month()(F.col("_f"))))
    kinds = F.struct("_i", "_w", "_f", "_flag", ((F.length("_f") >= 3) & F.col("_form")).alias("_form"), (F.col("_flag") | F.col("_w").rlike(FOOTNOTE) | ~F.col("_w").rlike(r"[\p{L}\p{N}]")).alias("_mark"))
    each = each.join(words, "_f").groupBy("value").agg(F.sort_array(F.collect_list(kinds)).alias("_words"))
    whole = words.select(F.col("_f").alias("_whole"), F.col("_flag").alias("flagged"), F.col("_month").alias("month"))
    out = v.join(each, "value").join(whole, "_whole")
    pick = lambda c: F.transform("_words", lambda x: x[c])
    marks = pick("_mark")
    n = F.coalesce(F.array_min(F.filter(F.transform(marks, lambda m, i: F.when(~m, i)), lambda x: x.isNotNull())), F.size(marks))
    head = F.filter(F.slice("_words", F.lit(1), n), lambda x: x["_flag"])
    out = out.withColumn("_n", F.when(n < F.size(marks), n).otherwise(0)).withColumn("flag", F.nullif(F.array_join(F.transform(head, lambda x: x["_w"]), " "), F.lit("")))
    out = out.withColumn("flag", F.when(F.col("_n") > 0, F.col("flag"))).withColumn("_own", F.slice("_words", F.col("_n") + 1, F.greatest(F.size("_words") - F.col("_n"), F.lit(0))))
    rest = F.when(F.col("_n") > 0, t.clean_edges(F.array_join(F.transform("_own", lambda x: x["_w"]), " "))).otherwise(F.col("value"))

    def ship(value: Column, of: Column) -> Column:
        long_word = F.exists(of, lambda x: F.length(x["_f"]) >= LEAST_SHIP_WORD)
        fine = t.plausible_value(value).isNotNull() & (F.length(value) <= MOST_SHIP_CHARS) & long_word & ~F.exists(of, lambda x: x["_form"])
        return F.nullif(F.when(fine, t.clean_edges(F.regexp_replace(value, BEFORE_SHIP, ""))), F.lit(""))

    return out.select("value", "flag", "flagged", "month", F.when(~F.col("flagged"), ship(F.col("value"), F.col("_words"))).alias("ship"), ship(rest, F.col("_own")).alias("rest"))


def letterheads(lines: DataFrame, key: list[str], lex: Lexicon, is_label: Column) -> DataFrame:
    """key, line: the first of the topmost lines that can be a shipping company's."""
    rows = lines.where((F.col("pos") < HEAD_LINES) & ~is_label).withColumn("_f", t.fold(F.regexp_replace("line", r"[^\p{L}\p{N}_\s]+", " "), "lower"))
    other = F.col("line").rlike(LONG_NUMBER) | F.col("line").rlike(DOTTED) | F.col("_f").rlike(FORM_NUMBER)
    rows = cut(rows.where((F.length("_f") >= LEAST_HEAD) & t.plausible_value(t.clean_edges(F.col("line"))).isNotNull() & ~other))
    if lex.not_head:  # words that are like ones no company's name has
        bad = flag_words(rows, [*key, "pos"], "line", near_any(lex.not_head, FORM_FLOOR, 4), "_bad").where("_bad > 0").select(*key, "pos")
        rows = rows.join(bad, [*key, "pos"], "left_anti")
    if lex.ports:
        port = cut(rows.select("_f").distinct()).withColumn("_port", near_any(lex.ports, LETTERHEAD_FLOOR)(F.col("_f"))).where("_port").select("_f")
        rows = rows.join(port, "_f", "left_anti")
    return extract.first_line(rows, key, F.lit(True)).select(*key, t.clean_edges(F.col("line")).alias("line"))


def parse_pages(pages: DataFrame, lex: Lexicon, key: tuple[str, ...] = ("doc", "page"), text: str = "text", fragments: DataFrame | None = None) -> DataFrame:
    """One row per page that is a form: key, source, ship, flag, origin, line, port, arrival, arrival_raw, year, year_source, month, passengers.

    ``fragments``: key, text, x0, y0, x1, y1 of pages whose boxes are known; these are read by place.
    """
    k = list(key)
    lines = extract.lines_of(pages, k, text)
    if fragments is not None:
        boxes = cut(fragments.select(*k, "text", "x0", "y0", "x1", "y1"))
        lines = lines.join(boxes.select(*k).distinct(), k, "left_anti").unionByName(extract.fragment_lines(boxes, k))
    lines = lines.withColumn("line", t.squeeze(F.col("line"))).where(F.col("line") != "")
    w = Window.partitionBy(*k).orderBy("pos")
    lines = lines.withColumn("pos", F.row_number().over(w) - 1).withColumn("_folded", t.fold(F.col("line"), "lower"))
    marks = [*lex.parte_marks, *lex.lista_marks]
    label = F.lower("line").rlike("|".join((lex.ship_label, lex.origin_label, lex.landed_label))) | (extract.mark_count(F.col("_folded"), marks) > 0)
    lines = cut(lines.withColumn("_label", label))  # folding is dear: once for all that asks whether a line is a label
    whole = lines.groupBy(*k).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("pos", "_folded"))), lambda x: x["_folded"])).alias("_all"))
    lines, is_label = lines.drop("_folded"), F.col("_label")
    out = whole.select(*k, extract.mark_count(F.col("_all"), list(lex.parte_marks)).alias("_p"), extract.mark_count(F.col("_all"), list(lex.lista_marks)).alias("_l"))

    place = F.trim(F.get(F.split("line", ",", 2), 0))  # what a line says before its first comma
    named = F.col("line").contains(",") & place.rlike(lex.place) & F.length(place).between(*lex.place_chars)
    places = lines.where((F.col("pos") < PORT_LINES) & named & ~is_label).select(*k, "pos", place.alias("value"))
    quotes = lines.select(*k, "pos", F.regexp_extract("line", QUOTED, 1).alias("_a"), F.regexp_extract("line", QUOTED_OPEN, 1).alias("_b"))
    quotes = quotes.select(*k, "pos", (F.col("_a") == "").alias("open"), t.clean_edges(F.when(F.col("_a") != "", F.col("_a")).otherwise(F.col("_b"))).alias("value")).where("value <> ''")
    label, above = rf"(?i){lex.ship_label}", Window.partitionBy(*k).orderBy(F.desc("pos"))
    beside = extract.value_beside(lines, k, label, is_label).select(*k, t.clean_edges(F.col("value")).alias("beside"))
    first = lines.where(F.col("line").rlike(label)).groupBy(*k).agg(F.min("pos").alias("_at"))
    up = lines.join(first, k).where((F.col("pos") < F.col("_at")) & ~is_label).select(*k, "pos", t.clean_edges(F.col("line")).alias("value")).where("value <> ''")
    up = up.withColumn("_top", F.first("value").over(above))  # the nearest line above, and the nearest that says something else
    up = up.groupBy(*k).agg(F.max_by("value", "pos").alias("above"), F.max_by("value", F.when(F.col("value") != F.col("_top"), F.col("pos"))).alias("above2"))
    placed: DataFrame | None = None
    if fragments is not None:
        found = [extract.positional(boxes, k, rf"(?i){p}", t.plausible_value).withColumnRenamed("value", name) for p, name in ((lex.ship_label, "_p1"), (lex.list_label, "_p2"), (lex.origin_label, "_po")) if p]
        placed = found[0]
        for more in found[1:]:
            placed = placed.join(more, k, "full")
        placed = cut(placed.select(*k, F.coalesce("_p1", *[c for c in ["_p2"] if lex.list_label]).alias("placed"), "_po"))
    beside = cut(beside.join(up, k, "full"))
    texts = [places.select("value"), quotes.select("value"), *[beside.select(F.col(c).alias("value")) for c in ("beside", "above", "above2")]]
    texts += [placed.select(F.col("placed").alias("value"))] if placed is not None else []
    every = texts[0]
    for more in texts[1:]:
        every = every.unionByName(more)
    known = cut(judged(every, lex))
    known = F.broadcast(known) if known.count() <= extract.SPELLINGS else known  # pages needn't be shuffled by what they say

    def told(rows: DataFrame, column: str, *wanted: str) -> DataFrame:
        names = known.select(F.col("value").alias(column), *[F.col(x).alias(f"{column}_{x}") for x in wanted])
        return rows.join(names, column, "left")

    port = places.join(known.where("month is null").select("value"), "value").groupBy(*k).agg(F.min_by("value", "pos").alias("port"))
    quote = quotes.join(known.where("month is null").select("value", "ship"), "value").groupBy(*k)
    quote = quote.agg(F.min_by(F.struct("value", "ship"), F.struct("open", "pos")).alias("quoted"), F.min_by("ship", "pos").alias("quoted_ship"))
    out = out.join(port, k, "left").join(letterheads(lines, k, lex, is_label), k, "left").join(beside, k, "left").join(quote, k, "left")
    out = out.join(placed, k, "left") if placed is not None else out.withColumns({c: F.lit(None).cast("string") for c in ("placed", "_po")})
    out = out.withColumn("source", extract.form_kind(F.col("_p"), F.col("_l"), F.col("port").isNotNull(), F.col("line").isNotNull())).where("source is not null")
    out = out.withColumn("said", F.when(F.col("source") == "lista", F.coalesce("placed", "beside")).otherwise(F.col("beside")))
    for column, wanted in (("said", ("flag", "flagged", "rest")), ("above", ("ship",)), ("above2", ("ship",))):
        out = told(out, column, *wanted)
    # A list has the ship beside the label, a nationality perhaps before it, or alone; the other form has the nationality there, and the ship in quotes or above.
    within = F.col("quoted.value").isNotNull() & F.contains(F.col("said"), F.col("quoted.value"))
    parte_flag = F.when(within, F.nullif(t.clean_edges(F.substr("said", F.lit(1), F.position(F.col("quoted.value"), F.col("said")) - 1)), F.lit(""))).otherwise(F.nullif(F.col("said"), F.lit("")))
    over = lambda flag: F.when(F.col("above").eqNullSafe(flag), F.col("above2_ship")).otherwise(F.col("above_ship"))
    lista = F.col("source") == "lista"
    flagged = F.coalesce("said_flagged", F.lit(False))
    out = out.withColumn("flag", F.when(lista, F.when(flagged, F.col("said")).otherwise(F.lower("said_flag"))).otherwise(parte_flag))
    one = F.when(lista, F.when(flagged, over(F.col("said"))).otherwise(F.col("said_rest"))).otherwise(F.when(F.col("quoted").isNotNull(), F.col("quoted.ship")).otherwise(over(F.col("flag"))))
    out = cut(out.withColumns({"_s1": one, "_s2": F.when(lista, F.col("quoted_ship"))}).select(*k, "source", "flag", "line", "port", "_po", "_s1", "_s2"))
    # What stands nearest the label where no ship was written is the letterhead: not taken for one.
    f = lambda c: t.fold(F.col(c), "lower", letters_only=True)
    pairs = out.where("line is not null").select(F.explode(F.array("_s1", "_s2")).alias("ship"), "line").where("ship is not null").distinct()
    pairs = cut(pairs)  # else the test goes down past distinct, to every page
    same = cut(pairs.withColumn("_same", near_text(LETTERHEAD_FLOOR)(f("ship"), f("line"))).where("_same").select("ship", "line"))
    same = F.broadcast(same) if same.count() <= extract.SPELLINGS else same
    for c in ("_s1", "_s2"):
        out = out.join(same.select(F.col("ship").alias(c), "line", F.lit(True).alias(f"{c}_no")), [c, "line"], "left")
    out = out.withColumn("ship", F.coalesce(*[F.when(F.col(f"{c}_no").isNull(), F.col(c)) for c in ("_s1", "_s2")]))

    origin = extract.value_beside(lines, k, rf"(?i){lex.origin_label}", is_label).select(*k, t.clean_edges(F.col("value")).alias("_o"))
    month = lex.month()
    dates = extract.dateline_near(lines, k, month, lex.joiners).select(*k, F.struct("arrival", "raw", "month", "year").alias("_d"))
    entered = extract.entered_near(lines, k, lex.entered, month, lex.joiners[0]) if lex.entered else None
    if entered is not None:
        dates = dates.join(entered.select(*k, F.struct("arrival", "raw", "month", "year").alias("_e")), k, "full")
    else:
        dates = dates.withColumn("_e", F.lit(None).cast(dates.schema["_d"].dataType))
    stamp = lines.select(*k, "pos", t.stamp_year(F.col("line")).alias("_s")).where("_s is not null").groupBy(*k).agg(F.min_by("_s", "pos").alias("_stamp"))
    near = F.lower(F.concat_ws(" ", "line", F.lead("line").over(w)))
    landed = lines.withColumn("_near", near).where(F.col("_near").rlike(lex.landed_label)).groupBy(*k).agg(F.min_by(F.regexp_extract("_near", lex.landed_label, 1), "pos").alias("_n"))
    for part in (origin, dates, stamp, landed):
        out = out.join(part, k, "left")
    late = (F.col("source") == "lista") & F.col("_e.year").isNull()  # the date line counts on a list, where the date of entering has no year
    field = lambda c: F.coalesce(F.when(late, F.col(f"_d.{c}")), F.col(f"_e.{c}"))
    printed = field("year")
    return out.select(
        *k, "source", "ship", "flag", t.plausible_value(strip_leading_marks(F.coalesce(F.when(F.col("source") == "lista", F.col("_po")), F.col("_o")))).alias("origin"),
        F.when(F.col("source") == "lista", F.col("line")).alias("line"), F.when(F.col("source") == "lista", F.col("port")).alias("port"),
        field("arrival").alias("arrival"), field("raw").alias("arrival_raw"), F.coalesce(printed, "_stamp").alias("year"),
        F.when(printed.isNotNull(), F.lit("printed")).when(F.col("_stamp").isNotNull(), F.lit("stamp")).alias("year_source"), field("month").alias("month"),
        F.when((F.col("source") == "parte") & F.col("_n").rlike(r"^\d{1,4}$"), F.col("_n")).cast("int").alias("passengers"),
    )


FIELDS = ["source", "ship", "flag", "origin", "line", "port", "arrival", "arrival_raw", "month", "passengers"]


def fold_documents(pages: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """One record per document: each field's first value in page order, a printed year before a stamped one."""
    return extract.merge_records(pages, [doc], [page], FIELDS, "year", "year_source")


def reparse(pages: DataFrame, stored: DataFrame, lex: Lexicon, doc: str = "doc") -> DataFrame:
    """Records whose fields are others when their stored forms are parsed anew; what hasn't changed isn't written."""
    fresh = fold_documents(parse_pages(pages, lex))
    old = stored.select(F.col(doc), F.struct(*FIELDS, "year", "year_source").alias("_old"))
    both = fresh.withColumn("_new", F.struct(*FIELDS, "year", "year_source")).join(old, doc, "full")
    return both.where(~F.col("_new").eqNullSafe(F.col("_old"))).drop("_new", "_old")
