"""Catalogues: entries parsed from wrapped lines, notations, addresses, first-wins and precedence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewood.functions.text import fold


def join_wrapped(lines: DataFrame, key: list[str], starts: Column, closes: Column) -> DataFrame:
    """key, entry (from 1), first_pos, n_lines, text: entries that begin at a start and run on until the next start or a closing line."""
    w = Window.partitionBy(*key).orderBy("pos")
    rows = lines.withColumn("_start", starts).withColumn("_close", closes & ~starts)
    rows = rows.withColumn("entry", F.sum(F.col("_start").cast("int")).over(w))
    within = Window.partitionBy(*key, "entry").orderBy("pos")
    rows = rows.withColumn("_closed", F.max(F.col("_close").cast("int")).over(within)).where((F.col("entry") > 0) & (F.col("_closed") == 0))
    parts = F.sort_array(F.collect_list(F.struct("pos", F.trim("line").alias("line"))))
    out = rows.groupBy(*key, "entry").agg(parts.alias("p"))
    return out.select(*key, F.col("entry").cast("long").alias("entry"), F.col("p")[0]["pos"].alias("first_pos"), F.size("p").cast("long").alias("n_lines"), F.array_join(F.transform("p", lambda x: x["line"]), " ").alias("text"))


def parts_of(c: Column, pattern: str, *names: str) -> list[Column]:
    """The groups of a pattern as upper-case columns, null where it doesn't match."""
    return [F.nullif(F.upper(F.regexp_extract(c, pattern, i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)]


def padded_index(index: Column, width: Column) -> Column:
    """An index with its digits padded to a width and its letter kept."""
    digits, letter = F.regexp_extract(index, r"^(\d+)", 1), F.regexp_extract(index, r"^\d+([A-Z]*)", 1)
    return F.concat(F.when(F.length(digits) < width, F.lpad(digits, width, F.lit("0"))).otherwise(digits), letter)


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of every key."""
    return first_wins(rows, key, [F.desc(c) for c in order])


def fill_from(records: DataFrame, catalogue: DataFrame, key: str, value: str) -> DataFrame:
    """``records`` whose empty ``value`` is filled from the catalogue; what a record says itself goes first."""
    dim = catalogue.select(key, F.col(value).alias("_catalogued")).where(F.col("_catalogued") != "")
    return records.join(dim, key, "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("_catalogued"))).drop("_catalogued")


def candidate_parts(entries: DataFrame, most: int = 8) -> DataFrame:
    """Every (part, total) an entry's files may be numbered by, totals from 1 to ``most``."""
    both = entries.withColumn("total", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return both.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("total"))))


#: Fixed value: parts that a record has at most.
MOST_PARTS = 8


def listed_parts(files: DataFrame, name: str, pattern: str = r"^(.*)_d(\d+)de(\d+)\.\w+$") -> DataFrame:
    """folder, part, total of files by their names; names of other kinds aside. ``pattern``: groups are the record's folder, the part, and how many there are."""
    rows = files.where(F.col(name).rlike(pattern))
    group = lambda i: F.regexp_extract(name, pattern, i)
    return rows.select(group(1).alias("folder"), *[group(i).cast("int").alias(c) for i, c in ((2, "part"), (3, "total"))]).distinct()


def resolve_parts(entries: DataFrame, key: list[str], listed: DataFrame, most: int = MOST_PARTS) -> DataFrame:
    """key, folder, total, part, present: the files that each entry's record is made of, one row per part.

    ``entries``: key, folder and see_also (another record's folder, or null). An entry's own folder goes before the one it refers to, and in a folder the smallest
    total whose first part is there; what is there of ``listed`` (folder, part, total) is met by joins on the folder, nothing is tried one by one. Entries of
    which nothing is there have no row. ``present`` says whether a part is there itself.
    """
    asked = entries.select(*key, F.posexplode(F.array("folder", "see_also")).alias("_rank", "folder")).where("folder is not null")
    first = listed.where((F.col("part") == 1) & F.col("total").between(1, most)).select("folder", "total").distinct()
    best = asked.join(first, "folder").groupBy(*key).agg(F.min(F.struct("_rank", "total", "folder")).alias("_b"))
    parts = best.select(*key, "_b.folder", "_b.total", F.explode(F.sequence(F.lit(1), F.col("_b.total"))).alias("part"))
    there = listed.select("folder", "total", "part", F.lit(True).alias("_there")).distinct()
    return parts.join(there, ["folder", "total", "part"], "left").select(*key, "folder", "total", "part", F.coalesce("_there", F.lit(False)).alias("present"))


@dataclass(frozen=True)
class Grammar:
    """How a collection writes its notations and titles. ``notation``: one tuple of spellings per part, in order; the names fundo, series and
    index stand for what a notation varies in. The other fields are folded words that say what a part of a title is.
    """

    notation: tuple[tuple[str, ...], ...]
    numbered: str
    levels: tuple[str, ...]
    named_after: str
    see: tuple[str, ...]
    notes: tuple[tuple[str, ...], ...]
    unnamed: str


#: Fixed values of the archive's own notations, titles and addresses.
ARCHIVE = Grammar(
    notation=(("BR",), ("RJANRIO", "RJ AN RIO", "AN RIO", "A RIO"), ("fundo",), ("0",), ("RPV",), ("series",), ("index",)),
    numbered="rv",
    levels=("dossie", "item", "serie"),
    named_after="vapor",
    see=("ver", "br"),
    notes=(("nota",), ("ver", "br"), ("requisicao", "da", "listagem"), ("procedencia",), ("fora", "da", "ordem")),
    unnamed="sem notação",
)
_VARIED = {"fundo": "([A-Z]{2})", "series": "([A-Z]{3})", "index": "([0-9]+[A-Z]?)"}


def spaced(c: Column) -> Column:
    """A text in capitals with one space for whatever stands between letters and digits, and one around it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def notation(c: Column, grammar: Grammar = ARCHIVE) -> Column:
    """The varied parts of the first notation in a text (fundo, series, index), null if there is none.

    The text is brought to one separator first, so that dots, underscores, blanks or nothing between parts are all the same.
    """
    parts = []
    for spellings in grammar.notation:
        parts.append(_VARIED.get(spellings[0]) or "(?:" + "|".join(x.replace(" ", " ?") for x in spellings) + ")")
    pattern, flat = " " + " ?".join(parts) + " ", spaced(c)
    order = [p[0] for p in grammar.notation if p[0] in _VARIED]
    found = {name: F.regexp_extract(flat, pattern, i + 1) for i, name in enumerate(order)}
    return F.when(flat.rlike(pattern), F.struct(*[found[k].alias(k) for k in ("fundo", "series", "index")]))


def identify(file: Column, cover: Column, content_hash: Column, grammar: Grammar = ARCHIVE) -> dict[str, Column]:
    """notation, identified_by and label of a document: its cover goes before its file name, and a hash stands in for both."""
    read = {"cover": notation(cover, grammar), "filename": notation(file, grammar)}
    whole = lambda n: F.when(n.isNotNull(), F.concat_ws(".", n["fundo"], n["series"], n["index"]))
    found = F.coalesce(*[whole(n) for n in read.values()])
    return {
        "notation": found,
        "identified_by": F.coalesce(*[F.when(n.isNotNull(), F.lit(k)) for k, n in read.items()], F.lit("unknown")),
        "label": F.coalesce(found, F.concat(F.lit(f"{grammar.unnamed} ("), F.substring(content_hash, 1, 8), F.lit(")"))),
    }


def _first(words: Column, phrases: tuple[tuple[str, ...], ...]) -> Column:
    """Place (from 0) of the first word at which one of the phrases begins, each of its words by how it begins; null if none does."""
    starts = lambda i, phrase: reduce(and_, [F.coalesce(F.get(words, i + k).startswith(x), F.lit(False)) for k, x in enumerate(phrase)])
    hit = F.transform(words, lambda _, i: F.when(reduce(or_, [starts(i, p) for p in phrases]), i))
    return F.array_min(F.filter(hit, lambda i: i.isNotNull()))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is asked for there."""
    return F.transform(F.array(value), use)[0]


def title_parts(c: Column, grammar: Grammar = ARCHIVE) -> dict[str, Column]:
    """ship, rv number and see_also (three parts) of a catalogue title; each null if it isn't there.

    A title is read as words, each also in folded form without its punctuation. What stands in brackets and opens with the word for a
    number is the number. Of the rest the first word of a note, or of a level that ends the title, ends the name, which
    begins after the word it is named after; the cross-reference is the notation behind the words that announce one.
    """
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    bracketed = F.transform(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.trim(x))
    is_number = lambda x: F.lower(x).startswith(grammar.numbered)
    number = F.get(F.filter(bracketed, is_number), 0)
    open_ = F.regexp_replace(c, rf"(?i)\(\s*{grammar.numbered}[^()]*\)", " ")
    words = F.filter(F.split(F.regexp_replace(open_, r"(?<=\s)[-–]|[-–](?=\s|$)", " - "), r"\s+"), lambda w: w != "")
    plain = lambda words: F.transform(words, lambda w: F.regexp_replace(fold(w, "lower"), r"[^\p{L}\p{N}]+", ""))

    def read(words: Column, plain: Column) -> Column:
        n = F.size(words)
        last = F.coalesce(F.try_element_at(plain, F.lit(-1)), F.lit(""))
        levelled = (n >= 2) & (F.get(words, n - 2) == "-") & reduce(or_, [last.startswith(x) for x in grammar.levels])
        note = F.coalesce(_first(plain, grammar.notes), n)
        end = F.least(note, F.when(levelled, n - 2).otherwise(n))
        begin = F.array_position(plain, grammar.named_after).cast("int")
        ship = F.when((begin > 0) & (begin < end), F.array_join(F.slice(words, begin + 1, F.greatest(end - begin, F.lit(0))), " "))
        see = _first(plain, (grammar.see,))
        told = F.when(see.isNotNull(), F.array_join(F.slice(words, see + 1, n), " "))
        return F.struct(ship.alias("ship"), told.alias("told"))

    parts = _named(words, lambda w: _named(plain(w), lambda p: read(w, p)))
    see_also = _named(parts["told"], lambda t: notation(t, grammar))
    return {"ship": some(F.regexp_replace(parts["ship"], r"^[-.\s]+|[-.\s]+$", "")), "rv": some(F.substr(number, F.lit(len(grammar.numbered) + 1))), "see_also": see_also}


def address(base: Column, fundo: Column, series: Column, index: Column, width: Column, part: Column, total: Column) -> Column:
    """Where one file of an entry is kept: its folder has the padded index, its name the part and how many there are."""
    folder = padded_index(index, width)
    stem = F.concat_ws("_", F.lit("BR_RJANRIO"), fundo, F.lit("0_RPV"), series, folder)
    return F.concat(base, F.lit("/BR_RJANRIO_"), fundo, F.lit("/0/RPV/"), series, F.lit("/"), folder, F.lit("/"), stem, F.format_string("_d%04dde%04d.pdf", part, total))


def follow(entries: DataFrame) -> DataFrame:
    """``entries`` with ``via``, the entry (fundo, series, index) that a stated cross-reference leads to; the letter of an index is never dropped."""
    there = entries.select(F.struct(F.col("fundo"), F.col("series"), F.col("index")).alias("via")).distinct()
    return entries.join(there, F.col("see_also") == F.col("via"), "left")
