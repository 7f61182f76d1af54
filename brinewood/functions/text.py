"""Column functions over names and lines: folding, trigrams, marks, ordinals, plausibility.

All are built-in expressions, so they stay in generated code. None fails on odd input: where a value
isn't certain the result is null.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letter_tables() -> tuple[str, str, dict[str, str]]:
    """Letters that decompose, their base letters, and ligatures, from the Unicode database."""
    src, dst, many = [], [], {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    for cp in [0x132, 0x133, *range(0xFB00, 0xFB07)]:
        many[chr(cp)] = unicodedata.normalize("NFKD", chr(cp))
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(src) + marks, "".join(dst), many


_FROM, _TO, _LIGATURES = _letter_tables()


def strip_accents(c: Column) -> Column:
    """Letters without their combining marks."""
    return F.translate(c, _FROM, _TO)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column, case: str = "upper", compat: bool = False, letters_only: bool = False) -> Column:
    """Comparable form of a text: case folded, without accents, trimmed.

    ``compat`` also resolves ligatures; ``letters_only`` keeps letters, digits and white space.
    """
    if compat:
        for k, v in _LIGATURES.items():
            c = F.replace(c, F.lit(k), F.lit(v))
    c = strip_accents(F.upper(c) if case == "upper" else F.lower(c))
    if letters_only:
        c = F.regexp_replace(c, r"[^\p{L}\p{N}\s]", "")
    return F.trim(c)


def trigrams(folded: Column) -> Column:
    """Distinct 3-character windows of a short folded text, padded by two spaces before and one after."""
    p = F.concat(F.lit("  "), folded, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets of grams; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity of two folded texts."""
    return jaccard(trigrams(a), trigrams(b))


#: The last year of the first century is matched by the second branch.
YEAR = r"\b(1[6-9]\d{2}|20[0-2]\d)\b"


def query_year(q: Column) -> Column:
    """The first standalone year of a query, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(q, YEAR, 1), F.lit("")), F.lit("9999")).cast("int")


def query_without_year(q: Column) -> Column:
    """The query with its first year taken out."""
    return F.trim(F.when(F.regexp_extract(q, YEAR, 1) != "", F.regexp_replace(q, r"^([\s\S]*?)" + YEAR + r"([\s\S]*)$", "$1 $3")).otherwise(q))


#: What stands for "the same as above".
MARK_CHARS = "\"“”„«»'‘’,.-=/|〃_~*:;`^·"
MARK_WORDS = ("11", "n", "u", "ii", "il", "li", "y", "v")
_MARK_CLASS = "[" + "".join("\\" + c if c in "-^]\\|.*" else c for c in MARK_CHARS) + "]"


def is_mark(c: Column) -> Column:
    """Whether a reading is a repetition mark."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & (F.lower(t).isin(*MARK_WORDS) | t.rlike(f"^{_MARK_CLASS}+$"))


def after_mark(c: Column) -> Column:
    """What follows a mark glued to a name; null unless one was there and three letters remain."""
    t = F.ltrim(F.coalesce(c, F.lit("")))
    rest = F.ltrim(F.regexp_replace(t, f"^{_MARK_CLASS}+", ""))
    letters = F.length(F.regexp_replace(rest, r"[^\p{L}]", ""))
    return F.when(t.rlike(f"^{_MARK_CLASS}") & (letters >= 3), rest)


_ORDINAL_EDGE = r"[\s.,;:'`\-]"


def strip_ordinal(c: Column) -> Column:
    """A name without the line number before it; a cell with only a number is empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(rf"^{_ORDINAL_EDGE}*\d{{1,3}}{_ORDINAL_EDGE}*$"), F.lit("")).otherwise(
        F.trim(F.regexp_replace(t, rf"^{_ORDINAL_EDGE}*\d{{1,3}}{_ORDINAL_EDGE}+", ""))
    )


def surname(c: Column) -> Column:
    """All words but the last; a single word is a surname; null for a blank text."""
    w = F.split(squeeze(F.coalesce(c, F.lit(""))), " ")
    return F.when(squeeze(F.coalesce(c, F.lit(""))) == "", None).when(F.size(w) == 1, F.element_at(w, 1)).otherwise(F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), " "))


def given_name(c: Column) -> Column:
    """The last word; empty for a single word; null for a blank text."""
    w = F.split(squeeze(F.coalesce(c, F.lit(""))), " ")
    return F.when(squeeze(F.coalesce(c, F.lit(""))) == "", None).when(F.size(w) == 1, F.lit("")).otherwise(F.element_at(w, -1))


def row_text(ditto: Column, raw: Column, surname_: Column, given: Column) -> Column:
    """The text a row is searched by: resolved names if something was inherited, else the reading, else given and surname."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.when(F.size(F.coalesce(ditto, F.array().cast("array<string>"))) > 0, F.concat_ws(" ", some(surname_), some(given))).otherwise(
        F.coalesce(some(raw), F.trim(F.concat_ws(" ", some(given), some(surname_))))
    )


def clean_edges(c: Column) -> Column:
    """A value without white space and punctuation at its ends."""
    return F.regexp_replace(c, r"^[\s.,;:\-_·\"“”'’]+|[\s.,;:\-_·\"“”'’]+$", "")


def n_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def plausible_value(c: Column) -> Column:
    """The value if it has four letters, is at least half letters, and has a word of three; else null."""
    dense = n_letters(c) * 2 >= F.length(F.replace(c, F.lit(" "), F.lit("")))
    word = F.exists(F.split(c, r"\s+"), lambda w: n_letters(w) >= 3)
    return F.when((n_letters(c) >= 4) & dense & word, c)


#: Years a dossier can be from.
FIRST_YEAR, LAST_YEAR = 1880, 1935
MONTH_STAMPS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def plausible_year(c: Column, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    return F.when(c.between(first, last), c)


def stamp_year(c: Column, months: tuple[str, ...] = MONTH_STAMPS) -> Column:
    """The year at the end of a date stamp's digits; null if the stamp is broken or the year implausible."""
    digits = F.regexp_replace(F.regexp_extract(c, r"(?i)\b(" + "|".join(months) + r")\.?\s*([\d\s]{4,12})", 2), r"\s+", "")
    tail = F.right(digits, F.lit(4))
    return plausible_year(F.when(F.length(digits).between(4, 6) & tail.rlike(r"^1[89]\d\d$"), tail).cast("int"))


def repair_double_encoding(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; anything else unchanged."""
    suspicious = c.rlike("[ÃÂ]") & ~c.rlike("[^\\u0000-\\u00FF]")
    raw = F.encode(F.regexp_replace(c, "[^\\u0000-\\u00FF]", "?"), "ISO-8859-1")
    return F.when(suspicious & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(c)


def present(c: Column) -> Column:
    """Null for a missing, empty or zero value."""
    text = c.cast("string")
    return F.when((text != "") & (text != "0"), c)
