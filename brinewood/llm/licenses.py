"""License scans: fuzzy search for short notices in whole texts.

Every notice may differ in ``errors`` characters. It is cut into ``errors + 1`` pieces, of which at least one must
then stand unchanged in the text (pigeonhole). One automaton finds all pieces of all notices; where a piece stands,
the regex library matches the notice with at most that many errors and reports what it covers.

Texts are read as words: ASCII letters lower-cased, words of letters, digits and non-ASCII characters, joined
by single spaces. ``BASE`` phrases are also counted without errors, at every place where their words stand.

Cases: a null text is empty; no words give 0 places, null first and last word, empty labels and score 0; repeated
rows are scanned each; a notice longer than the text can't match; very long texts are read whole, in time linear in
their length; places that tie for first go by label; an empty table gives an empty result; only doc_id and text are read,
so extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_of

#: Fixed values of the contract: phrase, label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Further notices: phrase, label, errors that are let pass.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("this program is free software you can redistribute it and or modify it", "gpl", 6),
    ("apache license", "apache", 1),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("cc by", "cc-by", 0),
    ("cc by nc", "cc-by-nc", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("cc by nd", "cc-by-nd", 0),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("creative commons zero", "cc0", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("free and unencumbered software released into the public domain", "unlicense", 5),
)
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in range(256))


class Span(NamedTuple):
    label: str
    first_word: int
    last_word: int
    errors: int
    size: int


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` nearly equal pieces with their offsets."""
    edge = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


@cache
def _machine():
    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (phrase, _, errors) in enumerate(NOTICES):
        patterns.append(regex.compile(rf"(?<= )(?:{phrase}){{e<={errors}}}(?= )" if errors else rf"(?<= ){phrase}(?= )", regex.BESTMATCH))
        for at, piece in pieces(phrase, errors):
            seeds.setdefault(piece, []).append((i, at))
    machine = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        machine.add_word(piece, (len(piece), uses))
    machine.make_automaton()
    return machine, patterns


def scan(text: bytes) -> tuple[int, list[tuple[str, int]], list[Span]]:
    """Number of words; (label, first word) of every base place; spans of notices with their errors."""
    words = text.translate(_TABLE).split()
    line = f" {b' '.join(words).decode('latin-1')} "  # a character per byte: places stay what they are
    starts = list(accumulate((len(w) + 1 for w in words), initial=1))  # where each word begins, so that places cost a bisection each
    word_at = lambda at: bisect_right(starts, at) - 1
    machine, patterns = _machine()
    tried: set[tuple[int, int]] = set()
    found: dict[tuple[int, int, int], Span] = {}
    for end, (size, uses) in machine.iter(line):
        for i, at in uses:
            phrase, label, errors = NOTICES[i]
            begin = end - size + 1 - at
            if (i, begin) in tried:
                continue
            tried.add((i, begin))
            low = max(0, begin - errors - 1)
            m = patterns[i].search(line, low, min(len(line), begin + len(phrase) + errors + 1))
            if m:
                wrong = sum(m.fuzzy_counts) if errors else 0
                key = (i, m.start(), m.end())
                if key not in found or found[key].errors > wrong:
                    first = word_at(m.start())
                    found[key] = Span(label, first, first + m.group().count(" "), wrong, len(phrase))
    base = []
    for phrase, label in BASE:
        pad, at = f" {phrase} ", -1
        while (at := line.find(pad, at + 1)) >= 0:
            base.append((label, word_at(at + 1)))
    return len(words), base, sorted(found.values(), key=lambda x: (x.first_word, x.last_word, x.label))


def _row(text: bytes) -> tuple:
    n, base, spans = scan(text)
    at = [x for _, x in base]
    own = {x for x, _ in base}
    score = max([1.0] if base else [0.0], default=0.0)
    score = max([score, *(1.0 - x.errors / x.size for x in spans)])
    return (
        n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x.label for x in spans})), float(score),
        ",".join(f"{x.label}:{x.first_word}:{x.last_word + 1}:{x.errors}" for x in spans),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document n_words, n_base, first_word, last_word, base_labels, labels, score, and the spans (label:first:end:errors)."""
    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_row(t.as_py()) for t in b.column("text")]
            cols = list(zip(*got, strict=True)) if got else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return rows.mapInArrow(of, schema)
