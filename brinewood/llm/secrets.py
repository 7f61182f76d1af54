"""Secret scans: fixed patterns, and a battery of randomness tests over other tokens.

A token of letters, digits and a few signs gets the narrowest encoding (decimal, hexadecimal, letters, base 32, base 36,
letters of both cases, base 64) whose alphabet has all its characters. Three tests look at it: chi-squared uniformity over that
alphabet (by the number of equal pairs, its square root being nearly normal), runs of character classes, and serial
correlation of neighbours. What ordinary writing looks like to them is measured on the table itself: all texts are counted
once (how words begin and go on, how long words and numbers are), ordinary tokens are drawn from these counts as words and
numbers one after the other, and give each test its mean and spread by encoding and length. Tokens that random
characters would look like too rarely (``LEAST_CHANCE``) are out; the others get the chance
that ordinary writing looks as random, by all three in one score whose weights allow for how they depend on each other.

Discoveries are controlled over all tokens of the table: a step-up of Benjamini and Hochberg with weights by length, whose
threshold comes from a histogram of weighted chances (a few thousand rows, however large the table). One pass counts the texts, one
scans them; spans and statistics of tokens, which are few, are kept in between.

Cases: a null text is empty and has no spans, its digest is that of the empty string; long texts are read whole, in time
linear in their length; repeated rows are scanned each; chances that tie are found or not together; an empty table gives an
empty result; only doc_id and text are read, so extra columns, whatever their names, don't matter. Places are in code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Fixed values of the contract: base patterns, their least sizes, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

#: A token may follow "=" (KEY=value, ?sig=value); "=" after it is padding, of up to six signs (base 32).
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,6}(?![A-Za-z0-9+/_=-])")
#: Share of false discoveries among the tokens found.
RATE = 0.01
#: A token that random text would look like less often than this in one of the tests isn't random.
LEAST_CHANCE = 1e-4

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class Encoding(NamedTuple):
    """Name, alphabet in order, and the kinds of pieces that ordinary tokens within it are made of."""

    name: str
    alphabet: str
    pieces: str


#: From narrow to wide; kinds of pieces: l words, u words in capitals, c words with a capital, n numbers, s signs.
ENCODINGS = (
    Encoding("decimal", _DIGITS, "n"),
    Encoding("hex", _DIGITS + "abcdef", "ln"),
    Encoding("letters", _LOWER, "l"),
    Encoding("base32", _UPPER + "234567", "un"),
    Encoding("base36", _DIGITS + _LOWER, "ln"),
    Encoding("letters52", _UPPER + _LOWER, "lc"),
    Encoding("base64", _UPPER + _LOWER + _DIGITS + "+/", "lcns"),
)
_ONE_CASE = ("hex", "letters", "base36")
_AS_SIGNS = str.maketrans("-_", "+/")


def body_of(token: str) -> tuple[int, str]:
    """Which encoding a token has, and its characters as these stand in the alphabet."""
    body = token.rstrip("=").translate(_AS_SIGNS)
    for i, enc in enumerate(ENCODINGS):
        now = body.lower() if enc.name in _ONE_CASE and body in (body.lower(), body.upper()) else body
        if set(now) <= set(enc.alphabet):
            return i, now
    raise ValueError(token)


def encoding_of(token: str) -> Encoding:
    return ENCODINGS[body_of(token)[0]]


def _classes(enc: Encoding) -> np.ndarray:
    """Class of each letter of an alphabet: capital, small letter, digit, sign; halves of digits; vowels and consonants."""
    if enc.name == "decimal":
        return np.arange(10) // 5
    if enc.name == "letters":
        return np.array([c in "aeiou" for c in enc.alphabet], int)
    return np.array([0 if c in _LOWER else 1 if c in _UPPER else 2 if c in _DIGITS else 3 for c in enc.alphabet])


_CLASS = [_classes(e) for e in ENCODINGS]
_INDEX = [{c: i for i, c in enumerate(e.alphabet)} for e in ENCODINGS]


def statistics(codes: np.ndarray, enc: int) -> np.ndarray:
    """For rows of equally long tokens (as places in the alphabet): the three statistics, each of a size that doesn't depend on length.

    The root of the number of equal pairs over the length (chi-squared is a growing function of it), the share of neighbours of
    different classes (as the arc sine of its root, whose spread doesn't depend on the mean), and the correlation of neighbours.
    """
    rows, n = codes.shape
    size = len(ENCODINGS[enc].alphabet)
    counts = np.zeros((rows, size))
    np.add.at(counts, (np.repeat(np.arange(rows), n), codes.ravel()), 1)
    pairs = np.sqrt((counts * (counts - 1)).sum(axis=1)) / n
    cls = _CLASS[enc][codes]
    turns = np.arcsin(np.sqrt((cls[:, 1:] != cls[:, :-1]).mean(axis=1)))
    dev = codes - codes.mean(axis=1, keepdims=True)
    var = (dev**2).sum(axis=1)
    serial = np.where(var > 0, (dev[:, 1:] * dev[:, :-1]).sum(axis=1) / np.where(var > 0, var, 1), 1.0)
    return np.stack([pairs, turns, serial], axis=1)


# --- what ordinary writing looks like ----------------------------------------------------------------

MOST_LETTERS, MOST_DIGITS, LEAST_LETTERS = 24, 8, 3
#: Least share of numbers among the pieces of ordinary tokens, where identifiers have more than prose, and share of signs.
NUMBERS, SIGNS = 0.2, 0.1
#: Counts of a text: words by first letter, neighbours in words, words by length, numbers by length, digits.
_PARTS = (26, 676, MOST_LETTERS + 1, MOST_DIGITS + 1, 10)
_KIND = np.full(256, 36, np.uint8)
_KIND[[*range(97, 123)]] = np.arange(26)
_KIND[[*range(65, 91)]] = np.arange(26)
_KIND[[*range(48, 58)]] = np.arange(26, 36)
#: Letters from frequent to rare, for tables that have few words of their own.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def prior_counts() -> np.ndarray:
    """A thousand words or so: letters by rank (1 / (rank + 3)), vowels and consonants in turn twice as often, lengths around five."""
    share = np.zeros(26)
    share[[ord(c) - 97 for c in _FREQUENT]] = 1 / (np.arange(26) + 4.0)
    share /= share.sum()
    vowel = np.array([c in "aeiou" for c in _LOWER])
    pairs = share[:, None] * share[None, :] * np.where(vowel[:, None] != vowel[None, :], 2.0, 1.0)
    length = np.array([0.0, 0, 0, 3, 4, 4, 3, 3, 2, 2, 1, 1, 1] + [0.1] * (MOST_LETTERS - 12))
    digits = np.array([0.0, 4, 3, 2, 3] + [0.2] * (MOST_DIGITS - 4))
    return np.concatenate([1000 * share, 4000 * (pairs / pairs.sum()).ravel(), 1000 * length / length.sum(), 100 * digits / digits.sum(), np.full(10, 20.0)])


def count_text(text: bytes) -> np.ndarray:
    """Counts, in the order of ``_PARTS``, of the runs of ASCII letters and of digits in a text."""
    kind = _KIND[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.int64)
    side = np.where(kind < 26, 0, np.where(kind < 36, 1, 2))
    edge = np.flatnonzero(np.diff(side) != 0) + 1
    begin, end = edge, np.append(edge[1:], kind.size)
    word, number = side[begin] == 0, side[begin] == 1
    size = end - begin
    long = word & (size >= LEAST_LETTERS)
    inside = np.flatnonzero((side[1:] == 0) & (side[:-1] == 0))
    return np.concatenate([
        np.bincount(kind[begin[word]], minlength=26), np.bincount(kind[inside] * 26 + kind[inside + 1], minlength=676),
        np.bincount(np.minimum(size[long], MOST_LETTERS), minlength=MOST_LETTERS + 1), np.bincount(np.minimum(size[number], MOST_DIGITS), minlength=MOST_DIGITS + 1),
        np.bincount(kind[side == 1] - 26, minlength=10),
    ])


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """``count_text`` added up over all texts: a row per place and partition is what leaves the executors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(_PARTS), np.int64)
        for b in batches:
            for t in b.column("text"):
                total += count_text(t.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], ["at", "n"])

    out = np.zeros(sum(_PARTS))
    for r in docs.select(text_of().cast("binary").alias("text")).mapInArrow(of, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out


class Battery:
    """What the tests give for ordinary and for random tokens, by encoding and length.

    The tests are combined into the one score that tells the two apart best while it allows for how the tests depend on each other among
    ordinary tokens: weights are the shift from ordinary to random tokens times the inverse covariance of ordinary ones.
    """

    SIZES = (16, 20, 24, 28, 32, 40, 48, 64, 96, 160)
    DRAWS = 3000

    def __init__(self, counts: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        first, pairs, words, numbers, digits = np.split(counts + prior_counts(), np.cumsum(_PARTS)[:-1])
        shape = (len(ENCODINGS), len(self.SIZES))
        self.random, self.wide, self.side, self.weight = (np.zeros((*shape, 3)) for _ in range(4))
        self.mean, self.spread = np.zeros(shape), np.zeros(shape)
        for e, enc in enumerate(ENCODINGS):
            drawn = self._ordinary(rng, enc, first, pairs.reshape(26, 26), words, numbers, digits)
            random = rng.integers(0, len(enc.alphabet), (self.DRAWS, self.SIZES[-1]))
            for i, n in enumerate(self.SIZES):
                x, y = statistics(drawn[:, :n], e), statistics(random[:, :n], e)
                self.random[e, i], self.wide[e, i] = y.mean(axis=0), np.maximum(y.std(axis=0), 1e-3)
                shift = self.random[e, i] - x.mean(axis=0)
                self.side[e, i] = np.where(shift >= 0, 1, -1)  # where random tokens are, seen from ordinary ones
                cov = np.cov(x.T)
                w = np.linalg.solve(cov + 1e-3 * np.diag(np.diag(cov)) + 1e-9 * np.eye(3), shift)
                self.weight[e, i] = w / np.abs(w).max()
                score = x @ self.weight[e, i]
                self.mean[e, i], self.spread[e, i] = score.mean(), max(score.std(), 1e-6)

    def _ordinary(self, rng, enc: Encoding, first, pairs, words, numbers, digits) -> np.ndarray:
        """Tokens of pieces in any order: numbers as often as in the table, but ``NUMBERS`` at least; letters by the counts, within the alphabet."""
        index = {c: i for i, c in enumerate(enc.alphabet)}
        low = np.array([c in index or c.upper() in index for c in _LOWER])
        share = lambda x: np.cumsum(x / x.sum())
        start, step = share(first * low + 1e-9), np.cumsum((pairs * low + 1e-9) / (pairs * low + 1e-9).sum(axis=1, keepdims=True), axis=1)
        few = np.array([c in index for c in _DIGITS])
        of_digits, of_words, of_numbers = share(digits * few) if few.any() else None, share(words), share(numbers)
        small = np.array([index.get(c, index.get(c.upper(), 0)) for c in _LOWER])
        large = np.array([index.get(c.upper(), index.get(c, 0)) for c in _LOWER])
        cipher = np.array([index.get(c, 0) for c in _DIGITS])
        n, m = self.SIZES[-1], self.DRAWS
        out, kind, left, letter = np.zeros((m, n), np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        names = np.array([ord(c) for c in enc.pieces])
        told = {"n": max(NUMBERS, numbers.sum() / (words.sum() + numbers.sum())), "s": SIGNS}
        rest = [c for c in enc.pieces if c not in told]
        left_over = 1.0 - sum(told[c] for c in enc.pieces if c in told)
        of_kinds = share(np.array([told[c] if c in told else max(left_over, 0.1) / len(rest) for c in enc.pieces]))
        for at in range(n):
            new = left == 0
            k = new.sum()
            kind[new] = names[np.searchsorted(of_kinds, rng.random(k)).clip(0, len(names) - 1)]
            length = np.searchsorted(of_words, rng.random(m))
            length = np.where(kind == ord("n"), np.searchsorted(of_numbers, rng.random(m)), np.where(kind == ord("s"), 1, length))
            left = np.where(new, np.maximum(length, 1), left)
            u = rng.random(m)
            going = (step[letter] < u[:, None]).sum(axis=1).clip(0, 25)
            letter = np.where(new, np.searchsorted(start, u).clip(0, 25), going)
            code = np.where((kind == ord("u")) | ((kind == ord("c")) & new), large[letter], small[letter])
            if of_digits is not None:
                code = np.where(kind == ord("n"), cipher[np.searchsorted(of_digits, u).clip(0, 9)], code)
            out[:, at] = np.where(kind == ord("s"), len(enc.alphabet) - 1 - (u < 0.5), code)
            left -= 1
        return out

    def chances(self, enc: np.ndarray, size: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Per token the combined chance under ordinary writing; 1 where random characters would hardly look like it."""
        out = np.ones(len(size))
        for e in np.unique(enc):
            own = np.flatnonzero(enc == e)
            n, x = size[own], stats[own]
            near = np.abs(np.log(n)[:, None] - np.log(self.SIZES)).argmin(axis=1)  # whose weights are used
            fall = np.sqrt(np.asarray(self.SIZES)[near] / n)  # spreads fall with the root of the length
            far = self.side[e, near] * (self.random[e, near] - x) / (self.wide[e, near] * fall[:, None])
            z = ((x * self.weight[e, near]).sum(axis=1) - self.mean[e, near]) / (self.spread[e, near] * fall)
            out[own] = np.where((_upper(far) < LEAST_CHANCE).any(axis=1), 1.0, np.maximum(_upper(z), 1e-15))
        return out


def _upper(z: np.ndarray) -> np.ndarray:
    """Chance that a standard normal value is above z."""
    from math import erfc

    return 0.5 * np.vectorize(erfc, otypes=[float])(np.asarray(z) / np.sqrt(2.0))


# --- scanning ----------------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans of the fixed patterns, sorted; kinds as places in ``KINDS``."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float, float, float]]:
    """(start, end, encoding, characters without padding, the three statistics) of the tokens clear of base spans."""
    starts, ends = [s for s, _, _ in base], list(accumulate((e for *_, e in base), max))
    out = []
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before the token's end
        if before and ends[before - 1] > m.start():
            continue
        enc, body = body_of(m.group())
        got = statistics(np.array([[_INDEX[enc][c] for c in body]]), enc)[0]
        out.append((m.start(), m.end(), enc, len(body), *got.tolist()))
    return out


_TOKENS = "array<struct<start: long, end: long, enc: int, n: int, pairs: double, turns: double, serial: double>>"
_SPANS = "array<struct<start: long, kind: int, end: long>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and tokens (with their statistics) of every document."""
    rows = docs.select("doc_id", text_of().alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    toks = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("enc", pa.int32()), ("n", pa.int32()), ("pairs", pa.float64()), ("turns", pa.float64()), ("serial", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = [], []
            for t in b.column("text"):
                text = t.as_py()
                own = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in own])
                more.append([dict(zip(("start", "end", "enc", "n", "pairs", "turns", "serial"), x, strict=True)) for x in tokens(text, own)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, spans), pa.array(more, toks)], ["doc_id", "base", "tokens"])

    return rows.mapInArrow(of, f"doc_id {dict(rows.dtypes)['doc_id']}, base {_SPANS}, tokens {_TOKENS}")


def rated(rows: DataFrame, battery: Battery) -> DataFrame:
    """``rows`` of ``scanned`` with u, per token its chance under ordinary writing over its length (the weight)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            flat = lists.flatten()
            col = lambda c: flat.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            u = battery.chances(col("enc"), col("n").astype(float), np.stack([col(c) for c in ("pairs", "turns", "serial")], axis=1)) / col("n") if len(flat) else np.zeros(0)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(u))], [*b.schema.names, "u"])

    return rows.mapInArrow(of, f"doc_id {dict(rows.dtypes)['doc_id']}, base {_SPANS}, tokens {_TOKENS}, u array<double>")


#: Bins of the histogram of chances to a power of ten, and the power that it begins at.
BINS, LOWEST = 100, -20


def step_up(bins: list[tuple[int, int, int]], rate: float = RATE) -> float:
    """The largest weighted chance that counts as a discovery, from (bin, tokens, characters); below 0 if there is none.

    With weights in proportion to length, a threshold u holds if u times all characters is at most ``rate`` times the tokens up to
    u. A bin is taken as a whole at its upper edge, which errs on the safe side.
    """
    characters, found, best = sum(c for *_, c in bins), 0, -1.0
    for b, n, _ in sorted(bins):
        found += n
        edge = 10.0 ** (LOWEST + (b + 1) / BINS)
        if edge * characters <= rate * found:
            best = edge
    return best


def _bin(u: Column) -> Column:
    return F.greatest(F.floor((F.log10(u) - LOWEST) * BINS), F.lit(0)).cast("int")


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and random: the spans (start, kind, end) of the fixed patterns and of the battery, in order."""
    battery = Battery(corpus_counts(docs))
    rows = cut(scanned(docs))
    level = rated(rows, battery)
    each = level.select(F.explode(F.arrays_zip("tokens", "u")).alias("x")).select(_bin(F.col("x.u")).alias("bin"), F.col("x.tokens.n").cast("long").alias("n"))
    bins = each.groupBy("bin").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("characters")).collect()  # a row per bin
    edge = step_up([(r.bin, r.tokens, r.characters) for r in bins], rate)
    least = F.lit(LOWEST + 0.0)
    found = F.filter(F.arrays_zip("tokens", "u"), lambda x: (F.greatest(F.log10(x["u"]), least) < F.log10(F.lit(edge))) if edge > 0 else F.lit(False))
    spans = F.transform(found, lambda x: F.struct(x["tokens"]["start"].alias("start"), F.lit(3).alias("kind"), x["tokens"]["end"].alias("end")))
    return level.select("doc_id", "base", F.array_sort(spans).alias("random"))


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """Per document n_assign, n_access, n_hex, base_sha256 and all spans."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    digest = F.sha2(_line(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return secret_spans(docs).select("doc_id", n(0), n(1), n(2), digest, _line(F.array_sort(F.concat("base", "random"))).alias("spans"))
