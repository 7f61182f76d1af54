"""Hierarchical packing of documents into windows of several lengths.

A document is tokenised and closed by an end id. Every window of the longest tier that it fills is a sequence of its
own; what remains is routed to the shortest tier that holds it. Tiers are packed from the longest down: the longest piece
left opens a window of its tier, the gap takes the longest pieces from the shorter tiers that fit, and once none fits the
next longer piece is cut so that the window is exactly full. Windows are powers of two, so full ones need no padding; of the
last pieces of a bucket powers of two are made. Sequences are dealt to step groups, the longest first, each
to the group with the fewest tokens, so that groups have nearly the same number of tokens and the same mix of tiers.

Packing is done bucket by bucket, ``BUCKET_TOKENS`` at a time as the documents of a partition come, in the task that
has tokenised them: nothing is shuffled, memory is a bucket and a document, and a lost task is done again alike, since order
and partition decide. Ids are in the result, as little-endian unsigned 32-bit numbers, and ``sequences`` joins them.

Words are split at blanks and line ends and looked up before the tokenizer is asked: white space is dropped by it, and no rule
of it goes across. What a worker has read it keeps, up to ``KEPT_WORDS`` words. Strings of special tokens in a text are ordinary text.

Cases: a null text is the empty one, which has the end id alone; repeated rows are documents of their own; a null
doc_id stays null; texts of any length are whole; an empty table gives an empty result; only doc_id and text are read, so extra
columns, whatever their names, don't matter. ``sequence_id`` and ``step`` are unique over the table, not gapless.
"""

from __future__ import annotations

import heapq
import string
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Lengths of windows, powers of two, the longest last.
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that are packed together, and tokens of a step group.
BUCKET_TOKENS, STEP_TOKENS = 1 << 21, 1 << 18
#: Words whose ids a worker keeps, the longest of them, and characters that are read at a time.
KEPT_WORDS, KEPT_LENGTH, READ_CHARS = 1_000_000, 48, 1 << 18
#: The first character beyond Latin letters that no normaliser changes but for their case.
NOT_LATIN = "\u0180"
#: How the tokenizer names ids that end a piece.
PIECE_END = "</w>"
#: Signs that end words: neither letters nor numbers, so that the tokenizer takes them as a piece of their own.
SIGNS = string.punctuation

Piece = tuple[int, int, int]  # document, start, length


def core_of(word: str) -> tuple[str, str]:
    """A word as its core and the signs behind it, which the tokenizer reads apart; a core of Latin letters in small ones, as the tokenizer reads it."""
    core = word.rstrip(SIGNS)
    if not core or not core[-1].isalnum():
        core = word
    return core.lower() if core.isascii() or core.isalpha() and max(core) < NOT_LATIN else core, word[len(core) :]


class Reader:
    """Ids of texts; words, and cores of words, that were seen before aren't tokenised again.

    Cores of Latin letters alone, small ones, are one piece that the tokenizer's normaliser and splitter leave as it is: they go to its merges without these.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for name, i in names.items() if name.endswith(PIECE_END)]] = True
        self.cores: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def _learn(self, words: set[str]) -> None:
        pairs = [core_of(w) for w in words]
        if len(self.words) + len(words) > KEPT_WORDS:
            self.cores, self.words = {}, {"": b""}
        new = {part for pair in pairs for part in pair}.difference(self.cores)
        plain = [c for c in new if c.isalpha() and c.islower() and max(c) < NOT_LATIN]
        if plain:  # all in one text; each of them ends with the one id that ends a piece
            ids = np.array(self.merges.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            data, edges = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            self.cores.update(zip(plain, [data[lo:hi] for lo, hi in pairwise(edges)], strict=True))
        others = list(new.difference(plain))
        self.cores.update(zip(others, [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)], strict=True))
        cores = self.cores
        self.words.update(zip(words, [cores[core] + cores[signs] for core, signs in pairs], strict=True))

    def _parts(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.words.get
        found = [list(map(known, words)) for words in split]
        missing = [[i for i, ids in enumerate(own) if ids is None] for own in found]
        new = {words[i] for words, places in zip(split, missing, strict=True) for i in places}
        if new:
            self._learn(new)
            for words, own, places in zip(split, found, missing, strict=True):
                for i in places:
                    own[i] = self.words[words[i]]
            for w in new:
                if len(w) > KEPT_LENGTH:
                    for part in {w, *core_of(w)}:
                        self.words.pop(part, None)
                        self.cores.pop(part, None)
        return [b"".join(own) for own in found]

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Four bytes for each id of each whole text. Short texts are read together, long ones in parts that end at blanks."""
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars > READ_CHARS:
                yield from self._parts(some[:-1])
                yield b"".join(x for part in self._pieces_of(some[-1]) for x in self._parts([part]))
                some, chars = [], 0
        yield from self._parts(some)

    @staticmethod
    def _pieces_of(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + READ_CHARS)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end


@cache
def reader(path: str) -> Reader:
    """The reader of a worker, which its tasks share: what one has read the next one knows."""
    return Reader(path)


def windows(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces that hold documents of these sizes; each fills a power of two exactly."""
    longest = tiers[-1]
    done: list[list[Piece]] = []
    pool: list[list[Piece]] = [[] for _ in range(longest + 1)]
    open_sizes = 0  # bit s is set if the pool has a piece of s tokens

    def put(piece: Piece) -> None:
        nonlocal open_sizes
        pool[piece[2]].append(piece)
        open_sizes |= 1 << piece[2]

    def take(size: int) -> Piece:
        nonlocal open_sizes
        piece = pool[size].pop()
        if not pool[size]:
            open_sizes ^= 1 << size
        return piece

    for doc, size in enumerate(sizes):
        whole = size - size % longest
        done.extend([(doc, at, longest)] for at in range(0, whole, longest))
        if size > whole:
            put((doc, whole, size - whole))
    while open_sizes:
        first = take(open_sizes.bit_length() - 1)
        window, gap = [first], next(t for t in tiers if t >= first[2]) - first[2]
        while gap and open_sizes:
            if fits := open_sizes & ((2 << gap) - 1):
                window.append(take(fits.bit_length() - 1))
                gap -= window[-1][2]
            else:
                larger = open_sizes >> (gap + 1)
                doc, start, size = take(gap + 1 + (larger & -larger).bit_length() - 1)
                window.append((doc, start, gap))
                put((doc, start + gap, size - gap))
                gap = 0
        done.extend(_powers(window) if gap else [window])
    return done


def _powers(window: list[Piece]) -> Iterator[list[Piece]]:
    """A window that nothing is left to fill, as windows of the powers of two that add up to it."""
    left, rest = sum(n for *_, n in window), list(reversed(window))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, start, n = rest.pop()
            out.append((doc, start, min(n, room)))
            if n > room:
                rest.append((doc, start + room, n - room))
            room -= out[-1][2]
        yield out


def step_groups(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each sequence: the longest go first, each to the group that has the fewest tokens."""
    groups = max(1, round(sum(lengths) / step_tokens))
    load = [(0, g) for g in range(groups)]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, g = heapq.heappop(load)
        out[i] = g
        heapq.heappush(load, (tokens + lengths[i], g))
    return out


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("step", pa.int64())])


def _pieces(docs: list[tuple[int | None, bytes]], tiers: tuple[int, ...], first_sequence: int, first_step: int) -> tuple[pa.RecordBatch, int, int]:
    """The pieces of one bucket, and how many sequences and step groups it has."""
    found = windows([len(ids) // 4 for _, ids in docs], tiers)
    lengths = [sum(n for *_, n in w) for w in found]
    steps = step_groups(lengths)
    rows = []
    for k, (window, total, step) in enumerate(zip(found, lengths, steps, strict=True)):
        offset = 0
        tier = next(t for t in tiers if t >= total)
        for doc, start, n in window:
            doc_id, ids = docs[doc]
            rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, first_sequence + k, offset, tier, first_step + step))
            offset += n
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES), len(found), max(steps) + 1


def packer(path: str, tiers: tuple[int, ...], bucket_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task: batches of (doc_id, text) to batches of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, end = reader(path), array("I", [END_ID]).tobytes()
        task = TaskContext.get()
        sequence = step = (task.partitionId() if task else 0) << 33
        docs: list[tuple[int | None, bytes]] = []
        held = 0
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), read.ids(x.as_py() for x in b.column("text")), strict=True):
                docs.append((doc_id, ids + end))
                held += len(docs[-1][1]) // 4
                if held >= bucket_tokens:
                    out, n, groups = _pieces(docs, tiers, sequence, step)
                    yield out
                    sequence, step, docs, held = sequence + n, step + groups, [], 0
        if docs:
            yield _pieces(docs, tiers, sequence, step)[0]

    return run


def packed(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step: every piece of every document.

    ``path``: a tokenizer's file, at the same place on every executor. ``tiers``: lengths of windows, ascending powers of two.
    """
    if not tiers or any(t & (t - 1) or t < 1 for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    kinds = {"binary": "binary", "int64": "long"}
    return rows.mapInArrow(packer(path, tiers, bucket_tokens), ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in PIECES))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, tier, step, length, ids: whole sequences, at most the longest tier's tokens each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.first("tier").alias("tier"), F.first("step").alias("step"), F.sum("length").alias("length"), parts.alias("parts"))
    return rows.withColumn("ids", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).drop("parts")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")
