"""SimHash near-dedup at a similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The trie join of ``simhash`` with fingerprints wide enough for that similarity. 64 bits aren't: at 0.8 two sets differ in about a
seventh of their bits, and no budget that finds those prunes a trie. So a set gets several words of SimHash bits. Two sets at
0.8 differ in each bit with the chance ``FLIP``, and so are within ``BUDGET`` bits in one word in a few; there are as many words as it
takes that they miss each other in all of them with a chance of at most ``MISS``. Words are as long as the table is
large (``plan``), so that sets that aren't similar meet a few times each, however many there are.

* The tries of the first words are walked with the budget, and each subtree gives a forest of its pairs: a group of near copies costs
  its members and not its pairs, and hardly any group stays in pieces. These pairs are held against all bits, then
  verified on the whole sets.
* The tries of all words are walked, each set with the component that it has by then: node pairs within one component are
  dropped, and all pairs that are left, between components, are verified likewise.

Verification is exact, so what is linked is similar; ``MISS`` is all that is left to chance.

Cases: as in ``simhash``: a null text counts as empty, texts without words are one component, a text of fewer than
five words is one shingle; repeated rows are one, of ties the smallest id, then text hash, stays; very long texts
are read whole; an empty table gives an empty result; extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, rows_at_once, small_side, text_of
from .simhash import _WORDS, SUBTREE, connected, standing, subtrees, trie_pairs, whole_subtrees

SHINGLE = 5
#: Least similarity, as a fraction, so that it is compared in whole numbers.
FLOOR = (4, 5)
#: Bits of a word that two sets may differ in, and the chance of a pair at the floor to be missed.
BUDGET, MISS = 3, 1e-3
#: Two sets of one size with Jaccard similarity j have the cosine 2j / (1 + j), and differ in a bit with the angle's share of a half turn.
FLIP = acos(2 * FLOOR[0] / (FLOOR[0] + FLOOR[1])) / pi
LEAST_BITS, MOST_BITS, SPARE_BITS = 32, 52, 14
#: Texts, or pairs of whole sets, that are passed to Python at once.
SETS_AT_ONCE = 256
_RNG = np.random.default_rng(42)
_MASK, _ODD = _RNG.integers(0, 2**64, 256, dtype=np.uint64), _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plan(rows: int) -> tuple[int, int]:
    """(bits of a word, words) for a table of so many rows."""
    bits = min(MOST_BITS, max(LEAST_BITS, SPARE_BITS + ceil(log2(max(2, rows)))))
    meet = sum(comb(bits, i) * FLIP**i * (1 - FLIP) ** (bits - i) for i in range(BUDGET + 1))
    return bits, ceil(log(MISS) / log(1 - meet))


def most_apart(bits: int, spreads: float = 6.0) -> int:
    """So many standard deviations beyond the bits that two sets at the floor differ in, of ``bits``."""
    return ceil(bits * FLIP + spreads * sqrt(bits * FLIP * (1 - FLIP)))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted XXH64 values of the distinct shingles of a UTF-8 text; empty if it has no words."""
    words = _WORDS.findall(text.lower())  # bytes.lower() changes A-Z only
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), 42) for i in range(n)), np.uint64, n))


def _sum_bits(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit set. Full adders bring 15 rows down to four of weights 1, 2, 4 and 8 before bits are spread out."""
    rows = np.concatenate([rows, np.zeros((-len(rows) % 15, rows.shape[1]), np.uint64)]).reshape(15, -1, rows.shape[1])

    def add(a, b, c):
        x = a ^ b
        return x ^ c, (a & b) | (x & c)

    ones, twos = [], []
    for i in range(0, 15, 3):
        one, two = add(*rows[i : i + 3])
        ones.append(one)
        twos.append(two)
    for _ in range(2):
        one, two = add(ones.pop(), ones.pop(), ones.pop())
        ones.append(one)
        twos.append(two)
    fours = []
    for _ in range(3):
        two, four = add(twos.pop(), twos.pop(), twos.pop())
        twos.append(two)
        fours.append(four)
    four, eight = add(*fours)
    spread = lambda x: np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(x), -1), axis=1).sum(axis=0, dtype=np.int64)
    return spread(ones[0]) + 2 * spread(twos[0]) + 4 * spread(four) + 8 * spread(eight)


def words_of_bits(values: np.ndarray, bits: int, words: int) -> np.ndarray:
    """The words of a set's SimHash, right-aligned: a bit is 1 if over half of the shingles' mixed values have it."""
    per = 64 // bits
    lanes = -(-words // per)
    total = np.zeros(64 * lanes, np.int64)
    for k in range(0, values.size, 1 << 14):
        x = (values[k : k + (1 << 14), None] ^ _MASK[:lanes]) * _ODD[:lanes]
        total += _sum_bits(x ^ (x >> np.uint64(32)))
    packed = np.packbits(total * 2 > values.size).view(">u8").astype(np.uint64)
    k = np.arange(words)
    return (packed[k // per] >> (np.uint64(bits) * (k % per).astype(np.uint64))) & np.uint64((1 << bits) - 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of ``FLOOR`` or more."""
    top, low = FLOOR
    both = np.intersect1d(a, b, assume_unique=True).size
    return both * low >= top * (a.size + b.size - both)


def signatures(docs: DataFrame, bits: int, words: int) -> DataFrame:
    """doc_id, text_hash, sig (one value per set of shingles), n (its size) and words of every document."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, size, each = [], [], []
            for t in b.column("text"):
                values = shingle_set(t.as_py())
                sig.append(xxhash.xxh64_intdigest(values.tobytes(), 42))
                size.append(values.size)
                each.append(words_of_bits(values, bits, words).view(np.int64))
            cols = [b.column("doc_id"), b.column("text_hash"), pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(each, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "sig", "n", "words"])

    return rows.mapInArrow(of, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, sig long, n long, words array<long>")


def _sets(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """sig and its whole set (as bytes) for the rows of ``texts`` (sig, text_hash; cut)."""
    rows = docs.select(F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("text"))
    rows = rows.join(small_side(texts), "text_hash").groupBy("sig").agg(F.first("text").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [shingle_set(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("sig"), pa.array(values, pa.binary())], ["sig", "values"])

    return rows.mapInArrow(of, "sig long, values binary")


def _verified(docs: DataFrame, pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (a, b; cut) that are similar."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    texts = cut(ends.join(distinct.select("sig", "text_hash"), "sig"))
    with rows_at_once(docs.sparkSession, SETS_AT_ONCE):
        sets = cut(_sets(docs, texts))
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("values").alias(f"set_{c}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            both = zip(x.column("set_a"), x.column("set_b"), strict=True)
            ok = pa.array([similar(*(np.frombuffer(v.as_py(), np.uint64) for v in p)) for p in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(ok), x.column("b").filter(ok)], ["a", "b"])

    with rows_at_once(docs.sparkSession, SETS_AT_ONCE):
        return cut(rows.mapInArrow(of, "a long, b long"))


def near_sizes(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(a, b) * FLOOR[1] >= F.greatest(a, b) * FLOOR[0]


#: Sizes of sets are carried as powers of this, above a word's bits; those of similar sets differ by so many powers at most.
SIZE_STEP, SIZE_AT = 1.05, 52
SIZES_APART = ceil(log(FLOOR[1] / FLOOR[0]) / log(SIZE_STEP))


#: Words whose tries are walked for a forest before all are walked for pairs.
FIRST_WORDS = 3


def trie_candidates(members: DataFrame, bits: int, subtree: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of ``members`` (sig, n, words, root) of different roots and near sizes with a word within the budget.

    ``forest``: by the first words alone, and of the pairs in a subtree only as many as join the classes that all of them would.
    A member of a word's trie carries its set's size and the low halves of the next two words: pairs that met by chance go where they
    are found, and few ever leave the walk.
    """
    size = F.floor(F.log("n") / log(SIZE_STEP)).cast("long")
    asked = F.slice("words", 1, FIRST_WORDS) if forest else F.col("words")
    rows = members.select(F.posexplode(asked).alias("word", "value"), "words", "sig", "n", "root")
    other = lambda k: F.element_at("words", (F.col("word") + k) % F.size("words") + 1).bitwiseAND(F.lit((1 << 32) - 1))
    check = F.shiftleft(other(1), 32).bitwiseOR(other(2))
    packed = F.shiftleft(size, SIZE_AT).bitwiseOR(F.col("value"))
    rows = rows.select(F.xxhash64("word").alias("path"), F.col("value").alias("rest"), F.lit(bits).alias("left"), packed.alias("fp"), check.alias("check"), "sig", "root")
    most = most_apart(64, 5.0)
    low = (1 << SIZE_AT) - 1
    ready, hot = subtrees(rows, BUDGET, subtree, "root")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, fp, check, sig, root in whole_subtrees(batches):
            value, size = fp & low, fp >> SIZE_AT
            order = np.lexsort((root, value, tree))
            tree, value, size, check, sig, root = (x[order] for x in (tree, value, size, check, sig, root))
            _, number = np.unique(root, return_inverse=True)
            joined: dict[int, dict[int, int]] = {}  # per subtree, what the classes have been joined to
            for a, b in trie_pairs(tree, value.view(np.uint64), BUDGET, number, bits):
                near = (np.abs(size[a] - size[b]) <= SIZES_APART) & (np.bitwise_count((check[a] ^ check[b]).view(np.uint64)) <= most)
                a, b = a[near], b[near]
                if forest and a.size:
                    new = [_join(joined.setdefault(t, {}), x, y) for t, x, y in zip(tree[a].tolist(), number[a].tolist(), number[b].tolist(), strict=True)]
                    a, b = a[new], b[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(sig[a], sig[b])), pa.array(np.minimum(sig[a], sig[b]))], ["a", "b"])

    found = ready.select("path", "fp", "check", "sig", "root").mapInArrow(walk, "a long, b long")
    if hot is not None and forest:  # each against the least of its path
        lead = hot.groupBy("path").agg(F.min(F.struct("sig", "root")).alias("lead"))
        found = found.unionByName(hot.join(lead, "path").where("root <> lead.root").select(F.greatest("sig", "lead.sig").alias("a"), F.least("sig", "lead.sig").alias("b")))
    elif hot is not None:  # all but a few bits are shared there; the join splits what is too large for a task
        left, right = (hot.select("path", F.col("fp").alias(f"fp_{c}"), F.col("check").alias(f"check_{c}"), F.col("sig").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")).bitwiseAND(F.lit(low))) <= BUDGET
        near = near & (F.bit_count(F.col("check_a").bitwiseXOR(F.col("check_b"))) <= most)
        found = found.unionByName(left.join(right, "path").where("a > b and root_a <> root_b").where(near).select("a", "b"))
    return found.distinct()


def _join(joined: dict[int, int], a: int, b: int) -> bool:
    """Join two classes; whether they were apart."""

    def find(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            joined[x] = x = joined.get(up, up)
        return x

    a, b = find(a), find(b)
    joined[max(a, b)] = min(a, b)
    return a != b


def links(docs: DataFrame, distinct: DataFrame, bits: int, words: int, subtree: int = SUBTREE) -> DataFrame:
    """(node, root) of the sets in ``distinct`` (sig, n, words, text_hash; cut) that are similar to another one."""
    near = distinct.where("n > 0")
    side = lambda c: distinct.select(F.col("sig").alias(c), F.col("words").alias(f"words_{c}"), F.col("n").alias(f"n_{c}"))
    apart = F.aggregate(F.zip_with("words_a", "words_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    found = None
    for forest in (True, False):
        if found is None:
            members = near.withColumn("root", F.col("sig"))
        else:
            roots = cut(connected(found))
            members = cut(near.join(roots, near["sig"] == roots["node"], "left").withColumn("root", F.coalesce("root", "sig")).select("sig", "n", "words", "root"))
        pairs = cut(trie_candidates(members, bits, subtree, forest))
        release(docs.sparkSession)
        pairs = pairs.join(side("b"), "b").join(side("a"), "a").where(near_sizes(F.col("n_a"), F.col("n_b")) & (apart <= most_apart(bits * words)))
        ok = _verified(docs, cut(pairs.select("a", "b")), distinct)
        release(docs.sparkSession)
        found = ok if found is None else found.unionByName(ok)
    return connected(found)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id, then text hash, stays."""
    bits, words = plan(docs.count())
    narrow = cut(signatures(docs, bits, words))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    distinct = cut(narrow.groupBy("sig").agg(least.alias("first"), F.first("n").alias("n"), F.first("words").alias("words")))
    distinct = distinct.select("sig", "n", "words", F.col("first.text_hash").alias("text_hash"), "first")
    roots = cut(links(docs, distinct, bits, words))
    tagged = distinct.join(roots, distinct["sig"] == roots["node"], "left").select(F.coalesce("root", "sig").alias("root"), "first")
    kept = tagged.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_text"))
    return standing(docs, narrow, cut(kept))
