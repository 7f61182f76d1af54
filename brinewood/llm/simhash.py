"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked where few bits differ.

The join is a self-join of a binary trie: node pairs are walked down together, the bits in which they
differ add up, and a pair is dropped as soon as it is over the budget; members are compared at leaves only. The trie is cut into
subtrees that tasks can own: of ``budget + 1`` blocks of bits, two fingerprints within the budget
share at least one whole, so each fingerprint goes, once per block, to the subtree below that
block's value. Subtrees with too many members are cut again by blocks of the bits that are left.
Equal fingerprints are one member, and a subtree gives back a forest (at most one link per member),
so that groups of copies cost their members and never their pairs.

Components are found by star contraction over tables in the cluster; neither links nor labels ever
come to the driver.

Cases: a null text counts as empty; texts without words have fingerprint zero and link like any
other; repeated rows are rows of their own in the same component; ``component_id`` is the smallest
id of the component, null ids aside (null if it has no other); very long texts are read whole, in pieces of bounded size;
an empty table gives an empty result; only doc_id and text are read, and what filters rows keeps extra columns whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side, text_of, without

BITS = 64
#: Members that a subtree may have before it is cut again.
SUBTREE = 20_000
#: Node pairs that are walked at a time.
FRONTIER = 1 << 16
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_BIT = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: bit i is 1 if it is set in over half of its shingles' XXH64 values."""
    words = _WORDS.findall(text.lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    view, digest, counts = line, xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 15):
        h = np.array([digest(view[a:b], seed) for a, b in zip(begins[k : k + (1 << 15)], ends[k : k + (1 << 15)], strict=True)], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(_BIT[counts * 2 > n].sum())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every document."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(of, f"doc_id {id_type}, text_hash long, fp long")


# --- the trie join -----------------------------------------------------------------------------------


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n members joined by links a-b, the smallest member of each one's component."""
    root = np.arange(n)
    while a.size:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


class Trie:
    """Binary tries of sorted fingerprints, one per subtree, without nodes of one child; all of them in arrays.

    Leaves come first, one per distinct fingerprint, then a node for each place at which two neighbouring leaves part. ``depth`` is the number of
    bits that all below a node share, ``key`` a fingerprint below it, ``one`` the class of all members below it (-1 if they are of several).
    """

    def __init__(self, tree: np.ndarray, fp: np.ndarray, same: np.ndarray | None, bits: int):
        first = np.concatenate(([True], (tree[1:] != tree[:-1]) | (fp[1:] != fp[:-1])))
        self.begin = np.flatnonzero(first)
        self.end = np.append(self.begin[1:], len(fp))
        key, tree = fp[self.begin], tree[self.begin]
        n = len(key)
        part = np.full(n, -1)  # at which bit a leaf and the next one part; -1 between trees
        if n > 1:
            differ, width = key[1:] ^ key[:-1], np.zeros(n - 1, np.int64)
            for step in (32, 16, 8, 4, 2, 1):  # how many bits the difference has
                over = (differ >> width.astype(np.uint64)) >> np.uint64(step) != 0
                width += step * over
            part[:-1] = np.where(tree[1:] == tree[:-1], bits - 1 - width, -1)
        size = 2 * n
        self.bits, self.leaves = bits, n
        self.depth, self.key = np.concatenate((np.full(n, bits), part)), np.concatenate((key, key))
        self.left, self.right, self.one = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1)
        if same is not None:
            alike = np.minimum.reduceat(same, self.begin) == np.maximum.reduceat(same, self.begin)
            self.one[:n] = np.where(alike, same[self.begin], -1)
        top, start, stop = np.arange(n), np.arange(n), np.arange(n)  # of the block that begins, or ends, at a leaf
        for d in range(bits - 1, -1, -1):  # blocks grow together from the deepest partings up
            i = np.flatnonzero(part == d)
            if not i.size:
                continue
            s, e = start[i], stop[i + 1]
            self.left[n + i], self.right[n + i] = top[s], top[i + 1]
            self.one[n + i] = np.where(self.one[top[s]] == self.one[top[i + 1]], self.one[top[s]], -1)
            top[s], stop[s], start[e] = n + i, e, s
        self.roots = top[np.flatnonzero(np.concatenate(([True], part[:-1] == -1)))]


def trie_pairs(tree: np.ndarray, fp: np.ndarray, budget: int, same: np.ndarray | None = None, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of the same subtree whose fingerprints differ in at most ``budget`` of their ``bits`` low bits (there are no others).

    ``tree`` has each member's subtree, ``fp`` its fingerprint; both sorted by (tree, fp). Two nodes go down together, the one that parts
    first by its children; the bits in which they differ as far as both are one add up, and a pair over the budget is dropped
    with all that is below it. Members are compared at leaves only. With ``same`` (a class per member, not negative)
    pairs within a class are of no interest, and two nodes of one class are dropped as well.

    ``WALKED`` counts node pairs that were expanded, dropped by the budget, dropped by class, and that were leaves.
    """
    if not len(fp):
        return
    trie = Trie(tree, fp, same, bits)
    stack = [(trie.roots, trie.roots)]
    while stack:
        a, b = stack.pop()
        if a.size > FRONTIER:
            half = a.size // 2
            stack += [(a[half:], b[half:]), (a[:half], b[:half])]
            continue
        shared = np.minimum(trie.depth[a], trie.depth[b])
        differ = trie.key[a] ^ trie.key[b]
        fine = np.bitwise_count(np.where(shared > 0, differ >> (bits - np.maximum(shared, 1)).astype(np.uint64), 0)) <= budget
        WALKED["over_budget"] += int(a.size - fine.sum())
        if same is not None:
            one = fine & (trie.one[a] >= 0) & (trie.one[a] == trie.one[b])
            WALKED["one_class"] += int(one.sum())
            fine &= ~one
        a, b, shared = a[fine], b[fine], shared[fine]
        leaf = shared == bits
        if leaf.any():
            x, y = a[leaf], b[leaf]
            WALKED["leaves"] += int((x != y).sum())
            yield from _members(trie, x, y, same)
            a, b = a[~leaf], b[~leaf]
        if not a.size:
            continue
        WALKED["expanded"] += a.size
        twin, first = a == b, trie.depth[a] <= trie.depth[b]
        t, x, y = a[twin], ~twin & first, ~twin & ~first
        la, ra, lb, rb = trie.left[a[x]], trie.right[a[x]], trie.left[b[y]], trie.right[b[y]]
        lt, rt = trie.left[t], trie.right[t]
        stack.append((np.concatenate((lt, rt, lt, la, ra, a[y], a[y])), np.concatenate((lt, rt, rt, b[x], b[x], lb, rb))))


def _members(trie: Trie, x: np.ndarray, y: np.ndarray, same: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Member pairs of pairs of leaves: of a leaf with itself each once, those of one class never."""
    single = (trie.end[x] - trie.begin[x] == 1) & (trie.end[y] - trie.begin[y] == 1)
    a, b = trie.begin[x[single & (x != y)]], trie.begin[y[single & (x != y)]]
    if a.size:
        yield a, b
    for u, v in zip(x[~single].tolist(), y[~single].tolist(), strict=True):
        for a in range(trie.begin[u], trie.end[u]):  # equal fingerprints of several members
            b = np.arange(a + 1 if u == v else trie.begin[v], trie.end[v])
            if same is not None:
                b = b[same[b] != same[a]]
            if b.size:
                yield np.full(b.size, a), b


#: What the walks of this process did.
WALKED = {"expanded": 0, "over_budget": 0, "one_class": 0, "leaves": 0}


def trie_links(tree: np.ndarray, fp: np.ndarray, budget: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of ``trie_pairs``: at most one link per member."""
    root = np.arange(len(fp))
    for a, b in trie_pairs(tree, fp, budget, bits=bits):
        root = _joined(root, a, b)
    child = np.flatnonzero(root != np.arange(len(fp)))
    return child, root[child]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    touched, back = np.unique(np.concatenate((root[a], root[b])), return_inverse=True)
    new = _roots(len(touched), back[: a.size], back[a.size :])
    to = np.arange(root.size)
    to[touched] = touched[new]
    return to[root]


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of nearly equal blocks."""
    edge = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False) if b > a]


def _cut_subtrees(members: DataFrame, budget: int) -> DataFrame:
    """Members (path, rest, left, fp, ...) copied once per block of the bits that are left, path extended by the block's value.

    ``rest`` holds the ``left`` bits not yet fixed by the path, right-aligned.
    """
    out = None
    for left in sorted({r.left for r in members.select("left").distinct().collect()}):  # one value per round of cutting
        rows = members.where(F.col("left") == left)
        choices = []
        for off, width in _blocks(left, budget + 1):
            low = left - off - width  # bits below the block
            value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << width) - 1))
            above = F.shiftrightunsigned("rest", low + width) if off else F.lit(0).cast("long")
            if low:
                below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
                rest = F.shiftleft(above, low).bitwiseOR(below)
            else:
                rest = above
            choices.append(F.struct(F.xxhash64("path", F.lit(off), value).alias("path"), rest.alias("rest"), F.lit(left - width).alias("left")))
        own = [c for c in rows.columns if c not in ("path", "rest", "left")]
        cutting = rows.select(F.explode(F.array(*choices)).alias("x"), *own).select("x.path", *own, "x.rest", "x.left")
        out = cutting if out is None else out.unionByName(cutting)
    return out if out is not None else members.limit(0)


def subtrees(members: DataFrame, budget: int, subtree: int = SUBTREE, root: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The other columns of ``members`` (path, rest, left, fp, ...) with path: those of subtrees that a task can own, and those of hot ones.

    Every two members of a path within ``budget`` bits meet in a subtree. Those with more than ``subtree`` members are cut again by
    the bits that are left, as long as there are more of these than blocks. What then is too large holds many members of few
    fingerprints (where these aren't distinct): the hot ones, None if there are none. Large subtrees of one class (column
    ``root``) are left out. Paths are hashed; were two to collide, one subtree would hold both, which the
    walk, comparing all bits, still gets right.
    """
    subtree = max(subtree, 1 << (budget + 1))  # what no cutting of distinct fingerprints can split further
    members, done, hot = _cut_subtrees(members, budget), [], []
    one = (F.min(root) == F.max(root)) if root else F.lit(False)
    while True:
        heavy = cut(members.groupBy("path").agg(F.count(F.lit(1)).alias("n"), one.alias("one"), F.max("left").alias("most")).where(F.col("n") > subtree))
        n = heavy.count()
        if not n:
            done.append(members)
            break
        done.append(members.join(small_side(heavy.select("path"), n), "path", "left_anti"))
        more = heavy.where(~F.col("one"))
        hot.append(members.join(small_side(more.where(F.col("most") <= budget + 1).select("path"), n), "path", "left_semi"))
        members = _cut_subtrees(cut(members.join(small_side(more.where(F.col("most") > budget + 1).select("path"), n), "path", "left_semi")), budget)
    every = lambda parts: reduce(DataFrame.unionByName, parts).drop("rest", "left") if parts else None
    return every(done).repartition("path").sortWithinPartitions("path"), every(hot)


def whole_subtrees(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """Columns of members, of whole subtrees at a time, each sorted by (path, fp). path and fp are the first two."""
    held: list[list[np.ndarray]] = []

    def sorted_(cols: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort((cols[1].view(np.uint64), cols[0]))
        return [c[order] for c in cols]

    for x in batches:
        if x.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in x.columns])
        if sum(len(c[0]) for c in held) > most:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.searchsorted(cols[0], cols[0][-1]))  # the last subtree may go on
            held = [[c[end:].copy() for c in cols]]
            if end:
                yield sorted_([c[:end] for c in cols])
    if held:
        yield sorted_([np.concatenate(c) for c in zip(*held, strict=True)])


def fingerprint_links(distinct: DataFrame, budget: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect every pair within ``budget`` bits.

    A chain of links joins each such pair; no two fingerprints further apart are in one chain unless others
    between them are near.
    """
    members = distinct.select(F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest"), F.lit(BITS).alias("left"), "fp")
    ready = subtrees(members, budget, subtree)[0].select("path", "fp")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, signed in whole_subtrees(batches):
            fp = signed.view(np.uint64)
            first = np.concatenate(([True], (tree[1:] != tree[:-1]) | (fp[1:] != fp[:-1])))  # one subtree may be of several blocks
            a, b = trie_links(tree[first], fp[first], budget)
            yield pa.RecordBatch.from_arrays([pa.array(fp[first][a].view(np.int64)), pa.array(fp[first][b].view(np.int64))], ["a", "b"])

    return ready.mapInArrow(walk, "a long, b long")


# --- components --------------------------------------------------------------------------------------


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``links`` (a, b).

    Large and small stars in turn (Kiveris and others, 2014): each step hangs neighbours on the smallest one, by an
    aggregate with partial sums and a join, until every component is one star. A table in the shared folder ends
    each round.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.expr("coalesce(sum(cast(xxhash64(u, v) % 1000000007 as bigint)), 0)")).first())
    before = sign(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.*").where("u <> v").distinct())
        after = sign(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(narrow: DataFrame, budget: int = 3) -> DataFrame:
    """Per distinct fingerprint of ``narrow`` (doc_id, text_hash, fp; cut): component_id and the row that stands for the component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    distinct = cut(narrow.groupBy("fp").agg(first.alias("first")))
    roots = cut(connected(fingerprint_links(distinct, budget)))
    tagged = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lead = tagged.groupBy("root").agg(F.min("first").alias("first"))
    return tagged.select("fp", "root").join(lead, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_text"))


def near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    narrow = cut(fingerprints(docs, shingle))
    out = narrow.join(classes(narrow, budget), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id, then text hash, stays."""
    narrow = cut(fingerprints(docs, shingle))
    return standing(docs, narrow, cut(classes(narrow, budget).select("component_id", "component_text").distinct()))


def standing(docs: DataFrame, narrow: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their components: those in ``kept`` (component_id, component_text; cut), of equal rows one.

    ``narrow`` has doc_id and text_hash of all rows.
    """
    a, b, h = without(docs.columns, "kept_id", "kept_text", "text_hash")
    rows = docs.withColumn(h, F.xxhash64(text_of()))
    right = kept.select(F.col("component_id").alias(a), F.col("component_text").alias(b))
    out = rows.join(small_side(right), rows["doc_id"].eqNullSafe(F.col(a)) & (F.col(h) == F.col(b)), "left_semi")
    same = narrow.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if same:  # equal rows: one of them stays
        out = out.dropDuplicates(["doc_id", h])
    return out.select(*docs.columns)
