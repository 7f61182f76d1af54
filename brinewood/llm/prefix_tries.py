"""Conversation prefix trie: which conversations share their first turns, rolled up over succinct level-order tries.

A node is a distinct sequence of first turns. Turns are known by 128 bits of hashes of role and text, prefixes by the exclusive
or of the hashes of (place, turn) so far, which a window adds up; texts are shuffled once, to order turns, and then left behind.
Nodes with their members come from one aggregation with partial sums in each task, so a first turn that a third of all
conversations share is one row a task.

Subtrees with at most ``SHARD_TURNS`` turns are prefix shards: whole shards are read into numpy arrays and made into LOUDS tries
(``tries``): the bits of a trie are, in level order, a one for each child and a zero after each node, its labels the prefixes in the
same order, and its values what the nodes add up. Rollups go up in reverse level order with ``np.add.at`` (``rollups``). Nodes above the shards
(the root, and prefixes with more turns below) are the heavy upper levels. They get the totals of the shards' tops and
their own by one running sum along each path, merged by prefix: linear in the turns, however deep the heavy levels are.

The digest of the ids that end at a node is a SHA-256 over all of them in order, so one stream has to read them; they come as
text of up to ``IDS`` ids a row, ordered by the shuffle, and are never held together.

Cases: turns go by turn (null first), then role, then text by their bytes, so ties have an order and repeated rows are
turns of their own; null role or text is empty; rows without conv_id take no part; ``c - c%5`` and ``c%5`` are those of a truncated
division; a conversation without turns after rebuilding is a member of the root alone; an empty table gives an empty result;
texts of any length are hashed whole. Only conv_id, turn, role and text are read, so extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side

#: Turns below a prefix up to which it is kept in one shard, and nodes that a trie of several shards has at least.
SHARD_TURNS, TRIE_NODES = 1 << 16, 1 << 14
#: Of the contract: conversations that share a donor, and one more than the most turns that are lent.
FAMILY, LENT = 5, 9
#: Width of the ranges of ids that come as one text.
IDS = 256
EMPTY = hashlib.sha256(b"").hexdigest()


def _pair(*of: Column | str) -> list[Column]:
    """128 bits of hash as two longs, a and b."""
    return [F.xxhash64(F.lit(seed), *of).alias(k) for k, seed in (("a", 11), ("b", 7919))]


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 1, in order), a, b (hashes of role and text), size (bytes of the text)."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("k", F.row_number().over(order)).select("conv_id", "k", *_pair("role", "text"), F.octet_length("text").cast("long").alias("size"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, k, a, b, size: each conversation with the first turns of its donor in place of its own; k = 0 is the root."""
    ids = turns.where("k = 1").select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % LENT).alias("h"))
    family = F.col("conv_id") % FAMILY
    donors = turns.where((family == 0) & (F.col("k") < LENT)).withColumnRenamed("conv_id", "donor")
    lent = ids.withColumn("donor", F.col("conv_id") - family).join(donors, "donor").where("k <= h").select(turns.columns)
    kept = turns.where(F.col("k") > F.crc32(F.col("conv_id").cast("string")) % LENT)
    zero = F.lit(0).cast("long")
    return ids.select("conv_id", F.lit(0).alias("k"), zero.alias("a"), zero.alias("b"), zero.alias("size")).unionByName(lent).unionByName(kept)


def prefixes(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, size, a, b (the prefix up to here), pa, pb (the one before), below (turns from here on), last.

    ``sequences``: conv_id, k, a, b, size, where the least k of each is the root's.
    """
    w = Window.partitionBy("conv_id").orderBy("k")
    rows = sequences.withColumn("depth", F.row_number().over(w).cast("long") - 1)
    placed = rows.select("conv_id", "k", "depth", "size", *_pair("depth", "a", "b"))
    placed = placed.withColumns({k: F.bit_xor(k).over(w) for k in ("a", "b")})
    placed = placed.withColumns({"pa": F.lag("a").over(w), "pb": F.lag("b").over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})
    return placed.select("conv_id", "depth", "size", "a", "b", "pa", "pb", (F.col("n") - F.col("depth")).alias("below"), (F.col("depth") + 1 == F.col("n")).alias("last"))


def trie_nodes(paths: DataFrame) -> DataFrame:
    """a, b, pa, pb, depth, size, n_convs, conv_id (smallest member), below: every distinct prefix."""
    same = [F.min(c).alias(c) for c in ("pa", "pb", "depth", "size")]
    return paths.groupBy("a", "b").agg(*same, F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("below").alias("below"))


class Louds:
    """A trie in level order. Node 0 stands above all; bits are a one for each child and a zero after each node, behind a first "10"."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.astype(bool)
        self.ones = np.flatnonzero(self.bits)  # where node i is named as a child
        self.zeros = np.flatnonzero(~self.bits)  # where the children of node i - 1 end

    @classmethod
    def of(cls, degrees: np.ndarray) -> Louds:
        """From the number of children of each node in level order."""
        bits = np.ones(int(degrees.sum()) + degrees.size + 2, bool)
        bits[1] = False
        bits[1 + np.cumsum(degrees + 1)] = False
        return cls(bits)

    def __len__(self) -> int:
        return self.ones.size

    def degrees(self) -> np.ndarray:
        return np.diff(self.zeros) - 1

    def parents(self) -> np.ndarray:
        """The parent of every node; -1 for node 0."""
        return self.ones - np.arange(self.ones.size) - 1

    def children(self, i: int) -> range:
        first = int(self.zeros[i] - i)
        return range(first, first + int(self.zeros[i + 1] - self.zeros[i] - 1))

    def levels(self) -> list[range]:
        """The nodes of each level, from node 0 down."""
        out, at = [], range(0, 1)
        while len(at):
            out.append(at)
            first = self.children(at[0]).start
            at = range(first, self.children(at[-1]).stop)
        return out


def level_order(key: np.ndarray, parent_key: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in level order, siblings together and by key; the degree of node 0 and of each row in that order.

    ``level``: 0 for rows whose parent isn't among the keys; these are the children of node 0.
    """
    by_key = np.argsort(key, kind="stable")
    parent = by_key[np.minimum(np.searchsorted(key, parent_key, sorter=by_key), key.size - 1)]
    number = np.zeros(key.size, np.int64)  # of each row, from 1; its parent's is 0 on the first level
    by_level = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[by_level], np.arange(int(level.max(initial=0)) + 2))
    order, above, done = [], [], 1
    for depth, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        rows = by_level[lo:hi]
        up = number[parent[rows]] if depth else np.zeros(rows.size, np.int64)
        at = np.lexsort((key[rows], up))
        rows = rows[at]
        number[rows] = np.arange(done, done + rows.size)
        order.append(rows)
        above.append(up[at])
        done += rows.size
    return np.concatenate(order), np.bincount(np.concatenate(above), minlength=key.size + 1)


_VALUES = ("pa", "pb", "depth", "size", "n_convs", "conv_id")
_TRIE = "bits binary, a array<long>, b array<long>, " + ", ".join(f"{c} array<long>" for c in _VALUES)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a, b], axis=1).astype(">i8").copy().view("S16").ravel()  # bytes of equal width, which numpy sorts


def _trie(cols: dict[str, np.ndarray]) -> dict[str, list]:
    """One trie of whole shards, whose rows stand together, tops first."""
    shard = np.flatnonzero(np.concatenate(([True], (np.diff(cols["sa"]) != 0) | (np.diff(cols["sb"]) != 0))))
    level = cols["depth"] - np.repeat(cols["depth"][shard], np.diff(np.append(shard, cols["sa"].size)))
    order, degrees = level_order(_key(cols["a"], cols["b"]), _key(cols["pa"], cols["pb"]), level)
    bits = Louds.of(degrees).bits
    packed = np.packbits(np.concatenate((bits, np.zeros(-bits.size % 8, bool)))).tobytes()
    return {"bits": [packed], **{c: [cols[c][order]] for c in ("a", "b", *_VALUES)}}


def tries(nodes: DataFrame) -> DataFrame:
    """One row per trie: bits (packed; zeros fill up the last byte), a, b (labels) and values of its nodes in level order.

    ``nodes``: those of ``trie_nodes`` with sa, sb, the top of the shard that they're in.
    """
    rows = nodes.select("sa", "sb", "a", "b", *_VALUES).repartition("sa", "sb").sortWithinPartitions("sa", "sb", "depth")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n = 0

        def joined() -> dict[str, np.ndarray]:
            return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
            n += batch.num_rows
            if n < TRIE_NODES:
                continue
            cols = joined()
            last = max(np.flatnonzero((cols["sa"] != cols["sa"][-1]) | (cols["sb"] != cols["sb"][-1])), default=-1) + 1  # where the last shard begins, which may go on
            if last >= TRIE_NODES:
                yield pa.RecordBatch.from_pydict(_trie({c: x[:last] for c, x in cols.items()}))
                cols = {c: x[last:] for c, x in cols.items()}
            held, n = [cols], cols["sa"].size
        if n:
            yield pa.RecordBatch.from_pydict(_trie(joined()))

    return rows.mapInArrow(build, _TRIE)


_ROLLED = "a long, b long, pa long, pb long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _rolled(trie: Louds, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns of ``rollups``; parent_conv_id is masked at tops."""
    parent, degree = trie.parents(), trie.degrees()
    leaves, saved = (degree == 0).astype(np.int64), np.concatenate(([0], (v["n_convs"] - 1) * v["size"]))
    for nodes in reversed(trie.levels()[1:]):
        own = slice(nodes.start, nodes.stop)
        np.add.at(leaves, parent[own], leaves[own])
        np.add.at(saved, parent[own], saved[own])
    up = np.ma.masked_array(v["conv_id"][np.maximum(parent[1:] - 1, 0)], parent[1:] == 0)
    return {**{c: v[c] for c in ("a", "b", "pa", "pb", "conv_id", "depth")}, "parent_conv_id": up, "n_convs": v["n_convs"], "n_children": degree[1:], "n_leaves": leaves[1:], "saved_tokens": saved[1:]}


def rollups(shards: DataFrame) -> DataFrame:
    """Every node of ``tries`` with its children, and leaves and savings of its subtree; tops have no parent_conv_id."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("a", "b", *_VALUES)}
                bits = np.unpackbits(np.frombuffer(batch.column("bits")[i].as_py(), np.uint8))[: 2 * v["a"].size + 3]
                out = _rolled(Louds(bits), v)
                masks = {c: x.mask for c, x in out.items() if isinstance(x, np.ma.MaskedArray)}
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x), pa.int64(), mask=masks.get(c)) for c, x in out.items()], list(out))

    return shards.mapInArrow(roll, _ROLLED)


def _upper(paths: DataFrame, nodes: DataFrame, heavy: DataFrame, hot: DataFrame, tops: DataFrame, n_heavy: int) -> DataFrame:
    """The heavy nodes with the columns of ``rollups``: own numbers and those of tops, summed along paths, merged by prefix."""
    parents = heavy.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    kids = nodes.join(small_side(parents.select("pa", "pb"), n_heavy), ["pa", "pb"]).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    rows = heavy.join(small_side(cut(kids), n_heavy), ["a", "b"], "left").na.fill(0, ["n_children"])
    own = rows.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    below = tops.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    given = own.unionByName(below).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    sums = hot.join(given, ["conv_id", "depth"], "left").na.fill(0, ["leaves", "saved"]).withColumns({c: F.sum(c).over(up) for c in ("leaves", "saved")})
    sums = sums.groupBy("a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    rows = rows.join(small_side(cut(sums), n_heavy), ["a", "b"]).join(small_side(parents, n_heavy), ["pa", "pb"], "left")
    return rows.select([f.split()[0] for f in _ROLLED.split(", ")])


def endings(paths: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of prefixes at which a conversation ends."""
    ends = paths.where("last").groupBy("a", "b", F.expr(f"conv_id div {IDS}").alias("range"))
    texts = ends.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    texts = texts.repartition("a", "b").sortWithinPartitions("a", "b", "range")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        out: list[tuple] = []
        for batch in batches:
            for key, ids in zip(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True), batch.column("ids"), strict=True):
                if key == now:
                    sha.update(b",")
                else:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(ids.as_py().encode())
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("a", "b", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))
                out = []
        if now:
            yield pa.RecordBatch.from_pydict({"a": [now[0]], "b": [now[1]], "ends_sha256": [sha.hexdigest()]})

    return texts.mapInArrow(digest, "a long, b long, ends_sha256 string")


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node, a and b (its prefix).

    ``sequences``: conv_id, k, a, b (hashes of a turn), size; the least k of each conversation stands for the root.
    """
    paths = cut(prefixes(sequences))
    nodes = cut(trie_nodes(paths))
    is_heavy = (F.col("depth") == 0) | (F.col("below") > shard_turns)
    heavy = nodes.where(is_heavy)
    n_heavy = heavy.count()
    keys = small_side(heavy.select("a", "b"), n_heavy)
    hot = cut(paths.join(keys, ["a", "b"]).select("conv_id", "depth", "a", "b"))
    reach = hot.groupBy("conv_id").agg((F.max("depth") + 1).alias("depth"))
    shards = paths.join(reach, ["conv_id", "depth"]).select("conv_id", F.col("a").alias("sa"), F.col("b").alias("sb"))
    light = cut(rollups(tries(nodes.where(~is_heavy).join(shards, "conv_id"))))
    tops = light.where(F.col("parent_conv_id").isNull())
    upper = _upper(paths, nodes, heavy, hot, tops, n_heavy)
    above = small_side(heavy.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")), n_heavy)
    tops = tops.drop("parent_conv_id").join(above, ["pa", "pb"])
    all_nodes = light.where(F.col("parent_conv_id").isNotNull()).unionByName(tops).unionByName(upper)
    out = all_nodes.join(endings(paths), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "a", "b")


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The contract's nodes: of all conversations, rebuilt."""
    return prefix_trie(rebuilt(cut(own_turns(conversations))), shard_turns).drop("a", "b")
