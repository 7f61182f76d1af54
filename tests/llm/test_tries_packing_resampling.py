"""Prefix tries, packing and importance resampling against brute force, laws and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewood.llm import packing, prefix_tries, resampling

public_tokenizers = pytest.importorskip("public_tokenizers")


def brute_trie(rows):
    """{(conv_id, depth): the other columns} by sequences in plain Python."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    out = {}
    for p, who in members.items():
        kids = sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        under = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in who if full[c] == p)
        out[who[0], len(p)] = (members[p[:-1]][0] if p else None, len(who), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def conversations(seed):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bé", "", None, "long " * 40])) for c in [*range(60), -7, -5, -3, 10**12] for t in range(r.choice([0, 1, 2, 3, 5, 12]))]
    same = [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(6)]
    deep = [(c, t, "user", f"turn {t}") for c in (200, 201) for t in range(40)]
    ties = [(300, None, "b", "x"), (300, None, "a", "y"), (300, 1, "b", "x"), (300, 1, "b", "x"), (None, 1, "user", "lost")]
    rows += same + deep + ties
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 50, 1 << 16])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = conversations(shard_turns)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, depth string").repartition(5)
    got = prefix_tries.conversation_trie(df, shard_turns).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == brute_trie(rows)


def test_tries_of_several_shards_a_task(spark, monkeypatch):
    monkeypatch.setattr(prefix_tries, "TRIE_NODES", 8)
    rows = conversations(3)
    got = prefix_tries.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 60).collect()
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == brute_trie(rows)


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_tries.conversation_trie(df).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_louds_tells_the_tree(seeds):
    parent = [seed % (i + 1) for i, seed in enumerate(seeds)]  # node i + 1 hangs below one of 0..i
    n = len(parent)
    level = np.zeros(n, np.int64)
    for i, p in enumerate(parent):
        level[i] = 0 if p == 0 else level[p - 1] + 1
    key = np.array([f"{(i * 7919) % 1009:016d}".encode() for i in range(1, n + 1)], "S16")
    up = np.array([key[p - 1] if p else b"none" for p in parent], "S16")
    if not n:
        return
    order, degrees = prefix_tries.level_order(key, up, level)
    trie = prefix_tries.Louds.of(degrees)
    assert len(trie) == n + 1 and trie.degrees().tolist() == degrees.tolist()
    number = {0: 0} | {int(row) + 1: at + 1 for at, row in enumerate(order)}
    assert {number[i + 1]: number[p] for i, p in enumerate(parent)} == dict(enumerate(trie.parents().tolist()[1:], 1))
    assert [i for nodes in trie.levels() for i in nodes] == list(range(n + 1))
    for i in range(n + 1):
        assert all(trie.parents()[c] == i for c in trie.children(i)) and len(trie.children(i)) == degrees[i]


TOKENS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "one", "It's  the\tCAFÉ d'été\n\nd́a 12,345  x \x1c y\x85z", "wörter " * 3000, "x" * 5000, "a <|endoftext|> b", "日本語 текст", " lead and trail ", "End. END! end... (end); J\u030c, T\u0308. o'S's, -- ?! x' 3.14, A.B.", "same words again", "same words again"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=80), st.sampled_from([(256, 512, 1024, 2048), (2048,), (1, 64)]))
def test_windows_are_full_and_hold_everything_once(sizes, tiers):
    found = packing.windows(sizes, tiers)
    totals = [sum(n for *_, n in w) for w in found]
    assert all(t & (t - 1) == 0 and 0 < t <= tiers[-1] for t in totals) and sum(totals) == sum(sizes)
    at = Counter()
    for doc, start, n in sorted(p for w in found for p in w):
        assert start == at[doc] and n > 0
        at[doc] += n
    assert [at[i] for i in range(len(sizes))] == sizes


def test_few_windows_cut_documents():
    r = random.Random(1)
    sizes = [min(6000, int(r.lognormvariate(5, 1.2)) + 1) for _ in range(8000)]
    found = packing.windows(sizes)
    pieces = sum(len(w) for w in found)
    whole = sum(-(-s // 2048) for s in sizes)
    assert pieces - whole < 0.15 * len(found)  # a cut in one window of seven at most
    lengths = [sum(n for *_, n in w) for w in found]
    steps = packing.step_groups(lengths, 1 << 16)
    load = Counter()
    for s, n in zip(steps, lengths, strict=True):
        load[s] += n
    assert max(load.values()) - min(load.values()) <= 2048


def test_reader_gives_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "READ_CHARS", 100)
    monkeypatch.setattr(packing, "KEPT_WORDS", 10)
    reader = packing.Reader(TOKENS)
    for texts in (TEXTS, TEXTS[::-1], ["Straße ÆON ﬁn Σας ΌΔΟΣ İstanbul ŉ ǅ ªº µ K Å e\u0301t, naïve."]):
        texts = [t or "" for t in texts]
        for text, ids in zip(texts, reader.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reader.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_reader_gives_the_ids_of_given_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    reader = packing.Reader(TOKENS)
    for text, ids in zip(texts, reader.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reader.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bucket", [1, 3000, 1 << 21])
def test_packing_keeps_every_id(spark, bucket):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(2)
    pieces = packing.packed(df, TOKENS, bucket_tokens=bucket)
    got = pieces.collect()
    reader = packing.Reader(TOKENS)
    want = {i: [*np.frombuffer(next(reader.ids([t or ""])), "<u4").tolist(), 1] for i, t, _ in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    for doc, ids in want.items():
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        assert [x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()] == ids and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        total = sum(r.length for r in parts)
        assert [r.offset for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist() and total <= 2048 and total & (total - 1) == 0
    assert {r.sequence_id: r.length for r in packing.sequences(pieces).collect()} == {k: sum(r.length for r in v) for k, v in by_seq.items()}
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(pieces).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in got}


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), TOKENS).count() == 0
    with pytest.raises(ValueError, match="powers of two"):
        packing.packed(spark.createDataFrame([], "doc_id long, text string"), TOKENS, tiers=(100, 200))


def brute_resample(docs, target, buckets, longest, least, share, seed):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0))
    taken = len(may) * share[0] // share[1]
    ranks = [k + 1 if k < taken else None for k in range(len(may))]
    return sorted([(*x[1:], k) for x, k in zip(may, ranks, strict=True)] + [(*x[1:], None) for x in out if x[0] < least], key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    r = random.Random(longest)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "x9", "o'clock", "日本", "zeta", "42"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 4, 5, 30, 200])))) for i in range(150)]
    docs += [(7, None), (None, "beta " * 9), (None, "beta " * 9), (150, "Zeta-alpha, " * 4000), (3, docs[3][1]), (3, docs[3][1])]
    target = ["alpha zeta alpha", None, "", "42 beta"]
    args = dict(buckets=97, longest=longest, least=5, share=(30, 100), seed=11)
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, score string, features int").repartition(7)
    got = resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), **args).collect()
    assert sorted(map(tuple, got), key=repr) == brute_resample(docs, target, **args)


def test_resampling_of_odd_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == [] and [r["rank"] for r in resampling.resample(some, none).collect()] == [None]
    assert [(r.n_features, r.weight, r["rank"]) for r in resampling.resample(some, none, least=1, share=(1, 1)).collect()] == [(2, 2 * math.floor(1000 * math.log(10002 / (2 * 10000))), 1)]
