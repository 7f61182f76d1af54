"""Near-dedup by similarity against brute force on planted edits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brinewood.llm import shingles, simhash


def brute_groups(texts):
    """Sets of row numbers whose texts are linked by a five-word Jaccard of 0.8 or more."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    root = simhash._roots(n, *(np.array(x, int) for x in zip(*pairs, strict=True)))
    return {tuple(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())}, pairs


def planted(seed):
    """Texts of 8 to 300 words, each with edited copies; long ones share a passage; some are without words."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = list(rng.choice(vocabulary, 150))
    texts = [None, "", " \n", "one two", "One  two", "one three"]
    for k in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(8, 300)))) + (passage if k % 4 == 0 else [])
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.integers(0, len(base), max(1, int(len(base) * rng.uniform(0, 0.04)))):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    return texts


def test_stage_equals_brute_force(spark):
    texts = planted(3)
    groups, pairs = brute_groups(texts)
    far = [p for p in pairs if (simhash.fingerprint((texts[p[0]] or "").encode()) ^ simhash.fingerprint((texts[p[1]] or "").encode())).bit_count() > 3]
    assert len(far) > 20  # what three bits don't find
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups)


@pytest.mark.parametrize("subtree", [20_000, 8])
def test_links_of_any_subtrees_are_whole(spark, subtree, monkeypatch):
    """With one short word for all sets, subtrees are hot, or cut as far as that goes; the links are those of brute force."""
    monkeypatch.setattr(shingles, "plan", lambda rows: (5, 2))
    monkeypatch.setattr(shingles, "most_apart", lambda bits, spreads=6.0: bits)
    monkeypatch.setattr(shingles, "words_of_bits", lambda values, bits, words: np.array([values.size % 3, 0], np.uint64))
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    texts = planted(4)[:34]
    narrow = spark.createDataFrame([(i, *signature(t)) for i, t in enumerate(texts)], "doc_id long, sig long, n long, words array<long>")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    narrow = narrow.join(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")), "doc_id")
    distinct = narrow.groupBy("sig").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.min("text_hash").alias("text_hash"))
    root = {r.node: r.root for r in shingles.links(docs, distinct.cache(), 5, 2, subtree).collect()}
    by = {}
    for r in narrow.collect():
        by.setdefault(root.get(r.sig, r.sig), []).append(r.doc_id)
    assert {tuple(sorted(x)) for x in by.values()} == brute_groups(texts)[0]


def signature(t):
    values = shingles.shingle_set((t or "").encode())
    sig = np.array([shingles.xxhash.xxh64_intdigest(values.tobytes(), 42)], np.uint64).view(np.int64)
    return int(sig[0]), int(values.size), shingles.words_of_bits(values, 5, 2).view(np.int64).tolist()


def test_bits_are_counted_and_packed():
    values = np.random.default_rng(1).integers(0, 2**64, 100, dtype=np.uint64)
    for bits, words in ((32, 5), (40, 3), (52, 2)):
        got = shingles.words_of_bits(values, bits, words)
        per = 64 // bits
        for k in range(words):
            x = (values ^ shingles._MASK[k // per]) * shingles._ODD[k // per]
            x ^= x >> np.uint64(32)
            want = sum(1 << b for b in range(64) if int(((x >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(values))
            assert int(got[k]) == (want >> (k % per * bits)) & ((1 << bits) - 1)


def test_pairs_at_the_floor_meet():
    """Of 600 pairs of sets with a similarity of exactly 0.8 hardly any is missed by all words, or is further apart than allowed."""
    rng, missed, apart = np.random.default_rng(2), 0, 0
    bits, words = shingles.plan(100_000)
    for _ in range(600):
        base = rng.integers(0, 2**64, 450, dtype=np.uint64)
        a, b = (shingles.words_of_bits(x, bits, words) for x in (base[:405], np.concatenate([base[45:405], base[405:]])))
        missed += (np.bitwise_count(a ^ b) > shingles.BUDGET).all()
        apart += np.bitwise_count(a ^ b).sum() > shingles.most_apart(bits * words)
    assert missed <= 4 and not apart


def test_stage_takes_odd_tables(spark):
    rows = [(None, None, "x"), (7, "", "x"), (7, "", "x"), (None, "a b", "x"), (2, "A b", "x"), (2, "A b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    kept = shingles.dedup(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, "A b", "x"), (7, "", "x")]
    assert shingles.dedup(docs.limit(0)).count() == 0


def test_few_whole_sets_are_held_at_once(spark, monkeypatch):
    """Verification passes sets to Python a few at a time, however many pairs there are, and leaves the session as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(shingles, "SETS_AT_ONCE", 3)
    seen = []
    monkeypatch.setattr(shingles, "cut", lambda df, real=shingles.cut: seen.append((df.columns, spark.conf.get(name))) or real(df))
    texts = [" ".join(f"w{k}" for k in range(30)) + f" x{i}" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in shingles.dedup(docs).collect()] == [0]
    assert {n for c, n in seen if c == ["sig", "values"]} == {"3"} and spark.conf.get(name) == before
    assert any(n == "3" for c, n in seen if c == ["a", "b"])
