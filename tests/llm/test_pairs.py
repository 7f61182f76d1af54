"""Near-dedup, search and decontamination against brute force."""

import os

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brinewood.llm import decontaminate, simhash, topk


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("text", ["", "one", "Two Words", "a b c", "a b c d e É É a b c", "x y z\tq " * 50, "WORD " * 7])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_xxhash_is_sparks(spark):
    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s").alias("h")).first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", seed=42)


def components(fps, budget=3):
    """Labels by a union-find of its own over all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(np.asarray(fps[:i], np.uint64) ^ np.uint64(x)) <= budget):
            parent[find(int(j))] = find(i)
    return [find(i) for i in range(len(fps))]


def near_and_dense(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]
    return np.unique(np.concatenate([base, np.arange(64, dtype=np.uint64), *near]))  # the latter: all near each other, one heavy subtree


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


@pytest.mark.parametrize("subtree", [20_000, 16])
def test_trie_join_equals_brute_force(spark, subtree):
    fps = near_and_dense(subtree)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.connected(simhash.fingerprint_links(df, 3, subtree)).collect()}
    assert same_partition([got.get(int(x), int(x)) for x in fps.view(np.int64)], components(fps))


@pytest.mark.parametrize("n", [2, 3, 50, 700])
def test_the_trie_is_walked_at_every_size(n):
    """All pairs within the budget, each once, by expanding and pruning nodes; members are only compared at leaves."""
    rng = np.random.default_rng(n)
    fps = np.unique(np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), near_and_dense(n)[: n // 2]]))
    before = dict(simhash.WALKED)
    got = [(int(x), int(y)) for a, b in simhash.trie_pairs(np.zeros(len(fps), np.int64), fps, 3) for x, y in zip(a, b, strict=True)]
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert len(got) == len(set(got)) and {tuple(sorted(x)) for x in got} == set(zip(i.tolist(), j.tolist(), strict=True))
    walked = {k: v - before[k] for k, v in simhash.WALKED.items()}
    assert walked["expanded"] > 0 and (n < 50 or walked["over_budget"] > 0)
    assert walked["leaves"] <= max(1, len(fps) * (len(fps) - 1) // 2) and (n < 700 or walked["leaves"] < len(fps) * (len(fps) - 1) // 8)


def test_walks_across_classes():
    """Equal fingerprints and classes: the pairs of different classes, each once, and nodes of one class are dropped."""
    rng = np.random.default_rng(3)
    fp = np.sort(rng.integers(0, 2**10, 400, dtype=np.uint64))
    same = rng.integers(0, 3, 400)
    order = np.lexsort((same, fp))
    fp, same = fp[order], same[order]
    got = [(int(x), int(y)) for a, b in simhash.trie_pairs(np.zeros(400, np.int64), fp, 2, same, 10) for x, y in zip(a, b, strict=True)]
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2) & (same[:, None] != same[None, :])
    i, j = np.nonzero(np.triu(near, 1))
    assert len(got) == len(set(got)) and {tuple(sorted(x)) for x in got} == set(zip(i.tolist(), j.tolist(), strict=True))
    before = simhash.WALKED["leaves"]
    assert not list(simhash.trie_pairs(np.zeros(400, np.int64), fp, 2, np.zeros(400, int), 10)) and simhash.WALKED["leaves"] == before


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_components_of_given_documents(spark):
    """The query's components against all pairs of independently computed fingerprints."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text or "") for r in rows]
    want = components(np.array(fps, np.uint64))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{x:016x}" for x in fps]
    assert same_partition([got[r.doc_id].component_id for r in rows], want)


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in simhash.connected(links).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500


def test_near_duplicates_and_dedup(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    long = [" ".join(rng.choice(words, 400)) for _ in range(4)]
    rows = [(5, long[0]), (3, long[0]), (9, long[0] + " extra"), (1, long[1]), (None, long[2]), (8, ""), (7, None), (7, None), (2, long[3]), (2, long[3])]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    ids = {r.doc_id: r.component_id for r in got}
    assert ids[5] == ids[3] == ids[9] == 3 and ids[1] == 1 and ids[None] is None and ids[8] == ids[7] == 7
    assert {r.fingerprint for r in got if r.doc_id in (7, 8)} == {"0" * 16}
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.dedup(docs.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 3]) for i in range(230)] + [(50, [1.0, 0.0, 0.0, 0.0]), (231, None), (232, [1.0, None, 0.0, 0.0]), (233, [float("nan"), 0.0, 0.0, 0.0]), (234, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = [(i, np.floor(256 * np.array(np.float32(v), np.float64)).astype(int)) for i, v in vecs if v and None not in v and len(v) == 4 and not np.isnan(v).any()]
    for q in (0, 100, 150, 200):
        own = next(v for i, v in fine if i == q)
        best = sorted((-int(own @ v), i) for i, v in fine if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert len(got[50]) == 10  # two rows of that id are two queries
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_tiles_and_large_values(spark):
    q, c = np.array([[1e15, 1.0]]), np.array([[2.0**60, 3.0], [-(2.0**60), 1.0]])
    assert topk._products(q, c).tolist() == [[2**63 - 1, -(2**63) + 1]]
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.top_k(df).orderBy("rank").collect()] == [(1, 65536), (2, 65536)]


QUESTION = "If Anna has 12 apples and Bob has 7 apples then Anna gives Bob 3 kg of rice, who has more?"


def test_reparameterised_questions_are_found(spark):
    docs = [
        (1, f"Some words before. {QUESTION} And some after."), (2, "filler here then If Carla has 40 apples and Dan has 9 apples then Carla gives Dan 8 kg of rice, who has more?"),
        (3, "If Carla has 40 apples and Dan has 9 apples then Eve gives Dan 8 kg of rice, who has more?"), (4, None), (5, ""), (6, "clean words about apples and rice"),
        (7, QUESTION.upper()), (8, "short item"), (None, QUESTION), (1, f"Some words before. {QUESTION} And some after."),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, "Short item"), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1), (8, 3), (None, 1)}
    assert got[(1, 1)].coverage == 1.0 and got[(1, 1)].n_slots == 0 and got[(2, 1)].n_slots == 5
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_slots_go_one_to_one(spark):
    one = "Carla has 40 apples and Carla has 40 apples then Carla gives Carla 40 kg of rice, who has more?"
    df = spark.createDataFrame([(1, f"If {one}"), (2, f"If {one.replace('Carla', 'Dan', 1)}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert decontaminate.contaminated(df, bench).count() == 0


MARY = "Mary has 5 apples. Mary gives 2 apples to Tom. Mary then buys 9 pears. How many fruits does Mary have?"


def test_names_that_open_sentences_and_lines(spark):
    other = MARY.replace("Mary", "Olga").replace("Tom", "Ivan").replace("5", "31").replace("9", "14")
    docs = [(1, other), (2, other.replace(". Olga", ".\nOlga")), (3, f'He said: "{other}"'), (4, f"and {MARY[0].lower()}{MARY[1:]}"), (5, other.replace("does Olga", "does Vera"))]
    bench = spark.createDataFrame([(1, MARY)], "item_id long, text string")
    got = {r.doc_id: r.coverage for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {1, 2, 3, 4} <= set(got) and 5 not in got and got[1] == 1.0


def test_short_items_by_their_own_length(spark):
    docs = [(1, "here is a short item inside"), (2, "short, item"), (3, "an item that is short"), (4, "word"), (5, "a word more"), (6, "three little words stand here"), (7, "three little pigs")]
    bench = spark.createDataFrame([(1, "Short item"), (2, "word"), (3, "Three little words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (6, 3)}


def test_placeholders_alone_are_no_key(spark):
    """A text of numbers meets an item of numbers where both are the same, and nowhere else."""
    numbers = " ".join(str(i * 7 % 3001) for i in range(3000))
    docs = spark.createDataFrame([(1, numbers), (2, numbers + " then " + " ".join(str(i) for i in range(60)))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(str(i) for i in range(60)))], "item_id long, text string")
    assert decontaminate.benchmark_windows(bench).where("bkept is not null").count() == 0
    assert [r.doc_id for r in decontaminate.contaminated(docs, bench).collect()] == [2]


def test_long_repeated_text_against_a_repeated_item(spark):
    docs = spark.createDataFrame([(1, "la " * 50_000), (2, "lo " * 9)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "La " * 40)], "item_id long, text string")
    assert [(r.doc_id, r.coverage, r.n_windows) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1.0, 36)]


def test_native_plan(spark):
    df = spark.createDataFrame([(1, QUESTION)], "doc_id long, text string")
    plan = decontaminate.contaminated(df, df.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_top_k_over_many_shards(spark):
    rng = np.random.default_rng(8)
    vecs = np.floor(rng.normal(size=(120, 3)) * 8) / 8
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    whole = np.floor(vecs * 256).astype(int)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, k=4, shard_bytes=256).collect())
    want = []
    for q in (0, 50, 100):
        best = sorted((-int(whole[q] @ v), i) for i, v in enumerate(whole) if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def test_top_k_of_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in topk.top_k(df).where("query_id = 100").orderBy("rank").collect()] == [(i + 1, i) for i in range(5)]
