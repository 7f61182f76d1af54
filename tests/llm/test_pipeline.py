"""The pipeline on planted documents, stage by stage, against a brute-force one."""

import numpy as np
from test_models_and_plans import targets_by_rounds
from test_shingles import brute_groups

import corpus_pipeline as p

ITEM = "Thirty brown bears walked over seven frozen lakes before the ranger counted every one of them again"


def planted():
    """(doc_id, text, source), ids of toxic documents and of documents that hold the item: clean ones, toxic ones, copies with few edits, and leaks."""
    rng = np.random.default_rng(11)
    parts = "ba ko mi ru te so la ne ra ti".split()
    words = [a + b + c for a in parts for b in parts for c in parts]
    rows, toxic, leaked = [], set(), set()

    def add(text):
        rows.append((len(rows), text, "abc"[int(rng.choice(3, p=[0.6, 0.3, 0.1]))]))
        return len(rows) - 1

    for i in range(240):
        text = list(rng.choice(words, int(rng.integers(40, 140))))
        if i % 6 == 0:
            for _ in range(5):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(["idiotic", "vilescum"])))
            toxic.add(add(" ".join(text)))
            continue
        first = add(" ".join(text))
        if i % 5 == 1:
            for k in (0, 1):
                copy = list(text)
                copy[int(rng.integers(0, len(copy)))] = f"edited{k}"
                add(" ".join(copy if k else text))
        if i % 11 == 3:
            leaked.add(add(" ".join(text[::-1]) + " " + ITEM + " " + " ".join(rng.choice(words, 30))))
        assert first not in toxic
    return rows, toxic, leaked


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows, toxic, leaked = planted()
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, [i for i, _, _ in rows]
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}

    want = {"toxicity": [i for i in ids if i not in toxic]}
    kept = want["toxicity"]
    groups, _ = brute_groups([text[i] for i in kept])
    want["near_dedup"] = [kept[min(g)] for g in groups]
    want["decontamination"] = [i for i in want["near_dedup"] if ITEM not in text[i]]
    assert [k for k, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"] and leaked and len(want["near_dedup"]) < len(kept) - 20
    for name, stage in p.STAGES[:3]:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(want[name]), name

    out = p.run(spark, sf)
    assert out.columns == [*columns, "law", "shard", "slot"]
    got = out.collect()
    sizes, count = {}, {}
    for i in want["decontamination"]:
        sizes[source[i]] = sizes.get(source[i], 0) + len(text[i].split())
    target = targets_by_rounds(sizes)
    for r in got:
        assert (r.text, r.source) == (text[r.doc_id], source[r.doc_id])
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    for i in want["decontamination"]:  # each as often as its rate says, or once more
        rate = target[source[i]] / sizes[source[i]]
        assert int(rate) <= count.get(i, 0) <= int(rate) + 1
    assert set(count) <= set(want["decontamination"])
    for s in sizes:
        taken = sum(n * len(text[i].split()) for i, n in count.items() if source[i] == s)
        assert abs(taken - target[s]) <= 140
    slots, shard_of = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        shard_of.setdefault(r.text, set()).add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in shard_of.values())


def test_stages_take_odd_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(None, None, None), (1, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(None, None, None, "x"), (1, "", "a", "x"), (1, "", "a", "x"), (2, "word " * 30_000, "a", None), (3, "a few clean words here", None, "x")]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, source string, score string"), spark.createDataFrame([], "doc_id long, text string, source string, score string")):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= 3 * docs.count()
        assert p.STAGES[-1][1](spark, docs, sf).count() == docs.count()
