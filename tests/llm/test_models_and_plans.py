"""Classifiers by held-out accuracy, mixing and sharding by their laws, and the pipeline by its stages."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewood.llm import mixing, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"


def test_forest_learns_and_its_arrays_agree_with_walking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit(x[:2000], y[:2000], trees=60)
    assert ((forest.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    row = x[7]
    total = forest.base
    for f, c, v in zip(forest.feature, forest.cut, forest.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(row[f[node]] > c[node])
        total += v[node - len(f)]
    assert forest.logits(x[7:8])[0] == pytest.approx(total)


def test_forest_without_both_labels():
    assert quality.fit(np.zeros((3, 2), np.float32), np.ones(3)).scores(np.zeros((1, 2)))[0] > 0.99
    assert quality.fit(np.zeros((0, 2), np.float32), np.zeros(0)).scores(np.zeros((1, 2)))[0] == pytest.approx(0.5)


def _labelled(spark, n=400):
    rng = np.random.default_rng(1)
    parts = "ba ko mi ru te so la ne ra ti".split()
    words = [f"{a}{b}{c}" for a in parts for b in parts for c in parts]
    rows, labels = [], []
    for i in range(n):
        toxic, junk = int(i % 6 == 0), int(i % 7 == 0)
        w = list(rng.choice(words, rng.integers(20, 120)))
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["idiotic", "vilescum"])))
        rows.append((i, " ".join(f"{x}###" if junk else x for x in w), "en"))
        labels.append((i, 1 - junk, toxic))
    extra = [(n, "", "en"), (n + 1, None, "en"), (None, "baba", "en")]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_classifiers_on_held_out_rows(spark, name):
    docs, labels, truth = _labelled(spark)
    got = (quality.quality_scores if name == "quality" else toxicity.toxicity_scores)(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    want = {i: (q if name == "quality" else t) for i, q, t in truth}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 40 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95


def _rows(rng, n, d):
    return toxicity.packed([np.unique(rng.integers(0, d, rng.integers(0, 6))) for _ in range(n)], rng.integers(1, 5, n).astype(float))


@pytest.mark.parametrize("prior", [0.05, 0.6])
def test_gradient_of_the_risk(prior):
    """By finite differences, on both sides of the non-negative part's kink."""
    rng = np.random.default_rng(4)
    p, u, d = _rows(rng, 30, 8), _rows(rng, 50, 8), 8
    risk = lambda t: toxicity.nn_risk(t, p, toxicity.loss_sums(u, t, -1), u[2].sum(), prior)
    for _ in range(5):
        theta = rng.normal(size=d + 1)
        _, grad = risk(theta)
        for i in range(d + 1):
            step = np.eye(d + 1)[i] * 1e-5
            assert grad[i] == pytest.approx((risk(theta + step)[0] - risk(theta - step)[0]) / 2e-5, abs=1e-6)


def test_the_risk_by_hand():
    p, u = toxicity.packed([np.array([0])]), toxicity.packed([np.array([0]), np.array([], int)], np.array([1.0, 3.0]))
    theta, s = np.array([2.0, -1.0]), lambda z: 1 / (1 + np.exp(-z))
    got = toxicity.nn_risk(theta, p, toxicity.loss_sums(u, theta, -1), 4.0, 0.2)[0]
    rest = (s(1) + 3 * s(-1)) / 4 - 0.2 * s(1)
    assert rest > 0 and got == pytest.approx(0.2 * s(-1) + rest + toxicity.RIDGE / 2 * 4)


def test_passes_over_the_table_sum_what_one_list_does(spark):
    rng = np.random.default_rng(7)
    lists, n = [np.unique(rng.integers(0, 10, rng.integers(0, 5))) for _ in range(60)], rng.integers(1, 9, 60)
    theta = rng.normal(size=11)
    table = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(lists, n, strict=True)], "marks array<int>, n long").repartition(5)
    assert np.allclose(toxicity._negative_sums(table, theta), toxicity.loss_sums(toxicity.packed(lists, n.astype(float)), theta, -1))


def test_passes_over_few_patterns_take_few_tasks(spark):
    many = spark.createDataFrame([([i % 7], 1) for i in range(600)], "marks array<int>, n long").repartition(60)
    few = toxicity.in_few_tasks(many)
    assert few.rdd.getNumPartitions() <= max(4, spark.sparkContext.defaultParallelism) < 60
    theta = np.linspace(-1, 1, 8)
    assert np.allclose(toxicity._negative_sums(few, theta), toxicity._negative_sums(many, theta))


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 30.0, 0.2])
    got = toxicity.minimise(lambda t: (float((t - 1) @ a @ (t - 1)), 2 * a @ (t - 1)), np.zeros(3), steps=60)
    assert np.allclose(got, 1, atol=1e-2)


def test_marks_of_a_text():
    keys = sorted({k for w in ("idiot", "idle") for k in toxicity.features_of(w)})
    marks = toxicity.Marks(keys)
    got = marks.of("Idiot, idiot " + "x " * 120)
    assert {keys[i // 2] for i in got} == set(toxicity.features_of("idiot")) and all(i % 2 == 0 for i in got)
    assert toxicity.Marks(keys, nested=True).present("an idiot's (idle) x_idiom") == {i for i, k in enumerate(keys)}
    assert {i % 2 for i in marks.of("idiot y")} == {0, 1} and marks.of("") == []


def test_unlabelled_text_is_all_there(spark):
    """Every document of the training folds stands in the risk, and none of the held-out one."""
    docs, labels, _ = _labelled(spark)
    seen = {}
    keep = toxicity._negative_sums
    try:
        toxicity._negative_sums = lambda patterns, theta: seen.update(n=patterns.agg(F.sum("n")).first()[0]) or keep(patterns, theta)
        toxicity.train(docs, labels)
    finally:
        toxicity._negative_sums = keep
    assert seen["n"] == docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2).count()


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = _labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity_scores(docs, x).collect()) for x in (labels, other))
    assert a == b


def test_classifiers_on_empty_tables(spark):
    docs, labels, _ = _labelled(spark, 20)
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert f(docs.limit(0), labels).count() == 0
        assert f(docs, labels.limit(0)).count() == 23
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.count() == 23 and kept.columns == docs.columns


def targets_by_rounds(sizes, weights=(1, 2, 3), most=3.0):
    """Share by weight, stop at the caps, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        per = left / sum(w[s] for s in open_)
        over = [s for s in open_ if per * w[s] > most * sizes[s]]
        if not over:
            return target | {s: per * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets_and_takes(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["b", "a", "é", None, "empty", "Z"]
    rows = [(i, names[int(rng.choice(6, p=[0.5, 0.2, 0.1, 0.1, 0.02, 0.08]))], int(rng.integers(1, 80))) for i in range(900)]
    data = [(i, None if s == "empty" else "w " * n, s, 1) for i, s, n in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    got = mixing.mixed(docs).collect()
    sizes = {}
    for _, text, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    want = targets_by_rounds(sizes)
    taken = {}
    for r, (_, _, s, _) in zip(sorted(got, key=lambda r: r.doc_id), data, strict=True):
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= max(80, 0.02 * want[s]) for s in want)  # the size of a document, or little
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_copies_are_bernoulli_at_the_fraction(spark):
    """Over 200 draws each document's mean is its rate, whatever its size: heavy tails, three sources, a hot one."""
    rng, draws, rate = np.random.default_rng(9), 200, {"a": 1.058, "b": 0.91, "c": 2.4}
    data = [(int(rng.pareto(1.1) * 20 + 1), "abc"[int(rng.choice(3, p=[0.2, 0.5, 0.3]))]) for _ in range(60)]
    # Each draw is a source of its own with documents of its own, which is what a seed changes.
    docs = spark.createDataFrame([(k * 100 + i, "w " * n, f"{s}{k}") for k in range(draws) for i, (n, s) in enumerate(data)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(f"{s}{k}", 1, 1.0, r) for k in range(draws) for s, r in rate.items()], "source string, source_size long, target double, rate double")
    rows = docs.select("doc_id", "source", *[c.alias(k) for k, c in mixing._places(17).items()]).cache()
    hist = rows.groupBy("source", "class", "bin").agg(F.count(F.lit(1)).alias("n"))
    plan = mixing.cuts(hist, targets, 17).select("source", "class", "cut")
    sums = {r.i: r.n for r in rows.join(plan, ["source", "class"]).groupBy((F.col("doc_id") % 100).alias("i")).agg(F.count_if(F.col("bin") < F.col("cut")).alias("n")).collect()}
    assert len(sums) == len(data)
    for i, (_, s) in enumerate(data):
        f = rate[s] % 1
        assert abs(sums[i] / draws - f) <= 3.5 * (f * (1 - f) / draws) ** 0.5


def test_no_text_is_shuffled_to_mix(spark):
    docs = spark.createDataFrame([(i, "w " * i, "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_mixing_takes_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a")], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mixed(docs).collect()} == {(0, 0.0, 0)}
    assert mixing.mixed(docs.limit(0)).count() == 0
    plan = mixing.mix_plan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_laws(spark):
    rng = np.random.default_rng(2)
    data = [(i, "x" * int(rng.pareto(1.5) * 40) + f"\n{i % 700}") for i in range(2000)] + [(None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, shard string")
    got = sharding.shards(docs).collect()
    assert len(got) == len(data) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    by, place = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        place.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert set(by) == set(range(8)) and all(len(x) == 1 for x in place.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    total = [sum(r.size for r in x) for x in by.values()]
    assert max(total) - min(total) <= 0.02 * sum(total) + max(r.size for r in got)
    out = sharding.shard_documents(docs)
    assert out.columns == ["doc_id", "text", "shard", "law", "_shard", "slot"] and out.count() == len(data)


def test_sharding_takes_odd_tables(spark):
    docs = spark.createDataFrame([(1, "same")] * 50, "doc_id long, text string")
    assert {r.shard for r in sharding.shards(docs).collect()} and sharding.shards(docs).select("shard", "slot").distinct().count() == 50
    assert sharding.shards(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline_keeps_clean_documents_and_columns(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, n = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == first
        n.append(docs.count())
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.columns == [*first, "law", "shard", "slot"] and last.count() == n[-1]
    assert n[1] >= 0.7 * n[0] and n[2] <= n[1] and n[3] <= n[2]


def test_operators_take_long_texts_repeated_rows_and_clashing_names(spark):
    docs, labels, _ = _labelled(spark, 60)
    more = spark.createDataFrame([(900, "word, " * 60_000, "x"), (901, "same", "x"), (901, "same", "x"), (902, "\n" * 50_000, "x")], "doc_id long, text string, score string")
    odd = docs.unionByName(more).withColumns({"label": F.lit(1), "predicted": F.lit("x"), "size": F.lit(0), "hash": F.lit(0), "component_id": F.lit(0), "marks": F.lit(0)})
    n = odd.count()
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        got = f(odd, labels).collect()
        assert len(got) == n and len({r.score for r in got if r.doc_id == 901}) == 1
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.where("doc_id >= 900").count() == 4
    placed = sharding.shards(odd).collect()
    assert len(placed) == n and {r["size"] for r in placed if r.doc_id == 900} == {360_001} and len({(r.shard, r.slot) for r in placed}) == n


def test_shards_are_those_of_a_tree_built_by_hand(spark):
    """Every split separates what lies below a weighted median along the widest dimension, as near as whole groups of texts allow."""
    rng = np.random.default_rng(6)
    data = [(i, "x" * int(rng.integers(1, 400)) + "\n" * int(rng.integers(0, 9)) + str(i % 90)) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = sharding.metadata(docs)
    local = [r.asDict() for r in rows.collect()]
    whole = {d: max(1, max(r[f"d_{d}"] for r in local) - min(r[f"d_{d}"] for r in local)) for d in sharding.DIMS}

    def key(r, d):
        return (r[f"d_{d}"] << sharding.TIE_BITS) + ((r["hash"] % 2**64) >> (64 - sharding.TIE_BITS))

    def leaves(members, n):
        if n == 1:
            return [members]
        wide = {d: (max(r[f"d_{d}"] for r in members) - min(r[f"d_{d}"] for r in members)) / whole[d] for d in sharding.DIMS}
        d = max(sharding.DIMS, key=lambda x: (wide[x], -sharding.DIMS.index(x)))
        want, total, best = n // 2 / n * sum(r["size"] for r in members), 0, None
        for k in sorted({key(r, d) for r in members}):
            total += sum(r["size"] for r in members if key(r, d) == k)
            if best is None or abs(total - want) < best[0]:
                best = (abs(total - want), k)
        left, right = [r for r in members if key(r, d) <= best[1]], [r for r in members if key(r, d) > best[1]]
        return leaves(left, n // 2) + leaves(right, n - n // 2)

    want = sorted(sum(r["size"] for r in x) for x in leaves(local, 8))
    got = {}
    for r in sharding.shards(docs).collect():
        got[r.shard] = got.get(r.shard, 0) + r["size"]
    assert max(abs(a - b) for a, b in zip(sorted(got.values()), want, strict=True)) <= 0.01 * sum(want)
