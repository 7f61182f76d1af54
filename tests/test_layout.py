"""Islands, combs, thresholds, interval joins, lines and seams."""

import numpy as np
from pyspark.sql import functions as F

from brinewood.operators import evaluate, layout


def test_peaks_and_runs(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 5, 6, 0, 0, 0, 0, 9, 0])], "g string, at int, v double")
    assert [(r.first, r.last, r.peak) for r in layout.peaks(rows, ["g"], "at", "v", 1.0, 2).orderBy("first").collect()] == [(1, 2, 1), (7, 7, 7)]
    run = layout.longest_run(rows.where("v > 0"), ["g"], "at", 2).first()
    assert (run["first"], run["last"], run["n"]) == (1, 2, 2)


def test_comb(spark):
    good = [("a", y) for y in (10.0, 30.0, 50.0, 90.0, 110.0)]
    bad = [("b", y) for y in (1.0, 2.0, 50.0, 51.5, 400.0)]
    got = layout.comb_fit(spark.createDataFrame(good + bad, "g string, y double"), ["g"], "y").collect()
    assert [(r.g, r.n_teeth, r.n_seen) for r in got] == [("a", 6, 5)] and abs(got[0].slope - 20) < 1e-9


def test_otsu_separates_two_heaps(spark):
    rows = spark.createDataFrame([("a", v, n) for v, n in ((1, 9), (2, 10), (3, 9), (40, 8), (41, 9))], "g string, level int, n long")
    assert layout.otsu(rows, ["g"], "level", "n").first().threshold == 3


def test_interval_join_equals_comparing_all(spark):
    rng = np.random.default_rng(1)
    mk = lambda p: spark.createDataFrame([(1, i, float(x), float(x + w)) for i, (x, w) in enumerate(zip(rng.uniform(0, 100, 40), rng.uniform(0.5, 30, 40), strict=True))], f"k int, id_{p} int, lo_{p} double, hi_{p} double")
    a, b = mk("a"), mk("b")
    got = {(r.id_a, r.id_b) for r in layout.overlapping(a, b, ["k"], 0.3, 8.0).collect()}
    full = a.join(b, "k").where(F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b") >= 0.3 * (F.col("hi_b") - F.col("lo_b")))
    assert got == {(r.id_a, r.id_b) for r in full.collect()}


def test_lines_and_seam(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 10.0), (1, 6.0, 1.0, 9.0, 11.0), (1, 0.0, 20.0, 5.0, 30.0)], "p int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.line_no for r in layout.group_lines(boxes, ["p"]).collect()) == [0, 0, 1]
    ink = np.ones((5, 6))
    ink[3, :] = 0
    assert layout.seam(ink, 0.01).tolist() == [3] * 6


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 7, 7, 0.9), (1, 7, 8, 0.5), (2, 9, 9, 0.3), (2, 9, 8, 0.4)], "q int, truth int, c int, s double")
    ranked = evaluate.ranks(hits, "q", "truth", "c", "s")
    assert {r.q: (r["rank"], round(r.margin, 6)) for r in ranked.collect()} == {1: (1, 0.4), 2: (2, -0.1)}
    r = evaluate.recall(ranked, 2, 1).first()
    assert (r.found, r.recall, r.median_rank) == (1, 0.5, 2)


def test_lines_of_many_pages_are_read_in_one_go(spark):
    """Pages stand one after the other in a task, none is a call of its own; null and NaN places are lines of their own."""
    nan = float("nan")
    rows = [(p, float(k), 10.0 * (k // 2), 0.0, 10.0 * (k // 2) + 8) for p in [*range(700), None] for k in range(6)]
    rows += [(9000, 0.0, None, 0.0, 5.0), (9000, 1.0, nan, 0.0, 5.0), (9000, 2.0, 1.0, 0.0, 5.0)]
    got = layout.group_lines(spark.createDataFrame(rows, "p long, x0 double, y0 double, x1 double, y1 double"), ["p"])
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.collect()
    assert len(got) == len(rows) and all(r.line_no == r.x0 // 2 for r in got if r.p != 9000)
    assert sorted((r.x0, r.line_no) for r in got if r.p == 9000) == [(0.0, 1), (1.0, 2), (2.0, 0)]
