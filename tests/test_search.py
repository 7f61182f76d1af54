"""Search: empty results, ranking, composition, and the index against comparing everything."""

from pyspark.sql import functions as F

from brinewood.functions import text as t
from brinewood.operators import search

NAMES = ["CONTADORE GUIDO", "CONTADORE", "CASTADORE GUUDO", "ROCA AMPARO", "B   B", "SILVA JOSE", "FORMOSA MARIA", "ÇELIK ÑANDU"]


def lines(spark):
    rows = spark.createDataFrame([(i, x, f"s{i % 2}") for i, x in enumerate(NAMES)], "row long, text string, ship string")
    return rows.withColumn("folded", t.fold(F.col("text")))


def test_nothing_similar_and_short_queries_are_empty(spark):
    assert search.search_lines(lines(spark), "XYZXYZXYZ", ["row"]).count() == 0
    assert search.search_lines(lines(spark), "ab", ["row"]).count() == 0


def test_whole_name_goes_first(spark):
    got = [r.row for r in search.search_lines(lines(spark), "Contadore Guido", ["row"]).collect()]
    assert got[:3] == [0, 1, 2] or got[:3] == [0, 2, 1]


def test_index_loses_nothing(spark):
    rows = lines(spark)
    g = search.grams(rows, ["row"], "folded")
    fast = search.similarity_join(g.withColumnRenamed("row", "a"), g.withColumnRenamed("row", "b"), "a", "b")
    a, b = rows.select(F.col("row").alias("a"), F.col("folded").alias("fa")), rows.select(F.col("row").alias("b"), F.col("folded").alias("fb"))
    full = a.join(b, F.col("a") <= F.col("b")).where(t.similarity(F.col("fa"), F.col("fb")) >= search.MIN_SCORE)
    assert {(r.a, r.b) for r in fast.collect() if r.a <= r.b} == {(r.a, r.b) for r in full.collect()}


def test_one_query_scan_equals_the_join(spark):
    rows = lines(spark)
    q = search.grams(spark.createDataFrame([(1, "CONTADORE GUIDO")], "q long, f string"), ["q"], "f")
    joined = search.similarity_join(q, search.grams(rows, ["row"], "folded"), "q", "row")
    scanned = search.scored_lines(rows, "Contadore Guido", ["row"])
    assert {(r.row, round(r.name_score, 9)) for r in joined.collect()} == {(r.row, round(r.name_score, 9)) for r in scanned.collect()}


def test_bonus_multiplies(spark):
    rows = spark.createDataFrame([(0.5, 1924, 1.0), (0.5, 1900, None), (0.5, None, None), (0.0, 1924, 1.0)], "s double, y int, g double")
    got = [r.x for r in rows.select(search.ranked_score(F.col("s"), search.bonus(F.col("y"), F.lit(1924), F.col("g"))).alias("x")).collect()]
    assert got == [1.0, 0.425, 0.5, 0.0]


def test_tiers(spark):
    named = spark.createDataFrame([(1, 0.9), (2, 0.2)], "row long, score double")
    aboard = spark.createDataFrame([(2, 1.0), (3, 1.0)], "row long, score double")
    assert [(r.row, r.tier) for r in search.compose(named, aboard, ["row"]).collect()] == [(1, 1), (3, 2), (2, 3)]


def many(spark, n=400):
    import numpy as np

    rng = np.random.default_rng(4)
    parts = ["silva", "costa", "mar", "ia", "jo", "se", "ñan", "dú", "ro", "ca", "guido", " "]
    texts = ["".join(rng.choice(parts, rng.integers(1, 7))) for _ in range(n)] + ["", None, "a"]
    rows = spark.createDataFrame([(i, x, f"s{i % 3}") for i, x in enumerate(texts)], "row long, text string, ship string")
    return rows.withColumn("folded", t.fold(F.col("text")))


def test_the_index_finds_what_the_scan_finds(spark):
    rows = many(spark)
    index = search.postings(rows, ["row", "ship"]).cache()
    for q in ("Costa Maria", "ñandú roca", "guido", "ab", "qqqqqq", ""):
        by_index = {(r.row, r.ship, round(r.name_score, 9)) for r in search.scored_postings(index, q, ["row", "ship"]).collect()}
        by_scan = {(r.row, r.ship, round(r.name_score, 9)) for r in search.scored_lines(rows, q, ["row", "ship"]).collect()}
        full = rows.where(t.similarity(F.coalesce("folded", F.lit("")), search.folded_query(q)) >= search.MIN_SCORE) if len(q) >= 3 else rows.limit(0)
        assert by_index == by_scan and {r for r, *_ in by_index} == {r.row for r in full.collect()}


def test_many_queries_equal_the_join_on_grams(spark, monkeypatch):
    rows = many(spark, 120)
    asked = rows.where("row % 7 = 0").select(F.col("row").alias("q"), "folded")
    monkeypatch.setattr(search, "BLOCK_GRAMS", 40)  # several blocks
    pairs = lambda df: {(r.q, r.row, round(r.name_score, 9)) for r in df.collect()}
    fast = pairs(search.search_many(asked, "q", "folded", rows, ["row"]))
    assert fast and fast == pairs(search.search_many(asked, "q", "folded", rows, ["row"], most=1))
    assert search.search_many(asked.limit(0), "q", "folded", rows, ["row"]).count() == 0


def test_a_kept_table_is_built_once_per_state_of_its_source(spark, tmp_path):
    from brinewood.sources import store

    built = []
    make = lambda: built.append(1) or spark.read.parquet(path)
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    for _ in range(2):
        assert store.kept(spark, "t", path, make).count() == 3
    assert len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert store.kept(spark, "t", path, make).count() == 5 and len(built) == 2
