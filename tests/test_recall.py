"""Recall over all queries of a table."""

from brinewood.plans import catalogue


def test_recall_counts_the_queries_of_the_table(spark, tmp_path):
    rows = [(1, 1, 5.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 2.0), (3, 1, 1.0), (3, 2, 2.0), (3, 3, 3.0), (4, 2, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalogue.QUERIES["recall_at_k"](spark, str(tmp_path)).first()
    assert (got.found, got.total, got.recall, got.median_rank) == (2, 4, 0.5, 2)
