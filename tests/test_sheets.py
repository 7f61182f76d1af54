"""Boxes that are made of texts aren't shuffled: the texts are, where headings are too many to broadcast."""

import pytest
from pyspark.sql import functions as F

from brinewood.operators import grid
from brinewood.plans import page_queries as queries
from brinewood.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sheets"))
    line = F.concat(F.lit("12 9 the "), F.repeat(F.lit("word and others "), 3), F.lit("\n 7 3 of it\n8 quex there\n"))
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(line, (F.col("id") % 5 + 1).cast("int"))).alias("text"))
    texts.repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["sheet_columns", "sheet_ordinals", "sheet_written_lines", "sheet_tables"])
def test_many_headings_give_what_few_do(spark, folder, monkeypatch, name):
    few = sorted(map(str, QUERIES[name](spark, folder).collect()))
    monkeypatch.setattr(grid, "SPELLINGS", 5)
    assert few and sorted(map(str, QUERIES[name](spark, folder).collect())) == few


@pytest.mark.parametrize("most", [5, 50_000])
def test_boxes_are_neither_shuffled_nor_sorted(spark, folder, monkeypatch, most):
    monkeypatch.setattr(grid, "SPELLINGS", most)
    rows = QUERIES["sheet_ordinals"](spark, folder)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "SortMergeJoin" not in plan
    above, below = plan[: plan.index("Generate")], plan[plan.index("Generate") :]  # what shuffles above a step that makes boxes shuffles boxes
    assert "hashpartitioning" not in above and ("hashpartitioning" in below) == (most == 5)


def test_sheets_are_read_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    boxes, sizes, heads = queries._sheets(docs)
    assert sizes.count() == docs.count() and 0 < heads.count() <= docs.count()
    assert boxes.count() == docs.select(F.explode(F.split("text", r"[ \n]")).alias("w")).where("w <> ''").count()
