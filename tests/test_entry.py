"""The contract with the driver: queries and SQL by the same names, and columns that agree."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["search_single", "trigram_pairs", "carry_forward", "record_merge", "comb_fit", "align_offset", "catalog_url"])
def test_query_equals_its_sql(spark, name):
    from brinewood.plans import catalogue

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(catalogue.ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(tidy(r[i]) for i in at) for r in rel.fetchall()), key=repr)
