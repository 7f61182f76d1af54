"""Column functions against small cases, positive, negative and null."""

import pytest
from pyspark.sql import functions as F

from brinewood.functions import fuzzy
from brinewood.functions import text as t


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [(" José ", "JOSE"), ("straße", "STRASSE"), ("Ñandú", "NANDU"), ("", ""), (None, None)])
def test_fold(spark, text, want):
    assert one(spark, t.fold(F.col("a")), a=text) == want


def test_fold_variants(spark):
    assert one(spark, t.fold(F.col("a"), "lower", letters_only=True), a="D'Ávila, 3º") == "davila 3º"
    assert one(spark, t.fold(F.col("a"), compat=True), a="ﬁno") == "FINO"


def test_trigrams_and_similarity(spark):
    assert one(spark, F.size(t.trigrams(F.col("a"))), a="") == 1
    assert one(spark, t.similarity(F.col("a"), F.col("b")), a="MARIA", b="MARIA") == 1.0
    near = one(spark, t.similarity(F.col("a"), F.col("b")), a="VASQUEZ", b="VAZQUEZ")
    assert 0.3 < near < 0.6
    assert one(spark, t.similarity(F.col("a"), F.col("b")), a="ABC", b="XYZ") < 0.2


@pytest.mark.parametrize("q,name,year", [("Contadore 1924", "Contadore", 1924), ("1924", "", 1924), ("Silva 12345", "Silva 12345", None), ("Silva 2031", "Silva 2031", None), ("a 1900 b 1901", "a   b 1901", 1900)])
def test_query_year(spark, q, name, year):
    assert one(spark, t.query_year(F.col("a")), a=q) == year
    assert one(spark, t.query_without_year(F.col("a")), a=q) == name


@pytest.mark.parametrize("text,want", [('"', True), (" ii ", True), ("-,.", True), ("Silva", False), ("", False), (None, False), ("a", False)])
def test_is_mark(spark, text, want):
    assert one(spark, t.is_mark(F.col("a")), a=text) is want


@pytest.mark.parametrize("text,want", [('"Joze', "Joze"), (",Ab", None), ("Joze", None), (None, None)])
def test_after_mark(spark, text, want):
    assert one(spark, t.after_mark(F.col("a")), a=text) == want


@pytest.mark.parametrize("text,want", [("14. Roca", "Roca"), ("14", ""), (" 3 ,", ""), ("1234 Roca", "1234 Roca"), ("Roca 14", "Roca 14"), (None, "")])
def test_strip_ordinal(spark, text, want):
    assert one(spark, t.strip_ordinal(F.col("a")), a=text) == want


@pytest.mark.parametrize("text,a,b", [("ROCA  REBULLIDA AMPARO", "ROCA REBULLIDA", "AMPARO"), ("Roca", "Roca", ""), ("  ", None, None), (None, None, None)])
def test_split_name(spark, text, a, b):
    assert (one(spark, t.surname(F.col("a")), a=text), one(spark, t.given_name(F.col("a")), a=text)) == (a, b)


@pytest.mark.parametrize("text,want", [("ITAPUCA", "ITAPUCA"), ("ri  ad", None), ("RI VE", None), ("12 ab3456", None), (None, None)])
def test_plausible_value(spark, text, want):
    assert one(spark, t.plausible_value(F.col("a")), a=text) == want


@pytest.mark.parametrize("text,want", [("JUN 23 1917", 1917), ("JUN 19 1918", 1918), ("ABR 2 917 2", None), ("MAR 1 1799", None), ("no stamp", None), (None, None)])
def test_stamp_year(spark, text, want):
    assert one(spark, t.stamp_year(F.col("a")), a=text) == want


def test_row_text(spark):
    c = t.row_text(F.col("d"), F.col("r"), F.col("s"), F.col("g"))
    assert one(spark, c, d=["surname"], r='" Ana', s="Silva", g="Ana") == "Silva Ana"
    assert one(spark, c, d=[], r="Silva Ana", s="x", g="y") == "Silva Ana"
    assert one(spark, c, d=[], r="", s="Silva", g="Ana") == "Ana Silva"


def test_repair_double_encoding(spark):
    broken = "notação".encode().decode("latin-1")
    assert one(spark, t.repair_double_encoding(F.col("a")), a=broken) == "notação"
    assert one(spark, t.repair_double_encoding(F.col("a")), a="São Paulo") == "São Paulo"
    assert one(spark, t.repair_double_encoding(F.col("a")), a=None) is None


def test_ratio_is_bounded_by_lengths(spark):
    rows = spark.createDataFrame([("valdivia", "valdivla"), ("ab", "abcdefgh"), (None, "x")], "a string, b string")
    got = rows.select(fuzzy.ro_ratio("a", "b").alias("r"), fuzzy.may_reach(F.col("a"), F.col("b"), 0.85).alias("m")).collect()
    assert got[0].r == pytest.approx(0.875) and got[0].m
    assert got[1].r <= 0.4 and not got[1].m
    assert got[2].r is None


def test_token_alternatives(spark):
    got = one(spark, fuzzy.token_alternatives(F.col("a")), a=["Joao Silva", "Joao Sylva"])
    assert got == [["Joao"], ["Silva", "Sylva"]]
    assert one(spark, fuzzy.token_alternatives(F.col("a")), a=[]) is None
