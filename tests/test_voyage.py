"""Voyage records, headings, lexicon functions and the SQL surface."""

import pandas as pd
from pyspark.sql import functions as F

from brinewood.functions import lexical
from brinewood.operators import extract, voyage

LEX = voyage.Lexicon(
    parte_marks=("parte", "interprete", "visitou"), lista_marks=("lista de entrada", "toneladas"), ship_label=r"vapor\b\s*(.*)", origin_label=r"procedente de\b\s*(.*)",
    landed_label=r"lista com (\S{1,4}) immigrantes", months=(("janeiro", 1), ("maio", 5)), flags=("inglez", "francez"), form_words=("consignado", "registro"), not_head=("policia",),
)
PAGES = [
    ("a", 1, "Policia do porto\nLloyd Paulista\nSantos, 4 de maio de\n1912\nLista de entrada\n90 toneladas\nvapor inglez Itapuca\nprocedente de Genova"),
    ("a", 2, "Lista de entrada, toneladas\nvapor\nFormosa\nJUN 23 1917"),
    ("b", 1, "nothing of a form"), ("c", 1, None), ("d", 1, "parte interprete visitou\nvapor Consignado\nlista com 23 immigrantes"),
]


def test_pages_and_documents(spark):
    pages = voyage.parse_pages(spark.createDataFrame(PAGES, "doc string, page int, text string"), LEX)
    got = {(r.doc, r.page): r for r in pages.collect()}
    assert set(got) == {("a", 1), ("a", 2), ("d", 1)}
    a = got[("a", 1)]
    assert (a.source, a.ship, a.flag, a.origin, a.line, a.port) == ("lista", "Itapuca", "inglez", "Genova", "Lloyd Paulista", "Santos")
    assert (a.arrival, a.year, a.year_source, a.month) == ("1912-05-04", 1912, "printed", 5)
    assert (got[("a", 2)].ship, got[("a", 2)].year, got[("a", 2)].year_source) == ("Formosa", 1917, "stamp")
    assert (got[("d", 1)].source, got[("d", 1)].ship, got[("d", 1)].passengers) == ("parte", None, 23)
    whole = {r.doc: r for r in voyage.fold_documents(pages).collect()}
    assert (whole["a"].ship, whole["a"].year, whole["a"].year_source) == ("Itapuca", 1912, "printed")
    again = voyage.reparse(spark.createDataFrame(PAGES, "doc string, page int, text string"), voyage.fold_documents(pages), LEX)
    assert again.count() == 0


def test_leading_nationalities_and_misread_words_of_the_head(spark):
    pages = [
        ("a", 1, "Polizia do porto\nLloyd Sabaudo\nLista de entrada\n90 toneladas\nvapor inglez francez Conte Verde"), ("b", 1, "Lista de entrada\n90 toneladas\nvapor inglez"),
        ("c", 1, "Lista de entrada\n90 toneladas\nvapor Re Vittorio inglez"),
    ]
    got = {r.doc: r for r in voyage.parse_pages(spark.createDataFrame(pages, "doc string, page int, text string"), LEX).collect()}
    assert (got["a"].ship, got["a"].flag, got["a"].line) == ("Conte Verde", "inglez francez", "Lloyd Sabaudo")
    assert (got["b"].ship, got["b"].flag) == (None, "inglez")  # a nationality alone is one, and no ship
    assert (got["c"].ship, got["c"].flag) == (None, None)  # nor is a phrase with one in it


FULL = voyage.Lexicon(
    parte_marks=("parte", "interprete", "visitou"), lista_marks=("lista de entrada", "toneladas"), ship_label=r"(?:paquete|vapor)\b(.*)", origin_label=r"procedente d[eo]\b(.*)", landed_label=r"lista com (\S{1,4}) immigrantes",
    months=(("janeiro", 1), ("maio", 5), ("mai", 5), ("outubro", 10)), flags=("inglez", "francez"), form_words=("registro", "passageiros"), not_head=("policia",), list_label=r"passage\w* no\b(.*)", entered="entrado em", ports=("santos",),
)
HEAD = "Lista de entrada\n90 toneladas\n"


def test_fields_of_both_forms(spark):
    pages = {
        "above": HEAD + "Ravenna\n90 toneladas\nvapor inglez", "quoted": HEAD + "vapor ...\n\"Itabera", "month in quotes": HEAD + "vapor 12\n\"Outubro\"\n“Itapema”",
        "letterhead": "Lloyd Paulista\n" + HEAD + "vapor Lloyd Paulistz", "entered": HEAD + "vapor Itapuca\nfoi entrado em 7 de Oatubro de\n19 21", "day lost": HEAD + "vapor Itapuca\nentrado em f de Outubro de 1921",
        "dateline": HEAD + "Santos, 19 de Maiq de 19.18\nvapor Itapuca", "no such year": HEAD + "Santos, 19 de Maio de 1980\nvapor Itapuca\nJUN 23 1917",
        "parte": "parte\ninterprete\nvisitou\nFormosa\nmore of parte\nvapor inglez\nlista com\n23 immigrantes", "parte quoted": "parte\ninterprete\nvisitou\nvapor inglez \"Bologna\" de",
        "port is no line": "Santos\n" + HEAD + "vapor Itapuca", "none": "vapor Itapuca",
    }
    got = {r.doc: r for r in voyage.parse_pages(spark.createDataFrame([(k, 1, v) for k, v in pages.items()], "doc string, page int, text string"), FULL).collect()}
    assert set(got) == set(pages) - {"none"}
    assert {k: (r.ship, r.flag) for k, r in got.items() if k in ("above", "quoted", "month in quotes", "letterhead", "parte", "parte quoted")} == {
        "above": ("Ravenna", "inglez"), "quoted": ("Itabera", None), "month in quotes": ("Itapema", None), "letterhead": (None, None), "parte": ("Formosa", "inglez"), "parte quoted": ("Bologna", "inglez"),
    }
    assert (got["entered"].arrival, got["entered"].year, got["entered"].year_source) == ("1921-10-07", 1921, "printed")
    assert (got["day lost"].arrival, got["day lost"].month, got["day lost"].year) == (None, 10, 1921)
    assert (got["dateline"].arrival, got["dateline"].port, got["dateline"].month) == ("1918-05-19", "Santos", 5)
    assert (got["no such year"].year, got["no such year"].year_source, got["no such year"].month) == (1917, "stamp", None) and "1980" in got["no such year"].arrival_raw
    assert got["parte"].passengers == 23 and got["port is no line"].line is None and got["letterhead"].line == "Lloyd Paulista"


def test_values_are_found_by_place(spark):
    def box(text, x, y, wide=80):
        return ("a", 1, text, float(x), float(y), float(x + wide), y + 20.0)

    boxes = [box("90 toneladas", 100, 150), box("Indiana", 300, 195), box("Lista de entrada", 100, 60), box("vapor", 200, 205), box("(2)", 290, 205, 8), box("far Below", 300, 260), box("procedente de", 100, 300), box("(1) Genova", 240, 308)]
    fragments = spark.createDataFrame([*boxes, ("b", 1, "vapor", 0.0, 0.0, 1.0, 1.0)], "doc string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("a", 1, "nothing to read here"), ("c", 1, HEAD + "vapor Itapuca")], "doc string, page int, text string")
    assert [r.line for r in extract.fragment_lines(fragments.where("doc = 'a'"), ["doc", "page"]).orderBy("pos").collect()][:3] == ["Lista de entrada", "90 toneladas", "Indiana"]
    got = {r.doc: r for r in voyage.parse_pages(pages, FULL, fragments=fragments).collect()}
    assert {k: (r.ship, r.origin) for k, r in got.items()} == {"a": ("Indiana", "Genova"), "c": ("Itapuca", None)}


def test_forms_of_nothing(spark):
    none = spark.createDataFrame([], "doc string, page int, text string")
    assert voyage.parse_pages(none, FULL).count() == 0 and voyage.parse_pages(none, FULL, fragments=spark.createDataFrame([], "doc string, page int, text string, x0 double, y0 double, x1 double, y1 double")).count() == 0


def test_headings(spark):
    rows = [(1, "Nomes e Cognomes"), (2, "Nomes e Cognome"), (3, "registro consignada"), (4, "registro"), (5, "registra"), (6, "Gomes"), (7, "Total34"), (8, None), (9, "Silva Ana")]
    got = lexical.headings(spark.createDataFrame(rows, "k int, text string"), ["k"], "text", ("NOMES E COGNOMES", "NOMES"), ("registro", "consignado", "total"))
    assert {r.k for r in got.collect() if r.heading} == {1, 2, 3, 4, 7}


def test_months_marks_and_flags(spark):
    month = lexical.month_number((("janeiro", "jan"), ("fevereiro", "fev")))
    rows = spark.createDataFrame([("janairo",), ("jan",), ("jam",), ("xyz",), (None,)], "w string")
    assert [r.m for r in rows.select(month(F.col("w")).alias("m")).collect()] == [1, 1, None, None, None]
    rows = spark.createDataFrame([("(2) Duca degli Abruzzi",), ("()JENOS AYRES",), ("(2)",), (None,)], "v string")
    assert [r.x for r in rows.select(lexical.strip_leading_marks(F.col("v")).alias("x")).collect()] == ["Duca degli Abruzzi", "JENOS AYRES", "(2)", None]
    rest, flag = lexical.split_leading(F.array(F.lit("inglez"), F.lit("Itapuca")), F.array(F.lit(True), F.lit(False)))
    assert tuple(spark.range(1).select(rest.alias("a"), flag.alias("b")).first()) == ("Itapuca", "inglez")


def test_sql_surface(spark):
    names = lexical.register(spark)
    assert spark.sql("SELECT fold_name(' José ') AS x").first().x == "JOSE"
    assert spark.sql("SELECT trigram_similarity('MARIA', 'MARIA') AS x").first().x == 1.0 and "ro_ratio" in names
    assert spark.sql("SELECT ro_ratio('abcd', 'abce') AS x").first().x == 0.75


def test_headings_are_judged_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "registro consignado"), (2, None), (3, "registro desconhecido"), (3, "registro consignadc")], "k int, text string")
    got = lexical.headings(rows, ["k"], "text", ("NOMES E COGNOMES",), ("registro", "consignado"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted((r.k, bool(r.heading)) for r in got.collect()) == [(1, True), (2, False), (3, False), (3, True)]


def test_words_and_ports_are_judged_once(spark):
    """What a word can be is asked once per distinct word, however many lines have it, though only some are kept by the answer."""
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("int")
    def month(c: pd.Series) -> pd.Series:
        asked.add(len(c))
        return c.map(lambda w: 5 if w == "maio" else None).astype("Int32")

    lines = spark.createDataFrame([(k, p, f"rio, {k % 3} de maio") for k in range(40) for p in range(3)], "k int, pos int, line string")
    got = extract.words_with_months(lines, ["k"], month, 10)
    assert {(r.k, r.pos, r.at, r.word, r.month) for r in got.collect()} == {(k, p, 3, "maio", 5) for k in range(40) for p in range(3)}
    assert asked.value < 10  # rio, maio; not the 240 words of the lines
