"""Exports: a document's rows and a search's hits as tables of fixed columns, and what their files are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of both exports, and what they say of where a surname or a hit comes from.
DOCUMENT_COLUMNS = (
    "notacao", "arquivo", "navio", "companhia", "procedencia", "porto_chegada", "data_chegada", "pagina", "linha", "nome_lido", "sobrenome", "nome",
    "origem", "sobrenome_origem", "score_motor",
)
HIT_COLUMNS = ("consulta", "leitura", "notacao", "arquivo", "pagina", "linha", "navio", "ano", "origem_do_ano", "pontuacao", "achado_por", "score_motor")
SURNAME_FROM = {"mark": "aspas de repetição", "indent": "recuo sob as aspas", "position": "posição na lista (inferido)"}
SURNAME_INHERITED, SURNAME_READ = "herdado", "lido"
FOUND_BY = {"ship": "todos os passageiros deste navio", "year": "todas as chegadas deste ano"}
FOUND_BY_NAME = "semelhança com o nome procurado"


def said(c: Column) -> Column:
    """A text; empty where nothing is said. The text "0" says something."""
    return F.coalesce(c.cast("string"), F.lit(""))


def counted(c: Column) -> Column:
    """A number as text; empty where it is null or zero."""
    return F.when(c != 0, c.cast("string")).otherwise(F.lit(""))


def first_said(*columns: Column) -> Column:
    """The first of several values that says something, else the empty text."""
    return F.coalesce(*[F.nullif(said(c), F.lit("")) for c in columns], F.lit(""))


def arrival(voyage: Column) -> Column:
    """The date of landing as far as it is stated: the whole date, else the year, else nothing."""
    return first_said(voyage["arrival"], counted(voyage["year"]))


def origin(row: Column, engine: Column) -> Column:
    """Who made a row: a person, else the document's engine."""
    return first_said(row["source"], engine)


def surname_from(row: Column) -> Column:
    """Whether a surname was read, or what it was inherited by."""
    table = F.create_map(*[F.lit(x) for kv in SURNAME_FROM.items() for x in kv])
    inherited = F.coalesce(F.size(row["ditto"]) > 0, F.lit(False))
    return F.when(inherited, F.coalesce(F.try_element_at(table, F.coalesce(row["ditto_source"], F.lit(""))), F.lit(SURNAME_INHERITED))).otherwise(F.lit(SURNAME_READ))


def document_rows(records: DataFrame, catalogued: Column | None = None) -> DataFrame:
    """hash, at (place of the row) and ``DOCUMENT_COLUMNS``, one row per list row, blank ones too.

    The ship that the page states goes before the record's own (a column ship, if there is one), and that before the catalogue's.
    """
    own = F.col("ship").cast("string") if "ship" in records.columns else F.lit(None).cast("string")
    rows = records.withColumn("_ship", first_said(own, F.lit(None).cast("string") if catalogued is None else catalogued)).select("hash", "notation", "file", "engine", "voyage", "_ship", F.posexplode("rows").alias("at", "r"))
    r, v = F.col("r"), F.col("voyage")
    score = F.coalesce(F.try_element_at(r["conf"], F.lit("surname")).cast("string"), F.lit(""))
    values = (
        said(F.col("notation")), said(F.col("file")), first_said(v["ship"], F.col("_ship")), said(v["line"]), said(v["origin"]), said(v["port"]), arrival(v), counted(r["page"]),
        counted(r["n"]), said(r["name_raw"]), said(r["surname"]), said(r["given"]), origin(r, F.col("engine")), surname_from(r), score,
    )
    return rows.select("hash", "at", *[c.alias(n) for n, c in zip(DOCUMENT_COLUMNS, values, strict=True)])


def hit_rows(query: str, hits: DataFrame) -> DataFrame:
    """``HIT_COLUMNS`` of hits (text, notation, file, page, row, ship, year, year_source, score, matched, conf)."""
    table = F.create_map(*[F.lit(x) for kv in FOUND_BY.items() for x in kv])
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by = F.coalesce(F.try_element_at(table, F.coalesce("matched", F.lit(""))), F.lit(FOUND_BY_NAME))
    shown = [counted(F.col(c)) if c in ("page", "row", "year") else said(F.col(c)) for c in ("text", "notation", "file", "page", "row", "ship", "year", "year_source")]
    values = (F.lit(query), *shown, plain("score"), by, plain("conf"))
    return hits.select(*[c.alias(n) for n, c in zip(HIT_COLUMNS, values, strict=True)])


def document_name(notation: Column, file: Column) -> Column:
    """The file of a document's rows: its notation, else its file's name, without slashes and blanks."""
    stem = F.replace(F.coalesce(F.nullif(notation, F.lit("")), F.nullif(file, F.lit("")), F.lit("documento")), F.lit("/"), F.lit("-"))
    return F.replace(F.concat(stem, F.lit(".csv")), F.lit(" "), F.lit("_"))


def hits_name(query: Column) -> Column:
    """The file of a search's hits: letters, digits, hyphens and underscores of the query, hyphens for the rest."""
    stem = F.regexp_replace(F.coalesce(F.nullif(query, F.lit("")), F.lit("busca")), r"[^\p{L}\p{N}\-_]", "-")
    return F.concat(F.lit("busca-"), F.coalesce(F.nullif(F.trim(stem, F.lit("-")), F.lit("")), F.lit("vazia")), F.lit(".csv"))
