"""Records: flattening, version gates, incremental plans, and the precedence of people over machines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewood.functions.lexical import headings
from brinewood.functions.text import fold, row_text, similarity, squeeze
from brinewood.operators.carry import carry_forward, run_ids
from brinewood.operators.lexicon import cluster

#: Fixed value: records of a later version are skipped.
SCHEMA_VERSION = 18

BOX = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]])
ROW = T.StructType(
    [
        T.StructField("n", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("name_raw", T.StringType()), T.StructField("surname", T.StringType()),
        T.StructField("given", T.StringType()), T.StructField("conf", T.MapType(T.StringType(), T.DoubleType())), T.StructField("indent", T.DoubleType()),
        T.StructField("header", T.BooleanType()), T.StructField("ditto", T.ArrayType(T.StringType())), T.StructField("ditto_source", T.StringType()),
        T.StructField("name_alts", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("source", T.StringType()), T.StructField("verified", T.BooleanType()),
    ]
)
GEOMETRY = T.StructType(
    [T.StructField("rows", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("columns", T.ArrayType(T.DoubleType())), T.StructField("skew", T.DoubleType()), T.StructField("measured_by", T.StringType()), T.StructField("read_from", T.StringType())]
)
PAGE = T.StructType(
    [
        T.StructField("n", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("form", T.StructType([T.StructField("text", T.StringType()), T.StructField("fragments", T.ArrayType(BOX))])), T.StructField("geometry", GEOMETRY),
    ]
)
VOYAGE = T.StructType([*[T.StructField(c, T.StringType()) for c in ("source", "ship", "flag", "origin", "line", "port", "arrival", "arrival_raw", "year_source")], *[T.StructField(c, T.IntegerType()) for c in ("year", "month", "passengers")]])
RECORD = T.StructType(
    [
        T.StructField("schema", T.IntegerType()), T.StructField("read_schema", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("hash", "file", "notation", "identified_by", "engine", "source", "saved_at")],
        T.StructField("pages", T.ArrayType(PAGE)), T.StructField("rows", T.ArrayType(ROW)), T.StructField("voyage", VOYAGE), T.StructField("_corrupt_record", T.StringType()),
    ]
)


def is_current(read_schema: Column, schema: Column, pages: Column, version: int = SCHEMA_VERSION) -> Column:
    """Whether a machine-made record needs no new reading: recent enough and no page failed."""
    failed = F.coalesce(F.exists(pages, lambda p: F.coalesce(p["error"], F.lit("")) != ""), F.lit(False))
    return (F.coalesce(read_schema, schema, F.lit(0)) >= version) & ~failed


def flatten(records: DataFrame, engine_only: bool = True, version: int = SCHEMA_VERSION) -> DataFrame:
    """One row per list row, with its document's fields; later versions, and records without an engine if asked, are left out."""
    kept = records.where(F.coalesce("schema", F.lit(1)) <= version)
    if engine_only:
        kept = kept.where(F.coalesce("engine", F.lit("")) != "")
    rows = kept.select(F.col("hash").alias("doc"), "notation", "file", "voyage", F.posexplode("rows").alias("index_pos", "r"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "doc", "notation", "file", "index_pos", some("voyage.ship").alias("ship"), F.nullif(F.col("voyage.year"), F.lit(0)).alias("year"), some("voyage.year_source").alias("year_source"), "r.*"
    )


def incremental(found: DataFrame, stored: DataFrame, key: str, current: Column) -> DataFrame:
    """What of ``found`` has to be worked on: without a stored record that is current."""
    return found.join(stored.where(current).select(key), key, "left_anti")


def prefer_human(existing: DataFrame, fresh: DataFrame, key: str, value: str, human: str) -> DataFrame:
    """Per key the existing value if a person made it and it isn't empty, else the fresh one, else the existing one."""
    a = existing.select(key, F.col(value).alias("_old"), F.col(human).alias("_human"))
    both = a.join(fresh.select(key, F.col(value).alias("_new")), key, "full")
    keep = F.coalesce(F.col("_human"), F.lit(False)) & F.col("_old").isNotNull()
    return both.select(key, F.when(keep, F.col("_old")).otherwise(F.coalesce("_new", "_old")).alias(value), F.when(keep, F.lit("human")).otherwise(F.lit("machine")).alias("made_by"))


def with_geometry(pages: Column, number: Column, geometry: Column, last_row: Column) -> Column:
    """Pages with a measured geometry on one of them; refused (null) if it has fewer bands than that page has rows."""
    fits = (F.size(geometry["rows"]) > 0) & (F.size(geometry["rows"]) >= last_row)
    return F.when(fits, F.transform(pages, lambda p: F.when(p["n"] == number, p.withField("geometry", geometry)).otherwise(p)))


def read_ratio(rows: DataFrame, page: list[str], text: str) -> DataFrame:
    """page, n_rows, ratio of rows with a reading, and whether that calls for another try (under a half)."""
    filled = (F.trim(F.coalesce(F.col(text), F.lit(""))) != "").cast("int")
    out = rows.groupBy(*page).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(filled).cast("long").alias("n_read"))
    return out.withColumn("retry", F.col("n_read") / F.col("n_rows") < 0.5)


def second_reading(words: Column, alternatives: Column) -> Column:
    """The reading with each word's first alternative in its place; null if nothing differs or the counts don't fit."""
    swapped = F.zip_with(words, alternatives, lambda w, a: F.coalesce(F.try_element_at(a, F.lit(1)), w))
    return F.when((F.size(words) == F.size(alternatives)) & (F.array_join(swapped, " ") != F.array_join(words, " ")), F.array_join(swapped, " "))


def progress(total: Column, done: Column, skipped: Column, elapsed: Column) -> dict[str, Column]:
    """Remaining files and seconds of a batch; failures count in neither."""
    left = F.greatest(F.lit(0), total - done - skipped)
    rate = F.when((elapsed > 0) & (done > 0), done / elapsed)
    return {"remaining": left, "eta_s": F.round(left / rate).cast("long")}


def flagged_next(rows: DataFrame, group: list[str], order: str, flag: Column) -> DataFrame:
    """``rows`` with the position of the next flagged row after each."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_flagged", F.min(F.when(flag, F.col(order))).over(w))


#: Fixed value: pages whose text is worth reading.
TEXT_PAGES = 4


def is_complete(voyage: Column) -> Column:
    """Whether a record says all that ends the reading of further pages: a ship, and a date or a year."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return some(voyage["ship"]) & (some(voyage["arrival"]) | (F.coalesce(voyage["year"], F.lit(0)) != 0))


def text_wanted(page: Column, has_notation: Column, has_voyage: Column, limit: int = TEXT_PAGES) -> Column:
    """Whether a page's text is to be read: the cover for a notation, the first pages for a voyage."""
    return ((page == 1) & ~has_notation) | ((page <= limit) & ~has_voyage)


def page_kind(page: Column) -> Column:
    return F.when(page == 1, F.lit("cover")).otherwise(F.lit("list"))


def pages_wanting_geometry(records: DataFrame, key: str = "hash") -> DataFrame:
    """key, page: pages that own rows, exist, and have no measured bands."""
    rows = records.select(key, F.explode("rows.page").alias("page")).where("page is not null").distinct()
    bare = records.select(key, F.explode("pages").alias("p")).where(F.coalesce(F.size("p.geometry.rows"), F.lit(0)) <= 0)
    return rows.join(bare.select(key, F.col("p.n").alias("page")).distinct(), [key, "page"])


def rows_from_bands(bands: DataFrame, readings: DataFrame, key: list[str]) -> DataFrame:
    """One row per band (key, n): its reading and confidence, or an empty reading of confidence 0 that keeps its number."""
    both = bands.join(readings.select(*key, "n", F.col("text").alias("_t"), F.col("confidence").alias("_c")), [*key, "n"], "left")
    return both.withColumn("name_raw", F.coalesce("_t", F.lit(""))).withColumn("conf", F.when(F.coalesce("_t", F.lit("")) == "", F.lit(0.0)).otherwise(F.col("_c"))).drop("_t", "_c")


def richer(first: DataFrame, second: DataFrame, page: list[str], text: str) -> DataFrame:
    """The rows of the second reading for pages where it names strictly more rows, else those of the first."""
    filled = F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    a, b = first.groupBy(*page).agg(filled.alias("_a")), second.groupBy(*page).agg(filled.alias("_b"))
    better = b.join(a, page, "left").where(F.col("_b") > F.coalesce("_a", F.lit(0))).select(*page)
    return first.join(better, page, "left_anti").unionByName(second.join(better, page, "left_semi"))


def find_in_document(rows: DataFrame, query: str, columns: list[str], floor: float = 0.4, variants: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of which a word of one of ``columns`` is like the query, or like one of its known variants.

    Words are as like as their trigrams; the scope is the columns given.
    """
    asked = [query, *((variants or {}).get(query.lower(), []))]

    def like(words: Column, q: str) -> Column:
        return F.exists(words, lambda w: (F.length(w) > 0) & (similarity(w, fold(F.lit(q))) >= floor))

    hit = F.lit(False)
    for c in columns:
        words = F.split(fold(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+")
        for q in asked:
            hit = hit | like(words, q)
    return rows.where(hit)


def widest_pair(columns: Column) -> Column:
    """The widest gap between adjacent column edges: where names stand."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(columns) - 2), lambda i: F.struct((F.get(columns, i + 1) - F.get(columns, i)).alias("width"), (-i).alias("at")))
    best = F.array_max(pairs)
    return F.when(F.size(columns) >= 2, F.array(F.get(columns, -best["at"]), F.get(columns, 1 - best["at"])))


#: Letters that a row's folded text has at least, and fields whose presence a report counts.
LEAST_TEXT, REPORTED = 4, ("ship", "year", "port", "origin", "line")


def searchable(records: DataFrame, captions: tuple[str, ...] = (), printed: tuple[str, ...] = (), engine_only: bool = True, version: int = SCHEMA_VERSION) -> DataFrame:
    """What can be searched for: a row per list row, with its text and its document's fields.

    Repetition marks are resolved within each run of rows of one page. Printed headers, captions of the list and rows of fewer than
    ``LEAST_TEXT`` folded characters are left out.
    """
    rows = run_ids(flatten(records, engine_only, version), ["doc"], ["index_pos"], "page")
    rows = carry_forward(rows, ["doc", "run"], ["index_pos"], indent="indent")
    rows = rows.withColumn("text", squeeze(F.coalesce(row_text(F.col("ditto"), F.col("name_raw"), F.col("surname"), F.col("given")), F.lit(""))))
    rows = rows.where(~F.coalesce("header", F.lit(False)) & (F.length(fold(F.col("text"))) >= LEAST_TEXT))
    if captions or printed:
        captioned = headings(rows.select("text").distinct(), ["text"], "text", captions, printed).where("heading").select("text")
        rows = rows.join(captioned, "text", "left_anti")
    return rows.select("doc", "notation", "file", "page", F.col("n").alias("row"), "index_pos", "text", "ship", "year", "year_source", F.col("name_alts").alias("alts"), F.try_element_at("conf", F.lit("surname")).alias("conf"), "ditto_source")


def summary(records: DataFrame) -> DataFrame:
    """documents, with_voyage, with_ship, with_year, with_full_date, with_port, with_line over records."""
    some = lambda c: F.count_if(F.coalesce(F.col(f"voyage.{c}").cast("string"), F.lit("")).isin("", "0") == F.lit(False))
    return records.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("voyage").isNotNull()).alias("with_voyage"), some("ship").alias("with_ship"), some("year").alias("with_year"),
        some("arrival").alias("with_full_date"), some("port").alias("with_port"), some("line").alias("with_line"),
    )


def said_groups(records: DataFrame, fields: tuple[str, ...] = ("ship", "line")) -> DataFrame:
    """field, label, n: what records' voyages state of each field, spellings of one name grouped under the commonest."""
    out = None
    for field in fields:
        said = records.select(F.col(f"voyage.{field}").alias("name")).where(F.coalesce("name", F.lit("")) != "")
        counted = said.groupBy("name").agg(F.count(F.lit(1)).alias("seen"))
        groups = cluster(counted, form=lambda c: fold(c, "lower", letters_only=True)).select(F.lit(field).alias("field"), "label", F.col("size").alias("n")).distinct()
        out = groups if out is None else out.unionByName(groups)
    return out


def said_years(records: DataFrame) -> DataFrame:
    """year, n: how many records' voyages state each year."""
    return records.where("voyage.year <> 0").groupBy(F.col("voyage.year").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def status(records: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """records, rows, named, stale, errors, and of how many records each of ``REPORTED`` says something."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("")).isin("", "0") == F.lit(False)
    old = (F.coalesce("engine", F.lit("")) != "") & (F.coalesce("read_schema", "schema", F.lit(0)) < version)
    failed = F.exists("pages", lambda p: F.coalesce(p["error"], F.lit("")) != "")
    size = lambda a: F.coalesce(F.sum(F.greatest(F.size(F.coalesce(a, F.array())), F.lit(0))), F.lit(0)).cast("long")
    return records.agg(
        F.count(F.lit(1)).alias("records"), size(F.col("rows.name_raw")).alias("rows"), size(F.filter("rows.name_raw", lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")).alias("named"),
        F.count_if(old).alias("stale"), F.count_if(F.coalesce(failed, F.lit(False))).alias("errors"), *[F.count_if(said(F.col(f"voyage.{c}"))).alias(f"with_{c}") for c in REPORTED],
    )


def ditto_histogram(records: DataFrame) -> DataFrame:
    """source, n: how rows' surnames were inherited."""
    rows = records.select(F.explode("rows").alias("r")).where(F.size("r.ditto") > 0)
    return rows.groupBy(F.coalesce(F.nullif("r.ditto_source", F.lit("")), F.lit("?")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def with_alternatives(rows: DataFrame, other: DataFrame, key: list[str], alternatives: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``alts``: per word the readings that another reading of the same row (by its number, never by place) has; null if it has none of its own."""
    both = rows.join(other.select(*key, "n", F.col("name_raw").alias("_other")), [*key, "n"], "left")
    alts = alternatives(F.array("name_raw", "_other"))
    return both.withColumn("alts", F.when(F.exists(alts, lambda a: F.size(a) > 1), alts)).drop("_other")


def contained(path: Column, root: str) -> Column:
    """Whether a path, its steps back resolved, lies in a folder or is it."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    # A step back takes the last part away; one that goes above the top can't be inside.
    walked = F.aggregate(parts, F.array(F.lit("")), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    inside = [p for p in root.split("/") if p]
    return path.startswith("/") & (F.slice(walked, 1, len(inside) + 1) == F.array(F.lit(""), *[F.lit(p) for p in inside]))
