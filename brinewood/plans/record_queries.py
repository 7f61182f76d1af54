"""Queries on records, their exports and reports, ships, dictionaries and measures. Records are made from customers, all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewood.functions import fuzzy, lexical
from brinewood.functions import text as t
from brinewood.operators import catalog, evaluate, export, extract, layout, lexicon, records, search, voyage
from brinewood.plans.registry import FOLD, LINES, query


def _off(i, m: int):
    """The number of a record and row, folded."""
    return (F.col("c_custkey") + i) % m


def _dossiers(customer: DataFrame) -> DataFrame:
    """A record per customer with up to four rows on two pages; what it says of its voyage depends on its number."""
    some = lambda m, c: F.when(F.col("c_custkey") % m == 0, c)
    said = F.struct(
        some(2, F.col("c_mktsegment")).alias("ship"), some(3, F.lit("Line")).alias("line"), F.lit("").alias("origin"), some(4, F.lit("Port")).alias("port"),
        some(5, F.lit("1924-01-02")).alias("arrival"), F.when(F.col("c_custkey") % 3 != 0, 1900 + F.col("c_nationkey")).otherwise(0).alias("year"), F.lit("stamp").alias("year_source"),
    )
    row = lambda i: F.struct(
        i.cast("int").alias("n"), F.when(i > 2, 2).otherwise(1).alias("page"), F.when(_off(i, 5) == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name_raw"),
        F.col("c_mktsegment").alias("surname"), F.when(_off(i, 9) == 0, F.lit("0")).otherwise(F.lit("X")).alias("given"), F.when(_off(i, 4) != 0, F.create_map(F.lit("surname"), (_off(i, 4) / 8).cast("double"))).alias("conf"),
        F.lit(None).cast("double").alias("indent"), (_off(i, 13) == 0).alias("header"), F.when(_off(i, 3) == 0, F.array(F.lit("surname"))).alias("ditto"),
        F.when(_off(i, 6) == 0, F.lit("mark")).when(_off(i, 12) == 3, F.lit("position")).alias("ditto_source"), F.lit(None).cast("array<array<string>>").alias("name_alts"),
        F.when(_off(i, 10) == 0, F.lit("manual")).alias("source"), F.lit(False).alias("verified"),
    )
    bands = F.array(F.array(F.lit(0.1), F.lit(0.2)))
    page = lambda n, error, measured: F.struct(F.lit(n).alias("n"), error.alias("error"), F.struct(F.when(measured, bands).alias("rows")).alias("geometry"))
    return customer.select(
        F.col("c_custkey").alias("c_custkey"), F.col("c_custkey").cast("string").alias("hash"), F.when(F.col("c_custkey") % 3 != 1, F.concat(F.lit("BS/"), F.col("c_custkey").cast("string"))).alias("notation"), F.col("c_name").alias("file"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("e1")).alias("engine"), (16 + F.col("c_custkey") % 4).cast("int").alias("schema"), F.when(F.col("c_custkey") % 5 == 0, 18).alias("read_schema"),
        F.array(page(1, F.when(F.col("c_custkey") % 11 == 0, F.lit("failed")).otherwise(F.lit("")), F.col("c_custkey") % 2 == 0), page(2, F.lit(None).cast("string"), F.lit(False))).alias("pages"),
        F.transform(F.sequence(F.lit(1), 1 + F.col("c_custkey") % 4), row).alias("rows"), F.when(F.col("c_custkey") % 7 != 0, said).alias("voyage"),
    )


_ROWS = "r AS (SELECT *, unnest(range(1, c_custkey % 4 + 2)) AS i FROM customer)"
_VOYAGE = (
    "v AS (SELECT *, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 2 = 0 THEN c_mktsegment END AS ship, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 = 0 THEN 'Line' END AS line, "
    "CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 4 = 0 THEN 'Port' END AS port, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 = 0 THEN '1924-01-02' END AS arrival, "
    "CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 THEN 1900 + c_nationkey END AS year FROM customer)"
)

# --- reports and gates -----------------------------------------------------------------------------------------


@query("customer", sql=f"WITH {_VOYAGE} SELECT count(*) AS documents, count(*) FILTER (c_custkey % 7 <> 0) AS with_voyage, count(ship) AS with_ship, count(year) AS with_year, count(arrival) AS with_full_date, count(port) AS with_port, count(line) AS with_line FROM v")
def record_summary(customer: DataFrame) -> DataFrame:
    return records.summary(_dossiers(customer))


@query("customer", sql=f"WITH {_VOYAGE}, {_ROWS} SELECT (SELECT count(*) FROM v) AS records, (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM r WHERE (c_custkey + i) % 5 <> 0) AS named, count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 4 < 2) AS stale, count(*) FILTER (c_custkey % 11 = 0) AS errors, count(ship) AS with_ship, count(year) AS with_year, count(port) AS with_port, CAST(0 AS BIGINT) AS with_origin, count(line) AS with_line FROM v")
def record_status(customer: DataFrame) -> DataFrame:
    return records.status(_dossiers(customer))


@query("customer", sql=f"WITH {_ROWS} SELECT CASE WHEN (c_custkey + i) % 6 = 0 THEN 'mark' WHEN (c_custkey + i) % 12 = 3 THEN 'position' ELSE '?' END AS source, count(*) AS n FROM r WHERE (c_custkey + i) % 3 = 0 GROUP BY 1")
def ditto_sources(customer: DataFrame) -> DataFrame:
    return records.ditto_histogram(_dossiers(customer))


@query("customer", sql="SELECT c_custkey, (c_custkey % 5 = 0 OR c_custkey % 4 >= 2) AND c_custkey % 11 <> 0 AS is_current FROM customer")
def schema_gate(customer: DataFrame) -> DataFrame:
    """Whether a record needs no new reading."""
    return _dossiers(customer).select("c_custkey", records.is_current(F.col("read_schema"), F.col("schema"), F.col("pages")).alias("is_current"))


@query("customer", sql=f"WITH {_VOYAGE} SELECT c_custkey, ship IS NOT NULL AND (arrival IS NOT NULL OR year IS NOT NULL) AS complete FROM v")
def complete_records(customer: DataFrame) -> DataFrame:
    return _dossiers(customer).select("c_custkey", F.coalesce(records.is_complete(F.col("voyage")), F.lit(False)).alias("complete"))


@query("customer", sql="SELECT CAST(c_custkey AS VARCHAR) AS hash, CAST(p AS INTEGER) AS page FROM customer, (VALUES (1), (2)) AS u(p) WHERE (p = 1 AND c_custkey % 2 <> 0) OR (p = 2 AND c_custkey % 4 >= 2)")
def geometry_wanted(customer: DataFrame) -> DataFrame:
    """Pages with rows that nobody has measured."""
    return records.pages_wanting_geometry(_dossiers(customer))


@query("customer")
def searchable_rows(customer: DataFrame) -> DataFrame:
    """Rows to search: marks resolved, headers, captions and short ones left out, of records that an engine read."""
    return records.searchable(_dossiers(customer), ("MACHINERY", "NOME E SOBRENOME"), ("furniture", "building")).select("doc", "page", "row", "text", "ship", "year", "conf", "ditto_source")


@query("documents", sql=f"WITH {LINES} SELECT doc_id, pos FROM lines WHERE length({FOLD.format('line')}) >= 4")
def length_filter(docs: DataFrame) -> DataFrame:
    rows = extract.lines_of(docs, ["doc_id"]).where(F.length(t.fold(F.col("line"))) >= records.LEAST_TEXT)
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("pages", sql="SELECT page_id, page_id % 4 IN (0, 2) AS inside FROM pages")
def safe_paths(pages: DataFrame) -> DataFrame:
    """Whether paths lie in a folder, once their steps back are resolved."""
    name = F.md5("url")
    step = F.element_at(F.array(F.lit("/"), F.lit("/../other/"), F.lit("/a/../b/./"), F.lit("/a/../../../")), (F.col("page_id") % 4 + 1).cast("int"))
    return pages.select("page_id", records.contained(F.concat(F.lit("/data/scans"), step, name), "/data/scans").alias("inside"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE min(l_returnflag) END AS name_raw, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE min(l_discount) END AS conf FROM lineitem GROUP BY l_orderkey, l_linenumber")
def band_rows(lineitem: DataFrame) -> DataFrame:
    """A row per band, also where the recogniser has said nothing."""
    bands = lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("text"), F.min("l_discount").alias("confidence"))
    return records.rows_from_bands(bands.select("l_orderkey", "n"), bands.where("n % 3 <> 0"), ["l_orderkey"])


@query("lineitem", sql="WITH c AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 2 = 0) AS a, count(*) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, CASE WHEN b > a THEN CASE WHEN l_returnflag = 'N' THEN 'second' END ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'first' END END AS text FROM lineitem JOIN c USING (l_orderkey)")
def richer_reading(lineitem: DataFrame) -> DataFrame:
    """The second reading of a page where it names strictly more rows."""
    first = lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.lit("first")).alias("text"))
    second = lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", F.lit("second")).alias("text"))
    return records.richer(first, second, ["l_orderkey"], "text")


# --- exports -----------------------------------------------------------------------------------------------------

_EXPORT = (
    "SELECT CAST(r.c_custkey AS VARCHAR) AS hash, CAST(i - 1 AS INTEGER) AS at, CASE WHEN r.c_custkey % 3 <> 1 THEN 'BS/' || r.c_custkey ELSE '' END AS notacao, r.c_name AS arquivo, "
    "coalesce(ship, CASE WHEN r.c_custkey % 11 = 0 THEN '0' END, n_name) AS navio, coalesce(line, '') AS companhia, '' AS procedencia, coalesce(port, '') AS porto_chegada, coalesce(arrival, CAST(year AS VARCHAR), '') AS data_chegada, "
    "CASE WHEN i > 2 THEN '2' ELSE '1' END AS pagina, CAST(i AS VARCHAR) AS linha, CASE WHEN (r.c_custkey + i) % 5 = 0 THEN ' ' ELSE r.c_name END AS nome_lido, r.c_mktsegment AS sobrenome, CASE WHEN (r.c_custkey + i) % 9 = 0 THEN '0' ELSE 'X' END AS nome, "
    "CASE WHEN (r.c_custkey + i) % 10 = 0 THEN 'manual' WHEN r.c_custkey % 3 = 0 THEN '' ELSE 'e1' END AS origem, "
    "CASE WHEN (r.c_custkey + i) % 3 <> 0 THEN 'lido' WHEN (r.c_custkey + i) % 6 = 0 THEN 'aspas de repetição' WHEN (r.c_custkey + i) % 12 = 3 THEN 'posição na lista (inferido)' ELSE 'herdado' END AS sobrenome_origem, "
    "CASE (r.c_custkey + i) % 4 WHEN 0 THEN '' WHEN 1 THEN '0.125' WHEN 2 THEN '0.25' ELSE '0.375' END AS score_motor FROM r JOIN v USING (c_custkey) JOIN nation ON r.c_nationkey = n_nationkey"
)


@query("customer", "nation", sql=f"WITH {_ROWS}, {_VOYAGE} {_EXPORT}")
def export_documents(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """All rows of all records in the fifteen columns; the nation stands for the ship that the archive has filed a record under."""
    filed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), "n_name")
    rows = _dossiers(customer).join(filed, F.col("c_custkey") == F.col("k")).withColumn("ship", F.when(F.col("k") % 11 == 0, F.lit("0")))
    return export.document_rows(rows, F.col("n_name"))


@query("customer", sql="SELECT 'SILVA' AS consulta, c_name AS leitura, '' AS notacao, c_mktsegment AS arquivo, CASE WHEN c_nationkey = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS pagina, CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS linha, '' AS navio, CAST(1900 + c_nationkey AS VARCHAR) AS ano, 'stamp' AS origem_do_ano, CASE c_custkey % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '0.0' ELSE '' END AS pontuacao, CASE c_custkey % 3 WHEN 0 THEN 'semelhança com o nome procurado' WHEN 1 THEN 'todas as chegadas deste ano' ELSE 'todos os passageiros deste navio' END AS achado_por, '' AS score_motor FROM customer")
def export_hit_rows(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey") % 3
    hits = customer.select(
        F.col("c_name").alias("text"), F.lit("").alias("notation"), F.col("c_mktsegment").alias("file"), F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("row"), F.lit(None).cast("string").alias("ship"),
        (1900 + F.col("c_nationkey")).alias("year"), F.lit("stamp").alias("year_source"), F.when(k == 0, F.lit(0.5)).when(k == 1, F.lit(0.0)).alias("score"),
        F.when(k == 1, F.lit("year")).when(k == 2, F.lit("ship")).alias("matched"), F.lit(None).cast("double").alias("conf"),
    )
    return export.hit_rows("SILVA", hits)


@query("customer", sql=r"SELECT c_custkey, replace(CASE WHEN c_custkey % 3 <> 1 THEN 'BS-' || c_custkey ELSE c_name END || '.csv', ' ', '_') AS document, 'busca-' || coalesce(nullif(trim(regexp_replace(c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' & ' || c_nationkey ELSE '!' END, '[^\p{L}\p{N}\-_]', '-', 'g'), '-'), ''), 'vazia') || '.csv' AS hits FROM customer")
def export_names(customer: DataFrame) -> DataFrame:
    asked = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" & "), F.col("c_nationkey").cast("string"))).otherwise(F.lit("!")))
    rows = _dossiers(customer).join(customer.select(F.col("c_custkey").alias("k"), asked.alias("asked")), F.col("c_custkey") == F.col("k"))
    return rows.select("c_custkey", export.document_name(F.col("notation"), F.col("file")).alias("document"), export.hits_name(F.col("asked")).alias("hits"))


# --- catalogue ------------------------------------------------------------------------------------------------------


@query("nation", sql="SELECT n_nationkey, total, part FROM nation, (SELECT unnest(range(1, 9)) AS t) x, LATERAL (SELECT unnest(range(1, t + 1)) AS p) y, LATERAL (SELECT CAST(t AS INTEGER) AS total, CAST(p AS INTEGER) AS part) z")
def candidate_files(nation: DataFrame) -> DataFrame:
    return catalog.candidate_parts(nation.select("n_nationkey")).select("n_nationkey", "total", "part")


@query("part", sql="SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND EXISTS (FROM part q WHERE q.p_partkey = part.p_partkey + 1) THEN CAST(p_partkey + 1 AS VARCHAR) END AS via FROM part")
def follow_reference(part: DataFrame) -> DataFrame:
    """The entry that a stated cross-reference leads to, if it is there."""
    key = lambda c: F.struct(F.lit("BS").alias("fundo"), F.lit("ENT").alias("series"), c.cast("string").alias("index"))
    rows = part.select("p_partkey", F.lit("BS").alias("fundo"), F.lit("ENT").alias("series"), F.col("p_partkey").cast("string").alias("index"), F.when(F.col("p_partkey") % 5 == 0, key(F.col("p_partkey") + 1)).alias("see_also"))
    return catalog.follow(rows).select("p_partkey", F.col("via.index").alias("via"))


# --- ships and dictionaries ---------------------------------------------------------------------------------------------


@query("customer", "nation")
def split_ship(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Queries of a name and a nation that lacks its third letter: the term that names a nation, and the rest."""
    asked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    misread = F.concat(F.substring("n_name", 1, 2), F.expr("substring(n_name, 4)"))
    return search.split_ships(asked.select("c_custkey", F.concat_ws(" ", "c_mktsegment", misread, "c_name").alias("q")), ["c_custkey"], "q", nation.select(F.col("n_name").alias("ship")))


@query("customer", "nation")
def search_rerank_fuzzy_ship(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Scores raised by how much a row's nation is like a misspelt one."""
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ship"), (F.col("c_custkey") % 10 / 10).alias("s"))
    terms = rows.sparkSession.createDataFrame([("GERMANI",), ("UNITED STATE",)], "term string")
    got = search.ship_bonus(rows, "ship", terms)
    none = F.lit(None).cast("int")
    return got.select("c_custkey", F.round("group_ratio", 6).alias("ratio"), search.ranked_score(F.col("s"), search.bonus(none, none, F.col("group_ratio"))).alias("score"))


@query("part")
def rank_readings(part: DataFrame) -> DataFrame:
    """Readings of one word by how much each is a name that parts' names have."""
    names = lexicon.build(part.select(F.explode(F.split("p_name", " ")).alias("w")), "w", least=2)
    first = F.split("p_name", " ")[0]
    readings = part.select("p_partkey", F.array(F.concat(F.lit("x"), first), first, F.col("p_brand")).alias("readings"))
    got = lexicon.ranked(readings, ["p_partkey"], "readings", names, "levenshtein")
    return got.select("p_partkey", F.array_join(F.transform("ranked", lambda x: F.concat_ws(":", x["word"], x["score"].cast("string"))), " ").alias("ranked"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN month(o_orderdate) <> 5 THEN CAST(month(o_orderdate) AS INTEGER) END AS month FROM orders")
def month_number(orders: DataFrame) -> DataFrame:
    """Months that have lost their last letter; of May nothing certain is left."""
    names = tuple((m,) for m in "january february march april may june july august september october november december".split())
    words = orders.select("o_orderkey", F.expr("substring(lower(date_format(o_orderdate, 'MMMM')), 1, length(date_format(o_orderdate, 'MMMM')) - 1)").alias("w"))
    known = words.select("w").distinct().withColumn("month", lexical.month_number(names)(F.col("w")))
    return words.join(known, "w").select("o_orderkey", "month")


@query("part", sql="SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN '(' || p_size % 10 || ')' ELSE p_name END AS value FROM part")
def leading_marks(part: DataFrame) -> DataFrame:
    """Footnote numbers and signs before a name are dropped; alone they stay."""
    n = (F.col("p_size") % 10).cast("string")
    form = F.col("p_size") % 5
    text = F.when(form == 0, F.concat(F.lit("("), n, F.lit(") "), "p_name")).when(form == 1, F.concat(F.lit("- * "), "p_name")).when(form == 2, F.concat(F.lit("["), n, F.lit("]"), "p_name"))
    text = text.when(form == 3, F.concat(n, F.lit(" — "), "p_name")).otherwise(F.concat(F.lit("("), n, F.lit(")")))
    return part.select("p_partkey", lexical.strip_leading_marks(text).alias("value"))


@query("documents")
def voyage_pages(docs: DataFrame) -> DataFrame:
    """Documents read as pages of forms, with words of the tables as marks and labels."""
    lex = voyage.Lexicon(
        parte_marks=("licensed", "released", "license"), lista_marks=("token", "http"), ship_label=r"token\s*=\s*(.*)", origin_label=r"license\s*(.*)", landed_label=r"(\d+)\s+licensed",
        months=tuple((m, i + 1) for i, m in enumerate("january february march april may june july august september october november december".split())),
    )
    return voyage.parse_pages(docs.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text"), lex)


@query("documents")
def alternative_readings(docs: DataFrame) -> DataFrame:
    """Lines with, per word, what a second reading of the line has in its place; the second reading has lost the line's first letter."""
    rows = extract.lines_of(docs, ["doc_id"]).select("doc_id", F.col("pos").alias("n"), F.col("line").alias("name_raw"))
    other = rows.withColumn("name_raw", F.expr("substring(name_raw, 2)"))
    return records.with_alternatives(rows, other, ["doc_id"], fuzzy.token_alternatives).select("doc_id", "n", "alts")


# --- measures and layout ----------------------------------------------------------------------------------------------------


@query("supplier", sql="SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN ['printed'] WHEN s_suppkey % 3 = 0 THEN list_filter([CASE WHEN s_suppkey % 5 > 1 THEN 'left' END, CASE WHEN s_suppkey % 7 > 3 THEN 'rows' END], lambda x: x IS NOT NULL) ELSE [] END AS faults FROM supplier")
def golden_compare(supplier: DataFrame) -> DataFrame:
    """Measured pages against what they should be: printed at all, the column's sides, the number of rows."""
    k = F.col("s_suppkey")
    want = supplier.select("s_suppkey", (k % 3 == 0).alias("printed"), F.lit(0.1).alias("left"), F.lit(0.4).alias("right"), F.lit(30).alias("rows"))
    got = supplier.select("s_suppkey", F.when(k % 4 == 0, k % 3 != 0).otherwise(k % 3 == 0).alias("printed"), (0.1 + (k % 5) * 0.02).alias("left"), F.lit(0.42).alias("right"), (30 + k % 7).alias("rows"))
    return evaluate.golden(want, got, ["s_suppkey"])


@query("lineitem", sql="WITH p AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS place, sum(l_linenumber) AS ink FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber * 6 AS top, l_linenumber * 6 + 4 AS bottom FROM lineitem), h AS (SELECT p.l_orderkey, sum(ink) AS inside FROM p JOIN b ON p.l_orderkey = b.l_orderkey AND place >= top AND place < bottom GROUP BY 1) SELECT t.l_orderkey, CAST(coalesce(inside, 0) AS DOUBLE) AS inside, CAST(total AS DOUBLE) AS total, round(coalesce(inside, 0) / total, 4) AS coverage FROM (SELECT l_orderkey, sum(ink) AS total FROM p GROUP BY 1) t LEFT JOIN h ON t.l_orderkey = h.l_orderkey")
def coverage_metric(lineitem: DataFrame) -> DataFrame:
    """How much of a page's ink lies inside its bands."""
    profile = lineitem.groupBy("l_orderkey", F.col("l_quantity").cast("long").alias("at")).agg(F.sum("l_linenumber").alias("ink"))
    return evaluate.coverage(profile, lineitem.select("l_orderkey", (F.col("l_linenumber") * 6).alias("top"), (F.col("l_linenumber") * 6 + 4).alias("bottom")), ["l_orderkey"])


@query("documents", "labels", sql="SELECT count(*) AS n, count(*) FILTER (quality = 0) AS flagged, count(*) FILTER (toxic = 1) AS bad, count(*) FILTER (quality = 0 AND toxic = 1) AS both, round(count(*) FILTER (quality = 0 AND toxic = 1) / count(*) FILTER (quality = 0), 6) AS precision, round(count(*) FILTER (quality = 0 AND toxic = 1) / count(*) FILTER (toxic = 1), 6) AS recall FROM documents JOIN labels USING (doc_id)")
def flag_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall of one label as a flag for the other."""
    return evaluate.flag_quality(docs.join(labels, "doc_id"), F.col("quality") == 0, F.col("toxic") == 1)


@query("part", sql="SELECT count(*) AS rows, count(*) FILTER (p_size % 2 = 0) AS exact, count(*) FILTER (p_size % 3 <> 0 OR p_size % 2 = 0) AS findable, round(avg(CASE WHEN p_size % 2 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 1 ELSE 1.0 / length(p_name) END), 3) AS cer FROM part")
def bench_score(part: DataFrame) -> DataFrame:
    """Names read whole, with their first letter lost, or not at all."""
    read = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).when(F.col("p_size") % 3 != 0, F.upper(F.expr("substring(p_name, 2)")))
    return evaluate.score(part.select(F.upper("p_name").alias("truth"), read.alias("read")), "read", "truth")


@query("nation", "region", sql="WITH c AS (SELECT n_nationkey, n_name, r_name, levenshtein(r_name, n_name) / length(n_name) AS e FROM nation, region) SELECT n_nationkey, n_name, arg_min(r_name, (e, r_name)) AS match, round(min(e), 6) AS error FROM c GROUP BY ALL")
def best_match(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Of the regions' names the one that is most like each nation's."""
    every = region.select(F.col("r_name"), F.explode(F.sequence(F.lit(0), F.lit(nation.agg(F.max("n_nationkey")).first()[0] or 0))).alias("n_nationkey"))
    return evaluate.best_match(nation, every, ["n_nationkey"], "n_name", "r_name").withColumn("error", F.round("error", 6))


@query("events", sql="SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS columns FROM events")
def column_hint(events: DataFrame) -> DataFrame:
    """Pages without headings take the columns of the last page before them that had some."""
    rows = events.select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("columns"))
    return layout.carried_columns(rows, ["user_id"], "at", "columns").select("event_id", "columns")


@query("lineitem")
def row_bands(lineitem: DataFrame) -> DataFrame:
    """Bands of an order's rows, from where its lines stand."""
    y = F.col("l_linenumber") * 20.0 + F.col("l_quantity") / 25
    marks = lineitem.select("l_orderkey", F.lit("written").alias("kind"), y.alias("y0"), (y + 14).alias("y1"), F.lit(400.0).alias("height"))
    got = layout.row_bands(marks, ["l_orderkey"])
    return got.select("l_orderkey", "n", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query("lineitem")
def line_groups(lineitem: DataFrame) -> DataFrame:
    """Boxes of a page in lines: a box joins the first line whose last box it overlaps by half."""
    y = F.col("l_quantity")
    return layout.group_lines(lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10.0).alias("x0"), y.alias("y0"), (y + 6).alias("y1")), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "line_no")


# --- fields of forms ---------------------------------------------------------------------------------------------------------


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Ship ' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'Ship ' || o_custkey ELSE 'Clerk' END AS value FROM orders")
def value_above_label(orders: DataFrame) -> DataFrame:
    """The ship above its label, past other labels, blank lines, and a nationality that has been read already."""
    ship = F.concat(F.lit("Ship "), F.col("o_custkey").cast("string"))
    form = F.when(F.col("o_orderkey") % 3 == 0, F.concat(ship, F.lit("\nregistro:\n\nvapor"))).when(F.col("o_orderkey") % 3 == 1, F.concat(ship, F.lit("\ninglez\nvapor"))).otherwise(F.lit("Clerk\nvapor\nafter"))
    lines = extract.lines_of(orders.select("o_orderkey", form.alias("text")), ["o_orderkey"])
    return extract.value_above(lines, ["o_orderkey"], "^vapor", F.col("line").rlike("registro|vapor"), F.lit("inglez"))


@query("part", sql="SELECT p_partkey, p_name AS value FROM part WHERE p_size % 3 <> 2")
def quoted_alone(part: DataFrame) -> DataFrame:
    """The first line that is a quoted name and no month, closed or not."""
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("“"), "p_name")).otherwise(F.concat("p_name", F.lit(' "x" y')))
    lines = extract.lines_of(part.select("p_partkey", F.concat(F.lit('plain line\n"Maio"\n'), name).alias("text")), ["p_partkey"])
    return extract.quoted_line(lines, ["p_partkey"], ("maio",))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(day(o_orderdate) AS INTEGER) END AS day, CASE WHEN o_orderkey % 4 = 2 THEN NULL ELSE CAST(month(o_orderdate) AS INTEGER) END AS month, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(year(o_orderdate) - 70 AS INTEGER) END AS year, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate - INTERVAL 70 YEAR, '%Y') || strftime(o_orderdate, '-%m-%d') END AS arrival FROM orders")
def entered_date(orders: DataFrame) -> DataFrame:
    """Dates of entering that run on to the next line; the parts that can't be read are null, and then there is no date."""
    k = F.col("o_orderkey") % 4
    day = F.when(k == 1, F.lit("I7")).otherwise(F.dayofmonth("o_orderdate").cast("string"))
    month = F.when(k == 2, F.lit("xxx")).otherwise(F.date_format("o_orderdate", "MMMM"))
    year = (F.year("o_orderdate") - 70).cast("string")
    year = F.when(k == 3, F.substring(year, 1, 3)).otherwise(F.concat(F.substring(year, 1, 2), F.lit(" "), F.substring(year, 3, 2)))
    text = F.concat(F.lit("Modelo\nfoi entrado em "), day, F.lit(" de "), month, F.lit(" de\n"), year)
    months = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
    got = extract.entered_date(extract.lines_of(orders.select("o_orderkey", text.alias("text")), ["o_orderkey"]), ["o_orderkey"], "entrado em", months)
    return got.select("o_orderkey", "day", "month", "year", "arrival")


_SEA = voyage.Lexicon(
    parte_marks=("interprete", "mortalidade", "nascimentos"), lista_marks=("lista de entrada", "toneladas"), ship_label=r"(?:paquete|vapor)\b(.*)", origin_label=r"procedente d[eo]\b(.*)", landed_label=r"lista com (\S{1,4}) immigrantes",
    months=tuple((m, i + 1) for i, m in enumerate("janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split())),
    flags=("inglez", "francez"), form_words=("registro", "passageiros"), not_head=("policia",), entered="entrado em",
)
_MONTHS = "['janeira','fevereira','marce','abrik','maia','junhe','julhe','agoste','setembra','outubra','novembra','dezembra']"


@query("orders", "customer", sql=f"""WITH o AS (SELECT *, o_orderkey % 5 AS k, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(year(o_orderdate) - 70 AS INTEGER) AS y, 'Vessel ' || lower(c_mktsegment) AS vessel FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE WHEN k = 4 THEN 'parte' ELSE 'lista' END AS source, vessel AS ship, CASE WHEN k IN (1, 2, 4) THEN 'inglez' END AS flag, CASE WHEN k < 4 THEN 'Lloyd Paulista' END AS line, CASE WHEN k = 3 THEN 'Santos' END AS port,
  CASE WHEN k = 0 THEN NULL ELSE printf('%04d-%02d-%02d', y, m, d) END AS arrival, y AS year, CASE WHEN k = 0 THEN 'stamp' ELSE 'printed' END AS year_source, CASE WHEN k <> 0 THEN m END AS month, CASE WHEN k = 4 THEN CAST(o_custkey % 1000 AS INTEGER) END AS passengers FROM o""")
def form_fields(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Forms of five kinds, one per order, their months misread: the ship by place among fragments, behind a nationality, above one, quoted, and in the other form."""
    o = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).withColumn("k", F.col("o_orderkey") % 5)
    vessel, day, year = F.concat(F.lit("Vessel "), F.lower("c_mktsegment")), F.dayofmonth("o_orderdate").cast("string"), (F.year("o_orderdate") - 70).cast("string")
    months = F.array(*[F.lit(m) for m in _MONTHS.strip("[]").replace("'", "").split(",")])
    date = lambda a: F.concat(F.lit(a), day, F.lit(" de "), F.element_at(months, F.month("o_orderdate")), F.lit(" de\n"), year)
    head = F.lit("Lloyd Paulista\nLista de entrada\n90 toneladas\n")
    text = (
        F.when(F.col("k") == 1, F.concat(head, F.lit("vapor inglez "), vessel, F.lit("\n"), date("entrado em "))).when(F.col("k") == 2, F.concat(head, vessel, F.lit("\n90 toneladas\nvapor inglez\n"), date("entrado em ")))
        .when(F.col("k") == 3, F.concat(head, date("Santos, "), F.lit("\nvapor 12\n\""), vessel)).when(F.col("k") == 4, F.concat(F.lit("interprete\nmortalidade\nnascimentos\nvapor inglez \""), vessel, F.lit("\" de\nlista com\n"), (F.col("o_custkey") % 1000).cast("string"), F.lit(" immigrantes\n"), date("entrado em ")))
    )
    box = lambda said, x, y: F.struct(said.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(x + 90.0).alias("x1"), F.lit(y + 20.0).alias("y1"))
    placed = F.array(box(vessel, 300, 194), box(F.lit("vapor"), 200, 206), box(F.lit("Lloyd Paulista"), 90, 10), box(F.lit("Lista de entrada"), 90, 60), box(F.lit("90 toneladas"), 90, 100), box(F.concat(F.lit("JUN 23 "), year), 90, 300))
    fragments = o.where("k = 0").select("o_orderkey", F.explode(placed).alias("b")).select("o_orderkey", "b.*")
    got = voyage.parse_pages(o.select("o_orderkey", text.alias("text")), _SEA, ("o_orderkey",), fragments=fragments)
    return got.select("o_orderkey", "source", "ship", "flag", "line", "port", "arrival", "year", "year_source", "month", "passengers")


# --- what an archive says of itself -------------------------------------------------------------------------------------------

@query("customer", sql="SELECT 'ship' AS field, c_mktsegment AS label, count(*) AS n FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 2 UNION ALL SELECT 'line', 'Line ' || c_mktsegment, count(*) FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 2")
def stated_ships_and_lines(customer: DataFrame) -> DataFrame:
    """Ships and lines that records state, some of them misspelt, grouped by spelling."""
    name = F.when(F.col("c_custkey") % 7 == 1, F.concat(F.col("c_mktsegment"), F.lit("X"))).when(F.col("c_custkey") % 11 == 2, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    some = lambda m, c: F.when(F.col("c_custkey") % m != 0, c)
    return records.said_groups(customer.select(F.struct(some(4, name).alias("ship"), some(3, F.concat(F.lit("Line "), name)).alias("line")).alias("voyage")))


@query("customer", sql=f"WITH {_VOYAGE} SELECT CAST(year AS INTEGER) AS year, count(*) AS n FROM v WHERE year <> 0 GROUP BY 1")
def stated_years(customer: DataFrame) -> DataFrame:
    got = records.said_years(_dossiers(customer))
    return got.select(F.col("year").cast("int").alias("year"), "n")


@query("part", sql="SELECT upper(w) AS name, count(*) AS seen FROM (SELECT unnest(string_split(p_name, ' ')) AS w, * FROM part WHERE p_size % 10 = 0 OR p_partkey % 100 >= 95) WHERE w NOT IN ('bolt', 'gear') AND length(w) >= 3 GROUP BY 1")
def dictionary_from_rows(part: DataFrame) -> DataFrame:
    """Names counted from rows that a person made or that were read cleanly; words near a refused one are left out."""
    rows = part.select(F.col("p_name").alias("name_raw"), (F.col("p_partkey") % 100 / 100).alias("score"), (F.col("p_size") % 10 == 0).alias("by_hand"))
    return lexicon.build_from_rows(rows, ("bolt", "gears"))
