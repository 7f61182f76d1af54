"""Queries on ordered lists, scalar functions, forms and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.functions import fuzzy, lexical
from brinewood.functions import text as t
from brinewood.operators import carry, catalog, evaluate, extract, lexicon, records
from brinewood.plans.registry import FOLD, LINES, folder_query, query
from brinewood.sources import hashes, tables

# --- ordered lists ----------------------------------------------------------------------------------------

_READING = "CASE WHEN event_id % 7 IN (0, 1) AND event_id % 3 <> 0 THEN '' WHEN event_id % 5 = 0 THEN '\"' WHEN event_id % 5 = 1 THEN '\" ' || event_type WHEN event_id % 5 = 2 THEN event_type ELSE upper(event_type) || ' ' || event_type END"


def _readings(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", "user_id", "ts", F.expr(_READING.replace("'\"'", "'\\\"'").replace("'\" '", "'\\\" '")).alias("name_raw"))
    return rows.withColumn("surname", t.surname(F.col("name_raw"))).withColumn("given", t.given_name(F.col("name_raw")))


_CARRIED = (
    f"r AS (SELECT event_id, user_id, ts, {_READING} AS raw FROM events), "
    "p AS (SELECT *, row_number() OVER w AS pos, len(string_split(raw, ' ')) AS n, raw = '' AS blank, raw = '\"' AS mark, raw LIKE '\" %' AS lead FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "g AS (SELECT *, pos - coalesce(max(CASE WHEN NOT blank THEN pos END) OVER w, 0) - 1 AS since, arg_max(CASE WHEN n >= 2 AND NOT lead THEN string_split(raw, ' ')[1] END, CASE WHEN n >= 2 AND NOT lead THEN pos END) OVER w AS head FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "c AS (SELECT event_id, user_id, raw, CASE WHEN blank OR head IS NULL OR since > 2 THEN NULL WHEN mark OR lead THEN 'mark' WHEN n = 1 THEN 'position' END AS ditto_source, head, mark, lead, n, blank FROM g)"
)


@query("events", sql=f"WITH {_CARRIED} SELECT event_id, ditto_source, CASE WHEN ditto_source IS NOT NULL THEN head WHEN blank THEN NULL WHEN n = 1 THEN raw ELSE string_split(raw, ' ')[1] END AS surname FROM c")
def carry_forward(events: DataFrame) -> DataFrame:
    return carry.carry_forward(_readings(events), ["user_id"], ["ts", "event_id"]).select("event_id", "ditto_source", "surname")


@query("events", sql=f"WITH {_CARRIED} SELECT coalesce(ditto_source, 'read') AS source, count(*) AS n FROM c GROUP BY 1")
def carry_sources(events: DataFrame) -> DataFrame:
    got = carry.carry_forward(_readings(events), ["user_id"], ["ts", "event_id"])
    return got.groupBy(F.coalesce("ditto_source", F.lit("read")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("events", sql="SELECT event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def page_runs(events: DataFrame) -> DataFrame:
    return carry.run_ids(events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "run")


@query("events", sql="SELECT event_id, pos - max(CASE WHEN event_type = 'purchase' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)")
def gap_since_nonblank(events: DataFrame) -> DataFrame:
    return carry.gap_before(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "gap")


@query("events")
def list_breaks(events: DataFrame) -> DataFrame:
    """Where numbering, here the event number modulo 100, starts again in a user's list."""
    rows = events.select("user_id", "ts", "event_id", (F.col("event_id") % 100).cast("string").alias("ordinal"))
    return carry.list_breaks(rows, ["user_id"], ["ts", "event_id"], "ordinal")


# --- scalars -----------------------------------------------------------------------------------------------


@query("part", sql="SELECT p_partkey, p_name AS name FROM part")
def strip_ordinal(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", t.strip_ordinal(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(". "), "p_name")).alias("name"))


@query("part", sql="SELECT p_partkey, array_to_string(a[:-2], ' ') AS surname, a[-1] AS given FROM (SELECT p_partkey, string_split(p_name || '  x', ' ') AS q, string_split(p_name || ' x', ' ') AS a FROM part)")
def split_name(part: DataFrame) -> DataFrame:
    name = F.concat("p_name", F.lit("  x"))
    return part.select("p_partkey", t.surname(name).alias("surname"), t.given_name(name).alias("given"))


@query("part", sql="SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || ' ' || p_type WHEN p_size % 3 = 1 THEN p_name ELSE p_type || ' ' || p_brand END AS text FROM part")
def row_text(part: DataFrame) -> DataFrame:
    ditto = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("surname")))
    raw = F.when(F.col("p_size") % 3 == 1, F.col("p_name"))
    return part.select("p_partkey", t.row_text(ditto, raw, F.col("p_brand"), F.col("p_type")).alias("text"))


@query("documents", sql=f"WITH {LINES}, w AS (SELECT doc_id, unnest(string_split(line, ' ')) AS w FROM lines) SELECT doc_id, count(*) AS n_marks FROM w WHERE w <> '' AND (lower(w) IN ('11', 'n', 'u', 'ii', 'il', 'li', 'y', 'v') OR regexp_full_match(w, '[\"“”„«»''‘’,.\\-=/|〃_~*:;`^·]+')) GROUP BY doc_id")
def mark_predicate(docs: DataFrame) -> DataFrame:
    """Words that would be read as repetition marks, per document."""
    words = extract.lines_of(docs, ["doc_id"]).select("doc_id", F.explode(F.split("line", " ")).alias("w"))
    return words.where((F.col("w") != "") & t.is_mark(F.col("w"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_marks"))


@query("documents", sql=rf"WITH {LINES}, l AS (SELECT *, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS k FROM lines) SELECT doc_id, count(*) AS n FROM l WHERE k >= 4 AND 2 * k >= length(replace(line, ' ', '')) AND len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 3)) > 0 GROUP BY doc_id")
def plausible_value(docs: DataFrame) -> DataFrame:
    rows = extract.lines_of(docs, ["doc_id"]).where(t.plausible_value(F.col("line")).isNotNull())
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN y BETWEEN 1993 AND 1996 THEN y END AS year FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)")
def plausible_year(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", t.plausible_year(F.year("o_orderdate"), 1993, 1996).alias("year"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(year(o_orderdate) - 70 AS INTEGER) END AS year FROM orders")
def stamp_year(orders: DataFrame) -> DataFrame:
    """Stamps such as ABR 2 1921; every fourth has lost a digit and says nothing."""
    y = (F.year("o_orderdate") - 70).cast("string")
    text = F.concat(F.lit("SANTOS ABR "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), F.when(F.col("o_orderkey") % 4 == 3, F.substring(y, 1, 3)).otherwise(y))
    return orders.select("o_orderkey", t.stamp_year(text).alias("year"))


@query("documents", sql=rf"""WITH {LINES} SELECT doc_id, md5(string_agg(regexp_replace(line, '^[\s.,;:\-_·"“”''’]+|[\s.,;:\-_·"“”''’]+$', '', 'g'), '|' ORDER BY pos)) AS cleaned FROM lines GROUP BY doc_id""")
def clean_edges(docs: DataFrame) -> DataFrame:
    rows = extract.lines_of(docs, ["doc_id"]).select("doc_id", "pos", t.clean_edges(F.col("line")).alias("c"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "|")
    return rows.groupBy("doc_id").agg(F.md5(joined).alias("cleaned"))


@query("documents")
def mojibake_repair(docs: DataFrame) -> DataFrame:
    """Texts whose bytes are read as Latin-1 and repaired again, by how many come back whole."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    fixed = docs.select("lang", t.repair_double_encoding(broken).alias("r"), "text")
    return fixed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") == F.col("text")).alias("n_whole"))


@query("documents")
def token_alternatives(docs: DataFrame) -> DataFrame:
    """Words of every line against a reading of it with its first word changed."""
    lines = extract.lines_of(docs, ["doc_id"])
    other = F.regexp_replace("line", r"^\S+", "Other")
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), fuzzy.token_alternatives(F.array("line", other)).alias("alternatives"))


# --- forms --------------------------------------------------------------------------------------------------


@query("documents", sql=rf"""WITH {LINES}, l AS (SELECT doc_id, pos, line, CASE WHEN NOT regexp_matches(line, 'token\s*=') AND trim(line) <> '' THEN trim(line) END AS plain FROM lines), n AS (SELECT *, lag(plain) OVER w AS above, lead(plain) OVER w AS below FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), h AS (SELECT doc_id, pos, coalesce(nullif(trim(regexp_extract(line, 'token\s*=\s*(.*)', 1)), ''), above, below) AS value FROM n WHERE regexp_matches(line, 'token\s*=')) SELECT doc_id, arg_min(value, pos) AS value FROM h GROUP BY doc_id""")
def label_value_beside(docs: DataFrame) -> DataFrame:
    return extract.value_beside(extract.lines_of(docs, ["doc_id"]), ["doc_id"], r"token\s*=\s*(.*)", F.col("line").rlike(r"token\s*="))


@query("documents", sql=f"WITH {LINES} SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM lines WHERE contains(lower(line), 'licen') GROUP BY doc_id")
def first_matching_line(docs: DataFrame) -> DataFrame:
    got = extract.first_line(extract.lines_of(docs, ["doc_id"]), ["doc_id"], F.contains(F.lower("line"), F.lit("licen")))
    return got.withColumn("pos", F.col("pos").cast("long"))


@query("documents", sql="WITH m AS (SELECT doc_id, contains(t, 'licensed')::INT + contains(t, 'released')::INT + contains(t, 'license')::INT AS a, contains(t, 'token')::INT + contains(t, 'http')::INT AS b FROM (SELECT doc_id, lower(text) AS t FROM documents)) SELECT doc_id, CASE WHEN a >= 3 AND a >= b THEN 'parte' WHEN b >= 2 THEN 'lista' WHEN b = 1 AND a >= 1 THEN 'lista' END AS kind FROM m")
def form_classify(docs: DataFrame) -> DataFrame:
    low = F.lower("text")
    a, b = extract.mark_count(low, ["licensed", "released", "license"]), extract.mark_count(low, ["token", "http"])
    return docs.select("doc_id", extract.form_kind(a, b, a >= 1, a >= 1).alias("kind"))


@query("orders", sql="SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%d') AS arrival FROM orders")
def dateline(orders: DataFrame) -> DataFrame:
    """Datelines such as "Santos, 4 de july de", with the year on the line below."""
    text = F.concat(F.lit("Modelo\nSantos, "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), F.date_format("o_orderdate", "MMMM"), F.lit(" de\n"), F.year("o_orderdate").cast("string"))
    months = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
    return extract.dateline(extract.lines_of(orders.select("o_orderkey", text.alias("text")), ["o_orderkey"]), ["o_orderkey"], months)


@query("events", sql="SELECT user_id, arg_min(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'click' THEN event_id END) AS ship, arg_min(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type = 'view' THEN event_id END) AS port, CAST(coalesce(arg_min(CASE WHEN event_id % 3 = 0 THEN event_id END, CASE WHEN event_id % 3 = 0 THEN event_id END), arg_min(event_id, event_id)) AS BIGINT) AS year, CASE WHEN count(CASE WHEN event_id % 3 = 0 THEN 1 END) > 0 THEN 'printed' ELSE 'stamp' END AS year_source FROM events GROUP BY user_id")
def record_merge(events: DataFrame) -> DataFrame:
    """First value per field in order; a printed year goes before a stamped one."""
    rows = events.select(
        "user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("ship"), F.when(F.col("event_type") == "view", F.col("value")).alias("port"),
        F.col("event_id").alias("year"), F.when(F.col("event_id") % 3 == 0, F.lit("printed")).otherwise(F.lit("stamp")).alias("year_source"),
    )
    return extract.merge_records(rows, ["user_id"], ["event_id"], ["ship", "port"], "year", "year_source")


# --- catalogues ---------------------------------------------------------------------------------------------

_URL = r"^https?://([a-z0-9.\-]+)/([a-z]{2})/(\d+)"
_HOST, _LANG, _INDEX = (f"regexp_extract(url, '{_URL}', {i})" for i in (1, 2, 3))


@query("pages", sql=f"SELECT page_id, nullif(upper({_HOST}), '') AS host, nullif(upper({_LANG}), '') AS lang, nullif(upper({_INDEX}), '') AS index FROM pages")
def catalog_parse(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", *catalog.parts_of(F.col("url"), _URL, "host", "lang", "index"))


@query("pages", sql=f"SELECT page_id, 'https://archive.invalid/' || {_LANG} || '/' || CASE WHEN length({_INDEX}) < 6 THEN lpad({_INDEX}, 6, '0') ELSE {_INDEX} END || 'A_d0001de0002.pdf' AS url FROM pages")
def catalog_url(pages: DataFrame) -> DataFrame:
    """Addresses with the digits of an index padded and its letter kept."""
    index = F.concat(F.regexp_extract("url", _URL, 3), F.lit("A"))
    return pages.select("page_id", F.concat(F.lit("https://archive.invalid/"), F.regexp_extract("url", _URL, 2), F.lit("/"), catalog.padded_index(index, F.lit(6)), F.format_string("_d%04dde%04d.pdf", F.lit(1), F.lit(2))).alias("url"))


@query("pages", sql=f"SELECT host, min(page_id) AS page_id FROM (SELECT page_id, {_HOST} AS host FROM pages) GROUP BY host")
def catalog_dedup(pages: DataFrame) -> DataFrame:
    return catalog.first_wins(pages.select("page_id", F.regexp_extract("url", _URL, 1).alias("host")), ["host"], ["page_id"])


@query("documents", sql=rf"""WITH {LINES}, l AS (SELECT *, regexp_matches(line, '^(The|Die|Le|La|De|And|It) ') AS s, trim(line) = '' AS c FROM lines), e AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS entry FROM l), o AS (SELECT *, max((c AND NOT s)::INT) OVER (PARTITION BY doc_id, entry ORDER BY pos) AS closed FROM e) SELECT doc_id, CAST(entry AS BIGINT) AS entry, min(pos) AS first_pos, count(*) AS n_lines, md5(string_agg(trim(line), ' ' ORDER BY pos)) AS text FROM o WHERE entry > 0 AND closed = 0 GROUP BY doc_id, entry""")
def multi_line_entries(docs: DataFrame) -> DataFrame:
    lines = extract.lines_of(docs, ["doc_id"])
    got = catalog.join_wrapped(lines, ["doc_id"], F.col("line").rlike("^(The|Die|Le|La|De|And|It) "), F.trim("line") == "")
    return got.select("doc_id", "entry", F.col("first_pos").cast("long").alias("first_pos"), "n_lines", F.md5("text").alias("text"))


@query("documents", sql="SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("customer", "nation", sql="SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, n_name) AS ship FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def catalog_precedence_join(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """What a record says itself goes before what the catalogue says."""
    rows = customer.select("c_custkey", F.col("c_nationkey").alias("file"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("ship"))
    return catalog.fill_from(rows, nation.select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("ship")), "file", "ship").select("c_custkey", "ship")


@query("documents", sql=r"SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') || ',' || source || ',' || lang || ',' || CASE WHEN regexp_matches(l, '[\",\r\n]') THEN '\"' || replace(l, '\"', '\"\"') || '\"' ELSE l END || ',' AS line FROM (SELECT doc_id, source, lang, text AS l FROM documents)".replace('\\"', '"'))
def export_rows(docs: DataFrame) -> DataFrame:
    """Whole texts as fields of CSV lines."""
    return docs.select("doc_id", tables.csv_line(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text"), F.lit(None)).alias("line"))


@query("documents", sql=r"SELECT doc_id, regexp_replace(source || ' ' || lang || '/' || doc_id, '[^\p{L}\p{N}\-_]', '-', 'g') || '.csv' AS name FROM documents")
def export_hits(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(tables.safe_name(F.concat("source", F.lit(" "), "lang", F.lit("/"), F.col("doc_id").cast("string"))), F.lit(".csv")).alias("name"))


# --- dictionaries ------------------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT upper(w) AS name, count(*) AS seen FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE regexp_matches(w, '^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''\\-]{2,}$') GROUP BY 1 HAVING count(*) >= 2)"


def _dictionary(part: DataFrame) -> DataFrame:
    return lexicon.build(part.select(F.explode(F.split("p_name", " ")).alias("w")), "w", least=2)


def _observed(part: DataFrame) -> DataFrame:
    """Dictionary words with their first letter lost."""
    return _dictionary(part).select(F.expr("substring(name, 2)").alias("observed")).where(F.length("observed") >= 3)


@query("part", sql=f"WITH {_WORDS} SELECT name, seen FROM w")
def dictionary_build(part: DataFrame) -> DataFrame:
    return _dictionary(part)


@query("part", sql=f"WITH {_WORDS}, o AS (SELECT DISTINCT substr(name, 2) AS observed FROM w WHERE length(name) >= 4), s AS (SELECT observed, name, seen, 1 - levenshtein(observed, name) / greatest(length(observed), length(name)) AS score FROM o, w WHERE abs(length(observed) - length(name)) <= 3 AND observed <> name), r AS (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY score DESC, seen DESC, name) AS rank FROM s WHERE score >= 0.62) SELECT observed, name, round(score, 6) AS score, rank FROM r WHERE rank <= 4")
def dictionary_suggest_lev(part: DataFrame) -> DataFrame:
    return lexicon.suggest(_observed(part), _dictionary(part), "levenshtein").select("observed", "name", F.round("score", 6).alias("score"), "rank")


@query("part")
def dictionary_suggest_ro(part: DataFrame) -> DataFrame:
    return lexicon.suggest(_observed(part), _dictionary(part)).select("observed", "name", F.round("score", 6).alias("score"), "rank")


@query("part")
def doubtful(part: DataFrame) -> DataFrame:
    """Part types, of which a dictionary of part names knows few words."""
    return lexicon.doubtful(part, ["p_partkey"], "p_type", _dictionary(part))


@query("part")
def cluster_names(part: DataFrame) -> DataFrame:
    return lexicon.cluster(part.groupBy(t.fold(F.col("p_name"), "lower").alias("name")).agg(F.count(F.lit(1)).alias("seen")))


@query("documents", "labels", sql="SELECT d.doc_id, list_filter([CASE WHEN (quality + 0.5) / 2 < 0.85 THEN 'score' END, CASE WHEN d.doc_id % 2 = 0 THEN 'inferido' END, CASE WHEN toxic = 1 THEN 'desconhecido' END], lambda x: x IS NOT NULL) AS reasons FROM documents d JOIN labels l USING (doc_id)")
def review_reasons(docs: DataFrame, labels: DataFrame) -> DataFrame:
    both = docs.select("doc_id").join(labels, "doc_id")
    source = F.when(F.col("doc_id") % 2 == 0, F.lit("position"))
    return both.select("doc_id", lexicon.review_reasons((F.col("quality") + 0.5) / 2, source, F.col("toxic") == 1).alias("reasons"))


@query("documents")
def heading_filter(docs: DataFrame) -> DataFrame:
    """Lines that are captions and not readings, by the whole rule, over all lines, each judged where it stands."""
    lines = extract.lines_of(docs, ["doc_id"])
    judged = lexical.headings(lines, ["doc_id", "pos"], "line", ("THE", "THE AND ATTION TO", "UND IST"), ("thention", "anea", "tieren", "other"))
    return judged.select("doc_id", F.col("pos").cast("long").alias("pos"), "heading")


@query("benchmark", sql=f"SELECT item_id, round(levenshtein(substr(f, 2), f) / greatest(length(f), 1), 6) AS cer FROM (SELECT item_id, {FOLD.format('text')} AS f FROM benchmark)")
def cer_lev(bench: DataFrame) -> DataFrame:
    folded = bench.select("item_id", t.fold(F.col("text")).alias("f"))
    return folded.select("item_id", F.round(evaluate.lev_error_rate(F.expr("substring(f, 2)"), F.col("f")), 6).alias("cer"))


_TITLE = "'quadro de embarque do vapor ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' (rv ' || p_size || ')' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' - ver br an,rio ol.0.rpv, prj.' || p_partkey ELSE '' END || '. - Dossiê'"


@query("part", sql="SELECT p_partkey, p_name AS ship, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS rv, CASE WHEN p_size % 3 = 0 THEN 'OL.PRJ.' || p_partkey END AS see_also FROM part")
def catalog_titles(part: DataFrame) -> DataFrame:
    """Ship, number and cross-reference out of catalogue titles."""
    got = catalog.title_parts(F.expr(_TITLE))
    see = F.transform(F.array(got["see_also"]), lambda x: F.when(x.isNotNull(), F.concat_ws(".", x["fundo"], x["series"], x["index"])))[0]  # worked out once
    titles = part.repartition(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # few bytes, much work
    return titles.select("p_partkey", got["ship"].alias("ship"), got["rv"].alias("rv"), see.alias("see_also"))


@query("part", sql="SELECT p_partkey, CASE WHEN p_size % 3 <> 2 THEN 'BS.ENT.' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS notation, CASE p_size % 3 WHEN 0 THEN 'cover' WHEN 1 THEN 'filename' ELSE 'unknown' END AS identified_by, CASE WHEN p_size % 3 <> 2 THEN 'BS.ENT.' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE 'sem notação (' || substr(sha256(p_name), 1, 8) || ')' END AS label FROM part")
def document_identity(part: DataFrame) -> DataFrame:
    """A document's notation from its cover, else its file name."""
    number = F.lpad(F.col("p_partkey").cast("string"), 6, F.lit("0"))
    file = F.when(F.col("p_size") % 3 != 2, F.concat(F.lit("br_rjanrio_bs_0_rpv_ent_"), number, F.lit("_d0001de0001.pdf"))).otherwise(F.lit("scan.pdf"))
    cover = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("NOTAÇÃO: BR.AN.RIO.BS.0.RPV.ENT. "), number))
    got = catalog.identify(file, cover, F.sha2("p_name", 256))
    return part.select("p_partkey", got["notation"].alias("notation"), got["identified_by"].alias("identified_by"), got["label"].alias("label"))


@query("part")
def find_fuzzy(part: DataFrame) -> DataFrame:
    """Parts of which a word of the name is like a misspelt one, or like its known variant."""
    return records.find_in_document(part.select("p_partkey", "p_name", "p_type"), "gezr", ["p_name"], 0.3, {"gezr": ["gear"]}).select("p_partkey", "p_name")


@query("orders", sql="SELECT o_orderkey, (k = 1 AND o_orderkey % 2 = 0) OR (k <= 4 AND o_orderkey % 3 = 0) AS wanted, CASE WHEN k = 1 THEN 'cover' ELSE 'list' END AS kind FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS k FROM orders)")
def page_pruning(orders: DataFrame) -> DataFrame:
    page = F.col("o_orderkey") % 7 + 1
    wanted = records.text_wanted(page, F.col("o_orderkey") % 2 != 0, F.col("o_orderkey") % 3 != 0)
    return orders.select("o_orderkey", wanted.alias("wanted"), records.page_kind(page).alias("kind"))


_LISTED = "listed AS (SELECT DISTINCT 'f' || l_suppkey % 300 AS folder, l_linenumber AS part, CAST(1 + l_quantity % 11 AS INTEGER) AS total FROM lineitem WHERE l_partkey % 5 <> 0)"


@query("lineitem", "part", sql=f"""WITH {_LISTED}, e AS (SELECT p_partkey, 'f' || p_partkey % 400 AS folder, CASE WHEN p_size % 2 = 0 THEN 'f' || p_size END AS see_also FROM part),
asked AS (SELECT p_partkey, 0 AS rank, folder FROM e UNION ALL SELECT p_partkey, 1, see_also FROM e WHERE see_also IS NOT NULL),
best AS (SELECT p_partkey, arg_min(folder, (rank, total)) AS folder, arg_min(total, (rank, total)) AS total FROM asked JOIN listed USING (folder) WHERE part = 1 AND total <= 8 GROUP BY p_partkey),
parts AS (SELECT p_partkey, folder, total, CAST(unnest(range(1, total + 1)) AS INTEGER) AS part FROM best)
SELECT p_partkey, folder, total, part, l.part IS NOT NULL AS present FROM parts LEFT JOIN listed l USING (folder, total, part)""")
def resolved_parts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The parts of each record, from files named after suppliers' folders; totals have gaps, and some are over the most there may be."""
    name = F.format_string("f%d_d%04dde%04d.pdf", F.col("l_suppkey") % 300, F.col("l_linenumber"), (1 + F.col("l_quantity") % 11).cast("int"))
    files = lineitem.where("l_partkey % 5 <> 0").select(name.alias("file"))
    folder = lambda c: F.concat(F.lit("f"), c.cast("string"))
    entries = part.select("p_partkey", folder(F.col("p_partkey") % 400).alias("folder"), F.when(F.col("p_size") % 2 == 0, folder(F.col("p_size"))).alias("see_also"))
    return catalog.resolve_parts(entries, ["p_partkey"], catalog.listed_parts(files, "file"))


@folder_query()
def folder_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The table's files by content; hashes are kept, and a second run reads no file."""
    return hashes.by_content(hashes.content_hashes(spark, folder, ".parquet"))
