"""Queries on folding, grams, search and its composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.functions import text as t
from brinewood.operators import extract, records, search
from brinewood.plans.registry import FOLD, LINES, folder_query, query
from brinewood.sources import store

#: What is searched for: words of the invented prose, a group that lines belong to, and a year.
NAME, GROUP, YEAR = "thention reonanst oferhe", "src3", 1924


@query("documents", sql=f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def fold_upper(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(t.fold(F.col("text"))).alias("folded"))


@query("documents", sql=r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}\s]', '', 'g'))) AS folded FROM documents")
def fold_lower_alnum(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(t.fold(F.col("text"), "lower", letters_only=True)).alias("folded"))


_GRAMS = "SELECT DISTINCT {key}, substr(p, i, 3) AS gram FROM (SELECT {key}, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT {key}, '  ' || {fold} || ' ' AS p FROM {src}))"
_PART_GRAMS = f"g AS ({_GRAMS.format(key='name', fold=FOLD.format('name'), src='(SELECT DISTINCT p_name AS name FROM part)')}), n AS (SELECT name, count(*) AS k FROM g GROUP BY name)"


@query("part", sql=f"WITH {_PART_GRAMS} SELECT name, k AS n_grams FROM n")
def trigram_counts(part: DataFrame) -> DataFrame:
    names = part.select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.size(t.trigrams(t.fold(F.col("name")))).cast("long").alias("n_grams"))


@query("part", sql=f"WITH {_PART_GRAMS} SELECT gram, count(*) AS n_rows FROM g GROUP BY gram")
def gram_postings(part: DataFrame) -> DataFrame:
    names = part.select(F.col("p_name").alias("name")).distinct().withColumn("folded", t.fold(F.col("name")))
    return search.grams(names, ["name"], "folded").groupBy("gram").agg(F.count(F.lit(1)).alias("n_rows"))


_PAIRS = "pairs AS (SELECT a.name AS a, b.name AS b, count(*) AS both_ FROM g a JOIN g b USING (gram) WHERE a.name < b.name GROUP BY ALL)"


def _part_pairs(part: DataFrame) -> DataFrame:
    names = part.select(F.col("p_name").alias("name")).distinct().withColumn("folded", t.fold(F.col("name")))
    g = search.grams(names, ["name"], "folded")
    return search.similarity_join(g.withColumnRenamed("name", "a"), g.withColumnRenamed("name", "b"), "a", "b").where("a < b")


@query("part", sql=f"WITH {_PART_GRAMS}, {_PAIRS} SELECT a, b, round(both_ / (x.k + y.k - both_), 6) AS score FROM pairs JOIN n x ON x.name = a JOIN n y ON y.name = b WHERE both_ / (x.k + y.k - both_) >= 0.1")
def trigram_pairs(part: DataFrame) -> DataFrame:
    return _part_pairs(part).select("a", "b", F.round("name_score", 6).alias("score"))


def _lines(docs: DataFrame) -> DataFrame:
    return extract.lines_of(docs.select("doc_id", "source", "text"), ["doc_id", "source"]).withColumn("pos", F.col("pos").cast("long")).withColumn("folded", t.fold(F.col("line")))


KEY = ["doc_id", "pos"]


def index_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The kept index of a folder's documents, by line; its rows carry the group of the line."""
    path = f"{folder}/documents.parquet"
    return store.kept(spark, "gram-blocks", path, lambda: search.postings(_lines(spark.read.parquet(path)), ["doc_id", "pos", "source"]))


def _scored_sql(name: str) -> str:
    q = FOLD.format(f"'{name}'")
    return (
        f"WITH {LINES}, f AS (SELECT doc_id, source, pos, '  ' || {FOLD.format('line')} || ' ' AS p FROM lines), "
        "g AS (SELECT DISTINCT doc_id, pos, substr(p, i, 3) AS gram FROM (SELECT doc_id, pos, p, unnest(range(1, length(p) - 1)) AS i FROM f)), "
        f"q AS (SELECT DISTINCT substr(p, i, 3) AS gram FROM (SELECT p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT '  ' || {q} || ' ' AS p))), "
        "k AS (SELECT doc_id, pos, count(*) AS n, count(q.gram) AS b FROM g LEFT JOIN q USING (gram) GROUP BY ALL), "
        "s AS (SELECT doc_id, pos, b / (n + (SELECT count(*) FROM q) - b) AS s FROM k WHERE b / (n + (SELECT count(*) FROM q) - b) >= 0.1)"
    )


_LINE_GRAMS = f"WITH {LINES}, g AS (SELECT DISTINCT doc_id, pos, substr(p, i, 3) AS gram FROM (SELECT doc_id, pos, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT doc_id, pos, '  ' || {FOLD.format('line')} || ' ' AS p FROM lines)))"


@folder_query(sql=_LINE_GRAMS + " SELECT count(*) AS postings, count(DISTINCT gram) AS grams, count(DISTINCT (doc_id, pos)) AS lines FROM g")
def search_index(spark: SparkSession, folder: str) -> DataFrame:
    """How large the kept index is; builds it if it isn't there."""
    return search.index_size(index_of_lines(spark, folder))


@folder_query(sql=_scored_sql(NAME) + " SELECT doc_id, pos, round(s, 3) AS score FROM s ORDER BY score DESC, doc_id, pos LIMIT 50")
def search_single(spark: SparkSession, folder: str) -> DataFrame:
    return search.best_hits(search.scored_postings(index_of_lines(spark, folder), NAME, KEY), KEY)


@folder_query(sql=_scored_sql(NAME) + f" SELECT doc_id, pos, round(s, 3) AS name_score, round(least(1.0, greatest(0.0, s * (1.0 + CASE WHEN 1900 + doc_id % 30 = {YEAR} THEN 0.6 ELSE -0.15 END))), 3) AS score FROM s")
def search_rerank_year(spark: SparkSession, folder: str) -> DataFrame:
    """All rows above the floor, raised where the year agrees, lowered where it doesn't."""
    hits = search.scored_postings(index_of_lines(spark, folder), NAME, KEY)
    gain = search.bonus((1900 + F.col("doc_id") % 30).cast("int"), F.lit(YEAR), F.lit(None).cast("double"))
    return hits.select("doc_id", "pos", F.round("name_score", 3).alias("name_score"), search.ranked_score(F.col("name_score"), gain).alias("score"))


@folder_query(sql=_scored_sql(NAME) + f" SELECT doc_id, pos, round(least(1.0, s * CASE WHEN source = '{GROUP}' THEN 1.6 ELSE 1.0 END), 3) AS score FROM s JOIN f USING (doc_id, pos)")
def search_rerank_ship(spark: SparkSession, folder: str) -> DataFrame:
    """All rows above the floor, raised where their group is the one that was named."""
    hits = search.scored_postings(index_of_lines(spark, folder), NAME, [*KEY, "source"])
    same = F.when(F.col("source") == GROUP, F.lit(1.0))
    gain = search.bonus(F.lit(None).cast("int"), F.lit(None).cast("int"), same)
    return hits.select("doc_id", "pos", search.ranked_score(F.col("name_score"), gain).alias("score"))


@folder_query(sql=_scored_sql(NAME) + f", named AS (SELECT doc_id, pos, round(s, 3) AS score FROM s), every AS (SELECT doc_id, pos, score, CAST(CASE WHEN score >= 0.5 THEN 1 ELSE 3 END AS BIGINT) AS tier FROM named UNION ALL SELECT doc_id, pos, 1.0, 2 FROM lines WHERE source = '{GROUP}' AND NOT EXISTS (FROM named n WHERE n.doc_id = lines.doc_id AND n.pos = lines.pos)) SELECT doc_id, pos, CAST(score AS DOUBLE) AS score, tier FROM every")
def search_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Strong names, then everyone of the named group, then weak names."""
    index = index_of_lines(spark, folder)
    named = search.best_hits(search.scored_postings(index, NAME, KEY), KEY, None)
    lines = extract.lines_of(spark.read.parquet(f"{folder}/documents.parquet").where(F.col("source") == GROUP), ["doc_id"])
    certain = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(1.0).alias("score"))
    return search.compose(named, certain, KEY, None).withColumn("tier", F.col("tier").cast("long"))


@query("documents", sql=f"WITH {LINES} SELECT doc_id, pos, 1.0::DOUBLE AS score, 'year' AS matched FROM lines WHERE 1900 + doc_id % 30 = {YEAR}")
def search_year_only(docs: DataFrame) -> DataFrame:
    return _lines(docs).where(1900 + F.col("doc_id") % 30 == YEAR).select("doc_id", "pos", F.lit(1.0).alias("score"), F.lit("year").alias("matched"))


@query("documents", sql=f"WITH {LINES} SELECT doc_id, pos, 1.0::DOUBLE AS score, 'ship' AS matched FROM lines WHERE source = '{GROUP}'")
def search_ship_only(docs: DataFrame) -> DataFrame:
    """Groups are compared once each, then their rows joined."""
    lines = _lines(docs)
    groups = lines.select("source").distinct().where(t.fold(F.col("source")) == search.folded_query(GROUP))
    return lines.join(groups, "source").select("doc_id", "pos", F.lit(1.0).alias("score"), F.lit("ship").alias("matched"))


@query("benchmark", "conversations", sql=f"WITH a AS ({_GRAMS.format(key='item_id', fold=FOLD.format('text'), src='benchmark')}), b AS ({_GRAMS.format(key='conv_id, turn', fold=FOLD.format('text'), src='conversations')}), an AS (SELECT item_id, count(*) AS k FROM a GROUP BY ALL), bn AS (SELECT conv_id, turn, count(*) AS k FROM b GROUP BY ALL), p AS (SELECT item_id, conv_id, turn, count(*) AS c FROM a JOIN b USING (gram) GROUP BY ALL) SELECT item_id, conv_id, turn, round(c / (an.k + bn.k - c), 6) AS score FROM p JOIN an USING (item_id) JOIN bn USING (conv_id, turn) WHERE c / (an.k + bn.k - c) >= 0.1")
def search_batch(bench: DataFrame, talks: DataFrame) -> DataFrame:
    """Every item against every turn, at the floor."""
    folded = lambda rows: rows.withColumn("folded", t.fold(F.col("text")))
    hits = search.search_many(folded(bench), "item_id", "folded", folded(talks), ["conv_id", "turn"])
    return hits.select("item_id", "conv_id", "turn", F.round("name_score", 6).alias("score"))


@query("benchmark", sql=r"SELECT item_id, CAST(regexp_extract(q, '\b(1[6-9]\d{2}|20[0-2]\d)\b', 1) AS INTEGER) AS year, trim(regexp_replace(q, '\b(1[6-9]\d{2}|20[0-2]\d)\b', ' ')) AS name FROM (SELECT item_id, (1900 + item_id % 30) || ' ' || text AS q FROM benchmark)")
def split_year(bench: DataFrame) -> DataFrame:
    q = bench.select("item_id", F.concat((1900 + F.col("item_id") % 30).cast("string"), F.lit(" "), "text").alias("q"))
    return q.select("item_id", t.query_year(F.col("q")).alias("year"), t.query_without_year(F.col("q")).alias("name"))


@query("part", sql="SELECT p_partkey, CASE WHEN a[1] IS NOT NULL AND p_size % 2 = 0 THEN array_to_string([p_brand] || a[2:], ' ') END AS second FROM (SELECT p_partkey, p_size, p_brand, string_split(p_name, ' ') AS a FROM part)")
def alt_readings(part: DataFrame) -> DataFrame:
    """A second reading puts a word's first alternative in its place."""
    words = F.split("p_name", " ")
    alts = F.transform(words, lambda w, i: F.when((i == 0) & (F.col("p_size") % 2 == 0), F.array(F.col("p_brand"))).otherwise(F.array(w)))
    return part.select("p_partkey", records.second_reading(words, alts).alias("second"))
