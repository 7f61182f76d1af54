"""Queries on reports, incremental work, retrieval quality and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewood.functions import text as t
from brinewood.operators import evaluate, extract, layout, records
from brinewood.plans.registry import query

# --- reports ---------------------------------------------------------------------------------------------


@query("documents", "labels", sql="SELECT count(*) AS records, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS rows, count(*) FILTER (trim(text) <> '') AS with_text, count(quality) AS with_label, count(*) FILTER (quality = 0) AS stale FROM documents LEFT JOIN labels USING (doc_id)")
def status_rollup(docs: DataFrame, labels: DataFrame) -> DataFrame:
    both = docs.join(labels, "doc_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size(F.split("text", "\n"))).alias("rows"), F.count_if(F.trim("text") != "").alias("with_text"),
        F.count("quality").alias("with_label"), F.count_if(F.col("quality") == 0).alias("stale"),
    )


@query("events", sql="SELECT event_type, count(*) AS n, count(*) FILTER (value > 0) AS with_value, count(*) FILTER (props IS NOT NULL AND props <> '') AS with_props, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM events GROUP BY event_type")
def field_coverage(events: DataFrame) -> DataFrame:
    has = t.present(F.col("value")).isNotNull() & (F.col("value") > 0)
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has).alias("with_value"), F.count(t.present(F.col("props"))).alias("with_props"), F.round(F.avg(has.cast("double")), 6).alias("share")
    )


@query("orders", sql="SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_histogram(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("documents", sql="WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) SELECT source, doc_id FROM r WHERE k <= 5")
def stratified_sample(docs: DataFrame) -> DataFrame:
    """Five rows per group, by hash: the same on every run."""
    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return docs.select("source", "doc_id", F.row_number().over(w).alias("k")).where("k <= 5").drop("k")


@query("events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- incremental work --------------------------------------------------------------------------------------


@query("orders", sql="SELECT o_custkey, greatest(0, total - done - skipped) AS remaining, CASE WHEN done > 0 THEN CAST(round(greatest(0, total - done - skipped) / (done / 60.0)) AS BIGINT) END AS eta_s FROM (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS skipped FROM orders GROUP BY ALL)")
def batch_progress(orders: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), is_("F").alias("done"), is_("P").alias("skipped"))
    got = records.progress(F.col("total"), F.col("done"), F.col("skipped"), F.lit(60.0))
    return per.select("o_custkey", got["remaining"].cast("long").alias("remaining"), got["eta_s"].alias("eta_s"))


@query("documents", "labels", sql="SELECT doc_id FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def incremental_plan(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return records.incremental(docs.select("doc_id"), labels, "doc_id", F.col("quality") == 1)


@query("documents", "labels", sql="SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN toxic END, CAST(n_chars AS INTEGER), toxic) AS value, CASE WHEN quality = 1 THEN 'human' ELSE 'machine' END AS made_by FROM documents d FULL JOIN labels l USING (doc_id)")
def human_precedence(docs: DataFrame, labels: DataFrame) -> DataFrame:
    old = labels.select("doc_id", F.col("toxic").alias("value"), (F.col("quality") == 1).alias("by_hand"))
    return records.prefer_human(old, docs.select("doc_id", F.col("n_chars").cast("int").alias("value")), "doc_id", "value", "by_hand")


@query("documents", sql="SELECT doc_id, count(*) AS n_rows, count(*) FILTER (trim(l) <> '' AND length(l) % 2 = 0) AS n_read, count(*) FILTER (trim(l) <> '' AND length(l) % 2 = 0) / count(*) < 0.5 AS retry FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def read_ratio_fallback(docs: DataFrame) -> DataFrame:
    """Pages of which fewer than half the rows have a reading (here: a line of even length) are read again."""
    rows = extract.lines_of(docs, ["doc_id"]).withColumn("read", F.when(F.length("line") % 2 == 0, F.col("line")))
    return records.read_ratio(rows, ["doc_id"], "read")


@query("embeddings", sql="SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN 3 END AS n_bands FROM embeddings")
def geometry_attach_gate(vectors: DataFrame) -> DataFrame:
    """A measured geometry is attached unless it has fewer bands than the page has rows."""
    pages = F.array(F.struct(F.lit(1).alias("n"), F.lit("list").alias("kind"), F.struct(F.lit(None).cast("array<array<double>>").alias("rows")).alias("geometry")))
    bands = F.array(*[F.array(F.lit(float(k)), F.lit(k + 0.5)) for k in range(3)])
    got = records.with_geometry(pages, F.lit(1), F.struct(bands.alias("rows")), F.when(F.col("vec_id") % 3 == 0, 4).otherwise(3))
    return vectors.select("vec_id", F.size(got[0]["geometry"]["rows"]).alias("n")).select("vec_id", F.when(F.col("n") > 0, F.col("n")).alias("n_bands"))


# --- retrieval quality ------------------------------------------------------------------------------------------

_RANKED = "h AS (SELECT l_orderkey AS q, l_linenumber AS c, l_quantity AS s FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank, max(CASE WHEN c <> 1 THEN s END) OVER (PARTITION BY q) AS w FROM h), t AS (SELECT q, rank, s - coalesce(w, 0) AS margin FROM r WHERE c = 1)"


def _ranked(lineitem: DataFrame) -> DataFrame:
    """Orders as queries, their lines as candidates by quantity; line 1 is the right one."""
    return evaluate.ranks(lineitem.select(F.col("l_orderkey").alias("q"), F.lit(1).alias("truth"), F.col("l_linenumber").alias("c"), F.col("l_quantity").alias("s")), "q", "truth", "c", "s")


@query("lineitem", sql=f"WITH {_RANKED} SELECT count(*) FILTER (rank <= 2) AS found, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS total, count(*) FILTER (rank <= 2) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS recall, (SELECT list_sort(list(rank))[CAST(floor(count(*) / 2) AS BIGINT) + 1] FROM t) AS median_rank FROM t")
def recall_at_k(lineitem: DataFrame) -> DataFrame:
    """Over all orders of the table, which are counted."""
    total = lineitem.agg(F.countDistinct("l_orderkey")).first()[0]
    return evaluate.recall(_ranked(lineitem), total, 2)


@query("lineitem", sql=f"WITH {_RANKED} SELECT round(avg(margin), 6) AS mean_margin, min(margin) AS least_margin, round(avg((margin < 0.05)::INT), 6) AS near_share FROM t")
def margin_stats(lineitem: DataFrame) -> DataFrame:
    got = evaluate.margins(_ranked(lineitem))
    return got.select(F.round("mean_margin", 6).alias("mean_margin"), "least_margin", F.round("near_share", 6).alias("near_share"))


@query("conversations", sql="WITH s AS (SELECT conv_id, turn, role, shift FROM conversations, unnest(range(0, 4)) AS u(shift)), j AS (SELECT s.conv_id, s.shift, CASE WHEN c.role IS NULL THEN 1.0 ELSE levenshtein(c.role, s.role) / greatest(length(s.role), 1) END AS e FROM s LEFT JOIN (SELECT conv_id, turn + 1 AS turn, role FROM conversations) c ON c.conv_id = s.conv_id AND c.turn = s.turn + s.shift), p AS (SELECT conv_id, shift, round(sum(e), 6) AS cost FROM j GROUP BY ALL) SELECT conv_id, arg_min(shift, (cost, shift)) AS shift, min(cost) AS cost FROM p GROUP BY conv_id")
def align_offset(talks: DataFrame) -> DataFrame:
    """A copy of every conversation shifted by one turn is put back in its place."""
    read = talks.select("conv_id", (F.col("turn") + 1).alias("turn"), "role")
    return evaluate.best_offset(read, talks.select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", 3)


@query("lineitem", sql="WITH y AS (SELECT year(l_shipdate) AS y, l_suppkey, avg(l_discount) AS v FROM lineitem GROUP BY ALL), j AS (SELECT b.v AS b, a.v AS a FROM y b JOIN y a ON a.l_suppkey = b.l_suppkey WHERE b.y = 1994 AND a.y = 1995) SELECT count(*) FILTER (a - b > 0.002) AS improved, count(*) FILTER (a - b < -0.002) AS regressed, count(*) AS compared, round(avg(b), 6) AS mean_before, round(avg(a), 6) AS mean_after FROM j")
def regression_compare(lineitem: DataFrame) -> DataFrame:
    per = lineitem.groupBy(F.year("l_shipdate").alias("y"), "l_suppkey").agg(F.avg("l_discount").alias("v"))
    got = evaluate.compare(per.where("y = 1994"), per.where("y = 1995"), ["l_suppkey"], "v", 0.002)
    return got.withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


# --- layout --------------------------------------------------------------------------------------------------------

_HOURS = "h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL)"


def _hours(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


_ISLANDS = "i AS (SELECT *, sum(CASE WHEN hour - prev > {gap} OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY hour) AS island FROM (SELECT *, lag(hour) OVER (PARTITION BY event_type ORDER BY hour) AS prev FROM h WHERE n > {floor}))"


@query("events", sql=f"WITH {_HOURS}, {_ISLANDS.format(gap=2, floor=2)} SELECT event_type, CAST(island AS BIGINT) AS island, CAST(floor(avg(hour)) AS BIGINT) AS peak, min(hour) AS first, max(hour) AS last, count(*) AS n FROM i GROUP BY event_type, island")
def peaks_islands(events: DataFrame) -> DataFrame:
    return layout.peaks(_hours(events), ["event_type"], "hour", "n", 2, 2)


@query("events", sql=f"WITH {_HOURS}, {_ISLANDS.format(gap=3, floor=1)}, r AS (SELECT event_type, min(hour) AS first, max(hour) AS last, count(*) AS n FROM i GROUP BY event_type, island), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY last - first DESC, first) AS k FROM r) SELECT event_type, first, last, n FROM k WHERE k = 1")
def longest_run(events: DataFrame) -> DataFrame:
    return layout.longest_run(_hours(events).where("n > 1"), ["event_type"], "hour", 3)


@query("events", sql=f"WITH {_HOURS} SELECT event_type, hour, round(avg(n) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM h")
def moving_avg_lines(events: DataFrame) -> DataFrame:
    got = layout.smoothed(_hours(events), ["event_type"], "hour", "n")
    return got.select("event_type", "hour", F.round("smooth", 6).alias("smooth"))


@query("events", sql=f"WITH {_HOURS}, d AS (SELECT * FROM (SELECT event_type, CAST(hour - lag(hour) OVER (PARTITION BY event_type ORDER BY hour) AS DOUBLE) AS d FROM h WHERE n > 4) WHERE d > 1), m AS (SELECT event_type, quantile_cont(d, 0.5) AS m FROM d GROUP BY 1) SELECT event_type, quantile_cont(d, 0.5) AS pitch FROM d JOIN m USING (event_type) WHERE d BETWEEN m * 0.6 AND m * 1.4 GROUP BY 1")
def pitch_median(events: DataFrame) -> DataFrame:
    return layout.pitch(_hours(events).where("n > 4"), ["event_type"], "hour")


_COMB = "o AS (SELECT l_orderkey AS k, l_linenumber * 20 + l_linenumber % 2 AS y FROM lineitem WHERE l_linenumber <> 3)"


@query("lineitem", sql=f"WITH {_COMB}, g AS (SELECT *, CAST(y - lag(y) OVER (PARTITION BY k ORDER BY y) AS DOUBLE) AS gap FROM o), p AS (SELECT k, quantile_cont(gap, 0.5) AS pitch FROM g WHERE gap IS NOT NULL GROUP BY k), s AS (SELECT g.k, y, gap, coalesce(round(gap / pitch), 0) AS steps, pitch FROM g JOIN p USING (k) WHERE pitch > 0), t AS (SELECT *, sum(steps) OVER (PARTITION BY k ORDER BY y) AS tooth, abs(gap / pitch - steps) AS off FROM s), f AS (SELECT k, regr_slope(y, tooth) AS slope, regr_intercept(y, tooth) AS intercept, CAST(max(tooth) + 1 AS BIGINT) AS n_teeth, count(*) AS n_seen, quantile_cont(off, 0.5) AS off, max(steps) AS widest FROM t GROUP BY k) SELECT k, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n_teeth, n_seen FROM f WHERE off <= 0.15 AND widest <= 6 AND n_seen >= n_teeth * 0.5")
def comb_fit(lineitem: DataFrame) -> DataFrame:
    """Lines of an order stand at even distances, and the third is missing."""
    rows = lineitem.where("l_linenumber <> 3").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 20 + F.col("l_linenumber") % 2).alias("y"))
    return layout.comb_fit(rows, ["k"], "y").select("k", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n_teeth", "n_seen")


@query("lineitem", sql="WITH h AS (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS level, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS a, sum(level * n) OVER w AS s, CAST(sum(n) OVER p AS DOUBLE) AS ta, sum(level * n) OVER p AS ts FROM h WINDOW w AS (PARTITION BY l_returnflag ORDER BY level), p AS (PARTITION BY l_returnflag)), v AS (SELECT l_returnflag, level, round(a * (ta - a) * pow(s / a - (ts - s) / (ta - a), 2), 6) AS v FROM c WHERE a > 0 AND ta - a > 0) SELECT l_returnflag, arg_max(level, (v, -level)) AS threshold FROM v GROUP BY l_returnflag")
def otsu_hist(lineitem: DataFrame) -> DataFrame:
    hist = lineitem.groupBy("l_returnflag", F.col("l_quantity").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return layout.otsu(hist, ["l_returnflag"], "level", "n")


_BANDS = "a AS (SELECT l_orderkey AS k, l_linenumber AS id_a, l_quantity AS lo_a, l_quantity + 10 AS hi_a FROM lineitem), b AS (SELECT l_orderkey AS k, l_linenumber AS id_b, l_extendedprice / 1000 AS lo_b, l_extendedprice / 1000 + 8 AS hi_b FROM lineitem)"


@query("lineitem", sql=f"WITH {_BANDS} SELECT k, id_a, id_b, round(least(hi_a, hi_b) - greatest(lo_a, lo_b), 6) AS shared FROM a JOIN b USING (k) WHERE least(hi_a, hi_b) > greatest(lo_a, lo_b) AND least(hi_a, hi_b) - greatest(lo_a, lo_b) >= 0.3 * (hi_b - lo_b)")
def interval_overlap_join(lineitem: DataFrame) -> DataFrame:
    k, n = F.col("l_orderkey").alias("k"), F.col("l_linenumber")
    a = lineitem.select(k, n.alias("id_a"), F.col("l_quantity").alias("lo_a"), (F.col("l_quantity") + 10).alias("hi_a"))
    b = lineitem.select(k, n.alias("id_b"), (F.col("l_extendedprice") / 1000).alias("lo_b"), (F.col("l_extendedprice") / 1000 + 8).alias("hi_b"))
    return layout.overlapping(a, b, ["k"], 0.3, 16.0).select("k", "id_a", "id_b", F.round("shared", 6).alias("shared"))


@query("lineitem", sql="WITH l AS (SELECT l_orderkey AS k, l_linenumber AS label, 0.0 AS x0, 10.0 AS x1, l_linenumber * 10.0 AS y0, l_linenumber * 10.0 + 8 AS y1 FROM lineitem), f AS (SELECT l_orderkey AS k, l_quantity AS x0, l_linenumber * 10.0 + l_quantity / 10 AS y0, l_linenumber * 10.0 + 8 + l_quantity / 10 AS y1, CAST(l_partkey AS VARCHAR) AS text FROM lineitem), j AS (SELECT l.k, l.label, f.x0, f.text FROM l JOIN f ON l.k = f.k AND least(l.y1, f.y1) - greatest(l.y0, f.y0) >= 0.25 * (l.y1 - l.y0) AND f.x0 >= l.x1 - 0.2 * (l.x1 - l.x0)) SELECT k, label, arg_min(text, (x0, text)) AS value FROM j GROUP BY k, label")
def nearest_right(lineitem: DataFrame) -> DataFrame:
    """The nearest box to the right of a label on the same height."""
    k, top = F.col("l_orderkey").alias("k"), F.col("l_linenumber") * F.lit(10.0)
    labels = lineitem.select(k, F.col("l_linenumber").alias("label"), F.lit(0.0).alias("x0"), F.lit(10.0).alias("x1"), top.alias("y0"), (top + 8).alias("y1"))
    down = F.col("l_quantity") / 10
    boxes = lineitem.select(k, F.col("l_quantity").alias("x0"), F.col("l_quantity").alias("x1"), (top + down).alias("y0"), (top + 8 + down).alias("y1"), F.col("l_partkey").cast("string").alias("text"))
    return extract.beside_fragments(labels, boxes, ["k"])


@query("conversations")
def seam_path(talks: DataFrame) -> DataFrame:
    """The path of least ink through a band of five rows made of each turn's whole text, whose letters' codes are the ink."""
    rows = talks.select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), "").alias("letters"))
    rows = rows.withColumn("codes", F.transform("letters", lambda x: (F.ascii(x) % 16).cast("double"))).withColumn("width", F.greatest(F.ceil(F.size("codes") / 5).cast("int"), F.lit(1)))
    row = lambda i: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.coalesce(F.get("codes", i * F.col("width") + j), F.lit(0.0)))
    return rows.withColumn("ink", F.array(*[row(F.lit(i)) for i in range(5)])).select("conv_id", "turn", layout.seam_of("ink").alias("path"))
