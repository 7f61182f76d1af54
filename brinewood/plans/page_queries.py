"""Queries on scanned pages. Their ink is made of the tables: a page per supplier, on which its order lines are written.

A line item is a run of ink on one of twelve lines of its supplier's page, 60 pixels apart; a page has four ruled columns, which are broken here and
there, and every third one a dark surround at the top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewood.operators import extract, grid, pages, strips
from brinewood.plans.registry import LINES, query
from brinewood.sources.store import cut

PAGE = ["page"]
WIDTH, HEIGHT = 560, 900
#: Rules' places on a page, and for each the period and the width of its breaks.
RULES = ((30, 97, 9), (200, 61, 30), (330, 83, 50), (500, 400, 60))

_SIZES = f"sizes AS (SELECT s_suppkey AS page, {WIDTH} AS width, {HEIGHT} AS height FROM supplier)"
_WRITING = "writing AS (SELECT l_suppkey AS page, CAST(100 + 60 * (l_partkey % 12) + (5 * l_linenumber + CAST(l_quantity AS BIGINT)) % 26 AS INTEGER) AS y, CAST(40 + CAST(floor(l_extendedprice) AS BIGINT) % 400 AS INTEGER) AS x0, CAST(60 + CAST(floor(l_extendedprice) AS BIGINT) % 400 + CAST(l_quantity AS BIGINT) AS INTEGER) AS x1 FROM lineitem)"
_RULED = "ruled AS (SELECT s_suppkey AS page, CAST(y AS INTEGER) AS y, x AS x0, x + 3 AS x1 FROM supplier, range(80, 840) AS r(y), (VALUES {}) AS v(x, every, gap) WHERE (y + s_suppkey * 7) % every >= gap)".format(", ".join(map(str, RULES)))
_DARK = f"dark AS (SELECT s_suppkey AS page, CAST(y AS INTEGER) AS y, 0 AS x0, {WIDTH} AS x1 FROM supplier, range(0, 12) AS r(y) WHERE s_suppkey % 3 = 0 AND y < 3 + s_suppkey % 9)"
_RUNS = f"{_SIZES}, {_WRITING}, {_RULED}, {_DARK}, raw AS (FROM writing UNION ALL FROM ruled UNION ALL FROM dark), marked AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM raw), runs AS (SELECT page, y, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(fresh) OVER (PARTITION BY page, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY page, y, run)"


def _sizes(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def _ink(lineitem: DataFrame, supplier: DataFrame, by_page: bool = False) -> DataFrame:
    price, quantity = F.floor("l_extendedprice") % 400, F.col("l_quantity").cast("long")
    y = 100 + 60 * (F.col("l_partkey") % 12) + (5 * F.col("l_linenumber") + quantity) % 26
    writing = lineitem.select(F.col("l_suppkey").alias("page"), y.cast("int").alias("y"), (40 + price).cast("int").alias("x0"), (60 + price + quantity).cast("int").alias("x1"))
    rules = F.explode(F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(every).alias("every"), F.lit(gap).alias("gap")) for x, every, gap in RULES]))
    rows = supplier.select(F.col("s_suppkey").alias("page"), rules.alias("r")).select("page", "r.*", F.explode(F.sequence(F.lit(80), F.lit(839))).alias("y"))
    ruled = rows.where((F.col("y") + F.col("page") * 7) % F.col("every") >= F.col("gap")).select("page", "y", "x0", (F.col("x0") + 3).alias("x1"))
    dark = supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("y"), F.lit(0).alias("x0"), F.lit(WIDTH).alias("x1")).where("y < 3 + page % 9")
    return pages.merged(writing.unionByName(ruled).unionByName(dark), PAGE, by_page)


@query("lineitem", "supplier", sql=f"WITH {_RUNS} SELECT page, y, x0, x1 FROM runs")
def page_runs_merged(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return _ink(lineitem, supplier)


# --- skew --------------------------------------------------------------------------------------------------------------

_POINTS = f"points AS (SELECT DISTINCT l_suppkey AS page, CAST(x - {WIDTH // 2} AS BIGINT) AS x, CAST(100 + 60 * (l_partkey % 12) + floor(x * (l_suppkey % 7 - 3) / 150) - {HEIGHT // 2} AS BIGINT) AS y FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 500 AS x FROM lineitem))"
_TURNED = "SELECT page, angle, axis, CAST(floor(CASE WHEN axis = 0 THEN x * cos(radians(angle / 100.0)) + y * sin(radians(angle / 100.0)) + 0.5 ELSE y * cos(radians(angle / 100.0)) - x * sin(radians(angle / 100.0)) + 0.5 END) AS BIGINT) AS bin, count(*) AS n FROM points {}, range(0, 2) AS a(axis) GROUP BY ALL"
_PEAK = "SELECT page, angle, CAST(sum(n) AS BIGINT) AS sharpness FROM (SELECT page, angle, axis, max(n) AS n FROM {} GROUP BY ALL) GROUP BY ALL"
_CONTRAST = "SELECT page, angle, CAST(sum(d) AS BIGINT) AS sharpness FROM (SELECT page, angle, pow(n - CASE WHEN bin - lag(bin) OVER w = 1 THEN lag(n) OVER w ELSE 0 END, 2) + CASE WHEN lead(bin) OVER w - bin = 1 THEN 0 ELSE n * n END AS d FROM {} WINDOW w AS (PARTITION BY page, angle, axis ORDER BY bin)) GROUP BY ALL"
_SKEW = f"""WITH {_POINTS}, c AS ({_TURNED.format(", range(-150, 151, 5) AS g(angle)")}), cs AS ({{score}}), rough AS (SELECT page, arg_max(angle, (sharpness, -angle)) AS best FROM cs GROUP BY page),
f AS ({_TURNED.format("JOIN rough USING (page), range(-5, 6) AS g(step), LATERAL (SELECT best + step AS angle)")}), fs AS ({{fine}}) SELECT page, arg_max(angle, (sharpness, -angle)) / 100.0 AS degrees FROM fs GROUP BY page"""


def _points(lineitem: DataFrame) -> DataFrame:
    """Dots on lines that rise or fall by the page's own slope, as runs of one pixel."""
    x = F.floor("l_extendedprice") % 500
    y = 100 + 60 * (F.col("l_partkey") % 12) + F.floor(x * (F.col("l_suppkey") % 7 - 3) / 150)
    return lineitem.select(F.col("l_suppkey").alias("page"), y.cast("int").alias("y"), x.cast("int").alias("x0"), (x + 1).cast("int").alias("x1")).distinct()


@query("lineitem", "supplier", sql=_SKEW.format(score=_PEAK.format("c"), fine=_PEAK.format("f")))
def page_skew(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return pages.skew(_points(lineitem), _sizes(supplier), PAGE)


@query("lineitem", "supplier", sql=_SKEW.format(score=_CONTRAST.format("c"), fine=_CONTRAST.format("f")))
def page_skew_contrast(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return pages.skew(_points(lineitem), _sizes(supplier), PAGE, "contrast")


# --- border, rules, lines ------------------------------------------------------------------------------------------------

_ROWS = f"rows AS (SELECT s.page, r.spot, coalesce(n, 0) AS n FROM sizes s, range(0, {HEIGHT}) AS r(spot) LEFT JOIN (SELECT page, y, sum(x1 - x0) AS n FROM runs GROUP BY ALL) i ON i.page = s.page AND i.y = r.spot)"
_COLS = f"cols AS (SELECT s.page, r.spot, coalesce(n, 0) AS n FROM sizes s, range(0, {WIDTH}) AS r(spot) LEFT JOIN (SELECT page, x, count(*) AS n FROM (SELECT page, unnest(range(x0, x1)) AS x FROM runs) GROUP BY ALL) i ON i.page = s.page AND i.x = r.spot)"
_BORDER = f"""border AS (SELECT page, first_y + 4 AS by0, last_y - 4 AS by1, first_x + 4 AS bx0, last_x - 4 AS bx1 FROM
  (SELECT page, min(spot) AS first_y, max(spot) AS last_y FROM rows WHERE n < 0.85 * {WIDTH} GROUP BY page) JOIN (SELECT page, min(spot) AS first_x, max(spot) AS last_x FROM cols WHERE n < 0.85 * {HEIGHT} GROUP BY page) USING (page))"""


@query("lineitem", "supplier", sql=f"WITH {_RUNS}, {_ROWS}, {_COLS}, {_BORDER} SELECT page, CAST(bx0 AS INTEGER) AS bx0, CAST(by0 AS INTEGER) AS by0, CAST(bx1 AS INTEGER) AS bx1, CAST(by1 AS INTEGER) AS by1 FROM border")
def page_border(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return pages.border(_ink(lineitem, supplier, True), _sizes(supplier), PAGE)


_LIMIT = f"lim AS (SELECT page, round(greatest(0.10, 0.45 * quantile_cont(n, 0.998) / {HEIGHT}), 9) AS t FROM cols GROUP BY page), share AS (SELECT page, spot, round(n / {HEIGHT}, 9) AS s, t FROM cols JOIN lim USING (page))"
_CENTRES = "SELECT page, CAST(floor(avg(spot)) AS INTEGER) AS rule FROM (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY spot) AS island FROM (SELECT *, CASE WHEN spot - lag(spot) OVER (PARTITION BY page ORDER BY spot) <= 10 THEN 0 ELSE 1 END AS fresh FROM share WHERE s > {})) GROUP BY page, island"
_COLUMN_RULES = f"{_COLS}, {_LIMIT}, plain AS ({_CENTRES.format('t')}), low AS ({_CENTRES.format('greatest(0.06, round(t * 0.6, 9))')}), enough AS (SELECT page FROM plain GROUP BY page HAVING count(*) >= 3), rules AS (SELECT * FROM plain WHERE page IN (FROM enough) UNION ALL SELECT * FROM low WHERE page NOT IN (FROM enough))"


def _rules(ink: DataFrame, supplier: DataFrame) -> DataFrame:
    sizes = _sizes(supplier)
    return pages.column_rules(pages.column_profile(ink, pages.whole_pages(sizes, PAGE), PAGE), sizes.select("page", "height"), PAGE)


@query("lineitem", "supplier", sql=f"WITH {_RUNS}, {_COLUMN_RULES} SELECT page, rule FROM rules")
def page_column_rules(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return _rules(_ink(lineitem, supplier), supplier)


_TOUCHED = "touched AS (SELECT DISTINCT r.page, rule, y FROM rules r JOIN runs i ON i.page = r.page AND i.x0 < rule + 4 AND i.x1 > greatest(rule - 3, 0))"
_EXTENTS = f"{_TOUCHED}, stretch AS (SELECT page, rule, min(y) AS top, max(y) AS bottom, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY page, rule ORDER BY y) AS island FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page, rule ORDER BY y) <= 40 THEN 0 ELSE 1 END AS fresh FROM touched)) GROUP BY page, rule, island)"


@query("lineitem", "supplier", sql=f"WITH {_RUNS}, {_COLUMN_RULES}, {_EXTENTS} SELECT page, rule, arg_max(top, (n, -top)) AS top, arg_max(bottom, (n, -top)) AS bottom FROM stretch GROUP BY page, rule")
def page_rule_extents(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    ink = _ink(lineitem, supplier)
    return pages.rule_extents(ink, _rules(ink, supplier), PAGE)


_LINES = f"""smooth AS (SELECT page, spot, sum(n) OVER (PARTITION BY page ORDER BY spot ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM rows), cut AS (SELECT page, round(quantile_cont(s, 0.70), 6) AS t FROM smooth GROUP BY page),
text_lines AS (SELECT page, CAST(floor(avg(spot)) AS INTEGER) AS line FROM (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY spot) AS island FROM (SELECT page, spot, CASE WHEN spot - lag(spot) OVER (PARTITION BY page ORDER BY spot) <= 6 THEN 0 ELSE 1 END AS fresh FROM smooth JOIN cut USING (page) WHERE s > t)) GROUP BY page, island HAVING count(*) >= 18)"""


def _lines(ink: DataFrame, supplier: DataFrame) -> DataFrame:
    return pages.text_lines(pages.row_profile(ink, pages.whole_pages(_sizes(supplier), PAGE), PAGE), PAGE)


@query("lineitem", "supplier", sql=f"WITH {_RUNS}, {_ROWS}, {_LINES} FROM text_lines")
def page_text_lines(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return _lines(_ink(lineitem, supplier), supplier)


# --- combs -----------------------------------------------------------------------------------------------------------------

# Every pitch from every line; counted, judged, fitted.
_PITCH = """tries AS (SELECT a.page, 60 + 0.5 * p AS pitch, a.line AS spot, count(*) AS n, max(round_even((c.line - a.line) / (60 + 0.5 * p), 0)) - min(round_even((c.line - a.line) / (60 + 0.5 * p), 0)) + 1 AS span
  FROM text_lines a JOIN text_lines c USING (page), range(0, 280) AS g(p) WHERE abs(c.line - (a.line + round_even((c.line - a.line) / (60 + 0.5 * p), 0) * (60 + 0.5 * p))) < (60 + 0.5 * p) * 0.18 GROUP BY ALL HAVING count(*) >= 4),
best AS (SELECT page, arg_max(pitch, (score, -pitch, -spot)) AS pitch, arg_max(spot, (score, -pitch, -spot)) AS spot FROM (SELECT *, n + 3 * (n / span) AS score FROM tries) GROUP BY page),
kept AS (SELECT page, CAST(line AS DOUBLE) AS y, round_even((line - spot) / pitch, 0) AS i FROM text_lines JOIN best USING (page) WHERE abs(line - (spot + round_even((line - spot) / pitch, 0) * pitch)) < pitch * 0.18),
combs AS (SELECT page, regr_slope(y, i) AS pitch, regr_intercept(y, i) AS intercept FROM kept GROUP BY page)"""


@query("lineitem", "supplier", sql=f"WITH {_RUNS}, {_ROWS}, {_LINES}, {_PITCH} SELECT page, round(pitch, 6) AS pitch, round(intercept, 6) AS intercept FROM combs")
def page_best_pitch(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    got = pages.best_pitch(_lines(_ink(lineitem, supplier), supplier), PAGE)
    return got.select("page", F.round("pitch", 6).alias("pitch"), F.round("intercept", 6).alias("intercept"))


_TEETH = "teeth AS (SELECT DISTINCT page, CAST(round_even((line - intercept) / pitch, 0) AS INTEGER) AS i FROM text_lines JOIN combs USING (page) WHERE abs(line - (intercept + round_even((line - intercept) / pitch, 0) * pitch)) < pitch * 0.18), spans AS (SELECT page, min(i) AS first, max(i) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY page ORDER BY i) <= 4 THEN 0 ELSE 1 END AS fresh FROM teeth)) GROUP BY page, run)"


@query("lineitem", "supplier", sql=f"WITH {_RUNS}, {_ROWS}, {_LINES}, {_PITCH}, {_TEETH} SELECT page, arg_max(first, (last - first, -first)) AS first, arg_max(last, (last - first, -first)) AS last FROM spans GROUP BY page")
def page_occupied_rows(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    lines = _lines(_ink(lineitem, supplier), supplier)
    return pages.occupied(lines, pages.best_pitch(lines, PAGE), PAGE)


_SUPPORT = """ruled_bands AS (SELECT page, 80 - 1.5 * (page % 5) AS intercept, 55 + page % 9 AS pitch, CAST(-2 AS INTEGER) AS first, CAST(15 AS INTEGER) AS last FROM sizes),
hit AS (SELECT page, CAST(ceil(round((y + 1 - (intercept - pitch / 2)) / pitch, 9)) AS INTEGER) - 1 AS band, count(DISTINCT rule) AS n FROM touched JOIN ruled_bands USING (page) GROUP BY ALL),
total AS (SELECT page, count(*) AS n FROM rules GROUP BY page), support AS (SELECT b.page, CAST(r.band AS INTEGER) AS band, coalesce(hit.n, 0) / total.n AS support FROM ruled_bands b JOIN total USING (page), range(-2, 16) AS r(band) LEFT JOIN hit ON hit.page = b.page AND hit.band = r.band)"""


def _support(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    ink = _ink(lineitem, supplier)
    combs = supplier.select(F.col("s_suppkey").alias("page"), (80 - F.lit(1.5) * (F.col("s_suppkey") % 5)).alias("intercept"), (55 + F.col("s_suppkey") % 9).alias("pitch"), F.lit(-2).alias("first"), F.lit(15).alias("last"))
    return pages.rule_support(ink, _rules(ink, supplier), combs, PAGE)


@query("lineitem", "supplier", sql=f"WITH {_RUNS}, {_COLUMN_RULES}, {_TOUCHED}, {_SUPPORT} SELECT page, band, round(support, 6) AS support FROM support")
def page_rule_support(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return _support(lineitem, supplier).select("page", "band", F.round("support", 6).alias("support"))


@query("lineitem", "supplier", sql=f"WITH {_RUNS}, {_COLUMN_RULES}, {_TOUCHED}, {_SUPPORT}, runs_of AS (SELECT page, min(band) AS first, max(band) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY band) AS run FROM (SELECT *, CASE WHEN band - lag(band) OVER (PARTITION BY page ORDER BY band) <= 2 THEN 0 ELSE 1 END AS fresh FROM support WHERE support > 0.75)) GROUP BY page, run) SELECT page, arg_max(first, (last - first, -first)) AS first, arg_max(last, (last - first, -first)) AS last FROM runs_of GROUP BY page")
def page_ruled_run(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return pages.ruled_run(_support(lineitem, supplier), PAGE)


# An order's lines of writing stand at its quantities; one comb goes by its customer and may be missing, another by its first item's price.
_CHOICE = """ln AS (SELECT DISTINCT l_orderkey AS page, CAST(l_quantity AS INTEGER) * 20 AS line FROM lineitem),
combs2 AS (SELECT o_orderkey AS page, CAST(o_custkey % 7 AS INTEGER) AS nb, CAST(o_custkey % 500 AS DOUBLE) AS n0, CAST(10 + o_orderkey % 23 AS DOUBLE) AS np, CAST(o_orderkey % 31 AS INTEGER) AS wb, CAST(o_totalprice % 300 - 30 AS DOUBLE) AS w0, CAST(15 + o_custkey % 40 AS DOUBLE) AS wp, o_orderkey % 3 = 0 AS reaches FROM orders),
scored AS (SELECT page, nb, np, wb, wp, reaches, count(line) AS lines, count(*) FILTER (line >= n0 AND line < n0 + nb * np) AS nin, count(*) FILTER (line >= w0 AND line < w0 + wb * wp) AS win, any_value(w0) AS w0, any_value(n0) AS n0 FROM combs2 LEFT JOIN ln USING (page) GROUP BY ALL),
judged AS (SELECT *, nb > 1 AS has_n, wb > 0 AS has_w, CASE WHEN lines > 0 THEN nin ELSE -1 END AS ns, CASE WHEN lines > 0 AND win / wb >= 0.5 THEN win ELSE -1 END AS ws FROM scored),
says AS (SELECT *, CASE WHEN NOT has_w THEN CASE WHEN has_n THEN 'narrow' END WHEN has_n THEN CASE WHEN reaches AND (ns < 0 OR ws > greatest(ns * 1.5, ns + 3)) THEN 'wider' ELSE 'narrow' END WHEN reaches OR (w0 >= 0 AND wb >= 8 AND ws >= 8 AND ws >= 0.5 * lines) THEN 'wider' END AS chosen FROM judged)"""


def _edges(start: Column, width: Column, bands: Column) -> Column:
    some = F.transform(F.sequence(F.lit(0), F.greatest(bands, F.lit(1))), lambda i: start + i * width)
    return F.when(bands > 0, some).otherwise(F.array().cast("array<double>"))


@query("orders", "lineitem", sql=f"WITH {_CHOICE} SELECT page, chosen, CAST(CASE WHEN chosen = 'wider' THEN wb ELSE nb END AS INTEGER) AS bands, CASE WHEN chosen = 'wider' THEN wp ELSE np END AS pitch FROM says WHERE chosen IS NOT NULL")
def page_comb_choice(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    lines = lineitem.select(F.col("l_orderkey").alias("page"), (F.col("l_quantity").cast("int") * 20).alias("line")).distinct()
    d = lambda c: c.cast("double")
    n = orders.select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 7).cast("int").alias("bands"), d(F.col("o_custkey") % 500).alias("start"), d(10 + F.col("o_orderkey") % 23).alias("pitch"))
    w = orders.select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 31).cast("int").alias("bands"), (F.col("o_totalprice") % 300 - 30).alias("start"), d(15 + F.col("o_custkey") % 40).alias("pitch"), (F.col("o_orderkey") % 3 == 0).alias("reaches"))
    combs = [x.withColumn("edges", _edges(F.col("start"), F.col("pitch"), F.col("bands"))).drop("start", "bands") for x in (n.where("bands > 1"), w)]
    got = pages.choose_comb(*combs, lines, PAGE)
    return got.select("page", "chosen", (F.size("edges") - 1).alias("bands"), "pitch")


@query("lineitem", "supplier")
def page_tables(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Border, rules, extents, lines and combs together."""
    return pages.table_grids(_ink(lineitem, supplier, True), _sizes(supplier), PAGE)


# --- tables from boxes -----------------------------------------------------------------------------------------------------

# A document is a page whose words are the detector's boxes; words of some lengths weren't read. Short words that all texts of a language have are the heading.
WORDINGS = ("the", "der", "les", "que")
_BOXES = f"""{LINES}, cells AS (SELECT page, pos, i - 1 AS i, parts[i] AS word, length(parts[i]) AS n FROM (SELECT doc_id AS page, pos, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, pos, list_filter(string_split(line, ' '), lambda x: x <> '') AS parts FROM lines))),
boxes AS (SELECT page, CASE WHEN n % 5 <> 0 THEN word END AS text, CAST(i * 100 + n * 7 % 60 AS DOUBLE) AS x0, CAST(pos * 30 + i * 7 % 5 AS DOUBLE) AS y0, CAST(i * 100 + n * 7 % 60 + 8 * n AS DOUBLE) AS x1, CAST(pos * 30 + i * 7 % 5 + 22 AS DOUBLE) AS y1 FROM cells),
sheets AS (SELECT doc_id AS page, 1200.0 AS width, CAST(30 * count(*) AS DOUBLE) AS height FROM lines GROUP BY doc_id)"""
_HEADED = f"""{_BOXES}, heads AS (SELECT page, b.x0 AS hx0, b.y0 AS hy0, b.x1 AS hx1, b.y1 AS hy1 FROM (SELECT page, arg_min({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}, (y0, x0)) AS b FROM boxes WHERE trim(regexp_replace(trim(lower(strip_accents(text))), '\\s+', ' ', 'g')) IN {WORDINGS} GROUP BY page)),
same AS (SELECT b.*, h.* EXCLUDE (page), CASE WHEN x1 <= hx0 + 2 THEN 'left' WHEN x0 >= hx1 - 2 THEN 'right' END AS side FROM boxes b JOIN heads h USING (page) WHERE NOT (abs(x0 - hx0) <= 2 AND abs(y0 - hy0) <= 2 AND abs(x1 - hx1) <= 2 AND abs(y1 - hy1) <= 2) AND least(y1, hy1) - greatest(y0, hy0) >= 0.3 * (hy1 - hy0)),
ends AS (SELECT page, max(x1) FILTER (side = 'left') AS l, min(x0) FILTER (side = 'right') AS r FROM same GROUP BY page), near AS (SELECT page, min(x0) AS o0 FROM same JOIN ends USING (page) WHERE side = 'left' AND x1 >= l - 0.05 * 1200 GROUP BY page),
cols AS (SELECT page, coalesce(l, hx0 - 24) AS n0, coalesce(r, hx1 + 24) AS n1, o0, CASE WHEN o0 IS NOT NULL THEN coalesce(l, hx0 - 24) END AS o1, hy1 AS top FROM heads LEFT JOIN ends USING (page) LEFT JOIN near USING (page))"""
_SHARED = "greatest(0, least(x1, {1}) - greatest(x0, {0}))"


def _lines_of(docs: DataFrame) -> DataFrame:
    return extract.lines_of(docs.select(F.col("doc_id").alias("page"), "text"), PAGE)


def _boxes(docs: DataFrame) -> DataFrame:
    cells = _lines_of(docs).select("page", "pos", F.posexplode(F.filter(F.split("line", " "), lambda x: x != "")).alias("i", "word")).withColumn("n", F.length("word"))
    x, y = F.col("i") * 100 + F.col("n") * 7 % 60, F.col("pos") * 30 + F.col("i") * 7 % 5
    place = {"x0": x, "y0": y, "x1": x + 8 * F.col("n"), "y1": y + 22}
    return cells.select("page", F.when(F.col("n") % 5 != 0, F.col("word")).alias("text"), *[c.cast("double").alias(k) for k, c in place.items()])


def _sheets(docs: DataFrame, floor: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, sizes and headings. Where headings are too many to broadcast, texts are shuffled by page before boxes, many times as large, are made of them."""
    sizes = cut(_lines_of(docs).groupBy("page").agg(F.lit(1200.0).alias("width"), (30 * F.count(F.lit(1))).cast("double").alias("height")))
    heads = cut(grid.headings(_boxes(docs), PAGE, WORDINGS, floor))
    few = heads.count() <= grid.SPELLINGS
    return _boxes(docs if few else docs.select("doc_id", "text").repartition("doc_id")), sizes, heads


@query("documents", sql=f"WITH {_HEADED} SELECT page, n0, n1, o0, o1, top FROM cols")
def sheet_columns(docs: DataFrame) -> DataFrame:
    """The column below the first heading that is written exactly."""
    return grid.columns(*_sheets(docs), PAGE).select("page", "n0", "n1", "o0", "o1", "top")


@query("documents", sql=rf"WITH {_HEADED}, signs AS (SELECT b.*, n0, o0, o1, regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '', 'g') AS s FROM boxes b JOIN cols USING (page) WHERE o0 IS NOT NULL AND y0 > top AND {_SHARED.format('o0', 'o1')} >= 0.5 * (x1 - x0)) SELECT page, x0, y0, x1, y1, text FROM signs WHERE CASE WHEN text IS NULL THEN x1 - x0 <= 1.2 * (o1 - o0) ELSE length(s) BETWEEN 1 AND 3 AND length(regexp_replace(s, '\P{{Nd}}', '', 'g')) >= length(s) - 1 END")
def sheet_ordinals(docs: DataFrame) -> DataFrame:
    boxes, sizes, heads = _sheets(docs)
    return grid.ordinals(boxes, grid.columns(boxes, sizes, heads, PAGE), PAGE)


@query("documents", sql=f"WITH {_HEADED} SELECT page, x0, y0, x1, y1, text FROM boxes JOIN cols USING (page) JOIN sheets USING (page) WHERE y0 > top AND NOT (y0 > 0.88 * height AND x1 - x0 > 2.5 * (n1 - n0)) AND ({_SHARED.format('n0', 'n1')} >= 0.35 * (x1 - x0) OR {_SHARED.format('n0', 'n1')} >= 0.5 * (n1 - n0))")
def sheet_written_lines(docs: DataFrame) -> DataFrame:
    boxes, sizes, heads = _sheets(docs)
    return grid.written(boxes, grid.columns(boxes, sizes, heads, PAGE), sizes, PAGE)


@query("documents")
def sheet_tables(docs: DataFrame) -> DataFrame:
    """Bands of rows below headings that are written nearly right."""
    boxes, sizes, heads = _sheets(docs, 0.8)
    return grid.tables(boxes, sizes, PAGE, WORDINGS, 0.8, heads=heads)


@query("conversations")
def strip_rows(talks: DataFrame) -> DataFrame:
    """Rows cut out of a strip per turn: its text's bytes are pixels, forty to a line, and its lines go in bands of six."""
    size = F.octet_length("text")
    rows = talks.where(size > 0).select("conv_id", "turn", F.encode("text", "UTF-8").alias("grey"), F.lit(40).alias("width"), F.greatest(F.floor(size / 240).cast("int"), F.lit(1)).alias("n"))
    edges = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array(i * 6, i * 6 + 6))
    cut = strips.carved(rows.withColumn("edges", edges), ["conv_id", "turn"])
    return cut.select("conv_id", "turn", "n", "top", "height", F.sha2("image", 256).alias("image"))
