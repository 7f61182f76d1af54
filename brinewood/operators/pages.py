"""Tables on scanned pages, measured on their ink: skew, border, column rules, lines of writing, and the comb of rows.

Ink comes as runs, the way bilevel scans are stored: key, y, x0, x1 for the pixels x0 to x1 - 1 of row y; ``sizes`` has key, width,
height. What is measured on a page is a profile (ink per row or column, which runs give without being spread into pixels) or a few numbers
per line or rule, so all is aggregation, windows and equi-joins on the page; only the skew spreads ink into points, of a page
made small, and turns those of a page together.

Cases: rows with a null key take no part; runs that overlap count once after ``merged``, and empty or null ones are dropped by it; a page
without ink, or without what a step looks for, has no row in that step's result, and ``table_grids`` gives it none; ties
are settled by position, as each function says; columns besides those named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewood.operators import profiles
from brinewood.operators.layout import islands, longest_run, overlapping
from brinewood.sources.store import cut

#: Fixed values. Skew: degrees searched to either side and the two steps, in hundredths; pixels of the longer side that are enough.
SEARCH, COARSE, FINE, SKEW_SIDE = 150, 5, 1, 900
#: Border: share of ink from which a row or column is the scanner's surround, pixels left off, and the least share of a side that remains.
SOLID, MARGIN, LEAST_SIDE = 0.85, 4, 0.3
#: Rules: least share of a column, share of the strongest one (a percentile), the second try, rules that make it needless, and their gap.
RULE_SHARE, RULE_OF_BEST, BEST_PERCENT, SECOND_SHARE, SECOND_OF_FIRST, ENOUGH_RULES, RULE_GAP = 0.10, 0.45, 0.998, 0.06, 0.6, 3, 10
#: Half the width of a rule, the gap in it that still is one rule, and the share of rules that vouches for a row.
HALF_RULE, EXTENT_GAP, VOUCHED = 3, 40, 0.75
#: Lines: rows smoothed together, gap and least height of a line, and the percentiles above which ink is writing, plain and keen.
SMOOTH, LINE_GAP, LEAST_LINE, PLAIN, KEEN = 9, 6, 8, 0.70, 0.55
#: Combs: pitches tried and their step, how near a line must be, lines at least, and how many empty rows a list may have in a row.
PITCHES, PITCH_STEP, NEAR, LEAST_LINES, EMPTY_ROWS = (60.0, 200.0), 0.5, 0.18, 4, 3
#: Choice: share of a comb's bands that must be written; what a wider comb must find; what it must be like on its own.
WRITTEN, TIMES_MORE, MORE, ALONE_BANDS, ALONE_SHARE, LEAST_TABLE = 0.5, 1.5, 3, 8, 0.5, 20


def merged(ink: DataFrame, key: list[str], by_page: bool = False) -> DataFrame:
    """key, y, x0, x1: runs that don't overlap or touch; empty ones and those with nulls dropped.

    ``by_page`` brings a page's runs to one task, so that what adds them up by page has little left to shuffle.
    """
    w = Window.partitionBy(*key, "y").orderBy("x0", "x1")
    rows = ink.where(F.col("x1") > F.col("x0")).dropna(subset=[*key, "y"]).select(*key, "y", "x0", "x1")
    rows = rows.repartition(*key) if by_page else rows
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*key, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


# --- skew --------------------------------------------------------------------------------------------------------------


def shrunk(ink: DataFrame, sizes: DataFrame, key: list[str], side: int = SKEW_SIDE) -> DataFrame:
    """key, x, y, width, height: inked cells of pages whose longer side is made about ``side``; a cell is ink if over half of it is."""
    scale = F.greatest(F.lit(1), F.floor(F.greatest("width", "height") / side)).cast("int")
    small = sizes.select(*key, scale.alias("_s"), F.floor(F.col("width") / scale).cast("int").alias("width"), F.floor(F.col("height") / scale).cast("int").alias("height"))
    rows = ink.join(small, key).repartition(*key).withColumn("y", F.floor(F.col("y") / F.col("_s")).cast("int"))  # once for all that follows
    rows = rows.withColumn("x", F.explode(F.sequence(F.floor(F.col("x0") / F.col("_s")).cast("int"), F.floor((F.col("x1") - 1) / F.col("_s")).cast("int"))))
    part = F.least("x1", (F.col("x") + 1) * F.col("_s")) - F.greatest("x0", F.col("x") * F.col("_s"))
    cells = rows.where("x < width and y < height").groupBy(*key, "x", "y", "width", "height", "_s").agg(F.sum(part).alias("_n"))
    return cells.where(F.col("_n") * 2 > F.col("_s") * F.col("_s")).drop("_n", "_s")


def _profile_sharpness(bins: np.ndarray, measure: str) -> int:
    """Sharpness of one axis: the fullest bin, or the squared differences of neighbouring bins, the empty ones at either end too."""
    n = np.bincount(bins - bins.min())
    return int(n.max()) if measure == "peak" else int((np.diff(np.concatenate(([0], n, [0]))) ** 2).sum())


def sharpness(x: np.ndarray, y: np.ndarray, angle: int, measure: str = "peak") -> int:
    """Sharpness of a page's points (from its middle) turned by an angle in hundredths of a degree.

    Points are dealt into rows and columns of the turned page. "peak" adds the fullest row to the fullest column; "contrast" adds up the squared
    differences of neighbouring rows and of neighbouring columns.
    """
    turn = math.radians(angle / 100.0)
    bins = (np.floor(x * math.cos(turn) + y * math.sin(turn) + 0.5), np.floor(y * math.cos(turn) - x * math.sin(turn) + 0.5))
    return sum(_profile_sharpness(b.astype(np.int64), measure) for b in bins)


def skew(ink: DataFrame, sizes: DataFrame, key: list[str], measure: str = "peak", search: int = SEARCH, coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """key, degrees: by how much a page is to be turned, counter-clockwise, for its ink to be sharpest along the axes.

    All angles of a coarse grid, then those of a fine one around the best; of equals the smallest. Angles are whole hundredths. A page's points, which
    are bounded since it was made small, stand in one array, so that no point is written once per angle.
    """
    points = shrunk(ink, sizes, key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*key).schema)

    def of(page: pa.Table) -> pa.Table:
        x, y, width, height = (page.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "width", "height"))
        x, y = x - width // 2, y - height // 2
        best = lambda angles: max((sharpness(x, y, a, measure), -a) for a in angles)[1] * -1
        rough = best(range(-search, search + 1, coarse))
        return page.select(key).slice(0, 1).append_column("degrees", pa.array([best(range(rough - coarse, rough + coarse + 1, fine)) / 100.0]))

    return points.groupBy(*key).applyInArrow(of, f"{schema}, degrees double")


# --- profiles, border, rules ---------------------------------------------------------------------------------------------


def row_profile(ink: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """key, at, n: ink of every row of the page's box (bx0, by0, bx1, by1), empty rows too."""
    n = F.least("x1", "bx1") - F.greatest("x0", "bx0")
    inside = ink.join(boxes, key).where((n > 0) & (F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1")))
    return _dense(inside.groupBy(*key, F.col("y").alias("at")).agg(F.sum(n).alias("n")), boxes, key, "by0", "by1")


def column_profile(ink: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """key, at, n: ink of every column of the page's box: a running sum of where runs begin and end."""
    lo, hi = F.greatest("x0", "bx0"), F.least("x1", "bx1")
    inside = ink.join(boxes, key).where((hi > lo) & (F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1")))
    ends = inside.select(*key, F.explode(F.array(F.struct(lo.alias("at"), F.lit(1).alias("d")), F.struct(hi.alias("at"), F.lit(-1).alias("d")))).alias("_e"))
    steps = ends.groupBy(*key, F.col("_e.at").alias("at")).agg(F.sum("_e.d").alias("n"))
    return _dense(steps, boxes, key, "bx0", "bx1").withColumn("n", F.sum("n").over(Window.partitionBy(*key).orderBy("at")))


def _dense(rows: DataFrame, boxes: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    every = boxes.where(F.col(hi) > F.col(lo)).select(*key, F.explode(F.sequence(F.col(lo), F.col(hi) - 1)).alias("at"))
    return every.join(rows, [*key, "at"], "left").select(*key, "at", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def whole_pages(sizes: DataFrame, key: list[str]) -> DataFrame:
    """key, bx0, by0, bx1, by1: boxes that are the pages."""
    return sizes.select(*key, F.lit(0).alias("bx0"), F.lit(0).alias("by0"), F.col("width").cast("int").alias("bx1"), F.col("height").cast("int").alias("by1"))


def _solid(ink: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """key, axis (0: rows, 1: columns), size, at: solid rows and columns of pages, size being how many the page has of them.

    Ink is read once, for both axes. Only what is solid is written out: bare rows aren't, and between two steps of ink all columns have as much.
    """
    pages_ = sizes.select(*key, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    lo, hi = F.greatest("x0", F.lit(0)), F.least("x1", "width")
    inside = ink.join(pages_, key).where((hi > lo) & (F.col("y") >= 0) & (F.col("y") < F.col("height")))
    said = [(0, F.col("y"), hi - lo), (1, lo, F.lit(1)), (1, hi, F.lit(-1))]
    steps = inside.select(*key, F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), at.cast("int").alias("at"), n.cast("long").alias("n")) for k, at, n in said])).alias("_e"))
    steps = steps.groupBy(*key, F.col("_e.axis").alias("axis"), F.col("_e.at").alias("at")).agg(F.sum("_e.n").alias("n"))
    w = Window.partitionBy(*key, "axis").orderBy("at")
    column = F.col("axis") == 1
    steps = steps.select(*key, "axis", "at", F.when(column, F.sum("n").over(w)).otherwise(F.col("n")).alias("n"), F.when(column, F.lead("at").over(w)).otherwise(F.col("at") + 1).alias("_next"))
    rows = steps.join(pages_, key).where((F.col("n") > 0) & (F.col("n") >= SOLID * F.when(column, F.col("height")).otherwise(F.col("width"))))  # the last step of columns leaves none
    return rows.select(*key, "axis", F.when(column, F.col("width")).otherwise(F.col("height")).alias("size"), F.explode(F.sequence(F.col("at"), F.col("_next") - 1)).alias("at"))


def _surround(solid: DataFrame, key: list[str]) -> DataFrame:
    """key, y0, y1, x0, x1: how many of the solid rows and columns stand without a gap at the start, and how many at the end."""
    up, down = Window.partitionBy(*key, "axis").orderBy("at"), Window.partitionBy(*key, "axis").orderBy(F.desc("at"))
    rows = solid.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down))
    start, end = F.col("at") == F.col("_a") - 1, F.col("size") - F.col("at") == F.col("_b")
    return rows.groupBy(*key).agg(*[F.count_if((F.col("axis") == k) & c).alias(f"{name}{i}") for k, name in ((0, "y"), (1, "x")) for i, c in enumerate((start, end))])


def border(ink: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """key, bx0, by0, bx1, by1: the sheet within the scanner's dark surround; the page itself if too little would remain."""
    found = sizes.select(*key, "width", "height").join(_surround(_solid(ink, sizes, key), key), key, "left").na.fill(0, ["y0", "y1", "x0", "x1"])
    low = lambda c: F.col(c) + MARGIN
    high = lambda size, c: F.col(size) - 1 - F.col(c) - MARGIN
    box = F.struct(low("x0").alias("bx0"), low("y0").alias("by0"), high("width", "x1").alias("bx1"), high("height", "y1").alias("by1"))
    found = found.withColumn("_b", box)
    fine = (F.col("_b.bx1") - F.col("_b.bx0") >= F.col("width") * LEAST_SIDE) & (F.col("_b.by1") - F.col("_b.by0") >= F.col("height") * LEAST_SIDE)
    page = {"bx0": F.lit(0), "by0": F.lit(0), "bx1": F.col("width"), "by1": F.col("height")}
    return found.select(*key, *[F.when(fine, F.col(f"_b.{c}")).otherwise(p).cast("int").alias(c) for c, p in page.items()])


def column_rules(profile: DataFrame, heights: DataFrame, key: list[str]) -> DataFrame:
    """key, rule: centres of the vertical rules, against a threshold that goes by the page's own strongest column.

    ``profile``: columns of a box; ``heights``: key, height of that box. A page with fewer rules than enough is tried again, lower.
    """
    first = F.greatest(F.lit(RULE_SHARE), RULE_OF_BEST * F.percentile("n", F.lit(BEST_PERCENT)) / F.first("height"))
    limits = profile.join(heights, key).groupBy(*key).agg(F.round(first, 9).alias("_t"), F.max("height").alias("_h"))
    rows = profile.join(limits, key).withColumn("_share", F.round(F.col("n") / F.col("_h"), 9))
    centres = lambda t: islands(rows.where(F.col("_share") > t), key, "at", RULE_GAP).groupBy(*key, "island").agg(F.floor(F.avg("at")).cast("int").alias("rule"))
    plain, low = centres(F.col("_t")), centres(F.greatest(F.lit(SECOND_SHARE), F.round(F.col("_t") * SECOND_OF_FIRST, 9)))
    enough = plain.groupBy(*key).count().where(F.col("count") >= ENOUGH_RULES).select(*key)
    return plain.join(enough, key, "left_semi").unionByName(low.join(enough, key, "left_anti")).drop("island")


def rule_extents(ink: DataFrame, rules: DataFrame, key: list[str], half: int = HALF_RULE, gap: int = EXTENT_GAP) -> DataFrame:
    """key, rule, top, bottom: of each rule the run of inked rows, across gaps, that has most rows; the first of equals."""
    runs = islands(_touched(ink, rules, key, half), [*key, "rule"], "y", gap).groupBy(*key, "rule", "island")
    runs = runs.agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy(*key, "rule").agg(F.max_by(F.struct("top", "bottom"), F.struct("n", -F.col("top"))).alias("_e"))
    return best.select(*key, "rule", "_e.top", "_e.bottom")


def _touched(ink: DataFrame, rules: DataFrame, key: list[str], half: int) -> DataFrame:
    """key, rule, y: rows in which a rule's strip has ink. Strips meet runs by bins of x."""
    strips = rules.select(*key, F.col("rule").alias("id_a"), F.greatest(F.col("rule") - half, F.lit(0)).cast("double").alias("lo_a"), (F.col("rule") + half + 1).cast("double").alias("hi_a"))
    runs = ink.select(*key, F.col("y").alias("id_b"), F.col("x0").cast("double").alias("lo_b"), F.col("x1").cast("double").alias("hi_b"))
    return overlapping(strips, runs, key, 0.0, 64.0).select(*key, F.col("id_a").alias("rule"), F.col("id_b").alias("y")).distinct()


# --- lines and combs -----------------------------------------------------------------------------------------------------


def text_lines(profile: DataFrame, key: list[str], percent: float | Column = PLAIN, smooth: int = SMOOTH, gap: int = LINE_GAP, least: int | None = None) -> DataFrame:
    """key, line: centres of the lines of writing in a profile of rows.

    The profile is smoothed (beyond its ends there is nothing); a line is an island above the page's own percentile that is high
    enough not to be a horizontal rule.
    """
    w = Window.partitionBy(*key).orderBy("at").rowsBetween(-(smooth // 2), smooth // 2)
    rows = profile.withColumn("_s", F.sum("n").over(w))
    limit = rows.groupBy(*key).agg(F.round(F.percentile("_s", F.lit(percent)), 6).alias("_t"))
    found = islands(rows.join(limit, key).where(F.col("_s") > F.col("_t")), key, "at", gap)
    found = found.groupBy(*key, "island").agg(F.floor(F.avg("at")).cast("int").alias("line"), F.count(F.lit(1)).alias("_n"))
    return found.where(F.col("_n") >= (max(LEAST_LINE, 2 * smooth) if least is None else least)).select(*key, "line")


def best_pitch(lines: DataFrame, key: list[str], pitches: tuple[float, float] = PITCHES, step: float = PITCH_STEP, near: float = NEAR) -> DataFrame:
    """key, pitch, intercept: the comb that most lines agree with, fitted to those that do.

    Every pitch of a grid is tried from every line. A try counts the lines near one of its teeth, and three times their share of the teeth between
    the outermost; the best has the smallest pitch, then the highest start, of equals. A page's lines are one short array.
    """
    page = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.col("line").cast("double"))).alias("_c")).where(F.size("_c") >= LEAST_LINES)
    n = round((pitches[1] - pitches[0]) / step)
    page = page.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)  # few bytes, much work: not to be coalesced by size
    grid = pitches[0] + np.arange(n) * step

    @F.pandas_udf("_p double, _at double")
    def start(lines: pd.Series) -> pd.DataFrame:
        found = [profiles.comb_start(np.asarray(c), grid, near, LEAST_LINES) or (None, None) for c in lines]
        return pd.DataFrame(found, columns=["_p", "_at"], dtype="float64")

    best = page.select(*key, "_c", start("_c").alias("_t")).where("_t._p is not null")
    kept = best.select(*key, "_t._p", "_t._at", F.explode("_c").alias("_y")).withColumn("_i", F.rint((F.col("_y") - F.col("_at")) / F.col("_p")))
    kept = kept.where(F.abs(F.col("_y") - (F.col("_at") + F.col("_i") * F.col("_p"))) < F.col("_p") * near)
    return kept.groupBy(*key).agg(F.regr_slope("_y", "_i").alias("pitch"), F.regr_intercept("_y", "_i").alias("intercept"))


def occupied(lines: DataFrame, combs: DataFrame, key: list[str], near: float = NEAR, empty: int = EMPTY_ROWS) -> DataFrame:
    """key, first, last: the widest stretch of teeth that lines stand on, with no more than ``empty`` bare ones in a row."""
    i = F.rint((F.col("line") - F.col("intercept")) / F.col("pitch"))
    off = F.abs(F.col("line") - (F.col("intercept") + i * F.col("pitch")))
    teeth = lines.join(combs, key).where(off < F.col("pitch") * near).select(*key, i.cast("int").alias("i")).distinct()
    return longest_run(teeth, key, "i", empty + 1).select(*key, "first", "last")


def band_edges(pitch: Column, intercept: Column, first: Column, last: Column) -> Column:
    """Edges of the bands of rows ``first`` to ``last``: half a pitch to either side of each centre. None if there are no rows."""
    some = F.transform(F.sequence(first, F.greatest(first, last) + 1), lambda i: intercept + i * pitch - pitch / 2)
    return F.when(last >= first, some).otherwise(F.array().cast("array<double>"))


def comb_scores(combs: DataFrame, lines: DataFrame, key: list[str], floor: float | Column = WRITTEN) -> DataFrame:
    """``combs`` (key, edges) with score: how many lines it holds; -1 if too few of its bands are written, it has no band, or the page no line."""
    ends = combs.select(*key, F.get("edges", F.lit(0)).alias("_lo"), F.get("edges", F.size("edges") - 1).alias("_hi"))
    inside = lines.join(ends, key).groupBy(*key).agg(F.count_if((F.col("line") >= F.col("_lo")) & (F.col("line") < F.col("_hi"))).alias("_in"))
    bands = F.size("edges") - 1
    fine = (bands >= 1) & F.col("_in").isNotNull() & (F.col("_in") / bands >= floor)
    return combs.join(inside, key, "left").withColumn("score", F.when(fine, F.col("_in")).otherwise(F.lit(-1)).cast("int")).drop("_in")


def choose_comb(narrow: DataFrame, wider: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """key, edges, pitch, chosen (narrow or wider): which of two combs a page keeps; pages for which neither will do have no row.

    ``narrow`` and ``wider``: key, edges, pitch; ``wider`` also reaches (it touches the extent of the rules). The narrow one stays unless the
    wider holds clearly more lines. Without it, the wider one stays if it reaches, or else if it looks like a table by itself: on the page,
    with enough bands that hold enough of all lines.
    """
    w = comb_scores(wider.where(F.size("edges") > 0), lines, key).select(*key, F.struct("edges", "pitch", "reaches", "score").alias("w"))
    n = comb_scores(narrow, lines, key, 0.0).select(*key, F.struct("edges", "pitch", "score").alias("n"))
    all_lines = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("_lines"))
    both = n.join(w, key, "full").join(all_lines, key, "left")
    more = F.col("w.reaches") & ((F.col("n.score") < 0) | (F.col("w.score") > F.greatest(F.col("n.score") * TIMES_MORE, (F.col("n.score") + MORE).cast("double"))))
    table = (F.get("w.edges", F.lit(0)) >= 0) & (F.size("w.edges") - 1 >= ALONE_BANDS) & (F.col("w.score") >= ALONE_BANDS) & (F.col("w.score") >= ALONE_SHARE * F.col("_lines"))
    says = F.when(F.col("w").isNull(), F.lit("narrow")).when(F.col("n").isNotNull(), F.when(more, F.lit("wider")).otherwise(F.lit("narrow"))).when(F.col("w.reaches") | table, F.lit("wider"))
    both = both.withColumn("chosen", says).where(F.col("chosen").isNotNull())
    pick = lambda c: F.when(F.col("chosen") == "wider", F.col(f"w.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(*key, pick("edges"), pick("pitch"), "chosen")


def rule_support(ink: DataFrame, rules: DataFrame, combs: DataFrame, key: list[str], half: int = HALF_RULE) -> DataFrame:
    """key, band, support: the share of the page's rules that have ink within each band of a comb (key, pitch, intercept, first, last).

    A band goes from pixel to pixel between its edges; a row's band is worked out from the pitch, so rules meet the ink once and bands never do.
    """
    start = F.col("intercept") - F.col("pitch") / 2
    band = F.ceil(F.round((F.col("y") + 1 - start) / F.col("pitch"), 9)).cast("int") - 1
    hits = _touched(ink, rules, key, half).join(combs, key).withColumn("band", band).where("band between first and last")
    hits = hits.groupBy(*key, "band").agg(F.count_distinct("rule").alias("_hit"))
    total = rules.groupBy(*key).agg(F.count_distinct("rule").alias("_all"))
    every = combs.where("last >= first").select(*key, F.explode(F.sequence("first", "last")).alias("band")).join(total, key)
    return every.join(hits, [*key, "band"], "left").select(*key, "band", (F.coalesce("_hit", F.lit(0)) / F.col("_all")).alias("support"))


def ruled_run(support: DataFrame, key: list[str], floor: float = VOUCHED) -> DataFrame:
    """key, first, last: the widest stretch of bands that the rules vouch for, across single weak ones; the first of equals."""
    return longest_run(support.where(F.col("support") > floor), key, "band", 2).select(*key, "first", "last")


def _measured(ink: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """key, by0, columns, top, bottom, keen, plain, above: what ``table_grids`` needs of the ink of each page that has rules enough.

    As ``border``, ``column_rules``, ``rule_extents``, ``row_profile`` and ``text_lines`` give it. No profile is written out row by row.
    """
    pages_ = sizes.select(*key, F.col("width").cast("int").alias("_width"), F.col("height").cast("int").alias("_height"))
    runs = ink.select(*key, F.col("y").cast("int").alias("_y"), F.col("x0").cast("int").alias("_x0"), F.col("x1").cast("int").alias("_x1")).join(pages_, key)
    measured = "by0 int, columns array<int>, top int, bottom int, keen array<int>, plain array<int>, above array<int>"
    named = [f"`{f.name}` {f.dataType.simpleString()}" for f in runs.select(*key).schema]
    types = [pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 3]

    def of(page: pa.Table) -> pa.Table:
        y, x0, x1, width, height = (page.column(c).to_numpy().astype(np.int64) for c in ("_y", "_x0", "_x1", "_width", "_height"))
        found = _measures((y, x0, x1), int(width[0]), int(height[0]))
        out = page.select(key).slice(0, 0 if found is None else 1)
        for field, t, value in zip(measured.split(", "), types, found or [None] * len(types), strict=True):
            out = out.append_column(field.split()[0], pa.array([] if found is None else [value], t))
        return out

    return runs.groupBy(*key).applyInArrow(of, ", ".join([*named, measured]))


def _measures(runs: profiles.Runs, width: int, height: int) -> tuple | None:
    """by0, columns, top, bottom and the lines (keen, plain, above) of a page; None without rules enough."""
    bx0, by0, bx1, by1 = profiles.border(runs, width, height, SOLID, MARGIN, LEAST_SIDE)
    ink = profiles.column_ink(runs, bx0, bx1, by0, by1)
    rules = profiles.column_rules(ink, bx0, by1 - by0, RULE_SHARE, RULE_OF_BEST, BEST_PERCENT, SECOND_SHARE, SECOND_OF_FIRST, ENOUGH_RULES, RULE_GAP)
    ends = [e for e in (profiles.rule_extent(runs, r, HALF_RULE, EXTENT_GAP) for r in rules) if e]
    if len(rules) < 2 or not ends:
        return None
    top, bottom = (math.floor(profiles.percentile(np.array(e), 0.5)) for e in zip(*ends, strict=True))
    if bottom - top < LEAST_TABLE:
        return None

    def lines(start: int, percent: float) -> list[int]:
        return profiles.text_lines(profiles.row_ink(runs, rules[0], rules[-1], start, bottom), start, percent, SMOOTH, LINE_GAP, max(LEAST_LINE, 2 * SMOOTH))

    return by0, rules, top, bottom, lines(by0, KEEN), lines(top, PLAIN), lines(by0, PLAIN) if by0 >= top else []


def table_grids(ink: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """key, columns, top, bottom, edges, pitch, chosen: the table on each page that has one.

    Rules bound the table; a comb is fitted to the lines within, and another, with a keener eye, to all lines above its end; ``choose_comb`` decides.
    ``ink`` should be merged and turned upright before. It is asked for many times over: a page's runs stand together and are measured in arrays, in one go. What
    is measured (rules, lines, combs) is a few rows a page, cut from what it was made of, since several later steps ask for it.
    """
    per = cut(_measured(ink, sizes, key))
    bounds = per.select(*key, "top", "bottom", "by0")
    lines = lambda c: per.select(*key, F.explode(c).alias("line"))
    keen, plain, plain_above = lines("keen"), lines("plain"), lines("above")

    def bounded(combs: DataFrame, low: str) -> DataFrame:
        edges = band_edges(F.col("pitch"), F.col("intercept"), F.col("first"), F.col("last"))
        near = lambda e: (e >= F.col(low) - F.col("pitch")) & (e <= F.col("bottom") + F.col("pitch"))
        return combs.withColumn("edges", F.filter(edges, near))

    def ruled(fit: DataFrame) -> DataFrame:
        row = lambda c: (F.col(c) - F.col("intercept")) / F.col("pitch")
        return fit.join(bounds, key).withColumns({"first": F.ceil(row("top")).cast("int"), "last": F.floor(row("bottom")).cast("int")})

    narrow = cut(bounded(ruled(best_pitch(plain, key)), "top").select(*key, "edges", "pitch"))
    keen_fit = cut(best_pitch(keen.join(bounds.where("by0 < top").select(*key), key), key))
    wide = bounded(keen_fit.join(occupied(keen, keen_fit, key), key).join(bounds, key), "by0")
    wide = wide.unionByName(bounded(ruled(best_pitch(plain_above, key)), "by0"))
    reaches = (F.element_at("edges", -1) >= F.col("top") - F.col("pitch")) & (F.get("edges", F.lit(0)) <= F.col("bottom"))
    wide = cut(wide.where(F.size("edges") > 0).select(*key, "edges", "pitch", reaches.alias("reaches")))
    return per.select(*key, "columns", "top", "bottom").join(choose_comb(narrow, wide, keen, key), key)
