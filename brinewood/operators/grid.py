"""Tables read off what is printed on them: the columns around a heading, printed numbers, written lines, bands of rows.

Boxes are the detector's: key, x0, y0, x1, y1 and text, null where a box wasn't read. ``sizes`` has key, width, height. Boxes
of a page meet each other by equi-joins on the page, with ranges within it; the only Python is the ratio of distinct texts to the
heading's wordings, behind an exact bound by length.

Cases: a page without boxes or heading has no row in ``columns`` (and none in ``tables`` unless an earlier page of its group lends
its columns); null texts are boxes that weren't read; ties go to the box further up, then further left; columns of the tables besides those named
are ignored; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewood.functions.fuzzy import may_reach
from brinewood.functions.lexical import best_ratio
from brinewood.functions.text import fold, squeeze
from brinewood.operators.layout import FOOTING_FROM, FOOTING_WIDTH, group_lines, row_bands
from brinewood.sources.store import cut, release

#: Likeness of a heading, shares of heights and widths that must be shared, and slack in pixels and widths.
HEADING_FLOOR, SAME_LINE, IN_COLUMN, COVERS, SAME_BOX, BESIDE, MARGIN, ORDINAL_REACH = 0.72, 0.3, 0.35, 0.5, 2.0, 2, 0.02, 0.05
#: Characters of a printed number, and how much wider than its column an unread box may be.
NUMBER_CHARS, NUMBER_WIDTH = 3, 1.2
#: Heading rows: cells at least, lines at most, share of the sheet they span, widest cell, and how far down they may be.
CELLS, HEAD_LINES, SPAN, WIDEST_CELL, HEAD_UNTIL = 4, 4, 0.55, 0.22, 0.7

#: Spellings of a heading, and headed pages, up to which they are broadcast.
SPELLINGS = 50_000

BOX = ("x0", "y0", "x1", "y1")


def shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def _at(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def beside(rows: DataFrame) -> DataFrame:
    """A few rows a page, cut, to be joined with boxes: broadcast if they are few, else hashed, so that the boxes aren't sorted (and spilled) to meet them."""
    rows = cut(rows)
    release(rows.sparkSession)  # boxes that were shuffled for it
    return F.broadcast(rows) if rows.count() <= SPELLINGS else rows.hint("shuffle_hash")


def headings(boxes: DataFrame, key: list[str], wordings: tuple[str, ...], floor: float = HEADING_FLOOR) -> DataFrame:
    """key, hx0, hy0, hx1, hy1: the box of each page whose folded text is most like one of ``wordings`` (which are folded), if like enough."""
    rows = boxes.where(F.col("text").isNotNull()).withColumn("_f", squeeze(fold(F.col("text"), "lower")))
    near = F.lit(False)
    for w in wordings:
        near = near | may_reach(F.col("_f"), F.lit(w), floor)
    rows = rows.where((F.col("_f") != "") & near)
    texts = cut(rows.select("_f").distinct())
    known = cut(texts.withColumn("_r", best_ratio(wordings)(F.col("_f"))).where(F.col("_r") >= floor))
    known = F.broadcast(known) if known.count() <= SPELLINGS else known  # few spellings are near: boxes needn't be shuffled by their text
    best = rows.join(known, "_f").groupBy(*key).agg(F.max_by(F.struct(*BOX), F.struct("_r", -F.col("y0"), -F.col("x0"))).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(f"h{c}") for c in BOX])


def columns(boxes: DataFrame, sizes: DataFrame, heads: DataFrame, key: list[str]) -> DataFrame:
    """key, n0, n1 (the headed column), o0, o1 (the column of printed numbers to its left; null if nothing is there), top.

    The column ends where the nearest boxes on the heading's own line begin, read or not; a margin stands in for them.
    """
    page = beside(heads.join(sizes.select(*key, "width"), key))
    same = boxes.select(*key, *BOX).join(page, key)
    itself = F.greatest(*[F.abs(F.col(c) - F.col(f"h{c}")) for c in BOX]) <= SAME_BOX
    same = same.where(~itself & (shared(*_at("y0", "y1", "hy0", "hy1")) >= SAME_LINE * (F.col("hy1") - F.col("hy0"))))
    side = F.when(F.col("x1") <= F.col("hx0") + BESIDE, F.lit("left")).when(F.col("x0") >= F.col("hx1") - BESIDE, F.lit("right"))
    same = same.withColumn("_side", side).where(F.col("_side").isNotNull())
    left, right = F.col("_side") == "left", F.col("_side") == "right"
    ends = same.groupBy(*key).agg(F.max(F.when(left, F.col("x1"))).alias("_left"), F.min(F.when(right, F.col("x0"))).alias("_right"), F.collect_list(F.when(left, F.struct("x0", "x1"))).alias("_all"))
    out = page.join(ends, key, "left")
    near = F.filter("_all", lambda b: b["x1"] >= F.col("_left") - ORDINAL_REACH * F.col("width"))
    out = out.withColumn("o0", F.array_min(F.transform(near, lambda b: b["x0"])))
    margin = MARGIN * F.col("width")
    out = out.select(*key, F.coalesce("_left", F.col("hx0") - margin).alias("n0"), F.coalesce("_right", F.col("hx1") + margin).alias("n1"), "o0", F.col("hy1").alias("top"))
    return out.withColumn("o1", F.when(F.col("o0").isNotNull(), F.col("n0")))


def ordinals(boxes: DataFrame, cols: DataFrame, key: list[str]) -> DataFrame:
    """key, x0, y0, x1, y1, text: the printed numbers below the heading. One misread sign is forgiven; an unread box goes by place and size."""
    rows = boxes.select(*key, *BOX, "text").join(beside(cols.where("o0 is not null")), key).where(F.col("y0") > F.col("top"))
    wide = F.col("x1") - F.col("x0")
    rows = rows.where(shared(*_at("x0", "x1", "o0", "o1")) >= 0.5 * wide)
    signs = F.regexp_replace("text", r"[^\p{L}\p{N}_]", "")
    digits = F.length(F.regexp_replace(signs, r"\P{Nd}", ""))
    number = F.length(signs).between(1, NUMBER_CHARS) & (digits >= F.length(signs) - 1)
    return rows.where(F.when(F.col("text").isNull(), wide <= NUMBER_WIDTH * (F.col("o1") - F.col("o0"))).otherwise(number)).select(*key, *BOX, "text")


def written(boxes: DataFrame, cols: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """key, x0, y0, x1, y1, text: boxes below the heading that lie in the headed column or cover half of it, the sheet's footing aside."""
    rows = boxes.select(*key, *BOX, "text").join(beside(cols.join(sizes.select(*key, "height"), key)), key).where(F.col("y0") > F.col("top"))
    wide, column = F.col("x1") - F.col("x0"), F.col("n1") - F.col("n0")
    footing = (F.col("y0") > FOOTING_FROM * F.col("height")) & (wide > FOOTING_WIDTH * column)
    over = shared(*_at("x0", "x1", "n0", "n1"))
    return rows.where(~footing & ((over >= IN_COLUMN * wide) | (over >= COVERS * column))).select(*key, *BOX, "text")


def longest_rise(numbers: list[int | None]) -> set[int]:
    """Places of a longest strictly rising run of the numbers, in their order; nulls are never in it."""
    ends: list[int] = []
    at: list[int] = []
    before: dict[int, int | None] = {}
    for i, n in enumerate(numbers):
        if n is None:
            continue
        k = bisect_left(ends, n)
        if ends[k : k + 1] == [n]:
            continue  # the first of equals stays
        before[i] = at[k - 1] if k else None
        ends[k : k + 1], at[k : k + 1] = [n], [i]
    out, i = set(), at[-1] if at else None
    while i is not None:
        out.add(i)
        i = before[i]
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _rising(numbers: pd.Series) -> pd.Series:
    runs = [(len(x), longest_rise([None if pd.isna(n) else int(n) for n in x])) for x in numbers]
    return pd.Series([[i in run for i in range(n)] for n, run in runs])


def rising(numbers: DataFrame, key: list[str]) -> DataFrame:
    """``ordinals`` with number (the digits that were read) and in_run: whether it is in a longest rising run down the page.

    Numbers that a misreading put out of order are told from the rest by it. A page's printed numbers are one short array.
    """
    rows = numbers.withColumn("number", F.nullif(F.regexp_replace("text", r"\P{Nd}", ""), F.lit("")).cast("int"))
    page = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1", "text", "number"))).alias("_n"))
    page = page.withColumn("_n", F.arrays_zip("_n", _rising(F.transform("_n", lambda x: x["number"])).alias("_run")))
    return page.select(*key, F.explode("_n").alias("_n")).select(*key, "_n._n.*", F.col("_n._run").alias("in_run"))


def heading_lines(boxes: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no, x0, y0, x1, y1: the boxes worth reading to find a heading: short cells of the topmost lines that have many across the sheet."""
    rows = group_lines(boxes.select(*key, *BOX), key)
    wide = rows.groupBy(*key).agg(F.max("x1").alias("_w"))
    per = rows.groupBy(*key, "line_no").agg(F.count(F.lit(1)).alias("_n"), F.min("y0").alias("_y"), (F.max("x1") - F.min("x0")).alias("_span"), F.max(F.col("x1") - F.col("x0")).alias("_cell"))
    per = per.join(wide, key).join(sizes.select(*key, "height"), key)
    fits = (F.col("_n") >= CELLS) & (F.col("_y") < HEAD_UNTIL * F.col("height")) & (F.col("_span") >= SPAN * F.col("_w")) & (F.col("_cell") <= WIDEST_CELL * F.col("_w"))
    w = Window.partitionBy(*key).orderBy("_y", "line_no")
    top = per.where(fits).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= HEAD_LINES)
    return rows.join(top.select(*key, "line_no"), [*key, "line_no"])


def lent(cols: DataFrame, sizes: DataFrame, key: list[str], group: list[str], page: str) -> DataFrame:
    """``columns`` of every page of ``sizes`` (group, page among its keys): its own, or those of the last page before it in the group, from its top on."""
    w = Window.partitionBy(*group).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.select(*key).join(cols.withColumn("headed", F.lit(True)), key, "left")
    kept = F.last(F.when(F.col("headed"), F.struct("n0", "n1", "o0", "o1")), ignorenulls=True).over(w)
    rows = rows.withColumn("_c", kept).where(F.col("_c").isNotNull())
    return rows.select(*key, "_c.*", F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce("headed", F.lit(False)).alias("headed"))


def tables(boxes: DataFrame, sizes: DataFrame, key: list[str], wordings: tuple[str, ...], floor: float = HEADING_FLOOR, group: list[str] | None = None, page: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """key, n, top, bottom, left, right (of its page's sides, 0 to 1), headed: a band for each ruled row of each page's table.

    With ``group`` and ``page`` a page without a heading goes on with the columns of the pages before it. ``heads``: the headings, if they were asked for before.
    """
    found = columns(boxes, sizes, headings(boxes, key, wordings, floor) if heads is None else heads, key)
    found = cut(lent(cut(found), sizes, key, group, page) if group and page else found.withColumn("headed", F.lit(True)))  # asked for by what follows, several times
    marks = ordinals(boxes, found, key).withColumn("kind", F.lit("ordinal")).unionByName(written(boxes, found, sizes, key).withColumn("kind", F.lit("written")))
    bands = row_bands(marks.join(beside(sizes.select(*key, F.col("height").cast("double").alias("height"))), key), key)
    out = bands.join(beside(found.select(*key, "n0", "n1", "headed").join(sizes.select(*key, "width", "height"), key)), key)
    part = lambda c, of: (F.col(c) / F.col(of))
    return out.select(*key, "n", part("top", "height").alias("top"), part("bottom", "height").alias("bottom"), part("n0", "width").alias("left"), part("n1", "width").alias("right"), "headed")
