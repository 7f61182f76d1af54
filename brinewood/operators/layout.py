"""One-dimensional layout: islands, peaks, pitch, combs, thresholds, interval joins; and the least-ink seam."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def islands(points: DataFrame, group: list[str], at: str, gap: int) -> DataFrame:
    """``points`` with the number of the island they're in: positions no more than ``gap`` apart are one."""
    w = Window.partitionBy(*group).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return points.withColumn("_new", new).withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def peaks(profile: DataFrame, group: list[str], at: str, value: str, threshold: float, gap: int = 10) -> DataFrame:
    """group, island, peak (truncated mean position), first, last, n of the runs above a threshold."""
    found = islands(profile.where(F.col(value) > threshold), group, at, gap)
    return found.groupBy(*group, "island").agg(F.floor(F.avg(at)).cast("long").alias("peak"), F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))


def longest_run(points: DataFrame, group: list[str], at: str, gap: int = 40) -> DataFrame:
    """group, first, last, n: the widest island, the first of equals."""
    runs = islands(points, group, at, gap).groupBy(*group, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy((F.col("last") - F.col("first")).desc(), "first")
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "island")


def smoothed(profile: DataFrame, group: list[str], at: str, value: str, width: int = 9) -> DataFrame:
    """``profile`` with the centred moving average."""
    w = Window.partitionBy(*group).orderBy(at).rowsBetween(-(width // 2), width // 2)
    return profile.withColumn("smooth", F.avg(value).over(w))


def pitch(centres: DataFrame, group: list[str], at: str) -> DataFrame:
    """group, pitch: the median of gaps over 1 that lie within 0.6 to 1.4 of the median gap."""
    w = Window.partitionBy(*group).orderBy(at)
    gaps = centres.withColumn("d", (F.col(at) - F.lag(at).over(w)).cast("double")).where(F.col("d") > 1).select(*group, "d")
    middle = gaps.groupBy(*group).agg(F.percentile("d", F.lit(0.5)).alias("m"))
    near = gaps.join(middle, group).where(F.col("d").between(F.col("m") * 0.6, F.col("m") * 1.4))
    return near.groupBy(*group).agg(F.percentile("d", F.lit(0.5)).alias("pitch"))


def comb_fit(observed: DataFrame, group: list[str], at: str, worst: float = 0.15, most: int = 6, missing: float = 0.5) -> DataFrame:
    """group, slope, intercept, n_teeth, n_seen: the even comb behind positions of which some are missing.

    Gaps must be near whole multiples of their median; a comb with too many missing teeth is refused (no row).
    """
    w = Window.partitionBy(*group).orderBy(at)
    rows = observed.withColumn("_gap", (F.col(at) - F.lag(at).over(w)).cast("double"))
    middle = rows.where(F.col("_gap").isNotNull()).groupBy(*group).agg(F.percentile("_gap", F.lit(0.5)).alias("_pitch"))
    rows = rows.join(middle.where("_pitch > 0"), group).withColumn("_steps", F.coalesce(F.round(F.col("_gap") / F.col("_pitch")), F.lit(0.0)))
    rows = rows.withColumn("_tooth", F.sum("_steps").over(w)).withColumn("_off", F.abs(F.col("_gap") / F.col("_pitch") - F.col("_steps")))
    x, y = F.col("_tooth"), F.col(at).cast("double")
    fit = rows.groupBy(*group).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.max("_tooth") + 1).cast("long").alias("n_teeth"),
        F.count(F.lit(1)).alias("n_seen"), F.percentile("_off", F.lit(0.5)).alias("off"), F.max("_steps").alias("widest"),
    )
    fine = (F.col("off") <= worst) & (F.col("widest") <= most) & (F.col("n_seen") >= F.col("n_teeth") * (1 - missing))
    return fit.where(fine).drop("off", "widest")


def otsu(histogram: DataFrame, group: list[str], level: str, count: str) -> DataFrame:
    """group, threshold: the level that separates a histogram best (greatest variance between classes), the first of equals."""
    w = Window.partitionBy(*group).orderBy(level)
    whole = Window.partitionBy(*group)
    mass = F.col(level).cast("double") * F.col(count)
    rows = histogram.withColumn("_w", F.sum(count).over(w).cast("double")).withColumn("_s", F.sum(mass).over(w))
    rows = rows.withColumn("_tw", F.sum(count).over(whole).cast("double")).withColumn("_ts", F.sum(mass).over(whole))
    low, high = F.col("_w"), F.col("_tw") - F.col("_w")
    between = low * high * F.pow(F.col("_s") / low - (F.col("_ts") - F.col("_s")) / high, F.lit(2.0))
    rows = rows.where((low > 0) & (high > 0)).withColumn("_v", F.round(between, 6))
    return rows.groupBy(*group).agg(F.max_by(level, F.struct("_v", -F.col(level))).alias("threshold"))


def overlapping(a: DataFrame, b: DataFrame, key: list[str], least: float, bin_width: float) -> DataFrame:
    """Pairs of intervals (id_a, lo_a, hi_a) and (id_b, lo_b, hi_b) of one key that share at least ``least`` of b's length.

    Intervals go to all bins they touch, so that the join is an equi-join on key and bin; a pair counts in the bin where
    its shared part begins.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bin_width), F.floor(F.col(hi) / bin_width)))
    both = a.withColumn("bin", bins("lo_a", "hi_a")).join(b.withColumn("bin", bins("lo_b", "hi_b")), [*key, "bin"])
    lo, hi = F.greatest("lo_a", "lo_b"), F.least("hi_a", "hi_b")
    both = both.withColumn("shared", hi - lo).where((F.floor(lo / bin_width) == F.col("bin")) & (hi > lo))
    return both.where(F.col("shared") >= F.lit(least) * (F.col("hi_b") - F.col("lo_b"))).drop("bin")


def group_lines(boxes: DataFrame, key: list[str], overlap: float = 0.5) -> DataFrame:
    """Boxes (x0, y0, x1, y1) with the number of the line they're in: a box joins the first line whose last box it overlaps.

    Depends on order, so each page's boxes are read one after the other: pages stand whole and sorted in a task, which goes from one to the next.
    Of a page only the last box of each line is held. A null place is as good as none (NaN): such a box is a line of its own, after all others.
    """
    at = {c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("y0", "x0")}
    rows = boxes.repartition(*key).sortWithinPartitions(*key, at["y0"], at["x0"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))
        page, last = None, []
        for batch in batches:
            number = []
            place = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist() for c in ("y0", "y1"))  # nulls are NaN
            for own, a, b in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), *place, strict=True):
                if page is None or (own != page and not same(own, page)):
                    page, last = own, []
                i = next((i for i, (c, d) in enumerate(last) if min(b, d) - max(a, c) >= overlap * min(b - a, d - c)), len(last))
                last[i : i + 1] = [(a, b)]
                number.append(i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], [*batch.schema.names, "line_no"])

    return rows.mapInArrow(of, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in boxes.schema)}, line_no long")


def seam(ink: np.ndarray, drift: float = 0.05) -> np.ndarray:
    """The path of least ink from left to right through a band: one row a column, steps of one, drifting from the middle costs."""
    rows, cols = ink.shape
    cost = ink.astype(float) + drift * np.abs(np.arange(rows) - (rows - 1) / 2)[:, None]
    total, back = cost[:, 0].copy(), np.zeros((rows, cols), np.int8)
    for x in range(1, cols):
        padded = np.concatenate(([np.inf], total, [np.inf]))
        choice = np.stack([padded[1:-1], padded[:-2], padded[2:]])  # straight on goes first in ties
        step = choice.argmin(axis=0)
        back[:, x] = np.array([0, -1, 1], np.int8)[step]
        total = choice[step, np.arange(rows)] + cost[:, x]
    path = np.zeros(cols, np.int64)
    path[-1] = int(total.argmin())
    for x in range(cols - 1, 0, -1):
        path[x - 1] = path[x] + back[path[x], x]
    return path


@F.pandas_udf(T.ArrayType(T.LongType()))
def seam_of(ink: pd.Series) -> pd.Series:
    """``seam`` of bands given as arrays of rows."""
    return ink.map(lambda a: seam(np.stack([np.asarray(r, float) for r in a])).tolist() if a is not None and len(a) else None)


#: Printed numbers from which on these carry the rows, their share of written lines, and where a sheet's footing begins and how wide it is.
LEAST_ORDINALS, ORDINAL_SHARE, FOOTING_FROM, FOOTING_WIDTH = 8, 0.5, 0.88, 2.5


def _medians(page: np.ndarray, value: np.ndarray, pages: int) -> np.ndarray:
    """Per page (0 to pages - 1) the exact median of its values, NaN where it has none."""
    value, n = value[np.lexsort((value, page))], np.bincount(page, minlength=pages)
    begin, out = np.cumsum(n) - n, np.full(pages, np.nan)
    some = n > 0
    low, high = value[(begin + (n - 1) // 2)[some]], value[(begin + n // 2)[some]]
    out[some] = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return out


def _pitches(page: np.ndarray, centre: np.ndarray, pages: int) -> np.ndarray:
    """``pitch`` of pages in arrays, NaN where there is none."""
    order = np.lexsort((centre, page))
    page, centre = page[order], centre[order]
    gap, at = np.diff(centre), page[1:]
    wide = (page[1:] == page[:-1]) & (gap > 1)
    gap, at = gap[wide], at[wide]
    middle = _medians(at, gap, pages)[at]
    near = (gap >= middle * 0.6) & (gap <= middle * 1.4)
    return _medians(at[near], gap[near], pages)


ORDINAL, WRITTEN = 1, 2


def page_bands(begin: np.ndarray, kind: np.ndarray, y0: np.ndarray, y1: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, n, top, bottom) of all bands of some whole pages, whose marks stand together from ``begin`` on; nulls are NaN."""
    pages = len(begin)
    page = np.repeat(np.arange(pages), np.diff(np.append(begin, len(kind))))
    c = (y0 + y1) / 2
    placed = ~np.isnan(c)
    n_ordinal, n_written = (np.bincount(page[kind == k], minlength=pages) for k in (ORDINAL, WRITTEN))
    use = np.where(n_ordinal >= np.maximum(LEAST_ORDINALS, n_written * ORDINAL_SHARE), ORDINAL, WRITTEN)
    step = np.full(pages, np.nan)
    for chosen in (kind == use[page], kind == ORDINAL, kind == WRITTEN):  # the first of these that has a pitch
        chosen &= placed & np.isnan(step)[page]
        step = np.where(np.isnan(step), _pitches(page[chosen], c[chosen], pages), step)
    use = np.where((use == WRITTEN) & (n_written == 0), ORDINAL, use)
    used = (kind == use[page]) & placed & ~np.isnan(step)[page]
    base = np.fmin.reduceat(np.where(used, c, np.nan), begin)
    off, p = (c - base[page])[used], step[page[used]]
    base = base + _medians(page[used], off - np.rint(off / p) * p, pages)
    first, last = (np.rint((f.reduceat(c, begin) - base) / step) for f in (np.fmin, np.fmax))
    bands = np.where(np.isnan(first), 0, last - first + 1).astype(np.int64)
    first, at = np.where(np.isnan(first), 0, first).astype(np.int64), np.cumsum(bands) - bands
    of = np.repeat(np.arange(pages), bands)
    n = np.arange(of.size) - at[of]
    middle = base[of] + (first[of] + n) * step[of]
    top, bottom = middle - step[of] / 2, middle + step[of] / 2
    low, high = top.copy(), bottom.copy()
    held = np.flatnonzero((kind == WRITTEN) & placed & (bands > 0)[page])
    near = np.rint((c[held] - base[page[held]]) / step[page[held]]).astype(np.int64) - first[page[held]]
    for d in (-1, 0, 1):  # what stands where two bands meet is in both
        i, k = held[(near + d >= 0) & (near + d < bands[page[held]])], (near + d)[(near + d >= 0) & (near + d < bands[page[held]])]
        k = k + at[page[i]]
        inside = (top[k] <= c[i]) & (c[i] <= bottom[k])
        i, k = i[inside], k[inside]
        np.minimum.at(low, k, y0[i] - 1)
        np.maximum.at(high, k, y1[i] + 1)
    return of, n + 1, np.maximum(0.0, low), np.fmin(np.fmax.reduceat(height, begin)[of], high)


def row_bands(marks: DataFrame, key: list[str], height: str = "height") -> DataFrame:
    """key, n, top, bottom: one band per ruled row, from marks (kind: ordinal or written; y0, y1) below the heading.

    Printed numbers carry the rows if there are enough of them, else what is written does. Their pitch is the distance of rows, the median of
    what each is off by is the phase, and rows go from the first mark of either kind to the last. A band grows to hold what is
    written in it.

    A page's marks stand together in a task, which reads whole pages in turn and measures those of a batch at once. Rows with a null key take no part;
    a null place is as good as none (NaN), and counts only as a mark of its kind.
    """
    kind = F.when(F.col("kind") == "ordinal", ORDINAL).when(F.col("kind") == "written", WRITTEN).otherwise(0).cast("tinyint")
    rows = marks.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in key]))
    rows = rows.select(*key, kind.alias("_kind"), *[F.col(c).cast("double").alias(n) for c, n in (("y0", "_y0"), ("y1", "_y1"), (height, "_height"))])
    rows = rows.repartition(*key).sortWithinPartitions(*key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, page in whole_groups(batches, key):
            values = [page.column(c).to_numpy() for c in ("_kind", "_y0", "_y1", "_height")]  # nulls are NaN
            at, n, top, bottom = page_bands(begin, *values)
            own = page.select(key).take(pa.array(begin[at]))
            out = own.append_column("n", pa.array(n, pa.int32())).append_column("top", pa.array(top)).append_column("bottom", pa.array(bottom, from_pandas=True))
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(of, f"{schema}, n int, top double, bottom double")


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by ``key`` (plain values, not null), in tables of whole groups, each with where its groups begin."""

    def begins(columns: list[pa.ChunkedArray]) -> np.ndarray:
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns:
            a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
            other = pc.not_equal(a, b)
            if pa.types.is_floating(c.type):
                other = pc.and_(other, pc.invert(pc.and_(pc.is_nan(a), pc.is_nan(b))))
            new[1:] |= other.to_numpy()
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        edge = pa.Table.from_batches([*before, batch])
        last = int(begins([edge.column(c) for c in key])[-1]) - len(before)
        if last >= 0:  # a group begins in this batch, so those before it are whole
            whole = pa.Table.from_batches([*held, batch.slice(0, last)])
            if whole.num_rows:
                yield begins([whole.column(c) for c in key]), whole
            held = []
        held.append(batch.slice(max(0, last)))
    if held:
        whole = pa.Table.from_batches(held)
        yield begins([whole.column(c) for c in key]), whole


def carried_columns(pages: DataFrame, group: list[str], page: str, columns: str) -> DataFrame:
    """``pages`` whose columns are those of the last page of the group, up to themselves, that printed its headings."""
    w = Window.partitionBy(*group).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(columns, F.last(columns, ignorenulls=True).over(w))
