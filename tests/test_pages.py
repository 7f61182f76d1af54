"""Page geometry on runs of ink against plain numpy on masks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewood.operators import pages, profiles

KEY = ["page"]


def runs_of(masks):
    """(page, y, x0, x1) of the masks, some runs in two overlapping halves."""
    out = []
    for page, m in masks.items():
        for y, row in enumerate(m):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(int), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                out += [(page, y, a, b)] if (a + y) % 3 else [(page, y, a, (a + b) // 2 + 1), (page, y, (a + b) // 2, b)]
    return out


def sheet(seed, rows=14, pitch=70, dark=0, faint=0.0, top=260):
    """A ruled sheet: letterhead, vertical rules, rows of writing; its mask and where things are."""
    r = np.random.default_rng(seed)
    m = np.zeros((top + rows * pitch + 120, 640), bool)
    cols = [60, 110, 330, 480, 600]
    bottom = top + rows * pitch
    for c in cols:
        m[top:bottom, c - 1 : c + 2] = r.random((bottom - top, 3)) >= faint
    for k in range(rows):
        y = top + k * pitch + pitch // 2
        m[y - 13 : y + 13, 120:320] |= r.random((26, 200)) < 0.6
    m[60:84, 150:500] |= r.random((24, 350)) < 0.5
    if dark:
        m[:dark], m[:, :dark] = True, True
    return m, cols, top, bottom


@pytest.fixture(scope="module")
def made(spark):
    masks = {1: sheet(1)[0], 2: sheet(2, rows=9, pitch=81, dark=14)[0], 3: sheet(3, rows=22, pitch=64, faint=0.2, top=300)[0], 4: np.zeros((300, 200), bool)}
    ink = pages.merged(spark.createDataFrame([*runs_of(masks), (None, 1, 0, 5), (1, 5, 9, 9), (1, 6, None, 3)], "page int, y int, x0 int, x1 int"), KEY).cache()
    sizes = spark.createDataFrame([(k, m.shape[1], m.shape[0]) for k, m in masks.items()], "page int, width int, height int").cache()
    return masks, ink, sizes


def test_merged_runs_are_the_mask(made):
    masks, ink, _ = made
    assert sorted(tuple(r) for r in ink.collect()) == sorted((p, y, a, b) for p, m in masks.items() for y, a, b in [(y, a, b) for _, y, a, b in whole_runs(p, m)])


def whole_runs(page, m):
    for y, row in enumerate(m):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(int), [0]))))
        yield from ((page, y, a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def test_profiles_border_and_rules(made):
    masks, ink, sizes = made
    boxes = pages.whole_pages(sizes, KEY)
    rows, cols = pages.row_profile(ink, boxes, KEY).collect(), pages.column_profile(ink, boxes, KEY).collect()
    for p, m in masks.items():
        assert [r.n for r in sorted((r for r in rows if r.page == p), key=lambda r: r["at"])] == m.sum(axis=1).tolist()
        assert [r.n for r in sorted((r for r in cols if r.page == p), key=lambda r: r["at"])] == m.sum(axis=0).tolist()
    got = {r.page: tuple(r)[1:] for r in pages.border(ink, sizes, KEY).collect()}
    for p, m in masks.items():
        y, x = (np.flatnonzero(m.mean(axis=a) < 0.85) for a in (1, 0))
        assert got[p] == (x[0] + 4, y[0] + 4, x[-1] - 4, y[-1] - 4)
    found = pages.column_rules(pages.column_profile(ink, boxes, KEY), sizes.select("page", "height"), KEY).collect()
    for p, m in masks.items():
        share = np.round(m.sum(axis=0) / m.shape[0], 9)
        limit = max(0.10, 0.45 * np.percentile(share, 99.8))
        want = centres(np.flatnonzero(share > limit), 10)
        want = want if len(want) >= 3 else centres(np.flatnonzero(share > max(0.06, limit * 0.6)), 10)
        assert sorted(r.rule for r in found if r.page == p) == [int(np.mean(g)) for g in want]


def centres(at, gap):
    return [g for g in np.split(at, np.flatnonzero(np.diff(at) > gap) + 1) if g.size]


def lines_of(m, percent=70):
    s = np.convolve(m.sum(axis=1), np.ones(9), mode="same")
    return [int(np.mean(g)) for g in centres(np.flatnonzero(s > np.percentile(s, percent)), 6) if len(g) >= 18]


def comb_of(lines):
    best = None
    for k in range(280):
        pitch = 60 + k * 0.5
        for at in lines:
            teeth = [(round((c - at) / pitch), c) for c in lines if abs(c - (at + round((c - at) / pitch) * pitch)) < pitch * 0.18]
            if len(teeth) >= 4:
                score = len(teeth) + 3 * (len(teeth) / (max(teeth)[0] - min(teeth)[0] + 1))
                if best is None or score > best[0]:
                    best = score, *np.polyfit(*zip(*teeth, strict=True), 1)
    return best and best[1:]


def test_lines_and_pitch(made):
    masks, ink, sizes = made
    found = pages.text_lines(pages.row_profile(ink, pages.whole_pages(sizes, KEY), KEY), KEY).cache()
    by = {p: sorted(r.line for r in found.where(f"page = {p}").collect()) for p in masks}
    assert by == {p: lines_of(m) for p, m in masks.items()} and len(by[1]) >= 14
    combs = pages.best_pitch(found, KEY)
    got = {r.page: (r.pitch, r.intercept) for r in combs.collect()}
    for p in masks:
        want = comb_of(by[p])
        assert (p in got) == (want is not None) and (want is None or np.allclose(got[p], want))
    spans = {r.page: (r["first"], r["last"]) for r in pages.occupied(found, combs, KEY).collect()}
    for p, (pitch, start) in got.items():
        teeth = np.unique([round((c - start) / pitch) for c in by[p] if abs(c - (start + round((c - start) / pitch) * pitch)) < pitch * 0.18])
        runs = centres(teeth, 4)
        best = max(runs, key=lambda g: g[-1] - g[0])
        assert spans[p] == (best[0], best[-1])


def test_extents_support_and_ruled_run(spark, made):
    masks, ink, sizes = made
    rules = pages.column_rules(pages.column_profile(ink, pages.whole_pages(sizes, KEY), KEY), sizes.select("page", "height"), KEY).cache()
    per = {p: sorted(r.rule for r in rules.where(f"page = {p}").collect()) for p in masks}
    strip = lambda m, c: m[:, max(0, c - 3) : c + 4].any(axis=1)
    for r in pages.rule_extents(ink, rules, KEY).collect():
        best = max(centres(np.flatnonzero(strip(masks[r.page], r.rule)), 40), key=len)
        assert (r.top, r.bottom) == (best[0], best[-1])
    combs = spark.createDataFrame([(p, 33.3, 20.0 + p, -1, 40) for p in masks], "page int, pitch double, intercept double, first int, last int")
    support = pages.rule_support(ink, rules, combs, KEY).cache()
    for r in support.collect():
        lo, hi = (math.floor(20.0 + r.page + (r.band + s) * 33.3) for s in (-0.5, 0.5))
        hit = sum(strip(masks[r.page], c)[max(0, lo) : max(0, hi)].any() for c in per[r.page])
        assert math.isclose(r.support, hit / len(per[r.page])), r
    for r in pages.ruled_run(support, KEY).collect():
        ok = np.array(sorted(x.band for x in support.where(f"page = {r.page} and support > 0.75").collect()))
        best = max(centres(ok, 2), key=lambda g: g[-1] - g[0])
        assert (r["first"], r["last"]) == (best[0], best[-1])


def test_choice_of_combs(spark):
    lines = [(p, y) for p in range(1, 9) for y in range(100, 400, 30)]  # ten lines a page
    edges = lambda a, b, n: [a + (b - a) * i / n for i in range(n + 1)]
    narrow = [(1, edges(100, 130, 3)), (2, edges(90, 400, 10)), (3, edges(500, 600, 5)), (7, edges(90, 400, 10)), (9, edges(0, 9, 2))]
    wider = [(1, edges(90, 400, 10), True), (2, edges(90, 400, 10), True), (3, edges(90, 400, 10), False), (4, edges(90, 400, 10), False), (5, edges(90, 130, 2), False), (6, edges(90, 130, 2), True), (7, [], True), (8, edges(-5, 400, 10), False)]
    mk = lambda rows, more: spark.createDataFrame([(p, e, 30.0, *x) for p, e, *x in rows], f"page int, edges array<double>, pitch double{more}")
    got = pages.choose_comb(mk(narrow, ""), mk(wider, ", reaches boolean"), spark.createDataFrame(lines, "page int, line int"), KEY)
    assert {r.page: r.chosen for r in got.collect()} == {1: "wider", 2: "narrow", 3: "narrow", 4: "wider", 6: "wider", 7: "narrow", 9: "narrow"}


@pytest.mark.parametrize("measure", ["peak", "contrast"])
def test_skew_is_found(spark, measure):
    rows = []
    for page, degrees in ((1, 0.0), (2, 0.87), (3, -1.32)):
        slope = math.tan(math.radians(degrees))
        rows += [(page, int(round(y + (x - 300) * slope)), x, x + 1) for y in range(60, 560, 40) for x in range(0, 600)]
    ink = spark.createDataFrame(rows, "page int, y int, x0 int, x1 int")
    sizes = spark.createDataFrame([(p, 600, 620) for p in (1, 2, 3, 4)], "page int, width int, height int")
    got = {r.page: r.degrees for r in pages.skew(ink, sizes, KEY, measure).collect()}
    assert set(got) == {1, 2, 3} and abs(got[1]) <= 0.1 and abs(got[2] - 0.87) <= 0.06 and abs(got[3] + 1.32) <= 0.06
    points = pages.shrunk(ink, sizes, KEY).where("page = 2").collect()
    x, y = (np.array([r[c] for r in points]) for c in ("x", "y"))

    def sharp(hundredths):
        t = math.radians(hundredths / 100)
        total = 0
        for b in (np.floor((x - 300) * math.cos(t) + (y - 310) * math.sin(t) + 0.5), np.floor((y - 310) * math.cos(t) - (x - 300) * math.sin(t) + 0.5)):
            n = np.bincount((b - b.min() + 1).astype(int), minlength=int(b.max() - b.min()) + 3)
            total += n.max() if measure == "peak" else int((np.diff(n) ** 2).sum())
        return total

    rough = max(range(-150, 151, 5), key=lambda a: (sharp(a), -a))
    assert round(got[2] * 100) == max(range(rough - 5, rough + 6), key=lambda a: (sharp(a), -a))


def test_large_pages_are_made_small(spark):
    ink = spark.createDataFrame([(1, y, 0, 2000) for y in (0, 1, 3)], "page int, y int, x0 int, x1 int")
    got = pages.shrunk(ink, spark.createDataFrame([(1, 2000, 10)], "page int, width int, height int"), KEY).collect()
    assert {(r.y, r.x) for r in got} == {(0, x) for x in range(1000)}  # row 3 fills half of its cells, which isn't over half


def test_tables_are_found(made):
    masks, ink, sizes = made
    got = {r.page: r for r in pages.table_grids(ink, sizes, KEY).collect()}
    assert set(got) == {1, 2, 3}
    for page, (rows, pitch, cols, top) in {1: (14, 70, 5, 260), 2: (9, 81, 5, 260), 3: (22, 64, 5, 300)}.items():
        r = got[page]
        assert abs(r.pitch - pitch) < 1 and len([c for c in r["columns"] if c > 50]) == cols and abs(r.top - top) <= 40
        centre = [(a + b) / 2 for a, b in zip(r.edges, r.edges[1:], strict=False)]
        hit = sum(min(abs(c - (top + k * pitch + pitch // 2)) for c in centre) < 10 for k in range(rows))
        assert hit >= rows - 1 and len(centre) <= rows + 2


def test_pages_of_nothing(spark):
    ink, sizes = spark.createDataFrame([], "page int, y int, x0 int, x1 int"), spark.createDataFrame([], "page int, width int, height int")
    assert pages.table_grids(ink, sizes, KEY).collect() == [] and pages.skew(ink, sizes, KEY).collect() == []


@pytest.mark.parametrize("measure", ["peak", "contrast"])
def test_points_are_not_written_once_per_angle(spark, made, measure):
    """All angles of a page are tried where its points are: no row is made for a point and an angle."""
    _, ink, _ = made
    sizes = spark.createDataFrame([(1, 640, 1300), (3, 640, 1700)], "page int, width int, height int")
    plan = pages.skew(ink, sizes, KEY, measure)._jdf.queryExecution().optimizedPlan().toString()
    assert "angle" not in plan and plan.count("explode(sequence(") == 1


def test_sharpness_of_points():
    x, y = np.array([0, 0, 0, 2]), np.array([0, 1, 3, 3])
    assert pages.sharpness(x, y, 0) == 3 + 2
    assert pages.sharpness(x, y, 0, "contrast") == (9 + 9 + 1 + 1) + (1 + 0 + 1 + 4 + 4)


def test_equal_runs_are_one(spark):
    """Of equal runs none is put with the run before, whichever of them comes first."""
    rows = [(1, 1, 10, 20), *[(1, 1, 30, 40)] * 50, *[(1, 1, 60, 70)] * 50]
    got = pages.merged(spark.createDataFrame(rows, "page int, y int, x0 int, x1 int").repartition(4), KEY)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 10, 20), (1, 1, 30, 40), (1, 1, 60, 70)]


def test_border_reads_ink_once_and_writes_no_bare_rows(spark):
    """A page of many rows without ink isn't written out row by row, and the ink stands in the plan once."""
    ink = spark.createDataFrame([(1, y, 0, 100) for y in range(5)] + [(1, 50, 10, 20)] + [(1, y, 97, 100) for y in range(5, 200)], "page int, y int, x0 int, x1 int")
    sizes = spark.createDataFrame([(1, 100, 200), (2, 50, 60), (3, 0, 0)], "page int, width int, height int")
    found = pages.border(ink, sizes, KEY)
    assert sorted(map(tuple, found.collect())) == [(1, 4, 9, 92, 195), (2, 4, 4, 45, 55), (3, 0, 0, 0, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence(") == 1 and "coalesce(n#" not in plan


def test_a_page_is_measured_in_arrays_as_in_rows(made):
    """What ``table_grids`` takes of the ink in one go, no profile being written row by row, is what the operators on rows say."""
    _, ink, sizes = made
    measured = pages._measured(ink, sizes, KEY)
    assert "explode" not in measured._jdf.queryExecution().optimizedPlan().toString()
    got = {r.page: r for r in measured.collect()}
    boxes = pages.border(ink, sizes, KEY).cache()
    assert {p: r.by0 for p, r in got.items()} == {r.page: r.by0 for r in boxes.collect() if r.page in got} and len(got) >= 3
    rules = pages.column_rules(pages.column_profile(ink, boxes, KEY), boxes.selectExpr("page", "by1 - by0 AS height"), KEY).cache()
    ends = {}
    for r in pages.rule_extents(ink, rules, KEY).collect():
        ends.setdefault(r.page, []).append((r.top, r.bottom))
    by_page = lambda rows, c: {p: sorted(r[c] for r in rows if r.page == p) for p in got}
    assert by_page(rules.collect(), "rule") == {p: r["columns"] for p, r in got.items()}
    assert {p: (r.top, r.bottom) for p, r in got.items()} == {p: tuple(int(np.percentile(e, 50)) for e in zip(*ends[p], strict=True)) for p in got}
    for name, start, percent in (("keen", "by0", pages.KEEN), ("plain", "top", pages.PLAIN)):
        span = measured.selectExpr("page", "columns[0] AS bx0", "element_at(columns, -1) AS bx1", f"{start} AS by0", "bottom AS by1")
        assert by_page(pages.text_lines(pages.row_profile(ink, span, KEY), KEY, percent).collect(), "line") == {p: r[name] for p, r in got.items()}


def test_percentiles_and_rounding_are_sparks(spark):
    values = [0, 3, 3, 7, 11, 12, 40, 41]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for share in (0.5, 0.55, 0.7, 0.998):
        assert rows.agg(F.percentile("v", F.lit(share))).first()[0] == profiles.percentile(np.array(values), share)
    for n in (1, 3, 512, 1023):
        assert spark.range(1).select(F.round(F.lit(n) / 1024, 9)).first()[0] == profiles.half_up(n / 1024, 9)
