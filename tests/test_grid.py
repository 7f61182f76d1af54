"""Tables from boxes, and rows cut out of strips, against plain Python."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewood.operators import grid, strips

KEY = ["page"]
BOXES = "page int, text string, x0 double, y0 double, x1 double, y1 double"
SIZES = "page int, width double, height double"
WORDINGS = ("nomes e cognomes", "nome e cognome")


def sheet(page, heading="Nomes e Cognomes", rows=12, left=True):
    """A heading row at 100, a number and a name on rows 40 apart from 160 on, and a footing."""
    out = [(page, heading, 200.0, 100.0, 420.0, 120.0), (page, "Idade", 460.0, 102.0, 520.0, 121.0), (page, "Classe", 560.0, 99.0, 640.0, 119.0)]
    if left:
        out += [(page, "N", 90.0, 101.0, 120.0, 119.0), (page, None, 130.0, 101.0, 160.0, 119.0)]
    for k in range(rows):
        y = 160.0 + 40 * k
        out += [(page, str(k + 1) if k != 3 else "4l", 100.0, y, 140.0, y + 20), (page, f"Name {k}", 210.0 + k, y - 4, 400.0, y + 24)]
    return out + [(page, "(1) footing of the sheet", 60.0, 960.0, 900.0, 985.0)]


def test_columns_around_a_heading(spark):
    rows = [*sheet(1), *sheet(2, heading="Nome$ e Cognomcs", left=False), *sheet(3, heading="Observacoes"), (4, None, 0.0, 0.0, 1.0, 1.0)]
    boxes, sizes = spark.createDataFrame(rows, BOXES), spark.createDataFrame([(p, 1000.0, 1000.0) for p in (1, 2, 3, 4, 5)], SIZES)
    got = {r.page: r for r in grid.columns(boxes, sizes, grid.headings(boxes, KEY, WORDINGS), KEY).collect()}
    assert set(got) == {1, 2}
    assert (got[1].n0, got[1].n1, got[1].o0, got[1].o1, got[1].top) == (160.0, 460.0, 90.0, 160.0, 120.0)
    assert (got[2].n0, got[2].n1, got[2].o0, got[2].o1) == (180.0, 460.0, None, None)


def test_tables_go_on_over_pages(spark):
    rows = [*sheet(1), *[b for b in sheet(2, heading="x") if b[3] > 130], *sheet(4)]
    boxes = spark.createDataFrame([("a", *r) for r in rows] + [("b", *r) for r in sheet(2, heading="x")], f"doc string, {BOXES}")
    sizes = spark.createDataFrame([(d, p, 1000.0, 1000.0) for d in "ab" for p in (1, 2, 3, 4)], f"doc string, {SIZES}")
    got = grid.tables(boxes, sizes, ["doc", "page"], WORDINGS, group=["doc"], page="page").collect()
    assert {(r.doc, r.page, r.headed) for r in got} == {("a", 1, True), ("a", 2, False), ("a", 4, True)}
    for p in (1, 2, 4):
        bands = sorted((r for r in got if r.page == p), key=lambda r: r.n)
        assert len(bands) == 12 and [round((b.top + b.bottom) / 2, 2) for b in bands] == [round(0.17 + 0.04 * k, 2) for k in range(12)]
        assert all((b.left, b.right) == (0.16, 0.46) for b in bands)
    assert grid.tables(boxes.where("page = 2"), sizes, ["doc", "page"], WORDINGS).count() == 0


def test_numbers_that_rise(spark):
    boxes, sizes = spark.createDataFrame(sheet(1), BOXES), spark.createDataFrame([(1, 1000.0, 1000.0)], SIZES)
    cols = grid.columns(boxes, sizes, grid.headings(boxes, KEY, WORDINGS), KEY)
    numbers = grid.ordinals(boxes, cols, KEY)
    assert sorted(r.text for r in numbers.collect()) == sorted(["4l", *(str(k) for k in range(1, 13) if k != 4)])
    assert len(grid.written(boxes, cols, sizes, KEY).collect()) == 12
    odd = spark.createDataFrame([(1, t, 0.0, float(y), 1.0, y + 1.0) for y, t in enumerate(["1", "2", "13", "4", "x", None, "5", "5"])], BOXES)
    got = sorted(grid.rising(odd, KEY).collect(), key=lambda r: r.y0)
    assert [r.number for r in got] == [1, 2, 13, 4, None, None, 5, 5] and [r.in_run for r in got] == [True, True, False, True, False, False, True, False]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 12)), max_size=9))
def test_longest_rise_is_longest(numbers):
    found = sorted(grid.longest_rise(numbers))
    rises = lambda c: all(numbers[i] is not None for i in c) and all(numbers[a] < numbers[b] for a, b in itertools.pairwise(c))
    best = max(n for n in range(len(numbers) + 1) for c in itertools.combinations(range(len(numbers)), n) if rises(c))
    assert rises(found) and len(found) == best


def test_heading_lines(spark):
    def line(y, cells, wide=60.0):
        return [(1, "x", 100.0 + i * 200, float(y), 100.0 + i * 200 + wide, y + 15.0) for i in range(cells)]

    rows = [*line(20, 2), *line(60, 4, 260.0), *line(100, 4), *line(140, 5), *line(180, 4), *line(220, 4), *line(260, 4), *line(900, 4), (1, "wide", 0.0, 500.0, 1000.0, 515.0)]
    got = grid.heading_lines(spark.createDataFrame(rows, BOXES), spark.createDataFrame([(1, 1000.0, 1000.0)], SIZES), KEY)
    assert sorted({r.y0 for r in got.collect()}) == [100.0, 140.0, 180.0, 220.0]


def brute_seam(ink, at, margin, above):
    """The cheapest of all paths by looking at every one."""
    h, w = ink.shape
    lo, hi = max(0, at - margin), min(h, at + margin + 1)
    if above is not None:
        hi = max(hi, min(h, int(above.max()) + 1))
    best = None
    for path in itertools.product(range(lo, hi), repeat=w):
        if any(abs(a - b) > 1 for a, b in itertools.pairwise(path)) or above is not None and any(p < a for p, a in zip(path, above, strict=True)):
            continue
        cost = sum(ink[y, x] + 0.05 * abs(y - at) for x, y in enumerate(path))
        best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6))
def test_seams_are_cheapest_and_never_cross(seed, width):
    r = np.random.default_rng(seed)
    ink = (r.random((9, width)) < 0.5).astype(float)
    above = None
    for at in (1, 3, 4, 7):
        path = strips.seam_below(ink, at, 2, above)
        assert np.all(np.abs(np.diff(path)) <= 1) and (above is None or np.all(path >= above))
        cost = sum(ink[y, x] + 0.05 * abs(y - at) for x, y in enumerate(path))
        assert abs(cost - brute_seam(ink, at, 2, above)) < 1e-9
        above = path


def test_rows_are_carved(spark):
    grey = np.full((40, 12), 230, np.uint8)
    grey[8:12, 2:10] = 10  # the first row's writing, with a stroke that hangs down over the printed line
    grey[12:24, 5] = 10
    grey[28:32, 1:11] = 10
    rows = [(1, grey.tobytes(), 12, [[0, 20], [20, 40]]), (2, None, 12, [[0, 5]]), (3, b"", 12, [[0, 5]]), (4, grey.tobytes(), 12, []), (5, grey.tobytes(), 12, [[0, 20], [20, 60]])]
    got = {(r.page, r.n): r for r in strips.carved(spark.createDataFrame(rows, "page int, grey binary, width int, edges array<array<int>>"), KEY).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 1), (5, 1), (5, 2)} and got[3, 1].image == b""
    first, second = (np.frombuffer(got[1, n].image, np.uint8).reshape(got[1, n].height, 12) for n in (1, 2))
    assert (first == 10).sum() == (grey[:25] == 10).sum() and (second == 10).sum() == (grey[25:] == 10).sum()
    assert got[1, 1].lower == got[1, 2].upper and all(a <= b for a, b in zip(got[1, 1].upper, got[1, 1].lower, strict=True))
    assert first[:, 5][got[1, 1].lower[5] - got[1, 1].top - 1] in (10, 230)
