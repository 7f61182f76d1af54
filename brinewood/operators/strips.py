"""Rows cut out of a strip of handwriting along paths of least ink, so that no stroke is cut or claimed by two rows.

A strip is one row of a table: grey (its pixels, a byte each, row after row), width, and edges (top and bottom of every band, in
order). Strips are independent, so they are cut where they lie, one by one; nothing is shuffled.

Cases: a strip without bands, or null, gives no rows; one without pixels gives empty images; bands beyond the strip are cut at its ends; a band that has nothing in
it is an image of paper, not a missing row; ties go to the path that comes from above, then to the one straight on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pull towards the printed line, least margin around it, its share of a band, and how ink is told from paper.
DRIFT, LEAST_MARGIN, MARGIN_SHARE, DARKEST_PAPER, DARKER, PAPER = 0.05, 4, 0.35, 60, 35, 255


def ink_of(grey: np.ndarray) -> np.ndarray:
    """One where a pixel is clearly darker than the strip is on average."""
    return (grey < max(DARKEST_PAPER, int(grey.mean()) - DARKER)).astype(float) if grey.size else np.zeros(grey.shape)


def seam_below(ink: np.ndarray, at: int, margin: int, above: np.ndarray | None = None, drift: float = DRIFT) -> np.ndarray:
    """The path of least ink around row ``at``, a row for each column, that nowhere goes over the path ``above``."""
    height, width = ink.shape
    lo, hi = max(0, at - margin), min(height, at + margin + 1)
    if above is not None:
        hi = max(hi, min(height, int(above.max()) + 1))
    if hi - lo <= 1:
        return np.full(width, min(max(at, 0), height - 1))
    rows = np.arange(lo, hi)
    cost = ink[lo:hi] + drift * np.abs(rows - at)[:, None]
    if above is not None:
        cost = np.where(rows[:, None] < above[None, :], np.inf, cost)
    total, came = cost[:, 0], np.zeros(cost.shape, np.int64)
    for x in range(1, width):
        fenced = np.concatenate(([np.inf], total, [np.inf]))
        three = np.stack((fenced[:-2], fenced[1:-1], fenced[2:]))
        came[:, x] = three.argmin(axis=0) - 1
        total = three.min(axis=0) + cost[:, x]
    path = np.empty(width, np.int64)
    y = int(total.argmin())
    for x in range(width - 1, -1, -1):
        path[x] = y + lo
        y += came[y, x]
    return path


def row_seams(ink: np.ndarray, edges: list[tuple[int, int]]) -> list[np.ndarray]:
    """One path for every boundary of the bands, from the top down; none goes over the one above it."""
    margin = max(LEAST_MARGIN, int(MARGIN_SHARE * sum(b - a for a, b in edges) / len(edges)))
    out: list[np.ndarray] = []
    for at in (edges[0][0], *(b for _, b in edges)):
        out.append(seam_below(ink, at, margin, out[-1] if out else None))
    return out


def cut_rows(grey: np.ndarray, edges: list[tuple[int, int]], fill: int = PAPER) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """For each band (upper path, lower path, top, image): what lies between its paths, all else being paper."""
    paths, rows = row_seams(ink_of(grey), edges), np.arange(grey.shape[0])[:, None]
    for upper, lower in zip(paths[:-1], paths[1:], strict=True):
        own = np.where((rows >= upper) & (rows < lower), grey, fill).astype(np.uint8)
        top, bottom = int(upper.min()), int(lower.max())
        yield upper, lower, *((top, own[top:bottom]) if bottom > top else (0, own))


def carved(strips: DataFrame, key: list[str], fill: int = PAPER) -> DataFrame:
    """key, n (from 1), upper, lower (paths), top, height, image: the rows of every strip (key, grey, width, edges)."""
    kinds = {f.name: f.dataType.simpleString() for f in strips.schema if f.name in key}
    rows = strips.select(*key, "grey", "width", "edges").where("grey is not null and width > 0 and size(edges) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, edges = batch.column("width")[i].as_py(), [tuple(e) for e in batch.column("edges")[i].as_py()]
                grey = np.frombuffer(batch.column("grey")[i].as_py(), np.uint8)
                grey = grey[: grey.size - grey.size % width].reshape(-1, width)
                if not grey.size:
                    found = [(np.zeros(0, np.int64),) * 2 + (0, grey) for _ in edges]
                else:
                    found = list(cut_rows(grey, edges, fill))
                own = {k: pa.array([batch.column(k)[i].as_py()] * len(found), batch.schema.field(k).type) for k in key}
                upper, lower, top, image = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict(
                    own | {"n": pa.array(range(1, len(found) + 1), pa.int32()), "upper": pa.array(upper, pa.list_(pa.int32())), "lower": pa.array(lower, pa.list_(pa.int32()))}
                    | {"top": pa.array(top, pa.int32()), "height": pa.array([x.shape[0] for x in image], pa.int32()), "image": pa.array([x.tobytes() for x in image], pa.binary())}
                )

    return rows.mapInArrow(run, f"{', '.join(f'{k} {kinds[k]}' for k in key)}, n int, upper array<int>, lower array<int>, top int, height int, image binary")
