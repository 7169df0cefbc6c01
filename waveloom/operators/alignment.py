"""Sequence alignment of feature frames: dynamic time warping and two on-line forms (Dixon 2005).

A pair of tracks is the unit of work: both sides' frames meet by cogroup, as Arrow's arrays, and the band is filled line by line. Of its costs only
the last lines are held, of the rest two bits a cell, by which the path is followed back.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TICKS_PER_SECOND

HOP, RATE = 882, 44100


def frame_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Frames against one frame: 90 * L1 difference over the sum, weighted by the sum's level; 0 for two empty frames."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    total = a.sum(1) + b.sum()
    some = total > 0
    safe = np.where(some, total, 1.0)
    level = np.clip((8 + np.log(safe)) / 10, 0.0, 1.0)
    return np.where(some, 90.0 * np.abs(a - b).sum(1) / safe * level, 0.0)


def frame_cost(a: np.ndarray, b: np.ndarray) -> float:
    return float(frame_costs(a[None, :], b)[0])


def backtrack(total, i: int, j: int) -> list[tuple[int, int]]:
    """The path from (0, 0) by the costs total(i, j): the diagonal first, then i - 1, then j - 1 among equal ones."""
    path = [(i, j)]
    while i > 0 or j > 0:
        if i == 0:
            j -= 1
        elif j == 0:
            i -= 1
        else:
            d, u, l = total(i - 1, j - 1), total(i - 1, j), total(i, j - 1)
            least = min(d, u, l)
            if d == least:
                i, j = i - 1, j - 1
            elif u == least:
                i -= 1
            else:
                j -= 1
        path.append((i, j))
    return path[::-1]


def band(n: int, m: int, width: int) -> tuple[list[int], list[int]]:
    """For each row 1 .. n the first and last column of the band: from a cell of the line between the ends, `width` cells back along its row and column."""
    # the band's centre goes from the first frames to the last ones of both sides
    dn, dm = (1.0, 1.0) if n == m else (1.0, (m - 1) / (n - 1)) if n > m else ((n - 1) / (m - 1), 1.0)
    steps = np.arange(max(n, m))
    x, y = np.minimum(n, (steps * dn + 1e-9).astype(int) + 1), np.minimum(m, (steps * dm + 1e-9).astype(int) + 1)
    rows = np.arange(1, n + 1)
    first = np.maximum(1, y[np.searchsorted(x, rows, "left")] - width)
    last = y[np.searchsorted(x, np.minimum(n, rows + width), "right") - 1]
    return first.tolist(), last.tolist()


class Steps:
    """Steps back from cells that are filled line by line, four in a byte: all that a path needs of cells that are no longer held."""

    def __init__(self):
        self.first, self.lines = [], []

    def add(self, first: int, steps: bytes) -> None:
        """The next line's cells, from `first` on."""
        v = np.frombuffer(steps.ljust(-(-len(steps) // 4) * 4, b"\0"), np.uint8).reshape(-1, 4)
        self.first.append(first)
        self.lines.append((v[:, 0] | v[:, 1] << 2 | v[:, 2] << 4 | v[:, 3] << 6).tobytes())

    def at(self, line: int, cell: int) -> int:
        k = cell - self.first[line]
        return self.lines[line][k >> 2] >> 2 * (k & 3) & 3


def follow(step, i: int, j: int) -> list[tuple[int, int]]:
    """backtrack() by the steps of cells."""
    path = [(i, j)]
    while i > 0 or j > 0:
        k = 2 if i == 0 else 1 if j == 0 else step(i, j)
        i, j = i - (k < 2), j - (k != 1)
        path.append((i, j))
    return path[::-1]


def dtw(a: np.ndarray, b: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The cheapest path in a band of `width` cells along the n : m diagonal, in 1-based cells from (0, 0). Of the costs the last row is held, of
    the rows before it the steps back, a quarter of a byte a cell."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    inf = math.inf
    first, last = band(n, m, max(width, 1))
    first, last, steps = [0, *first], [0, *last], Steps()
    steps.add(0, b"\0")
    row = [0.0]
    for i in range(1, n + 1):
        low, high = first[i], last[i]
        # costs of the row above from low - 1 to high; what lies outside of its band is infinite
        start, end = first[i - 1], last[i - 1]
        before = max(0, start - (low - 1))
        above = [inf] * before + row[low - 1 + before - start : high + 1 - start]
        above += [inf] * (high - low + 2 - len(above))
        left, row, back = inf, [], bytearray()
        for c, d, u in zip(frame_costs(b[low - 1 : high], a[i - 1]).tolist(), above, above[1:]):
            back.append(0 if d <= u and d <= left else 1 if u <= left else 2)
            left = c + min(u, left, d)
            row.append(left)
        steps.add(low, bytes(back))
    return follow(steps.at, n, m)


def oltw(a: np.ndarray, b: np.ndarray, width: int, max_run: int = 3, diagonal: float = 2.0, by_length: bool = False) -> list[tuple[int, int]]:
    """On-line time warping: the frontier grows by a row, a column or both, towards the cheapest cell of its last row and column, and no
    side more than max_run times in a row. by_length divides costs by path length, the off-line variant (with diagonal 1).

    Of the costs the last row and column are held. A cell is filled once, after all it is reached from, so its step back is known then.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    c = max(1, min(width, n, m))
    inf = math.inf
    # costs of the cells (x, j) by x and (i, y) by y, from x0 and y0 on; steps of the cells of column j with x <= i, and of row i with y <= j
    column, x0 = [frame_cost(a[0], b[0])], 0
    row, y0 = list(column), 0
    columns, rows = Steps(), Steps()
    columns.add(0, b"\0")
    rows.add(0, b"\0")
    # i at the time when column j came, which tells where a cell was filled
    reached = [0]
    i = j = run = 0
    previous = None

    def cheapest(costs: list[float], at: int, first: int, last: int, other: int) -> tuple[float, int]:
        """The least cost of the cells first .. last, by length if so asked, and its place: the last of equal ones."""
        own = np.array(costs[max(0, first - at) : last - at + 1])
        if by_length:
            own = own / (1 + np.arange(last - len(own) + 1, last + 1) + other)
        k = len(own) - 1 - int(own[::-1].argmin())
        return float(own[k]), last - len(own) + 1 + k

    def fill(held: list[float], at: int, low: int, costs: list[float], of_column: bool) -> tuple[list[float], bytes]:
        """The next column's or row's costs from `low` on, by those of the one before from `at` on, and the steps back: 0 for the diagonal, 1 for
        i - 1, 2 for j - 1, the first of the least."""
        before = max(0, at - (low - 1))
        old = [inf] * before + held[low - 1 + before - at :]
        out, back, last = [], bytearray(), inf
        for cost, d, across in zip(costs, old, old[1:]):
            u, l = (last, across) if of_column else (across, last)
            back.append(0 if d <= u and d <= l else 1 if u <= l else 2)
            last = min(d + diagonal * cost, u + cost, l + cost)
            out.append(last)
        return out, bytes(back)

    while i < n - 1 or j < m - 1:
        if i < c:
            way = "both"
        else:
            x, y = cheapest(column, x0, max(0, i - c + 1), i, j), cheapest(row, y0, max(0, j - c + 1), j, i)
            way = "both" if x[1] == i and y[1] == j else "row" if x[0] < y[0] else "column"
        run = run + 1 if way == previous else run
        if way == "both":
            run = 0
        elif run >= max_run:
            way, run = ("column" if way == "row" else "row"), 0
        # a side that has ended leaves the other to go on
        if way == "row" and j == m - 1:
            way = "column"
        elif way == "column" and i == n - 1:
            way = "row"
        if j < m - 1 and way in ("row", "both"):
            j += 1
            low = max(i - c + 1, 0)
            column, back = fill(column, x0, low, frame_costs(a[low : i + 1], b[j]).tolist(), True)
            x0 = low
            columns.add(low, back)
            reached.append(i)
            row.append(column[-1])
        if i < n - 1 and way in ("column", "both"):
            i += 1
            low = max(j - c + 1, 0)
            row, back = fill(row, y0, low, frame_costs(b[low : j + 1], a[i]).tolist(), False)
            y0 = low
            rows.add(low, back)
            column.append(row[-1])
        # no more than the last c cells, and the one before, are looked at
        if len(column) > 2 * c + 8:
            x0, column = x0 + len(column) - c - 1, column[-c - 1 :]
        if len(row) > 2 * c + 8:
            y0, row = y0 + len(row) - c - 1, row[-c - 1 :]
        previous = way
    return follow(lambda x, y: columns.at(y, x) if x <= reached[y] else rows.at(x, y), n - 1, m - 1)


def smooth(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Horizontal and vertical runs as one point each, the truncated mean; the last run stays as it is."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for p in path:
        if held and p not in ((held[-1][0], held[-1][1] + 1), (held[-1][0] + 1, held[-1][1])):
            out.append((sum(h[0] for h in held) // len(held), sum(h[1] for h in held) // len(held)))
            held = []
        held.append(p)
    return out + held


KERNELS = {
    "dtw": lambda a, b, w: dtw(a, b, w),
    "oltw": lambda a, b, w: oltw(a, b, w),
    "oltw2": lambda a, b, w: oltw(a, b, w, diagonal=1.0, by_length=True),
}


def _stack(own: pa.Table) -> np.ndarray:
    """Frames (pair, frame, values) in order, as rows."""
    own = own.combine_chunks()
    order = np.argsort(own.column(1).to_numpy(), kind="stable")
    lists = own.column(2).chunk(0)
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return values if (order[:-1] < order[1:]).all() else values[order]


def align(pairs: DataFrame, frames: DataFrame, kind: str = "dtw", width: int = 500, zero_based: bool = False, optimize: bool = True) -> DataFrame:
    """pairs (pair_id, track1, track2) and frames (track_id, frame_idx, values) -> path rows: pair_id, step, i1, i2, t1, t2 in ticks.

    zero_based shifts the 1-based cells of dtw back by one hop. Pairs without frames on a side have no rows.
    """
    kernel = KERNELS[kind]
    # new names on either side, as both come from one table of frames
    f = frames.select("track_id", "frame_idx", "values")
    side = lambda n: pairs.select(F.col("pair_id").alias(f"pair{n}"), F.col(f"track{n}").alias("track_id")).join(f, "track_id").select(f"pair{n}", F.col("frame_idx").alias(f"frame{n}"), F.col("values").alias(f"values{n}"))
    shift = 1 if zero_based and kind == "dtw" else 0

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        path = kernel(_stack(left), _stack(right), width) if len(left) and len(right) else []
        path = smooth(path) if optimize else path
        at = np.maximum(np.array(path, np.int64).reshape(-1, 2) - shift, 0)
        ticks = np.rint(at * HOP / RATE * TICKS_PER_SECOND).astype(np.int64)
        columns = (np.full(len(at), key[0].as_py(), np.int64), np.arange(len(at), dtype=np.int32), at[:, 0], at[:, 1], ticks[:, 0], ticks[:, 1])
        return pa.table([pa.array(c) for c in columns], ["pair_id", "step", "i1", "i2", "t1", "t2"])

    return side(1).groupBy("pair1").cogroup(side(2).groupBy("pair2")).applyInArrow(run, "pair_id long, step int, i1 long, i2 long, t1 long, t2 long")
