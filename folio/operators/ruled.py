"""Tables drawn with rules: touching rules make a grid, missing edges make merged cells.

A page's rules are worked on together (a file format bounds them); pages run in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.operators.geometry import MOST_COLUMNS, MOST_ROWS, MOST_TABLES, TOUCH

MOST_RULES, MOST_PAIRS = 4_000, 1 << 20
WHOLE_PAGE = 0.85  # a frame beyond this share of the page is no table


def _runs(at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Collinear stretches as rows (at, start, stop): each run keeps its first coordinate and grows to what it reaches."""
    out: list[list[float]] = []
    for k in np.lexsort((start, at)):
        if out and abs(at[k] - out[-1][0]) <= TOUCH and start[k] <= out[-1][2] + TOUCH:
            out[-1][2] = max(out[-1][2], stop[k])
        else:
            out.append([at[k], start[k], stop[k]])
    return np.array(out).reshape(-1, 3)


def _labels(meets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least level rule of the component of each level and each upright rule; -1 for one that meets nothing."""
    n, m = meets.shape
    level = np.arange(n)
    while True:
        upright = np.where(meets, level[:, None], n).min(0, initial=n)
        new = np.minimum(level, np.where(meets, upright[None, :], n).min(1, initial=n))
        new = new[new]
        if np.array_equal(new, level):
            return np.where(meets.any(1), level, -1), np.where(upright < n, upright, -1)
        level = new


def _edges(values: np.ndarray) -> np.ndarray:
    kept: list[float] = []
    for v in np.sort(values):
        if not kept or v - kept[-1] > TOUCH:
            kept.append(v)
    return np.array(kept)


def _drawn(lines: np.ndarray, across: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Whether a rule lies on edge i of `across` from along[j] to along[j + 1]."""
    on = np.zeros((len(across), max(0, len(along) - 1)), bool)
    for at, start, stop in lines:
        near = np.flatnonzero(np.abs(across - at) <= TOUCH)
        if len(near):
            on[near[0]] |= (start <= along[:-1] + TOUCH) & (stop >= along[1:] - TOUCH)
    return on


def grids(rules: np.ndarray, width: float, height: float) -> list[dict]:
    """Grids (xs, ys, owner by row and column as row * columns + column) of rules (l, t, r, b), top to bottom."""
    w, h = rules[:, 2] - rules[:, 0], rules[:, 3] - rules[:, 1]
    flat, tall = (h < 0.5) & (w >= 3), (w < 0.5) & (h >= 3) & ~((h < 0.5) & (w >= 3))
    hs = _runs(rules[flat][:, [1, 3]].mean(1), rules[flat, 0], rules[flat, 2])
    vs = _runs(rules[tall][:, [0, 2]].mean(1), rules[tall, 1], rules[tall, 3])
    if min(len(hs), len(vs)) < 2 or len(hs) + len(vs) > MOST_RULES or len(hs) * len(vs) > MOST_PAIRS:
        return []
    x, y = vs[None, :, 0], hs[:, None, 0]
    meets = (x >= hs[:, None, 1] - TOUCH) & (x <= hs[:, None, 2] + TOUCH) & (y >= vs[None, :, 1] - TOUCH) & (y <= vs[None, :, 2] + TOUCH)
    of_h, of_v = _labels(meets)
    found = []
    for label in np.unique(of_h[of_h >= 0]):
        mine_h, mine_v = hs[of_h == label], vs[of_v == label]
        if min(len(mine_h), len(mine_v)) < 2:
            continue
        ys, xs = _edges(mine_h[:, 0]), _edges(mine_v[:, 0])
        rows, cols = len(ys) - 1, len(xs) - 1
        if not (2 <= rows <= MOST_ROWS and 2 <= cols <= MOST_COLUMNS) or (xs[-1] - xs[0]) * (ys[-1] - ys[0]) > WHOLE_PAGE * width * height:
            continue
        left, top = _drawn(mine_v, xs, ys).T, _drawn(mine_h, ys, xs)
        owner = np.arange(rows * cols).reshape(rows, cols)
        for r in range(rows):
            for c in range(cols):
                if c and not left[r, c]:
                    owner[r, c] = owner[r, c - 1]
                elif r and not top[r, c]:
                    owner[r, c] = owner[r - 1, c]
        found.append({"xs": xs, "ys": ys, "owner": owner.ravel()})
    return sorted(found[:MOST_TABLES], key=lambda g: (g["ys"][0], g["xs"][0]))


def ruled_tables(rules: DataFrame, by: list[str], width: float, height: float) -> DataFrame:
    """by, grid_no, rows, cols, xs, ys, owner of the tables that a page's rules (l, t, r, b) draw."""
    from pyspark.sql import types as T

    schema = T.StructType([*rules.select(*by).schema.fields, *T._parse_datatype_string("grid_no int, rows int, cols int, xs array<double>, ys array<double>, owner array<int>").fields])

    def run(table: pa.Table) -> pa.Table:
        found = grids(np.column_stack([table.column(c).to_numpy() for c in "ltrb"]).astype(float), width, height)
        n = len(found)
        keys = [pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in by]
        numbers = [pa.array(range(n), pa.int32()), pa.array([len(g["ys"]) - 1 for g in found], pa.int32()), pa.array([len(g["xs"]) - 1 for g in found], pa.int32())]
        lists = [pa.array([g[k].tolist() for g in found], pa.list_(t)) for k, t in (("xs", pa.float64()), ("ys", pa.float64()), ("owner", pa.int32()))]
        return pa.table([*keys, *numbers, *lists], [*by, "grid_no", "rows", "cols", "xs", "ys", "owner"])

    return rules.select(*by, *"ltrb").groupBy(*by).applyInArrow(run, schema)
