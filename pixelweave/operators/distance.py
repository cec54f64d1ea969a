"""Exact Euclidean distance to the nearest cell of a mask, separably and in linear time.

First each strip of 64 columns finds, for all its cells, the nearest set cell of
the same column. Then each band of 64 image rows takes the lower envelope of the
parabolas that stand on these distances along the row. Work follows the image's
area; no cell meets candidates of the other mask. A group is a strip of 64
columns or a band of 64 rows, so its size is 64 times the image's side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import unpacked

BAND = 64
_FAR = np.int32(1 << 30)


def column_distances(set_: np.ndarray) -> np.ndarray:
    """For each cell of a boolean array the distance to the nearest set cell of its column, ``_FAR`` where there is none."""
    y = np.arange(len(set_), dtype=np.int32)[:, None]
    above = np.maximum.accumulate(np.where(set_, y, -_FAR), axis=0)
    below = np.minimum.accumulate(np.where(set_, y, _FAR)[::-1], axis=0)[::-1]
    return np.minimum(np.minimum(y - above, _FAR), np.minimum(below - y, _FAR)).astype(np.int32)


def envelope(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower envelope of the parabolas (x - q)^2 + g[r, q]^2 of each row r, all rows at once: sites v[r], their left bounds z[r], and how many there are."""
    rows, width = g.shape
    f = g.astype(np.int64) ** 2 + np.arange(width) ** 2
    v, z, top = np.zeros((rows, width), np.int64), np.full((rows, width), -np.inf), np.full(rows, -1)
    for q in np.flatnonzero((g < _FAR).any(axis=0)):
        live = np.flatnonzero(g[:, q] < _FAR)
        bound = np.full(len(live), -np.inf)
        open_ = np.flatnonzero(top[live] >= 0)
        while len(open_):
            r = live[open_]
            last = v[r, top[r]]
            bound[open_] = (f[r, q] - f[r, last]) / (2 * (q - last))
            hidden = bound[open_] <= z[r, top[r]]
            top[r[hidden]] -= 1
            open_ = open_[hidden & (top[r] >= 0)]
        empty = top[live] < 0
        bound[empty] = -np.inf
        top[live] += 1
        v[live, top[live]], z[live, top[live]] = q, bound
    return v, z, top + 1


def _strips(height: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        set_ = np.zeros((-(-height // BAND) * BAND, words.WORD), bool)
        bits = np.ascontiguousarray(table.column("bits").to_numpy())
        set_[table.column("y").to_numpy()] = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, words.WORD)
        g = column_distances(set_).reshape(-1, BAND * words.WORD)
        n = len(g)
        return pa.table({"slide": pa.array([table.column("slide")[0].as_py()] * n, table.schema.field("slide").type), "band": pa.array(np.arange(n, dtype=np.int32)), "w": pa.array([table.column("w")[0].as_py()] * n, pa.int32()), "g": pa.array([x.tobytes() for x in g], pa.binary())})

    return run, f"slide {kind}, band int, w int, g binary"


def _bands(kind: str):
    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        slide_type = own.schema.field("slide").type if len(own) else near.schema.field("slide").type
        none = pa.table({"slide": pa.array([], slide_type), "y": pa.array([], pa.int32()), "x": pa.array([], pa.int32()), "d2": pa.array([], pa.int64())})
        if not len(own) or not len(near):
            return none
        band, at = own.column("band")[0].as_py(), near.column("w").to_numpy()
        first = int(at.min())
        g = np.full((BAND, int(at.max()) - first + 1, words.WORD), _FAR, np.int32)
        for k, data in zip(at, near.column("g")):
            g[:, k - first] = np.frombuffer(data.as_py(), np.int32).reshape(BAND, words.WORD)
        grid, y0, x0 = unpacked(own.column("y").to_numpy(), own.column("w").to_numpy(), own.column("bits").to_numpy())
        used = np.flatnonzero(grid.any(axis=1))
        g = g.reshape(BAND, -1)[used + y0 - band * BAND]
        v, z, n = envelope(g)
        ys, xs, d2 = [], [], []
        for r, row in enumerate(used):
            x = np.flatnonzero(grid[row]) + x0 - first * words.WORD
            q = v[r, np.searchsorted(z[r, : n[r]], x, "right") - 1]
            ys.append(np.full(len(x), row + y0, np.int32))
            xs.append((x + first * words.WORD).astype(np.int32))
            d2.append((x - q) ** 2 + g[r, q].astype(np.int64) ** 2)
        y, x, d = map(np.concatenate, (ys, xs, d2))
        return pa.table({"slide": pa.array([own.column("slide")[0].as_py()] * len(y), slide_type), "y": pa.array(y), "x": pa.array(x), "d2": pa.array(d)})

    return run, f"slide {kind}, y int, x int, d2 long"


def squared_distances(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    """(slide, y, x, d2) of each cell of ``a`` (words): squared distance to the nearest cell of ``b`` (words) on its slide; slides without ``b`` are left out."""
    kind = a.schema["slide"].dataType.simpleString()
    run, schema = _strips(height, kind)
    strips = b.where("bits != 0").groupBy("slide", "w").applyInArrow(run, schema)
    own = a.where("bits != 0").select("slide", F.floor(F.col("y") / BAND).cast("int").alias("band"), "y", "w", "bits")
    run, schema = _bands(kind)
    return own.groupBy("slide", "band").cogroup(strips.groupBy("slide", "band")).applyInArrow(run, schema)
