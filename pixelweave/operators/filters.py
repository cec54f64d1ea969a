"""Filters of a neighbourhood, tile by tile: a task holds one tile and a margin as wide as the filter reaches, as arrays.

A pass shrinks the array by its own reach where the image goes on, and pads it
where the image ends: by mirroring for weights, by cells that don't count for
medians, dilations and erosions. After all passes the tile itself is left. One
shuffle moves the values (or, for masks, words of 64 cells) with their margins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import unpacked
from .patches import halo_tiles
from .pixels import KEY

TILE = 512
Touch = tuple[bool, bool, bool, bool]  # whether the array's top, bottom, left and right are the image's


def _padded(a: np.ndarray, ry: int, rx: int, touch: Touch, **how) -> np.ndarray:
    top, bottom, left, right = touch
    return np.pad(a, ((ry * top, ry * bottom), (rx * left, rx * right)), **how)


def correlate(a: np.ndarray, wy: np.ndarray, wx: np.ndarray, touch: Touch) -> np.ndarray:
    """Sum of wy[i] * wx[j] * a[y + i - ry, x + j - rx], mirrored at the image's edges. Some rows at a time, which the CPU's cache holds."""
    a = _padded(a, len(wy) // 2, len(wx) // 2, touch, mode="symmetric")
    h, w = a.shape[0] - len(wy) + 1, a.shape[1] - len(wx) + 1
    n = max(1, 32_000 // max(a.shape[1], 1))
    out, rows, part = np.zeros((h, w)), np.empty((n, a.shape[1])), np.empty((n, a.shape[1]))
    for y in range(0, h, n):
        some = out[y : y + n]
        m = len(some)
        values = a[y : y + m + len(wy) - 1].astype(float)
        rows[:] = 0
        for i in np.flatnonzero(wy):
            rows[:m] += np.multiply(values[i : i + m], wy[i], out=part[:m])
        for j in np.flatnonzero(wx):
            some += np.multiply(rows[:m, j : j + w], wx[j], out=part[:m, :w])
    return out


def box_sums(a: np.ndarray, r: int, touch: Touch) -> np.ndarray:
    """Sums of the (2 r + 1)^2 cells around each, none beyond the image, by running sums."""
    s = np.zeros(np.add(_padded(a, r, r, touch, mode="constant").shape, 1), np.int64)
    s[1:, 1:] = _padded(a, r, r, touch, mode="constant").cumsum(axis=0).cumsum(axis=1)
    k = 2 * r + 1
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def dilated(a: np.ndarray, shape: list[tuple[int, int, int]], touch: Touch) -> np.ndarray:
    """Cells that the rows (dy, left, right) of a shape reach from a set cell, with no set cell beyond the image. ``shape`` is symmetric, each row of it around 0."""
    r = max(abs(x) for row in shape for x in row)
    a = _padded(a, r, r, touch, mode="constant")
    h, w = a.shape[0] - 2 * r, a.shape[1] - 2 * r
    out = np.zeros((h, w), bool)
    # Every image row spread to both sides, wider step by step: a row of the shape takes it when it has its width.
    wide, reach = a[:, r : r + w].copy(), 0
    for dy, _, right in sorted(shape, key=lambda row: row[2]):
        for reach in range(reach + 1, right + 1):
            wide |= a[:, r - reach : r - reach + w]
            wide |= a[:, r + reach : r + reach + w]
        out |= wide[r + dy : r + dy + h]
    return out


def eroded(a: np.ndarray, shape: list[tuple[int, int, int]], touch: Touch) -> np.ndarray:
    """Cells beyond the image count as set."""
    return ~dilated(~a, shape, touch)


def inner(a: np.ndarray, r: int, touch: Touch) -> np.ndarray:
    """An array as a pass of reach r would leave it."""
    top, bottom, left, right = (0 if t else r for t in touch)
    return a[top : a.shape[0] - bottom, left : a.shape[1] - right]


def _region(ty: int, tx: int, tile: int, reach: int, height: int, width: int) -> tuple[int, int, int, int, Touch]:
    y0, y1, x0, x1 = max(0, ty * tile - reach), min(height, (ty + 1) * tile + reach), max(0, tx * tile - reach), min(width, (tx + 1) * tile + reach)
    return y0, y1, x0, x1, (y0 == 0, y1 == height, x0 == 0, x1 == width)


def _rows(table: pa.Table, ty: int, tx: int, tile: int, where: np.ndarray, y_from: int, x_from: int, values: dict[str, np.ndarray], types: dict[str, pa.DataType]) -> pa.Table:
    """Rows of the cells of the tile's own part of a result that begins at (y_from, x_from)."""
    y, x = np.nonzero(where)
    own = ((y + y_from) // tile == ty) & ((x + x_from) // tile == tx)
    y, x = y[own], x[own]
    slide = pa.array([table.column("slide")[0].as_py()] * len(y), table.schema.field("slide").type)
    return pa.table({"slide": slide, "y": pa.array((y + y_from).astype(np.int32)), "x": pa.array((x + x_from).astype(np.int32)), **{n: pa.array(a[y, x]).cast(types[n]) for n, a in values.items()}})


def map_values(v: DataFrame, reach: int, height: int, width: int, f: Callable, out: dict[str, str], tile: int | None = None) -> DataFrame:
    """(slide, y, x, columns ``out``) by ``f(values, present, touch)`` over arrays of a tile and its margin; f gives ({name: array}, where), shrunk by ``reach``.

    Absent pixels have value 0; of pixels given twice one counts.
    """
    side = max(tile or TILE, 1)
    types = {n: {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "smallint": pa.int16(), "tinyint": pa.int8()}[t] for n, t in out.items()}

    def run(table: pa.Table) -> pa.Table:
        ty, tx = (table.column(c)[0].as_py() for c in ("ty", "tx"))
        y0, y1, x0, x1, touch = _region(ty, tx, side, reach, height, width)
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        value, present = np.zeros((y1 - y0, x1 - x0), table.column("v").to_numpy().dtype), np.zeros((y1 - y0, x1 - x0), bool)
        value[y - y0, x - x0], present[y - y0, x - x0] = table.column("v").to_numpy(), True
        found, where = f(value, present, touch)
        return _rows(table, ty, tx, side, where, y0 if touch[0] else y0 + reach, x0 if touch[2] else x0 + reach, found, types)

    kind = v.schema["slide"].dataType.simpleString()
    tiled = halo_tiles(v.select(*KEY, "v"), height, width, side, reach).select(*KEY, "v", "ty", "tx")
    return tiled.groupBy("slide", "ty", "tx").applyInArrow(run, f"slide {kind}, y int, x int, " + ", ".join(f"{n} {t}" for n, t in out.items()))


def map_masks(w: DataFrame, masks: list[str], reach: int, height: int, width: int, f: Callable, tile: int | None = None) -> DataFrame:
    """(slide, y, x) of the cells where ``f(arrays, touch)`` is true: one boolean array for each of the masks (columns of words), result shrunk by ``reach``."""
    side = max(tile or TILE, 1)

    def run(table: pa.Table) -> pa.Table:
        ty, tx = (table.column(c)[0].as_py() for c in ("ty", "tx"))
        y0, y1, x0, x1, touch = _region(ty, tx, side, reach, height, width)
        arrays = []
        for name in masks:
            grid, gy, gx = unpacked(*(table.column(c).to_numpy() for c in ("y", "w", name)))
            a = np.zeros((y1 - y0, x1 - x0), bool)
            top, left = max(gy, y0), max(gx, x0)
            part = grid[top - gy : y1 - gy, left - gx : x1 - gx]
            a[top - y0 : top - y0 + part.shape[0], left - x0 : left - x0 + part.shape[1]] = part
            arrays.append(a)
        return _rows(table, ty, tx, side, f(arrays, touch), y0 if touch[0] else y0 + reach, x0 if touch[2] else x0 + reach, {}, {})

    first = F.col("w") * words.WORD
    span = lambda low, high, n: F.sequence(F.greatest(F.lit(0), F.floor((low - reach) / side).cast("int")), F.least(F.lit((n - 1) // side), F.floor((high + reach) / side).cast("int")))
    tiled = w.where((F.col("y") >= 0) & (F.col("y") < height) & (first < width)).withColumn("ty", F.explode(span(F.col("y"), F.col("y"), height)))
    tiled = tiled.withColumn("tx", F.explode(span(first, F.least(first + words.WORD - 1, F.lit(width - 1)), width)))
    kind = w.schema["slide"].dataType.simpleString()
    return tiled.groupBy("slide", "ty", "tx").applyInArrow(run, f"slide {kind}, y int, x int")


def of_block(block: np.ndarray, ty: int, tx: int, side: int, halo: int, reach: int, height: int, width: int, f: Callable) -> np.ndarray:
    """``f(array, touch)`` over the part of a tile's block (with its halo, which isn't smaller than the reach) that lies in the image: the tile's own (side, side) cells, unset beyond the image."""
    y0, y1, x0, x1, touch = _region(ty, tx, side, reach, height, width)
    top, left = ty * side - halo, tx * side - halo
    found = f(block[y0 - top : y1 - top, x0 - left : x1 - left], touch)
    own = _own(found, ty, tx, side, y0 if touch[0] else y0 + reach, x0 if touch[2] else x0 + reach)
    return np.pad(own, ((0, side - own.shape[0]), (0, side - own.shape[1])))


def _own(found: np.ndarray, ty: int, tx: int, side: int, y_from: int, x_from: int) -> np.ndarray:
    """The tile's part of a result that begins at (y_from, x_from)."""
    return found[ty * side - y_from :, tx * side - x_from :][:side, :side]


def map_levels(w: DataFrame, masks: list[str], reach: int, height: int, width: int, f: Callable, out: list[str], tile: int | None = None) -> DataFrame:
    """(slide, y, w, columns ``out``): words of the cells where ``f(arrays, touch)``, {name: array} shrunk by ``reach``, is true.

    ``w`` (slide, k, y, w, columns ``masks``) has words of levels, a cell of which is k x k cells here, each word of a mask once. One
    shuffle moves each level's own words; a task enlarges them. A tile's side is a multiple of 64.
    """
    side = tile or TILE
    if side % words.WORD:
        raise ValueError("words don't fit into the tiles")

    def run(table: pa.Table) -> pa.Table:
        ty, tx = (table.column(c)[0].as_py() for c in ("ty", "tx"))
        y0, y1, x0, x1, touch = _region(ty, tx, side, reach, height, width)
        arrays = {name: np.zeros((y1 - y0, x1 - x0), bool) for name in masks}
        level, y, at, *bits = (table.column(c).to_numpy() for c in ("k", "y", "w", *masks))
        for k in np.unique(level).tolist():
            for name, b in zip(masks, bits):
                some = np.flatnonzero((level == k) & (b != 0))
                if len(some):
                    grid, gy, gx = unpacked(y[some], at[some], b[some])
                    grid, gy, gx = grid.repeat(k, 0).repeat(k, 1), gy * k, gx * k
                    top, left = max(gy, y0), max(gx, x0)
                    part = grid[top - gy : max(y1 - gy, 0), left - gx : max(x1 - gx, 0)]
                    arrays[name][top - y0 : top - y0 + part.shape[0], left - x0 : left - x0 + part.shape[1]] |= part
        found = f(arrays, touch)
        packed = []
        for name in out:
            own = _own(found[name], ty, tx, side, y0 if touch[0] else y0 + reach, x0 if touch[2] else x0 + reach)
            packed.append(np.packbits(np.pad(own, ((0, 0), (0, -own.shape[1] % words.WORD))), axis=1, bitorder="little").view(np.int64))
        y, at = np.nonzero(np.any(packed, axis=0))
        slide = pa.array([table.column("slide")[0].as_py()] * len(y), table.schema.field("slide").type)
        place = {"y": pa.array((y + ty * side).astype(np.int32)), "w": pa.array((at + tx * side // words.WORD).astype(np.int32))}
        return pa.table({"slide": slide, **place, **{n: pa.array(b[y, at]) for n, b in zip(out, packed)}})

    k = F.col("k")
    first = F.col("w") * words.WORD * k
    span = lambda low, high, n: F.sequence(F.greatest(F.lit(0), F.floor((low - reach) / side).cast("int")), F.least(F.lit((n - 1) // side), F.floor((high + reach) / side).cast("int")))
    tiled = w.where((F.col("y") >= 0) & (F.col("y") * k < height) & (F.col("w") >= 0) & (first < width)).withColumn("ty", F.explode(span(F.col("y") * k, F.least(F.col("y") * k + k - 1, F.lit(height - 1)), height)))
    tiled = tiled.withColumn("tx", F.explode(span(first, F.least(first + k * words.WORD - 1, F.lit(width - 1)), width)))
    kind = w.schema["slide"].dataType.simpleString()
    return tiled.groupBy("slide", "ty", "tx").applyInArrow(run, f"slide {kind}, y int, w int, " + ", ".join(f"{n} long" for n in out))


def separable(v: DataFrame, wy: np.ndarray, wx: np.ndarray, height: int, width: int, tile: int | None = None) -> DataFrame:
    """(slide, y, x, v): weighted sums, for the cells with a present pixel among those that have a weight."""
    reach = max(len(wy), len(wx)) // 2
    wy, wx = (np.pad(w, reach - len(w) // 2) for w in (wy, wx))

    def f(value, present, touch):
        return {"v": correlate(value, wy, wx, touch)}, correlate(present, wy != 0, wx != 0, touch) > 0

    return map_values(v, reach, height, width, f, {"v": "double"}, tile)


def medians(v: DataFrame, k: int, height: int, width: int, tile: int | None = None) -> DataFrame:
    """Lower median of the present values in the k x k window. A task counts, for each value of its tile, the values up to it by running sums: work follows the number of different values, not k."""

    def f(value, present, touch):
        total = box_sums(present, k // 2, touch)
        out, rest = np.zeros(total.shape, value.dtype), total > 0
        for t in np.unique(value[present]):
            here = rest & (2 * box_sums(present & (value <= t), k // 2, touch) >= total)
            out[here] = t
            rest &= ~here
            if not rest.any():
                break
        return {"v": out}, total > 0

    return map_values(v, k // 2, height, width, f, {"v": v.schema["v"].dataType.simpleString()}, tile)
