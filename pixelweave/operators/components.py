"""Connected components of a mask tile by tile.

A task holds one tile of words, cuts it into runs and joins touching runs; only
labels of runs that touch across tile borders meet in a graph of labels, whose
rounds are bounded by the tiles an object winds through, not by its bends. With
``block``, components end at the edges of block x block squares, a tile is made
of whole blocks, and there are no rounds at all.

A label is the least cell y * width + x of the component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import words

TILE = 1024


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes linked by (a, b): larger roots hook onto smaller ones, then all paths are shortened."""
    parent = np.arange(n)
    while len(a):
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def unpacked(y: np.ndarray, w: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The cells of words as a boolean array over their bounding box, with its first row and column."""
    y0, w0 = int(y.min()), int(w.min())
    grid = np.zeros((int(y.max()) - y0 + 1, int(w.max()) - w0 + 1, words.WORD), bool)
    grid[y - y0, w - w0] = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), bitorder="little").reshape(-1, words.WORD).astype(bool)
    return grid.reshape(len(grid), -1), y0, w0 * words.WORD


def runs_of(grid: np.ndarray, y0: int, x0: int, conn: int, block: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1, root) of the runs of a boolean array: root is the index of the component's first run."""
    h, width = grid.shape
    column = np.arange(x0, x0 + width)
    left, right = np.zeros_like(grid), np.zeros_like(grid)
    left[:, 1:], right[:, :-1] = grid[:, :-1], grid[:, 1:]
    if block:
        left[:, column % block == 0] = False
        right[:, column % block == block - 1] = False
    row, a = np.nonzero(grid & ~left)
    b = np.nonzero(grid & ~right)[1]
    touch = 1 if conn == 8 else 0
    # Runs of the row above that reach the run: a stretch of them, as both are sorted.
    first = np.searchsorted(row * (width + 2) + b, (row - 1) * (width + 2) + a - touch)
    last = np.searchsorted(row * (width + 2) + a, (row - 1) * (width + 2) + b + touch, "right")
    n = np.maximum(last - first, 0)
    own = np.repeat(np.arange(len(row)), n)
    other = np.repeat(first, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    if block:
        same = ((row[own] + y0) // block == (row[other] + y0) // block) & ((a[own] + x0) // block == (a[other] + x0) // block)
        own, other = own[same], other[same]
    return row + y0, a + x0, b + x0, roots(len(row), own, other)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def tile_runs(w: DataFrame, width: int, conn: int, block: int | None, tile: int) -> DataFrame:
    """(slide, y, x0, x1, label) with labels of each tile's own components."""

    def run(table: pa.Table) -> pa.Table:
        y, a, b, root = runs_of(*unpacked(_column(table, "y"), _column(table, "w"), _column(table, "bits")), conn, block)
        slide = pa.array([table.column("slide")[0].as_py()] * len(y), table.schema.field("slide").type)
        return pa.table({"slide": slide, "y": pa.array(y, pa.int32()), "x0": pa.array(a, pa.int32()), "x1": pa.array(b, pa.int32()), "label": pa.array(y[root].astype(np.int64) * width + a[root])})

    kind = w.schema["slide"].dataType.simpleString()
    tiled = words.cut(w, tile, ["bits"], "ty", "tx").where("bits != 0")
    return tiled.groupBy("slide", "ty", "tx").applyInArrow(run, f"slide {kind}, y int, x0 int, x1 int, label long")


def border_links(runs: DataFrame, conn: int, tile: int) -> DataFrame:
    """(slide, a, b): labels of runs that touch across a border of tiles, a and b of each link once."""
    touch = 1 if conn == 8 else 0
    edge = lambda c: F.floor(F.col(c) / tile)
    other = lambda y: [F.col("slide"), y.alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("label").alias("a")]
    # From the last row of a tile to the first of the next.
    above = runs.where((F.col("y") + 1) % tile == 0).select(*other(F.col("y") + 1))
    down = runs.where(F.col("y") % tile == 0).join(above, ["slide", "y"]).where((F.col("a0") <= F.col("x1") + touch) & (F.col("a1") >= F.col("x0") - touch))
    # From the last column of a tile to the first of the next; with 8 neighbours also one row up or down.
    near = F.explode(F.array(*[F.col("y") + F.lit(d) for d in ((-1, 0, 1) if conn == 8 else (0,))]))
    before = runs.where((F.col("x1") + 1) % tile == 0).select("slide", near.alias("y"), (F.col("x1") + 1).alias("x0"), F.col("label").alias("a"))
    across = runs.where(edge("x0") * tile == F.col("x0")).join(before, ["slide", "y", "x0"])
    links = down.select("slide", "a", F.col("label").alias("b")).unionByName(across.select("slide", "a", F.col("label").alias("b")))
    return links.where("a != b").select("slide", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def least_labels(links: DataFrame) -> DataFrame:
    """(slide, label, root) of the labels in ``links`` that aren't their component's least. Neighbours' least labels spread, and one jump a round shortens the way; each round is a written table."""
    both = stored(links.select("slide", F.col("a").alias("label"), F.col("b").alias("other")).unionByName(links.select("slide", F.col("b").alias("label"), F.col("a").alias("other"))), "links")
    if both.isEmpty():
        return both.select("slide", "label", F.col("label").alias("root"))
    now = both.groupBy("slide", "label").agg(F.least(F.min("other"), F.col("label")).alias("root"))
    while True:
        reach = both.join(now.select("slide", F.col("label").alias("other"), "root"), ["slide", "other"]).groupBy("slide", "label").agg(F.min("root").alias("near"))
        least = stored(now.join(reach, ["slide", "label"]).select("slide", "label", F.col("root").alias("old"), F.least("root", "near").alias("root")), "labels")
        jump = least.select("slide", F.col("label").alias("root"), F.col("root").alias("further"))
        new = stored(least.join(jump, ["slide", "root"], "left").select("slide", "label", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        if new.where("old != root").isEmpty():
            return new.where("label != root").select("slide", "label", "root")
        now = new.select("slide", "label", "root")


def label_words(w: DataFrame, width: int, conn: int = 8, block: int | None = None, tile: int | None = None) -> DataFrame:
    """(slide, y, x0, x1, label) of a mask in words: runs, cut at tiles, with their components' labels."""
    tile = tile or TILE
    if block:
        return tile_runs(w, width, conn, block, block * -(-tile // block))
    runs = stored(tile_runs(w, width, conn, None, tile), "runs")
    moved = least_labels(border_links(runs, conn, tile))
    return runs.join(moved, ["slide", "label"], "left").select("slide", "y", "x0", "x1", F.coalesce("root", "label").alias("label"))


def drop_small(w: DataFrame, mask: str, up_to: int, block: int, keys: list[str], tile: int | None = None) -> DataFrame:
    """The rows ``w`` (slide, y, w, and masks as columns ``keys``), cut at tiles of whole blocks, where ``mask`` has lost its 8-connected objects of up to so many cells; objects end at block edges. One shuffle."""
    side = block * -(-(tile or TILE) // block)

    def run(table: pa.Table) -> pa.Table:
        bits = _column(table, mask)
        if not bits.any():
            return table.select(names)
        some = np.flatnonzero(bits)
        y, at = _column(table, "y")[some], _column(table, "w")[some]
        grid, y0, x0 = unpacked(y, at, bits[some])
        row, a, b, root = runs_of(grid, y0, x0, 8, block)
        small = np.bincount(root, b - a + 1, len(root))[root] <= up_to
        # The cells of small objects: where runs begin less where they end, summed along the row.
        change = np.zeros((len(grid), grid.shape[1] + 1), np.int8)
        change[row[small] - y0, a[small] - x0] += 1
        change[row[small] - y0, b[small] - x0 + 1] -= 1
        grid &= np.cumsum(change[:, :-1], axis=1, dtype=np.int8) == 0
        packed = np.packbits(grid, axis=1, bitorder="little").view(np.int64)
        out = bits.copy()
        out[some] = packed[y - y0, at - x0 // words.WORD]
        return table.select(names).set_column(names.index(mask), mask, pa.array(out))

    names = ["slide", *keys]
    kind = w.schema["slide"].dataType.simpleString()
    tiled = words.cut(w, side, keys, "ty", "tx")
    return tiled.groupBy("slide", "ty", "tx").applyInArrow(run, f"slide {kind}, " + ", ".join(f"{k} long" for k in keys))


def any_bit(keys: list[str]) -> Column:
    """Whether a row has a cell of any of the masks."""
    out = F.col(keys[0])
    for k in keys[1:]:
        out = out.bitwiseOR(F.col(k))
    return out != 0
