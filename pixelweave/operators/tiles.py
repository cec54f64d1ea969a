"""Work on stored tiles (slide, ty, tx, h, w, data): masks, coarser levels and scores, with no row for a pixel.

Tiles are square, their side a multiple of 64, so the words of a mask don't cross
them. What lies beyond the image holds the fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words

MASK = "y int, w int, bits long"


def _kind(df: DataFrame) -> str:
    return df.schema["slide"].dataType.simpleString()


def packed(cells: np.ndarray, y0: int, x0: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, w, bits) of the set cells of a boolean array that begins at (y0, x0), cut to the image."""
    cells = cells & (np.arange(y0, y0 + cells.shape[0]) < height)[:, None] & (np.arange(x0, x0 + cells.shape[1]) < width)
    bits = np.packbits(cells, axis=1, bitorder="little").view(np.int64)
    y, w = np.nonzero(bits)
    return (y + y0).astype(np.int32), (w + x0 // words.WORD).astype(np.int32), bits[y, w]


def _table(slide: pa.Scalar, y: np.ndarray, w: np.ndarray, bits: np.ndarray) -> pa.Table:
    return pa.table({"slide": pa.array([slide.as_py()] * len(y), slide.type), "y": pa.array(y), "w": pa.array(w), "bits": pa.array(bits)})


def _each(batch: pa.RecordBatch) -> Iterator[tuple[pa.Scalar, int, int, np.ndarray]]:
    for slide, ty, tx, h, w, data in zip(*(batch.column(i) for i in range(6))):
        yield slide, ty.as_py(), tx.as_py(), np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), -1)


def mask(tiles: DataFrame, f: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> DataFrame:
    """(slide, y, w, bits) of the cells where ``f`` of a tile's array (h, w, channels) is true. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slide, ty, tx, a in _each(batch):
                yield from _table(slide, *packed(f(a), ty * a.shape[0], tx * a.shape[1], height, width)).to_batches()

    return tiles.select("slide", "ty", "tx", "h", "w", "data").mapInArrow(run, f"slide {_kind(tiles)}, {MASK}")


def coarse(a: np.ndarray, k: int) -> np.ndarray:
    """k x k means cut to whole numbers."""
    h, w = a.shape[0] // k * k, a.shape[1] // k * k
    return (sum(a[i:h:k, j:w:k].astype(np.uint32) for i in range(k) for j in range(k)) // (k * k)).astype(np.uint8)


def coarser(tiles: DataFrame, k: int = 2) -> DataFrame:
    """The next level: k x k means cut to whole numbers, in tiles of side / k. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for _, _, _, a in _each(batch):
                data.append(coarse(a, k).tobytes())
            side = [pa.array([x.as_py() // k for x in batch.column(i)], pa.int32()) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *side, pa.array(data, pa.binary())], ["slide", "ty", "tx", "h", "w", "data"])

    return tiles.select("slide", "ty", "tx", "h", "w", "data").mapInArrow(run, f"slide {_kind(tiles)}, ty int, tx int, h int, w int, data binary")


def score(tiles: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], height: int, width: int, side: int, halo: int = 0, t: float = 0.5, fill: int = 255) -> DataFrame:
    """(slide, y, w, bits) of the cells that score above t. Tiles (of ``side``) send their edges to their eight neighbours, nine rows a tile, and a task scores one tile with its halo."""
    if halo > side:
        raise ValueError("a halo can't be wider than a tile")
    rows, cols = -(-height // side), -(-width // side)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By the step to the neighbour: what it needs of this tile, and where that lies in its block.
        part = {-1: (slice(0, halo), halo + side), 0: (slice(0, side), halo), 1: (slice(side - halo, side), 0)}
        steps = (-1, 0, 1) if halo else (0,)
        for batch in batches:
            for slide, ty, tx, a in _each(batch):
                out = [(ty + dy, tx + dx, part[dy][1], part[dx][1], a[part[dy][0], part[dx][0]]) for dy in steps for dx in steps if 0 <= ty + dy < rows and 0 <= tx + dx < cols]
                columns = [pa.array([o[i] for o in out], pa.int32()) for i in range(4)] + [pa.array([o[4].shape[i] for o in out], pa.int32()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([slide.as_py()] * len(out), slide.type), *columns, pa.array([o[4].tobytes() for o in out], pa.binary())], ["slide", "ty", "tx", "oy", "ox", "h", "w", "data"])

    def run(table: pa.Table) -> pa.Table:
        block = None
        for oy, ox, h, w, data in zip(*(table.column(c) for c in ("oy", "ox", "h", "w", "data"))):
            a = np.frombuffer(data.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), -1)
            if block is None:
                block = np.full((side + 2 * halo, side + 2 * halo, a.shape[2]), float(fill))
            block[oy.as_py() : oy.as_py() + a.shape[0], ox.as_py() : ox.as_py() + a.shape[1]] = a
        found = scorer(block)[halo : halo + side, halo : halo + side] > t
        ty, tx = (table.column(c)[0].as_py() for c in ("ty", "tx"))
        return _table(table.column("slide")[0], *packed(found, ty * side, tx * side, height, width))

    kind = _kind(tiles)
    sent = tiles.select("slide", "ty", "tx", "h", "w", "data").mapInArrow(send, f"slide {kind}, ty int, tx int, oy int, ox int, h int, w int, data binary")
    return sent.groupBy("slide", "ty", "tx").applyInArrow(run, f"slide {kind}, {MASK}")


Part = Callable[[np.ndarray, int, int], np.ndarray]


def layers(tiles: DataFrame, levels: dict[int, tuple[int, dict[str, Part]]], height: int, width: int, side: int, fill: int = 255) -> DataFrame:
    """(slide, k, y, w, one column of words a layer): masks of the level itself (k = 1) and of coarser ones (each k a multiple of the one before, side / k one of 64), in one pass.

    ``levels`` gives, for each k, a halo and ``f(block, ty, tx)`` for each layer: the mask (side / k, side / k) of a
    tile from its block of bytes with the halo. A tile makes its own coarser levels and sends the edges of all
    to its eight neighbours, nine rows a tile; a task holds one tile.
    """
    ks = sorted(levels)
    halos = {k: levels[k][0] for k in ks}
    if any(halos[k] > side // k for k in ks):
        raise ValueError("a halo can't be wider than a tile")
    names = [n for k in ks for n in levels[k][1]]
    rows, cols = -(-height // side), -(-width // side)
    # By the step to the neighbour: what it needs of this tile, and where that lies in its block.
    part = {k: {-1: (slice(0, halos[k]), halos[k] + side // k), 0: (slice(0, side // k), halos[k]), 1: (slice(side // k - halos[k], side // k), 0)} for k in ks}
    steps = (-1, 0, 1) if any(halos.values()) else (0,)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slide, ty, tx, a in _each(batch):
                each, at = {}, 1
                for k in ks:
                    a, at = (a if k == at else coarse(a, k // at)), k
                    each[k] = a
                out = [(ty + dy, tx + dx, dy, dx, a.shape[2], b"".join(each[k][part[k][dy][0], part[k][dx][0]].tobytes() for k in ks)) for dy in steps for dx in steps if 0 <= ty + dy < rows and 0 <= tx + dx < cols]
                columns = [pa.array([o[i] for o in out], pa.int32()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array([slide.as_py()] * len(out), slide.type), *columns, pa.array([o[5] for o in out], pa.binary())], ["slide", "ty", "tx", "dy", "dx", "c", "data"])

    def run(table: pa.Table) -> pa.Table:
        c = table.column("c")[0].as_py()
        blocks = {k: np.full((side // k + 2 * halos[k], side // k + 2 * halos[k], c), fill, np.uint8) for k in ks}
        for dy, dx, data in zip(*(table.column(n) for n in ("dy", "dx", "data"))):
            dy, dx, data, at = dy.as_py(), dx.as_py(), data.as_buffer(), 0
            for k in ks:
                (ys, oy), (xs, ox) = part[k][dy], part[k][dx]
                h, w = ys.stop - ys.start, xs.stop - xs.start
                blocks[k][oy : oy + h, ox : ox + w] = np.frombuffer(data, np.uint8, h * w * c, at).reshape(h, w, c)
                at += h * w * c
        ty, tx = (table.column(n)[0].as_py() for n in ("ty", "tx"))
        found = []
        for k in ks:
            n = side // k
            inside = (np.arange(ty * n, ty * n + n) < height // k)[:, None] & (np.arange(tx * n, tx * n + n) < width // k)
            own = [np.packbits(f(blocks[k], ty, tx) & inside, axis=1, bitorder="little").view(np.int64) for f in levels[k][1].values()]
            y, w = np.nonzero(np.any(own, axis=0))
            bits = dict(zip(levels[k][1], own))
            masks = {m: pa.array(bits[m][y, w] if m in bits else np.zeros(len(y), np.int64)) for m in names}
            place = {"k": np.full(len(y), k, np.int32), "y": (y + ty * n).astype(np.int32), "w": (w + tx * n // words.WORD).astype(np.int32)}
            found.append(pa.table({"slide": pa.array([table.column("slide")[0].as_py()] * len(y), table.schema.field("slide").type), **{p: pa.array(v) for p, v in place.items()}, **masks}))
        return pa.concat_tables(found)

    kind = _kind(tiles)
    sent = tiles.select("slide", "ty", "tx", "h", "w", "data").mapInArrow(send, f"slide {kind}, ty int, tx int, dy int, dx int, c int, data binary")
    return sent.groupBy("slide", "ty", "tx").applyInArrow(run, f"slide {kind}, k int, y int, w int, " + ", ".join(f"{n} long" for n in names))
