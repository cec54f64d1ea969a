"""Tiles, patches, integral images, mosaics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .components import unpacked
from .pixels import KEY


def hashed(*keys: Column, seed: int = 0, below: int = 1000) -> Column:
    """Deterministic number in [0, below) from whole-number keys: plain arithmetic, the same in any SQL."""
    h: Column = F.lit(seed + 7).cast("long")
    for k in keys:
        h = (h * 31 + k.cast("long") + 17) % 1000003
        h = (h * h + h * 7 + 13) % 1000003
    return (h % below).cast("int")


def tiles_grid(px: DataFrame, height: int, width: int, th: int, tw: int) -> DataFrame:
    """Pixels with tile keys; the rest of rows and columns is dropped."""
    inside = px.where((F.col("y") < height // th * th) & (F.col("x") < width // tw * tw))
    return inside.withColumns({"ty": F.floor(F.col("y") / th).cast("int"), "tx": F.floor(F.col("x") / tw).cast("int")})


def pct_black(tiled: DataFrame, below: float | None = None) -> DataFrame:
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    out = tiled.groupBy("slide", "ty", "tx").agg((100.0 * F.count_if(black) / F.count(F.lit(1))).alias("pct"))
    return out if below is None else out.where(F.col("pct") < below)


def patches_overlap(spark: SparkSession, height: int, width: int, size: int, overlap: float = 0.5) -> DataFrame:
    """(patch_idx, y0, x0) of whole patches in row-major order."""
    stride = int(size * (1 - overlap))
    rows, cols = (height - size) // stride + 1, (width - size) // stride + 1
    return spark.range(max(0, rows) * max(0, cols)).select(F.col("id").cast("int").alias("patch_idx"), (F.floor(F.col("id") / cols) * stride).cast("int").alias("y0"), (F.col("id") % cols * stride).cast("int").alias("x0"))


def slide_patches(extents: DataFrame, size: int, overlap: float = 0.5) -> DataFrame:
    """(slide, patch_idx, y0, x0) of the whole patches of each slide (slide, height, width), in row-major order."""
    stride = int(size * (1 - overlap))
    fit = lambda n: F.floor((F.col(n) - size) / stride).cast("int") + 1
    sized = extents.where((F.col("height") >= size) & (F.col("width") >= size)).select("slide", fit("height").alias("rows"), fit("width").alias("cols"))
    i = F.col("i")
    each = sized.select("slide", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)).alias("i"))
    return each.select("slide", i.alias("patch_idx"), (F.floor(i / F.col("cols")) * stride).cast("int").alias("y0"), (i % F.col("cols") * stride).cast("int").alias("x0"))


def _covering(c: str, size: int, stride: int, last: int) -> Column:
    """Starts of the patches that cover a coordinate."""
    low = F.greatest(F.lit(0), F.floor((F.col(c) - size) / stride).cast("int") + 1)
    high = F.least(F.lit(last), F.floor(F.col(c) / stride).cast("int"))
    return F.when(low <= high, F.transform(F.sequence(low, high), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def patch_pixels(px: DataFrame, height: int, width: int, size: int, overlap: float = 0.5) -> DataFrame:
    """Every pixel with each patch (y0, x0) that covers it: at most ceil(size / stride) squared rows a pixel."""
    stride = int(size * (1 - overlap))
    rows, cols = (height - size) // stride, (width - size) // stride
    out = px.select("*", F.explode(_covering("y", size, stride, rows)).alias("y0"))
    return out.select("*", F.explode(_covering("x", size, stride, cols)).alias("x0"))


def min_positive(m: DataFrame, height: int, width: int, size: int, overlap: float = 0.5, t: float = 0.10) -> DataFrame:
    """Patches with at least a share ``t`` of set pixels."""
    return patch_pixels(m, height, width, size, overlap).groupBy("slide", "y0", "x0").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= t * size * size)


def padded_overlap_patches(m: DataFrame, height: int, width: int, size: int, stride: int) -> DataFrame:
    """Patches of the extent padded by size - stride that touch the mask."""
    pad = size - stride
    moved = m.withColumns({"y": F.col("y") + pad, "x": F.col("x") + pad})
    covered = patch_pixels(moved, height + 2 * pad, width + 2 * pad, size, 1 - stride / size)
    return covered.select("slide", "y0", "x0").distinct()


def pad_colour(px: DataFrame) -> DataFrame:
    """Colour of the padding: mean of the corner 2 x 2, absent pixels white."""
    corner = px.where("y < 2 and x < 2").groupBy("slide").agg(*[F.floor((F.sum(c) + 255 * (4 - F.count(F.lit(1)))) / 4).cast("int").alias(c) for c in "rgb"])
    every = px.select("slide").distinct().join(corner, "slide", "left")
    return every.select("slide", *[F.coalesce(c, F.lit(255)).alias(c) for c in "rgb"])


def halo_tiles(px: DataFrame, height: int, width: int, tile: int, halo: int) -> DataFrame:
    """Each pixel with the tiles whose block, grown by the halo and clipped, holds it; ``inner`` marks its own tile."""

    def around(c: str, n: int) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile).cast("int")), F.least(F.lit((n - 1) // tile), F.floor((F.col(c) + halo) / tile).cast("int")))

    out = px.select("*", F.explode(around("y", height)).alias("ty")).select("*", F.explode(around("x", width)).alias("tx"))
    return out.withColumn("inner", (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx")))


def integral_image(m: DataFrame, grid: DataFrame) -> DataFrame:
    """(slide, y, x, s): cells of the mask in the rectangle from the origin to the cell, both ends in. Each window holds one row or column."""
    v = grid.join(m.select(*KEY, F.lit(1).alias("v")), KEY, "left").withColumn("v", F.coalesce("v", F.lit(0)))
    across = v.withColumn("s", F.sum("v").over(Window.partitionBy("slide", "y").orderBy("x")))
    return across.select(*KEY, F.sum("s").over(Window.partitionBy("slide", "x").orderBy("y")).alias("s"))


def patch_counts(integral: DataFrame, h: int, w: int, allowance: float, aligned: bool = False) -> DataFrame:
    """Origins whose rectangle holds at least h * w * allowance cells, from four corners of the integral image.

    As the image has no zero border, the rectangle of origin (y, x) covers rows
    y + 1 .. y + h and the last origins are missing; ``aligned`` counts from the
    origin itself. Each cell goes to the four origins whose corner it is, by one shuffle.
    """
    shift = 1 if aligned else 0
    corners = F.array(*[F.struct((F.col("y") - dy + shift).alias("y"), (F.col("x") - dx + shift).alias("x"), F.lit(sign).alias("sign"), F.lit(int(dy == h and dx == w)).alias("last")) for dy, dx, sign in ((0, 0, 1), (h, 0, -1), (0, w, -1), (h, w, 1))])
    met = integral.select("slide", "s", F.explode(corners).alias("c")).select("slide", "c.y", "c.x", "s", "c.sign", "c.last").where("y >= 0 and x >= 0")
    counts = met.groupBy(*KEY).agg(F.sum(F.col("s") * F.col("sign")).alias("n"), F.count(F.lit(1)).alias("corners"), F.max("last").alias("whole"))
    # With a border of zeros, only the lower right corner must exist.
    return counts.where("whole = 1" if aligned else "corners = 4").select(*KEY, "n").where(F.col("n") >= h * w * allowance)


def count_patches(m: DataFrame, height: int, width: int, h: int, w: int, allowance: float, aligned: bool = False, tile: int = 1024) -> DataFrame:
    """What ``patch_counts`` gives for the integral image of a mask, without one: a task sums one tile of words and its margin below and to the right, and only the origins that pass leave it."""
    if allowance <= 0:
        raise ValueError("allowance must be above 0: origins of empty rectangles have no row")
    k, side = 0 if aligned else 1, max(tile, h, w)
    kind = m.schema["slide"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ty, tx = (table.column(c)[0].as_py() for c in ("ty", "tx"))
        y0, x0 = ty * side + k, tx * side + k
        # Origins of this tile whose rectangle lies in the image.
        rows, cols = min(side, height - h - k + 1 - ty * side), min(side, width - w - k + 1 - tx * side)
        grid, gy, gx = unpacked(*(table.column(c).to_numpy() for c in ("y", "w", "bits")))
        area = np.zeros((rows + h, cols + w), np.int64)
        top, left = max(gy, y0), max(gx, x0)
        part = grid[top - gy :, left - gx :][: max(0, y0 + rows + h - 1 - top), : max(0, x0 + cols + w - 1 - left)]
        area[top - y0 + 1 : top - y0 + 1 + part.shape[0], left - x0 + 1 : left - x0 + 1 + part.shape[1]] = part
        area = area.cumsum(axis=0).cumsum(axis=1)
        n = area[h:, w:] - area[:-h, w:] - area[h:, :-w] + area[:-h, :-w]
        y, x = np.nonzero(n >= h * w * allowance)
        return pa.table({"slide": pa.array([table.column("slide")[0].as_py()] * len(y), table.schema.field("slide").type), "y": pa.array((y + ty * side).astype(np.int32)), "x": pa.array((x + tx * side).astype(np.int32)), "n": pa.array(n[y, x])})

    origin = lambda c, reach, last: F.sequence(F.greatest(F.lit(0), F.floor((c - reach) / side).cast("int")), F.least(F.lit(last // side), F.floor(c / side).cast("int")))
    if h + k > height or w + k > width:
        return m.sparkSession.createDataFrame([], f"slide {kind}, y int, x int, n long")
    tiled = words.from_pixels(m).withColumn("ty", F.explode(origin(F.col("y"), h + k - 1, height - h - k)))
    # A word reaches from its first cell, less the rectangle, to its last.
    first = F.col("w") * words.WORD
    low, high = F.greatest(F.lit(0), F.floor((first - (w + k - 1)) / side).cast("int")), F.least(F.lit((width - w - k) // side), F.floor((first + words.WORD - 1) / side).cast("int"))
    tiled = tiled.where(low <= high).withColumn("tx", F.explode(F.sequence(low, high)))
    return tiled.groupBy("slide", "ty", "tx").applyInArrow(run, f"slide {kind}, y int, x int, n long")


def grid_points(px: DataFrame, sy: int, sx: int) -> DataFrame:
    """Points where x % sy + y % sx is 0."""
    return px.where(F.col("x") % sy + F.col("y") % sx == 0)


def patch_offsets(counted: DataFrame, sy: int, sx: int, vy: int, vx: int) -> DataFrame:
    """World offsets of the selected origins on the grid."""
    return grid_points(counted, sy, sx).select("slide", (F.col("y") * vy).cast("long").alias("oy"), (F.col("x") * vx).cast("long").alias("ox"))


def coverage_runs(offsets: DataFrame, height: int, width: int) -> DataFrame:
    """(slide, y, x0, x1, n): stretches of image rows that n of the rectangles at (y, x) cover, n > 0; neighbouring stretches differ in n.

    A difference array: four signed corners a rectangle. Summed down each column
    they give what begins and ends there in each row; summed along each row, the number.
    """
    corners = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(sign).alias("d")) for dy, dx, sign in ((0, 0, 1), (0, width, -1), (height, 0, -1), (height, width, 1))])
    events = offsets.select("slide", F.explode(corners).alias("c")).groupBy("slide", "c.y", "c.x").agg(F.sum("c.d").alias("d")).where("d != 0")
    down = Window.partitionBy("slide", "x").orderBy("y")
    steps = events.select("slide", "x", "y", F.sum("d").over(down).alias("d"), F.lead("y").over(down).alias("until")).where("d != 0")
    rows = steps.select("slide", "x", "d", F.explode(F.sequence(F.col("y"), F.col("until") - 1)).alias("y"))
    along = Window.partitionBy("slide", "y").orderBy("x")
    stretches = rows.select("slide", "y", F.col("x").alias("x0"), (F.lead("x").over(along) - 1).alias("x1"), F.sum("d").over(along).alias("n"))
    return stretches.where("n > 0")


def roi_coverage(offsets: DataFrame, height: int, width: int, count: bool = False) -> DataFrame:
    """Pixels of the union of rectangles at (y, x), with the number that cover each if asked."""
    cells = coverage_runs(offsets, height, width).select("slide", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "n")
    return cells if count else cells.select(*KEY)


def mosaic(tiles: DataFrame, rows: int, cols: int) -> DataFrame:
    """(slide, row, col, class + 1) of every place of the grid from file names l_{row}-{col}.png; missing tiles are class 0."""
    at = lambda i: F.regexp_extract("name", r"l_(\d+)-(\d+)\.png$", i).cast("int")
    placed = tiles.where(F.col("name").rlike(r"l_\d+-\d+\.png$")).select("slide", at(1).alias("row"), at(2).alias("col"), (F.col("pred") + 1).alias("class"))
    grid = tiles.select("slide").distinct().select("slide", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).select("slide", "row", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    return grid.join(placed, ["slide", "row", "col"], "left").select("slide", "row", "col", F.coalesce("class", F.lit(0)).alias("class"))


def paint_center(pred: DataFrame, size: int, spacing: int, wanted: int = 1) -> DataFrame:
    """Pixels of the central squares of patches (y, x) whose class is the wanted one."""
    edge = (size - spacing) // 2
    moved = pred.where(F.col("class") == wanted).select("slide", (F.col("y") + edge).alias("y"), (F.col("x") + edge).alias("x"))
    return roi_coverage(moved, spacing, spacing)


def jitter_windows(spark: SparkSession, height: int, width: int, patch: int, stride: int, seed: int = 0) -> DataFrame:
    """Window grid over the extent; inner windows move by a hashed step in [-stride, stride), windows at the border stay."""
    rows, cols = -(-(height - patch) // stride) + 1, -(-(width - patch) // stride) + 1
    i = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    y, x = F.least(F.col("i") * stride, F.lit(height - patch)), F.least(F.col("j") * stride, F.lit(width - patch))
    inner = (F.col("i") > 0) & (F.col("i") < rows - 1) & (F.col("j") > 0) & (F.col("j") < cols - 1)
    step = lambda k: hashed(F.col("i"), F.col("j"), seed=seed + k, below=2 * stride) - stride
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - patch))
    return i.select("i", "j", F.when(inner, clip(y + step(0), height)).otherwise(y).alias("y"), F.when(inner, clip(x + step(1), width)).otherwise(x).alias("x"))


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits count as numbers of up to twelve digits."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|[^\d]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 12, "0")).otherwise(p)), "")


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their number from 1 in the given order: sorted by ranges, numbered within each, the sizes of the ranges before added. No task holds all rows."""
    from ..sources.tables import stored

    keys = [f"__key{i}" for i in range(len(order))]
    sorted_ = rows.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    placed = stored(sorted_.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)  # its lower 33 bits count the rows of a partition
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a partition
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__id") - F.shiftleft("__part", 33) + 1).select(*rows.columns, name)


def tile_manifest(paths: DataFrame) -> DataFrame:
    """One row per patch file that is no mask, numbered in natural order, with a flat name."""
    kept = paths.where(~F.col("path").contains("mask"))
    numbered = kept.withColumn("id", F.row_number().over(Window.partitionBy("folder").orderBy(natural_key(F.col("path")), "path")) - 1)
    return numbered.select("folder", "path", F.col("id").cast("int").alias("id"), F.replace(F.col("path"), F.lit("/"), F.lit("-")).alias("name"))


def slide_windows(extents: DataFrame, patch: int, stride: int, seed: int = 0) -> DataFrame:
    """(slide, i, j, y, x): the window grid of each slide (slide, height, width, none below ``patch``); inner windows move by a hashed step in [-stride, stride), windows at the border stay."""
    fit = lambda n: F.ceil((F.col(n) - patch) / stride).cast("int") + 1
    sized = extents.where((F.col("height") >= patch) & (F.col("width") >= patch)).select("*", fit("height").alias("rows"), fit("width").alias("cols"))
    each = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    inner = (F.col("i") > 0) & (F.col("i") < F.col("rows") - 1) & (F.col("j") > 0) & (F.col("j") < F.col("cols") - 1)

    def start(c: str, n: str, k: int) -> Column:
        last = F.col(n) - patch
        plain = F.least(F.col(c) * stride, last)
        moved = plain + hashed(F.col("slide"), F.col("i"), F.col("j"), seed=seed + k, below=2 * stride) - stride
        return F.when(inner, F.least(F.greatest(moved, F.lit(0)), last)).otherwise(plain)

    return each.select("slide", "i", "j", start("i", "height", 0).alias("y"), start("j", "width", 1).alias("x"))
