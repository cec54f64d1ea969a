"""Connected components of masks and what is done with them. Labels come from :mod:`.components`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import words
from .algebra import minus
from .components import label_words
from .neighborhood import SQUARE_4, close_, complement_runs, from_runs, gauss_threshold_runs, spread_by, spread_runs, to_runs
from .patches import hashed
from .pixels import KEY
from .resample import downsample_mask


def label_runs(m: DataFrame, width: int, conn: int = 8, block: int | None = None, tile: int | None = None) -> DataFrame:
    """(slide, y, x0, x1, label) of the runs of a mask, cut at tiles; with ``block``, components end at the edges of block x block squares."""
    return label_words(words.from_pixels(m), width, conn, block, tile)


def label(m: DataFrame, width: int, conn: int = 8, block: int | None = None, tile: int | None = None) -> DataFrame:
    """(slide, y, x, label)."""
    return label_runs(m, width, conn, block, tile).select("slide", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("slide", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))


def _of_size(runs: DataFrame, keep) -> DataFrame:
    return from_runs(runs.join(sizes(runs).where(keep), ["slide", "label"], "left_semi"))


def remove_small(m: DataFrame, min_size: int, width: int, conn: int = 8, block: int | None = None) -> DataFrame:
    """Components of at least ``min_size`` pixels."""
    return _of_size(label_runs(m, width, conn, block), F.col("size") >= min_size)


def fill_small_holes(m: DataFrame, area: int, height: int, width: int, conn: int = 4) -> DataFrame:
    """The mask with background components of fewer than ``area`` pixels set."""
    holes = from_runs(complement_runs(to_runs(m), m, height, width))
    small = _of_size(label_runs(holes, width, conn), F.col("size") < area)
    return m.select(*KEY).unionByName(small)


def scaled_dilation(m: DataFrame, height: int, width: int, base: int = 5) -> DataFrame:
    """Rings around 4-connected objects: dilation by base + int(ln(1 + 2500 * size)), without the source."""
    runs = label_runs(m, width, 4)
    with_size = runs.join(sizes(runs), ["slide", "label"])
    return minus(from_runs(spread_by(with_size, F.lit(base) + F.floor(F.log1p(2500.0 * F.col("size"))), height, width)), m)


def of_size_at_least(w: DataFrame, size: int, width: int) -> DataFrame:
    """(slide, y, x0, x1, label, size): runs of the 4-connected objects of a mask in words that have at least ``size`` cells."""
    runs = stored(label_words(w, width, 4), "objects")
    return runs.join(sizes(runs).where(F.col("size") >= size), ["slide", "label"])


def holes_of_less(w: DataFrame, area: int, height: int, width: int) -> DataFrame:
    """Words of the 4-connected background components of fewer than ``area`` cells."""
    holes = stored(label_words(words.complement(w, height, width), width, 4), "holes")
    return words.from_runs(holes.join(sizes(holes).where(F.col("size") < area), ["slide", "label"], "left_semi"))


def scaled_rings(runs: DataFrame, height: int, width: int, base: int = 5) -> DataFrame:
    """Words of the rings around objects (runs with ``size``): dilation by base + int(ln(1 + 2500 * size)), with the source."""
    return words.from_runs(spread_runs(runs, F.lit(base) + F.floor(F.log1p(2500.0 * F.col("size"))), height, width))


def filter_fibrosis(m: DataFrame, max_size: int, width: int, block: int | None = None) -> DataFrame:
    """Pixels with ``kept``: whether their 8-connected object (cut at blocks, if given) has more than ``max_size`` pixels."""
    runs = label_runs(m, width, 8, block)
    told = runs.join(sizes(runs), ["slide", "label"]).withColumn("kept", F.col("size") > max_size)
    return told.select("slide", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "kept")


def abnormal_tissue(fib: DataFrame, eroded_cortex: DataFrame, height: int, width: int, factor: int = 4, min_size: int = 2000, sigma: float = 41, t: float = 0.01) -> DataFrame:
    """Large fibrosis at reduced size, blurred wide, within the eroded cortex."""
    low = downsample_mask(fib, factor)
    large = remove_small(low, min_size, width // factor)
    soft = gauss_threshold_runs(large, sigma, t, height // factor, width // factor)
    return soft.intersect(downsample_mask(eroded_cortex, factor, "any"))


def tissue_objects(m: DataFrame, height: int, width: int, min_area: int = 20, min_hole: int = 16, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(objects, holes): closed mask's objects whose net area passes, and for each its largest holes.

    A hole is a background component that doesn't touch the border; it belongs
    to the object left of its first pixel.
    """
    closed = stored(close_(m, SQUARE_4, 1, height, width), "closed")
    runs = stored(label_runs(closed, width, 8), "objects")
    big = sizes(runs).where(F.col("size") > min_area)
    objects = runs.join(big.select("slide", "label"), ["slide", "label"], "left_semi")
    gaps = stored(label_runs(from_runs(complement_runs(to_runs(closed), closed, height, width)), width, 4), "gaps")
    border = gaps.where((F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x0") == 0) | (F.col("x1") == width - 1)).select("slide", F.col("label")).distinct()
    inner = gaps.join(border, ["slide", "label"], "left_anti")
    hole = inner.groupBy("slide", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).where(F.col("area") > min_hole)
    first = hole.select("slide", "label", "area", F.floor(F.col("label") / width).cast("int").alias("y"), (F.col("label") % width - 1).cast("int").alias("at"))
    owner = first.join(objects.select("slide", "y", F.col("x1").alias("at"), F.col("label").alias("parent")), ["slide", "y", "at"])
    rank = F.row_number().over(Window.partitionBy("slide", "parent").orderBy(F.desc("area"), "label"))
    kept = owner.withColumn("rank", rank).where(F.col("rank") <= most).select("slide", "label", "parent")
    return objects, inner.join(kept, ["slide", "label"])


def fill_objects(objects: DataFrame, holes: DataFrame, height: int, width: int) -> DataFrame:
    """Objects with all their gaps filled but for the kept holes."""
    runs = objects.select("slide", "y", "x0", "x1")
    gaps = stored(label_runs(from_runs(complement_runs(runs, runs, height, width)), width, 4), "gaps")
    border = gaps.where((F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x0") == 0) | (F.col("x1") == width - 1)).select("slide", "label").distinct()
    inner = gaps.join(border, ["slide", "label"], "left_anti").select("slide", "y", "x0", "x1")
    return minus(from_runs(runs.unionByName(inner)), from_runs(holes.select("slide", "y", "x0", "x1")))


def bounding_boxes(m: DataFrame, height: int, width: int, crop: int = 0, margin: int = 32) -> DataFrame:
    """Per slide the least box of the mask, grown to ``crop`` and by the margin, clamped; ends exclusive."""
    box = m.groupBy("slide").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    for a, n in (("y", height), ("x", width)):
        lack = F.greatest(F.lit(0), crop - (F.col(f"{a}1") - F.col(f"{a}0")))
        low = F.col(f"{a}0") - F.floor(lack / 2).cast("int") - margin
        high = F.col(f"{a}1") + F.ceil(lack / 2).cast("int") + margin
        box = box.withColumn(f"n{a}0", F.greatest(low, F.lit(0))).withColumn(f"n{a}1", F.least(high, F.lit(n)))
    return box.select("slide", *[F.col(f"n{c}").alias(c) for c in ("y0", "y1", "x0", "x1")])


def sample_crop(boxes: DataFrame, crop: int, height: int, width: int, p: float = 0.8, seed: int = 0) -> DataFrame:
    """A start inside the box for a share p of the slides, else anywhere; by hashed choice."""
    inside = hashed(F.col("slide"), seed=seed) < int(p * 1000)

    def start(a: str, n: int, k: int):
        low = F.when(inside, F.col(f"{a}0")).otherwise(0)
        high = F.greatest(low, F.least(F.when(inside, F.col(f"{a}1") - crop).otherwise(n - crop), F.lit(n - crop)))
        low = F.least(low, F.lit(n - crop))
        return (low + hashed(F.col("slide"), seed=seed + k, below=1000003) % (high - low + 1)).cast("int")

    return boxes.select("slide", start("y", height, 1).alias("y"), start("x", width, 2).alias("x"), inside.alias("inside"))


