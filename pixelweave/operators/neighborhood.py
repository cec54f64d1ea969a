"""Neighbourhood operators over sparse pixels and row runs.

Dilation and erosion work on runs (slide, y, x0, x1): a disk of radius r adds
2r + 1 shifted runs a run, and a window per image row merges what overlaps.
Extents are given, as erosion needs the border.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters, words
from .algebra import minus
from .pixels import KEY


def to_runs(m: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring pixels in each row."""
    place = F.row_number().over(Window.partitionBy("slide", "y").orderBy("x"))
    return m.select(*KEY, (F.col("x") - place).alias("g")).groupBy("slide", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def from_runs(runs: DataFrame) -> DataFrame:
    return runs.select("slide", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Union of runs: those that overlap or touch become one."""
    row = Window.partitionBy("slide", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(reach.isNull() | (F.col("x0") > reach + 1), 1).otherwise(0))
    return marked.withColumn("g", F.sum("new").over(row)).groupBy("slide", "y", "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("g")


def clip_runs(runs: DataFrame, height: int, width: int) -> DataFrame:
    cut = runs.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.lit(width - 1))})
    return cut.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x0") <= F.col("x1")))


def complement_runs(runs: DataFrame, slides: DataFrame, height: int, width: int) -> DataFrame:
    """Gaps of merged runs in every row of the extent."""
    rows = slides.select("slide").distinct().select("slide", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    ends = rows.select("slide", "y", F.explode(F.array(F.struct(F.lit(-2).alias("x0"), F.lit(-1).alias("x1")), F.struct(F.lit(width).alias("x0"), F.lit(width).alias("x1")))).alias("e")).select("slide", "y", "e.*")
    after = F.lead("x0").over(Window.partitionBy("slide", "y").orderBy("x0"))
    gaps = runs.unionByName(ends).select("slide", "y", (F.col("x1") + 1).alias("x0"), (after - 1).alias("x1"))
    return gaps.where("x0 <= x1")


def _spread(runs: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Runs shifted by (dy, left, right): one output run for each offset row."""
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in offsets])
    return runs.select("slide", "y", "x0", "x1", F.explode(rows).alias("o")).select("slide", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x0") + F.col("o.a")).alias("x0"), (F.col("x1") + F.col("o.b")).alias("x1"))


def disk(r: int) -> list[tuple[int, int, int]]:
    """Rows (dy, left, right) of the Euclidean disk."""
    return [(dy, -math.isqrt(r * r - dy * dy), math.isqrt(r * r - dy * dy)) for dy in range(-r, r + 1)]


# The 5 x 5 ellipse, the 4 x 4 square (its origin right and below the middle) and the plus.
ELLIPSE_5 = [(-2, 0, 0), (-1, -2, 2), (0, -2, 2), (1, -2, 2), (2, 0, 0)]
SQUARE_4 = [(dy, -2, 1) for dy in (-2, -1, 0, 1)]
PLUS = [(-1, 0, 0), (0, -1, 1), (1, 0, 0)]


def mirrored(shape: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return [(-dy, -b, -a) for dy, a, b in shape]


def dilate_runs(runs: DataFrame, shape: list[tuple[int, int, int]], height: int, width: int) -> DataFrame:
    return merge_runs(clip_runs(_spread(runs, shape), height, width))


def erode_runs(runs: DataFrame, shape: list[tuple[int, int, int]], slides: DataFrame, height: int, width: int) -> DataFrame:
    """Complement of the dilated complement; cells outside the extent count as set."""
    gaps = complement_runs(runs, slides, height, width)
    return complement_runs(dilate_runs(gaps, mirrored(shape), height, width), slides, height, width)


def dilate(m: DataFrame, r: int, height: int, width: int) -> DataFrame:
    """Pixels within the disk of radius r of a set pixel."""
    return from_runs(dilate_runs(to_runs(m), disk(r), height, width))


def erode(m: DataFrame, r: int, height: int, width: int) -> DataFrame:
    return from_runs(erode_runs(to_runs(m), disk(r), m, height, width))


def fill_holes(m: DataFrame, grow: int, shrink: int, height: int, width: int) -> DataFrame:
    """Dilation, then erosion by a smaller disk."""
    grown = dilate_runs(to_runs(m), disk(grow), height, width)
    return from_runs(erode_runs(grown, disk(shrink), m, height, width))


def close_(m: DataFrame, shape: list[tuple[int, int, int]], n: int, height: int, width: int) -> DataFrame:
    """n dilations, then n erosions."""
    runs = to_runs(m)
    for _ in range(n):
        runs = dilate_runs(runs, shape, height, width)
    for _ in range(n):
        runs = erode_runs(runs, shape, m, height, width)
    return from_runs(runs)


def open_(m: DataFrame, shape: list[tuple[int, int, int]], n: int, height: int, width: int) -> DataFrame:
    """n erosions, then n dilations."""
    runs = to_runs(m)
    for _ in range(n):
        runs = erode_runs(runs, shape, m, height, width)
    for _ in range(n):
        runs = dilate_runs(runs, shape, height, width)
    return from_runs(runs)


def background_clean(m: DataFrame, height: int, width: int) -> DataFrame:
    """Open once, then close three times with the 5 x 5 ellipse."""
    return close_(open_(m, ELLIPSE_5, 1, height, width), ELLIPSE_5, 3, height, width)


def kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian that sums to 1."""
    reach = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    return [(i - reach, x / sum(w)) for i, x in enumerate(w)]


def weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    return np.array([w for _, w in kernel(sigma, truncate)])


def gauss(v: DataFrame, sigma: float, height: int, width: int, truncate: float = 4.0) -> DataFrame:
    """Blurred values, edges mirrored, absent pixels 0; a row for each cell within reach of a present pixel."""
    w = weights(sigma, truncate)
    return filters.separable(v, w, w, height, width)


def gauss_threshold(m: DataFrame, sigma: float, t: float, height: int, width: int, truncate: float = 4.0) -> DataFrame:
    """Cells of the blurred mask above t; the mask moves as words."""
    w = weights(sigma, truncate)
    return filters.map_masks(words.from_pixels(m), ["bits"], len(w) // 2, height, width, lambda a, touch: filters.correlate(a[0], w, w, touch).round(9) > t)


gauss_threshold_runs = gauss_threshold


def window_pixels(v: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Every value at each place of whose k x k window it is part, edges clipped."""
    reach = k // 2
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(n - 1))))
    return v.select("slide", near("y", height).alias("cy"), "x", "v").select("slide", F.col("cy").alias("y"), near("x", width).alias("cx"), "v").select("slide", "y", F.col("cx").alias("x"), "v")


def median_blur(v: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Lower median of the present values in the k x k window."""
    return filters.medians(v, k, height, width)


def median_mask(m: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Median of a mask: more than half of the k x k window set; cells outside count as unset.

    Whole image rows, then whole columns, are summed by running sums in Arrow
    batches, so the work doesn't grow with k.
    """
    import numpy as np
    import pandas as pd

    reach = k // 2

    def sums(size: int, along: str, across: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            line = np.zeros(size + 1, np.int64)
            line[pdf[along].to_numpy() + 1] = pdf["n"].to_numpy()
            upto = np.cumsum(line)
            at = np.arange(size)
            n = upto[np.minimum(at + reach + 1, size)] - upto[np.maximum(at - reach, 0)]
            at = np.flatnonzero(n)
            return pd.DataFrame({"slide": pdf["slide"].iloc[0], along: at, across: pdf[across].iloc[0], "n": n[at]})[["slide", "y", "x", "n"]]

        return run

    schema = f"slide {m.schema['slide'].dataType.simpleString()}, y int, x int, n long"
    rows = m.select(*KEY, F.lit(1).cast("long").alias("n")).groupBy("slide", "y").applyInPandas(sums(width, "x", "y"), schema)
    return rows.groupBy("slide", "x").applyInPandas(sums(height, "y", "x"), schema).where(F.col("n") * 2 > k * k).select(*KEY)


def shell_array(given: dict[str, np.ndarray], inner: int, outer: int, nested: bool, w: np.ndarray | None, touch: filters.Touch) -> np.ndarray:
    """The shell of the array ``m`` without ``nuclei`` and within ``within``, as far as given, smoothed by the weights."""
    core = filters.eroded(given["m"], disk(inner), touch)
    grown = filters.dilated(core if nested else filters.inner(given["m"], inner, touch), disk(outer), touch)
    out = grown & ~filters.inner(core, outer, touch)
    if "nuclei" in given:
        out &= ~filters.inner(given["nuclei"], inner + outer, touch)
    if "within" in given:
        out &= filters.inner(given["within"], inner + outer, touch)
    if w is None:
        return out
    # Above 0.5 when rounded to nine digits.
    return filters.correlate(out, w, w, touch) * 1e9 > 5e8 + 0.5 if out.any() else filters.inner(out, len(w) // 2, touch)


def shell_words(masks: dict[str, DataFrame], inner: int, outer: int, height: int, width: int, nested: bool = False, sigma: float | None = 2.0) -> DataFrame:
    """Pixels of the shell of mask ``m`` without ``nuclei`` and within ``within``, as far as given, all in words. All steps run over one tile and its margin."""
    names = list(masks)
    w = None if sigma is None else weights(sigma)
    reach = inner + outer + (0 if w is None else len(w) // 2)
    return filters.map_masks(words.joined(masks), names, reach, height, width, lambda arrays, touch: shell_array(dict(zip(names, arrays)), inner, outer, nested, w, touch))


def shell(m: DataFrame, nuclei: DataFrame | None, inner: int, outer: int, height: int, width: int, nested: bool = False, within: DataFrame | None = None, sigma: float | None = 2.0) -> DataFrame:
    """Dilated minus eroded mask, without nuclei, within a mask, smoothed. ``nested`` dilates the eroded mask instead of the mask; without ``sigma`` it isn't smoothed."""
    masks = {n: words.from_pixels(x) for n, x in (("m", m), ("nuclei", nuclei), ("within", within)) if x is not None}
    return shell_words(masks, inner, outer, height, width, nested, sigma)


def tubule_shell(tubule: DataFrame, nuclei: DataFrame | None, height: int, width: int, inner: int = 2, outer: int = 7, within: DataFrame | None = None) -> DataFrame:
    """Membrane around tubules. Cluster form: no nuclei, ``within`` the clusters, outer radius 15; by region: ``within`` the region."""
    return shell(tubule, nuclei, inner, outer, height, width, nested=True, within=within)


def capsule_shell(cap: DataFrame, nuclei: DataFrame | None, height: int, width: int, inner: int = 8, outer: int = 25, within: DataFrame | None = None) -> DataFrame:
    """Capsule around tufts. Cluster form: no nuclei, ``within`` the clusters, radii 14 and 51; by region: ``within`` the region."""
    return shell(cap, nuclei, inner, outer, height, width, within=within)


def unsharp(v: DataFrame, sigma: float, amount: float, height: int, width: int) -> DataFrame:
    """v + amount * (v - blurred), clamped to 0..255."""
    w = weights(sigma)

    def f(value, present, touch):
        own = filters.inner(value, len(w) // 2, touch)
        return {"v": np.clip(own + amount * (own - filters.correlate(value, w, w, touch)), 0, 255)}, filters.inner(present, len(w) // 2, touch)

    return filters.map_values(v.select(*KEY, F.col("v").cast("double").alias("v")), len(w) // 2, height, width, f, {"v": "double"})


# Smoothing and difference parts of the 3 x 3 Sobel operator, scaled by 1/4 and 1/2.
SOBEL_SMOOTH, SOBEL_STEP = np.array([0.25, 0.5, 0.25]), np.array([-0.5, 0.0, 0.5])


def sobel(v: DataFrame, axis: str, height: int, width: int) -> DataFrame:
    """Gradient along ``axis``."""
    return filters.separable(v, *((SOBEL_STEP, SOBEL_SMOOTH) if axis == "y" else (SOBEL_SMOOTH, SOBEL_STEP)), height, width)


def _gradients(value: np.ndarray, present: np.ndarray, touch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients along y and x, and where both have a present pixel among their cells."""
    both = [(SOBEL_STEP, SOBEL_SMOOTH), (SOBEL_SMOOTH, SOBEL_STEP)]
    gy, gx = (filters.correlate(value, a, b, touch) for a, b in both)
    known = [filters.correlate(present, a != 0, b != 0, touch) > 0 for a, b in both]
    return gy, gx, known[0] & known[1]


def orientation(v: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """Angle of the structure tensor, 0.5 * atan2(2 Axy, Axx - Ayy)."""
    w = weights(sigma)

    def f(value, present, touch):
        gy, gx, known = _gradients(value, present, touch)
        gy, gx = gy * known, gx * known
        yy, xx, xy = (filters.correlate(p, w, w, touch) for p in (gy * gy, gx * gx, gx * gy))
        return {"theta": 0.5 * np.arctan2(2 * xy, xx - yy)}, filters.correlate(known, w != 0, w != 0, touch) > 0

    return filters.map_values(v.select(*KEY, F.col("v").cast("double").alias("v")), 1 + len(w) // 2, height, width, f, {"theta": "double"})


def orientation_gradient(theta: DataFrame, height: int, width: int) -> DataFrame:
    """Length of the gradient of the angle."""

    def f(value, present, touch):
        gy, gx, known = _gradients(value, present, touch)
        return {"change": np.hypot(gy, gx)}, known

    return filters.map_values(theta.select(*KEY, F.col("theta").alias("v")), 1, height, width, f, {"change": "double"})


def sample_field(theta: DataFrame, step: int = 20) -> DataFrame:
    return theta.where((F.col("y") % step == 0) & (F.col("x") % step == 0)).select(*KEY, F.cos("theta").alias("u"), F.sin("theta").alias("w"))


def edge_band(m: DataFrame, height: int, width: int, n: int = 2) -> DataFrame:
    """n dilations by the plus, without the mask."""
    runs = to_runs(m)
    for _ in range(n):
        runs = dilate_runs(runs, PLUS, height, width)
    return minus(from_runs(runs), m)


def spread_runs(runs: DataFrame, radius: Column, height: int, width: int) -> DataFrame:
    """The rows of disks whose radius is a column of the runs, as they overlap."""
    r = radius.cast("int")
    rows = runs.withColumn("r", r).select("slide", "y", "x0", "x1", "r", F.explode(F.sequence(-F.col("r"), F.col("r"))).alias("dy"))
    reach = F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("dy") * F.col("dy"))).cast("int")
    return clip_runs(rows.select("slide", (F.col("y") + F.col("dy")).alias("y"), (F.col("x0") - reach).alias("x0"), (F.col("x1") + reach).alias("x1")), height, width)


def spread_by(runs: DataFrame, radius: Column, height: int, width: int) -> DataFrame:
    """Union of disks whose radius is a column of the runs."""
    return merge_runs(spread_runs(runs, radius, height, width))
