"""Per-pixel projections: colour, contrast, background, labels, overlays, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["slide", "y", "x"]
# The legend's colours in order, with their red, green and blue.
COLOURS = {
    "purple": (82, 22, 180),
    "magenta": (255, 0, 255),
    "yellow": (255, 211, 25),
    "cyan": (60, 214, 230),
    "blue": (21, 52, 80),
    "brown": (81, 62, 62),
    "red": (237, 0, 38),
    "maroon": (111, 0, 61),
    "orange": (255, 97, 25),
    "white": (255, 255, 255),
}


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(c + 0.5).cast("int")


def gray(px: DataFrame, swap: bool = False) -> DataFrame:
    """Luma; ``swap`` exchanges the weights of red and blue, as for reversed channels."""
    first, last = ("b", "r") if swap else ("r", "b")
    return px.select(*KEY, rounded(F.col(first) * 0.299 + F.col("g") * 0.587 + F.col(last) * 0.114).alias("v"))


def sigmoid_contrast(px: DataFrame, cutoff: float = 0.7, gain: float = 2.0) -> DataFrame:
    return px.select(*KEY, F.floor(F.lit(255.0) / (1 + F.exp(F.lit(gain) * (F.lit(cutoff) - F.col("v") / 255.0)))).cast("int").alias("v"))


def sigmoid_norm(px: DataFrame, alpha: float = 127.5) -> DataFrame:
    """Sigmoid centred on the range (max - min) of the slide."""
    beta = px.groupBy("slide").agg((F.max("v") - F.min("v")).alias("beta"))
    return px.join(beta, "slide").select(*KEY, F.round(F.lit(255.0) / (1 + F.exp(-(F.col("v") - F.col("beta")) / alpha)), 6).alias("v"))


def hsv_sv(px: DataFrame) -> DataFrame:
    """Saturation and value on 0..255."""
    v, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return px.select(*KEY, F.when(v == 0, 0).otherwise(rounded((v - low) * 255.0 / v)).alias("s"), v.alias("v"))


def foreground(px: DataFrame, delta: int = 50) -> DataFrame:
    """Pixels that are not near white in all channels."""
    edge = 255 - delta
    return px.where(~((F.col("r") > edge) & (F.col("g") > edge) & (F.col("b") > edge))).select(*KEY)


def background_hsv(px: DataFrame, sat: int = 30, val: int = 210) -> DataFrame:
    """Pale and bright pixels; clean up with open and close."""
    return hsv_sv(px).where((F.col("s") < sat) & (F.col("v") > val)).select(*KEY)


def invert_gray(px: DataFrame) -> DataFrame:
    return gray(px).withColumn("v", 255 - F.col("v"))


def normalize(px: DataFrame, mean: float = 0.5, std: float = 0.5) -> DataFrame:
    return px.select(*KEY, ((F.col("v") / 255.0 - mean) / std).alias("v"))


def clip_scale(px: DataFrame, low: float = -325, high: float = 325, by: float = 325) -> DataFrame:
    return px.withColumn("v", F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high)) / by)


def binarize(px: DataFrame, at_least: float | None = None) -> DataFrame:
    """Pixels whose value is not 0, or reaches ``at_least``."""
    return px.where(F.col("v") != 0 if at_least is None else F.col("v") >= at_least).select(*KEY)


def remap_labels(px: DataFrame, task: Column) -> DataFrame:
    """Two channels per task: for tasks 0 and 1 label 2 counts as the second structure; others know one; -1 is undefined."""
    known = F.col("label") >= 0
    return px.withColumns({
        "c0": F.when(~known, -1).when(task <= 1, (F.col("label") >= 1).cast("int")).otherwise((F.col("label") == 1).cast("int")),
        "c1": F.when(~known | (task > 1), -1).otherwise((F.col("label") == 2).cast("int")),
    })


def mask_color(px: DataFrame, m: DataFrame) -> DataFrame:
    return px.join(m.select(*KEY), KEY, "left_semi")


def erase(px: DataFrame, m: DataFrame, fill: int = 0) -> DataFrame:
    """``px`` with the pixels under the mask filled."""
    marked = px.join(m.select(*KEY, F.lit(True).alias("hit")), KEY, "left")
    return marked.select(*KEY, *[F.when(F.col("hit"), fill).otherwise(F.col(c)).alias(c) for c in "rgb"])


def black_to_white(px: DataFrame) -> DataFrame:
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    return px.select(*KEY, *[F.when(black, 255).otherwise(F.col(c)).alias(c) for c in "rgb"])


def overlay(px: DataFrame, classes: DataFrame, colours: DataFrame, other: str = "808080") -> DataFrame:
    """Half the image plus a sixth of each class colour; pixels of no class take ``other``; clamped.

    ``colours`` (class, r, g, b) is the legend: ten rows, so it is broadcast.
    """
    paint = colours.select("class", *[F.col(c).alias(f"p{c}") for c in "rgb"])
    sums = classes.join(F.broadcast(paint), "class").groupBy(*KEY).agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in "rgb"])
    rest = [int(other[i : i + 2], 16) for i in (0, 2, 4)]
    tint = {c: F.coalesce(F.col(f"p{c}"), F.lit(rest[i])) for i, c in enumerate("rgb")}
    return px.join(sums, KEY, "left").select(*KEY, *[F.least(F.lit(255), F.floor(F.col(c) / 2.0 + tint[c] / 6.0)).cast("int").alias(c) for c in "rgb"])


def class_legend(classes: DataFrame) -> DataFrame:
    """Classes in order, each with the name of the next of the fixed colours; classes beyond them are left out."""
    table = classes.sparkSession.createDataFrame([(i, c) for i, c in enumerate(COLOURS)], "i int, colour string")
    numbered = classes.select("class").distinct().withColumn("i", F.row_number().over(Window.orderBy("class")) - 1)
    return numbered.join(F.broadcast(table), "i").select("class", "colour")


def clahe(px: DataFrame, height: int, width: int, clip: float = 2.0, grid: int = 256) -> DataFrame:
    """Contrast-limited equalisation of ``v``: clipped histograms of grid x grid tiles, blended bilinearly.

    Histograms are sums per (slide, tile, value); each pixel meets the four
    tiles around it by an equi-join on (slide, tile, value).
    """
    th, tw, bins = -(-height // grid), -(-width // grid), 256
    tiles = px.select("slide", F.floor(F.col("y") / th).cast("int").alias("ty"), F.floor(F.col("x") / tw).cast("int").alias("tx"), "v")
    hist = tiles.groupBy("slide", "ty", "tx", "v").agg(F.count(F.lit(1)).alias("n"))
    total = hist.groupBy("slide", "ty", "tx").agg(F.sum("n").alias("total"))
    limit = F.greatest(F.lit(1.0), F.lit(clip) * F.col("total") / bins)
    cut = hist.join(total, ["slide", "ty", "tx"]).withColumn("kept", F.least(F.col("n").cast("double"), limit))
    spare = cut.groupBy("slide", "ty", "tx").agg(F.first("total").alias("total"), F.sum(F.col("n") - F.col("kept")).alias("spare"))
    values = px.sparkSession.range(bins).select(F.col("id").cast("int").alias("v"))
    full = spare.crossJoin(F.broadcast(values)).join(cut.select("slide", "ty", "tx", "v", "kept"), ["slide", "ty", "tx", "v"], "left")
    up = Window.partitionBy("slide", "ty", "tx").orderBy("v")
    look = full.select("slide", "ty", "tx", "v", (255.0 * F.sum(F.coalesce("kept", F.lit(0.0)) + F.col("spare") / bins).over(up) / F.col("total")).alias("level"))
    fy, fx = (F.col("y") + 0.5) / th - 0.5, (F.col("x") + 0.5) / tw - 0.5
    placed = px.select(*KEY, "v", F.floor(fy).cast("int").alias("y0"), F.floor(fx).cast("int").alias("x0"), (fy - F.floor(fy)).alias("wy"), (fx - F.floor(fx)).alias("wx"))
    corners = F.array(*[F.struct((F.col("y0") + dy).alias("ty"), (F.col("x0") + dx).alias("tx"), ((F.col("wy") if dy else 1 - F.col("wy")) * (F.col("wx") if dx else 1 - F.col("wx"))).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    near = placed.select(*KEY, "v", F.explode(corners).alias("c")).select(*KEY, "v", F.col("c.ty").alias("ty"), F.col("c.tx").alias("tx"), F.col("c.w").alias("w"))
    # Missing neighbours (edge of the grid, empty tiles) leave their weight to the others.
    return near.join(look, ["slide", "ty", "tx", "v"]).groupBy(*KEY).agg(F.floor(F.sum(F.col("w") * F.col("level")) / F.sum("w") + 0.5).cast("int").alias("v"))


def world_to_voxel(roi: DataFrame, levels: DataFrame) -> DataFrame:
    """World bounds to voxel bounds of each level; ``exact`` tells whether all divide without rest."""
    out = roi.join(levels, "slide")
    bounds = {f"{b}_{a}": (F.col(f"{b}_{a}") - F.col(f"o{a}")) for b in ("begin", "end") for a in "yx"}
    exact = None
    for name, d in bounds.items():
        whole = d % F.col(f"v{name[-1]}") == 0
        exact = whole if exact is None else exact & whole
    return out.select("slide", "level", *[F.floor(d / F.col(f"v{name[-1]}")).cast("long").alias(name) for name, d in bounds.items()], exact.alias("exact"))


def roi_ops(roi: DataFrame, grow: int, height: int, width: int, shift_y: int = 0, shift_x: int = 0, scale: int = 1) -> DataFrame:
    """Grow, clip to the extent, move to a new origin, scale; empty results are left out."""
    y0, x0 = F.greatest(F.col("y0") - grow, F.lit(0)), F.greatest(F.col("x0") - grow, F.lit(0))
    y1, x1 = F.least(F.col("y1") + grow, F.lit(height)), F.least(F.col("x1") + grow, F.lit(width))
    moved = roi.withColumns({"y0": y0, "x0": x0, "y1": y1, "x1": x1}).where("y0 < y1 and x0 < x1")
    return moved.withColumns({"y0": (F.col("y0") - shift_y) * scale, "y1": (F.col("y1") - shift_y) * scale, "x0": (F.col("x0") - shift_x) * scale, "x1": (F.col("x1") - shift_x) * scale})
