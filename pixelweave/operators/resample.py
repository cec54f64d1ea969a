"""Resampling: means, block masks, nearest and area resizing, pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import KEY


def _down(c: str, k: int):
    return F.floor(F.col(c) / k).cast("int").alias(c)


def coarsen_mean(px: DataFrame, height: int, width: int, k: int = 2, channels: str = "rgb") -> DataFrame:
    """k x k means, cut to whole numbers; an odd edge is trimmed. Absent pixels count as white."""
    inside = px.where((F.col("y") < height // k * k) & (F.col("x") < width // k * k))
    cells = k * k
    mean = lambda c: F.floor((F.sum(c) + 255 * (cells - F.count(F.lit(1)))) / cells).cast("int").alias(c)
    return inside.groupBy("slide", _down("y", k), _down("x", k)).agg(*[mean(c) for c in channels])


def downsample_mask(m: DataFrame, k: int, mode: str = "all") -> DataFrame:
    """A block is set if all (``all``), any (``any``) or half or more (``mean``) of its cells are."""
    need = {"all": k * k, "any": 1, "mean": k * k / 2}[mode]
    return m.groupBy("slide", _down("y", k), _down("x", k)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select(*KEY)


def upsample_nearest(m: DataFrame, fy: int, fx: int) -> DataFrame:
    each = lambda c, f: F.explode(F.sequence(F.col(c) * f, F.col(c) * f + (f - 1)))
    rest = [c for c in m.columns if c not in ("y", "x")]
    rows = m.select(*rest, "x", each("y", fy).alias("y"))
    return rows.select(*rest, "y", each("x", fx).alias("x")).select(*m.columns)


def upsample_runs(runs: DataFrame, fy: int, fx: int) -> DataFrame:
    """Runs keep one row per row of the image: only y is repeated."""
    return runs.select("slide", F.explode(F.sequence(F.col("y") * fy, F.col("y") * fy + (fy - 1))).alias("y"), (F.col("x0") * fx).alias("x0"), (F.col("x1") * fx + (fx - 1)).alias("x1"))


def resize_nearest(px: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Each target cell takes floor((i + 0.5) * size / target): a table of target rows and columns meets the source rows it names."""
    spark = px.sparkSession
    axis = lambda name, n, to: spark.range(to).select(F.col("id").cast("int").alias(f"to_{name}"), F.floor((F.col("id") + 0.5) * n / to).cast("int").alias(name))
    rest = [c for c in px.columns if c not in KEY]
    # One row per target row or column: bounded by the image's side.
    out = px.join(F.broadcast(axis("y", height, to_height)), "y").join(F.broadcast(axis("x", width, to_width)), "x")
    return out.select("slide", F.col("to_y").alias("y"), F.col("to_x").alias("x"), *rest)


def resize_area(px: DataFrame, height: int, width: int, to_height: int, to_width: int, channels: str = "rgb") -> DataFrame:
    """Means weighted by the overlap of source and target cells; absent pixels are white."""

    def spans(c: str, n: int, to: int):
        low, high = F.floor(F.col(c) * to / n).cast("int"), F.ceil((F.col(c) + 1) * to / n).cast("int") - 1
        return F.transform(F.sequence(low, high), lambda t: F.struct(t.alias("t"), (F.least((F.col(c) + 1) / n, (t + 1) / to) - F.greatest(F.col(c) / n, t / to)).alias("w")))

    rows = px.select("*", F.explode(spans("y", height, to_height)).alias("down")).select("*", F.explode(spans("x", width, to_width)).alias("across"))
    w = F.col("down.w") * F.col("across.w") * (to_height * to_width)
    mean = lambda c: F.floor(F.round(F.sum(w * (F.col(c) - 255)), 6) + 255 + 0.5).cast("int").alias(c)
    return rows.groupBy("slide", F.col("down.t").alias("y"), F.col("across.t").alias("x")).agg(*[mean(c) for c in channels])


def limit_dim(px: DataFrame, height: int, width: int, most: int = 2048) -> tuple[DataFrame, int, int]:
    """The image with its longest side cut to ``most``, and its new size."""
    side = max(height, width)
    if side <= most:
        return px, height, width
    to = max(1, height * most // side), max(1, width * most // side)
    return resize_area(px, height, width, *to), *to


def restore_mask(m: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """A mask of a limited image back at full size: opacity ``v`` of 1..255 by bilinear weights of the cells around."""
    spark = m.sparkSession

    def axis(name: str, n: int, to: int) -> DataFrame:
        # Two rows a target row or column: bounded by the image's side.
        at = (F.col("id") + 0.5) * n / to - 0.5
        low, part = F.floor(at), at - F.floor(at)
        ends = F.array(F.struct(low.alias("c"), (1 - part).alias("w")), F.struct((low + 1).alias("c"), part.alias("w")))
        rows = spark.range(to).select(F.col("id").cast("int").alias(f"to_{name}"), F.explode(ends).alias("k"))
        held = F.least(F.greatest(F.col("k.c"), F.lit(0)), F.lit(n - 1)).cast("int")
        return F.broadcast(rows.select(f"to_{name}", held.alias(name), F.col("k.w").alias(f"w_{name}")))

    near = m.select(*KEY).join(axis("y", height, to_height), "y").join(axis("x", width, to_width), "x")
    v = F.floor(F.round(255 * F.sum(F.col("w_y") * F.col("w_x")), 6) + 0.5).cast("int")
    return near.groupBy("slide", F.col("to_y").alias("y"), F.col("to_x").alias("x")).agg(v.alias("v")).where("v > 0")


def build_pyramid(px: DataFrame, height: int, width: int, n: int = 4) -> DataFrame:
    """Levels 0..n: each level is the 2 x 2 mean of the one before, written once and read by the next."""
    from ..sources.tables import stored

    out, now = px.select(F.lit(0).alias("level"), *KEY, "r", "g", "b"), px
    for level in range(1, n + 1):
        now = stored(coarsen_mean(now, height, width), "level")
        height, width = height // 2, width // 2
        out = out.unionByName(now.select(F.lit(level).alias("level"), *KEY, "r", "g", "b"))
    return out
