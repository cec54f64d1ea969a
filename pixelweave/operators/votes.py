"""Merging of overlapping window predictions by votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .pixels import KEY
from .resample import upsample_nearest


def window_votes(preds: DataFrame, size: int, edge: int) -> DataFrame:
    """(slide, task, y, x, n): windows (wy, wx) whose pixel (py, px), off the border, scores class 1 above class 0."""
    inner = (F.col("py") >= edge) & (F.col("py") < size - edge) & (F.col("px") >= edge) & (F.col("px") < size - edge)
    return preds.where(inner & (F.col("score1") > F.col("score0"))).groupBy("slide", "task", (F.col("wy") + F.col("py")).alias("y"), (F.col("wx") + F.col("px")).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def majority(votes: DataFrame, n: int) -> DataFrame:
    return votes.where(F.col("n") >= n)


def unpad(m: DataFrame, pad: int, height: int, width: int) -> DataFrame:
    """Rows inside the padded frame, moved to its origin."""
    inside = (F.col("y") >= pad) & (F.col("y") < height - pad) & (F.col("x") >= pad) & (F.col("x") < width - pad)
    return m.where(inside).withColumns({"y": F.col("y") - pad, "x": F.col("x") - pad})


def merge_slices(preds: DataFrame, size: int, edge: int) -> DataFrame:
    """Per task the sum of 0/1 predictions of patches at (y0, x0), border left out."""
    py, px = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    inner = (py >= edge) & (py < size - edge) & (px >= edge) & (px < size - edge)
    return preds.where(inner).groupBy("slide", "task", "y", "x").agg(F.sum("pred").alias("n"))


def mask_votes(votes: DataFrame, tissue: DataFrame) -> DataFrame:
    return votes.join(tissue.select(*KEY), KEY, "left_semi")


def other_class(votes: DataFrame, grid: DataFrame, other: int = 6, weight: int = 7) -> DataFrame:
    """Votes plus ``weight`` for the other class wherever the rest has none."""
    voted = votes.where((F.col("task") < other) & (F.col("n") > 0)).select(*KEY).distinct()
    none = grid.select(*KEY).join(voted, KEY, "left_anti")
    return votes.where(F.col("task") != other).select(*KEY, "task", F.col("n").cast("long").alias("n")).unionByName(none.select(*KEY, F.lit(other).alias("task"), F.lit(weight).cast("long").alias("n")))


def argmax_class(votes: DataFrame) -> DataFrame:
    """Task with most votes; ties go to the lowest."""
    return votes.groupBy(*KEY).agg(F.max_by("task", F.struct(F.col("n"), -F.col("task"))).alias("class"))


def task_layers(classes: DataFrame, votes: DataFrame, names: dict[int, str], capsule: tuple[int, ...] = (2, 3), tuft: int = 3, at_least: int = 2) -> DataFrame:
    """(slide, layer, y, x): a layer a class, the capsule from its classes, and the tuft where it has votes inside the capsule."""
    code = F.coalesce(*[F.when(F.col("class") == k, v) for k, v in names.items() if k not in capsule], F.when(F.col("class").isin(*capsule), "capsule"))
    layers = classes.select("slide", code.alias("layer"), "y", "x").where("layer is not null")
    inside = classes.where(F.col("class").isin(*capsule)).select(*KEY)
    tufts = votes.where((F.col("task") == tuft) & (F.col("n") >= at_least)).select(*KEY).intersect(inside)
    return layers.unionByName(tufts.select("slide", F.lit("tuft").alias("layer"), "y", "x"))


def segmented(preds: DataFrame, tissue: DataFrame, size: int, edge: int, pad: int, side: int, factor: int, names: dict[int, str], capsule: tuple[int, ...] = (2, 3), tuft: int = 3, at_least: int = 2, other: int = 6) -> DataFrame:
    """(slide, layer, y, x): window predictions of a padded image of the given side to its layers at the final size.

    Windows vote, the padding goes, the votes are enlarged by a whole factor and kept
    to the tissue (at the final size); cells without a vote are of the other class, the
    rest of the task with most votes.
    """
    votes = unpad(window_votes(preds, size, edge), pad, side, side)
    votes = stored(mask_votes(upsample_nearest(votes, factor, factor), tissue), "votes")
    whole = factor * (side - 2 * pad)
    slides = tissue.select("slide").distinct()
    rows = slides.select("slide", F.explode(F.sequence(F.lit(0), F.lit(whole - 1))).alias("y"))
    told = other_class(votes, rows.select("slide", "y", F.explode(F.sequence(F.lit(0), F.lit(whole - 1))).alias("x")), other)
    return task_layers(argmax_class(told), told, names, capsule, tuft, at_least)
