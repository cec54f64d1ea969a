"""Tiles on disk, laid out so that a region reads only what it touches.

A table of tiles is partitioned by slide, level and row of tiles, and sorted by
column inside: a region prunes folders by its rows and row groups by its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .slides import from_tiles, select_roi


def write_tiles(tiles: DataFrame, path: str, level: int = 0) -> None:
    """Add one level of slides (slide, ty, tx, h, w, data) to the store; the rows of tiles at hand are replaced."""
    rows = tiles.withColumn("level", F.lit(level)).repartition("slide", "level", "ty").sortWithinPartitions("slide", "level", "ty", "tx")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slide", "level", "ty").parquet(path)


def read_tiles(spark: SparkSession, path: str, level: int = 0, slide: int | str | None = None, box: tuple[int, int, int, int] | None = None, tile: int = 256, halo: int = 0) -> DataFrame:
    """Tiles of a level; with ``box`` (y0, x0, height, width) those that it, grown by the halo, touches."""
    out = spark.read.parquet(path).where(F.col("level") == level)
    if slide is not None:
        out = out.where(F.col("slide") == slide)
    if box is not None:
        y0, x0, height, width = box
        inside = lambda c, low, n: F.col(c).between((low - halo) // tile, (low + n - 1 + halo) // tile)
        out = out.where(inside("ty", y0, height) & inside("tx", x0, width))
    return out.select("slide", "ty", "tx", "h", "w", "data")


def read_region(spark: SparkSession, path: str, slide: int | str, box: tuple[int, int, int, int], level: int = 0, tile: int = 256) -> DataFrame:
    """Pixels of a region of one slide."""
    return select_roi(from_tiles(read_tiles(spark, path, level, slide, box, tile)), *box)
