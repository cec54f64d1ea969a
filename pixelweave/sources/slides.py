"""Slide catalogue, levels, extents, tiles, layers and reports as tables and files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pixels import KEY
from ..operators.resample import build_pyramid

EXTENSIONS = ("ndpi", "svs", "zarr")

#: Image rows of a layer that are written to one file.
BAND = 1024


def catalog_of(files: DataFrame) -> DataFrame:
    """(slide_id, path, ext) of the files whose suffix is known; others are left out."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)/?$", 1))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+/?$", 1)
    return files.select(stem.alias("slide_id"), "path", ext.alias("ext")).where(F.col("ext").isin(*EXTENSIONS))


def slide_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of a folder; contents aren't read."""
    return catalog_of(spark.read.format("binaryFile").load(path).select("path"))


def slide_stream(spark: SparkSession, path: str) -> DataFrame:
    """New slides as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return catalog_of(spark.readStream.format("binaryFile").schema(schema).load(path).select("path"))


def normalize_resolution(meta: DataFrame) -> DataFrame:
    """Nanometres a pixel: from pixels a centimetre (ndpi) or micrometres a pixel (svs)."""
    return meta.withColumn("nm", F.when(F.col("ext") == "ndpi", F.floor(F.lit(1.0) / F.col("res") * 1e7)).when(F.col("ext") == "svs", F.floor(F.col("res") * 1000)).cast("long"))


def expand_levels(slides: DataFrame, n: int = 5) -> DataFrame:
    """Levels 0..n-1: extents halve, voxels double."""
    each = slides.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    k = F.pow(F.lit(2), F.col("level"))
    return each.withColumns({"height": F.floor(F.col("height") / k).cast("int"), "width": F.floor(F.col("width") / k).cast("int"), "vy": (F.col("vy") * k).cast("long"), "vx": (F.col("vx") * k).cast("long")})


def level_repair_plan(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per expected level: keep it, or regenerate it if wrong or missing."""
    found = actual.select("slide", "level", F.col("height").alias("h"), F.col("width").alias("w"))
    action = F.when(F.col("h").isNull(), "create").when((F.col("h") == F.col("height")) & (F.col("w") == F.col("width")), "keep").otherwise("regenerate")
    return expected.join(found, ["slide", "level"], "left").select("slide", "level", "height", "width", action.alias("action"))


def to_tiles(px: DataFrame, tile: int, channels: str = "rgb", fill: int = 255) -> DataFrame:
    """(slide, ty, tx, h, w, data): dense tiles of unsigned bytes. A group is one tile."""
    kind = px.schema["slide"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.full((tile, tile, len(channels)), fill, np.uint8)
        block[pdf["y"].to_numpy() % tile, pdf["x"].to_numpy() % tile] = pdf[list(channels)].to_numpy(np.uint8)
        return pd.DataFrame({"slide": [key[0]], "ty": [key[1]], "tx": [key[2]], "h": [tile], "w": [tile], "data": [block.tobytes()]})

    keyed = px.select(F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), *KEY, *channels)
    return keyed.groupBy("slide", "ty", "tx").applyInPandas(run, f"slide {kind}, ty int, tx int, h int, w int, data binary")


def from_tiles(tiles: DataFrame, channels: str = "rgb", fill: int = 255) -> DataFrame:
    """Pixels of tiles that aren't the fill in all channels."""
    kind = tiles.schema["slide"].dataType.simpleString()
    n = len(channels)

    def run(batches):
        for pdf in batches:
            for slide, ty, tx, h, w, data in pdf.itertuples(index=False, name=None):
                block = np.frombuffer(data, np.uint8).reshape(h, w, n)
                y, x = np.nonzero((block != fill).any(axis=2))
                yield pd.DataFrame({"slide": slide, "y": y + ty * h, "x": x + tx * w} | {c: block[y, x, i].astype("int32") for i, c in enumerate(channels)})

    return tiles.select("slide", "ty", "tx", "h", "w", "data").mapInPandas(run, f"slide {kind}, y int, x int, " + ", ".join(f"{c} int" for c in channels))


def grid(slides: DataFrame, height: int, width: int) -> DataFrame:
    """All cells of the extent of each slide."""
    rows = slides.select("slide").distinct().select("slide", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select("slide", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def pad_extent(px: DataFrame, height: int, width: int, bottom: int, right: int, fill: int = 255, channels: str = "rgb") -> DataFrame:
    """The dense image of the grown extent; cells without a pixel take the fill."""
    return grid(px, height + bottom, width + right).join(px, KEY, "left").select(*KEY, *[F.coalesce(c, F.lit(fill)).alias(c) for c in channels])


def create_layers(levels: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    """One row per slide and named layer with the extent of its level; the layers themselves are empty."""
    table = levels.sparkSession.createDataFrame(names, "layer string, level int")
    return levels.join(F.broadcast(table), "level").select("slide", "layer", "level", "height", "width")


def write_layer(m: DataFrame, path: str) -> None:
    """Layers as Parquet by slide and layer; only the partitions at hand are replaced. A layer of a slide is one file for each band of ``BAND`` image rows, whatever number of tasks makes its cells."""
    together = m.repartition("slide", "layer", F.floor(F.col("y") / BAND))
    together.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slide", "layer").parquet(path)


def read_layer(spark: SparkSession, path: str, slide: Column | None = None, layer: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    out = out if layer is None else out.where(F.col("layer") == layer)
    return out if slide is None else out.where(F.col("slide") == slide)


def export_level(levels: DataFrame, level: int, path: str) -> None:
    """One level of a pyramid as its own table."""
    levels.where(F.col("level") == level).drop("level").write.mode("overwrite").partitionBy("slide").parquet(path)


def crop(px: DataFrame, y0: int, x0: int, height: int, width: int, pad: int = 0, level: int = 0) -> DataFrame:
    """The region moved to the origin, with white padding scaled to the level."""
    p = pad // 2**level
    inside = select_roi(px, y0, x0, height, width)
    moved = inside.withColumns({"y": F.col("y") - y0 + p, "x": F.col("x") - x0 + p})
    return pad_extent(moved, height + 2 * p, width + 2 * p, 0, 0)


def select_roi(px: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    return px.where((F.col("y") >= y0) & (F.col("y") < y0 + height) & (F.col("x") >= x0) & (F.col("x") < x0 + width))


def region_pyramid(px: DataFrame, y0: int, x0: int, height: int, width: int, n: int = 4) -> DataFrame:
    """The region moved to the origin with its own levels."""
    moved = select_roi(px, y0, x0, height, width).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})
    return build_pyramid(moved, height, width, n - 1)


def upsert_roi(m: DataFrame, patch: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """The mask with a rectangle replaced by the patch's cells above 0."""
    inside = (F.col("y") >= y0) & (F.col("y") < y0 + height) & (F.col("x") >= x0) & (F.col("x") < x0 + width)
    return m.where(~inside).select(*KEY).unionByName(patch.where(inside & (F.col("v") > 0)).select(*KEY))


def write_counts(counts: DataFrame, path: str, title: str) -> None:
    """One whole number a line under a # header, in as many files as there are partitions."""
    counts.select(F.col("n").cast("string")).unionByName(counts.sparkSession.createDataFrame([(f"# {title}",)], "n string")).write.mode("overwrite").text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Sum of the numbers in a counter's files; # lines don't count."""
    return spark.read.option("comment", "#").schema("n bigint").csv(path).agg(F.sum("n").alias("n"))


def report_rows(scores: DataFrame) -> DataFrame:
    """(slide, metric, value) of a wide score table."""
    return scores.unpivot("slide", [c for c in scores.columns if c != "slide"], "metric", "value")


def write_report(scores: DataFrame, path: str) -> None:
    """The report files of a wide score table: one folder a slide, a line for each metric and its value."""
    report_rows(scores).repartition("slide").sortWithinPartitions("slide", "metric").write.mode("overwrite").partitionBy("slide").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(slide, metric, value) of written reports."""
    return spark.read.option("header", True).schema("metric string, value double, slide int").csv(path).select("slide", "metric", "value")


def skip_done(inputs: DataFrame, outputs: DataFrame, suffix: str = "_out") -> DataFrame:
    """Inputs (name) without an output name + suffix, and that are no outputs themselves."""
    return inputs.where(~F.col("name").endswith(suffix)).join(outputs.select(F.regexp_replace("name", f"{suffix}$", "").alias("name")), "name", "left_anti")
