"""Tile scoring with a pluggable scorer.

A scorer takes an array (height, width, channels) with its halo and returns an
array (height, width) of scores. Tiles are dense in memory one at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patches import halo_tiles, paint_center
from .pixels import KEY
from .resample import resize_area, upsample_nearest

Scorer = Callable[[np.ndarray], np.ndarray]


def score_tiles(px: DataFrame, scorer: Scorer, height: int, width: int, tile: int, halo: int = 0, t: float = 0.5, channels: tuple[str, ...] = ("r", "g", "b"), fill: int = 0) -> DataFrame:
    """Pixels whose score is above t. A group is one tile with its halo."""
    kind = px.schema["slide"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(key[1]), int(key[2])
        y0, x0 = ty * tile - halo, tx * tile - halo
        side = tile + 2 * halo
        block = np.full((side, side, len(channels)), float(fill))
        block[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf[list(channels)].to_numpy(float)
        score = scorer(block)[halo : halo + tile, halo : halo + tile]
        y, x = np.nonzero(score > t)
        y, x = y + ty * tile, x + tx * tile
        inside = (y < height) & (x < width)
        return pd.DataFrame({"slide": key[0], "y": y[inside], "x": x[inside], "score": score[score > t][inside]})

    tiles = halo_tiles(px.select(*KEY, *channels), height, width, tile, halo)
    return tiles.groupBy("slide", "ty", "tx").applyInPandas(run, f"slide {kind}, y int, x int, score double")


def mean_scorer(reach: int = 1) -> Scorer:
    """Mean of all channels over the (2 reach + 1) square, divided by 255; zeros beyond the block."""

    def run(block: np.ndarray) -> np.ndarray:
        n, (h, w) = 2 * reach + 1, block.shape[:2]
        s = np.zeros((h + n, w + n))
        s[reach + 1 : reach + 1 + h, reach + 1 : reach + 1 + w] = block.sum(axis=2) if block.shape[2] > 1 else block[:, :, 0]
        np.cumsum(s, axis=0, out=s)
        np.cumsum(s, axis=1, out=s)
        out = s[n:, n:] - s[:-n, n:]
        out -= s[n:, :-n]
        out += s[:-n, :-n]
        return out / (255.0 * block.shape[2] * n * n)

    return run


def classify_patches(patches: DataFrame, score: Callable[[pd.DataFrame], np.ndarray], size: int, spacing: int) -> DataFrame:
    """Class by highest score per patch (slide, y, x, features), then the central squares of class 1."""
    kind = patches.schema["slide"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"slide": pdf["slide"], "y": pdf["y"], "x": pdf["x"], "class": np.argmax(score(pdf), axis=1).astype("int32")})

    return paint_center(patches.mapInPandas(run, f"slide {kind}, y int, x int, class int"), size, spacing)


def score_images(px: DataFrame, scorer: Scorer, height: int, width: int, side: int, border: int, factor: int, t: float = 0.5) -> DataFrame:
    """Resize to side x side, white border, score, cut the border, enlarge by a whole factor."""
    small = resize_area(px, height, width, side, side)
    moved = small.withColumns({"y": F.col("y") + border, "x": F.col("x") + border})
    whole = side + 2 * border
    scored = score_tiles(moved, scorer, whole, whole, whole, 0, t, fill=255)
    cut = scored.where((F.col("y") >= border) & (F.col("y") < side + border) & (F.col("x") >= border) & (F.col("x") < side + border))
    return upsample_nearest(cut.select("slide", (F.col("y") - border).alias("y"), (F.col("x") - border).alias("x")), factor, factor)
