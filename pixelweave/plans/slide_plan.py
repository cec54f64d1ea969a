"""The slide pipeline as one plan: from tiles of pixels over foreground, scorers, clean-up, enlargement and shells to the scores.

Three levels take part: the finest (1), half (2) and a quarter (3) of it.
Scorers stand for the segmentation models: functions of an array with its halo.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import algebra, filters, neighborhood, objects, tiles, words
from ..operators.scoring import Scorer
from ..sources.tables import stored
from . import presets


@dataclass(frozen=True)
class Sizes:
    """Thresholds, radii and areas as published, each at the level where it is applied."""

    white: int = 50
    fill: int = 31
    shrink: int = 28
    erode: int = 40
    saturation: int = 30
    value: int = 210
    small: int = 2000
    hole: int = 5000
    ring: int = 5
    membrane: tuple[int, int] = (2, 7)
    capsule: tuple[int, int] = (8, 25)
    halo: int = 208
    block: int = 2000
    drop_up_to: int = 100


def foreground(a: np.ndarray, white: int) -> np.ndarray:
    return ~(a > 255 - white).all(axis=2)


def pale(a: np.ndarray, saturation: int, value: int) -> np.ndarray:
    """Pale and bright cells, by saturation and value on 0..255."""
    v, low = (reduce(f, (a[:, :, i] for i in range(a.shape[2]))).astype(np.int32) for f in (np.maximum, np.minimum))
    # floor((v - low) * 255 / v + 0.5) < saturation, in whole numbers.
    return np.where(v == 0, saturation > 0, (v - low) * 510 < (2 * saturation - 1) * v) & (v > value)


def level_masks(level1: DataFrame, height: int, width: int, side: int, scorers: dict[str, tuple[Scorer, float]], sizes: Sizes) -> DataFrame:
    """(slide, k, y, w, tissue, background, cortex, tubule, cap, vessel, nuclei): what follows from a tile and its neighbours, each layer at its own level (cells of k x k), in one pass over the pixels."""
    s = sizes
    close = s.fill + s.shrink + s.erode

    def tissue(a: np.ndarray, touch) -> np.ndarray:
        filled = filters.eroded(filters.dilated(foreground(a, s.white), neighborhood.disk(s.fill), touch), neighborhood.disk(s.shrink), touch)
        return filters.eroded(filled, neighborhood.disk(s.erode), touch)

    def clean(a: np.ndarray, touch) -> np.ndarray:
        out = pale(a, s.saturation, s.value)
        for step in (filters.eroded, filters.dilated, *[filters.dilated] * 3, *[filters.eroded] * 3):
            out = step(out, neighborhood.ELLIPSE_5, touch)
        return out

    def level(k: int, reaches: dict[str, tuple[int, object]], scored: list[str]) -> tuple[int, dict]:
        n, h, w = side // k, height // k, width // k
        around = min(s.halo, n)
        halo = max(around, *(r for r, _ in reaches.values()), 0) if reaches else around

        def of(name: str):
            scorer, t = scorers[name]
            cut = slice(halo - around, halo + n + around)
            return lambda block, ty, tx: scorer(block[cut, cut].astype(float))[around : around + n, around : around + n] > t

        parts = {name: (lambda block, ty, tx, r=r, f=f: filters.of_block(block, ty, tx, n, halo, r, h, w, f)) for name, (r, f) in reaches.items()}
        return halo, parts | {name: of(name) for name in scored}

    # Where the steps of the foreground reach further than a tile of its level, they follow on its words.
    wide = close > side // 4
    ground = (0, lambda a, touch: foreground(a, s.white)) if wide else (close, tissue)
    found = stored(tiles.layers(level1, {1: level(1, {"background": (16, clean)}, ["nuclei"]), 2: level(2, {}, ["tubule", "cap", "vessel"]), 4: level(4, {"tissue": ground}, ["cortex"])}, height, width, side), "layers")
    if not wide:
        return found
    h, w = height // 4, width // 4

    def grown(a: list[np.ndarray], touch) -> np.ndarray:
        filled = filters.eroded(filters.dilated(a[0], neighborhood.disk(s.fill), touch), neighborhood.disk(s.shrink), touch)
        return filters.eroded(filled, neighborhood.disk(s.erode), touch)

    done = words.from_pixels(filters.map_masks(layer(found, 4, "tissue"), ["bits"], close, h, w, grown))
    return found.withColumn("tissue", F.lit(0).cast("long")).unionByName(at_level(done, 4, "tissue", found.columns))


def layer(found: DataFrame, k: int, name: str) -> DataFrame:
    """Words of one layer."""
    return found.where((F.col("k") == k) & (F.col(name) != 0)).select(*words.PLACE, F.col(name).alias("bits"))


def at_level(w: DataFrame, k: int, name: str, columns: list[str]) -> DataFrame:
    """Words of one mask as rows of a table with a column for each layer."""
    zero = F.lit(0).cast("long")
    return w.select([F.lit(k).alias("k") if c == "k" else F.col(c) if c in words.PLACE else (F.col("bits") if c == name else zero).alias(c) for c in columns])


def masks(level1: DataFrame, height: int, width: int, side: int, scorers: dict[str, tuple[Scorer, float]], sizes: Sizes) -> DataFrame:
    """(slide, k, y, w, one column a layer): tissue, background, cortex, tubule, cap, vessel, vessel_dilated, nuclei, as the pipeline has them before restriction, each at its own level."""
    s, zero = sizes, F.lit(0).cast("long")
    h, w = height // 2, width // 2
    found = level_masks(level1, height, width, side, scorers, s)
    cap = stored(words.from_runs(objects.of_size_at_least(layer(found, 2, "cap"), s.small, w)), "cap")
    vessel = stored(objects.of_size_at_least(layer(found, 2, "vessel"), s.small, w), "vessel")
    found = found.withColumns({"cap": zero, "vessel": zero, "vessel_dilated": zero})
    filled = cap.unionByName(objects.holes_of_less(cap, s.hole, h, w)).groupBy(*words.PLACE).agg(F.bit_or("bits").alias("bits"))
    more = [(filled, "cap"), (words.from_runs(vessel), "vessel"), (objects.scaled_rings(vessel, h, w, s.ring), "vessel_dilated")]
    for bits, name in more:
        found = found.unionByName(at_level(bits, 2, name, found.columns))
    return found


def slide_scores(level1: DataFrame, height: int, width: int, side: int, scorers: dict[str, tuple[Scorer, float]], sizes: Sizes | None = None) -> DataFrame:
    """Scores of each slide of ``level1`` (tiles of ``side``, a multiple of 256; height and width multiples of 4).

    ``scorers`` gives a scorer and its threshold for cortex, cap, tubule, vessel and nuclei.
    """
    s = sizes or Sizes()
    found = masks(level1, height, width, side, scorers, s)
    names = [c for c in found.columns if c not in (*words.PLACE, "k")]
    smooth = neighborhood.weights(2.0)
    reach = {m: sum(radii) + len(smooth) // 2 for m, radii in (("tubule", s.membrane), ("cap", s.capsule))}
    most = max(reach.values())

    def shells(a: dict[str, np.ndarray], touch) -> dict[str, np.ndarray]:
        """All layers, the dilated vessel without the vessel, and the shells of tubule and cap as they are after restriction."""
        keep = a["cortex"] & ~a["background"]
        of = {"tubule": a["tubule"] & keep, "cap": a["cap"] & keep & ~a["tubule"]}
        shell = lambda m, radii: neighborhood.shell_array({n: filters.inner(x, most - reach[m], touch) for n, x in (("m", of[m]), ("nuclei", a["nuclei"]))}, *radii, m == "tubule", smooth, touch)
        own = {n: filters.inner(x, most, touch) for n, x in a.items()}
        return own | {"vessel_dilated": own["vessel_dilated"] & ~own["vessel"], "tbm": shell("tubule", s.membrane), "bc": shell("cap", s.capsule)}

    stacked = filters.map_levels(found, names, most, height, width, shells, [*names, "tbm", "bc"])
    zero = F.lit(0).cast("long")
    return presets.scores_of_stack(stacked.withColumns({n: zero for n in algebra.LAYERS if n not in stacked.columns}), s.block, "final", s.drop_up_to)
