"""Layers of several levels in one pass over the tiles, and what follows from them tile by tile."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import filters, neighborhood, scoring, tiles, words
from pixelweave.plans import slide_plan

from .test_slide_plan import SCORERS, SIDE, SIZES, H, W, disk, eroded, halved, images, moved, tiled  # noqa: F401


def cells(df, name="bits"):
    return {(r.slide, r.y, r.x) for r in words.to_pixels(df.select(*words.PLACE, F.col(name).alias("bits"))).collect()}


def test_the_pipeline_reads_each_tile_once(spark, images):  # noqa: F811
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    level1 = tiled(spark, images)
    n = level1.count()
    assert slide_plan.slide_scores(level1.mapInArrow(count, level1.schema), H, W, SIDE, SCORERS, SIZES).count() == 2
    assert seen.value == n


def test_layers_equal_scores_level_by_level(spark, images):  # noqa: F811
    scorer = scoring.mean_scorer(3)
    side, halo = 128, 20
    t = tiled(spark, images, side)
    own = lambda n: lambda block, ty, tx: scorer(block.astype(float))[halo : halo + n, halo : halo + n] > 0.5
    got = tiles.layers(t, {1: (halo, {"a": own(side)}), 2: (halo, {"b": own(side // 2), "low": lambda block, ty, tx: block[halo:-halo, halo:-halo, 0] < 90})}, H, W, side)
    level2 = tiles.coarser(t)
    want = {"a": (1, tiles.score(t, scorer, H, W, side, halo)), "b": (2, tiles.score(level2, scorer, H // 2, W // 2, side // 2, halo)), "low": (2, tiles.mask(level2, lambda a: a[:, :, 0] < 90, H // 2, W // 2))}
    for name, (k, one) in want.items():
        assert cells(got.where(f"k = {k}"), name) == cells(one) != set()
    assert got.groupBy("slide", "k", "y", "w").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError, match="halo"):
        tiles.layers(t, {2: (side // 2 + 1, {"a": own(side)})}, H, W, side)


def test_tissue_where_its_steps_reach_beyond_a_tile(spark, images):  # noqa: F811
    wide = dataclasses.replace(SIZES, fill=31, shrink=28, erode=6)
    for sizes in (SIZES, wide):
        found = slide_plan.level_masks(tiled(spark, images), H, W, SIDE, SCORERS, sizes)
        want = set()
        for s, a in enumerate(images):
            m = ~(halved(halved(a)) > 255 - sizes.white).all(axis=2)
            m = eroded(eroded(moved(m, disk(sizes.fill)), disk(sizes.shrink)), disk(sizes.erode))
            want |= {(s, int(y), int(x)) for y, x in zip(*np.nonzero(m))}
        assert cells(slide_plan.layer(found, 4, "tissue")) == want != set()


def test_map_levels_equals_enlarged_arrays(spark):
    r = np.random.default_rng(3)
    h, w = 150, 200
    a, b = r.random((h, w)) < 0.2, r.random((h // 2, w // 2)) < 0.1
    rows = lambda m: spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(m))], "slide int, y int, x int")
    zero = F.lit(0).cast("long")
    both = words.from_pixels(rows(a)).select("slide", F.lit(1).alias("k"), "y", "w", F.col("bits").alias("a"), zero.alias("b"))
    both = both.unionByName(words.from_pixels(rows(b)).select("slide", F.lit(2).alias("k"), "y", "w", zero.alias("a"), F.col("bits").alias("b")))
    f = lambda m, touch: {"a": filters.inner(m["a"], 3, touch), "near": filters.dilated(m["a"] & m["b"], neighborhood.disk(3), touch)}
    got = filters.map_levels(both, ["a", "b"], 3, h, w, f, ["a", "near"], tile=64)
    near = moved(a & b.repeat(2, 0).repeat(2, 1), disk(3))
    for name, m in (("a", a), ("near", near)):
        assert cells(got, name) == {(0, int(y), int(x)) for y, x in zip(*np.nonzero(m))}
    with pytest.raises(ValueError, match="tiles"):
        filters.map_levels(both, ["a", "b"], 3, h, w, f, ["a"], tile=50)


def test_complement_of_words(spark):
    m = np.random.default_rng(4).random((5, 130)) < 0.5
    one = words.from_pixels(spark.createDataFrame([(7, int(y), int(x)) for y, x in zip(*np.nonzero(m))], "slide int, y int, x int"))
    assert cells(words.complement(one, 5, 130)) == {(7, int(y), int(x)) for y, x in zip(*np.nonzero(~m))}


def test_dilated_by_shapes():
    a = np.random.default_rng(5).random((40, 60)) < 0.03
    for shape, offsets in ((neighborhood.disk(4), disk(4)), (neighborhood.ELLIPSE_5, [(dy, dx) for dy, n in ((-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)) for dx in range(-n, n + 1)]), (neighborhood.PLUS, disk(1))):
        assert (filters.dilated(a, shape, (True,) * 4) == moved(a, offsets)).all()
        assert (filters.eroded(a, shape, (True,) * 4) == eroded(a, offsets)).all()
