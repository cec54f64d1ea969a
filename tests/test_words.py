"""Masks as words: round trips, labels by tiles, distances; each against brute force, at sizes with many words and tiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import algebra, components, distance, metrics, neighborhood, objects, words
from pixelweave.plans import presets, raster, registry

D = "/root/testdata/sf0.001"


def pixels(spark, *grids):
    rows = [np.stack([np.full(g.sum(), s), *np.nonzero(g)], 1) for s, g in enumerate(grids)]
    return spark.createDataFrame(pd.DataFrame(np.concatenate(rows), columns=["slide", "y", "x"]).astype("int32"))


def cells(df):
    return {(r.slide, r.y, r.x) for r in df.collect()}


def brute_labels(grid, conn=8, block=None):
    """Flood fill; labels are the least y * width + x."""
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (conn == 8 or not dy * dx)]
    out = np.full(grid.shape, -1)
    for y, x in zip(*np.nonzero(grid)):
        if out[y, x] >= 0:
            continue
        todo, out[y, x] = [(y, x)], y * grid.shape[1] + x
        while todo:
            cy, cx = todo.pop()
            for dy, dx in near:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < grid.shape[0] and 0 <= nx < grid.shape[1] and grid[ny, nx] and out[ny, nx] < 0 and (not block or (ny // block, nx // block) == (cy // block, cx // block)):
                    out[ny, nx] = out[y, x]
                    todo.append((ny, nx))
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(3).random((90, 200)) < 0.45


@pytest.fixture(scope="module")
def m(spark, noise):
    return pixels(spark, noise, ~noise)


def test_round_trips(m):
    want, w = cells(m), words.from_pixels(m)
    assert cells(words.to_pixels(w)) == want
    runs = words.to_runs(w)
    assert cells(neighborhood.from_runs(runs)) == want
    assert cells(words.to_pixels(words.from_runs(runs))) == want
    whole = m.sparkSession.createDataFrame([(0, 3, 5, 400), (0, 4, 0, 63), (0, 5, 64, 64), (0, 6, 63, 128)], "slide int, y int, x0 int, x1 int")
    assert cells(words.to_pixels(words.from_runs(whole))) == cells(neighborhood.from_runs(whole))
    assert sorted((r.y, r.x0, r.x1) for r in words.to_runs(words.from_runs(whole)).where("y > 3").collect()) == [(4, 0, 63), (5, 64, 64), (6, 63, 63), (6, 64, 127), (6, 128, 128)]


def test_words_cut_at_squares_keep_each_cell_once(m):
    want = cells(m)
    for side in (7, 20, 64, 100, 1000):
        part = words.cut(words.from_pixels(m), side, ["bits"])
        assert part.agg(F.sum(F.bit_count("bits"))).first()[0] == len(want)
        assert cells(words.to_pixels(part)) == want
        x = words.to_pixels(part.where("bx = 1 AND bits != 0")).select("x").distinct().collect()
        assert all(side <= r.x < 2 * side for r in x)


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("tile", [64, 1024, 30])
def test_labels_by_tiles(m, noise, conn, tile):
    got = {(r.slide, r.y, r.x): r.label for r in objects.label(m, 200, conn, tile=tile).collect()}
    want = {(s, y, x): v for s, g in enumerate((noise, ~noise)) for (y, x), v in np.ndenumerate(brute_labels(g, conn)) if v >= 0}
    assert got == want


def test_labels_end_at_blocks(m, noise):
    got = {(r.slide, r.y, r.x): r.label for r in objects.label(m, 200, 8, block=17, tile=40).collect()}
    assert got == {(s, y, x): v for s, g in enumerate((noise, ~noise)) for (y, x), v in np.ndenumerate(brute_labels(g, 8, 17)) if v >= 0}


def spiral(side, gap=4):
    """One cell wide, turn after turn, ``gap`` apart."""
    g = np.zeros((side, side), bool)
    y, x, d, lo, hi = 0, 0, 0, 0, side - 1
    while lo < hi:
        g[lo, max(0, lo - gap) : hi + 1] = True
        g[lo : hi + 1, hi] = True
        g[hi, lo : hi + 1] = True
        g[lo + gap : hi + 1, lo] = True
        lo, hi = lo + gap, hi - gap
    return g


def test_rounds_follow_the_tiles_not_the_bends(spark, monkeypatch):
    g = spiral(640)
    rounds = []
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df, tag: (rounds.append(tag), keep(df, tag))[1])
    runs = components.label_words(words.from_pixels(pixels(spark, g)), 640, 4, tile=64)
    assert runs.select("label").distinct().count() == 1 and runs.agg(F.sum(F.col("x1") - F.col("x0") + 1)).first()[0] == g.sum()
    # 10 x 10 tiles; about 80 turns of up to 640 rows.
    assert rounds.count("labels") // 2 <= 24, rounds


def test_one_tile_needs_no_round(spark, m, monkeypatch):
    tags = []
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df, tag: (tags.append(tag), keep(df, tag))[1])
    assert components.label_words(words.from_pixels(m), 200).count() and tags == ["runs", "links"]
    tags.clear()
    plan = objects.filter_fibrosis(m, 3, 200, 20)._jdf.queryExecution().executedPlan().toString()
    assert not tags and "Join" in plan  # sizes are joined to the runs, but there are no rounds


def test_small_objects_go_per_block(spark, noise):
    thin = noise & (np.random.default_rng(9).random(noise.shape) < 0.6)
    w = words.joined({"a": words.from_pixels(pixels(spark, thin)), "b": words.from_pixels(pixels(spark, noise))})
    for block, tile in ((16, 40), (100, 64), (33, 1024)):
        got = components.drop_small(w, "a", 4, block, ["a", "b"], tile)
        labels = brute_labels(thin, 8, block)
        sizes = {}
        for (y, x), v in np.ndenumerate(labels):
            if v >= 0:
                sizes[v, y // block, x // block] = sizes.get((v, y // block, x // block), 0) + 1
        want = sum(n for n in sizes.values() if n > 4)
        assert got.agg(F.sum(F.bit_count("a")), F.sum(F.bit_count("b"))).first()[:] == (want, noise.sum())


def test_algebra_runs_no_python_and_moves_few_rows(spark):
    query = registry.queries()
    for name in ("preset_omniseg", "c11_interstitium", "k1_block_fib_counts", "k3_block_inflamm_counts"):
        plan = query[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    px = raster.layers(raster.pix(spark, D))
    plan = algebra.stack(px)._jdf.queryExecution().executedPlan().toString()
    # Rows of an image lie together after the one shuffle that makes them.
    assert plan.count("Exchange") == 1
    stacked = algebra.stack(px)
    assert stacked.count() * 20 < px.count()
    plan = presets.slide_scores(px, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Join" not in plan


def test_algebra_without_layers(spark, m):
    none = algebra.stack(m.withColumn("layer", F.lit("unknown")))
    assert none.count() == 0 and metrics.block_fib_counts(none, 20).count() == 0
    more = algebra.stack(m.withColumn("layer", F.lit("cap")), {"tubule": m.where("y < 5")})
    assert algebra.where(more, algebra.has("tubule")).count() == m.where("y < 5").count()
    assert {r.bits for r in algebra.pixel_bits(more).select("bits").distinct().collect()} == {32, 48}


def brute_distances(a, b):
    q = np.argwhere(b)
    return {(y, x): int(((q - (y, x)) ** 2).sum(axis=1).min()) for y, x in np.argwhere(a)}


def test_distances(spark, noise):
    r = np.random.default_rng(4)
    for n in (1, 3, 40, 3000):
        a, b = np.zeros((150, 300), bool), np.zeros((150, 300), bool)
        a[r.integers(0, 150, 400), r.integers(0, 300, 400)] = True
        b[r.integers(0, 150, n), r.integers(0, 300, n)] = True
        got = distance.squared_distances(words.from_pixels(pixels(spark, a)), words.from_pixels(pixels(spark, b)), 150)
        assert {(x.y, x.x): x.d2 for x in got.collect()} == brute_distances(a, b)
    one = words.from_pixels(pixels(spark, noise, noise))
    assert {x.slide for x in distance.squared_distances(one, one.where("slide = 1"), 90).collect()} == {1}
    assert distance.squared_distances(one.limit(0), one, 90).count() == 0


def test_surfaces_and_their_distance(spark, noise):
    grown = np.kron(noise[:30, :60], np.ones((5, 5), bool)).astype(bool)
    pad = np.pad(grown, 1)
    inner = grown & pad[2:, 1:-1] & pad[:-2, 1:-1] & pad[1:-1, 2:] & pad[1:-1, :-2]
    s = cells(metrics.surface(pixels(spark, grown), *grown.shape))
    assert s == {(0, y, x) for y, x in np.argwhere(grown & ~inner)}
    plan = metrics.surface_distance(pixels(spark, grown), pixels(spark, ~grown), *grown.shape)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2 and plan.count("Join") <= 1  # the one that adds slides without a surface
