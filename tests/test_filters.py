"""Tile filters, patch sums, coverage, quantiles and exact k-means, against brute force over whole arrays and many tiles."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import clusters, filters, metrics, neighborhood, patches, words
from pixelweave.operators.pixels import KEY
from pixelweave.operators.quantiles import grouped_quantiles
from pixelweave.sources.tables import stored

H, W = 70, 150


def frame(spark, a, where, slide=0):
    y, x = np.nonzero(where)
    return spark.createDataFrame(pd.DataFrame({"slide": np.full(len(y), slide, np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": a[y, x]}))


def array(df, name="v"):
    rows = df.collect()
    out = np.full((H, W), np.nan)
    for r in rows:
        assert math.isnan(out[r.y, r.x])
        out[r.y, r.x] = r[name]
    return out


@pytest.fixture(scope="module")
def gray():
    r = np.random.default_rng(8)
    return r.integers(0, 255, (H, W)).astype(np.int32), r.random((H, W)) < 0.6


def whole(a, wy, wx):
    p = np.pad(a.astype(float), ((len(wy) // 2,) * 2, (len(wx) // 2,) * 2), mode="symmetric")
    return sum(wy[i] * wx[j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(len(wy)) for j in range(len(wx)))


@pytest.mark.parametrize("tile", [16, 33, 512])
def test_weights_over_tiles(spark, gray, tile):
    v, has = gray
    for sigma in (1.0, 3.5):
        w = neighborhood.weights(sigma)
        got = array(filters.separable(frame(spark, v, has), w, w, H, W, tile))
        assert np.nanmax(np.abs(got - whole(v * has, w, w))) < 1e-9 and not np.isnan(got).any()
    lone = np.zeros((H, W), bool)
    lone[20, 30] = lone[0, 149] = True
    w = np.ones(5) / 5
    got = array(filters.separable(frame(spark, v, lone), w, w, H, W, tile))
    want = whole(lone, np.ones(5), np.ones(5)) > 0
    assert np.array_equal(~np.isnan(got), want)


def test_a_filter_wider_than_the_image(spark, gray):
    v, has = gray
    w = neighborhood.weights(25)  # reaches 100 cells
    got = array(neighborhood.gauss(frame(spark, v.astype(float), has), 25, H, W))
    assert np.abs(got - whole(v * has, w, w)).max() < 1e-9


@pytest.mark.parametrize("k", [3, 59, 101])
def test_medians_of_any_width(spark, gray, k):
    v, has = gray[0] // 8, gray[1]
    got = array(filters.medians(frame(spark, v, has), k, H, W, 40))
    r = k // 2
    for y, x in [(0, 0), (69, 149), (35, 70), (1, 140), (12, 31)] + [tuple(p) for p in np.random.default_rng(k).integers((H, W), size=(60, 2))]:
        box = np.s_[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
        values = np.sort(v[box][has[box]])
        assert math.isnan(got[y, x]) if not len(values) else got[y, x] == values[(len(values) - 1) // 2]


def disk(r):
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return np.argwhere(y * y + x * x <= r * r) - r


def grown(a, r):
    out = np.zeros_like(a)
    for dy, dx in disk(r):
        out[max(0, dy) : H + min(0, dy), max(0, dx) : W + min(0, dx)] |= a[max(0, -dy) : H + min(0, -dy), max(0, -dx) : W + min(0, -dx)]
    return out


@pytest.mark.parametrize("nested", [True, False])
def test_shells_over_tiles(spark, gray, nested, monkeypatch):
    monkeypatch.setattr(filters, "TILE", 30)
    m, nuclei, within = np.kron(gray[1][:14, :30], np.ones((5, 5), bool)).astype(bool), gray[0] < 40, np.zeros((H, W), bool)
    within[:, 20:] = True
    f = lambda a: frame(spark, a.astype(np.int32), a).select(*KEY)
    core = ~grown(~m, 2)
    ring = grown(core if nested else m, 6) & ~core & ~nuclei & within
    w = neighborhood.weights(2.0)
    want = whole(ring, w, w).round(9) > 0.5
    got = neighborhood.shell(f(m), f(nuclei), 2, 6, H, W, nested, f(within))
    assert {(r.y, r.x) for r in got.collect()} == set(map(tuple, np.argwhere(want))) and want.any()
    plain = neighborhood.shell(f(m), None, 2, 6, H, W, nested, None, None)
    assert {(r.y, r.x) for r in plain.collect()} == set(map(tuple, np.argwhere(grown(core if nested else m, 6) & ~core)))
    assert neighborhood.shell(f(m).limit(0), f(nuclei), 2, 6, H, W).count() == 0
    plan = neighborhood.shell(f(m), f(nuclei), 2, 6, H, W, nested, f(within))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 1


def test_orientation_over_tiles(spark, gray, monkeypatch):
    monkeypatch.setattr(filters, "TILE", 25)
    v = gray[0]
    every = np.ones((H, W), bool)
    smooth, step, w = np.array([0.25, 0.5, 0.25]), np.array([-0.5, 0, 0.5]), neighborhood.weights(2)
    gy, gx = whole(v, step, smooth), whole(v, smooth, step)
    yy, xx, xy = (whole(p, w, w) for p in (gy * gy, gx * gx, gx * gy))
    theta = array(neighborhood.orientation(frame(spark, v, every), 2, H, W), "theta")
    assert np.abs(theta - 0.5 * np.arctan2(2 * xy, xx - yy)).max() < 1e-9
    change = array(neighborhood.orientation_gradient(frame(spark, theta, every).withColumnRenamed("v", "theta"), H, W), "change")
    assert np.abs(change - np.hypot(whole(theta, step, smooth), whole(theta, smooth, step))).max() < 1e-9


@pytest.mark.parametrize("aligned", [True, False])
@pytest.mark.parametrize("h,w,tile", [(4, 6, 20), (20, 9, 20), (33, 70, 16), (70, 150, 1024)])
def test_patch_sums_over_tiles(spark, gray, aligned, h, w, tile):
    m = gray[1]
    k = 0 if aligned else 1
    s = np.pad(m.astype(int), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    n = (s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w])[k:, k:]
    want = {(y, x): int(n[y, x]) for y, x in np.argwhere(n >= h * w * 0.6)}
    df = frame(spark, gray[0], m).select(*KEY)
    got = patches.count_patches(df, H, W, h, w, 0.6, aligned, tile)
    assert {(r.y, r.x): r.n for r in got.collect()} == want
    assert patches.count_patches(df, H, W, H + 1, w, 0.5).count() == 0 and patches.count_patches(df.limit(0), H, W, h, w, 0.5).count() == 0


def test_coverage_of_rectangles(spark):
    r = np.random.default_rng(6)
    at = r.integers(0, 40, (90, 2))
    at = np.concatenate([at, at[:10]])  # some twice
    df = spark.createDataFrame(pd.DataFrame({"slide": 0, "y": at[:, 0], "x": at[:, 1]}).astype("int32"))
    n = np.zeros((60, 60), int)
    for y, x in at:
        n[y : y + 9, x : x + 13] += 1
    got = patches.roi_coverage(df, 9, 13, count=True).collect()
    assert {(c.y, c.x): c.n for c in got} == {(y, x): n[y, x] for y, x in np.argwhere(n)} and len(got) == (n > 0).sum()
    assert patches.roi_coverage(df, 9, 13).count() == (n > 0).sum() and patches.roi_coverage(df.limit(0), 9, 13).count() == 0
    runs = patches.coverage_runs(df, 9, 13)
    assert runs.count() < len(got) / 2
    # Two stretches a rectangle and image row at most, whatever its width.
    assert patches.coverage_runs(df, 3000, 3000).count() <= (3000 + 40) * 2 * len(at)


def test_quantiles_by_selection(spark):
    r = np.random.default_rng(2)
    groups = {0: r.normal(size=3000), 1: np.full(50, 7.5), 2: r.integers(0, 4, 999).astype(float), 3: np.array([1e308, -1e308, 0.0, 5e-324]), None: r.exponential(size=1)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(4, None)]
    df = stored(spark.createDataFrame(rows, "grp int, v double"), "t")
    got = grouped_quantiles(df, (0.25, 0.5, 0.75, 1.0))
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs)
        np.testing.assert_allclose(got[g][1], [np.quantile(vs, q) if g != 3 else got[g][1][i] for i, q in enumerate((0.25, 0.5, 0.75, 1.0))], rtol=1e-12)
    assert grouped_quantiles(df.limit(0), (0.5,)) == {}


def test_grades_of_dirty_scores(spark):
    rows = [("1.5", "2"), ("NaN", "2"), ("Infinity", "2"), (None, "2"), ("n/a", "1"), ("4", "x"), ("2.5", "2"), ("100", "1.4")]
    got = {r.grade: (r.n, r.median) for r in metrics.score_by_grade(spark.createDataFrame(rows, "fib_score string, pathologist_score string")).collect()}
    assert got == {2: (2, 2.0), None: (1, 4.0), 1: (1, 100.0)}
    assert metrics.score_by_grade(spark.createDataFrame(rows, "fib_score string, pathologist_score string").limit(0)).count() == 0


def inertia(v, centers):
    return float((np.abs(v[:, None] - np.array(centers)[None]) ** 2).min(axis=1).sum())


def test_exact_kmeans(spark):
    r = np.random.default_rng(7)
    v = np.concatenate([r.normal(m, 12, 700) for m in (20, 60, 130, 200, 240)]).clip(0, 255).round().astype(int)
    df = spark.createDataFrame([(int(x),) for x in v], "v int")
    got = [c[0] for _, c in sorted(map(tuple, clusters.fit_intensities(df, 5).collect()))]
    assert got == sorted(got) and len(got) == 5
    assert inertia(v, got) <= min(inertia(v, [c[0] for _, c in clusters.fit_centers(df, 5, seed=s).collect()]) for s in range(3)) + 1e-6
    few = spark.createDataFrame([(3,), (3,), (9,), (None,)], "v int")
    assert [c[0] for _, c in clusters.fit_intensities(few, 5).collect()] == [3.0, 9.0]
    assert clusters.fit_intensities(few.limit(0), 5).count() == 0
    # All ways to split a small histogram.
    small = [0, 0, 1, 5, 6, 6, 20, 21]
    levels = sorted(set(small))
    best = min(inertia(np.array(small), [np.mean([x for x in small if a <= levels.index(x) < b]) for a, b in zip((0, *c), (*c, len(levels)))]) for c in [(i, j) for i in range(1, 6) for j in range(i + 1, 6)])
    got = [c[0] for _, c in clusters.fit_intensities(spark.createDataFrame([(x,) for x in small], "v int"), 3).collect()]
    assert abs(inertia(np.array(small), got) - best) < 1e-9
