"""Invariants of the raster operators on small masks, and odd cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import algebra, metrics, neighborhood, objects, patches, resample, votes
from pixelweave.operators.pixels import KEY, roi_ops
from pixelweave.plans.presets import PRESETS, slide_scores
from pixelweave.sources import slides

H = W = 24


def cells(df):
    return {(r.y, r.x) for r in df.select("y", "x").collect()}


@pytest.fixture(scope="module")
def m(spark):
    rows = [(0, y, x) for y in range(H) for x in range(W) if (y * y + 3 * x * y + x) % 7 < 4 and not (8 < y < 14 and 5 < x < 9)]
    return spark.createDataFrame(rows, "slide int, y int, x int")


def brute_dilate(s, offsets):
    return {(y + dy, x + dx) for y, x in s for dy, dx in offsets if 0 <= y + dy < H and 0 <= x + dx < W}


def disk(r):
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


EVERY = {(y, x) for y in range(H) for x in range(W)}


def test_dilation_and_erosion(m):
    s = cells(m)
    for r in (1, 2, 5):
        assert cells(neighborhood.dilate(m, r, H, W)) == brute_dilate(s, disk(r))
        assert cells(neighborhood.erode(m, r, H, W)) == EVERY - brute_dilate(EVERY - s, disk(r))
    assert cells(neighborhood.erode(m, 1, H, W)) <= s <= cells(neighborhood.dilate(m, 1, H, W))


def test_runs_round_trip(m):
    runs = neighborhood.to_runs(m)
    assert cells(neighborhood.from_runs(runs)) == cells(m)
    assert cells(neighborhood.from_runs(neighborhood.complement_runs(runs, m, H, W))) == EVERY - cells(m)
    assert neighborhood.merge_runs(runs.union(runs)).count() == runs.count()


def brute_label(s, conn):
    out = {}
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (conn == 8 or not dy * dx)]
    for p in sorted(s):
        if p in out:
            continue
        todo, out[p] = [p], p[0] * W + p[1]
        while todo:
            y, x = todo.pop()
            for q in ((y + dy, x + dx) for dy, dx in near):
                if q in s and q not in out:
                    out[q] = out[p]
                    todo.append(q)
    return out


def test_labels(spark, m):
    for conn in (4, 8):
        assert {(r.y, r.x): r.label for r in objects.label(m, W, conn).collect()} == brute_label(cells(m), conn)
    spiral, y, x, d, n = set(), 0, 0, 0, 0
    step = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    while n < 250:  # a long thin object needs many rounds
        spiral.add((y, x))
        ny, nx = y + step[d][0], x + step[d][1]
        ahead = (ny + step[d][0], nx + step[d][1])
        if not (0 <= ny < H and 0 <= nx < W) or ahead in spiral:
            d = (d + 1) % 4
        else:
            y, x = ny, nx
        n += 1
    one = spark.createDataFrame([(0, *p) for p in spiral], "slide int, y int, x int")
    assert {(r.y, r.x): r.label for r in objects.label(one, W, 4).collect()} == brute_label(spiral, 4)


def test_empty_masks(m):
    none = m.limit(0)
    assert objects.label(none, W).count() == 0 and neighborhood.dilate(none, 3, H, W).count() == 0
    assert objects.remove_small(none, 5, W).count() == 0 and resample.downsample_mask(none, 2).count() == 0
    assert metrics.surface_distance(none, m, H, W).collect()[0][1:] == (0.0, 0.0)


def test_upsample_then_downsample_is_identity(m):
    up = resample.upsample_nearest(m, 3, 3)
    for mode in ("all", "any", "mean"):
        assert cells(resample.downsample_mask(up, 3, mode)) == cells(m)


def test_halo_result_equals_untiled(m):
    v = m.select(*KEY, F.lit(255).alias("v"))
    from pixelweave.operators.scoring import mean_scorer, score_tiles

    whole = cells(score_tiles(v, mean_scorer(2), H, W, 24, 2, 0.5, ("v",)))
    assert whole and whole == cells(score_tiles(v, mean_scorer(2), H, W, 5, 2, 0.5, ("v",)))


def test_blur_of_both_forms_agree(m):
    a = cells(neighborhood.gauss_threshold(m, 1.5, 0.5, H, W))
    assert a and a == cells(neighborhood.gauss_threshold_runs(m, 1.5, 0.5, H, W))
    flat = {(r.y, r.x): r.v for r in neighborhood.gauss(m.sparkSession.createDataFrame([(0, *p, 1.0) for p in sorted(EVERY)], "slide int, y int, x int, v double"), 2, H, W).collect()}
    assert len(flat) == H * W and all(abs(v - 1) < 1e-9 for v in flat.values())


def test_counts_add_up_over_blocks(spark, m):
    stacked = algebra.stack(m.withColumn("layer", F.lit("tissue")).union(m.withColumn("layer", F.lit("cortex"))))
    blocks = metrics.block_fib_counts(stacked, 5)
    assert blocks.agg(F.sum("tissue")).first()[0] == m.count()
    assert metrics.slide_scores(blocks, metrics.block_inflamm_counts(stacked, 5)).first()["fib_tissue"] == 100.0


def test_zero_denominators_are_null(spark, m):
    none = algebra.stack(m.withColumn("layer", F.lit("nuclei")))
    got = metrics.slide_scores(metrics.block_fib_counts(none, 5), metrics.block_inflamm_counts(none, 5)).first()
    assert got["fib_tissue"] is None and got["inflamm_interstitium"] is None


def test_integral_and_patch_counts(m):
    integral = patches.integral_image(m, slides.grid(m, H, W))
    s = cells(m)
    for aligned in (False, True):
        got = {(r.y, r.x): r.n for r in patches.patch_counts(integral, 4, 6, 0.5, aligned).collect()}
        k = 0 if aligned else 1
        want = {(y, x): sum((y + k + i, x + k + j) in s for i in range(4) for j in range(6)) for y in range(H - 3 - k) for x in range(W - 5 - k)}
        assert got == {p: n for p, n in want.items() if n >= 12}


def test_surface_distance(m):
    a, b = m.where("x < 10"), m.where("x >= 6 and y < 20")
    sa, sb = (cells(metrics.surface(x, H, W)) for x in (a, b))
    d = [min(math.dist(p, q) for q in sb) for p in sa] + [min(math.dist(p, q) for q in sa) for p in sb]
    got = metrics.surface_distance(a, b, H, W).first()
    assert abs(got.hausdorff - max(d)) < 1e-9 and abs(got["mean"] - sum(d) / len(d)) < 1e-9


def test_resizing(spark, m):
    px = spark.createDataFrame([(0, y, x, y * 10, x * 10, 7) for y, x in sorted(EVERY)], "slide int, y int, x int, r int, g int, b int")
    half = resample.resize_area(px, H, W, 12, 12)
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in half.collect()} == {(y, x): (y * 20 + 5, x * 20 + 5, 7) for y in range(12) for x in range(12)}
    assert resample.resize_nearest(px, H, W, 48, 48).count() == 48 * 48
    assert slides.from_tiles(slides.to_tiles(px, 7)).exceptAll(px).count() == 0


def test_stream_of_slides(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.ndpi", "b.svs", "c.txt"):
        (folder / name).write_bytes(b"x")
    stream = slides.slide_stream(spark, str(folder)).writeStream.format("memory").queryName("slides").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sorted(r.slide_id for r in spark.table("slides").collect()) == ["a", "b"] == sorted(r.slide_id for r in slides.slide_catalog(spark, str(folder)).collect())


def test_validation_and_small_functions(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        metrics.validate_columns(spark.range(1), ["id", "b"])
    df = spark.createDataFrame([("a10_b2",), ("a9_b10",), ("a9_b9",)], "name string")
    assert [r.name for r in df.orderBy(patches.natural_key(df.name)).collect()] == ["a9_b9", "a9_b10", "a10_b2"]
    roi = spark.createDataFrame([(0, 0, 5, 5), (50, 50, 60, 60)], "y0 int, x0 int, y1 int, x1 int")
    assert [tuple(r) for r in roi_ops(roi, 2, 20, 20).collect()] == [(0, 0, 7, 7)]
    v = spark.createDataFrame([(0, 1, 1, 0, 3), (0, 1, 1, 2, 3), (0, 2, 2, 5, 1)], "slide int, y int, x int, task int, n int")
    assert {(r.y, r.x): r["class"] for r in votes.argmax_class(v).collect()} == {(1, 1): 0, (2, 2): 5}


def by_multiplication(m, name):
    """(fibrosis, tissue, tissue without vessel and cap, inflammation, interstitium) masks of one slide, as products of 0/1 arrays; fibrosis before small objects go."""
    no = lambda *names: np.prod([1 - m[n] for n in names], axis=0)
    m = dict(m)
    where = {"final": m["cortex"] * no("background"), "unet_20x_cluster": m["eroded_cortex"] * no("background"), "newcortex": m["eroded_cortex"] * m["cortex"], "omniseg": m["tissue"], "segfault": m["tissue"]}.get(name, m["eroded_cortex"])
    region = {"final": m["cortex"], "newcortex": where, "omniseg": m["tissue"], "segfault": m["tissue"]}.get(name, m["eroded_cortex"])
    tubule, cap, vessel = (m[n] * where for n in ("tubule", "cap", "vessel"))
    vessel = vessel * (1 - tubule) * (1 - cap)
    cap = cap * (1 - tubule)
    m |= {"t": tubule, "c": cap, "v": vessel}
    clusters = np.clip(m["fib1"] + m["fib2"] + m["structural"], 0, 1)
    if name == "omniseg":
        m["ring"] = m["vessel_dilated"]
        fib = clusters * no("v", "ring", "t", "c", "tbm") * region
    elif name in ("main", "segfault"):
        m["ring"] = m["vessel_dilated"] * no("dark", "t", "c", "tbm", "bc") * clusters * region
        fib = clusters * no("v", "ring", "t", "c", "tbm", "bc") * region
    else:
        m["ring"] = m["vessel_dilated"] * where * no("nuclei", "t", "c", "tbm", "bc")
        fib = (1 if name == "newcortex" else m["tissue"]) * where * no("nuclei", "v", "ring", "t", "c", "tbm", "bc")
    out = ("t", "c", "v") if name in ("main", "segfault", "omniseg") else ("t", "c", "v", "nuclei")
    exclusion = np.clip(m["ring"] + m["tbm"] + m["bc"], 0, 1) * no(*out) * where
    inflamm = m["dark" if name in ("main", "segfault", "omniseg") else "nuclei"] * no("t", "c", "v") * where
    return fib, region, region * no("v", "c"), inflamm, exclusion


@pytest.mark.parametrize("name", sorted(PRESETS))
def test_presets_equal_products_of_masks(spark, name):
    rng = np.random.default_rng(5)
    masks = {n: (rng.random((8, 8)) < (0.9 if n in ("tissue", "cortex", "eroded_cortex") else 0.4 if n in ("fib1", "fib2", "dark") else 0.08)).astype(int) for n in algebra.LAYERS if n not in ("vessel_ring", "finfib")}
    layers = spark.createDataFrame([(0, y, x, n) for n, a in masks.items() for y in range(8) for x in range(8) if a[y, x]], "slide int, y int, x int, layer string")
    fib, tissue, bare, inflamm, exclusion = by_multiplication(masks, name)
    drop = 0 if name == "omniseg" else 2
    kept = set()
    for y0 in (0, 4):
        for x0 in (0, 4):
            cells_ = {(y, x) for y in range(y0, y0 + 4) for x in range(x0, x0 + 4) if fib[y, x]}
            found = brute_label(cells_, 8)
            kept |= {p for p in cells_ if sum(v == found[p] for v in found.values()) > drop}
    n_fib, n_inflamm = len(kept), int(inflamm.sum())
    inter = sum((y, x) in kept or inflamm[y, x] + exclusion[y, x] > 0 for y in range(8) for x in range(8))
    want = [100 * a / b if b else None for a, b in ((n_fib, bare.sum()), (n_fib + n_inflamm, bare.sum()), (n_fib, tissue.sum()), (n_fib + n_inflamm, tissue.sum()), (n_inflamm, inter))]
    got = slide_scores(layers, 4, name, 8, drop).first()
    assert [got[c] is None if w is None else abs(got[c] - w) < 1e-9 for c, w in zip(("fib_noglomvessel", "fib_inflamm_noglomvessel", "fib_tissue", "fib_inflamm_tissue", "inflamm_interstitium"), want)] == [True] * 5, (got, want)
    assert n_fib or name == "omniseg"
