"""The slide pipeline against whole NumPy arrays, and the tile store."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import filters, resample, scoring, tiles, words
from pixelweave.plans import slide_plan
from pixelweave.plans.queries_data import channel_scorer
from pixelweave.sources import slides, store

from .test_words import brute_labels

H, W, SIDE = 192, 320, 256
SIZES = slide_plan.Sizes(fill=3, shrink=2, erode=1, small=40, hole=30, ring=1, membrane=(1, 2), capsule=(1, 3), halo=24, block=100, drop_up_to=6)
SCORERS = {
    "cortex": (channel_scorer((-1.0, 0.0, 0.0), 3), -0.55), "cap": (channel_scorer((0.0, 1.0, 0.0), 3), 0.62), "tubule": (channel_scorer((0.5, 0.5, 0.0), 2), 0.62),
    "vessel": (channel_scorer((0.0, 0.0, 1.0), 3), 0.64), "nuclei": (channel_scorer((0.0, 0.0, -1.0), 1), -0.22),
}


@pytest.fixture(scope="module")
def images():
    r = np.random.default_rng(12)
    out = []
    for k in (8, 16):
        a = r.integers(0, 256, (H // k, W // k, 3)).repeat(k, 0).repeat(k, 1) * 0.8 + r.integers(0, 60, (H, W, 3))
        pale = r.random((H // 16, W // 16)).repeat(16, 0).repeat(16, 1) < 0.15
        a[pale] = 250
        out.append(a.clip(0, 255).astype(np.uint8))
    return out


def tiled(spark, images, side=SIDE, fill=255):
    rows = []
    for s, a in enumerate(images):
        whole = np.full((-(-H // side) * side, -(-W // side) * side, 3), fill, np.uint8)
        whole[:H, :W] = a
        rows += [(s, y, x, side, side, bytearray(whole[y * side : (y + 1) * side, x * side : (x + 1) * side].tobytes())) for y in range(whole.shape[0] // side) for x in range(whole.shape[1] // side)]
    return spark.createDataFrame(rows, "slide int, ty int, tx int, h int, w int, data binary")


def disk(r):
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def moved(a, shape):
    """Union of a mask moved by each offset."""
    r = max(max(abs(y), abs(x)) for y, x in shape)
    p = np.pad(a, r)
    return np.any([p[r + y : r + y + a.shape[0], r + x : r + x + a.shape[1]] for y, x in shape], axis=0)


def eroded(a, shape):
    return ~moved(~a, shape)


ELLIPSE = [(dy, dx) for dy, n in ((-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)) for dx in range(-n, n + 1)]


def big(a, size, conn=4):
    labels = brute_labels(a, conn)
    n = np.bincount(labels[labels >= 0], minlength=labels.size)
    return a & (np.where(labels >= 0, n[labels], 0) >= size)


def scored(a, name, halo):
    scorer, t = SCORERS[name]
    padded = np.pad(a.astype(float), ((halo, 4 * halo), (halo, 4 * halo), (0, 0)), constant_values=255)
    return scorer(padded)[halo : halo + a.shape[0], halo : halo + a.shape[1]] > t


def halved(a):
    return (a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2, 3).sum(axis=(1, 3), dtype=int) // 4).astype(np.uint8)


def shell(m, nuclei, radii, nested):
    from pixelweave.operators.neighborhood import weights

    core = eroded(m, disk(radii[0]))
    ring = moved(core if nested else m, disk(radii[1])) & ~core & ~nuclei
    w = weights(2.0)
    p = np.pad(ring.astype(float), len(w) // 2, mode="symmetric")
    rows = sum(w[i] * p[i : i + m.shape[0]] for i in range(len(w)))
    return sum(w[j] * rows[:, j : j + m.shape[1]] for j in range(len(w))).round(9) > 0.5


def brute(a):
    s, up = SIZES, lambda m, k: m.repeat(k, 0).repeat(k, 1)
    a2 = halved(a)
    a3 = halved(a2)
    fg = ~(a3 > 255 - s.white).all(axis=2)
    tissue = up(eroded(eroded(moved(fg, disk(s.fill)), disk(s.shrink)), disk(s.erode)), 4)
    v, low = a.max(axis=2).astype(int), a.min(axis=2).astype(int)
    bg = (np.floor(np.where(v > 0, (v - low) * 255 / np.maximum(v, 1), 0) + 0.5) < s.saturation) & (v > s.value)
    for step in (eroded, moved, moved, moved, moved, eroded, eroded, eroded):
        bg = step(bg, ELLIPSE)
    cap = big(scored(a2, "cap", 24), s.small)
    holes = ~cap
    cap |= holes & ~big(holes, s.hole)
    vessel2 = big(scored(a2, "vessel", 24), s.small)
    labels, ring = brute_labels(vessel2, 4), np.zeros_like(vessel2)
    for k in np.unique(labels[labels >= 0]):
        one = labels == k
        ring |= moved(one, disk(s.ring + int(math.log1p(2500.0 * one.sum()))))
    ring &= ~vessel2
    cortex, nuclei = up(scored(a3, "cortex", 24), 4), scored(a, "nuclei", 24)
    keep = cortex & ~bg
    tubule, cap0, vessel0 = (up(m, 2) & keep for m in (scored(a2, "tubule", 24), cap, vessel2))
    vessel, cap = vessel0 & ~tubule & ~cap0, cap0 & ~tubule
    tbm, bc = shell(tubule, nuclei, s.membrane, True), shell(cap, nuclei, s.capsule, False)
    ring = up(ring, 2) & cortex & ~(nuclei | tubule | cap | tbm | bc | bg)
    fib = tissue & cortex & ~(nuclei | vessel | ring | tubule | cap | tbm | bc | bg)
    labels, kept = brute_labels(fib, 8, s.block), np.zeros_like(fib)
    y, x = np.mgrid[:H, :W]
    for k in np.unique(labels[labels >= 0]):
        one = labels == k
        kept |= one if one.sum() > s.drop_up_to else False
    inflamm = nuclei & cortex & ~(bg | vessel | tubule | cap)
    inter = inflamm | kept | ((ring | tbm | bc) & cortex & ~(bg | nuclei | tubule | cap | vessel))
    bare = cortex & ~vessel & ~cap
    n = [m.sum() for m in (kept, inflamm, cortex, bare, inter, tubule, cap, vessel, tbm, bc, ring)]
    return n, {"fib_noglomvessel": 100 * n[0] / n[3], "fib_inflamm_noglomvessel": 100 * (n[0] + n[1]) / n[3], "fib_tissue": 100 * n[0] / n[2], "fib_inflamm_tissue": 100 * (n[0] + n[1]) / n[2], "inflamm_interstitium": 100 * n[1] / n[4]}


def test_pipeline_equals_whole_arrays(spark, images, monkeypatch):
    monkeypatch.setattr(filters, "TILE", 64)
    got = {r.slide: r for r in slide_plan.slide_scores(tiled(spark, images), H, W, SIDE, SCORERS, SIZES).collect()}
    assert set(got) == {0, 1}
    used = np.zeros(11, int)
    for s, a in enumerate(images):
        n, want = brute(a)
        used += np.array(n)
        for c, v in want.items():
            assert abs(got[s][c] - v) < 1e-9, (s, c, got[s], want, n)
    assert used.all()


def test_pipeline_without_slides(spark, images):
    assert slide_plan.slide_scores(tiled(spark, images).limit(0), H, W, SIDE, SCORERS, SIZES).count() == 0


def test_scores_of_tiles_equal_those_of_pixels(spark, images):
    px = slides.from_tiles(tiled(spark, images, 64))
    scorer = scoring.mean_scorer(3)
    for halo in (0, 5):
        a = words.to_pixels(tiles.score(tiled(spark, images, 64), scorer, H, W, 64, halo, 0.5))
        b = scoring.score_tiles(px, scorer, H, W, 64, halo, 0.5, fill=255).select("slide", "y", "x")
        assert a.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    with pytest.raises(ValueError, match="halo"):
        tiles.score(tiled(spark, images, 64), scorer, H, W, 64, 65)


def test_coarser_tiles_equal_coarser_pixels(spark, images):
    t = tiled(spark, images, 64)
    want = resample.coarsen_mean(slides.from_tiles(t), H, W).where("r < 255 OR g < 255 OR b < 255")
    got = slides.from_tiles(tiles.coarser(t)).where(f"y < {H // 2} AND x < {W // 2}")
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == want.count()


def test_a_region_reads_only_its_tiles(spark, images, tmp_path):
    path = str(tmp_path / "store")
    t = tiled(spark, images, 64)
    store.write_tiles(t, path)
    store.write_tiles(tiles.coarser(t), path, 1)
    assert store.read_tiles(spark, path).exceptAll(t).isEmpty() and store.read_tiles(spark, path, 1).count() == t.count()
    box = (70, 130, 50, 60)
    part = store.read_tiles(spark, path, 0, 1, box, 64)
    assert {(r.slide, r.ty, r.tx) for r in part.collect()} == {(1, 1, 2)}
    plan = part._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "slide" in scan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(tx,2)" in plan
    # The folders of one slide, level and row of tiles.
    read = part.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 1 and "slide=1/level=0/ty=1" in read[0].f.replace("%3D", "=")
    around = store.read_tiles(spark, path, 0, 0, box, 64, halo=10)
    assert {(r.ty, r.tx) for r in around.collect()} == {(y, x) for y in (0, 1, 2) for x in (1, 2, 3)}
    region = store.read_region(spark, path, 1, box, tile=64)
    y, x = np.mgrid[70:120, 130:190]
    keep = (images[1][70:120, 130:190] != 255).any(axis=2)
    assert {(r.y, r.x, r.r, r.g, r.b) for r in region.collect()} == {(int(a), int(b), *map(int, images[1][a, b])) for a, b in zip(y[keep], x[keep])}
    # Writing a row of tiles again leaves the others.
    store.write_tiles(t.where("ty = 0 AND slide = 0"), path)
    assert store.read_tiles(spark, path).exceptAll(t).isEmpty() and store.read_tiles(spark, path).count() == t.count()
