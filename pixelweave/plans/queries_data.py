"""Queries over files, clusters, tile scoring, votes, metrics and data sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as H
from ..operators import datasets as L
from ..operators import metrics as K
from ..operators import patches as E
from ..operators import pixels as B
from ..operators import scoring as I
from ..operators import tiles, words
from ..operators import votes as J
from ..operators.pixels import KEY
from ..sources import slides as A
from ..sources import store
from ..sources.tables import shared_dir
from . import presets, slide_plan
from ..operators.resample import downsample_mask
from .queries_raster import ABNORMAL_SQL, CLAHE_SQL, EXCLUSION, FIB, FIB_CLUSTER, GRAY, INFLAMM, R, abnormal, area_rows, area_sql, comp_sql, erode_sql, hash_sql, m_sql, offsets_table, sized
from .raster import GRID_SQL, LAYERS, PIX_SQL, SIDE, large_tiles, layers, mask, pix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
S = SIDE


def register(name: str, sql: str | None = None, raster: bool = True, more: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {PIX_SQL}{more and ', ' + more} {sql}" if raster else (f"WITH {more} {sql}" if more else sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- sources -----------------------------------------------------------------

FILES_SQL = "files AS (SELECT doc_id, 'slides/' || source || '/' || lang || CAST(doc_id AS VARCHAR) || '.' || (['ndpi', 'svs', 'zarr', 'txt'])[doc_id % 4 + 1] AS path FROM documents)"


def files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in ("ndpi", "svs", "zarr", "txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("slides/"), "source", F.lit("/"), "lang", F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))


@register("a1_slide_catalog", "SELECT regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS slide_id, path, regexp_extract(path, '\\.([^./]+)$', 1) AS ext FROM files WHERE doc_id % 4 != 3", False, FILES_SQL)
def _(spark, d):
    return A.catalog_of(files(spark, d))


@register("a2_normalize_resolution", "SELECT p_partkey, ext, CAST(CASE ext WHEN 'ndpi' THEN floor(1e0 / res * 1e7) WHEN 'svs' THEN floor(res * 1000) END AS BIGINT) AS nm FROM (SELECT p_partkey, p_retailprice * 10 AS res, (['ndpi', 'svs', 'zarr'])[p_partkey % 3 + 1] AS ext FROM part)", False)
def _(spark, d):
    ext = F.element_at(F.array(F.lit("ndpi"), F.lit("svs"), F.lit("zarr")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return A.normalize_resolution(table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 10).alias("res"), ext.alias("ext"))).drop("res")


#: Fibrosis objects up to this size are dropped here; the presets' sizes fit blocks of a thousand pixels a side.
SMALL = 3


def preset_ctes(name: str, block: int = 20, small: int = SMALL) -> str:
    """Tables that end in ``scores`` (slide, fib, infl, tissue, tn, inter), step by step as each variant of the formula is published."""
    clusters, region = name in ("main", "omniseg", "segfault"), {"final": "cortex", "newcortex": "eroded_cortex cortex", "omniseg": "tissue", "segfault": "tissue"}.get(name, "eroded_cortex").split()
    off = "background" if name in ("final", "unet_20x_cluster") else None
    infl = "dark" if clusters else "nuclei"
    inside = " AND ".join(region)
    keep = inside + (f" AND NOT {off}" if off else "")
    none = lambda *names: " AND ".join(f"NOT {n}" for n in names if n)
    ring = "vessel_dilated" if name == "omniseg" else f"vessel_dilated AND {inside} AND {none(off, infl, 'tub', 'cp', 'tbm', 'bc')}" + (" AND (fib1 OR fib2 OR structural)" if clusters else "")
    base = "(fib1 OR fib2 OR structural)" if clusters else "TRUE" if name == "newcortex" else "tissue"
    fib = f"{base} AND {inside} AND {none(off, None if clusters else infl, 've', 'ring', 'tub', 'cp', 'tbm', None if name == 'omniseg' else 'bc')}"
    exclusion = f"(ring OR tbm OR bc) AND {none(off, None if clusters else infl, 'tub', 'cp', 've')} AND {inside}"
    inflamm = f"{infl} AND {none(off, 've', 'tub', 'cp')} AND {inside}"
    kept = "SELECT slide, y, x FROM fibs" if name == "omniseg" else f"SELECT slide, y, x FROM (SELECT *, count(*) OVER (PARTITION BY slide, label, y // {block}, x // {block}) AS n FROM flab) WHERE n > {small}"
    return f"""masks AS (SELECT slide, y, x, {', '.join(f'({e}) AS {n}' for n, e in LAYERS.items())} FROM pix),
      cut AS (SELECT *, tubule AND {keep} AS tub, cap AND {keep} AS cap0, vessel AND {keep} AS ves0 FROM masks),
      apart AS (SELECT *, cap0 AND NOT tub AS cp, ves0 AND NOT tub AND NOT cap0 AS ve FROM cut),
      ringed AS (SELECT *, {ring} AS ring FROM apart),
      fibs AS (SELECT slide, y, x FROM ringed WHERE {fib}),
      {comp_sql('fibs', 'flab', block=block)}, kept AS ({kept}),
      told AS (SELECT r.*, k.slide IS NOT NULL AS fin FROM ringed r LEFT JOIN kept k ON r.slide = k.slide AND r.y = k.y AND r.x = k.x),
      scores AS (SELECT slide, CAST(count(*) FILTER (fin) AS DOUBLE) AS fib, CAST(count(*) FILTER ({inflamm}) AS DOUBLE) AS infl, count(*) FILTER ({inside}) AS tissue,
        count(*) FILTER ({inside} AND NOT ve AND NOT cp) AS tn, count(*) FILTER (fin OR ({inflamm}) OR ({exclusion})) AS inter FROM told GROUP BY slide)"""


SCORES_SQL = preset_ctes("final")
SCORE_COLUMNS = "slide, round(100 * fib / nullif(tn, 0), 6) AS fib_noglomvessel, round(100 * (fib + infl) / nullif(tn, 0), 6) AS fib_inflamm_noglomvessel, round(100 * fib / nullif(tissue, 0), 6) AS fib_tissue, round(100 * (fib + infl) / nullif(tissue, 0), 6) AS fib_inflamm_tissue, round(100 * infl / nullif(inter, 0), 6) AS inflamm_interstitium"
METRICS = ("fib_noglomvessel", "fib_inflamm_noglomvessel", "fib_tissue", "fib_inflamm_tissue", "inflamm_interstitium")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return preset_scores(spark, d, "final")


def preset_scores(spark: SparkSession, d: str, name: str) -> DataFrame:
    out = presets.slide_scores(layers(pix(spark, d)), 20, name, drop_up_to=min(SMALL, presets.PRESETS[name].drop_up_to))
    return out.select("slide", *[F.round(c, 6).alias(c) for c in METRICS])


@register("k4_slide_scores", f"SELECT {SCORE_COLUMNS} FROM scores", more=SCORES_SQL)
def _(spark, d):
    return scores(spark, d)


@register("a14_write_report", f"SELECT slide, metric, value FROM (SELECT {SCORE_COLUMNS} FROM scores) UNPIVOT (value FOR metric IN ({', '.join(METRICS)}))", more=SCORES_SQL)
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    A.write_report(scores(spark, d), path)
    return A.read_report(spark, path)


@register("a16_skip_done", "SELECT 'img' || CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id % 3 != 0", False)
def _(spark, d):
    ids = table(spark, d, "documents").select(F.concat(F.lit("img"), F.col("doc_id").cast("string")).alias("name"), "doc_id")
    done = ids.where("doc_id % 3 = 0").select(F.concat("name", F.lit("_out")).alias("name"))
    return A.skip_done(ids.select("name").union(done), done)


# --- names of tiles ----------------------------------------------------------


@register("e15_natural_order", "SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^[a-z]+', 0), CAST(regexp_extract(name, '([0-9]+)_', 1) AS INT), CAST(regexp_extract(name, '_([0-9]+)', 1) AS INT)) AS place FROM (SELECT lang || CAST(doc_id % 300 AS VARCHAR) || '_' || CAST(doc_id AS VARCHAR) || '.png' AS name FROM documents)", False)
def _(spark, d):
    names = table(spark, d, "documents").select(F.concat("lang", (F.col("doc_id") % 300).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"))
    return E.numbered(names, "place", E.natural_key(F.col("name")))


@register("e16_tile_manifest", "SELECT folder, path, CAST(row_number() OVER (PARTITION BY folder ORDER BY k) - 1 AS INT) AS id, replace(path, '/', '-') AS name FROM (SELECT source AS folder, doc_id AS k, source || '/p' || CAST(doc_id AS VARCHAR) || '.png' AS path FROM documents WHERE doc_id % 4 != 1)", False)
def _(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/p"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 1, "_mask").otherwise(""), F.lit(".png"))
    return E.tile_manifest(docs.select(F.col("source").alias("folder"), path.alias("path")))


# --- clusters ----------------------------------------------------------------

#: Centres for the queries, out of order as a file may have them.
CENTERS = (140.5, 30.0, 220.25, 95.0, 60.75)
CENTER_VALUES = ", ".join(f"({i}, {c}e0)" for i, c in enumerate(sorted(CENTERS, reverse=True)))
CLASS_SQL = f"cls AS (SELECT slide, y, x, v, min_by(k, abs(v - c) * 1000 + k) AS class FROM (SELECT slide, y, x, {GRAY} AS v FROM pix), (VALUES {CENTER_VALUES}) t(k, c) GROUP BY ALL)"


def centers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, [c]) for i, c in enumerate(CENTERS)], "k int, c array<double>")


def h1(spark: SparkSession, d: str) -> DataFrame:
    """Mean grays of the slides written as a centre file and read back."""
    import uuid

    path = f"{shared_dir(spark)}/centers-{uuid.uuid4().hex}"
    means = B.gray(pix(spark, d)).groupBy("slide").agg(F.avg("v").alias("m"))
    means.orderBy(F.desc("m")).coalesce(1).select(F.format_string("%.6f", "m").alias("value")).write.text(path)
    return H.load_centers(spark, path).select(F.col("k").cast("long").alias("k"), F.get("c", F.lit(0)).alias("c"))


QUERIES["h1_load_centers"] = h1
ORACLE_SQL["h1_load_centers"] = f"WITH {PIX_SQL} SELECT row_number() OVER (ORDER BY m DESC) - 1 AS k, round(m, 6) AS c FROM (SELECT avg({GRAY}) AS m FROM pix GROUP BY slide)"


@register("h2_assign", "SELECT slide, y, x, v, class FROM cls", more=CLASS_SQL)
def _(spark, d):
    return H.assign(B.gray(pix(spark, d)), centers(spark))


@register("h3_split_classes", f"SELECT slide, 'fib1' AS layer, y, x FROM {sized('n >= 3', 'one')} UNION ALL SELECT slide, 'fib2', y, x FROM {sized('n >= 3', 'two')} UNION ALL SELECT slide, CASE class WHEN 3 THEN 'structural' ELSE 'dark' END, y, x FROM cls WHERE class IN (3, 4)", more=CLASS_SQL + ", " + comp_sql("(SELECT slide, y, x FROM cls WHERE class = 1)", "one") + ", " + comp_sql("(SELECT slide, y, x FROM cls WHERE class = 2)", "two"))
def _(spark, d):
    return H.split_classes(H.assign(B.gray(pix(spark, d)), centers(spark)), S, 3)


@register("h4_background_cluster", f"SELECT slide, y, x FROM {sized('n > 2')}", more=CLASS_SQL + ", " + comp_sql("(SELECT slide, y, x FROM cls WHERE class = 0)"))
def _(spark, d):
    return H.background_cluster(pix(spark, d), centers(spark), S, S, equalise=False, max_size=2)


EQUAL_SQL = f"{CLAHE_SQL}, cls AS (SELECT slide, y, x, min_by(k, abs(v - c) * 1000 + k) AS class FROM eq, (VALUES {CENTER_VALUES}) t(k, c) GROUP BY ALL)"


@register("h4_background_cluster_equalised", f"SELECT slide, y, x FROM {sized('n > 2')}", more=EQUAL_SQL + ", " + comp_sql("(SELECT slide, y, x FROM cls WHERE class = 0)"))
def _(spark, d):
    return H.background_cluster(pix(spark, d), centers(spark), S, S, max_size=2, grid=8)


TRIPLES = ((200.0, 180.0, 160.0), (90.0, 60.0, 120.0), (150.0, 20.0, 40.0), (30.0, 25.0, 90.0))


@register("h5_assign_rgb", f"SELECT slide, y, x, min_by(k, ((r - c1) * (r - c1) + (g - c2) * (g - c2) + (b - c3) * (b - c3)) * 16 + k) AS class FROM pix, (VALUES {', '.join(f'({i}, {a}e0, {b}e0, {c}e0)' for i, (a, b, c) in enumerate(sorted(TRIPLES, reverse=True)))}) t(k, c1, c2, c3) GROUP BY ALL")
def _(spark, d):
    c = spark.createDataFrame([(i, list(t)) for i, t in enumerate(TRIPLES)], "k int, c array<double>")
    return H.assign(pix(spark, d), c, ("r", "g", "b")).select(*KEY, "class")


def kmeans_sql(k: int) -> str:
    """Tables that end in ``centers`` (k, c): the best split of the gray histogram into k stretches."""
    levels = (
        f"hist AS (SELECT v, row_number() OVER (ORDER BY v) AS i, CAST(n AS DOUBLE) AS n FROM (SELECT {GRAY} AS v, count(*) AS n FROM pix GROUP BY 1)), "
        "sums AS (SELECT i, v, n, sum(n) OVER w AS s0, sum(n * v) OVER w AS s1, sum(n * v * v) OVER w AS s2 FROM hist WINDOW w AS (ORDER BY i)), "
        "costs AS (SELECT a.i AS a, b.i AS b, b.s2 - a.s2 + a.n * a.v * a.v - (b.s1 - a.s1 + a.n * a.v) ** 2 / (b.s0 - a.s0 + a.n) AS cost, (b.s1 - a.s1 + a.n * a.v) / (b.s0 - a.s0 + a.n) AS c FROM sums a JOIN sums b ON a.i <= b.i), "
        "d1 AS (SELECT b AS e, cost AS best, [c] AS cs FROM costs WHERE a = 1)"
    )
    for j in range(2, k + 1):
        levels += f", d{j} AS (SELECT c.b AS e, min(d.best + c.cost) AS best, arg_min(list_append(d.cs, c.c), d.best + c.cost) AS cs FROM costs c JOIN d{j - 1} d ON d.e = c.a - 1 GROUP BY 1)"
    return levels + f", centers AS (SELECT unnest(range(1, {k + 1})) - 1 AS k, unnest(cs) AS c FROM d{k} WHERE e = (SELECT max(i) FROM hist))"


@register("h6_fit_centers", "SELECT CAST(k AS INT) AS k, round(c, 6) AS c FROM centers", more=kmeans_sql(5))
def _(spark, d):
    return H.fit_intensities(B.gray(pix(spark, d)), 5).select("k", F.round(F.get("c", F.lit(0)), 6).alias("c"))


# --- tile scoring ------------------------------------------------------------

NEAR = f"SELECT p.slide, p.y, p.x FROM grid p JOIN pix m ON p.slide = m.slide AND abs(p.y - m.y) <= 1 AND abs(p.x - m.x) <= 1 GROUP BY ALL HAVING sum(m.r + m.g + m.b) / (255e0 * 3 * 9) > 0.5"


@register("i1_score_tiles", NEAR, more=GRID_SQL)
def _(spark, d):
    """From tiles written to the shared folder; absent pixels count as black."""
    import uuid

    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    store.write_tiles(A.to_tiles(pix(spark, d), 64, fill=0), path)
    return words.to_pixels(tiles.score(store.read_tiles(spark, path), I.mean_scorer(1), S, S, 64, 4, fill=0))


def channel_scorer(weights: tuple[float, float, float], reach: int) -> I.Scorer:
    """Weighted channels, smoothed over a square: what stands for a model in the query below."""
    smooth = I.mean_scorer(reach)
    return lambda block: smooth((block @ np.array(weights))[:, :, None])


#: A scorer and its threshold for each layer.
SCORERS = {
    "cortex": (channel_scorer((-1.0, 0.0, 0.0), 12), -0.72),
    "cap": (channel_scorer((0.0, -1.0, 0.0), 12), -0.45),
    "tubule": (channel_scorer((0.5, 0.5, 0.0), 2), 0.75),
    "vessel": (channel_scorer((1.0, -1.0, 0.0), 12), 0.22),
    "nuclei": (channel_scorer((0.0, 0.0, -1.0), 1), -0.2),
}


@register("slide_pipeline")
def _(spark, d):
    """Slides of 1,000 x 1,000 cells from their pixels to their scores, with the objects' own sizes."""
    return slide_plan.slide_scores(large_tiles(pix(spark, d, ("slide",))), 10 * S, 10 * S, 256, SCORERS, slide_plan.Sizes(fill=11, shrink=8, erode=3, halo=32, block=500))


@register("i2_score_tiles_no_halo", f"SELECT slide, y, x FROM pix WHERE CAST(255 - {GRAY} AS DOUBLE) / 255 > 0.6")
def _(spark, d):
    return I.score_tiles(B.invert_gray(pix(spark, d)), I.mean_scorer(0), S, S, 32, 0, 0.6, ("v",)).select(*KEY)


@register("i3_classify_patches", "SELECT DISTINCT slide, CAST(y + 2 + a.i AS INT) AS y, CAST(x + 2 + b.i AS INT) AS x FROM pix, range(4) a(i), range(4) b(i) WHERE y % 4 = 0 AND x % 4 = 0 AND g >= r - 60 AND g >= b")
def _(spark, d):
    patches = pix(spark, d).where("y % 4 = 0 and x % 4 = 0")
    return I.classify_patches(patches, lambda pdf: np.stack([pdf["r"] - 60, pdf["g"] + 0.5, pdf["b"]], 1), 8, 4)


#: Images of 50 x 50 with a white border, scored by the mean of 3 x 3 cells, and twice enlarged.
IMAGES_SQL = (
    f"{area_sql('ar', S, 50)}, small AS ({area_rows('ar', 'ar')}), "
    "framed AS (SELECT g.slide, g.y, g.x, coalesce(s.r + s.g + s.b, 765) AS v FROM (SELECT slide, a.i AS y, b.i AS x FROM (SELECT DISTINCT slide FROM pix), range(-1, 51) a(i), range(-1, 51) b(i)) g LEFT JOIN small s ON g.slide = s.slide AND g.y = s.y AND g.x = s.x), "
    "high AS (SELECT c.slide, c.y, c.x FROM framed c JOIN framed n ON c.slide = n.slide AND abs(c.y - n.y) <= 1 AND abs(c.x - n.x) <= 1 WHERE c.y BETWEEN 0 AND 49 AND c.x BETWEEN 0 AND 49 GROUP BY ALL HAVING sum(n.v) / (255e0 * 27) > 0.5)"
)


@register("i4_score_images", "SELECT slide, CAST(y * 2 + a.i AS INT) AS y, CAST(x * 2 + b.i AS INT) AS x FROM high, range(2) a(i), range(2) b(i)", more=IMAGES_SQL)
def _(spark, d):
    return I.score_images(pix(spark, d), I.mean_scorer(1), S, S, 50, 10, 2)


# --- votes -------------------------------------------------------------------

#: Predictions: windows of 24 cells every 12, task = window column mod 3, scores from the cell's colour.
PRED_SQL = "pred AS (SELECT slide, CAST(b.i % 3 AS INT) AS task, CAST(a.i * 12 AS INT) AS wy, CAST(b.i * 12 AS INT) AS wx, CAST(y - a.i * 12 AS INT) AS py, CAST(x - b.i * 12 AS INT) AS px, r AS score1, CAST(g + a.i * 20 AS INT) AS score0 FROM pix, range(7) a(i), range(7) b(i) WHERE y >= a.i * 12 AND y < a.i * 12 + 24 AND x >= b.i * 12 AND x < b.i * 12 + 24)"
VOTES_SQL = PRED_SQL + ", votes AS (SELECT slide, task, wy + py AS y, wx + px AS x, count(*) AS n FROM pred WHERE py >= 2 AND py < 22 AND px >= 2 AND px < 22 AND score1 > score0 GROUP BY 1, 2, wy + py, wx + px)"


def preds(spark: SparkSession, d: str) -> DataFrame:
    cells = E.patch_pixels(pix(spark, d), S, S, 24, 0.5)
    return cells.select("slide", (F.col("x0") / 12 % 3).cast("int").alias("task"), F.col("y0").alias("wy"), F.col("x0").alias("wx"), (F.col("y") - F.col("y0")).alias("py"), (F.col("x") - F.col("x0")).alias("px"), F.col("r").alias("score1"), (F.col("g") + F.col("y0") / 12 * 20).cast("int").alias("score0"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    return J.window_votes(preds(spark, d), 24, 2)


@register("j1_window_votes", "SELECT * FROM votes", more=VOTES_SQL)
def _(spark, d):
    return votes(spark, d)


@register("j2_majority", "SELECT * FROM votes WHERE n >= 2", more=VOTES_SQL)
def _(spark, d):
    return J.majority(votes(spark, d), 2)


@register("j3_unpad_resize", "SELECT v.slide, v.task, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, v.n FROM votes v JOIN range(160) a(i) ON v.y - 10 = a.i // 2 JOIN range(160) b(i) ON v.x - 10 = b.i // 2", more=VOTES_SQL)
def _(spark, d):
    from ..operators import resample as D

    inner = J.unpad(votes(spark, d), 10, S, S)
    return D.resize_nearest(inner, 80, 80, 160, 160)


SLICE_SQL = "sl AS (SELECT slide, task, wy + py AS y, wx + px AS x, sum(CAST(score1 > score0 AS INT)) AS n FROM pred WHERE py >= 3 AND py < 21 AND px >= 3 AND px < 21 GROUP BY 1, 2, wy + py, wx + px)"


@register("j4_merge_slices", "SELECT slide, task, y, x, CAST(n AS BIGINT) AS n FROM sl", more=PRED_SQL + ", " + SLICE_SQL)
def _(spark, d):
    p = preds(spark, d)
    flat = p.select("slide", "task", (F.col("wy") + F.col("py")).alias("y"), (F.col("wx") + F.col("px")).alias("x"), F.col("wy").alias("y0"), F.col("wx").alias("x0"), (F.col("score1") > F.col("score0")).cast("int").alias("pred"))
    return J.merge_slices(flat, 24, 3)


@register("j5_mask_votes", f"SELECT v.* FROM votes v JOIN {m_sql('tissue')} m USING (slide, y, x)", more=VOTES_SQL)
def _(spark, d):
    return J.mask_votes(votes(spark, d), mask(pix(spark, d), "tissue"))


OTHER_SQL = "oth AS (SELECT slide, y, x, task, n FROM votes UNION ALL SELECT slide, y, x, 6, 7 FROM (SELECT slide, y, x FROM grid EXCEPT SELECT slide, y, x FROM votes))"


def with_other(spark: SparkSession, d: str) -> DataFrame:
    return J.other_class(votes(spark, d), A.grid(pix(spark, d), S, S))


@register("j6_other_class", "SELECT * FROM oth", more=f"{VOTES_SQL}, {GRID_SQL}, {OTHER_SQL}")
def _(spark, d):
    return with_other(spark, d)


ARG_SQL = "arg AS (SELECT slide, y, x, max_by(task, n * 10 - task) AS class FROM oth GROUP BY ALL)"


@register("j7_argmax_class", "SELECT * FROM arg", more=f"{VOTES_SQL}, {GRID_SQL}, {OTHER_SQL}, {ARG_SQL}")
def _(spark, d):
    return J.argmax_class(with_other(spark, d))


@register("j8_task_layers", "SELECT slide, CASE class WHEN 0 THEN 'dt' WHEN 6 THEN 'other' ELSE 'capsule' END AS layer, y, x FROM arg UNION ALL SELECT slide, 'tuft', y, x FROM arg JOIN (SELECT slide, y, x FROM votes WHERE task = 2 AND n >= 2) USING (slide, y, x) WHERE class IN (1, 2)", more=f"{VOTES_SQL}, {GRID_SQL}, {OTHER_SQL}, {ARG_SQL}")
def _(spark, d):
    v = with_other(spark, d)
    return J.task_layers(J.argmax_class(v), v, {0: "dt", 1: "pt", 2: "vessel", 6: "other"}, (1, 2), 2, 2)


_INNER = "{0} v JOIN range(160) a(i) ON v.y - 10 = a.i // 2 JOIN range(160) b(i) ON v.x - 10 = b.i // 2"
SEGMENT_SQL = (
    f"tis AS (SELECT v.slide, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x FROM {_INNER.format(m_sql('tissue'))}), "
    f"vt AS (SELECT v.slide, v.task, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, v.n FROM {_INNER.format('votes')}), "
    "vm AS (SELECT vt.* FROM vt JOIN tis USING (slide, y, x)), "
    "fine AS (SELECT slide, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x FROM (SELECT DISTINCT slide FROM tis), range(160) a(i), range(160) b(i)), "
    "all_ AS (SELECT slide, y, x, task, n FROM vm UNION ALL SELECT slide, y, x, 6, 7 FROM (SELECT slide, y, x FROM fine EXCEPT SELECT slide, y, x FROM vm)), "
    "most AS (SELECT slide, y, x, max_by(task, n * 10 - task) AS class FROM all_ GROUP BY ALL)"
)


@register("vote_segmentation", "SELECT slide, CASE class WHEN 0 THEN 'dt' WHEN 6 THEN 'other' ELSE 'capsule' END AS layer, y, x FROM most UNION ALL SELECT slide, 'tuft', y, x FROM most JOIN (SELECT slide, y, x FROM vm WHERE task = 2 AND n >= 2) USING (slide, y, x) WHERE class IN (1, 2)", more=f"{VOTES_SQL}, {SEGMENT_SQL}")
def _(spark, d):
    from ..operators import resample as D

    tissue = D.upsample_nearest(J.unpad(mask(pix(spark, d), "tissue"), 10, S, S), 2, 2)
    return J.segmented(preds(spark, d), tissue, 24, 2, 10, S, 2, {0: "dt", 6: "other"}, (1, 2), 2, 2)


# --- block counts and scores -------------------------------------------------


def count_sql(e: str) -> str:
    return f"count(*) FILTER (WHERE {e})"


BY = '"by"'
BLOCK = "slide, CAST(y // 20 AS INT) AS by, CAST(x // 20 AS INT) AS bx"
TISSUE = R["cortex"]


def fib_sql(tissue: str, fib: str = FIB) -> str:
    return f"SELECT {BLOCK}, {count_sql(fib)} AS fib, {count_sql(tissue)} AS tissue, {count_sql(f'{tissue} AND NOT {R['vessel']} AND NOT {R['cap']}')} AS tissue_noglomvessel FROM pix GROUP BY slide, y // 20, x // 20"


@register("k1_block_fib_counts", fib_sql(TISSUE))
def _(spark, d):
    return K.block_fib_counts(presets.prepare(layers(pix(spark, d))), 20)




@register("k2_block_fib_counts_eroded", fib_sql(f"{R['eroded_cortex']} AND {R['cortex']}", FIB_CLUSTER))
def _(spark, d):
    from ..operators.algebra import _all

    return K.block_fib_counts(presets.prepare(layers(pix(spark, d))), 20, _all("eroded_cortex cortex"), region="eroded_cortex", clusters=True, no_background=False)


@register("k3_block_inflamm_counts", f"SELECT {BLOCK}, {count_sql(INFLAMM)} AS inflamm, {count_sql(f'{INFLAMM} OR {EXCLUSION} OR {FIB}')} AS interstitium FROM pix GROUP BY slide, y // 20, x // 20")
def _(spark, d):
    return K.block_inflamm_counts(presets.prepare(layers(pix(spark, d))), 20)


@register("k4_rollup_counts", f'SELECT slide, "by", bx, CAST(sum(fib) AS BIGINT) AS fib, CAST(sum(tissue) AS BIGINT) AS tissue FROM ({fib_sql(TISSUE)}) GROUP BY ROLLUP (slide, "by", bx)')
def _(spark, d):
    return K.rollup_counts(K.block_fib_counts(presets.prepare(layers(pix(spark, d))), 20), ["fib", "tissue"])


@register("k5_abnormal_score", f"SELECT slide, round(100e0 * coalesce(a.n, 0) / b.n, 6) AS abnormal FROM (SELECT slide, count(*) AS n FROM (SELECT DISTINCT slide, y // 2, x // 2 FROM pix WHERE {LAYERS['eroded_cortex']}) GROUP BY slide) b LEFT JOIN (SELECT slide, count(*) AS n FROM ({ABNORMAL_SQL}) GROUP BY slide) a USING (slide)")
def _(spark, d):
    px = pix(spark, d)
    return K.ratio_score(abnormal(px), downsample_mask(mask(px, "eroded_cortex"), 2, "any"), "abnormal").withColumn("abnormal", F.round("abnormal", 6))


@register("k6_simple_score", f"SELECT slide, round(100e0 * sum(fib) / sum(tissue), 6) AS fib_tissue FROM ({fib_sql(TISSUE)}) GROUP BY slide")
def _(spark, d):
    return K.simple_score(K.block_fib_counts(presets.prepare(layers(pix(spark, d))), 20)).withColumn("fib_tissue", F.round("fib_tissue", 6))


@register("k7_compare_runs", f"SELECT slide, {BY}, bx, coalesce(p.n, 0) AS a, coalesce(q.n, 0) AS b, coalesce(q.n, 0) - coalesce(p.n, 0) AS delta FROM (SELECT {BLOCK}, count(*) AS n FROM pix WHERE g > 185 GROUP BY slide, y // 20, x // 20) p FULL JOIN (SELECT {BLOCK}, count(*) AS n FROM pix WHERE g > 195 OR y < 15 GROUP BY slide, y // 20, x // 20) q USING (slide, {BY}, bx)")
def _(spark, d):
    px = pix(spark, d)
    count = lambda where: px.where(where).groupBy(*K.blocks(20)).agg(F.count(F.lit(1)).alias("n"))
    return K.compare_runs(count("g > 185"), count("g > 195 or y < 15"), ["slide", "by", "bx"], "n")


@register("k8_format_duration", "SELECT p_partkey, format('{}h {}m {}s', s // 3600, s % 3600 // 60, s % 60) AS took FROM (SELECT p_partkey, CAST(floor(p_retailprice * 11.5e0) AS BIGINT) AS s FROM part)", False)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", K.format_duration(F.col("p_retailprice") * 11.5).alias("took"))


@register("k9_validate_columns", "SELECT c_custkey, c_acctbal, c_nationkey FROM customer", False)
def _(spark, d):
    wanted = ["c_custkey", "c_acctbal", "c_nationkey"]
    return K.validate_columns(table(spark, d, "customer"), wanted).select(*wanted)


@register(
    "k10_score_by_grade",
    "SELECT grade, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(score) FILTER (score BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS low, max(score) FILTER (score BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS high, count(*) FILTER (NOT score BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS outliers FROM (SELECT *, count(*) OVER g AS n, quantile_cont(score, 0.25) OVER g AS q1, quantile_cont(score, 0.5) OVER g AS median, quantile_cont(score, 0.75) OVER g AS q3 FROM rows_ WINDOW g AS (PARTITION BY grade)) GROUP BY ALL",
    False,
    "rows_ AS (SELECT c_acctbal * CASE WHEN c_custkey % 10 = 3 THEN 4 ELSE 1 END AS score, CASE WHEN c_nationkey % 6 > 3 THEN NULL ELSE c_nationkey % 6 END AS grade FROM customer WHERE c_custkey % 17 != 0)",
)
def _(spark, d):
    c = table(spark, d, "customer")
    score = F.when(F.col("c_custkey") % 17 == 0, "n/a").otherwise((F.col("c_acctbal") * F.when(F.col("c_custkey") % 10 == 3, 4).otherwise(1)).cast("string"))
    graded = F.when(F.col("c_nationkey") % 6 == 5, "?").otherwise((F.col("c_nationkey") % 6).cast("string"))
    out = K.score_by_grade(c.select(score.alias("fib_score"), graded.alias("pathologist_score")))
    return out.select("grade", "n", *[F.round(q, 6).alias(q) for q in ("q1", "median", "q3")], "low", "high", "outliers")


# --- evaluation: prediction and label of a cell from its colour --------------

EVAL_SQL = "ev AS (SELECT slide * 100 + x % 10 AS image, slide % 2 AS class, y, x, y * 100 + x AS i, CAST(r > 150 AS INT) AS p, CASE WHEN y * 100 + x = f AND slide = 1 AND x % 2 = 0 THEN -1 ELSE CAST(g > 100 AS INT) END AS l, CAST(b AS DOUBLE) / 200 AS w, (r - 140) / 5e1 AS z FROM (SELECT *, min(y * 100 + x) OVER (PARTITION BY slide, x % 10) AS f FROM pix))"


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    px = pix(spark, d)
    i = F.col("y") * 100 + F.col("x")
    first = px.groupBy("slide", (F.col("x") % 10).alias("m")).agg(F.min(i).alias("f"))
    rows = px.withColumn("m", F.col("x") % 10).join(F.broadcast(first), ["slide", "m"])  # ten rows a slide
    unknown = (i == F.col("f")) & (F.col("slide") == 1) & (F.col("x") % 2 == 0)
    return rows.select((F.col("slide") * 100 + F.col("m")).alias("image"), (F.col("slide") % 2).alias("class"), "y", "x", i.alias("i"), (F.col("r") > 150).cast("int").alias("p"), F.when(unknown, -1).otherwise((F.col("g") > 100).cast("int")).alias("l"), (F.col("b") / 200.0).alias("w"), ((F.col("r") - 140) / 50.0).alias("z"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("k11_dice", "SELECT round(avg(d), 6) AS dice, count(*) AS images FROM (SELECT image, 2e0 * sum(p * l) / (sum(p) + sum(l) + 1) AS d FROM ev GROUP BY image)", more=EVAL_SQL)
def _(spark, d):
    return r6(K.dice(evaluated(spark, d)), "dice")


KNOWN = "(SELECT e.* FROM ev e JOIN (SELECT class, image FROM ev GROUP BY ALL HAVING min_by(l, i) != -1) USING (class, image))"


@register("k12_weighted_dice", f"SELECT round(avg(d), 6) AS dice FROM (SELECT class, avg(d) AS d FROM (SELECT class, image, (2e0 * sum(p * l * w) + 1) / (sum(p) + sum(l) + 1) AS d FROM {KNOWN} GROUP BY ALL) GROUP BY class)", more=EVAL_SQL)
def _(spark, d):
    return r6(K.weighted_dice(evaluated(spark, d)), "dice")


@register("k13_precision_smooth", f"SELECT round(1 - avg(d), 6) AS loss FROM (SELECT class, avg(d) AS d FROM (SELECT class, image, CAST(sum(p * l) AS DOUBLE) / (sum(p * l) + sum(p * (1 - l)) + 1) AS d FROM {KNOWN} GROUP BY ALL) GROUP BY class)", more=EVAL_SQL)
def _(spark, d):
    return r6(K.precision_smooth(evaluated(spark, d)), "loss")


@register("k14_weighted_bce", "SELECT class, round(avg(greatest(z, 0) - z * l + ln(1 + exp(-abs(z)))) * ln(CAST(any_value(total) AS DOUBLE) / count(*)), 6) AS loss FROM ev, (SELECT count(*) AS total FROM ev) GROUP BY class", more=EVAL_SQL)
def _(spark, d):
    rows = evaluated(spark, d)
    return r6(K.weighted_bce(rows, K.class_weight(rows)), "loss")


@register("k15_f1_macro", "SELECT image, round((coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2e0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS f1 FROM (SELECT image, count(*) FILTER (p = 1 AND l = 1) AS tp, count(*) FILTER (p = 1 AND l != 1) AS fp, count(*) FILTER (p != 1 AND l = 1) AS fn, count(*) FILTER (p != 1 AND l != 1) AS tn FROM ev GROUP BY image)", more=EVAL_SQL)
def _(spark, d):
    return r6(K.f1_macro(evaluated(spark, d)), "f1")


def surface_sql(source: str) -> str:
    return f"(SELECT slide, y, x FROM {source} EXCEPT SELECT slide, y, x FROM {erode_sql(source, 'pl')} WHERE y > 0 AND y < {S - 1} AND x > 0 AND x < {S - 1})"


def _plus() -> str:
    from ..operators.neighborhood import PLUS

    return offsets_table(PLUS, "pl")


@register(
    "k16_surface_distance",
    "SELECT slide, round(max(d), 6) AS hausdorff, round(avg(d), 6) AS mean FROM (SELECT a.slide, a.y, a.x, 0 AS k, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d FROM sa a JOIN sb b USING (slide) GROUP BY ALL UNION ALL SELECT a.slide, a.y, a.x, 1, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) FROM sb a JOIN sa b USING (slide) GROUP BY ALL) GROUP BY slide",
    more=f"{GRID_SQL}, {_plus()}, ma AS (SELECT slide, y, x FROM pix WHERE r > 100), mb AS (SELECT slide, y, x FROM pix WHERE g < 150), sa AS (SELECT * FROM {surface_sql('ma')}), sb AS (SELECT * FROM {surface_sql('mb')})",
)
def _(spark, d):
    px = pix(spark, d)
    return r6(K.surface_distance(px.where("r > 100").select(*KEY), px.where("g < 150").select(*KEY), S, S), "hausdorff", "mean")


@register("k17_crop_eval", "SELECT round(avg(d), 6) AS dice, count(*) AS images FROM (SELECT image, 2e0 * sum(p * l) / (sum(p) + sum(l) + 1) AS d FROM ev WHERE y >= 10 + image % 10 AND y < 80 AND x >= 5 AND x < 90 - image % 7 GROUP BY image)", more=EVAL_SQL)
def _(spark, d):
    rows = evaluated(spark, d)
    boxes = rows.select("image").distinct().select("image", (F.col("image") % 10 + 10).alias("rmin"), F.lit(80).alias("rmax"), F.lit(5).alias("cmin"), (90 - F.col("image") % 7).alias("cmax"))
    return r6(K.dice(K.crop_eval(rows, boxes)), "dice")


# --- data sets: file names from documents ------------------------------------

STEMS = ("im_{i}", "im_u{i}_a_5x_patch{j}", "im_u{i}_a_5x", "s{i}_region_{j}", "s{i}_rand_roi{j}", "note{i}")
MASKS = ("im_{i}_mask", "im_u{i}_a_5x_mask_patch{j}", "im_u{i}_a_5x_mask", "s{i}_region_mask", "s{i}_rand_roi_mask_x", "junk{i}")


def _name(parts: tuple[str, ...], spark_: bool):
    """A name by doc_id % 6; i is doc_id // 6, j is doc_id % 5."""
    out = []
    for p in parts:
        p = p.replace("{i}", "\0i\0").replace("{j}", "\0j\0")
        bits = [{"i": "CAST(doc_id DIV 6 AS STRING)" if spark_ else "CAST(doc_id // 6 AS VARCHAR)", "j": "CAST(doc_id % 5 AS STRING)" if spark_ else "CAST(doc_id % 5 AS VARCHAR)"}[b] if k % 2 else f"'{b}'" for k, b in enumerate(p.split("\0")) if b]
        out.append(" || ".join(bits))
    return "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(out)) + " END"


FOLDER = "CASE WHEN doc_id % 50 = 7 THEN 'dataset' ELSE source END"
BASE_SQL = "CASE doc_id % 6 WHEN 0 THEN 'im_' || CAST(doc_id // 6 AS VARCHAR) WHEN 1 THEN 'im_u' || CAST(doc_id // 6 AS VARCHAR) || '_a_5x_patch' || CAST(doc_id % 5 AS VARCHAR) WHEN 2 THEN 'im_u' || CAST(doc_id // 6 AS VARCHAR) || '_a' WHEN 5 THEN NULL ELSE 's' || CAST(doc_id // 6 AS VARCHAR) END"
KIND_SQL = "(['omniseg', 'uuid_patch', 'uuid', 'region', 'rand_roi', NULL])[doc_id % 6 + 1]"
NAMES_SQL = f"im AS (SELECT {FOLDER} AS folder, {_name(STEMS, False)} AS stem, {KIND_SQL} AS kind, {BASE_SQL} AS base FROM documents WHERE doc_id % 11 != 0), ma AS (SELECT {FOLDER} AS folder, {_name(MASKS, False)} AS stem, {KIND_SQL} AS kind, {BASE_SQL} AS base FROM documents WHERE doc_id % 13 != 0)"
PAIRS_SQL = NAMES_SQL + ", pairs AS (SELECT im.folder, im.kind, im.base, im.stem AS image, ma.stem AS mask FROM im JOIN ma USING (folder, kind, base) WHERE folder != 'dataset')"


def images(spark: SparkSession, d: str) -> DataFrame:
    return L.classify_image(table(spark, d, "documents").where("doc_id % 11 != 0").select(F.expr(FOLDER).alias("folder"), F.expr(_name(STEMS, True)).alias("stem")))


def masks(spark: SparkSession, d: str) -> DataFrame:
    return L.classify_mask(table(spark, d, "documents").where("doc_id % 13 != 0").select(F.expr(FOLDER).alias("folder"), F.expr(_name(MASKS, True)).alias("stem")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.pair(images(spark, d), masks(spark, d))


@register("l1_classify_image", "SELECT * FROM im", False, NAMES_SQL)
def _(spark, d):
    return images(spark, d)


@register("l2_classify_mask", "SELECT * FROM ma", False, NAMES_SQL)
def _(spark, d):
    return masks(spark, d)


@register("l3_pair", "SELECT * FROM pairs", False, PAIRS_SQL)
def _(spark, d):
    return pairs(spark, d)


@register("l4_diagnostics", "SELECT 'uncategorised' AS kind, folder, stem FROM im WHERE kind IS NULL UNION ALL SELECT 'missing', folder, stem FROM im WHERE kind IS NOT NULL AND NOT EXISTS (FROM ma WHERE ma.folder = im.folder AND ma.kind = im.kind AND ma.base = im.base) UNION ALL SELECT 'orphan', folder, stem FROM ma WHERE kind IS NOT NULL AND NOT EXISTS (FROM im WHERE ma.folder = im.folder AND ma.kind = im.kind AND ma.base = im.base)", False, NAMES_SQL)
def _(spark, d):
    a, b = images(spark, d), masks(spark, d)
    out = [("uncategorised", L.uncategorised(a)), ("missing", L.missing_mask(a, b)), ("orphan", L.orphan_mask(a, b))]
    parts = [df.select(F.lit(k).alias("kind"), "folder", "stem") for k, df in out]
    return parts[0].union(parts[1]).union(parts[2])


ORDER = "regexp_extract(image, '([0-9]+)', 1)"
SHUFFLED = hash_sql(f"CAST({ORDER} AS INT)", below=1000003)


def shuffled() -> list:
    return [E.hashed(F.regexp_extract("image", r"(\d+)", 1).cast("int"), below=1000003), F.col("image")]


SPLIT_SQL = PAIRS_SQL + f", sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY folder ORDER BY {SHUFFLED}, image) <= floor(count(*) OVER (PARTITION BY folder) * 9e-1) THEN 'train' ELSE 'validation' END AS part FROM pairs)"


@register("l5_split", "SELECT * FROM sp", False, SPLIT_SQL)
def _(spark, d):
    return L.split(pairs(spark, d), shuffled())


@register("l6_number_pairs", f"SELECT *, CAST(row_number() OVER (PARTITION BY folder, part ORDER BY {SHUFFLED}, image) - 1 AS INT) AS number FROM sp", False, SPLIT_SQL)
def _(spark, d):
    return L.number_pairs(L.split(pairs(spark, d), shuffled()), shuffled(), ["folder", "part"])


PATCH_SQL = "pa AS (SELECT 'st' || CAST(slide % 2 AS VARCHAR) AS folder, 'im' || CAST(slide AS VARCHAR) AS image, CAST(a.i * 12 AS INT) AS y0, CAST(b.i * 12 AS INT) AS x0, count(*) AS n FROM pix, range(7) a(i), range(7) b(i) WHERE r + g > 330 AND y >= a.i * 12 AND y < a.i * 12 + 24 AND x >= b.i * 12 AND x < b.i * 12 + 24 GROUP BY 1, 2, a.i, b.i)"


def patch_rows(spark: SparkSession, d: str) -> DataFrame:
    n = E.patch_pixels(mask(pix(spark, d), "tubule"), S, S, 24, 0.5).groupBy("slide", "y0", "x0").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.concat(F.lit("st"), (F.col("slide") % 2).cast("string")).alias("folder"), F.concat(F.lit("im"), F.col("slide").cast("string")).alias("image"), "y0", "x0", "n", (F.col("slide") != 3).alias("same_extent"))


@register("l7_patch_dataset", "SELECT folder, image, y0, x0, image || '_patch' || CAST(k AS VARCHAR) AS name, image || '_mask_patch' || CAST(k AS VARCHAR) AS mask_name FROM (SELECT *, row_number() OVER (PARTITION BY folder, image ORDER BY y0, x0) - 1 AS k FROM pa WHERE n >= 0.2 * 576 AND image != 'im3')", more=PATCH_SQL)
def _(spark, d):
    return L.patch_dataset(patch_rows(spark, d), 576, 0.2)[0]


@register("l7_patch_totals", "SELECT folder, count(*) FILTER (n >= 0.2 * 576 AND image != 'im3') AS kept, count(*) FILTER (n < 0.2 * 576 OR image = 'im3') AS skipped FROM pa GROUP BY folder", more=PATCH_SQL)
def _(spark, d):
    return L.patch_dataset(patch_rows(spark, d), 576, 0.2)[1]


@register("l8_zip_manifests", "SELECT source, i, a.doc_id AS first, b.doc_id AS second FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents WHERE doc_id % 3 = 0) a JOIN (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS i FROM documents WHERE doc_id % 2 = 0) b USING (source, i)", False)
def _(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    a, b = docs.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "first"), docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "second")
    return L.zip_manifests(a, b, "source", [F.col("first")], [F.desc("second")]).withColumn("i", F.col("i").cast("long"))


TREE = "CAST(doc_id % 5 AS {s}) || '_' || CAST(doc_id % 3 AS {s}) || '_x/' || CAST(doc_id {div} 2 % 4 AS {s}) || '/f' || CAST(doc_id {div} 2 AS {s}) || CASE WHEN doc_id % 2 = 1 THEN '_mask' || CAST(doc_id % 7 AS {s}) ELSE '' END || '.png'"


@register(
    "l9_task_tree_manifest",
    "SELECT i.path, min(m.path) AS mask, i.task_id, i.scale_id, replace(i.path, '/', '-') AS name FROM tr i JOIN tr m ON i.doc_id % 2 = 0 AND m.doc_id % 2 = 1 AND i.dir = m.dir AND i.doc_id // 2 = m.doc_id // 2 GROUP BY ALL",
    False,
    "tr AS (SELECT doc_id, " + TREE.format(s="VARCHAR", div="//").replace("doc_id % 5", "(doc_id // 2 % 5)").replace("doc_id % 3", "(doc_id // 2 % 3)") + " AS path, CAST(doc_id // 2 % 5 AS INT) AS task_id, CAST(doc_id // 2 % 3 AS INT) AS scale_id, doc_id // 2 % 4 AS dir FROM documents)",
)
def _(spark, d):
    path = TREE.format(s="STRING", div="DIV").replace("doc_id % 5", "(doc_id DIV 2 % 5)").replace("doc_id % 3", "(doc_id DIV 2 % 3)")
    return L.task_tree_manifest(table(spark, d, "documents").select(F.expr(path).alias("path")))


def preset_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: preset_scores(spark, d, name)


for _preset in presets.PRESETS:
    QUERIES[f"preset_{_preset}"] = preset_query(_preset)
    ORACLE_SQL[f"preset_{_preset}"] = f"WITH RECURSIVE {PIX_SQL}, {preset_ctes(_preset)} SELECT {SCORE_COLUMNS} FROM scores"
