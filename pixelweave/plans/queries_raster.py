"""Queries over the derived raster: sources, pixels, masks, resampling, patches, morphology, objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import algebra as C
from ..operators import neighborhood as N
from ..operators import objects as G
from ..operators import patches as E
from ..operators import pixels as B
from ..operators import resample as D
from ..operators.pixels import KEY
from ..sources import slides as A
from ..sources.tables import shared_dir
from . import presets
from .raster import GRID_SQL, LAYERS, PIX_SQL, SIDE, layers, mask, pix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
S = SIDE


def on_pix(name: str, sql: str | None = None, more: str = ""):
    """Register a function of the raster, with its SQL over ``pix`` (and the tables that ``more`` adds)."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, d: f(pix(spark, d))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {PIX_SQL}{more and ', ' + more} {sql}"
        return f

    return add


def m_sql(layer: str) -> str:
    return f"(SELECT slide, y, x FROM pix WHERE {LAYERS[layer]})"


def rounded(e: str) -> str:
    return f"CAST(floor({e} + 0.5) AS INT)"


# --- sources -----------------------------------------------------------------


@on_pix("a3_expand_levels", f"SELECT slide, CAST(vy * 2 ** i AS BIGINT) AS vy, CAST(vx * 2 ** i AS BIGINT) AS vx, CAST(i AS INT) AS level, CAST(floor(h / 2 ** i) AS INT) AS height, CAST(floor(w / 2 ** i) AS INT) AS width FROM (SELECT slide, 77000 + max(y) AS h, 25000 + max(x) AS w, 250 AS vy, 250 AS vx FROM pix GROUP BY 1), range(5) t(i)")
def _(px):
    return A.expand_levels(px.groupBy("slide").agg((F.max("y") + 77000).alias("height"), (F.max("x") + 25000).alias("width"), F.lit(250).cast("long").alias("vy"), F.lit(250).cast("long").alias("vx")), 5)


@on_pix("a4_level_repair_plan", f"SELECT slide, level, height, width, CASE WHEN slide + level = 5 THEN 'create' WHEN (slide * level) % 3 = 1 THEN 'regenerate' ELSE 'keep' END AS action FROM (SELECT slide, CAST(i AS INT) AS level, CAST(floor({S} / 2 ** i) AS INT) AS height, CAST(floor({S} / 2 ** i) AS INT) AS width FROM (SELECT DISTINCT slide FROM pix), range(5) t(i))")
def _(px):
    start = px.select("slide").distinct().select("slide", F.lit(S).alias("height"), F.lit(S).alias("width"), F.lit(1).alias("vy"), F.lit(1).alias("vx"))
    expected = A.expand_levels(start, 5)
    wrong = (F.col("slide") * F.col("level")) % 3 == 1
    return A.level_repair_plan(expected, expected.where("slide + level != 5").withColumn("height", F.when(wrong, F.col("height") + 1).otherwise(F.col("height"))))


@on_pix("a5_tiles_roundtrip", "SELECT slide, y, x, r, g, b FROM pix WHERE NOT (r = 255 AND g = 255 AND b = 255)")
def _(px):
    return A.from_tiles(A.to_tiles(px, 32))


PADDED = f"SELECT slide, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(p.b, 255) AS b FROM (SELECT DISTINCT slide FROM pix) CROSS JOIN range({S + 6}) a(i) CROSS JOIN range({S + 4}) b(i) LEFT JOIN pix p USING (slide)"


@on_pix("a6_pad_extent", f"SELECT g.slide, g.y, g.x, coalesce(p.r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(p.b, 255) AS b FROM (SELECT slide, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x FROM (SELECT DISTINCT slide FROM pix), range({S + 6}) a(i), range({S + 4}) b(i)) g LEFT JOIN pix p ON g.slide = p.slide AND g.y = p.y AND g.x = p.x")
def _(px):
    return A.pad_extent(px, S, S, 6, 4)


NAMES = [("foreground", 3), ("fill", 3), ("eroded", 3), ("cortex", 3), ("cap", 2), ("tubule", 2), ("vessel", 2), ("nuclei", 1), ("tbm", 1), ("bc", 1)]


@on_pix("a7_create_layers", f"SELECT slide, layer, level, CAST(floor({S} / 2 ** level) AS INT) AS height, CAST(floor({S} / 2 ** level) AS INT) AS width FROM (SELECT DISTINCT slide FROM pix), (VALUES {', '.join(f"('{n}', {k})" for n, k in NAMES)}) t(layer, level)")
def _(px):
    start = px.select("slide").distinct().select("slide", F.lit(S).alias("height"), F.lit(S).alias("width"), F.lit(1).alias("vy"), F.lit(1).alias("vx"))
    return A.create_layers(A.expand_levels(start, 5), NAMES)


ALL_LAYERS = " UNION ALL ".join(f"SELECT slide, y, x, '{n}' AS layer FROM pix WHERE {p}" for n, p in LAYERS.items())


def a8(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"
    A.write_layer(layers(pix(spark, d)), path)
    return A.read_layer(spark, path).select(F.col("slide").cast("int").alias("slide"), "y", "x", "layer")


QUERIES["a8_write_layer"] = a8
ORACLE_SQL["a8_write_layer"] = f"WITH {PIX_SQL} {ALL_LAYERS}"


@on_pix("a9_crop", "SELECT g.slide, g.y, g.x, coalesce(p.r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(p.b, 255) AS b FROM (SELECT slide, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x FROM (SELECT DISTINCT slide FROM pix), range(44) a(i), range(34) b(i)) g LEFT JOIN pix p ON g.slide = p.slide AND g.y + 20 - 2 = p.y AND g.x + 30 - 2 = p.x AND p.y BETWEEN 20 AND 59 AND p.x BETWEEN 30 AND 59")
def _(px):
    return A.crop(px, 20, 30, 40, 30, pad=8, level=2)


@on_pix("a10_select_roi", "SELECT * FROM pix WHERE y BETWEEN 20 AND 59 AND x BETWEEN 30 AND 59")
def _(px):
    return A.select_roi(px, 20, 30, 40, 30)


def mean_sql(source: str, h: int, w: int, k: int = 2) -> str:
    cells = k * k
    cols = ", ".join(f"CAST(floor((sum({c}) + 255 * ({cells} - count(*))) / {cells}) AS INT) AS {c}" for c in "rgb")
    return f"SELECT slide, CAST(y // {k} AS INT) AS y, CAST(x // {k} AS INT) AS x, {cols} FROM {source} WHERE y < {h // k * k} AND x < {w // k * k} GROUP BY 1, y // {k}, x // {k}"


def pyramid_sql(first: str, h: int, w: int, n: int) -> tuple[str, str]:
    parts, rows = [f"p0 AS (SELECT slide, y, x, r, g, b FROM {first})"], ["SELECT 0 AS level, * FROM p0"]
    for i in range(1, n + 1):
        parts.append(f"p{i} AS ({mean_sql(f'p{i - 1}', h, w)})")
        rows.append(f"SELECT {i} AS level, * FROM p{i}")
        h, w = h // 2, w // 2
    return ", ".join(parts), " UNION ALL ".join(rows)


_more, _rows = pyramid_sql("(SELECT slide, y - 20 AS y, x - 30 AS x, r, g, b FROM pix WHERE y BETWEEN 20 AND 59 AND x BETWEEN 30 AND 59)", 40, 30, 3)


@on_pix("a11_region_pyramid", _rows, _more)
def _(px):
    return A.region_pyramid(px, 20, 30, 40, 30)


@on_pix("a12_upsert_roi", f"SELECT * FROM {m_sql('tubule')} WHERE NOT (y BETWEEN 20 AND 59 AND x BETWEEN 30 AND 59) UNION ALL SELECT slide, y, x FROM pix WHERE y BETWEEN 20 AND 59 AND x BETWEEN 30 AND 59 AND b > 50")
def _(px):
    return A.upsert_roi(mask(px, "tubule"), px.withColumn("v", F.col("b") - 50), 20, 30, 40, 30)


def a13(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    per = pix(spark, d).groupBy("slide", F.floor(F.col("y") / 10).alias("by"), F.floor(F.col("x") / 10).alias("bx")).agg(F.count(F.lit(1)).alias("n"))
    A.write_counts(per, path, "pixels per block")
    return A.read_counts(spark, path)


QUERIES["a13_read_counts"] = a13
ORACLE_SQL["a13_read_counts"] = f"WITH {PIX_SQL} SELECT CAST(count(*) AS BIGINT) AS n FROM pix"


def a15(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/level-{uuid.uuid4().hex}"
    A.export_level(D.build_pyramid(pix(spark, d), S, S, 2), 2, path)
    return spark.read.parquet(path).select(F.col("slide").cast("int").alias("slide"), "y", "x", "r", "g", "b")


QUERIES["a15_export_level"] = a15
ORACLE_SQL["a15_export_level"] = f"WITH {PIX_SQL}, p1 AS ({mean_sql('pix', S, S)}) {mean_sql('p1', S // 2, S // 2)}"

# --- pixels ------------------------------------------------------------------

GRAY = rounded("r * 2.99e-1 + g * 5.87e-1 + b * 1.14e-1")


@on_pix("b1_gray", f"SELECT slide, y, x, {rounded('b * 2.99e-1 + g * 5.87e-1 + r * 1.14e-1')} AS swapped, {GRAY} AS v FROM pix")
def _(px):
    return B.gray(px).join(B.gray(px, swap=True).withColumnRenamed("v", "swapped"), KEY)


@on_pix("b2_sigmoid_contrast", f"SELECT slide, y, x, CAST(floor(2.55e2 / (1 + exp(2e0 * (7e-1 - CAST({GRAY} AS DOUBLE) / 2.55e2)))) AS INT) AS v FROM pix")
def _(px):
    return B.sigmoid_contrast(B.gray(px))


@on_pix("b3_sigmoid_norm", f"SELECT slide, y, x, round(2.55e2 / (1 + exp(-(v - beta) / 1.275e2)), 6) AS v FROM (SELECT slide, y, x, {GRAY} AS v, max({GRAY}) OVER (PARTITION BY slide) - min({GRAY}) OVER (PARTITION BY slide) AS beta FROM pix)")
def _(px):
    return B.sigmoid_norm(B.gray(px))


SV = f"(SELECT slide, y, x, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE {rounded('CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) * 255.0 / greatest(r, g, b)')} END AS s, greatest(r, g, b) AS v FROM pix)"


@on_pix("b4_hsv_sv", f"SELECT * FROM {SV}")
def _(px):
    return B.hsv_sv(px)


@on_pix("b5_foreground", f"SELECT * FROM {m_sql('tissue')}")
def _(px):
    return B.foreground(px)


def spread_sql(source: str, offsets: str) -> str:
    """Dilation by an offset table, cut to the extent."""
    return f"(SELECT DISTINCT slide, y, x FROM (SELECT m.slide, CAST(m.y + o.dy AS INT) AS y, CAST(m.x + o.dx AS INT) AS x FROM {source} m, {offsets} o) WHERE y BETWEEN 0 AND {S - 1} AND x BETWEEN 0 AND {S - 1})"


def erode_sql(source: str, offsets: str) -> str:
    gone = f"(SELECT slide, y, x FROM grid EXCEPT SELECT slide, y, x FROM {source})"
    minus = f"(SELECT -dy AS dy, -dx AS dx FROM {offsets})"
    return f"(SELECT slide, y, x FROM grid EXCEPT SELECT slide, y, x FROM {spread_sql(gone, minus)})"


def disk_sql(r: int) -> str:
    return f"(SELECT a.i - {r} AS dy, b.i - {r} AS dx FROM range({2 * r + 1}) a(i), range({2 * r + 1}) b(i) WHERE (a.i - {r}) * (a.i - {r}) + (b.i - {r}) * (b.i - {r}) <= {r * r})"


def shape_sql(shape: list[tuple[int, int, int]]) -> str:
    return "(VALUES " + ", ".join(f"({dy}, {dx})" for dy, a, b in shape for dx in range(a, b + 1)) + ") o(dy, dx)"


def offsets_table(shape: list[tuple[int, int, int]], name: str) -> str:
    return f"{name} AS (SELECT * FROM {shape_sql(shape)})"


def steps(first: str, ops: str, shape: str) -> tuple[str, str]:
    """CTEs of a chain of dilations (d) and erosions (e); the last one's name."""
    out, now = [], first
    for i, op in enumerate(ops):
        out.append(f"s{i} AS (SELECT * FROM {(spread_sql if op == 'd' else erode_sql)(now, shape)})")
        now = f"s{i}"
    return ", ".join(out), now


PALE = f"(SELECT slide, y, x FROM {SV} WHERE s < 120 AND v > 150)"
_more, _last = steps("pale", "ed" + "ddd" + "eee", "el")


@on_pix("b6_background_hsv", f"SELECT * FROM {_last}", f"{GRID_SQL}, {offsets_table(N.ELLIPSE_5, 'el')}, pale AS (SELECT * FROM {PALE} UNION SELECT slide, y, x FROM pix WHERE y % 20 < 9 AND x % 20 < 9), {_more}")
def _(px):
    pale = C.or_(B.background_hsv(px, 120, 150), px.where("y % 20 < 9 and x % 20 < 9"))
    return N.background_clean(pale, S, S)


@on_pix("b7_invert_gray", f"SELECT slide, y, x, 255 - {GRAY} AS v FROM pix")
def _(px):
    return B.invert_gray(px)


@on_pix("b8_normalize", "SELECT slide, y, x, round((r / 255.0 - 0.5) / 0.5, 6) AS v FROM pix")
def _(px):
    return B.normalize(px.select(*KEY, F.col("r").alias("v"))).withColumn("v", F.round("v", 6))


@on_pix("b9_clip_scale", "SELECT slide, y, x, least(greatest(CAST(r * 4 - 500 AS DOUBLE), -325.0), 325.0) / 325.0 AS v FROM pix")
def _(px):
    return B.clip_scale(px.select(*KEY, (F.col("r") * 4 - 500).cast("double").alias("v")))


@on_pix("b10_binarize", "SELECT slide, y, x, 'mask' AS kind FROM pix WHERE b != 0 UNION ALL SELECT slide, y, x, 'label' FROM pix WHERE b / 200.0 >= 0.5")
def _(px):
    v = px.select(*KEY, F.col("b").alias("v"))
    return B.binarize(v).withColumn("kind", F.lit("mask")).union(B.binarize(v.withColumn("v", F.col("v") / 200.0), 0.5).withColumn("kind", F.lit("label")))


@on_pix("b11_remap_labels", "SELECT slide, y, x, label, CASE WHEN label < 0 THEN -1 WHEN slide <= 1 THEN CAST(label >= 1 AS INT) ELSE CAST(label = 1 AS INT) END AS c0, CASE WHEN label < 0 OR slide > 1 THEN -1 ELSE CAST(label = 2 AS INT) END AS c1 FROM (SELECT slide, y, x, r % 4 - 1 AS label FROM pix)")
def _(px):
    return B.remap_labels(px.select(*KEY, (F.col("r") % 4 - 1).alias("label")), F.col("slide"))


@on_pix("b12_mask_color", f"SELECT p.slide, p.y, p.x, p.r, p.g, p.b, 'kept' AS kind FROM pix p JOIN {m_sql('tubule')} m USING (slide, y, x) UNION ALL SELECT slide, y, x, CASE WHEN {LAYERS['tubule']} THEN 0 ELSE r END, CASE WHEN {LAYERS['tubule']} THEN 0 ELSE g END, CASE WHEN {LAYERS['tubule']} THEN 0 ELSE b END, 'erased' FROM pix")
def _(px):
    m = mask(px, "tubule")
    return B.mask_color(px, m).select(*KEY, "r", "g", "b", F.lit("kept").alias("kind")).union(B.erase(px, m).withColumn("kind", F.lit("erased")))


@on_pix("b13_black_to_white", f"SELECT slide, y, x, {', '.join(f'CASE WHEN r < 100 AND g < 100 AND b < 100 THEN 255 ELSE {c} END AS {c}' for c in 'rgb')} FROM pix")
def _(px):
    low = (F.col("r") < 100) & (F.col("g") < 100) & (F.col("b") < 100)
    return B.black_to_white(px.select(*KEY, *[F.when(low, 0).otherwise(F.col(c)).alias(c) for c in "rgb"]))


COLOUR_ROWS = [(i, *c) for i, c in enumerate(B.COLOURS.values())]
CLASS_OF = "CASE WHEN r + g > 330 THEN 0 WHEN b < 40 THEN 1 WHEN g < 40 THEN 2 END"


@on_pix(
    "b14_overlay",
    "SELECT p.slide, p.y, p.x, " + ", ".join(f"CAST(least(255, floor(p.{c} / 2.0 + coalesce(CAST(t.{c} AS INT), 128) / 6.0)) AS INT) AS {c}" for c in "rgb") + " FROM pix p LEFT JOIN t USING (slide, y, x)",
    f"col AS (SELECT * FROM (VALUES {', '.join(map(str, COLOUR_ROWS))}) v(class, r, g, b)), cl AS (SELECT slide, y, x, {CLASS_OF} AS class FROM pix UNION ALL SELECT slide, y, x, 3 FROM pix WHERE r % 3 = 0), t AS (SELECT slide, y, x, sum(col.r) AS r, sum(col.g) AS g, sum(col.b) AS b FROM cl JOIN col USING (class) GROUP BY ALL)",
)
def _(px):
    classes = px.select(*KEY, F.expr(CLASS_OF).alias("class")).where("class is not null").union(px.where("r % 3 = 0").select(*KEY, F.lit(3).alias("class")))
    return B.overlay(px, classes, px.sparkSession.createDataFrame(COLOUR_ROWS, "class int, r int, g int, b int"))


@on_pix("b15_class_legend", f"SELECT class, ([{', '.join(repr(c) for c in B.COLOURS)}])[row_number() OVER (ORDER BY class)] AS colour FROM (SELECT DISTINCT 'c' || CAST(r % 7 AS VARCHAR) AS class FROM pix)")
def _(px):
    return B.class_legend(px.select(F.concat(F.lit("c"), (F.col("r") % 7).cast("string")).alias("class")))


#: Equalised gray as ``eq``: clipped histograms of 8 x 8 tiles, 13 cells a side, blended between the four tiles around a cell.
CLAHE_SQL = (
    f"gy AS (SELECT slide, y, x, {GRAY} AS v FROM pix), "
    "hi AS (SELECT slide, y // 13 AS ty, x // 13 AS tx, v, CAST(count(*) AS DOUBLE) AS n FROM gy GROUP BY 1, y // 13, x // 13, v), "
    "tot AS (SELECT slide, ty, tx, sum(n) AS total, greatest(1e0, 2e0 * sum(n) / 256) AS most FROM hi GROUP BY ALL), "
    "kp AS (SELECT h.slide, h.ty, h.tx, h.v, h.n, least(h.n, t.most) AS kept, t.total FROM hi h JOIN tot t USING (slide, ty, tx)), "
    "sp AS (SELECT slide, ty, tx, any_value(total) AS total, sum(n - kept) AS spare FROM kp GROUP BY ALL), "
    "lk AS (SELECT s.slide, s.ty, s.tx, r.i AS v, 255e0 * sum(coalesce(k.kept, 0e0) + s.spare / 256) OVER (PARTITION BY s.slide, s.ty, s.tx ORDER BY r.i) / s.total AS level FROM sp s CROSS JOIN range(256) r(i) LEFT JOIN kp k ON k.slide = s.slide AND k.ty = s.ty AND k.tx = s.tx AND k.v = r.i), "
    "pl AS (SELECT slide, y, x, v, floor((y + 5e-1) / 13 - 5e-1) AS y0, floor((x + 5e-1) / 13 - 5e-1) AS x0, (y + 5e-1) / 13 - 5e-1 AS fy, (x + 5e-1) / 13 - 5e-1 AS fx FROM gy), "
    "cn AS (SELECT slide, y, x, v, y0 + a.i AS ty, x0 + b.i AS tx, (CASE a.i WHEN 1 THEN fy - y0 ELSE 1 - (fy - y0) END) * (CASE b.i WHEN 1 THEN fx - x0 ELSE 1 - (fx - x0) END) AS w FROM pl, range(2) a(i), range(2) b(i)), "
    "eq AS (SELECT c.slide, c.y, c.x, CAST(floor(sum(c.w * l.level) / sum(c.w) + 5e-1) AS INT) AS v FROM cn c JOIN lk l ON c.slide = l.slide AND c.ty = l.ty AND c.tx = l.tx AND c.v = l.v GROUP BY ALL)"
)


@on_pix("b16_clahe", "SELECT slide, y, x, v FROM eq", CLAHE_SQL)
def _(px):
    return B.clahe(B.gray(px), S, S, grid=8)


@on_pix("b17_world_to_voxel", "SELECT slide, level, (y0 * 1000) // v AS begin_y, (x0 * 1000) // v AS begin_x, (y1 * 1000) // v AS end_y, (x1 * 1000) // v AS end_x, (y0 * 1000) % v = 0 AND (x0 * 1000) % v = 0 AND (y1 * 1000) % v = 0 AND (x1 * 1000) % v = 0 AS exact FROM (SELECT slide, CAST(i AS INT) AS level, CAST(250 * 2 ** i AS BIGINT) AS v, CAST(min(y) AS BIGINT) AS y0, CAST(min(x) AS BIGINT) AS x0, CAST(max(y) AS BIGINT) AS y1, CAST(max(x) AS BIGINT) AS x1 FROM pix, range(5) t(i) GROUP BY ALL)")
def _(px):
    roi = px.groupBy("slide").agg(*[(f(c).cast("long") * 1000 + 40).alias(f"{n}_{c}") for n, f in (("begin", F.min), ("end", F.max)) for c in "yx"])
    start = px.select("slide").distinct().select("slide", F.lit(S).alias("height"), F.lit(S).alias("width"), F.lit(250).alias("vy"), F.lit(250).alias("vx"))
    return B.world_to_voxel(roi, A.expand_levels(start, 5).select("slide", "level", "vy", "vx", F.lit(40).alias("oy"), F.lit(40).alias("ox")))


@on_pix("b18_roi_ops", "SELECT slide, k, (a - 5) * 4 AS y0, (b - 7) * 4 AS x0, (c - 5) * 4 AS y1, (d - 7) * 4 AS x1 FROM (SELECT slide, k, greatest(y0 - 6, 0) AS a, greatest(x0 - 6, 0) AS b, least(y1 + 6, 60) AS c, least(x1 + 6, 60) AS d FROM (SELECT slide, r % 9 AS k, min(y) AS y0, min(x) AS x0, min(y) + r % 9 AS y1, min(x) + 3 AS x1 FROM pix WHERE y + x > 60 GROUP BY 1, 2)) WHERE a < c AND b < d")
def _(px):
    roi = px.where("y + x > 60").groupBy("slide", (F.col("r") % 9).alias("k")).agg(F.min("y").alias("y0"), F.min("x").alias("x0")).withColumns({"y1": F.col("y0") + F.col("k"), "x1": F.col("x0") + 3})
    return B.roi_ops(roi, 6, 60, 60, 5, 7, 4)


# --- mask algebra ------------------------------------------------------------

#: Layers after overlaps are resolved and the ring is set, as conditions on a row of pix.
R = {n: f"({p})" for n, p in LAYERS.items()}
R["vessel"] = f"({R['vessel']} AND NOT {R['tubule']} AND NOT {R['cap']})"
R["cap"] = f"({R['cap']} AND NOT {R['tubule']})"
_none = lambda names: " AND ".join(f"NOT {R[n]}" for n in names.split())
R["vessel_ring"] = f"({R['vessel_dilated']} AND {R['cortex']} AND {_none('nuclei tubule cap tbm bc background')})"
FIB = f"({R['tissue']} AND {R['cortex']} AND {_none('tubule cap vessel vessel_ring nuclei tbm bc background')})"
FIB_CLUSTER = f"(({R['fib1']} OR {R['fib2']} OR {R['structural']}) AND {R['eroded_cortex']} AND {_none('tubule cap vessel vessel_ring tbm bc')})"
COLLAGEN = f"(({R['structural']} OR {R['vessel_ring']} OR {R['tbm']} OR {R['bc']}) AND {_none('tubule cap vessel')})"
EXCLUSION = f"(({R['vessel_ring']} OR {R['tbm']} OR {R['bc']}) AND {R['cortex']} AND {_none('background nuclei tubule cap vessel')})"
INFLAMM = f"({R['nuclei']} AND {R['cortex']} AND {_none('tubule cap vessel background')})"

_BITS = " + ".join(f"CASE WHEN {LAYERS[n]} THEN {1 << i} ELSE 0 END" for i, n in enumerate(C.LAYERS) if n in LAYERS)


@on_pix("c1_stack", f"SELECT * FROM (SELECT slide, y, x, CAST({_BITS} AS INT) AS bits FROM pix) WHERE bits > 0")
def _(px):
    return C.pixel_bits(C.stack(layers(px)))


@on_pix("c2_set_operations", f"SELECT slide, y, x, 'and' AS kind FROM pix WHERE {LAYERS['tubule']} AND {LAYERS['nuclei']} UNION ALL SELECT slide, y, x, 'or' FROM pix WHERE {LAYERS['tubule']} OR {LAYERS['nuclei']} UNION ALL SELECT slide, y, x, 'minus' FROM pix WHERE {LAYERS['tubule']} AND NOT {LAYERS['nuclei']}")
def _(px):
    a, b = mask(px, "tubule"), mask(px, "nuclei")
    named = lambda df, k: df.withColumn("kind", F.lit(k))
    return named(C.and_(a, b), "and").union(named(C.or_(a, b), "or")).union(named(C.minus(a, b), "minus"))


def stacked_query(name: str, where: str, predicate, prepared: bool = True) -> None:
    on_pix(name, f"SELECT slide, y, x FROM pix WHERE {where}")(lambda px: C.where(presets.prepare(layers(px)) if prepared else C.stack(layers(px)), predicate()))


stacked_query("c3_restrict", f"{LAYERS['tubule']} AND {LAYERS['cortex']} AND NOT ({LAYERS['background']})", lambda: C.restrict("tubule"), prepared=False)
stacked_query("c4_resolve_overlaps", f"{R['cap']} OR {R['vessel']}", lambda: C._any("cap vessel"))
stacked_query("c5_vessel_ring", R["vessel_ring"], lambda: C.has("vessel_ring"))
stacked_query("c6_fibrosis_residual", FIB, C.fibrosis)
stacked_query("c7_fibrosis_cluster", FIB_CLUSTER, lambda: C.fibrosis(region="eroded_cortex", clusters=True, no_background=False))
stacked_query("c8_collagen", COLLAGEN, C.collagen)
stacked_query("c9_collagen_exclusion", EXCLUSION, C.collagen_exclusion)
stacked_query("c10_inflammation", INFLAMM, C.inflammation)
stacked_query("c11_interstitium", f"{INFLAMM} OR {EXCLUSION} OR {FIB}", C.interstitium)


@on_pix("c12_eroded_cortex", f"SELECT slide, y * 4 + CAST(a.i AS INT) AS y, x * 4 + CAST(b.i AS INT) AS x FROM {m_sql('cortex')} JOIN {m_sql('eroded_cortex')} USING (slide, y, x), range(4) a(i), range(4) b(i)")
def _(px):
    return D.upsample_nearest(C.and_(mask(px, "cortex"), mask(px, "eroded_cortex")), 4, 4)


@on_pix("c13_cortical_tissue", f"SELECT 's' || CAST(slide AS VARCHAR) AS base, y, x FROM pix WHERE slide != 2 AND slide != 3 AND {LAYERS['cortex']} AND {LAYERS['tissue']}")
def _(px):
    base = F.concat(F.lit("s"), F.col("slide").cast("string")).alias("base")
    kinds = F.explode(F.array(F.lit("cortex"), F.lit("tissue"))).alias("kind")
    extents = px.select("slide").distinct().select(base, "slide", kinds).where("not (slide = 2 and kind = 'tissue')").select("base", "kind", F.lit(S).alias("height"), F.when((F.col("base") == "s3") & (F.col("kind") == "tissue"), S + 1).otherwise(S).alias("width"))
    of = lambda n: mask(px, n).select(base, "y", "x")
    return C.cortical_tissue(of("cortex"), of("tissue"), extents)


@on_pix("c14_inflamm_outside", f"SELECT slide, y, x FROM pix WHERE r // 5 % 5 = 4 AND NOT ({LAYERS['tubule']} OR {LAYERS['cap']} OR {LAYERS['vessel']})")
def _(px):
    structures = C.or_(C.or_(mask(px, "tubule"), mask(px, "cap")), mask(px, "vessel"))
    return C.inflamm_outside(px.select(*KEY, (F.floor(F.col("r") / 5) % 5).alias("class")), structures)


@on_pix("c15_hist_mask", f"SELECT slide, y, x FROM grid EXCEPT SELECT slide, y, x FROM pix WHERE {LAYERS['tubule']} OR {LAYERS['cap']} OR {LAYERS['vessel']}", GRID_SQL)
def _(px):
    return C.hist_mask(A.grid(px, S, S), mask(px, "tubule"), mask(px, "cap"), mask(px, "vessel"))


# --- resampling --------------------------------------------------------------


@on_pix("d1_coarsen_mean", mean_sql("pix", 99, 99))
def _(px):
    return D.coarsen_mean(px, 99, 99)


@on_pix("d2_downsample_mask", " UNION ALL ".join(f"SELECT slide, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, '{k}' AS kind FROM {m_sql('tissue')} GROUP BY 1, y // 2, x // 2 HAVING count(*) >= {n}" for k, n in (("all", 4), ("any", 1), ("mean", 2))))
def _(px):
    m = mask(px, "tissue")
    out = [D.downsample_mask(m, 2, k).withColumn("kind", F.lit(k)) for k in ("all", "any", "mean")]
    return out[0].union(out[1]).union(out[2])


@on_pix("d3_upsample_nearest", f"SELECT slide, y * 2 + CAST(a.i AS INT) AS y, x * 3 + CAST(b.i AS INT) AS x FROM {m_sql('tubule')}, range(2) a(i), range(3) b(i)")
def _(px):
    return N.from_runs(D.upsample_runs(N.to_runs(mask(px, "tubule")), 2, 3))


@on_pix("d4_resize_nearest", "SELECT slide, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, r FROM pix JOIN range(75) a(i) ON pix.y = floor((a.i + 0.5) * 100 / 75) JOIN range(150) b(i) ON pix.x = floor((b.i + 0.5) * 100 / 150)")
def _(px):
    return D.resize_nearest(px.select(*KEY, "r"), S, S, 75, 150)


def area_sql(name: str, n: int, to: int) -> str:
    """Shares of source cells c in target cells t along one axis."""
    return f"{name} AS (SELECT c.i AS c, t.i AS t, {to} * (least((c.i + 1e0) / {n}, (t.i + 1e0) / {to}) - greatest((c.i + 0e0) / {n}, (t.i + 0e0) / {to})) AS w FROM range({n}) c(i), range({to}) t(i) WHERE t.i >= floor(c.i * {to} / {n}e0) AND t.i <= ceil((c.i + 1) * {to} / {n}e0) - 1)"


def area_rows(a: str, b: str) -> str:
    cols = ", ".join(f"CAST(floor(round(sum(v.w * h.w * (p.{c} - 255)), 6) + 255 + 0.5e0) AS INT) AS {c}" for c in "rgb")
    return f"SELECT p.slide, CAST(v.t AS INT) AS y, CAST(h.t AS INT) AS x, {cols} FROM pix p JOIN {a} v ON p.y = v.c JOIN {b} h ON p.x = h.c GROUP BY p.slide, v.t, h.t"


@on_pix("d4_resize_area", area_rows("ar", "ar"), area_sql("ar", S, 75))
def _(px):
    return D.resize_area(px, S, S, 75, 75)


_LINEAR = f"li AS (SELECT to_, greatest(0, least(63, c)) AS c, w FROM (SELECT t.i AS to_, floor((t.i + 0.5e0) * 64 / {S} - 0.5e0) AS c, 1 - (((t.i + 0.5e0) * 64 / {S} - 0.5e0) - floor((t.i + 0.5e0) * 64 / {S} - 0.5e0)) AS w FROM range({S}) t(i) UNION ALL SELECT t.i, floor((t.i + 0.5e0) * 64 / {S} - 0.5e0) + 1, ((t.i + 0.5e0) * 64 / {S} - 0.5e0) - floor((t.i + 0.5e0) * 64 / {S} - 0.5e0) FROM range({S}) t(i)))"


@on_pix(
    "d5_limit_dim",
    "SELECT * FROM (SELECT m.slide, CAST(v.to_ AS INT) AS y, CAST(h.to_ AS INT) AS x, CAST(floor(round(255 * sum(v.w * h.w), 6) + 0.5e0) AS INT) AS v FROM fg m JOIN li v ON m.y = v.c JOIN li h ON m.x = h.c GROUP BY m.slide, v.to_, h.to_) WHERE v > 0",
    f"{area_sql('ar', S, 64)}, small AS ({area_rows('ar', 'ar')}), fg AS (SELECT slide, y, x FROM small WHERE NOT (r > 205 AND g > 205 AND b > 205)), {_LINEAR}",
)
def _(px):
    small, h, w = D.limit_dim(px, S, S, 64)
    return D.restore_mask(B.foreground(small), h, w, S, S)


_more, _rows = pyramid_sql("pix", S, S, 4)


@on_pix("d6_build_pyramid", _rows, _more)
def _(px):
    return D.build_pyramid(px, S, S, 4)


# --- tiles and patches -------------------------------------------------------


@on_pix("e1_tiles_grid", "SELECT slide, y, x, CAST(y // 24 AS INT) AS ty, CAST(x // 32 AS INT) AS tx FROM pix WHERE y < 96 AND x < 96")
def _(px):
    return E.tiles_grid(px.select(*KEY), S, S, 24, 32)


@on_pix("e2_pct_black", "SELECT slide, CAST(y // 24 AS INT) AS ty, CAST(x // 32 AS INT) AS tx, round(100.0 * count(*) FILTER (b = 0) / count(*), 6) AS pct FROM pix WHERE y < 96 AND x < 96 GROUP BY 1, y // 24, x // 32 HAVING 100.0 * count(*) FILTER (b = 0) / count(*) < 6")
def _(px):
    dark = px.select(*KEY, *[F.when(F.col("b") == 0, 0).otherwise(1).alias(c) for c in "rg"], "b")
    return E.pct_black(E.tiles_grid(dark, S, S, 24, 32), 6).withColumn("pct", F.round("pct", 6))


PATCHES = "SELECT CAST(a.i * 8 + b.i AS INT) AS patch_idx, CAST(a.i * 10 AS INT) AS y0, CAST(b.i * 10 AS INT) AS x0 FROM range(8) a(i), range(8) b(i)"


#: Each slide's own extent.
EXTENT_SQL = "ext AS (SELECT slide, CAST(max(y) + 1 AS INT) AS height, CAST(max(x) + 1 AS INT) AS width FROM pix GROUP BY slide)"


def extents(px: DataFrame) -> DataFrame:
    return px.groupBy("slide").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


@on_pix(
    "e3_patches_overlap",
    "SELECT slide, CAST(i * cols + j AS INT) AS patch_idx, CAST(i * 10 AS INT) AS y0, CAST(j * 10 AS INT) AS x0 FROM (SELECT *, unnest(range(cols)) AS j FROM (SELECT slide, (width - 24) // 10 + 1 AS cols, unnest(range((height - 24) // 10 + 1)) AS i FROM ext))",
    EXTENT_SQL,
)
def _(px):
    return E.slide_patches(extents(px), 24, 0.55)


@on_pix("e4_min_positive", f"SELECT slide, y0, x0, count(*) AS n FROM {m_sql('tubule')} m, p WHERE y >= y0 AND y < y0 + 24 AND x >= x0 AND x < x0 + 24 GROUP BY ALL HAVING count(*) >= 0.22 * 576", f"p AS ({PATCHES})")
def _(px):
    return E.min_positive(mask(px, "tubule"), S, S, 24, 0.55, 0.22)


@on_pix("e5_padded_overlap_patches", f"SELECT DISTINCT slide, CAST(a.i * 12 AS INT) AS y0, CAST(b.i * 12 AS INT) AS x0 FROM {m_sql('cap')} m, range(9) a(i), range(9) b(i) WHERE y + 12 >= a.i * 12 AND y + 12 < a.i * 12 + 24 AND x + 12 >= b.i * 12 AND x + 12 < b.i * 12 + 24")
def _(px):
    return E.padded_overlap_patches(mask(px, "cap"), S, S, 24, 12)


@on_pix("e6_halo_tiles", "SELECT slide, y, x, CAST(a.i AS INT) AS ty, CAST(b.i AS INT) AS tx, y // 25 = a.i AND x // 25 = b.i AS inner FROM pix, range(4) a(i), range(4) b(i) WHERE y >= a.i * 25 - 3 AND y < a.i * 25 + 28 AND x >= b.i * 25 - 3 AND x < b.i * 25 + 28".replace(" AS inner", ' AS "inner"'))
def _(px):
    return E.halo_tiles(px.select(*KEY), S, S, 25, 3)


INTEGRAL = f"(SELECT slide, y, x, CAST(sum(s) OVER (PARTITION BY slide, x ORDER BY y) AS BIGINT) AS s FROM (SELECT g.slide, g.y, g.x, sum(CASE WHEN m.y IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY g.slide, g.y ORDER BY g.x) AS s FROM grid g LEFT JOIN {m_sql('tubule')} m ON g.slide = m.slide AND g.y = m.y AND g.x = m.x))"


@on_pix("e7_integral_image", f"SELECT * FROM {INTEGRAL}", GRID_SQL)
def _(px):
    return E.integral_image(mask(px, "tubule"), A.grid(px, S, S))


COUNTED = f"(SELECT p.slide, p.y, p.x, count(*) AS n FROM grid p JOIN {m_sql('tubule')} m ON p.slide = m.slide AND m.y > p.y AND m.y <= p.y + 20 AND m.x > p.x AND m.x <= p.x + 16 WHERE p.y + 20 < {S} AND p.x + 16 < {S} GROUP BY ALL HAVING count(*) >= 20 * 16 * 0.2)"


@on_pix("e8_patch_counts", f"SELECT * FROM {COUNTED}", GRID_SQL)
def _(px):
    return E.count_patches(mask(px, "tubule"), S, S, 20, 16, 0.2)


@on_pix("e9_grid_points", "SELECT slide, y, x FROM pix WHERE x % 10 + y % 5 = 0")
def _(px):
    return E.grid_points(px.select(*KEY), 10, 5)


@on_pix("e10_patch_offsets", f"SELECT slide, CAST(y * 2000 AS BIGINT) AS oy, CAST(x * 2000 AS BIGINT) AS ox FROM {COUNTED} WHERE x % 4 + y % 5 = 0", GRID_SQL)
def _(px):
    return E.patch_offsets(E.count_patches(mask(px, "tubule"), S, S, 20, 16, 0.2), 4, 5, 2000, 2000)


@on_pix("e11_roi_coverage", f"SELECT slide, CAST(y + a.i AS INT) AS y, CAST(x + b.i AS INT) AS x, count(*) AS n FROM {m_sql('cap')} m, range(6) a(i), range(8) b(i) GROUP BY 1, y + a.i, x + b.i")
def _(px):
    return E.roi_coverage(mask(px, "cap"), 6, 8, count=True)


@on_pix("e12_mosaic", f"SELECT g.slide, g.y AS row, g.x AS col, coalesce(p.r % 4 + 1, 0) AS class FROM grid g LEFT JOIN pix p ON g.slide = p.slide AND g.y = p.y AND g.x = p.x", GRID_SQL)
def _(px):
    return E.mosaic(px.select("slide", F.format_string("tiles/l_%d-%d.png", "y", "x").alias("name"), (F.col("r") % 4).alias("pred")), S, S)


@on_pix("e13_paint_center", "SELECT DISTINCT slide, CAST(y + 2 + a.i AS INT) AS y, CAST(x + 2 + b.i AS INT) AS x FROM pix, range(4) a(i), range(4) b(i) WHERE y % 4 = 0 AND x % 4 = 0 AND r % 3 = 1")
def _(px):
    return E.paint_center(px.where("y % 4 = 0 and x % 4 = 0").select(*KEY, (F.col("r") % 3).alias("class")), 8, 4)


def hash_sql(*keys: str, seed: int = 0, below: int = 1000) -> str:
    h = f"CAST({seed + 7} AS BIGINT)"
    for k in keys:
        h = f"(({h} * 31 + CAST({k} AS BIGINT) + 17) % 1000003)"
        h = f"(({h} * {h} + {h} * 7 + 13) % 1000003)"
    return f"CAST({h} % {below} AS INT)"


def _jitter(c: str, n: str, k: int) -> str:
    return f"CAST(CASE WHEN i > 0 AND i < rows - 1 AND j > 0 AND j < cols - 1 THEN least(greatest(least({c} * 12, {n} - 24) + {hash_sql('slide', 'i', 'j', seed=k, below=24)} - 12, 0), {n} - 24) ELSE least({c} * 12, {n} - 24) END AS INT)"


@on_pix(
    "e14_jitter_windows",
    f"SELECT slide, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_jitter('i', 'height', 0)} AS y, {_jitter('j', 'width', 1)} AS x FROM (SELECT *, unnest(range(cols)) AS j FROM (SELECT *, unnest(range(rows)) AS i FROM (SELECT *, (height - 24 + 11) // 12 + 1 AS rows, (width - 24 + 11) // 12 + 1 AS cols FROM ext)))",
    EXTENT_SQL,
)
def _(px):
    return E.slide_windows(extents(px), 24, 12)


# --- neighbourhoods ----------------------------------------------------------


@on_pix("f1_dilate", f"SELECT 3 AS radius, * FROM {spread_sql(m_sql('cap'), disk_sql(3))} UNION ALL SELECT 7, * FROM {spread_sql(m_sql('cap'), disk_sql(7))}")
def _(px):
    m = mask(px, "cap")
    return N.dilate(m, 3, S, S).select(F.lit(3).alias("radius"), *KEY).union(N.dilate(m, 7, S, S).select(F.lit(7).alias("radius"), *KEY))


@on_pix("f2_erode", f"SELECT * FROM {erode_sql(m_sql('tissue'), disk_sql(1))}", GRID_SQL)
def _(px):
    return N.erode(mask(px, "tissue"), 1, S, S)


@on_pix("f3_fill_holes", f"SELECT * FROM {erode_sql('grown', disk_sql(2))}", f"{GRID_SQL}, grown AS (SELECT * FROM {spread_sql(m_sql('tubule'), disk_sql(3))})")
def _(px):
    return N.fill_holes(mask(px, "tubule"), 3, 2, S, S)


_opened, _last_open = steps("blocky", "ed", "el")
_closed, _last_closed = steps("sparse", "de", "sq")
_closed = _closed.replace("s0", "c0").replace("s1", "c1")


@on_pix(
    "f4_open_close",
    "SELECT 'open' AS kind, * FROM s1 UNION ALL SELECT 'close', * FROM c1",
    f"{GRID_SQL}, {offsets_table(N.ELLIPSE_5, 'el')}, {offsets_table(N.SQUARE_4, 'sq')}, blocky AS (SELECT * FROM {m_sql('tubule')} UNION SELECT slide, y, x FROM pix WHERE y % 20 < 9 AND x % 20 < 9), sparse AS (SELECT * FROM {m_sql('cap')}), {_opened}, {_closed}",
)
def _(px):
    blocky = C.or_(mask(px, "tubule"), px.where("y % 20 < 9 and x % 20 < 9"))
    named = lambda df, k: df.select(F.lit(k).alias("kind"), *KEY)
    return named(N.open_(blocky, N.ELLIPSE_5, 1, S, S), "open").union(named(N.close_(mask(px, "cap"), N.SQUARE_4, 1, S, S), "close"))


def gauss_sql(name: str, source: str, sigma: float, n: int = S) -> str:
    """Tables that end in ``name`` (slide, y, x, v): (slide, y, x, v) of ``source`` blurred, edges mirrored as often as need be."""
    values = ", ".join(f"({o}, {w!r})" for o, w in N.kernel(sigma))
    return (
        f"{name}_a AS (SELECT c, CASE WHEN q < {n} THEN q ELSE {2 * n - 1} - q END AS m, sum(w) AS w FROM (SELECT c.i AS c, ((c.i + k.o) % {2 * n} + {2 * n}) % {2 * n} AS q, CAST(k.w AS DOUBLE) AS w FROM range({n}) c(i), (VALUES {values}) k(o, w)) GROUP BY ALL), "
        f"{name}_r AS (SELECT s.slide, CAST(a.c AS INT) AS y, s.x, sum(s.v * a.w) AS v FROM {source} s JOIN {name}_a a ON s.y = a.m GROUP BY s.slide, a.c, s.x), "
        f"{name} AS (SELECT r.slide, r.y, CAST(a.c AS INT) AS x, sum(r.v * a.w) AS v FROM {name}_r r JOIN {name}_a a ON r.x = a.m GROUP BY r.slide, r.y, a.c)"
    )


def ones(source: str) -> str:
    return f"(SELECT slide, y, x, 1e0 AS v FROM {source})"


@on_pix(
    "f5_gauss_threshold", "SELECT slide, y, x, 2 AS sigma FROM near WHERE round(v, 9) > 0.5e0 UNION ALL SELECT slide, y, x, 41 FROM far WHERE round(v, 9) > 0.01e0",
    f"{gauss_sql('near', ones(m_sql('tubule')), 2)}, {gauss_sql('far', ones(m_sql('tubule')), 41)}",
)
def _(px):
    m = mask(px, "tubule")
    return N.gauss_threshold(m, 2, 0.5, S, S).withColumn("sigma", F.lit(2)).union(N.gauss_threshold_runs(m, 41, 0.01, S, S).withColumn("sigma", F.lit(41)))


@on_pix("f6_median_mask", f"SELECT p.slide, p.y, p.x FROM grid p JOIN {m_sql('tubule')} m ON p.slide = m.slide AND abs(p.y - m.y) <= 2 AND abs(p.x - m.x) <= 2 GROUP BY ALL HAVING count(*) * 2 > 25", GRID_SQL)
def _(px):
    return N.median_mask(mask(px, "tubule"), 5, S, S)


@on_pix("f6_median_blur", f"SELECT slide, y, x, min(v) AS v FROM (SELECT slide, y, x, v, sum(n) OVER (PARTITION BY slide, y, x ORDER BY v) AS u, sum(n) OVER (PARTITION BY slide, y, x) AS a FROM (SELECT p.slide, p.y, p.x, m.r AS v, count(*) AS n FROM grid p JOIN pix m ON p.slide = m.slide AND abs(p.y - m.y) <= 1 AND abs(p.x - m.x) <= 1 GROUP BY ALL)) WHERE u * 2 >= a GROUP BY ALL", GRID_SQL)
def _(px):
    return N.median_blur(px.select(*KEY, F.col("r").alias("v")), 3, S, S)


_SMOOTH = "SELECT slide, y, x FROM soft WHERE round(v, 9) > 0.5e0"
_WITHIN = {"cluster": f"({LAYERS['fib1']} OR {LAYERS['fib2']} OR {LAYERS['structural']})", "region": f"({LAYERS['cortex']} AND {LAYERS['eroded_cortex']})"}


def shell_query(name: str, layer: str, make, outer: int, nested: bool, form: str | None = None) -> None:
    """A shell of inner radius 1: without nuclei, or (cluster form) within the clusters, or both without nuclei and within the region."""
    grown = spread_sql("core" if nested else "m", disk_sql(outer))
    ring = f"SELECT * FROM {grown} EXCEPT SELECT * FROM core" + ("" if form == "cluster" else f" EXCEPT SELECT * FROM {m_sql('nuclei')}")
    ring = f"({ring})" + (f" INTERSECT SELECT slide, y, x FROM pix WHERE {_WITHIN[form]}" if form else "")
    more = f"{GRID_SQL}, m AS (SELECT * FROM {m_sql(layer)} UNION SELECT slide, y, x FROM pix WHERE y % 30 < 15 AND x % 30 < 15), core AS (SELECT * FROM {erode_sql('m', disk_sql(1))}), ring AS ({ring}), {gauss_sql('soft', ones('ring'), 2.0)}"

    def run(px: DataFrame) -> DataFrame:
        within = px.where(_WITHIN[form]).select(*KEY) if form else None
        return make(C.or_(mask(px, layer), px.where("y % 30 < 15 and x % 30 < 15")), None if form == "cluster" else mask(px, "nuclei"), S, S, 1, outer, within)

    on_pix(name, _SMOOTH, more)(run)


shell_query("f7_tubule_shell", "tubule", N.tubule_shell, 5, True)
shell_query("f7_tubule_shell_cluster", "tubule", N.tubule_shell, 7, True, "cluster")
shell_query("f8_capsule_shell", "cap", N.capsule_shell, 4, False)
shell_query("f8_capsule_shell_region", "cap", N.capsule_shell, 5, False, "region")


@on_pix(
    "f9_unsharp_smooth",
    "SELECT g.slide, g.y, g.x, round(least(255e0, greatest(0e0, g.v + 5 * (g.v - s.v))), 6) AS v, 'sharp' AS kind FROM gr g JOIN two s ON g.slide = s.slide AND g.y = s.y AND g.x = s.x UNION ALL SELECT slide, y, x, round(v, 6), 'smooth' FROM one",
    f"gr AS (SELECT slide, y, x, CAST({GRAY} AS DOUBLE) AS v FROM pix), {gauss_sql('two', 'gr', 2)}, {gauss_sql('one', 'gr', 1)}",
)
def _(px):
    v = B.gray(px)
    both = N.unsharp(v, 2, 5, S, S).withColumn("kind", F.lit("sharp")).union(N.gauss(v.withColumn("v", F.col("v").cast("double")), 1, S, S).select(*KEY, "v").withColumn("kind", F.lit("smooth")))
    return both.withColumn("v", F.round("v", 6))


def _mirror(c: str, o: str) -> str:
    """Coordinate c + o mirrored at the edges."""
    return f"CASE WHEN {c} + {o} < 0 THEN -1 - ({c} + {o}) WHEN {c} + {o} >= {S} THEN {2 * S - 1} - ({c} + {o}) ELSE {c} + {o} END"


#: Offsets of a 3 x 3 neighbourhood with the weights of differences and of smoothing, edges mirrored.
SOBEL_SQL = f"o AS (SELECT CAST(c.i AS INT) AS c, {_mirror('c.i', '(k.i - 1)')} AS m, (k.i - 1) * 0.5e0 AS step, CASE WHEN k.i = 1 THEN 0.5e0 ELSE 0.25e0 END AS soft FROM range({S}) c(i), range(3) k(i))"


@on_pix(
    "f10_orientation",
    "SELECT yy.slide, yy.y, yy.x, round(0.5e0 * atan2(2 * xy.v, xx.v - yy.v), 6) AS theta FROM yy JOIN xx ON yy.slide = xx.slide AND yy.y = xx.y AND yy.x = xx.x JOIN xy ON yy.slide = xy.slide AND yy.y = xy.y AND yy.x = xy.x",
    f"gr AS (SELECT slide, y, x, CAST({GRAY} AS DOUBLE) AS v FROM pix), {SOBEL_SQL}, "
    "grad AS (SELECT t.slide, v.c AS y, h.c AS x, sum(t.v * v.step * h.soft) AS gy, sum(t.v * v.soft * h.step) AS gx FROM gr t JOIN o v ON t.y = v.m JOIN o h ON t.x = h.m GROUP BY ALL HAVING count(*) FILTER (v.step <> 0) > 0 AND count(*) FILTER (h.step <> 0) > 0), "
    + ", ".join(gauss_sql(n, f"(SELECT slide, y, x, {p} AS v FROM grad)", 2) for n, p in (("yy", "gy * gy"), ("xx", "gx * gx"), ("xy", "gx * gy"))),
)
def _(px):
    return N.orientation(B.gray(px), 2, S, S).withColumn("theta", F.round("theta", 6))


THETA = "(SELECT slide, y, x, CAST(r % 60 AS DOUBLE) / 8 AS theta FROM pix)"


@on_pix(
    "f11_orientation_gradient",
    "SELECT slide, y, x, round(sqrt(gy * gy + gx * gx), 6) AS change FROM (SELECT t.slide, v.c AS y, h.c AS x, sum(t.theta * v.step * h.soft) AS gy, sum(t.theta * v.soft * h.step) AS gx FROM t JOIN o v ON t.y = v.m JOIN o h ON t.x = h.m GROUP BY ALL)",
    f"t AS (SELECT * FROM {THETA}), o AS (SELECT CAST(c.i AS INT) AS c, {_mirror('c.i', '(k.i - 1)')} AS m, (k.i - 1) * 0.5 AS step, CASE WHEN k.i = 1 THEN 0.5 ELSE 0.25 END AS soft FROM range({S}) c(i), range(3) k(i))",
)
def _(px):
    theta = px.select(*KEY, ((F.col("r") % 60).cast("double") / 8).alias("theta"))
    every = N.orientation_gradient(A.grid(px, S, S).join(theta, KEY, "left").fillna(0.0, ["theta"]), S, S)
    # A cell with no pixel in its 3 x 3 neighbourhood has no row.
    near = N.window_pixels(theta.select(*KEY, F.lit(1).alias("v")), 3, S, S).select(*KEY).distinct()
    return every.join(near, KEY, "left_semi").select(*KEY, F.round("change", 6).alias("change"))


@on_pix("f12_sample_field", f"SELECT slide, y, x, round(cos(theta), 6) AS u, round(sin(theta), 6) AS w FROM {THETA} WHERE y % 20 = 0 AND x % 20 = 0")
def _(px):
    theta = px.select(*KEY, ((F.col("r") % 60).cast("double") / 8).alias("theta"))
    return E.grid_points(N.sample_field(theta).select(*KEY, F.round("u", 6).alias("u"), F.round("w", 6).alias("w")), 20, 20)


@on_pix("f13_edge_band", f"SELECT * FROM {spread_sql('once', 'pl')} EXCEPT SELECT * FROM {m_sql('cap')}", f"{offsets_table(N.PLUS, 'pl')}, once AS (SELECT * FROM {spread_sql(m_sql('cap'), 'pl')})")
def _(px):
    return N.edge_band(mask(px, "cap"), S, S)


# --- objects -----------------------------------------------------------------


def comp_sql(source: str, name: str = "lab", conn: int = 8, block: int | None = None) -> str:
    """CTEs that end in ``name`` (slide, y, x, label)."""
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" + ("" if conn == 8 else " AND abs(a.y - b.y) + abs(a.x - b.x) = 1")
    if block:
        near += f" AND a.y // {block} = b.y // {block} AND a.x // {block} = b.x // {block}"
    return (
        f"{name}_m AS (SELECT slide, y, x, CAST(y AS BIGINT) * {S} + x AS id FROM {source}), "
        f"{name}_o AS (SELECT a.i - 1 AS dy, b.i - 1 AS dx FROM range(3) a(i), range(3) b(i)), "
        f"{name}_e AS (SELECT a.slide, a.id AS f, b.id AS t FROM (SELECT *, y + dy AS ny, x + dx AS nx FROM {name}_m, {name}_o) a JOIN {name}_m b ON a.slide = b.slide AND a.ny = b.y AND a.nx = b.x AND {near}), "
        f"{name}_r AS (SELECT slide, id, id AS l FROM {name}_m UNION SELECT e.slide, e.t, r.l FROM {name}_r r JOIN {name}_e e ON e.slide = r.slide AND e.f = r.id WHERE r.l < e.t), "
        f"{name} AS (SELECT m.slide, m.y, m.x, r.label FROM {name}_m m JOIN (SELECT slide, id, min(l) AS label FROM {name}_r GROUP BY ALL) r ON m.slide = r.slide AND m.id = r.id)"
    )


@on_pix("g1_label", "SELECT 8 AS conn, * FROM lab UNION ALL SELECT 4, * FROM four", comp_sql(m_sql("tubule")) + ", " + comp_sql(m_sql("tubule"), "four", 4))
def _(px):
    m = mask(px, "tubule")
    return G.label(m, S, 8).select(F.lit(8).alias("conn"), *KEY, "label").union(G.label(m, S, 4).select(F.lit(4).alias("conn"), *KEY, "label"))


def sized(cond: str, name: str = "lab") -> str:
    return f"(SELECT slide, y, x FROM (SELECT *, count(*) OVER (PARTITION BY slide, label) AS n FROM {name}) WHERE {cond})"


@on_pix("g2_remove_small", f"SELECT * FROM {sized('n >= 12')}", comp_sql(m_sql("tubule")))
def _(px):
    return G.remove_small(mask(px, "tubule"), 12, S)


NOT_LOW = "(SELECT slide, y, x FROM grid EXCEPT SELECT slide, y, x FROM pix WHERE r > 120)"


@on_pix("g3_fill_small_holes", f"SELECT slide, y, x FROM pix WHERE r > 120 UNION ALL SELECT * FROM {sized('n < 9')}", f"{GRID_SQL}, " + comp_sql(NOT_LOW, conn=4))
def _(px):
    return G.fill_small_holes(px.where("r > 120").select(*KEY), 9, S, S)


@on_pix(
    "g4_scaled_dilation",
    f"SELECT DISTINCT slide, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM z, o WHERE dy * dy + dx * dx <= rad * rad AND y + dy BETWEEN 0 AND {S - 1} AND x + dx BETWEEN 0 AND {S - 1} EXCEPT SELECT slide, y, x FROM lab",
    comp_sql("(SELECT slide, y, x FROM pix WHERE g < 15)", conn=4) + ", z AS (SELECT slide, y, x, 1 + CAST(floor(ln(1 + 2500.0 * count(*) OVER (PARTITION BY slide, label))) AS INT) AS rad FROM lab), o AS (SELECT a.i - 20 AS dy, b.i - 20 AS dx FROM range(41) a(i), range(41) b(i))",
)
def _(px):
    return G.scaled_dilation(px.where("g < 15").select(*KEY), S, S, base=1)


@on_pix("g5_filter_fibrosis", "SELECT slide, y, x, count(*) OVER (PARTITION BY slide, label, y // 20, x // 20) > 6 AS kept FROM lab", comp_sql(m_sql("tubule"), block=20))
def _(px):
    return G.filter_fibrosis(mask(px, "tubule"), 6, S, block=20)


@on_pix(
    "g6_abnormal_tissue",
    f"SELECT slide, y, x FROM soft WHERE round(v, 9) > 0.01e0 INTERSECT SELECT slide, CAST(y // 2 AS INT), CAST(x // 2 AS INT) FROM {m_sql('eroded_cortex')}",
    f"{GRID_SQL}, fib AS (SELECT * FROM {m_sql('tissue')} UNION SELECT slide, y, x FROM grid WHERE y BETWEEN 30 AND 60 AND x BETWEEN 30 AND 60), low AS (SELECT slide, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x FROM fib GROUP BY slide, y // 2, x // 2 HAVING count(*) = 4), "
    + comp_sql("low") + f", {gauss_sql('soft', ones(sized('n >= 6')), 3.0, S // 2)}",
)
def abnormal(px):
    fib = C.or_(mask(px, "tissue"), A.grid(px, S, S).where("y between 30 and 60 and x between 30 and 60"))
    return G.abnormal_tissue(fib, mask(px, "eroded_cortex"), S, S, 2, 6, 3.0)


ABNORMAL_SQL = ORACLE_SQL["g6_abnormal_tissue"]


def g7(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    return G.tissue_objects(px.where("r + g > 380").select(*KEY), S, S, 20, 2, 8)


_closed7, _last7 = steps("first", "de", "sq")
OBJECTS = (
    f"{GRID_SQL}, {offsets_table(N.SQUARE_4, 'sq')}, first AS (SELECT slide, y, x FROM pix WHERE r + g > 380), {_closed7}, "
    + comp_sql(_last7, "obj")
    + f", big AS (SELECT slide, y, x, label FROM (SELECT *, count(*) OVER (PARTITION BY slide, label) AS n FROM obj) WHERE n > 20), "
    + comp_sql(f"(SELECT slide, y, x FROM grid EXCEPT SELECT slide, y, x FROM {_last7})", "gap", 4)
    + f", hole AS (SELECT slide, label, count(*) AS area, min(CAST(y AS BIGINT) * {S} + x) AS first FROM gap GROUP BY ALL HAVING min(y) > 0 AND max(y) < {S - 1} AND min(x) > 0 AND max(x) < {S - 1} AND count(*) > 2)"
    + f", own AS (SELECT h.slide, h.label, h.area, b.label AS parent FROM hole h JOIN big b ON h.slide = b.slide AND b.y = h.first // {S} AND b.x = h.first % {S} - 1)"
    + ", kept AS (SELECT slide, label, parent FROM (SELECT *, row_number() OVER (PARTITION BY slide, parent ORDER BY area DESC, label) AS k FROM own) WHERE k <= 8)"
)


@on_pix("g7_tissue_objects", "SELECT 'object' AS kind, slide, y, x, label FROM big UNION ALL SELECT 'hole', g.slide, g.y, g.x, g.label FROM gap g JOIN kept k ON g.slide = k.slide AND g.label = k.label", OBJECTS)
def _(px):
    objects, holes = g7(px)
    cells = lambda df, k: df.select(F.lit(k).alias("kind"), "slide", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")
    return cells(objects, "object").union(cells(holes, "hole"))


_OUT = f"out AS (SELECT slide, label FROM gap2 GROUP BY ALL HAVING min(y) > 0 AND max(y) < {S - 1} AND min(x) > 0 AND max(x) < {S - 1})"


@on_pix(
    "g8_fill_objects",
    "SELECT slide, y, x FROM big UNION SELECT g.slide, g.y, g.x FROM gap2 g JOIN out o ON g.slide = o.slide AND g.label = o.label EXCEPT SELECT g.slide, g.y, g.x FROM gap g JOIN kept k ON g.slide = k.slide AND g.label = k.label",
    OBJECTS + ", " + comp_sql("(SELECT slide, y, x FROM grid EXCEPT SELECT slide, y, x FROM big)", "gap2", 4) + ", " + _OUT,
)
def _(px):
    return G.fill_objects(*g7(px), S, S)


def box_sql(a: str) -> str:
    low, high = f"min({a})", f"(max({a}) + 1)"
    lack = f"greatest(0, 60 - ({high} - {low}))"
    return f"CAST(greatest({low} - floor({lack} / 2.0) - 8, 0) AS INT) AS {a}0, CAST(least({high} + ceil({lack} / 2.0) + 8, {S}) AS INT) AS {a}1"


BOXES = f"(SELECT slide, {box_sql('y')}, {box_sql('x')} FROM pix WHERE r + g > 440 GROUP BY slide)"


@on_pix("g9_bounding_boxes", f"SELECT * FROM {BOXES}")
def _(px):
    return G.bounding_boxes(px.where("r + g > 440"), S, S, 60, 8)


def start_sql(a: str, k: int) -> str:
    low = f"least(CASE WHEN inside THEN {a}0 ELSE 0 END, 60)"
    high = f"greatest(CASE WHEN inside THEN {a}0 ELSE 0 END, least(CASE WHEN inside THEN {a}1 - 40 ELSE 60 END, 60))"
    return f"CAST({low} + {hash_sql('slide', seed=k, below=1000003)} % ({high} - {low} + 1) AS INT) AS {a}"


@on_pix("g10_sample_crop", f"SELECT slide, {start_sql('y', 1)}, {start_sql('x', 2)}, inside FROM (SELECT *, {hash_sql('slide')} < 800 AS inside FROM {BOXES})")
def _(px):
    return G.sample_crop(G.bounding_boxes(px.where("r + g > 440"), S, S, 60, 8), 40, S, S)
