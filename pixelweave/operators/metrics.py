"""Block counts, slide scores, and evaluation against labels or expert grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from . import words
from .algebra import LAYERS, _any, collagen_exclusion, fibrosis, has, inflammation
from .distance import squared_distances
from .pixels import KEY
from .quantiles import grouped_quantiles
from .words import Bits


def blocks(block: int) -> list[Column]:
    return ["slide", F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx")]


def fib_sums(tissue: Bits, fib: Bits) -> list[Column]:
    return [fib.count().alias("fib"), tissue.count().alias("tissue"), (tissue & ~has("vessel") & ~has("cap")).count().alias("tissue_noglomvessel")]


def inflamm_sums(inflamm: Bits, exclusion: Bits, fib: Bits) -> list[Column]:
    return [inflamm.count().alias("inflamm"), (inflamm | exclusion | fib).count().alias("interstitium")]


def in_blocks(stacked: DataFrame, block: int) -> GroupedData:
    """The stack's words cut at block edges, grouped by blocks that hold a cell of any layer."""
    return words.cut(stacked, block, list(LAYERS)).where(_any(" ".join(LAYERS)).column != 0).groupBy("slide", "by", "bx")


def block_fib_counts(stacked: DataFrame, block: int, tissue: Bits | None = None, **options) -> DataFrame:
    """Per block: fibrosis, tissue, and tissue outside vessel and cap. ``tissue`` defaults to the cortex."""
    return in_blocks(stacked, block).agg(*fib_sums(has("cortex") if tissue is None else tissue, fibrosis(**options)))


def block_inflamm_counts(stacked: DataFrame, block: int, inflamm: Bits | None = None, exclusion: Bits | None = None, **options) -> DataFrame:
    """Per block: inflammation, and the union of inflammation, collagen with exclusion and fibrosis; the final form by default."""
    return in_blocks(stacked, block).agg(*inflamm_sums(inflammation() if inflamm is None else inflamm, collagen_exclusion() if exclusion is None else exclusion, fibrosis(**options)))


def slide_scores(fib: DataFrame, inflamm: DataFrame) -> DataFrame:
    """Five ratios in percent from block counts; a zero denominator gives null."""
    a = fib.groupBy("slide").agg(*[F.sum(c).alias(c) for c in ("fib", "tissue", "tissue_noglomvessel")])
    b = inflamm.groupBy("slide").agg(*[F.sum(c).alias(c) for c in ("inflamm", "interstitium")])
    return ratios(a.join(b, "slide"))


def ratios(sums: DataFrame) -> DataFrame:
    """Five ratios in percent from the five sums of each slide."""
    pct = lambda n, d: F.try_divide(F.lit(100.0) * n, F.col(d))
    both = F.col("fib") + F.col("inflamm")
    return sums.select(
        "slide", pct(F.col("fib"), "tissue_noglomvessel").alias("fib_noglomvessel"), pct(both, "tissue_noglomvessel").alias("fib_inflamm_noglomvessel"),
        pct(F.col("fib"), "tissue").alias("fib_tissue"), pct(both, "tissue").alias("fib_inflamm_tissue"), pct(F.col("inflamm"), "interstitium").alias("inflamm_interstitium"),
    )


def ratio_score(part: DataFrame, whole: DataFrame, name: str) -> DataFrame:
    """Pixels of one mask in percent of another, per slide."""
    a, b = part.groupBy("slide").agg(F.count(F.lit(1)).alias("a")), whole.groupBy("slide").agg(F.count(F.lit(1)).alias("b"))
    return b.join(a, "slide", "left").select("slide", F.try_divide(F.lit(100.0) * F.coalesce("a", F.lit(0)), F.col("b")).alias(name))


def simple_score(fib: DataFrame) -> DataFrame:
    return fib.groupBy("slide").agg(F.sum("fib").alias("f"), F.sum("tissue").alias("t")).select("slide", F.try_divide(F.lit(100.0) * F.col("f"), F.col("t")).alias("fib_tissue"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both counts per block and their difference; a block missing on one side counts 0."""
    x, y = a.select(*keys, F.col(value).alias("x")), b.select(*keys, F.col(value).alias("y"))
    both = x.join(y, keys, "full_outer").select(*keys, F.coalesce("x", F.lit(0)).alias("a"), F.coalesce("y", F.lit(0)).alias("b"))
    return both.withColumn("delta", F.col("b") - F.col("a"))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def validate_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def grade(c: Column) -> Column:
    """Expert grade as a whole number 0..3 after rounding, else null."""
    g = F.floor(c.try_cast("double") + 0.5).cast("int")
    return F.when(g.between(0, 3), g)


def score_by_grade(scores: DataFrame) -> DataFrame:
    """Box statistics of the score per grade, in grade order with null last: quartiles, whiskers at 1.5 IQR, outliers. What is no finite number is left out."""
    from ..sources.tables import stored

    rows = stored(scores.select(grade(F.col("pathologist_score")).alias("grp"), F.col("fib_score").try_cast("double").alias("v")).where("abs(v) < double('infinity')"), "scores")
    told = [(g, n, *map(float, q)) for g, (n, q) in grouped_quantiles(rows, (0.25, 0.5, 0.75)).items()]
    # Four grades and null: a broadcast of five rows.
    q = rows.sparkSession.createDataFrame(told, "of int, n long, q1 double, median double, q3 double")
    each = rows.join(F.broadcast(q), F.col("grp").eqNullSafe(F.col("of"))).select(F.col("of").alias("grade"), "n", "q1", "median", "q3", F.col("v").alias("score"))
    inside = F.col("score").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return each.groupBy("grade", "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("score"))).alias("low"), F.max(F.when(inside, F.col("score"))).alias("high"), F.count_if(~inside).alias("outliers"))


def dice(pixels: DataFrame, smooth: float = 1.0) -> DataFrame:
    """Mean over images of 2 * sum(p l) / (sum p + sum l + smooth), from (image, p, l)."""
    per = pixels.groupBy("image").agg((2.0 * F.sum(F.col("p") * F.col("l")) / (F.sum("p") + F.sum("l") + smooth)).alias("dice"))
    return per.agg(F.avg("dice").alias("dice"), F.count(F.lit(1)).alias("images"))


def _known(pixels: DataFrame) -> DataFrame:
    """Without the images (per class) whose first target is -1."""
    first = pixels.groupBy("class", "image").agg(F.min_by("l", "i").alias("first")).where("first != -1").select("class", "image")
    return pixels.join(first, ["class", "image"], "left_semi")


def weighted_dice(pixels: DataFrame, smooth: float = 1.0) -> DataFrame:
    """Per class the mean over its images of (2 sum(p l w) + smooth) / (sum p + sum l + smooth), then the mean over classes; classes without images drop out."""
    per = _known(pixels).groupBy("class", "image").agg(((2.0 * F.sum(F.col("p") * F.col("l") * F.col("w")) + smooth) / (F.sum("p") + F.sum("l") + smooth)).alias("d"))
    return per.where(~F.isnan("d")).groupBy("class").agg(F.avg("d").alias("d")).agg(F.avg("d").alias("dice"))


def precision_smooth(pixels: DataFrame, smooth: float = 1.0) -> DataFrame:
    """1 - mean over classes of the mean of tp / (tp + fp + smooth)."""
    tp, fp = F.sum(F.col("p") * F.col("l")), F.sum(F.col("p") * (1 - F.col("l")))
    per = _known(pixels).groupBy("class", "image").agg((tp / (tp + fp + smooth)).alias("d"))
    return per.groupBy("class").agg(F.avg("d").alias("d")).agg((1 - F.avg("d")).alias("loss"))


def class_weight(labels: DataFrame) -> DataFrame:
    """(class, weight) with weight ln(N / n)."""
    n = labels.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("class", F.log(F.col("total") / F.col("n")).alias("weight"))


def weighted_bce(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean binary cross-entropy with logits of (class, z, l), times the class's weight."""
    loss = F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("l") + F.log1p(F.exp(-F.abs("z")))
    return rows.groupBy("class").agg(F.avg(loss).alias("bce")).join(weights, "class").select("class", (F.col("bce") * F.col("weight")).alias("loss"))


def f1_macro(pixels: DataFrame) -> DataFrame:
    """Mean of the F1 of classes 0 and 1, per image; a class in neither has F1 0."""
    p, label = F.col("p") == 1, F.col("l") == 1
    n = pixels.groupBy("image").agg(F.count_if(p & label).alias("tp"), F.count_if(p & ~label).alias("fp"), F.count_if(~p & label).alias("fn"), F.count_if(~p & ~label).alias("tn"))
    f = lambda t: F.coalesce(F.try_divide(2.0 * F.col(t), 2 * F.col(t) + F.col("fp") + F.col("fn")), F.lit(0.0))
    return n.select("image", ((f("tp") + f("tn")) / 2).alias("f1"))


def surface(m: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of the mask that its 4-connected erosion takes away; the border counts as outside."""
    return words.to_pixels(words.surface(words.from_pixels(m), height, width))


def directed_distance(a: DataFrame, b: DataFrame, height: int, width: int) -> DataFrame:
    """(slide, y, x, d): distance from each pixel of ``a`` to the nearest of ``b`` on its slide; slides without ``b`` are left out."""
    return squared_distances(words.from_pixels(a), words.from_pixels(b), height).select(*KEY, F.sqrt("d2").alias("d"))


def surface_distance(pred: DataFrame, label: DataFrame, height: int, width: int) -> DataFrame:
    """Per slide the Hausdorff and mean distance of both surfaces; 0 where one is missing."""
    from ..sources.tables import stored

    a, b = (stored(words.surface(words.from_pixels(m), height, width), "surface") for m in (pred, label))
    both = squared_distances(a, b, height).unionByName(squared_distances(b, a, height)).select("slide", F.sqrt("d2").alias("d"))
    per = both.groupBy("slide").agg(F.max("d").alias("hausdorff"), F.avg("d").alias("mean"))
    every = pred.select("slide").union(label.select("slide")).distinct()
    return every.join(per, "slide", "left").select("slide", F.coalesce("hausdorff", F.lit(0.0)).alias("hausdorff"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def crop_eval(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside their image's valid box [rmin, rmax) x [cmin, cmax)."""
    return pixels.join(boxes, "image").where((F.col("y") >= F.col("rmin")) & (F.col("y") < F.col("rmax")) & (F.col("x") >= F.col("cmin")) & (F.col("x") < F.col("cmax"))).drop("rmin", "rmax", "cmin", "cmax")


def rollup_counts(counts: DataFrame, values: list[str]) -> DataFrame:
    """Block, slide and total sums in one pass."""
    return counts.rollup("slide", "by", "bx").agg(*[F.sum(v).alias(v) for v in values])


