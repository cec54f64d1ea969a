"""Intensity clustering with given or fitted centres."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .objects import remove_small
from .pixels import KEY, clahe, gray

CLASSES = {1: "fib1", 2: "fib2", 3: "structural", 4: "dark"}


def load_centers(spark: SparkSession, path: str) -> DataFrame:
    """(k, c) from a text file with one intensity, or one triple, a line; in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("k", "line"))
    return lines.select("k", F.transform(F.regexp_extract_all("line", F.lit(r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"), F.lit(0)), lambda x: x.cast("double")).alias("c"))


def ranked_centers(centers: DataFrame) -> DataFrame:
    """Centres with rank 0 for the brightest."""
    return centers.select("k", "c", (F.row_number().over(Window.orderBy(F.desc(F.get("c", F.lit(0))), "k")) - 1).alias("rank"))


def assign(values: DataFrame, centers: DataFrame, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """``values`` with ``class``: rank of the nearest centre, ties to the brighter.

    The centres, a handful by definition, are gathered into one row and meet
    each value as an array; nothing is shuffled.
    """
    table = ranked_centers(centers).agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("centers"))
    point = F.array(*[F.col(c).cast("double") for c in columns])
    far = lambda c: F.aggregate(F.zip_with(c["c"], point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("centers", lambda c: F.struct(far(c).alias("d"), c["rank"].alias("rank"))))["rank"]
    return values.crossJoin(F.broadcast(table)).withColumn("class", best).drop("centers")


def split_classes(assigned: DataFrame, width: int, min_size: int = 50) -> DataFrame:
    """(slide, layer, y, x): classes by name; the two fibrosis classes without objects under ``min_size``."""
    out = None
    for k, name in CLASSES.items():
        m = assigned.where(F.col("class") == k).select(*KEY)
        m = remove_small(m, min_size, width) if k in (1, 2) else m
        part = m.select("slide", F.lit(name).alias("layer"), "y", "x")
        out = part if out is None else out.unionByName(part)
    return out


def background_cluster(px: DataFrame, centers: DataFrame, height: int, width: int, equalise: bool = True, max_size: int = 100, grid: int = 256) -> DataFrame:
    """The brightest class of the (equalised) gray image, without objects of ``max_size`` pixels or fewer."""
    v = gray(px)
    v = clahe(v, height, width, grid=grid) if equalise else v
    return remove_small(assign(v, centers).where(F.col("class") == 0).select(*KEY), max_size + 1, width)


def fit_centers(values: DataFrame, k: int, columns: tuple[str, ...] = ("v",), seed: int = 0) -> DataFrame:
    """(k, c) by k-means over all rows."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="features").transform(values)
    model = KMeans(k=k, seed=seed, initMode="k-means||").fit(rows)
    return values.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "k int, c array<double>")


def fit_intensities(values: DataFrame, k: int, column: str = "v", levels: int = 256) -> DataFrame:
    """(k, c): the k centres of least total squared distance to whole intensities 0 .. ``levels`` - 1, in rising order; fewer if there are fewer intensities.

    Exact and the same at every run: one aggregation gives the histogram, and the best
    split of its levels into k stretches follows by dynamic programming. Values
    outside the levels count as the nearest one; nulls don't count.
    """
    level = F.least(F.greatest(F.col(column), F.lit(0)), F.lit(levels - 1)).cast("int")
    counts = {r.level: r.n for r in values.where(F.col(column).isNotNull()).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``levels`` rows
    v = sorted(counts)
    n = np.array([counts[x] for x in v], np.float64)
    x = np.array(v, np.float64)
    total, first, second = (np.concatenate([[0.0], np.cumsum(n * x**p)]) for p in (0, 1, 2))

    def cost(end: int) -> np.ndarray:
        """Of the stretches from each level i <= end to ``end``."""
        i = np.arange(end + 1)
        return second[end + 1] - second[i] - (first[end + 1] - first[i]) ** 2 / (total[end + 1] - total[i])

    k = min(k, len(v))
    best, starts = np.array([cost(e)[0] for e in range(len(v))]), []
    for _ in range(1, k):
        tried = [np.concatenate([[np.inf], best[:e]]) + cost(e) for e in range(len(v))]
        starts.append(np.array([int(t.argmin()) for t in tried]))
        best = np.array([t.min() for t in tried])
    edges, end = [], len(v) - 1
    for s in reversed(starts):
        edges.append((s[end], end))
        end = s[end] - 1
    edges = [(0, end), *reversed(edges)] if v else []
    centers = [float((first[b + 1] - first[a]) / (total[b + 1] - total[a])) for a, b in edges]
    return values.sparkSession.createDataFrame([(i, [c]) for i, c in enumerate(centers)], "k int, c array<double>")
