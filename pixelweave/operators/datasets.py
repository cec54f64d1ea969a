"""Assembly of training sets from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The five kinds of image and mask names, tried in order, and the base that both sides share.
EXTENSIONS = ("tif", "tiff")
IMAGE_KINDS = (
    ("omniseg", r"^(im_\d+)$", "1"),
    ("uuid_patch", r"^(im_.+_5x_patch\d+)$", "1"),
    ("uuid", r"^(im_.+)_5x$", "1"),
    ("region", r"^(?!.*_region_mask)(.*?)_region", "1"),
    ("rand_roi", r"^(?!.*_rand_roi_mask)(.*?)_rand_roi", "1"),
)
MASK_KINDS = (
    ("omniseg", r"^(im_\d+)_mask", "1"),
    ("uuid_patch", r"^(im_.+_5x)_mask(_patch\d+)", "12"),
    ("uuid", r"^(im_.+)_5x_mask", "1"),
    ("region", r"^(.*?)_region_mask", "1"),
    ("rand_roi", r"^(.*?)_rand_roi_mask", "1"),
)


def _classify(files: DataFrame, kinds: tuple, typed: tuple[str, ...] = ()) -> DataFrame:
    """``files`` with kind and base; kinds in ``typed`` need one of EXTENSIONS where ``files`` has a column ``ext``."""
    name, kind, base = F.col("stem"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern, groups in reversed(kinds):
        hit = name.rlike(pattern)
        if k in typed and "ext" in files.columns:
            hit = hit & F.col("ext").isin(*EXTENSIONS)
        kind = F.when(hit, k).otherwise(kind)
        base = F.when(hit, F.concat(*[F.regexp_extract(name, pattern, int(g)) for g in groups])).otherwise(base)
    return files.withColumns({"kind": kind, "base": base})


def classify_image(files: DataFrame) -> DataFrame:
    return _classify(files, IMAGE_KINDS, ("omniseg", "uuid_patch", "uuid"))


def classify_mask(files: DataFrame) -> DataFrame:
    return _classify(files, MASK_KINDS)


def pair(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(folder, kind, base, image, mask): each classified image with the first mask by name; the folder ``dataset`` is skipped."""
    first = masks.where("kind is not null").groupBy("folder", "kind", "base").agg(F.min("stem").alias("mask"))
    return images.where("kind is not null and folder != 'dataset'").select("folder", "kind", "base", F.col("stem").alias("image")).join(first, ["folder", "kind", "base"])


def uncategorised(images: DataFrame) -> DataFrame:
    return images.where("kind is null")


def missing_mask(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.where("kind is not null").join(masks.where("kind is not null"), ["folder", "kind", "base"], "left_anti")


def orphan_mask(images: DataFrame, masks: DataFrame) -> DataFrame:
    return masks.where("kind is not null").join(images.where("kind is not null"), ["folder", "kind", "base"], "left_anti")


def split(pairs: DataFrame, order: list[Column], ratio: float = 0.9, by: str = "folder") -> DataFrame:
    """``pairs`` with ``part``: the first int(n * ratio) of each folder, in the given order, train, the rest validates; exact."""
    folder = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(folder)
    at = F.row_number().over(folder.orderBy(*order))
    return pairs.withColumn("part", F.when(at <= F.floor(n * ratio), "train").otherwise("validation"))


def number_pairs(pairs: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """``pairs`` with consecutive numbers from 0 in each split."""
    return pairs.withColumn("number", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def patch_dataset(patches: DataFrame, pixels_per_patch: int, t: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Patches (folder, image, mask, y0, x0, n set pixels, equal extents) kept with new names, and per folder the kept and skipped."""
    told = patches.withColumn("keep", F.col("same_extent") & (F.col("n") >= t * pixels_per_patch))
    number = F.row_number().over(Window.partitionBy("folder", "image").orderBy("y0", "x0")) - 1
    kept = told.where("keep").withColumn("i", number).select("folder", "image", "y0", "x0", F.concat("image", F.lit("_patch"), "i").alias("name"), F.concat("image", F.lit("_mask_patch"), "i").alias("mask_name"))
    totals = told.groupBy("folder").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("skipped"))
    return kept, totals


def zip_manifests(a: DataFrame, b: DataFrame, by: str, order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """i-th row of ``a`` with i-th row of ``b`` in each group, as long as both last."""
    x = a.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(*order_a)) - 1)
    y = b.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(*order_b)) - 1)
    return x.join(y, [by, "i"])


def task_tree_manifest(files: DataFrame) -> DataFrame:
    """(path, mask, task_id, scale_id, name) of images in folders <task>_<scale>.../<stain>/ with their first mask by name."""
    parts = F.split("path", "/")
    tree = F.split(F.element_at(parts, 1), "_")
    rows = files.select("path", F.get(tree, F.lit(0)).try_cast("int").alias("task_id"), F.get(tree, F.lit(1)).try_cast("int").alias("scale_id"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))
    masks = rows.where(F.col("stem").contains("_mask")).select(F.regexp_replace("stem", "_mask.*$", "").alias("stem"), F.col("path").alias("mask")).groupBy("stem").agg(F.min("mask").alias("mask"))
    images = rows.where(~F.col("stem").contains("_mask"))
    return images.join(masks, "stem").select("path", "mask", "task_id", "scale_id", F.replace(F.col("path"), F.lit("/"), F.lit("-")).alias("name"))
