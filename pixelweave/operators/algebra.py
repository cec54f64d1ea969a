"""Mask algebra: sets of pixels, and bitwise formulas over one stack of all layers.

A stack has a row for each 64 cells of an image row and a column of bits for each
layer (:mod:`.words`), so a formula is a bitwise expression on longs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .pixels import KEY
from .words import Bits

LAYERS = ("tissue", "background", "cortex", "eroded_cortex", "tubule", "cap", "vessel", "vessel_dilated", "nuclei", "tbm", "bc", "fib1", "fib2", "structural", "dark", "vessel_ring", "finfib")


def stack(layers: DataFrame, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """(slide, y, w, one column a layer) of a mask relation with a ``layer`` column: one shuffle of words aligns all layers, none if the rows of an image lie together."""
    rows = layers.select(*KEY, "layer").where(F.col("layer").isin(*LAYERS))
    for name, m in (more or {}).items():
        rows = rows.unionByName(m.select(*KEY, F.lit(name).alias("layer")))
    one = words.bit(F.col("x"))
    zero = F.lit(0).cast("long")
    return rows.groupBy("slide", "y", words.word(F.col("x")).alias("w")).agg(*[F.coalesce(F.bit_or(F.when(F.col("layer") == n, one)), zero).alias(n) for n in LAYERS])


def pixel_bits(stacked: DataFrame) -> DataFrame:
    """(slide, y, x, bits): for each cell of any layer, bit i says whether layer i has it."""
    each = stacked.select("*", F.explode(F.sequence(F.lit(0), F.lit(words.WORD - 1))).alias("i"))
    of = lambda n, k: words.down(F.col(n), F.col("i")).bitwiseAND(F.lit(1)).cast("int") * (1 << k)
    told = each.select("slide", "y", (F.col("w") * words.WORD + F.col("i")).alias("x"), sum((of(n, k) for k, n in enumerate(LAYERS)), F.lit(0)).alias("bits"))
    return told.where("bits != 0")


def has(name: str) -> Bits:
    return Bits(F.col(name))


def _any(names: str) -> Bits:
    return reduce(Bits.__or__, map(has, names.split()))


def _all(names: str) -> Bits:
    return reduce(Bits.__and__, map(has, names.split()))


def where(stacked: DataFrame, formula: Bits) -> DataFrame:
    """Pixels of a formula."""
    return words.to_pixels(stacked, formula.column)


def with_layer(stacked: DataFrame, name: str, formula: Bits) -> DataFrame:
    """The stack with one layer set from a formula on the others: no shuffle."""
    return stacked.withColumn(name, formula.column)


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def or_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).join(b.select(*KEY), KEY, "left_anti")


def restrict(name: str, region: str = "cortex", no_background: bool = True) -> Bits:
    keep = _all(f"{name} {region}")
    return keep & ~has("background") if no_background else keep


def resolve_overlaps(stacked: DataFrame) -> DataFrame:
    """Tubule wins over cap and vessel; cap as it was wins over vessel."""
    return stacked.withColumns({"cap": (has("cap") & ~has("tubule")).column, "vessel": (has("vessel") & ~_any("tubule cap")).column})


def structures(stacked: DataFrame, region: str = "cortex", no_background: bool = True) -> DataFrame:
    """The stack with tubule, cap and vessel restricted to the region (and to what is not background) and their overlaps resolved, in one expression."""
    keep = _all(region) & ~has("background") if no_background else _all(region)
    set_ = {"tubule": has("tubule") & keep, "cap": has("cap") & keep & ~has("tubule"), "vessel": has("vessel") & keep & ~_any("tubule cap")}
    return stacked.withColumns({n: f.column for n, f in set_.items()})


CLUSTERS = "fib1 fib2 structural"


def vessel_ring(region: str = "cortex", no_background: bool = True, nuclei: str = "nuclei", clusters: bool = False) -> Bits:
    """The dilated vessel without what stands beside it; in the cluster form within the clusters."""
    rest = f"{nuclei} tubule cap tbm bc" + (" background" if no_background else "")
    ring = _all(f"vessel_dilated {region}") & ~_any(rest)
    return ring & _any(CLUSTERS) if clusters else ring


def fibrosis(base: str = "tissue", region: str = "cortex", subtract_bc: bool = True, no_background: bool = True, clusters: bool = False, nuclei: str = "nuclei") -> Bits:
    """Residual form: the base without every structure. Cluster form: the clusters without them; the dark cluster needs no taking out."""
    out = "tubule cap vessel vessel_ring tbm" + ("" if clusters else f" {nuclei}") + (" bc" if subtract_bc else "") + (" background" if no_background else "")
    inside = _any(CLUSTERS) & _all(region) if clusters else _all(f"{base} {region}")
    return inside & ~_any(out)


def collagen(region: str | None = None) -> Bits:
    found = _any("structural vessel_ring tbm bc") & ~_any("tubule cap vessel")
    return found & _all(region) if region else found


def collagen_exclusion(region: str = "cortex", no_background: bool = True, nuclei: str | None = "nuclei") -> Bits:
    """Ring, membranes and capsules without structures; ``nuclei`` None leaves nuclei in."""
    out = "tubule cap vessel" + (f" {nuclei}" if nuclei else "") + (" background" if no_background else "")
    return _any("vessel_ring tbm bc") & ~_any(out) & _all(region)


def inflammation(source: str = "nuclei", region: str = "cortex", no_background: bool = True) -> Bits:
    return _all(f"{source} {region}") & ~_any("tubule cap vessel" + (" background" if no_background else ""))


def interstitium(**options) -> Bits:
    """The union of inflammation, collagen with exclusion, and fibrosis, of the final form."""
    return inflammation() | collagen_exclusion() | fibrosis(**options)


def cortical_tissue(cortex: DataFrame, tissue: DataFrame, extents: DataFrame) -> DataFrame:
    """Per base name the pixels of both masks; pairs of unequal extents or with one side missing are left out."""
    sizes = extents.groupBy("base").agg(F.count_distinct("kind").alias("kinds"), F.count_distinct("height", "width").alias("shapes")).where("kinds = 2 and shapes = 1").select("base")
    return cortex.join(sizes, "base", "left_semi").join(tissue, ["base", "y", "x"], "left_semi")


def inflamm_outside(clusters: DataFrame, structures: DataFrame, wanted: int = 4) -> DataFrame:
    """Pixels of the dark class outside all structures."""
    return minus(clusters.where(F.col("class") == wanted), structures)


def hist_mask(grid: DataFrame, *masks: DataFrame) -> DataFrame:
    """The grid without the union of the masks."""
    union = masks[0].select(*KEY)
    for m in masks[1:]:
        union = union.union(m.select(*KEY))
    return minus(grid, union)
