"""Variants of the scoring formula as presets of one function."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import algebra, components, metrics, words
from ..operators.words import Bits


@dataclass(frozen=True)
class Preset:
    """Layers of the region (all of them), base of the residual formula, layer of inflammation, and the size from which fibrosis objects count (per block of 1 mm)."""

    region: str = "cortex"
    base: str = "tissue"
    clusters: bool = False
    no_background: bool = True
    subtract_bc: bool = True
    nuclei: str = "nuclei"
    plain_ring: bool = False  # the dilated vessel as it is
    drop_up_to: int = 100

    @property
    def formula(self) -> dict:
        return {"region": self.region, "base": self.base, "clusters": self.clusters, "no_background": self.no_background, "subtract_bc": self.subtract_bc, "nuclei": self.nuclei}

    def ring(self) -> Bits:
        return algebra.has("vessel_dilated") if self.plain_ring else algebra.vessel_ring(self.region, self.no_background, self.nuclei, self.clusters)

    def tissue(self) -> Bits:
        """The region alone is what fibrosis is set against."""
        return algebra._all(self.region)

    def inflammation(self) -> Bits:
        return algebra.inflammation(self.nuclei, self.region, self.no_background)

    def exclusion(self) -> Bits:
        return algebra.collagen_exclusion(self.region, self.no_background, None if self.clusters else self.nuclei)


PRESETS = {
    "final": Preset(),
    "newcortex": Preset(region="eroded_cortex cortex", base="cortex", no_background=False),
    "unet_20x": Preset(region="eroded_cortex", no_background=False),
    "unet_20x_cluster": Preset(region="eroded_cortex"),
    "unet": Preset(region="eroded_cortex", no_background=False),
    "cellpose": Preset(region="eroded_cortex", no_background=False),
    "main": Preset(region="eroded_cortex", clusters=True, no_background=False, nuclei="dark", drop_up_to=4999),
    "omniseg": Preset(region="tissue", clusters=True, no_background=False, subtract_bc=False, nuclei="dark", plain_ring=True, drop_up_to=0),
    "segfault": Preset(region="tissue", clusters=True, no_background=False, nuclei="dark", drop_up_to=4999),
}


def prepare(layers: DataFrame) -> DataFrame:
    """Stack of all layers with overlaps resolved and the vessel ring set: one shuffle."""
    stacked = algebra.resolve_overlaps(algebra.stack(layers))
    return algebra.with_layer(stacked, "vessel_ring", algebra.vessel_ring())


def slide_scores(layers: DataFrame, block: int, preset: str = "final", width: int | None = None, drop_up_to: int | None = None) -> DataFrame:
    """Scores of each slide from its mask layers: structures restricted to the region, overlaps resolved, the ring, fibrosis without small objects, five sums, five ratios.

    The masks that the five sums count follow from the stack, as words. One shuffle
    by tiles of whole blocks lets a task drop small objects from fibrosis there; the sums follow from what it gives.
    ``drop_up_to`` overrides the preset's size; ``width`` isn't needed any more.
    """
    p = PRESETS[preset]
    return scores_of_stack(algebra.stack(layers), block, preset, p.drop_up_to if drop_up_to is None else drop_up_to)


def scores_of_stack(stacked: DataFrame, block: int, preset: str, drop: int) -> DataFrame:
    """The same from a stack of layers."""
    p = PRESETS[preset]
    stacked = algebra.structures(stacked, p.region, p.no_background)
    stacked = algebra.with_layer(stacked, "vessel_ring", p.ring())
    outside = ~algebra._any("vessel cap")
    terms = {"finfib": algebra.fibrosis(**p.formula), "tissue": p.tissue(), "bare": p.tissue() & outside, "inflamm": p.inflammation(), "rest": p.inflammation() | p.exclusion()}
    rows = stacked.select(*words.PLACE, *[f.column.alias(n) for n, f in terms.items()])
    if drop:
        rows = components.drop_small(rows, "finfib", drop, block, list(terms))
    fib, tissue, bare, inflamm, rest = map(algebra.has, terms)
    sums = {"fib": fib, "tissue": tissue, "tissue_noglomvessel": bare, "inflamm": inflamm, "interstitium": rest | fib}
    return metrics.ratios(rows.groupBy("slide").agg(*[f.count().alias(n) for n, f in sums.items()]))
