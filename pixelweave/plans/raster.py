"""Rasters derived from the business tables, for queries and checks.

Slides of 100 x 100 cells, one for every ``SUPPLIERS`` suppliers, so the raster
grows with the tables: part and order keys give the place, quantities and
discounts the colour. A cell without a line item is white and has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pixels import KEY

SIDE, SUPPLIERS = 100, 25

#: Layer name and predicate over r, g, b, y, x, valid in Spark and in other SQL.
LAYERS = {
    "tissue": "NOT (r > 205 AND g > 205 AND b > 205)",
    "background": "r > 230 AND g > 200",
    "cortex": "y BETWEEN 10 AND 89 AND x BETWEEN 10 AND 89",
    "eroded_cortex": "y BETWEEN 14 AND 85 AND x BETWEEN 14 AND 85",
    "tubule": "r + g > 330",
    "cap": "g < 40 AND b < 100",
    "vessel": "r - g > 150 AND b > 100",
    "vessel_dilated": "r - g > 120 AND b > 90",
    "nuclei": "b < 40",
    "tbm": "r + g BETWEEN 300 AND 330",
    "bc": "g BETWEEN 40 AND 55",
    "fib1": "g BETWEEN 60 AND 90",
    "fib2": "g > 90 AND g <= 120",
    "structural": "g > 120 AND g <= 150",
    "dark": "r < 60",
}

PIX_SQL = f"""pix AS (
  SELECT CAST(l_suppkey // {SUPPLIERS} AS INT) AS slide, CAST(l_orderkey % 100 AS INT) AS y, CAST(l_partkey % 100 AS INT) AS x,
         CAST(round(max(l_quantity * 5)) AS INT) AS r, CAST(round(min(l_quantity * 5)) AS INT) AS g, CAST(round(max(l_discount * 2000)) AS INT) AS b
  FROM lineitem GROUP BY 1, 2, 3)"""
GRID_SQL = f"grid AS (SELECT slide, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x FROM (SELECT DISTINCT slide FROM pix), range({SIDE}) a(i), range({SIDE}) b(i))"


def pix(spark: SparkSession, sf_dir: str, together: tuple[str, ...] = ("slide", "y")) -> DataFrame:
    """(slide, y, x, r, g, b). What has the same ``together``, an image row or a whole slide, lies in one partition, so what groups cells by it and more needs no further shuffle."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = [F.floor(F.col("l_suppkey") / SUPPLIERS).cast("int").alias("slide"), *[(F.col(c) % SIDE).cast("int").alias(a) for c, a in (("l_orderkey", "y"), ("l_partkey", "x"))]]
    value = lambda c: F.round(c).cast("int")
    rows = lines.select(*place, "l_quantity", "l_discount").repartition(*together)
    return rows.groupBy(*KEY).agg(value(F.max(F.col("l_quantity") * 5)).alias("r"), value(F.min(F.col("l_quantity") * 5)).alias("g"), value(F.max(F.col("l_discount") * 2000)).alias("b"))


def mask(px: DataFrame, layer: str) -> DataFrame:
    return px.where(F.expr(LAYERS[layer])).select(*KEY)


def layers(px: DataFrame) -> DataFrame:
    """(slide, y, x, layer): all layers in one pass over the pixels."""
    names = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in LAYERS.items()]))
    return px.select(*KEY, F.explode(names).alias("layer"))


def large_tiles(px: DataFrame, k: int = 10, side: int = 256) -> DataFrame:
    """(slide, ty, tx, h, w, data): each slide enlarged k times, every cell a k x k square, in tiles; 1,000 x 1,000 cells for k = 10."""

    def run(table: pa.Table) -> pa.Table:
        n = -(-SIDE * k // side)
        cells = np.full((SIDE, SIDE, 3), 255, np.uint8)
        cells[table.column("y").to_numpy(), table.column("x").to_numpy()] = np.stack([table.column(c).to_numpy() for c in "rgb"], 1)
        whole = np.full((n * side, n * side, 3), 255, np.uint8)
        whole[: SIDE * k, : SIDE * k] = cells.repeat(k, axis=0).repeat(k, axis=1)
        at = [(ty, tx) for ty in range(n) for tx in range(n)]
        slide = table.column("slide")
        data = [whole[ty * side : (ty + 1) * side, tx * side : (tx + 1) * side].tobytes() for ty, tx in at]
        ints = lambda x: pa.array(x, pa.int32())
        return pa.table({"slide": pa.array([slide[0].as_py()] * len(at), slide.type), "ty": ints([a for a, _ in at]), "tx": ints([b for _, b in at]), "h": ints([side] * len(at)), "w": ints([side] * len(at)), "data": pa.array(data, pa.binary())})

    return px.groupBy("slide").applyInArrow(run, "slide int, ty int, tx int, h int, w int, data binary")
