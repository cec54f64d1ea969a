"""Exact quantiles of groups by selection: value ranges that hold the wanted ranks are narrowed with counts, so no task gathers a group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def _buckets(rows: DataFrame, ranges: list[tuple]) -> dict[tuple, list[tuple[int, float, float]]]:
    """(count, least, largest) of the values in each of ``BUCKETS`` parts of each range (group, low, high), in order."""
    spark = rows.sparkSession
    kind = rows.schema["grp"].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(ranges, f"of {kind}, low double, high double"))  # at most a few for each wanted quantile
    met = rows.join(table, F.col("grp").eqNullSafe(F.col("of")) & F.col("v").between(F.col("low"), F.col("high")))
    # Halves, as the range itself may be above the largest double; where they are equal, the least value stands apart from the rest.
    share = F.coalesce(F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2), (F.col("v") > F.col("low")).cast("double"))
    part = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    found = met.groupBy("of", "low", "high", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
    out: dict[tuple, list] = {}
    for r in sorted(found, key=lambda r: r.part):
        out.setdefault((r.of, r.low, r.high), []).append((r.n, r.least, r.most))
    return out


def grouped_quantiles(rows: DataFrame, quantiles: tuple[float, ...]) -> dict:
    """{group: (n, [quantiles])} of a stored (grp, v), with linear interpolation between neighbours; few groups, null one of them.

    Each pass scans the rows once and counts ``BUCKETS`` parts of every range that is
    still open; the part that holds a rank becomes its range. Groups of no value are left out.
    """
    ends = rows.groupBy("grp").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0").collect()
    size = {r.grp: r.n for r in ends}
    # (group, rank) -> (low, high, how many values lie below low)
    open_ = {(r.grp, rank): (r.low, r.high, 0) for r in ends for q in quantiles for rank in (math.floor(q * (r.n - 1)), math.ceil(q * (r.n - 1)))}
    value = {}
    while True:
        value |= {k: low for k, (low, high, _) in open_.items() if low == high}
        open_ = {k: x for k, x in open_.items() if x[0] != x[1]}
        if not open_:
            break
        counted = _buckets(rows, sorted({(g, low, high) for (g, _), (low, high, _) in open_.items()}, key=repr))
        for (g, rank), (low, high, below) in open_.items():
            for n, least, most in counted[g, low, high]:
                if rank < below + n:
                    open_[g, rank] = (least, most, below)
                    break
                below += n
    at = lambda g, p: value[g, math.floor(p)] + (p - math.floor(p)) * (value[g, math.ceil(p)] - value[g, math.floor(p)])
    return {g: (n, [at(g, q * (n - 1)) for q in quantiles]) for g, n in size.items()}
