"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source size`` times. The whole
part is taken outright; the fractional part is rounded dependently: documents
of a source stand in order of size, the one still open and the next pass mass
between them at random until one of the two is integral, and the other stays
open. The sum of the copies never changes, each document keeps its expected
copies, and as neighbours have like sizes the words hardly move.

Sums are kept over data-defined leaves (source, size bin, hash block of about
``leaf_rows`` documents), so reruns agree whatever the partitioning, and a hot
source is split over many leaves. What stays open, one document a leaf, goes up
a tree of fan-in ``FAN`` until one is left for a source.

Null text has size 0. Null sources form one source, the last. Rows equal in
source, id and size are one unit, wanted as often as all of them together; its
copies are whole and handed out evenly, so its rows differ by one copy at most.
A source of no words has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_few, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
FAN = 64
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, size): the total shared by weight, none above ``most`` times its size.

    With sources in order of ``most * size / weight``, the capped ones are a
    prefix, so running sums give the level in one pass. One row per source goes
    through the ordered window, not the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(at) - 1, F.lit(len(weights))) + 1).cast("int"))
    up = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    left = ranked.withColumns({
        "place": F.row_number().over(up),
        "left_words": (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double"),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    capped = left.withColumn("full", F.col("ratio") * F.col("left_w") <= F.col("left_words"))
    level = F.min(F.when(~F.col("full"), F.struct("place", (F.col("left_words") / F.col("left_w")).alias("per_w")))).over(everything)["per_w"]
    return capped.withColumn("level", level).select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _draw(a: np.ndarray | int, b: int, seed: int) -> float:
    """A number in [0, 1) from two unit hashes: equal pairs, equal draws."""
    x = (int(a) * 0x9E3779B97F4A7C15 ^ int(b) * 0xC2B2AE3D27D4EB4F ^ seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / 2.0**53


def pivot(f1: float, f2: float, u: float) -> tuple[float, float]:
    """Move mass between two fractions until one is 0 or 1, keeping their sum and both expectations."""
    total = f1 + f2
    if total < 1.0:
        return (0.0, total) if u * total < f2 else (total, 0.0)
    return (1.0, total - 1.0) if u * (2.0 - total) < 1.0 - f2 else (total - 1.0, 1.0)


def _fold(seed: int):
    """Over rows sorted by group: settle all but one of each group. Keeps one open unit, whatever the length of a group."""
    eps = 1e-12

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, None  # held: [unit, hash, size, bin, block, source_key, whole, fraction]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                key, rest = row[0], list(row[1:])
                if key != group:
                    if held is not None:
                        out.append((*held, True))
                    group, held = key, None
                f = rest[-1]
                if f <= eps or f >= 1 - eps:
                    rest[-1] = float(round(f))
                    out.append((*rest, False))
                    continue
                if held is None:
                    held = rest
                    continue
                held[-1], rest[-1] = pivot(held[-1], rest[-1], _draw(held[1], rest[1], seed))
                if eps < held[-1] < 1 - eps:
                    done = rest
                elif eps < rest[-1] < 1 - eps:
                    done, held = held, rest
                else:  # both came out whole
                    held[-1] = float(round(held[-1]))
                    out.append((*held, False))
                    done, held = rest, None
                done[-1] = float(round(done[-1]))
                out.append((*done, False))
            yield pd.DataFrame(out, columns=[*_COLUMNS, "open"])
        if held is not None:
            yield pd.DataFrame([(*held, True)], columns=[*_COLUMNS, "open"])

    return run


_COLUMNS = ["unit", "h", "size", "bin", "block", "source_key", "whole", "fraction"]
_SCHEMA = "unit string, h long, size long, bin int, block long, source_key string, whole long, fraction double"


def dependent_copies(units: DataFrame, seed: int = 0, leaf_rows: int = 4096) -> DataFrame:
    """(unit, copies) from (unit, h, size, source_key, p): copies is whole and has expectation p; each source's sum of copies is kept but for one rounding."""
    binned = units.withColumn("bin", F.floor(F.log2(F.greatest("size", F.lit(1))) * 4).cast("int"))
    # One row for each source and size bin, broadcast if a count shows they are few: a hot source's bin is then no hot key.
    blocks = stored(binned.groupBy("source_key", "bin").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).alias("blocks")), "blocks")
    leaves = binned.join(if_few(blocks, 100_000), ["source_key", "bin"]).withColumn("block", F.pmod("h", F.col("blocks"))).withColumn("whole", F.floor("p")).withColumn("fraction", F.col("p") - F.floor("p"))
    deepest = blocks.agg(F.max("blocks")).first()[0] or 1
    groups = [["source_key", "bin", "block"]]
    while deepest > 1:
        deepest = -(-deepest // FAN)
        groups.append(["source_key", "bin", "block"])
    groups.append(["source_key"])
    done, now = [], leaves.select(*_COLUMNS)
    for level, by in enumerate(groups):
        if 0 < level < len(groups) - 1:
            now = now.withColumn("block", F.floor(F.col("block") / FAN))
        key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in by])
        order = [F.col("key"), F.col("bin").desc(), F.col("block"), F.col("size").desc(), F.col("h"), F.col("unit")]
        folded = stored(now.withColumn("key", key).select("key", *_COLUMNS).repartition("key").sortWithinPartitions(*order).mapInPandas(_fold(seed + level), f"{_SCHEMA}, open boolean"), "mix")
        done.append(folded.where(~F.col("open")).select("unit", (F.col("whole") + F.col("fraction").cast("int")).alias("copies")))
        now = folded.where("open").drop("open")
    # One open document a source at most: rounded by chance with its own hash.
    chance = F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(1 << 30)) / (1 << 30)
    done.append(now.select("unit", (F.col("whole") + (chance < F.col("fraction")).cast("int")).alias("copies")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _totals(docs: DataFrame, weights, most: int, text: str, source: str, doc_id: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their source's size and target; and (unit, n, total): rows of each unit and the copies they take together."""
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sized = sized.withColumn("unit", unit_key("source", "doc_id", "size")).withColumn("source_key", source_key("source")).withColumn("part", F.spark_partition_id())
    targets = source_targets(sized, weights, most).withColumn("source_key", source_key("source")).drop("source")
    near = sized.join(if_few(targets, 100_000), "source_key")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = near.groupBy("unit", "source_key", "size").agg(F.count(F.lit(1)).alias("n"), F.first(p).alias("p")).withColumn("p", F.col("n") * F.col("p")).withColumn("h", F.xxhash64("unit"))
    total = dependent_copies(units, seed).withColumnRenamed("copies", "total")
    return near, stored(units.select("unit", "n").join(total, "unit"), "totals")


def _handed_out(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``rows`` (with unit and part) with their copies: each unit's total over its n rows, the odd ones to the first by part. A hot unit is spread over its parts."""
    joined = rows.join(totals, "unit")
    each = F.expr("cast(total div n as int)")
    even = joined.where("total % n = 0").withColumn("copies", each)
    odd = stored(joined.where("total % n <> 0"), "ties")
    tally = odd.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("m"), F.first(F.expr("total % n")).alias("odd"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = tally.select("unit", "part", F.least(F.col("m"), F.col("odd") - before).alias("extra"))
    place = F.row_number().over(Window.partitionBy("unit", "part").orderBy("unit"))  # equal rows: any order does
    handed = odd.withColumn("place", place).join(extra, ["unit", "part"]).withColumn("copies", each + (F.col("place") <= F.col("extra")).cast("int"))
    names = [*[c for c in rows.columns if c != "part"], "copies"]
    return even.select(names).unionByName(handed.select(names))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 0) -> DataFrame:
    """unit, doc_id, source, size, source_size, target, copies: one row per input row; ``unit`` is the key that ``unit_key`` gives."""
    near, totals = _totals(docs, weights, most, text, source, doc_id, seed)
    return _handed_out(near, totals).select("unit", "doc_id", "source", "size", "source_size", "target", "copies")


def source_key(source: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def unit_key(source: str, doc_id: str, size: str):
    return F.concat_ws("\u0002", source_key(source), F.coalesce(F.col(doc_id).cast("string"), F.lit("n")), F.col(size).cast("string"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` repeated as often as it is taken, with the columns of ``docs``."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    keyed = row.select("__row", F.col("__row")[source].alias("source"), F.col("__row")[doc_id].alias("doc_id"), F.coalesce(F.regexp_count(F.col("__row")[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    keyed = keyed.select("__row", unit_key("source", "doc_id", "size").alias("unit"), F.spark_partition_id().alias("part"))
    _, totals = _totals(docs, weights, most, text, source, doc_id, seed)
    taken = _handed_out(keyed, if_few(totals.where("total > 0"))).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
