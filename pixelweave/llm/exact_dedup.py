"""Exact dedup by content sort.

Sampled splitters range-partition the rows on a short sort key (leading bytes,
then a 64-bit hash of the whole text), each task sorts its range externally so
that equal texts are neighbours, and the window operator compares neighbours
by their full text. The key bounds what the sampling of splitters sends to the
driver: about 40 bytes a sample, whatever the length of the texts.

Hot groups: a digest held by more than ``max(hot_rows, rows / hot_groups)``
rows gets a salt by doc id and input partition, so its copies spread over ranges
even where their ids are null or equal: over ``salts`` of them, and over more the
larger the group is. There are at most ``hot_groups`` such digests, so the salted
digests and the merge of their partial winners, at most ``hot_groups * (salts + 8)``,
are small enough to broadcast.

Null text counts as empty. Rows with null ids come last in a group; of rows
equal in text and id, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAD = 24


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max", normalise=None, hot_rows: int = 1000, hot_groups: int = 1000, salts: int = 64) -> DataFrame:
    """One row per input row: ``doc`` (the input row as a struct), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``normalise`` maps the text column before comparison (none: identical texts
    only); ``keep`` is ``"max"`` or ``"min"`` of the ids.
    """
    normalise = normalise or (lambda c: c)
    others = [c for c in docs.columns if c != text]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("__pad")).alias("rest"),
        F.col(f"`{text}`").isNull().alias("was_null"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("raw"),
    ).withColumn("body", normalise(F.col("raw")))
    rows = docs.count()
    few = max(hot_rows, rows // hot_groups)
    parts = F.greatest(F.lit(salts), F.ceil(F.col("count") * 4 / few)).cast("int")
    hot = base.groupBy(F.sha2("body", 256).alias("digest")).count().where(F.col("count") > few).select("digest", F.lit(True).alias("hot"), parts.alias("parts"))
    doc = F.col("rest").getField(doc_id)
    keyed = (
        base.withColumn("digest", F.sha2("body", 256))
        .join(F.broadcast(hot), "digest", "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(doc, F.spark_partition_id()), F.col("parts")).cast("int")).otherwise(F.lit(0)))
        .withColumns({"lead": F.substring("body", 1, LEAD), "h": F.xxhash64("body")})
        .repartitionByRange("lead", "h", "salt")
    )
    same = Window.partitionBy("lead", "h", "salt", "body")
    first = F.col("rest").getField(doc_id).desc_nulls_last() if keep == "max" else F.col("rest").getField(doc_id).asc_nulls_last()
    best = F.max if keep == "max" else F.min
    part = keyed.select(
        "rest", "was_null", "raw", "digest", "hot", "salt",
        best(doc).over(same).alias("part_keep"), F.count(F.lit(1)).over(same).alias("part_size"), F.row_number().over(same.orderBy(first)).alias("nth"),
        "body",
    )
    # The partial winners of the salted groups: full texts are compared once more, one row a salt.
    winners = part.where(F.col("hot") & (F.col("nth") == 1)).select("digest", "salt", "body", "part_keep", "part_size")
    whole = winners.groupBy("digest", "body").agg(best("part_keep").alias("keep_id"), F.sum("part_size").alias("group_size"), F.collect_list(F.struct("salt", "part_keep")).alias("parts"))
    lookup = whole.select("digest", "keep_id", "group_size", F.array_min(F.transform(F.filter("parts", lambda p: p["part_keep"].eqNullSafe(F.col("keep_id"))), lambda p: p["salt"])).alias("first_salt"), F.explode("parts").alias("p")).select(
        F.col("digest").alias("w_digest"), F.col("p.salt").alias("w_salt"), F.col("p.part_keep").alias("w_part"), F.col("keep_id").alias("w_keep"), F.col("group_size").alias("w_size"), "first_salt"
    )
    joined = part.join(F.broadcast(lookup), F.col("hot") & (F.col("digest") == F.col("w_digest")) & (F.col("salt") == F.col("w_salt")) & F.col("part_keep").eqNullSafe(F.col("w_part")), "left")
    keep_id = F.when(F.col("hot"), F.col("w_keep")).otherwise(F.col("part_keep"))
    # The id that stays may be in several parts, null or repeated: of these the lowest salt's winner stays.
    wins = (F.col("nth") == 1) & (F.col("hot").isNull() | (F.col("salt") == F.col("first_salt")))
    row = F.struct(*[F.when(~F.col("was_null"), F.col("raw")).alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])
    return joined.select(row.alias("doc"), keep_id.alias("keep_id"), F.when(F.col("hot"), F.col("w_size")).otherwise(F.col("part_size")).alias("group_size"), wins.alias("kept"), F.col("digest").alias("text_sha256"))
