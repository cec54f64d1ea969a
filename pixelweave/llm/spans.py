"""Matches with their places, from built-in functions only.

Spark's regular-expression functions give the matches but not where they are.
``split`` gives the text between matches of the same pattern, so a running sum
of the lengths of both gives every start and end, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Sums are appended to arrays of at most so many members, so that a long text's matches aren't copied for each of them.
BLOCK = 256


def running_sums(values: Column) -> Column:
    """The sum of each value and all before it: sums within blocks, and sums of the blocks before."""
    long = "array<bigint>"
    sums = lambda x: F.aggregate(x, F.array().cast(long), lambda acc, v: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v))

    def joined_up(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda x: F.element_at(x, -1)))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("own"), F.concat(F.array(F.lit(0).cast("bigint")), ends).alias("before")), lambda x: F.transform(F.coalesce(x["own"], F.array().cast(long)), lambda v: v + x["before"])))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    return let(F.transform(starts, lambda i: sums(F.slice(values, i, BLOCK))), joined_up)


def find(text: Column, pattern: str, where: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, v), end exclusive; empty where ``where`` is false.

    ``where`` is a cheaper or stricter test; rows that fail it skip the work.
    The work is linear in the text and in the number of matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("v"))), lambda x: x["v"].isNotNull())

    def placed(found: Column) -> Column:
        ends = running_sums(F.transform(found, lambda x: (x["gap"] + F.length(x["v"])).cast("bigint")))
        return F.zip_with(found, ends, lambda x, e: F.struct((e - F.length(x["v"])).cast("int").alias("s"), e.cast("int").alias("e"), x["v"].alias("v")))

    found = let(pairs, lambda x: F.when(F.size(x) > 0, placed(x)).otherwise(none()))
    return found if where is None else F.when(where, found).otherwise(none())


def between(text: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern, as structs (s, e, v), some of them empty; the whole text if it has none."""

    def placed(parts: Column, matches: Column) -> Column:
        ends = running_sums(F.transform(F.zip_with(parts, matches, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))), lambda n: n.cast("bigint")))
        starts = F.concat(F.array(F.lit(0).cast("bigint")), ends)
        return F.transform(F.filter(F.arrays_zip(parts.alias("v"), starts.alias("s")), lambda x: x["v"].isNotNull()), lambda x: F.struct(x["s"].cast("int").alias("s"), (x["s"] + F.length(x["v"])).cast("int").alias("e"), x["v"].alias("v")))

    return let(F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: placed(parts, matches)))


def blanked(text: Column, pattern: str, where: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """The text with each match (each that ``keep`` holds for) turned into as many spaces, so that places stay; as it is where ``where`` is false."""
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    told = lambda m: F.coalesce(blank(m) if keep is None else F.when(keep(m), blank(m)).otherwise(m), F.lit(""))
    return F.when(where, F.array_join(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.concat(g, told(m))), "")).otherwise(text)


def kinded(spans: Column, kind: str, order: int) -> Column:
    """Spans as structs that sort by start, then by the order of kinds."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that touch none of ``others``."""
    return F.filter(spans, lambda x: ~F.exists(others, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
