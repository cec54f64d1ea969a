"""Masks as words: a row (slide, y, w, bits) holds the 64 cells x = 64 w .. 64 w + 63 of an image row, bit i the cell 64 w + i.

Several masks of a slide are several columns of the same rows. Formulas are
bitwise expressions on them, and areas are ``bit_count``s, all inside generated
code; a shuffle moves a sixty-fourth of the rows that pixels would need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
PLACE = ["slide", "y", "w"]


class Bits:
    """A column of words under ``&``, ``|`` and ``~``. Bits of a complement outside the image are set, so a formula ends in an intersection with a mask."""

    def __init__(self, column: Column):
        self.column = column

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.column.bitwiseAND(other.column))

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.column.bitwiseOR(other.column))

    def __invert__(self) -> Bits:
        return Bits(F.bitwise_not(self.column))

    def count(self) -> Column:
        """Set cells of all rows of a group."""
        return F.sum(F.bit_count(self.column).cast("long"))


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def up(value: Column, by: Column) -> Column:
    return _shift("shiftleft", value, by)


def down(value: Column, by: Column) -> Column:
    """Shift towards lower bits, zeros coming in."""
    return _shift("shiftrightunsigned", value, by)


def full() -> Column:
    return F.lit(-1).cast("long")


def span(low: Column, high: Column) -> Column:
    """A word with the bits low .. high set, both within 0 .. 63."""
    return up(full(), low).bitwiseAND(down(full(), F.lit(WORD - 1) - high))


def bit(x: Column) -> Column:
    return up(F.lit(1).cast("long"), x % WORD)


def word(x: Column) -> Column:
    return F.floor(x / WORD).cast("int")


def from_pixels(m: DataFrame) -> DataFrame:
    """(slide, y, w, bits) of the cells of ``m``."""
    return m.groupBy("slide", "y", word(F.col("x")).alias("w")).agg(F.bit_or(bit(F.col("x"))).alias("bits"))


def to_pixels(words: DataFrame, bits: Column | None = None) -> DataFrame:
    """(slide, y, x) of the set cells."""
    every = words.select(*PLACE, (F.col("bits") if bits is None else bits).alias("b")).where("b != 0").select(*PLACE, "b", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("i"))
    return every.where(down(F.col("b"), F.col("i")).bitwiseAND(F.lit(1)) == 1).select("slide", "y", (F.col("w") * WORD + F.col("i")).alias("x"))


def from_runs(runs: DataFrame) -> DataFrame:
    """Words of (slide, y, x0, x1), ends inclusive."""
    cut = runs.select("slide", "y", "x0", "x1", F.explode(F.sequence(word(F.col("x0")), word(F.col("x1")))).alias("w"))
    low, high = F.greatest(F.col("x0") - F.col("w") * WORD, F.lit(0)), F.least(F.col("x1") - F.col("w") * WORD, F.lit(WORD - 1))
    return cut.groupBy(*PLACE).agg(F.bit_or(span(low, high)).alias("bits"))


def to_runs(words: DataFrame) -> DataFrame:
    """(slide, y, x0, x1): runs of set cells, cut where words meet.

    A run starts at a set bit without a set bit below it; above the start, its
    length is the number of trailing ones.
    """
    starts = F.col("bits").bitwiseAND(F.bitwise_not(up(F.col("bits"), F.lit(1))))
    each = words.where("bits != 0").select(*PLACE, "bits", starts.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("i"))
    rest = F.bitwise_not(down(F.col("bits"), F.col("i")))
    # The lowest zero of what is above the start; z & -z as z & (~z + 1), which can't overflow but for the least long.
    low = rest.bitwiseAND(F.when(rest == F.lit(-(1 << 63)), rest).otherwise(-rest))
    length = F.when(rest == 0, WORD).otherwise(F.bit_count(F.when(low == F.lit(-(1 << 63)), F.lit((1 << 63) - 1)).otherwise(low - 1)))
    x0 = F.col("w") * WORD + F.col("i")
    return each.where(down(F.col("s"), F.col("i")).bitwiseAND(F.lit(1)) == 1).select("slide", "y", x0.alias("x0"), (x0 + length - 1).cast("int").alias("x1"))


def cut(words: DataFrame, side: int, masks: list[str], by: str = "by", bx: str = "bx") -> DataFrame:
    """The rows with ``by`` and ``bx`` of each square of the given side that they reach into, and the masks' bits inside it."""
    first = F.col("w") * WORD
    reach = words.withColumn(by, F.floor(F.col("y") / side).cast("int")).withColumn(bx, F.explode(F.sequence(F.floor(first / side).cast("int"), F.floor((first + WORD - 1) / side).cast("int"))))
    low = F.greatest(F.col(bx) * side - first, F.lit(0))
    high = F.least((F.col(bx) + 1) * side - 1 - first, F.lit(WORD - 1))
    return reach.withColumns({m: F.col(m).bitwiseAND(span(low, high)) for m in masks})


def joined(parts: dict[str, DataFrame]) -> DataFrame:
    """Masks given as words, side by side: one row a place, a column a name."""
    rows = None
    for name, part in parts.items():
        one = part.select(*PLACE, *[(F.col("bits") if n == name else F.lit(0).cast("long")).alias(n) for n in parts])
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*PLACE).agg(*[F.bit_or(n).alias(n) for n in parts])


def complement(words: DataFrame, height: int, width: int) -> DataFrame:
    """(slide, y, w, bits): the unset cells of the extent of each slide that has a row."""
    first = F.col("w") * WORD
    every = words.select("slide").distinct().select("slide", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("slide", "y", F.explode(F.sequence(F.lit(0), F.lit((width - 1) // WORD))).alias("w"))
    both = joined({"every": every.select(*PLACE, span(F.lit(0), F.least(F.lit(WORD - 1), F.lit(width - 1) - first)).alias("bits")), "set": words})
    return both.select(*PLACE, F.col("every").bitwiseAND(F.bitwise_not("set")).alias("bits")).where("bits != 0")


def surface(words: DataFrame, height: int, width: int) -> DataFrame:
    """Set cells with an unset one above, below, left or right of them; cells at the image's border are part of it.

    A word goes to its four neighbours' rows by one shuffle; of the words beside it only one bit matters.
    """
    b = F.col("bits")
    place = lambda dy, dw, kind, value: F.struct((F.col("y") + dy).alias("y"), (F.col("w") + dw).alias("w"), F.lit(kind).alias("kind"), value.alias("v"))
    sent = F.array(place(0, 0, "m", b), place(1, 0, "above", b), place(-1, 0, "below", b), place(0, 1, "left", down(b, F.lit(WORD - 1))), place(0, -1, "right", up(b, F.lit(WORD - 1))))
    met = words.select("slide", F.explode(sent).alias("n")).select("slide", "n.*").groupBy(*PLACE)
    zero = F.lit(0).cast("long")
    kinds = ("m", "above", "below", "left", "right")
    rows = met.agg(*[F.coalesce(F.bit_or(F.when(F.col("kind") == k, F.col("v"))), zero).alias(k) for k in kinds])
    m = F.col("m")
    inner = m.bitwiseAND(F.col("above")).bitwiseAND(F.col("below")).bitwiseAND(up(m, F.lit(1)).bitwiseOR(F.col("left"))).bitwiseAND(down(m, F.lit(1)).bitwiseOR(F.col("right")))
    inner = F.when((F.col("y") <= 0) | (F.col("y") >= height - 1), zero).otherwise(inner)
    return rows.where("m != 0").select(*PLACE, m.bitwiseAND(F.bitwise_not(inner)).alias("bits")).where("bits != 0")
