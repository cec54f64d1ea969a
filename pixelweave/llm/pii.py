"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Base kinds are email, ip, card and phone. Their matches are the seeds. Every
other token with at least ``DIGITS`` digits or an "@" is a candidate. Words
beside seeds and candidates are lexical patterns; patterns and values form a
graph. In each round a pattern's score for a kind is its share of values known
to be of that kind (smoothed), and a value's score is that of its best
pattern; after ``ROUNDS`` rounds candidates whose best pattern reaches
``SURE`` with ``SUPPORT`` seed values or more become spans of kind
``like_<kind>``. Edges are counted per (pattern, value) before they are
joined, and patterns only by equi-joins, so a word beside a third of all
values is one key with summed rows.

A value found as two kinds counts as the one whose name is last in the alphabet.

Null text is empty. Rows are told apart by a row number taken when the scan is
stored, so repeated ids stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import if_few, stored

# The base patterns. Possessive quantifiers and a start at the head of a run
# (or where the last match ended) change no match; they keep long runs from being tried at every place.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

DIGITS, ROUNDS, SURE, SUPPORT = 5, 3, 0.8, 5
#: A token with an "@" or with DIGITS digits; no place but the head of a token is tried.
TOKEN = r"(?<!\S)(?=[^\s@]*+@|[^\s0-9]*+(?:[0-9][^\s0-9]*+){%d})\S++" % DIGITS
#: Characters beside a span in which a neighbouring word is looked for first.
NEAR = 80


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def base_spans(t: Column) -> Column:
    digits = lambda x: F.regexp_replace(x["v"], "[^0-9]", "")
    email = spans.find(t, EMAIL, t.contains("@"))
    ip = F.filter(spans.find(t, IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda x: F.forall(F.split(x["v"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    card = F.filter(spans.find(t, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda x: F.when(F.length(digits(x)).between(14, 19), luhn(digits(x))).otherwise(False))
    phone = F.filter(spans.find(t, PHONE, t.contains("+")), lambda x: F.length(digits(x)).between(10, 15))
    return F.concat(*[spans.kinded(s, kind, k) for k, (kind, s) in enumerate(zip(KINDS, (email, ip, card, phone), strict=True))])


def _word(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _first_word(few: Column, whole: Column) -> Column:
    """The first run of other characters than spaces of ``whole``, whose first NEAR characters are ``few``."""
    head = r"^\s*(\S+)"
    return F.when(F.length(F.regexp_extract(few, r"^\s*\S*", 0)) < NEAR, F.regexp_extract(few, head, 1)).otherwise(F.regexp_extract(whole, head, 1))


def left_word(t: Column, s: Column) -> Column:
    """The word before place ``s`` of a text, of any length: the first of the reversed text before it."""
    few = F.reverse(F.substring(t, F.greatest(s - NEAR + 1, F.lit(1)), F.least(s, F.lit(NEAR))))
    return _word(F.reverse(_first_word(few, F.reverse(F.substring(t, F.lit(1), s)))))


def right_word(t: Column, e: Column) -> Column:
    """The word from place ``e`` of a text on."""
    return _word(_first_word(F.substring(t, e + 1, F.lit(NEAR)), F.substring(t, e + 1, F.length(t) - e)))


def scan_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, ``base`` and ``extra`` (arrays of structs s, k, e, kind, v), one row per row of ``docs``."""
    t = F.col("t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    based = rows.select("doc_id", "t", base_spans(t).alias("base"))
    candidate = spans.find(t, TOKEN, t.rlike(TOKEN))
    trimmed = F.transform(candidate, lambda x: F.struct((x["s"] + F.length(x["v"]) - F.length(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}+]+", ""))).alias("s"), (x["e"] - F.length(x["v"]) + F.length(F.regexp_replace(x["v"], r"[^\p{L}\p{N}]+$", ""))).alias("e"), F.regexp_replace(x["v"], r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "").alias("v")))
    fresh = spans.kinded(F.filter(spans.apart(trimmed, F.col("base")), lambda x: F.length(x["v"]) > 0), "", 9)
    both = based.select("doc_id", "t", "base", fresh.alias("fresh"))
    beside = F.transform(F.concat("base", "fresh"), lambda x: F.struct(*[x[f].alias(f) for f in ("s", "k", "e", "kind", "v")], left_word(t, x["s"]).alias("left"), right_word(t, x["e"]).alias("right")))
    scanned = stored(both.select("doc_id", F.monotonically_increasing_id().alias("row"), "base", beside.alias("found")), "pii")
    places = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.*")
    edges = (
        places.select("v", "kind", F.explode(F.array(F.concat(F.lit("l "), "left"), F.concat(F.lit("r "), "right"))).alias("pattern"))
        .where(F.length("pattern") > 2)
        .groupBy("pattern", "v")
        .agg(F.max("kind").alias("kind"))
    )
    edges = stored(edges, "edges")
    # A value's kind and how sure it is: 1 for seeds, then what its best pattern gives.
    known = edges.where(F.col("kind") != "").select("v", "kind").distinct().withColumn("score", F.lit(1.0))
    strong = None
    for _ in range(rounds):
        told = edges.select("pattern", "v").join(known, "v", "left")
        total = told.groupBy("pattern").agg(F.count_distinct("v").alias("values"))
        scores = told.where(F.col("score").isNotNull()).groupBy("pattern", F.col("kind").alias("p_kind")).agg(F.sum("score").alias("s"), F.sum((F.col("score") == 1).cast("int")).alias("seeds"))
        scores = stored(scores.where(F.col("seeds") >= support).join(total, "pattern").select("pattern", "p_kind", "seeds", (F.col("s") / (F.col("values") + 1)).alias("p")), "scores")
        best = F.max(F.struct("p", "seeds", "p_kind"))
        # Patterns of many seeds are few; broadcast, a pattern beside a third of all values is no hot key.
        guessed = edges.where(F.col("kind") == "").select("pattern", "v").join(if_few(scores, 100_000), "pattern").groupBy("v").agg(best.alias("b"))
        strong = guessed.where(F.col("b.p") >= sure).select("v", F.col("b.p_kind").alias("kind"), F.col("b.p").alias("score"))
        known = edges.where(F.col("kind") != "").select("v", "kind").distinct().withColumn("score", F.lit(1.0)).unionByName(strong)
    new = places.where(F.col("kind") == "").select("row", "v", "s", "e").join(strong.select("v", "kind"), "v")
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k + len(KINDS))])
    per = new.groupBy("row").agg(F.collect_list(F.struct("s", F.element_at(order, F.col("kind")).alias("k"), "e", F.concat(F.lit("like_"), "kind").alias("kind"), "v")).alias("extra"))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,kind:string,v:string>>")
    return scanned.select("doc_id", "row", "base").join(per, "row", "left").select("doc_id", "base", F.coalesce("extra", empty).alias("extra"))
