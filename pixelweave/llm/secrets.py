"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Base kinds are assign, access and hex. The method adds two kinds for strings
that no pattern names: runs of the hexadecimal class and of the base-64 class
in which some window of ``WINDOW`` characters has at least the class's Shannon
entropy. The window's entropy follows from counts that each step changes by one
in and one out.

A run ends where a base span stands, and where a window would come within
``WINDOW`` characters of an allow-listed word (placeholders, alphabets in order);
what is left on both sides is scanned. Identifiers with dashes in their usual
form are suppressed.

Null text is empty and has no spans; ``base_sha256`` is then that of "".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

# The base patterns and the least lengths that the results are defined by.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEPT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
ASSIGN_LEAST = 12
#: Runs of one class are maximal, so the least length can stand in the pattern: a match that fails holds no later one that passes.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
#: Class, its characters, and the entropy in bits from which a window counts.
CLASSES = (("entropy_hex", "0-9a-fA-F", 3.0), ("entropy_base64", "A-Za-z0-9+/_=-", 3.9))
ALLOWED = r"(?i:example|sample|dummy|placeholder|changeme|your[_-]|x{6}|0123456789|abcdefgh)"
IDENTIFIER = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Allow-listed words with what is within WINDOW characters of them.
AROUND_ALLOWED = rf"(?s)(?:.{{0,{WINDOW}}}{ALLOWED})+.{{0,{WINDOW}}}"


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any ``window`` neighbouring characters of an ASCII string.

    State: S = sum of c * log2(c) over the counts c of the window's characters,
    and the least S of a full window; H = log2(window) - S / window. A step
    changes two counts by one, that of the character that comes and that of the
    one that goes; both are counted in the window, so a step costs the same
    however long the string is.
    """
    return spans.let(F.transform(F.split(value, ""), F.ascii), lambda codes: _least_sum(codes, window))


def _least_sum(codes: Column, window: int) -> Column:
    # What S gains when a count rises from c to c + 1.
    gains = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(window + 1)])
    count = lambda part, x: F.size(F.filter(part, lambda y: y == x))

    def step(acc: Column, i: Column) -> Column:
        # The window before the step holds codes i - window .. i - 1 (from one); what stays of it, the later window - 1.
        new, old = F.get(codes, i - 1), F.get(codes, i - 1 - window)
        stays = F.slice(codes, F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1)))
        gone = F.when(i > window, F.get(gains, count(stays, old))).otherwise(0.0)
        s = F.when(new == old, acc["s"]).otherwise(acc["s"] - gone + F.get(gains, count(stays, new)))
        return spans.let(s, lambda s: F.struct(s.alias("s"), F.when(i >= window, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least")))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))
    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ``base`` and ``extra`` (arrays of structs s, k, e, kind, v), one row per row of ``docs``."""
    t = F.col("t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    assign = F.filter(spans.find(t, ASSIGN, t.rlike(ASSIGN_KEPT)), lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.concat(
        spans.kinded(assign, "assign", 0),
        spans.kinded(spans.find(t, ACCESS, t.rlike(ACCESS)), "access", 1),
        spans.kinded(spans.find(t, HEX, t.rlike(HEX)), "hex", 2),
    )
    # Base spans turned into spaces end the runs around them.
    free = spans.blanked(t, ASSIGN, t.rlike(ASSIGN_KEPT), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST)
    based = rows.select("doc_id", base.alias("base"), free.alias("t"))
    for pattern in (ACCESS, HEX):
        based = based.withColumn("t", spans.blanked(t, pattern, t.rlike(pattern)))
    candidates = []
    for order, (kind, chars, _) in enumerate(CLASSES, 3):
        run = f"[{chars}]{{{WINDOW},}}"
        with_digit = f"(?<![{chars}])(?=[{chars.replace('0-9', '')}]*+[0-9])[{chars}]{{{WINDOW},}}"
        whole = F.filter(spans.find(t, run, t.rlike(with_digit)), lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]"))
        pieces = lambda x: F.when(x["v"].rlike(ALLOWED), F.transform(spans.between(x["v"], AROUND_ALLOWED), lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"), y["v"].alias("v")))).otherwise(F.array(x))
        fresh = F.filter(F.flatten(F.transform(whole, pieces)), lambda x: (F.length(x["v"]) >= WINDOW) & x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]") & ~x["v"].rlike(IDENTIFIER))
        candidates.append(spans.kinded(fresh, kind, order))
    found = based.select("doc_id", "base", F.concat(*candidates).alias("candidates"))
    least = F.create_map(*[F.lit(x) for kind, _, bits in CLASSES for x in (kind, bits)])
    scored = found.select("doc_id", "base", F.when(F.size("candidates") > 0, F.filter("candidates", lambda x: window_entropy(x["v"]) >= F.element_at(least, x["kind"]))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,kind:string,v:string>>")).alias("extra"))
    # A string that passes both classes is told once, by the narrower.
    once = F.filter("extra", lambda x: (x["k"] == 3) | ~F.exists("extra", lambda y: (y["k"] == 3) & (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return scored.select("doc_id", "base", once.alias("extra"))


def digest(scanned: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The scan's counts and span strings."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(k) for k in kinds], F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.concat("base", "extra")).alias("spans"))
