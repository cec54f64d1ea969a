"""Benchmark decontamination by winnowing.

Every run of ``K`` words has a hash; a window of ``WINDOW`` words keeps the least
of its ``WINDOW - K + 1`` hashes as its fingerprint. Equal windows have equal
fingerprints, so a document and the benchmark can share ``WINDOW`` words only
where they share a fingerprint: none is missed. Windows of a document whose
fingerprint the benchmark has are then compared with the benchmark's windows
word by word, and all hit words of a document are the union of its windows.

An item of fewer words is one window of them all (K is then its length and the
window holds one hash); documents get fingerprints of such a length only if the
benchmark has an item of that length.

Fingerprints and windows of the benchmark are broadcast if a count shows that
they are few. Beyond that, fingerprints of documents are shuffled without the
texts, and only the windows that met one follow.

Windows of the same items form one set of items, so a passage that many items
share is one row for a document, whatever their number.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A null text has
no words. Documents are told apart by id and text, so ids may repeat or be null:
rows equal in both get equal results. A null item id counts as the empty string;
items of equal id are one item. No word is too long and no text too large for
the row that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, K = 10, 5
#: The most windows of a benchmark that are broadcast.
FEW = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["k_id", "k_text"]


def lower_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), "")).cast("long")


def _upto(n: Column) -> Column:
    """1 .. n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _sliding(name: str, n: int, of) -> Column:
    """``of`` every ``n`` neighbouring elements of the array ``name``."""
    return F.transform(_upto(F.size(name) - (n - 1)), lambda i: of(*[F.get(name, i + (j - 1)) for j in range(n)]))


def _window_text(at: Column, m: int) -> Column:
    return F.array_join(F.slice("words", at, m), " ")


def with_fingerprints(df: DataFrame, m: int) -> DataFrame:
    """``df`` (with ``words``) with ``prints``: the fingerprint of each window of ``m`` words.

    To be exploded by the outer form: for the inner one the optimizer would add a
    filter on the array's size, and compute the array a second time for it.
    """
    k = K if m >= WINDOW else m
    hashed = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashed.withColumn("grams", _sliding("hashes", k, F.xxhash64)).drop("hashes")
    if m == k:
        return grams.withColumnRenamed("grams", "prints")
    return grams.withColumn("prints", _sliding("grams", m - k + 1, F.least)).drop("grams")


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(m, print, window, set_id) of the benchmark's distinct windows, and (set_id, items): the ids, sorted as strings, of the items that share them."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words_of(F.col(f"`{text}`")).alias("words"))
    n = F.size("words")
    long_ = with_fingerprints(items, WINDOW).select("item", "words", F.posexplode_outer("prints").alias("at", "print")).where("print IS NOT NULL")
    windows = long_.select("item", F.lit(WINDOW).alias("m"), "print", _window_text(F.col("at") + 1, WINDOW).alias("window"))
    short = items.where((n > 0) & (n < WINDOW)).select("item", n.alias("m"), F.xxhash64(*[F.get(F.transform("words", lambda w: F.xxhash64(w)), F.lit(j)) for j in range(WINDOW - 1)]).alias("print"), F.array_join("words", " ").alias("window"))
    shared = windows.unionByName(short).groupBy("m", "print", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    shared = stored(shared.withColumn("set_id", F.sha2(F.array_join("items", "\0"), 256)), "windows")
    return shared.select("m", "print", "window", "set_id"), shared.groupBy("set_id").agg(F.first("items").alias("items"))


def occurrences(docs: DataFrame, windows: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """(k_id, k_text, s, m, set_id): the windows of ``docs`` (k_id, k_text, text) that the benchmark has; ``s`` counts words from 1."""
    out = None
    for m in lengths:
        own = windows.where(F.col("m") == m).select("print", "window", "set_id")
        prints = own.select("print").distinct()
        told = with_fingerprints(docs.select(*_KEY, words_of(F.col("text")).alias("words")), m)
        if few:
            met = told.select(*_KEY, "words", F.posexplode_outer("prints").alias("at", "print")).join(F.broadcast(prints), "print", "left_semi")
            met = met.select(*_KEY, (F.col("at") + 1).alias("s"), _window_text(F.col("at") + 1, m).alias("window"))
            own = F.broadcast(own)
        else:
            starts = told.select(*_KEY, F.posexplode_outer("prints").alias("at", "print")).join(prints, "print", "left_semi")
            starts = starts.groupBy(*_KEY).agg(F.collect_set(F.col("at") + 1).alias("starts")).select(F.col("k_id").alias("s_id"), F.col("k_text").alias("s_text"), "starts")
            texts = docs.join(starts, F.col("k_id").eqNullSafe(F.col("s_id")) & (F.col("k_text") == F.col("s_text")))
            met = texts.select(*_KEY, words_of(F.col("text")).alias("words"), "starts").select(*_KEY, "words", F.explode_outer("starts").alias("s")).select(*_KEY, "s", _window_text(F.col("s"), m).alias("window"))
        found = met.join(own.drop("print"), "window").select(*_KEY, "s", F.lit(m).alias("m"), "set_id")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _covered(windows: Column) -> Column:
    """Words in the union of (s, m)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        end = x["s"] + x["m"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["s"]))).cast("long").alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(F.sort_array(windows), start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", few: int = FEW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated: one row per row of ``docs``. ``items`` is null for clean documents."""
    windows, sets = benchmark_windows(benchmark, item_id, item_text)
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())  # at most ten
    plain = docs.select(F.col(f"`{doc_id}`").alias("k_id"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("k_text"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = plain.select(*_KEY, word_count(F.col("text")).alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if not lengths:
        return rows.select(F.col("k_id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("array<string>").alias("items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    found = occurrences(plain, windows, lengths, windows.limit(few + 1).count() <= few)
    hit = found.groupBy(*_KEY).agg(F.collect_set(F.struct("s", "m")).alias("hits"), F.collect_set("set_id").alias("ids")).select(*_KEY, _covered(F.col("hits")).alias("n_hit"), "ids")
    small_sets = F.broadcast(sets) if sets.limit(few + 1).agg(F.sum(F.size("items"))).first()[0] <= few else sets
    named = hit.select(*_KEY, "n_hit", F.explode("ids").alias("set_id")).join(small_sets, "set_id").groupBy(*_KEY, "n_hit").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    named = named.select(F.col("k_id").alias("h_id"), F.col("k_text").alias("h_text"), "n_hit", "items")
    all_ = rows.join(named, F.col("k_id").eqNullSafe(F.col("h_id")) & (F.col("k_text") == F.col("h_text")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_.select(
        F.col("k_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), "items",
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
