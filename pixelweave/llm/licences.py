"""Licence scan: a trained paragraph classifier with template comparison.

A paragraph is a line, or a notice wrapped over neighbouring lines. What is scored
as one text are spans: from every vocabulary n-gram, wherever it stands in its line,
all that follow within ``REACH`` words, up to the end of its line and of each line
after it without a blank one between. A span without confirmation counts only where
no earlier place of its line holds all of it; a confirmed one doesn't where more
alike spans of other families hold most of its n-grams. Of a family's spans in one
place that of fewest lines is told, by its first line; a line inside a confirmed span of
its family isn't told again. ``n_paragraphs`` counts lines.

Features are the word bigrams and trigrams of a fixed vocabulary (those of the templates that hold an anchor word), so vectors
are sparse and a paragraph without any of them has the same, empty vector: it
is scored once for all as unknown. Multinomial logistic regression gives each
family and the class unknown a probability; a temperature and a threshold for
unknown are calibrated on held-out paragraphs. A prediction is confirmed when
the paragraph holds at least ``ALIKE`` of the bigrams and trigrams of one of
the family's templates.

The classifier is fitted on variants of the templates (words dropped, words
around) and on at most ``NEGATIVES`` paragraphs of the corpus, those with the
least hashes among lines of fewer than 2000 characters. All paragraphs of all documents are scored.

Null text is empty and has one empty paragraph, which is unknown.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

# Short notices of public licences, by family.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
)
# Words that alone tell nothing about licences.
COMMON = "a an and are as at by can except file files following for form forms free in is it may met modify nc not obtain obtaining of or person provided sa source subject terms that the this to use v version with without work you any charge code copy conditions 2.0 3 4.0".split()
# Lines about licences that are no notices, for the class unknown.
NOT_NOTICES = (
    "the driver lost his license last year",
    "a license fee is paid to the general office",
    "the public library is licensed to sell coffee",
    "the apache helicopter landed under fire",
    "mit students released a new version of the game",
    "permission to land was granted by the tower",
)
UNKNOWN = "unknown"
NEGATIVES, VARIANTS, ALIKE = 3000, 60, 0.6
#: A wrapped notice may hold as many other words as the longest template has.
REACH = 2 * max(len(t.split()) for _, t in TEMPLATES)
WORDS = r"[^\p{L}\p{N}.]+|\.(?![\p{N}])"


def word_list(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), WORDS), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct word bigrams and trigrams."""
    n = F.size(words)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(2), of(3)))


def anchors() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()} - set(COMMON))


def template_grams(spark: SparkSession) -> DataFrame:
    """family, template, gram, size: the vocabulary's n-grams of each template; a few hundred rows."""
    found = spark.createDataFrame([(f, i, t) for i, (f, t) in enumerate(TEMPLATES)], "family string, template int, text string")
    held = F.array(*[F.lit(a) for a in anchors()])
    kept = F.filter(grams(word_list(F.col("text"))), lambda g: F.arrays_overlap(F.split(g, " "), held))
    return found.select("family", "template", kept.alias("grams")).select("family", "template", F.explode("grams").alias("gram"), F.size("grams").alias("size"))


def training_rows(docs: DataFrame, text: str, negatives: int) -> DataFrame:
    """family, words, held (for calibration): variants of the templates, lines that are none, and a bounded sample of the corpus."""
    spark = docs.sparkSession
    templates = spark.createDataFrame([(f, t) for f, t in TEMPLATES], "family string, text string").withColumn("words", word_list(F.col("text")))
    around = word_list(F.lit("see below for what we say on this page today and after all others have gone home"))
    drop = F.filter("words", lambda w, i: (F.col("v") < 10) | (F.pmod(F.xxhash64(w, i, F.col("v")), F.lit(100)) >= 12))
    variants = templates.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).select(
        "family", F.concat(F.slice(around, 1, F.pmod("v", F.lit(4))), drop, F.slice(around, 5, F.pmod("v", F.lit(7)))).alias("words"), (F.pmod("v", F.lit(4)) == 3).alias("held")
    )
    single = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    # The sample is told by the hashes of lines alone; its lines are then found in place, so no line of another is moved.
    last = docs.select(F.explode(single).alias("line")).where(F.length("line") < 2000).select(F.xxhash64("line").alias("h")).orderBy("h").limit(negatives).agg(F.max("h")).first()[0]
    last = last if last is not None else 0

    def picked(lines: Column) -> Column:
        """The chosen lines, and each with the two after it, as spans of lines are scored too."""
        after = lambda i: F.concat_ws(" ", *[F.substring(F.get(lines, i + j), 1, 2000) for j in range(3)])
        found = F.transform(lines, lambda x, i: F.when((F.length(x) < 2000) & (F.xxhash64(x) <= last), F.struct(F.xxhash64(x).alias("h"), x.alias("line"), after(i).alias("joined"))))
        return F.filter(found, lambda x: x.isNotNull())

    chosen = docs.select(F.inline(F.get(F.transform(F.array(single), picked), F.lit(0)))).groupBy("h").agg(F.min("line").alias("line"), F.min("joined").alias("joined"))
    sample = chosen.select("h", F.explode(F.array("line", "joined")).alias("line")).select(word_list(F.col("line")).alias("words"), F.pmod("h", F.lit(4)).alias("q"))
    # Corpus lines that hold most of a template are notices, not negatives.
    own = template_grams(spark).groupBy("template").agg(F.collect_list("gram").alias("t"))
    notice = F.exists(F.col("all"), lambda t: F.size(F.array_intersect(t, F.col("g"))) >= 0.5 * F.size(t))
    every = own.agg(F.collect_list("t").alias("all"))
    negative = sample.withColumn("g", grams(F.col("words"))).crossJoin(F.broadcast(every)).where(~notice).select(F.lit(UNKNOWN).alias("family"), "words", (F.col("q") == 3).alias("held"))
    lines_not = spark.createDataFrame([(t, i % 3 == 2) for i, t in enumerate(NOT_NOTICES)], "text string, held boolean").select(F.lit(UNKNOWN).alias("family"), word_list(F.col("text")).alias("words"), "held")
    return variants.unionByName(negative).unionByName(lines_not)


def fit(docs: DataFrame, text: str = "text", negatives: int = NEGATIVES) -> dict:
    """Families, vocabulary, weights, temperature and the threshold for unknown."""
    spark = docs.sparkSession
    vocabulary = sorted(r["gram"] for r in template_grams(spark).select("gram").distinct().collect())  # bounded by the templates
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    rows = stored(training_rows(docs, text, negatives).select(label.alias("label"), grams(F.col("words")).alias("grams"), "held"), "licences")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0).setBinary(True).transform(rows)
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, elasticNetParam=0.2, standardization=False).fit(vectors.where("not held"))
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    held = model.transform(vectors.where("held")).select("label", "rawPrediction").collect()  # a quarter of the bounded training rows
    raw, y = np.array([r["rawPrediction"].toArray() for r in held]), np.array([int(r["label"]) for r in held])

    def at(t: float) -> np.ndarray:
        z = raw / t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    temperature = min((0.25 * 2 ** (k / 2) for k in range(9)), key=lambda t: -np.log(np.maximum(at(t)[np.arange(len(y)), y], 1e-12)).mean())
    p = at(temperature)
    # Above all held-out unknowns' best family, halfway to certainty, and at least one half.
    worst = max((p[y == 0][:, 1:].max() if (y == 0).any() else 0.0), 0.0)
    return {"families": families, "vocabulary": vocabulary, "weights": weights, "bias": bias, "temperature": temperature, "sure": max(0.5, min(0.9, (worst + 1) / 2))}


def vocabulary_grams(text: Column, vocabulary: list[str]) -> Column:
    """Structs (line, end, at, gram) in order: n-grams of the vocabulary with the lines of their first and last words and the place of the first; blank lines between others as the gram ""."""
    words = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), word_list(x).alias("words")))
    blank = lambda x: F.array(F.struct(F.lit("").alias("w"), x["line"].alias("line"), F.lit(False).alias("a")))
    flat = F.flatten(F.transform(words, lambda x: F.when(F.size(x["words"]) == 0, blank(x)).otherwise(F.transform(x["words"], lambda w: F.struct(w.alias("w"), x["line"].alias("line"), w.isin(anchors()).alias("a"))))))

    def of(tokens: Column) -> Column:
        last = F.size(tokens) - 1
        held = lambda i: F.coalesce(F.get(tokens, i)["a"], F.lit(False))
        # Every gram of the vocabulary holds an anchor word.
        places = F.filter(F.sequence(F.lit(0), last), lambda i: held(i) | held(i + 1) | held(i + 2) | ((F.get(tokens, i)["w"] == "") & (F.get(tokens, i + 1)["w"] != "")))

        def at(i: Column, k: int) -> Column:
            joined = F.when(i + k - 1 <= last, F.concat_ws(" ", *[F.get(tokens, i + j)["w"] for j in range(k)]))
            return F.struct(F.get(tokens, i)["line"].alias("line"), F.get(tokens, i + k - 1)["line"].alias("end"), i.alias("at"), joined.alias("gram"))

        return F.filter(F.flatten(F.transform(places, lambda i: F.array(at(i, 1), at(i, 2), at(i, 3)))), lambda x: x["gram"].isin(["", *vocabulary]))

    return F.get(F.transform(F.array(flat), of), F.lit(0))


def spans_of_lines(scanned: DataFrame) -> DataFrame:
    """row, line, end, at, full, places: the vocabulary n-grams (at, gram) from each place that has one, up to ``REACH`` words on and no further than a line ``end`` or a blank line; ``full`` if the place before in the line doesn't reach as far."""
    hits = scanned.where(F.exists("hits", lambda x: x["gram"] != "")).select("row", F.inline("hits"))
    by_word = Window.partitionBy("row").orderBy("at")
    near = hits.withColumns({"near": F.collect_list(F.struct("at", "end", "gram")).over(by_word.rangeBetween(0, REACH)), "before": F.lag(F.struct("line", "at")).over(by_word)})
    starts = near.where((F.col("gram") != "") & (F.col("before").isNull() | (F.col("before.at") != F.col("at"))))
    stop = F.coalesce(F.array_min(F.transform(F.filter("near", lambda x: x["gram"] == ""), lambda x: x["end"])), F.lit((1 << 31) - 1))
    starts = starts.withColumn("stop", stop).withColumn("near", F.filter("near", lambda x: (x["gram"] != "") & (x["end"] < F.col("stop"))))
    ends = starts.select("row", "line", "at", "before", "near", F.explode(F.array_distinct(F.transform("near", lambda x: x["end"]))).alias("end"))
    places = F.transform(F.filter("near", lambda x: x["end"] <= F.col("end")), lambda x: F.struct(x["at"].alias("at"), x["gram"].alias("gram")))
    full = F.col("before").isNull() | (F.col("before.line") != F.col("line")) | (F.array_max("places")["at"] > F.col("before.at") + REACH)
    return ends.withColumn("places", places).select("row", "line", "end", "at", full.alias("full"), "places")


def disowned(compared: DataFrame, near: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, line, end, at, family) of confirmed spans that hold less than half of their n-grams alone: the others stand in a span of another family that is more alike, as where a span ends before the word that tells two families apart."""
    key = ["row", "line", "end", "at"]
    sure = compared.where("confirmed").join(near.select(*key, "places"), key)
    held = sure.select(*key, "family", F.struct("alike", -F.size("places"), "probability", "family").alias("rank"), F.inline(F.transform("places", lambda x: F.struct(x["at"].alias("place"), x["gram"].alias("gram")))))
    held = held.join(F.broadcast(templates.select("family", "gram").distinct()), ["family", "gram"])
    own = (F.max("rank").over(Window.partitionBy("row", "place", "gram"))["family"] == F.col("family")).cast("int")
    return held.withColumn("own", own).groupBy(*key, "family").agg(F.avg("own").alias("own")).where("own < 0.5").drop("own")


def told_once(compared: DataFrame) -> DataFrame:
    """Of (row, line, end, family, confirmed, ...): lines, and the shortest spans that tell more than what they hold, one in a place."""
    inner = Window.partitionBy("row", "family").orderBy(F.desc("line"), "end").rowsBetween(Window.unboundedPreceding, -1)
    holds = F.min("end").over(inner) <= F.col("end")
    holds_sure = F.min(F.when(F.col("confirmed"), F.col("end"))).over(inner) <= F.col("end")
    least = compared.withColumn("more", F.coalesce(F.when(F.col("confirmed"), holds_sure).otherwise(holds), F.lit(False))).where(~F.col("more")).drop("more")
    # What a confirmed span of the family holds or shares a line with says the same: spans in order, confirmed ones first.
    order = F.array_sort(F.collect_list(F.struct("line", "end", *[c for c in least.columns if c not in ("row", "line", "end", "family")])))
    per = least.groupBy("row", "family").agg(order.alias("all"))
    sure, rest = F.filter("all", lambda x: x["confirmed"]), F.filter("all", lambda x: ~x["confirmed"])
    kind = dict(per.dtypes)["all"]

    def fold(spans: Column) -> Column:
        start = F.struct(F.lit(-1).alias("last"), F.array().cast(kind).alias("out"))
        step = lambda acc, x: F.when(x["line"] > acc["last"], F.struct(x["end"].alias("last"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)
        return F.aggregate(spans, start, step, lambda acc: acc["out"])

    per = per.select("row", "family", fold(sure).alias("sure"), fold(rest).alias("rest"))
    apart = F.filter("rest", lambda x: ~F.exists("sure", lambda y: (x["line"] <= y["end"]) & (y["line"] <= x["end"])))
    return per.select("row", "family", F.inline(F.concat("sure", apart)))


def scan_licences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: dict | None = None) -> DataFrame:
    """doc_id, n_paragraphs, ``found``: array of structs (line, end, family, probability, alike, confirmed) of the paragraphs that are not unknown."""
    spark = docs.sparkSession
    model = model or fit(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    any_anchor = F.lower(body).rlike("|".join(anchors()).replace(".", r"\."))
    hits = F.when(any_anchor, vocabulary_grams(body, model["vocabulary"])).otherwise(F.array().cast("array<struct<line:int,end:int,at:int,gram:string>>"))
    scanned = stored(docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.size(F.split(body, "\n")).cast("long").alias("n_paragraphs"), hits.alias("hits")), "paragraphs")
    near = stored(spans_of_lines(scanned), "spans")
    key, templates = ["row", "line", "end", "at"], template_grams(spark)
    hits = near.select(*key, "full", F.explode(F.array_distinct(F.transform("places", lambda x: x["gram"]))).alias("gram"))
    k = len(model["families"])
    weights = spark.createDataFrame([(g, *map(float, model["weights"][:, i])) for i, g in enumerate(model["vocabulary"])], "gram string, " + ", ".join(f"w{j} double" for j in range(k)))
    sums = hits.join(F.broadcast(weights), "gram").groupBy(*key, "full").agg(*[F.sum(f"w{j}").alias(f"s{j}") for j in range(k)])
    z = F.array(*[(F.col(f"s{j}") + float(model["bias"][j])) / float(model["temperature"]) for j in range(k)])
    e = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    scored = sums.select(*key, "full", z.alias("z")).withColumn("p", F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
    best = F.array_max(F.slice("p", 2, k - 1))
    family = F.element_at(F.array(*[F.lit(f) for f in model["families"][1:]]), F.array_position(F.slice("p", 2, k - 1), best).cast("int"))
    told = scored.select(*key, "full", best.alias("probability"), family.alias("family")).where(F.col("probability") >= model["sure"])
    alike = hits.join(F.broadcast(templates), "gram").groupBy(*key, "family", "template").agg((F.count(F.lit(1)) / F.max("size")).alias("alike")).groupBy(*key, "family").agg(F.max("alike").alias("alike"))
    alike_or_0 = F.coalesce("alike", F.lit(0.0))
    compared = told.join(alike, [*key, "family"], "left").select(*key, "full", "family", F.round("probability", 4).alias("probability"), F.round(alike_or_0, 4).alias("alike"), (alike_or_0 >= ALIKE).alias("confirmed"))
    compared = stored(compared.where(F.col("full") | F.col("confirmed")), "compared")
    left = compared.join(disowned(compared, near, templates), [*key, "family"], "left_anti")
    most = F.max_by(F.struct("probability", "alike", "confirmed"), F.struct("confirmed", "alike", -F.col("at")))
    by_lines = left.groupBy("row", "line", "end", "family").agg(most.alias("most")).select("row", "line", "end", "family", "most.*")
    per = told_once(by_lines).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line", "end", "family", "probability", "alike", "confirmed"))).alias("found"))
    none = F.array().cast("array<struct<line:int,end:int,family:string,probability:double,alike:double,confirmed:boolean>>")
    return scanned.select("doc_id", "row", "n_paragraphs").join(per, "row", "left").select("doc_id", "n_paragraphs", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    sure = F.filter("found", lambda x: x["confirmed"])
    return scanned.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x["family"], x["line"].cast("string"))), ",").alias("paragraphs"),
    )
