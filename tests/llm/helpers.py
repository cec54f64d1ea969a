"""Small tables and brute-force versions for the text operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def table(spark, texts, extra=""):
    """A documents table of given texts; ``extra`` adds columns whose names the operators use inside."""
    rows = [(i, t, "en", None if i % 7 == 6 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra.split():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij klmnop".replace(" ", "")) for _ in range(r.randint(2, 8))) for _ in range(words))
