"""The pipeline over odd tables: nulls in any column, repeated rows, ties, clashing names, no rows."""

import corpus_pipeline
from pyspark.sql import functions as F

from .helpers import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, tmp_path, rows, labels, extra=""):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra.split():
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def odd_rows():
    rows = [(i, prose(i, 40 + i % 7), "en" if i % 5 else None, f"s{i % 3}" if i % 4 else None, 200 if i % 6 else None) for i in range(60)]
    rows += rows[:10] + [(None, prose(500, 30), "en", "s0", 10)] * 4 + [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "a b", "en", "s2", 3)]
    near = prose(7, 200).split()
    return rows + [(200 + i, " ".join(near[:-1] + [f"w{i}"]), "en", "s1", 900) for i in range(5)]


def test_odd_rows(spark, tmp_path):
    labels = [(i, i % 2, 0) for i in range(0, 60, 3)] + [(None, 1, 0), (9, None, None), (3, 1, 0)]
    d = write(spark, tmp_path, odd_rows(), labels, "ids label key kept h row bands size")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, seen, d)
        assert new.columns == docs.columns, name
        out = str(tmp_path / f"stage-{name.split()[0]}")
        new.write.parquet(out)
        seen = spark.read.parquet(out)
        assert {r.doc_id for r in seen.collect()} <= ids and seen.count(), name
        if name == "exact dedup":
            assert seen.groupBy(F.coalesce("text", F.lit(""))).count().where("count > 1").isEmpty()
        if name == "MinHash near-dedup":
            assert seen.where("doc_id BETWEEN 200 AND 204").count() <= 1
    last = corpus_pipeline.STAGES[-1][1](spark, seen, d)
    assert last.count() == seen.count() and last.where("NOT round_trip").isEmpty()


def test_no_rows_and_no_labels(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "a", [], [(1, 1, 0)])).count() == 0
    got = corpus_pipeline.run(spark, write(spark, tmp_path / "b", odd_rows()[:20], []))
    assert got.where("NOT round_trip").isEmpty()
