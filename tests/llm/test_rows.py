import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pixelweave.llm import entry, exact_dedup, mixing

from .helpers import SMALL, prose, table


def brute_groups(rows, best=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (best((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check_dedup(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute_groups(rows)
    got = exact_dedup.exact_dedup(df, **options).collect()
    assert sorted(map(repr, ((r.doc.doc_id, r.doc.text) for r in got))) == sorted(map(repr, rows))
    kept = defaultdict(int)
    for r in got:
        t = r.doc.text or ""
        assert (r.keep_id, r.group_size) == want[t] and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        kept[t] += r.kept
        assert not r.kept or r.doc.doc_id == r.keep_id
    assert set(kept.values()) <= {1} and len(kept) == len(want)


def test_exact_dedup_cases(spark):
    texts = [None, "", "a", "a", "A", "a ", prose(1, 9000), prose(1, 9000), "same lead " * 20 + "1", "same lead " * 20 + "2", "same lead " * 20 + "1", None]
    df = table(spark, texts, "body h salt lead digest rest kept")
    check_dedup(df)
    check_dedup(df.union(df))
    check_dedup(df.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))))
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(df).select("doc.*").columns == df.columns


def test_exact_dedup_salts_hot_groups(spark):
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm").otherwise(F.col("id").cast("string")).alias("text"), F.col("id").alias("doc_id"))
    check_dedup(df, hot_rows=10, salts=8)
    check_dedup(df.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))), hot_rows=10, salts=8)
    check_dedup(df.withColumn("doc_id", F.lit(None).cast("long")), hot_rows=10, salts=8)


def test_exact_dedup_splits_hot_groups_of_null_and_repeated_ids(spark):
    df = spark.range(3000).repartition(16).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"), F.lit(None).cast("long").alias("doc_id"))
    check_dedup(df, hot_rows=10, salts=8)
    check_dedup(df.withColumn("doc_id", F.lit(7).cast("long")), hot_rows=10, salts=8)
    check_dedup(df.withColumn("doc_id", F.when(F.col("text") == "hot", F.lit(7)).cast("long")).union(df), hot_rows=10, salts=8)
    keyed = exact_dedup.exact_dedup(df, hot_rows=10, salts=8)
    parts = {r["count"] for r in df.where("text = 'hot'").groupBy(F.pmod(F.xxhash64(F.col("doc_id"), F.spark_partition_id()), F.lit(8))).count().collect()}
    assert keyed.where("kept").count() == 2001 and max(parts) < 700


def test_exact_dedup_shuffles_texts_once(spark):
    plan = exact_dedup.exact_dedup(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") >= 1 and "Python" not in plan


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, lw = total - sum(most * sizes[s] for s in full), sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / lw for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_targets_match_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50, "d": 3, None: 400}, {"a": 0, "b": 7}, {"x": 5}, {f"s{i:02}": (i * 37) % 101 for i in range(40)}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


def test_mix_of_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = entry.op6_mix_sources(spark, SMALL).toPandas()
    again = entry.op6_mix_sources(spark, SMALL).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == sizes
    per = defaultdict(int)
    for i, n in sizes.items():
        per[source[i]] += n
    want = brute_targets(per)
    got["source"] = got.doc_id.map(source)
    assert all(abs(t - want[s]) < 1e-6 for s, t in zip(got.source, got.target, strict=True))
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for s, part in got.groupby("source"):
        assert abs(part.taken.sum() - want[s]) <= 2 * part["size"].max(), s


def test_copies_keep_sums_and_expectations(spark):
    units = spark.range(3000).select(F.col("id").cast("string").alias("unit"), F.xxhash64("id").alias("h"), (F.col("id") % 500 + 1).alias("size"), F.lit("s").alias("source_key"), ((F.col("id") % 7) / 5).alias("p"))
    got = mixing.dependent_copies(units, leaf_rows=8).join(units, "unit").toPandas()
    assert len(got) == 3000 and ((got.copies - got.p).abs() < 1).all()
    assert abs(got.copies.sum() - got.p.sum()) <= 1
    assert abs((got.copies * got["size"]).sum() - (got.p * got["size"]).sum()) < 2000


def test_pivot_is_fair():
    for f1, f2 in ((0.3, 0.4), (0.7, 0.8), (0.5, 0.5), (0.9, 0.2)):
        n = 20000
        out = [mixing.pivot(f1, f2, (i + 0.5) / n) for i in range(n)]
        assert all(abs(a + b - f1 - f2) < 1e-9 and (min(a, b) < 1e-9 or max(a, b) > 1 - 1e-9) for a, b in out)
        assert abs(sum(a for a, _ in out) / n - f1) < 1e-3 and abs(sum(b for _, b in out) / n - f2) < 1e-3


def test_mix_handles_odd_rows(spark):
    df = table(spark, [None, "", "a b c", "a b c", prose(2, 5000), "  ", "x"] * 3, "unit copies size h source_key")
    assert mixing.mix_sources(df).count() == 21
    assert mixing.mix_sources(df.limit(0)).count() == 0
    twice = df.union(df)
    assert mixing.mix_sources(twice).count() == 42
    mixed = mixing.mixed_documents(twice)
    assert mixed.columns == df.columns and mixed.count() > 0


def test_mix_of_equal_rows_meets_the_target(spark):
    rows = [(None, "ten words " * 5, "a")] * 300 + [(7, "ten words " * 50, "b")] * 500 + [(i, "w " * (i + 1), ("a", "b", "c")[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 2 * max(r.size for r in own), source
        p = own[0].target / own[0].source_size
        assert all(r.copies in (math.floor(p), math.floor(p) + 1) for r in own)
    hot = [r.copies for r in got if r.size == 100 and r.doc_id == 7]
    assert len(set(hot)) == 2 and len(hot) == 500
    taken = mixing.mixed_documents(docs).groupBy("doc_id", "source").count().collect()
    want = {}
    for r in got:
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    assert {(r.doc_id, r.source): r["count"] for r in taken} == {k: n for k, n in want.items() if n}
