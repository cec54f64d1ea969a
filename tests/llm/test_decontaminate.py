import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import decontaminate, entry

from .helpers import SMALL, prose, table

B = "item_id long, text string"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add("" if i is None else str(i))
    out = []
    for doc, t in texts:
        w, hit, met = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if found := windows.get(tuple(w[s : s + m])):
                    hit |= set(range(s, s + m))
                    met |= found
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def check(docs, benchmark, few):
    got = decontaminate.decontaminate(docs, benchmark, few=few)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(rows, key=repr) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    return rows


@pytest.mark.parametrize("few", [decontaminate.FEW, 0])
def test_odd_rows(spark, few):
    a, b = prose(1, 30), prose(2, 10)
    w = a.split()
    texts = [None, "", "...", a, a.upper(), " ".join(w[3:12]), " ".join(w[3:13]), "x " + " ".join(w[:11]) + " y " + " ".join(w[5:20]), b + " " + b, "one TWO", "two one two", "Été\u00a0é, ÉTÉ", "z " * 3000 + b, "r " * 40, prose(3, 20000) + " " + a, a, None]
    items = [(1, a), (2, b), (10, " ".join(w[:15])), (None, b), (3, "One two"), (4, "two"), (5, None), (6, ""), (7, "r " * 12), (1, prose(9, 12)), (2, b), (8, "été\u00a0é")]
    df, bench = table(spark, texts, "words window set_id hits k_id print").drop("n_chars"), spark.createDataFrame(items, B)
    rows = check(df, bench, few)
    assert sum(r[5] for r in rows) == 11
    check(df.union(df).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))), bench, few)
    check(df, bench.limit(0), few)
    check(df, bench.where("text = ''"), few)
    assert decontaminate.decontaminate(df.limit(0), bench, few=few).count() == 0


@pytest.mark.parametrize("few", [decontaminate.FEW, 0])
def test_every_shared_window_is_found(spark, few):
    """Few different words, so fingerprints repeat and tie."""
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(150)]
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(1, 25)))) for i in range(12)]
    rows = check(table(spark, texts), spark.createDataFrame(items, B), few)
    assert 0 < sum(r[5] for r in rows) < 150


def test_a_third_of_all_rows_alike(spark):
    hot = prose(4, 40)
    texts = [hot if i % 3 == 0 else prose(i + 10, 20) for i in range(300)]
    items = [(i, hot + " " + prose(i, 3)) for i in range(50)]
    df = table(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    rows = check(df, spark.createDataFrame(items, B), decontaminate.FEW)
    assert {r[3] for r in rows if r[0] is None} == {50}


def test_texts_are_split_once_for_the_windows_and_no_python_runs(spark):
    plan = entry.op12_decontaminate(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    # One scan counts the words of all documents, the other splits them; no filter splits once more.
    assert plan.count("split(") <= 4
