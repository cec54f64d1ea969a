import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pixelweave.llm import entry, spelling

from .helpers import SMALL, table


def brute_counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(n):
    letters, near, out = sorted(set("".join(n))), {}, []
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = {e for e in edits if e in n and e != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(out)


def check(df, **options):
    want = brute(brute_counts([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]))
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(df, **options).collect())
    assert got == want
    return want


def test_whole_table(spark):
    rows = check(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert any(r[1] and r[2] != r[1] for r in rows)
    assert entry.op13_spelling_groups(spark, SMALL).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_odd_rows(spark, monkeypatch):
    r = random.Random(3)
    long_ = "".join(r.choice("abc\u00e9") for _ in range(3000))
    stem = ["colour", "color", "colours", "col\u00f6ur", "COLOUR", "aaaaa", "aaaaaa", "aaaab", "\u00c9t\u00e9 \u00c9t\u00e9s", "\u0100abcde\u0101", "\u4e2dcolour\u4e2d", "\U0001d11ecolor", "x" * 70, "x" * 69, "x" * 69 + "y", long_, long_[:-1]]
    texts = [None, "", "1234 ---"] + [" ".join(r.choice(stem) for _ in range(60)) for _ in range(40)] + ["word" * 2 + " " + "colour " * 5000] * 6
    df = table(spark, texts, "word n form root near b segment")
    rows = check(df)
    assert {len(x[0]) for x in rows} >= {69, 70, 2999, 3000}
    check(df.union(df).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))), most_bytes=64)
    monkeypatch.setattr(spelling, "_TEXT_SLICE", 50)
    monkeypatch.setattr(spelling, "_FLUSH", 3)
    monkeypatch.setattr(spelling, "_EDIT_SLICE", 7)
    pairs = [(x.doc_id, x.text) for x in df.collect()]
    tables = [{"id": None if i is None else str(i).encode(), "b": None if t is None else t.encode()} for i, t in pairs]
    import pyarrow as pa

    found = Counter()
    for batch in spelling._counted(iter([pa.RecordBatch.from_pylist(tables, schema=pa.schema([("id", pa.binary()), ("b", pa.binary())]))])):
        for row in batch.to_pylist():
            found[row["word"]] += row["n"]
    assert {w: n for w, n in found.items() if n >= 3} == brute_counts(pairs)
    assert spelling.spelling_groups(df.limit(0)).count() == 0
    assert spelling.spelling_groups(table(spark, ["once upon a midnight"])).count() == 0


def test_chains_and_ties(spark):
    words = ["abcde"] * 3 + ["abcdf"] * 6 + ["abcdg"] * 6 + ["abcgg"] * 12 + ["abggg"] * 24 + ["agggg"] * 48 + ["ggggg"] * 96 + ["gggggg"] * 200
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    rows = {r[0]: r for r in check(docs)}
    assert rows["abcde"][1] == "abcdf" and rows["agggg"][2] == "gggggg" and rows["abcdg"][2] == "gggggg"


def test_a_third_of_all_rows_alike(spark):
    check(table(spark, ["hotword coldword" if i % 3 == 0 else f"coldwort hotwords {i}" for i in range(600)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))))


def test_filters_hold_all_words_and_few_others():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    words, others = [word() for _ in range(20000)], [word() for _ in range(20000)]
    filters = spelling.Filters({8: len(words)}, 1)
    table = np.zeros(-(-filters.total // spelling.SEGMENT) * spelling.SEGMENT * spelling.BLOCK, bool)
    w = spelling.Letters(words)
    key = spelling._keys(w.hash, w.length)
    for j in range(spelling.PROBES):
        table[filters.place(key, w.length)[0] * spelling.BLOCK + spelling._bits(key, j)] = True
    bits = np.packbits(table, bitorder="little").view(np.uint64)
    assert len(spelling._known(filters, bits, 0, w.hash, w.length)) == len(words)
    o = spelling.Letters(others)
    assert len(spelling._known(filters, bits, 0, o.hash, o.length)) < 0.02 * len(others)
