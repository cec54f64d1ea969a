import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import entry, licences, near_dedup, pieces, quality, repeats, wordhash

from .helpers import SMALL, prose, table

ODD = [None, "", "   ", "a", "a b c", "x" * 100_000, "la " * 3000, prose(1, 4000), prose(1, 4000), "é𝄞\n\t ▁▁ " + "ü" * 500, prose(2, 60), prose(2, 59) + " zzz"]


# --- words and BagMinHash ----------------------------------------------------


def test_words_match_split():
    texts = [(t or "").encode() for t in ODD]
    w = wordhash.words(texts)
    split = [t.split() for t in texts]
    assert w.counts.tolist() == [len(s) for s in split]
    seen = {}
    for word, h in zip((x for s in split for x in s), w.hash.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def shingle_counts(t):
    w = (t or "").encode().split()
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def test_signatures_estimate_weighted_jaccard():
    base = [prose(i, 1) for i in range(500)]
    for other in (base[50:], base + base[:200], base[:300] * 2):
        a, b = " ".join(base), " ".join(other)
        owner, h = wordhash.shingles(wordhash.words([a.encode(), b.encode()]))
        text, distinct, weight, _ = near_dedup.weights_of(owner, h)
        s = near_dedup.signatures(2, text, distinct, weight, 1024)
        want = similarity(shingle_counts(a), shingle_counts(b))
        assert abs((s[0] == s[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 1024) + 0.01


def brute_classes(rows):
    """Classes of (key, text) rows: equal texts, or similarity 0.8 or more, transitively."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    texts = sorted({t or "" for _, t in rows})
    counts = {t: shingle_counts(t) for t in texts}
    for i, a in enumerate(texts):
        find(a)
        for b in texts[:i]:
            if counts[a] and counts[b] and similarity(counts[a], counts[b]) >= 0.8:
                parent[find(a)] = find(b)
    out = collections.defaultdict(list)
    for k, t in rows:
        out[find(t or "")].append(k)
    return sorted(sorted(v, key=str) for v in out.values())


def test_near_duplicates_match_brute_force(spark):
    real = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    chain = [" ".join(prose(9, 200).split()[i * 8 : i * 8 + 100]) for i in range(10)]
    odd = table(spark, ODD + chain).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = real.union(odd)
    got = near_dedup.near_duplicates(docs).collect()
    classes = collections.defaultdict(list)
    for r in got:
        classes[r.class_id].append(r.doc_id)
        assert r.class_id <= r.doc_id and r.kept == (r.class_id == r.doc_id)
    assert all(r.class_size == len(classes[r.class_id]) for r in got)
    assert sorted(sorted(v, key=str) for v in classes.values()) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    stay = near_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(classes)


def test_near_duplicates_of_repeated_and_empty_tables(spark):
    df = table(spark, [prose(5, 50), "a b", None], "text_id bands label key")
    twice = df.union(df)
    assert near_dedup.near_duplicates(twice).count() == 6 and near_dedup.deduplicated(twice).count() == 3
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert near_dedup.near_duplicates(nulls).where("kept").count() == 3


def test_blocks_of_open_buckets_lose_no_link(spark, monkeypatch):
    # Two hub rounds less and blocks of few texts: most links come from pairs of blocks.
    base = prose(31, 120).split()
    texts = [" ".join(base[: 60 + 3 * i]) for i in range(20)] + [" ".join(base[i:]) for i in range(20)] + [" ".join([*base[:i], "new", *base[i:]]) for i in range(0, 120, 5)]
    texts += [" ".join(prose(32, 400).split()[i * 9 : i * 9 + 100]) for i in range(12)] + [" ".join(prose(33, 400).split()[i * 30 : i * 30 + 100]) for i in range(8)]
    docs = table(spark, texts)
    monkeypatch.setattr(near_dedup, "STARS", 1)
    want = brute_classes(list(enumerate(texts)))
    for most in (1, 3, 1000):
        monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", most)
        classes = collections.defaultdict(list)
        for r in near_dedup.near_duplicates(docs).collect():
            classes[r.class_id].append(r.doc_id)
        assert sorted(sorted(v, key=str) for v in classes.values()) == want


# --- repeated byte strings ---------------------------------------------------


def brute_removed(texts):
    bodies = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + 400] for b in bodies for i in range(len(b) - 399))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if n[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(spark):
    p, q = prose(11, 90), prose(12, 200)
    texts = ODD[:5] + [prose(20, 30) + p + prose(21, 30), p, "é" + p[3:] + prose(22, 9), q + p[:420], prose(23, 40) + q[100:900], q[99:600], "ab" * 700, "ab" * 300 + "c", prose(24, 300), prose(24, 300)]
    texts += [prose(i, 10) + p[i : 400 + 2 * i] + prose(i + 50, 10) for i in range(30, 45)]
    df = table(spark, texts, "k1 k2 p low high gram hull open spans")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)
    twice = repeats.remove_repeats(df.union(df)).collect()
    assert len(twice) == 2 * len(texts) and all(r.n_removed == (r.n_bytes if r.n_bytes >= 400 else 0) for r in twice)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def brute_passages(texts):
    """Words of each text in runs of 50 words that stand twice."""
    split = [(t or "").encode().split() for t in texts]
    n = collections.Counter(tuple(w[i : i + 50]) for w in split for i in range(len(w) - 49))
    return [len({j for i in range(len(w) - 49) if n[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)}) for w in split]


def test_passages_match_brute_force(spark):
    p, q = prose(51, 60).split(), prose(52, 300).split()
    texts = [None, "", "a b", " ".join(p), prose(53, 30) + " " + " ".join(p) + "\n" + prose(54, 40), " ".join(p[:49]), " ".join(q[10:59]) + " end", "\t".join(q), " ".join(q[200:260]) + " " + " ".join(p[5:]), "la " * 120, prose(55, 80)]
    texts += [prose(60 + i, 20) + " " + " ".join(q[i * 7 : i * 7 + 48 + i]) for i in range(12)]
    got = {r.doc_id: r.n_passage_words for r in repeats.remove_repeats(table(spark, texts, "k1 k2 p low high gram hull open spans")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts)
    real = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n_passage_words for r in repeats.remove_repeats(real).collect()}
    rows = real.collect()
    assert [got[r.doc_id] for r in rows] == brute_passages([r.text for r in rows]) and any(got.values())


def test_repeats_of_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.QUERIES["op4_remove_repeats"](spark, SMALL).collect()}
    assert [got[r.doc_id] for r in rows] == brute_removed([r.text for r in rows])


# --- SentencePiece -----------------------------------------------------------


def brute_encode(table_, text):
    """Viterbi over the whole escaped text, no units; runs here are shorter than the cut."""
    if not text:
        return []
    s = (" " + text).replace(" ", "▁")
    known = {p: (i, v) for p, i, v in table_.pieces}
    best = [(0.0, 0, None)] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - table_.longest), e):
            piece = known.get(s[b:e])
            if piece is None and e - b > 1:
                continue
            score = best[b][0] + (piece[1] if piece else table_.unknown)
            if best[e] is None or score > best[e][0] + 1e-9:
                best[e] = (score, b, [piece[0]] if piece else [table_.bytes0 + x for x in s[b:e].encode()])
    out, at = [], len(s)
    while at:
        out = best[at][2] + out
        at = best[at][1]
    return out


def test_encoding_matches_whole_text_viterbi_and_round_trips(spark):
    model = pieces.read_model()
    texts = [None, "", " ", "a", "Hello, world! 123 abc_def", "é𝄞\n\t tab", prose(3, 300), "  two  spaces ", "naïve coöperation 東京 ²."]
    real = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).collect()]
    df = table(spark, texts + real, "t unit ids packed row rare")
    got = {r.doc_id: r for r in pieces.encoded_documents(df).collect()}
    score = {i: v for _, i, v in model.pieces}
    total = lambda ids: sum(score.get(i, 0) for i in ids)
    for i, t in enumerate(texts + real):
        want = brute_encode(model, t)
        # Equal scores may be told apart by rounding over a whole text, but not the score itself.
        assert list(got[i].ids) == want or abs(total(got[i].ids) - total(want)) < 1e-6, (t, list(got[i].ids), want)
        assert got[i].round_trip and got[i].n_pieces == len(got[i].ids)


def test_long_runs_are_encoded_whole(spark):
    import random

    import sentencepiece

    model, r = pieces.read_model(), random.Random(7)
    run = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    texts = [run(chars, n) for chars in ("abcdefghijklmnopqrstuvwxyzABCDEFG", "0123456789", "=-_#*", "的一是不了人我在有他这中大来上国") for n in (47, 49, 65, 130, 5000)]
    texts += ["internationalization" * 9, "a" + " " * 40 + "bcd" + " " * 70, "東京" * 60, " " * 100, "éü𝄞" * 50, "x " + "ab" * 100 + " y"]
    df = table(spark, texts, "t unit ids packed row rare")
    score = {i: v for _, i, v in model.pieces}
    total = lambda ids: sum(score.get(i, 0) for i in ids)
    for hot in (5, pieces.HOT):
        got = {x.doc_id: list(x.ids) for x in pieces.encode(df, hot=hot).collect()}
        for i, t in enumerate(texts):
            want = brute_encode(model, t)
            assert got[i] == want or (len([x for x in got[i] if x not in score]) == len([x for x in want if x not in score]) and abs(total(got[i]) - total(want)) < 1e-5), (hot, t[:60])
    assert all(x.round_trip for x in pieces.encoded_documents(df).collect())
    # Against the library's unigram encoder, given the same scores.
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, piece in enumerate(proto.pieces):
        piece.score = score.get(i, 0.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for i, t in enumerate(texts):
        if "𝄞" not in t:
            ids = library.encode(t)
            assert ids == got[i] or abs(total(ids) - total(got[i])) < 1e-2, t[:60]


def test_rare_units_give_the_same_result(spark):
    df = table(spark, [prose(i, 50) for i in range(20)] + [None, "", "x" * 500, "▁ under"])
    few = {r.doc_id: list(r.ids) for r in pieces.encode(df, hot=5).collect()}
    many = {r.doc_id: list(r.ids) for r in pieces.encode(df).collect()}
    assert few == many and len(few) == 24
    back = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(df)).collect()}
    assert back[22] == "x" * 500 and back[23] == "  under" and back[20] == ""
    assert pieces.encode(df.limit(0)).count() == 0


def test_pieces_are_found_by_numbers_and_told_apart_by_their_strings(spark, monkeypatch):
    table_ = pieces.read_model()
    words = [" internationalization", " naïve", " 東京", " zzq", "123456", "%%%%", " a", "é𝄞", "-"]
    units = spark.createDataFrame([(w, i, 1) for i, w in enumerate(words)], "unit string, h long, n long")
    plan = pieces.encode_units(units, table_)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 1 and joins[0].count("key#") == 2 and " AND " not in joins[0]  # one 64-bit key, no string
    want = {r.unit: list(r.ids) for r in pieces.encode_units(units, table_).collect()}
    known = {p.replace("▁", " "): (i, v) for p, i, v in table_.pieces}
    assert want == {w: pieces.best_ids(w, known, table_.longest, table_.unknown, table_.bytes0).tolist() for w in words}
    # Hundreds of pieces to a key.
    monkeypatch.setattr(pieces, "piece_key", lambda piece: pieces.F.xxhash64(piece) % 50)
    assert {r.unit: list(r.ids) for r in pieces.encode_units(units, table_).collect()} == want


def test_pieces_need_no_python_workers(spark):
    units = spark.range(1).selectExpr("' naïve' AS unit", "0L AS h", "1L AS n")
    plan = pieces.encode_units(units, pieces.read_model())._jdf.queryExecution().optimizedPlan().toString()
    # Rows of Python objects stand in a plan as an RDD, whose workers stay beside those of the texts.
    assert "LogicalRDD" not in plan and "ExternalRDD" not in plan and "LocalRelation" in plan


def test_units_are_counted_whole_however_often_they_are_added_up(spark):
    from collections import Counter

    texts = [prose(i % 7, 60) for i in range(30)] + [None, "", "x" * 65, "y" * 63, "東京 é𝄞 ²."]
    want = Counter(x for t in texts for x in pieces.units_of(t or "") if len(x) <= pieces.LONG)
    df = table(spark, texts)
    for merge, most in ((200_000, 600_000), (10, 50), (0, 0)):
        got = Counter()
        for r in pieces.distinct_units(df, merge=merge, most=most).collect():
            got[r.unit] += r.n
        assert got == want


def test_a_worker_keeps_little_memory():
    # In a process of its own: 131,072 characters, the size of a slice of texts.
    code = """
import numpy as np, pyarrow as pa
from pixelweave.llm import pieces, wordhash
u = pieces.Units.of(["ab cd " * 21845])
print(sum(x.nbytes for x in wordhash._powers))
done = list(pieces.tidy(lambda batches: (b.slice(0, 1) for b in batches))(iter([pa.record_batch({"n": [1, 2]})])))
print(len(done), done[0].num_rows)
"""
    import subprocess
    import sys
    from pathlib import Path

    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, cwd=Path(__file__).parents[2])
    kept, same = run.stdout.splitlines()
    assert int(kept) <= 8 << 20 and same == "1 1"  # 32 MB before


def test_packed_ids_take_two_bytes_where_that_is_enough():
    r = np.random.default_rng(3)
    for ids in (r.integers(0, 32000, 1000), r.integers(-500, 65000, 1000), np.array([0, 0xFFFF]), np.array([-1, 0xFFFF]), np.array([-(1 << 31), (1 << 31) - 1, -1]), np.array([], np.int64)):
        x = pieces.packed(ids.astype(np.int32))
        back = pieces.unpacked(memoryview(x))
        assert back.dtype == np.int32 and back.tolist() == ids.tolist()
        two = len(ids) == 0 or max(ids.max(), 0) - min(ids.min(), 0) <= 0xFFFF
        assert len(x) == 8 + len(ids) * (2 if two else 4)


def test_tables_go_once_they_are_read(spark, monkeypatch, tmp_path):
    from pixelweave.llm import common

    seen = {}

    def store(df, tag, folder=None):
        seen[tag] = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
        return common.store(df, tag, str(tmp_path))

    monkeypatch.setattr(pieces, "store", store)
    df = table(spark, [prose(i, 50) for i in range(9)] + [None, ""])
    got = {r.doc_id: list(r.ids) for r in pieces.encode(df, hot=5).collect()}
    assert len(got) == 11 and got[10] == []
    # What the joins hold on disk at a time: the rare units' ids are joined, then grouped by text.
    assert seen["met"] == ["encoded"] and seen["rare"] == ["met"] and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["rare"]


def test_units_join_to_the_text_and_hold_no_piece_across():
    for t in ["a b", "  x", "abc123,;", "x" * 200, "\n\n a ", prose(4, 100)]:
        assert "".join(pieces.units_of(t)) == " " + t
    pieces.read_model()  # raises if a piece crosses the edge of a unit


def test_units_of_many_texts_are_cut_as_one_by_one():
    texts = [None, *(t.replace("▁", " ") for t in ["", " ", "a b", "  x", "abc123,;²_", "東京 ٣٤ é𝄞\n\t tab ", "x" * 200, "\n\n a ", "\u00a0\u2028 ﬁ"]), prose(4, 300)]
    u = pieces.Units.of(texts)
    cut = [u.body[a : a + n] for a, n in zip(u.start.tolist(), u.size.tolist(), strict=True)]
    assert [(i, x) for i, t in enumerate(texts) for x in pieces.units_of(t or "")] == list(zip(u.text.tolist(), cut, strict=True))
    assert u.strings(np.arange(len(cut))).to_pylist() == cut
    assert len(set(u.hash.tolist())) == len(set(cut))
    some = np.unique(u.hash[::2])
    found = pieces.Dictionary.of(some, pieces.pa.array([[1]] * len(some))).find(u.hash)
    assert [(x >= 0) for x in found] == [x in set(cut[::2]) for x in cut]


# --- quality -----------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    train = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0)
    model = quality.fit(docs, train)
    held = labels.join(train, "doc_id", "left_anti")
    rows = quality.score(docs, model, ["doc_id"]).select("doc.doc_id", "quality").join(held.select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    kept = rows.quality >= 0.5
    assert (kept == (rows.y == 1)).mean() > 0.98 and kept[rows.y == 1].mean() > 0.99 and (~kept)[rows.y == 0].mean() > 0.95


def test_quality_of_odd_rows(spark):
    docs = table(spark, ODD, "quality v_text")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(6)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        model = quality.fit(docs, known)
        assert quality.score(docs, model, docs.columns).count() == len(ODD)
        assert quality.score(docs, model, docs.columns, least=0.5).columns == docs.columns
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels), ["doc_id"]).count() == 0
    nulls = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert quality.score(nulls, quality.fit(nulls, labels), ["doc_id"]).count() == len(ODD)


def test_quality_with_hot_ids(spark):
    good = [(i, f"good words of prose stand here {prose(i, 40)}", "en", "a", 200) for i in range(60)]
    bad = [(100 + i, "!!! $$$ 999 " * 9 + prose(i, 3), "xx", "b", 20) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    copies = spark.range(17_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("!!! $$$ 999 copy "), "id").alias("text"), F.lit("xx").alias("lang"), F.lit("b").alias("source"), F.lit(20).cast("long").alias("n_chars"))
    # One id of 17000 rows, labelled 0 and then not labelled at all.
    for hot in (100, 7_000):
        model = quality.fit(docs.union(copies.withColumn("doc_id", F.lit(hot).cast("long"))), labels)
        assert model.always is None
        got = {r.doc_id: r.quality for r in quality.score(docs, model, ["doc_id"]).select("doc.doc_id", "quality").collect()}
        assert all((got[i] >= 0.5) == (i < 100) for i in got)


def test_pseudo_labels_come_from_all_unlabelled_documents(spark):
    texts = [f"w{i} {prose(i, 5)}" for i in range(6000)] + [None]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    find = quality._surest(docs.withColumn("doc_id", F.when(F.col("doc_id") < 6000, F.col("doc_id"))), labels.select("doc_id"))
    text, meta = (np.concatenate([x, np.ones((1,))]) for x in (np.zeros(quality.TEXT_BUCKETS + 14), np.zeros(quality.META_BUCKETS + 24)))
    # All are equally sure of label 1 in the text's view; none is in the other's.
    told, features = find([text * 9, meta * 0], [(1, 0), (1, 0)], 10_000)
    assert len(told[0]) == 5981 == len({k for k, _ in told[0]}) and not told[1] and {label for _, label in told[0]} == {1}
    assert {k[0] for k, _ in told[0]} == {None, *range(20, 6000)} and len(features) == 5981
    few, _ = find([text * 9, meta * 0], [(1, 0), (1, 0)], 7)
    assert len(few[0]) == 7


# --- licences ----------------------------------------------------------------


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_licences_of_written_notices(spark, licence_model):
    texts = [
        "Intro line.\nReleased under the MIT License.\nmore", "This program is Licensed under the Apache License, Version 2.0. All else is mine.", "this work is licensed under the GNU general public license, version 3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under CC BY-NC 4.0.",
        "My driving license was issued by the public office under the bridge.", None, "", prose(5, 3000), "x" * 50_000, "the general public met under the apache tribe",
    ]
    got = {r.doc_id: r for r in licences.digest(licences.scan_licences(table(spark, texts, "row near line gram"), model=licence_model)).collect()}
    assert [got[i].families for i in range(11)] == ["mit", "apache-2.0", "gpl-3.0", "bsd", "cc-by-nc", "", "", "", "", "", ""]
    assert got[0].paragraphs == "mit:1" and got[0].n_paragraphs == 3
    assert licences.scan_licences(table(spark, texts).limit(0), model=licence_model).count() == 0


def test_licences_of_wrapped_notices(spark, licence_model):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction."
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    apache = "# Licensed under the Apache\n# License, Version 2.0 (the License);\n# you may not use this file except in\n# compliance with the License."
    texts = [mit, f"/*\n * Copyright someone\n *\n{bsd}\n */\nint x;", apache, "\n".join("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()), f"{apache}\n\n{mit}\n", "released under\n\nthe mit license"]
    texts += ["licensed under the\nMIT license", "Released under the MIT License.\nReleased under the BSD License."]
    found = licences.scan_licences(table(spark, texts, "row near line gram"), model=licence_model)
    got = {r.doc_id: r for r in licences.digest(found).collect()}
    assert [got[i].families for i in range(8)] == ["mit", "bsd", "apache-2.0", "mit", "apache-2.0,mit", "", "mit", "bsd,mit"]
    assert got[0].paragraphs == "mit:0" and got[1].paragraphs == "bsd:3" and got[6].paragraphs == "mit:0" and got[7].paragraphs == "mit:0,bsd:1"
    assert all(r.n_predicted >= r.n_confirmed for r in got.values())


def test_licences_anywhere_in_long_lines(spark, licence_model):
    mit, apache, bsd = "released under the MIT license", "licensed under the Apache License, Version 2.0", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    cc = "this work is licensed under a creative commons attribution noncommercial 4.0 international license"
    far = lambda n: " ".join(f"word{i}" for i in range(n))
    texts = [f"see the mit license {far(60)} {apache}", f"{mit} {far(60)} {apache} {far(3000)} released under the BSD license", f"the mit license {far(60)} {bsd}", f"{mit}, or {apache}"]
    # Wherever a span from the first words ends, the rest of a notice isn't taken for another family's.
    texts += [f"released {far(2)} released under {far(n)} {cc} {far(n)} licensed under the GNU lesser general public license" for n in range(28, 50)]
    texts += [f"{mit} {far(60)} " * 400 + apache]
    found = licences.scan_licences(table(spark, texts, "row near line gram at full places"), model=licence_model)
    got = {r.doc_id: r for r in licences.digest(found).collect()}
    assert [got[i].families for i in range(3)] == ["apache-2.0", "apache-2.0,bsd,mit", "bsd"] and "apache-2.0" in got[3].families
    assert got[2].paragraphs == "bsd:0" and {got[i].families for i in range(4, 26)} == {"cc-by-nc,lgpl"}
    assert got[26].paragraphs == "apache-2.0:0,mit:0"


def test_licences_of_whole_table(spark, licence_model):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r.families for r in licences.digest(licences.scan_licences(docs, model=licence_model)).collect()}
    for r in docs.collect():
        named = {f for f, w in (("mit", "the MIT License"), ("apache-2.0", "the Apache License"), ("gpl-3.0", "GNU General Public"), ("cc-by-nc", "CC BY-NC")) if w in r.text}
        assert set(got[r.doc_id].split(",")) - {""} == named


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from pixelweave.llm import mixing
    from pixelweave.llm.common import stored

    assert [n for n, _ in p.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = stored(p.filter_quality(spark, docs, SMALL), "t")
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)
    once = stored(p.drop_copies(spark, good, SMALL), "t")
    texts = collections.defaultdict(list)
    for r in good.collect():
        texts[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(max(v) for v in texts.values())
    near = stored(p.drop_near_copies(spark, once, SMALL), "t")
    assert sorted(r.doc_id for r in near.collect()) == sorted(min(c) for c in brute_classes([(r.doc_id, r.text) for r in once.collect()]))
    mixed = stored(p.mix(spark, near, SMALL), "t")
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    want = {r.doc_id: r.copies for r in mixing.mix_sources(near).collect()}
    assert mixed.columns == docs.columns and all(taken[i] == n for i, n in want.items())
    out = p.encode(spark, mixed, SMALL).collect()
    assert len(out) == sum(taken.values()) and all(r.round_trip for r in out)


# --- merged Burrows-Wheeler transforms ---------------------------------------


def test_merged_transforms_find_repeated_places(spark):
    from pixelweave.llm import bwt

    p = prose(71, 12)
    texts = [None, "", "a", p, prose(72, 5) + p, p[:30] + "x" + p[31:], "ab" * 40, "ab" * 30 + "c", "é" + p[3:40], prose(73, 20), prose(73, 20), p[-9:]]
    for length in (1, 10, 25):
        n = collections.Counter(b[i : i + length] for b in ((t or "").encode() for t in texts) for i in range(len(b) - length + 1))
        want = {(k, i) for k, t in enumerate(texts) for b in [(t or "").encode()] for i in range(len(b) - length + 1) if n[b[i : i + length]] > 1}
        for shards in (1, 5):
            rows = bwt.repeated_places(table(spark, texts), length, shards).collect()
            assert len(rows) == len(want) and {(r.doc_id, r.place) for r in rows} == want
    assert bwt.repeated_places(table(spark, texts).limit(0), 5, 3).count() == 0


def test_merged_transforms_agree_with_the_query_on_long_repeats(spark):
    from pixelweave.llm import bwt

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.substring("text", 1, 3000).alias("text")).where("doc_id % 4 = 0")
    starts = collections.defaultdict(set)
    for r in bwt.repeated_places(docs, 400, 3).collect():
        starts[r.doc_id].add(r.place)
    for r in repeats.remove_repeats(docs).collect():
        gone = {j for i in starts[r.doc_id] for j in range(i, i + 400)}
        assert len(gone) == r.n_removed
