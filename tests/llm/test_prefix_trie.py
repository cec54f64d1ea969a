import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelweave.llm import entry, prefix_trie

from .helpers import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(int)
    for s in members:
        if s:
            children[s[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), children.get(s, 0), leaves[s], saved[s], digest(s)) for s in list(members))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(df):
    got = prefix_trie.prefix_trie(df)
    assert got.columns == COLUMNS
    rows = sorted(map(tuple, got.collect()))
    assert rows == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    return rows


def test_small_table(spark):
    check(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    assert entry.op11_prefix_trie(spark, SMALL).columns == COLUMNS


def test_few_different_turns(spark):
    """Many conversations share prefixes and part inside blocks; a third are copies; one holds a third of all turns."""
    r = random.Random(2)
    rows = []
    for c in list(range(120)) + [-7, -5, 1000, 1003]:
        turns = "abababababab" if c % 3 == 0 else "".join(r.choice("ab") for _ in range(r.randint(1, 14)))
        rows += [(c, i, "user" if i % 2 else "assistant", t * (i + 1)) for i, t in enumerate(turns)]
    rows += [(50, 100 + i, "user", "ab"[i % 2]) for i in range(500)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "", "user"), (1, 0, "", "user"), (2, 5, "user", "é𝄞" * 9), (2, None, "b", "late"), (2, None, "a", "x"), (None, 0, "user", "nobody"), (5, 0, "u", "a" * 100_000), (6, 0, "u", "a" * 100_000), (8, 1, "u", None), (9, 1, "u", None)]
    rows += [(15 + i, 0, "u", "same") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "at", "n", "depth", "px", "turns"):
        df = df.withColumn(name, F.lit("x"))
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    found = check(df)
    assert any(r[1] == 0 and r[2] is None for r in found)
    check(df.union(df))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(df.where("conv_id IS NULL")).count() == 0


def test_running_values_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    df = spark.range(200).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"), "id")
    got = prefix_trie.running(df, "k", "i", {"s": "id"}, F.sum, lambda a, b: a + b).collect()
    assert all(r.s == sum(range(r.k, r.id, 2)) for r in got) and len(got) == 200


def test_digests_stream_over_chunks_and_batches(monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(1, 5, 6, c) for c in range(10)] + [(1, 5, 7, 10)] + [(2, 0, 0, c) for c in range(4)]
    names = ["depth", "px", "py", "c"]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a : a + 4]]) for i in range(4)], names) for a in range(0, len(rows), 4)]
    got = [tuple(x.values()) for b in prefix_trie._digests(prefix_trie._chunks(iter(batches))) for x in b.to_pylist()]
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == [(1, 5, 6, digest(range(10))), (1, 5, 7, digest([10])), (2, 0, 0, digest(range(4)))]


def test_a_chain_is_not_taken_apart(spark):
    """Only blocks with siblings are grouped by their turns."""
    rows = [(c, i, "u", f"{c}-{i}") for c in (0, 5) for i in range(40)]
    cut = prefix_trie.blocks(prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)))[0])
    behind = cut.groupBy("b", "bx", "by").count()
    assert behind.where("count > 1").count() == 1 and behind.where("count = 1").count() == 18


def test_hot_parents_are_broadcast(spark):
    found = spark.range(3000).select(F.lit(1).cast("long").alias("depth"), "id", F.col("id").alias("px"), F.col("id").alias("py"), F.lit(0).cast("long").alias("qx"), F.lit(0).cast("long").alias("qy"), F.col("id").alias("conv_id"))
    root = found.limit(1).select(F.lit(0).cast("long").alias("depth"), "id", *[F.lit(0).cast("long").alias(c) for c in ("px", "py", "qx", "qy")], F.lit(-1).cast("long").alias("conv_id"))
    children = root.select("depth", "px", "py", F.lit(3000).alias("n_children"))
    got = prefix_trie.with_parents(found.unionByName(root), children, 3001)
    assert got.where("depth = 1 AND parent_conv_id = -1").count() == 3000 and got.where("depth = 0 AND parent_conv_id IS NULL").count() == 1
