"""Repeated strings by merging Burrows-Wheeler transforms of shards.

Each shard's suffixes are sorted once. Two transforms are merged by refining
their interleave: at first all suffixes of one stand before those of the other;
a stable sort by the symbols before them brings the order of h symbols to that
of h + 1. A position that parts from the one before it at h has a common prefix
of h - 1 symbols with it; what hasn't parted after ``length`` rounds are the
intervals of repeated strings. No suffix is sorted again. Rounds end when
neither the interleave nor the partition changes.

Every round passes over all suffixes of both shards, and the last merge holds
all of them in one task: this is the measured attempt that README tells of, for
small corpora and as a second opinion in tests. ``repeats`` is what the query
uses.

Null texts are empty; ids must be distinct. Matches never cross texts, as each
text ends in a mark of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Transform:
    """In the order of the suffixes: the symbol before each (0 where its text begins, bytes count from 1), its text and its place. The first ``marks`` are ends of texts."""

    symbol: np.ndarray
    text: np.ndarray
    place: np.ndarray
    marks: int

    @classmethod
    def of(cls, ids: list[int], bodies: list[bytes]) -> Transform:
        size = np.array([len(b) + 1 for b in bodies])
        n, end = int(size.sum()), np.cumsum(size) - 1
        code = np.zeros(n, np.int64)
        code[np.setdiff1d(np.arange(n), end)] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + len(bodies)
        code[end] = np.arange(len(bodies))
        rank, step = np.unique(code, return_inverse=True)[1], 1
        while True:  # prefix doubling: every mark is distinct, so ranks become so
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            order = np.lexsort((after, rank))
            new = (np.diff(rank[order], prepend=-1) != 0) | (np.diff(after[order], prepend=-1) != 0)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                break
            step *= 2
        owner = np.repeat(np.arange(len(bodies)), size)
        place = np.arange(n) - np.repeat(end + 1 - size, size)
        before = np.where(place > 0, code[np.maximum(np.arange(n) - 1, 0)] - len(bodies) + 1, 0)
        return cls(before[order].astype(np.int16), np.array(ids, np.int64)[owner[order]], place[order], len(bodies))


def merged(a: Transform, b: Transform, length: int) -> tuple[Transform, np.ndarray]:
    """The transform of both, in the order of their first ``length`` symbols, and where the blocks that agree on these begin."""
    marks = np.repeat(np.array([0, 1], np.int8), [a.marks, b.marks])
    z = np.repeat(np.array([0, 1], np.int8), [len(a.symbol), len(b.symbol)])
    begins = np.zeros(len(z), bool)
    begins[:1] = True
    for _ in range(length):
        symbol = np.empty(len(z), np.int16)
        symbol[z == 0], symbol[z == 1] = a.symbol, b.symbol
        order = np.argsort(symbol, kind="stable")[len(marks) :]  # the first texts' heads lead to the marks, whose order is fixed
        block = np.cumsum(begins)
        new = np.ones(len(z), bool)
        new[len(marks) + 1 :] = (np.diff(symbol[order]) != 0) | (np.diff(block[order]) != 0)
        after = np.concatenate([marks, z[order]])
        same = np.array_equal(after, z) and np.array_equal(new, begins)
        z, begins = after, new
        if same:
            break
    both = [np.empty(len(z), x.dtype) for x in (a.symbol, a.text, a.place)]
    for out, x, y in zip(both, (a.symbol, a.text, a.place), (b.symbol, b.text, b.place), strict=True):
        out[z == 0], out[z == 1] = x, y
    return Transform(*both, a.marks + b.marks), begins


def repeated_places(docs: DataFrame, length: int, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, place): where the strings of ``length`` bytes begin that stand twice."""
    state = "shard long, symbol binary, text binary, place binary, marks long"

    def packed(shard: int, t: Transform) -> pd.DataFrame:
        return pd.DataFrame([(shard, t.symbol.tobytes(), t.text.tobytes(), t.place.tobytes(), t.marks)], columns=["shard", "symbol", "text", "place", "marks"])

    def unpacked(row) -> Transform:
        return Transform(np.frombuffer(row.symbol, np.int16), np.frombuffer(row.text, np.int64), np.frombuffer(row.place, np.int64), int(row.marks))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return packed(int(pdf["shard"].iloc[0]), Transform.of(pdf["id"].tolist(), pdf["t"].tolist()))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [unpacked(r) for r in pdf.sort_values("shard").itertuples()]
        return packed(int(pdf["shard"].iloc[0]) // 2, rows[0] if len(rows) == 1 else merged(*rows, length)[0])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                t = unpacked(r)
                t, begins = merged(t, Transform(t.symbol[:0], t.text[:0], t.place[:0], 0), length)
                size = np.diff(np.append(np.flatnonzero(begins), len(begins)))
                twice = np.repeat(size > 1, size)
                yield pd.DataFrame({"doc_id": t.text[twice], "place": t.place[twice]})

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    now = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInPandas(build, state)
    while shards > 1:
        shards = -(-shards // 2)
        now = now.groupBy(F.floor(F.col("shard") / 2).alias("pair")).applyInPandas(join, state)
    return now.mapInPandas(last, "doc_id long, place long")
