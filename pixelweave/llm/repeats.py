"""Removal of byte strings that occur twice.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
(same text included) is removed; strings are judged on the input.

Method. The named method merges shard Burrows-Wheeler transforms, whose
interleave needs one pass over all suffixes for each of ``LENGTH`` symbols. Here
the interleave of sampled suffixes is refined instead, by longer common strings
in four rounds:

* each ``LENGTH``-byte window is represented by one anchor in it, the leftmost
  least hash of a ``GRAM``-byte string (equal windows have equal anchors at equal
  offsets), so about one suffix in ``SPAN / 2`` bytes is kept;
* an interval holds the anchors that agree on the string that all windows of an
  offset range share. An interval of one is dropped: nothing in it repeats.
  Members that also agree on the string that covers all their windows are
  settled: all of these repeat. The rest, and one witness of each settled
  class beside them, are split into ``FAN`` narrower offset
  ranges, whose common strings are longer, until a range is one window.

The same is done over words for passages of ``WORDS.length`` words, which may be
shorter than that many bytes: ``n_passage_words`` counts the words of a text in
runs of so many words that also stand elsewhere. It changes nothing above.

Only the edges of repeated passages reach the later rounds. Counts are made by
partial aggregation, so a passage in a third of all texts is a few summed rows
a task. Strings are compared by 64-bit hashes of their own (and of the anchor).

Null text is empty. Rows equal in id and text are told apart as occurrences and
get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_few, remove, store, stored
from .wordhash import mix, words


@dataclass(frozen=True)
class Scale:
    """Length of the repeated strings, of the strings that anchor them, and the fan of the rounds: ``span`` is a power of it."""

    length: int
    gram: int
    fan: int
    of_words: bool

    @property
    def span(self) -> int:
        """Offsets of an anchor in its window."""
        return self.length - self.gram + 1

    def values(self, text: pa.Scalar) -> np.ndarray:
        """A hash for each byte or each word of a text."""
        if self.of_words:
            return words([text.as_py()]).hash
        return _BYTE[np.frombuffer(text.as_buffer(), np.uint8)]


BYTES, WORDS = Scale(400, 58, 7, False), Scale(50, 26, 5, True)
LENGTH = BYTES.length
_BASE = np.uint64(0x9FB21C651E98DF25)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Hashed:
    """Hashes of any substring of a text, from running sums over the values of its bytes or words."""

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(_powers[0]) < n:
            for i, b in enumerate((_BASE, _UNBASE)):
                p = np.full(max(n, 1 << 18), b)
                p[0] = 1
                _powers[i] = np.multiply.accumulate(p)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * _powers[0][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers[1][start] ^ (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours: running minima from both ends of blocks of ``w``."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[w - 1 : w - 1 + n])


def anchors(values: np.ndarray, scale: Scale) -> tuple[np.ndarray, ...]:
    """(place, least offset, greatest offset, gram hash, hull hash) of the anchors of a text; its windows are split among them."""
    h = Hashed(values)
    at = np.arange(len(values) - scale.gram + 1)
    gram = h.of(at, at + scale.gram)
    # Hash above, place below: the minimum is the leftmost least, and says where it is.
    first = sliding_min((gram >> np.uint64(30) << np.uint64(30)) | at.astype(np.uint64), scale.span)
    place = (first & np.uint64((1 << 30) - 1)).astype(np.int64)
    change = np.flatnonzero(np.diff(place, prepend=-1))
    p, low, high = place[change], change, np.append(change[1:], len(place)) - 1
    return p, p - high, p - low, gram[p], h.of(low, high + scale.length)


def _first_round(scale: Scale):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            size = 0
            for k1, k2, t in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                values = scale.values(t)
                if len(values) < scale.length:
                    continue
                found = anchors(values, scale)
                for into, x in zip(out, (np.full(len(found[0]), k1), np.full(len(found[0]), k2), *found), strict=True):
                    into.append(x)
                size += len(found[0])
                if size > 200_000:
                    yield _rows(out)
                    out, size = [[] for _ in range(7)], 0
            if size:
                yield _rows(out)

    return run


def _rows(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint64, np.uint64)
    columns = [np.concatenate(x).astype(k) for x, k in zip(out, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], ["k1", "k2", "p", "low", "high", "gram", "hull"])


NODE = "k1 long, k2 long, p int, a0 int, low int, high int, gram long, core long, hull long"


def _next_round(width: int, scale: Scale):
    """Nodes of ``width`` offsets below the open ones (k1, k2, text, open: array of structs p, low, high, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for k1, k2, t, nodes in zip(*batch.columns, strict=True):
                h = Hashed(scale.values(t))
                n = nodes.values
                p, low, high, gram = (n.field(f).to_numpy().astype(np.int64) for f in ("p", "low", "high", "gram"))
                steps = high // width - low // width + 1
                of = np.repeat(np.arange(len(p)), steps)
                a0 = (low[of] // width + np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)) * width
                p, gram, lo, hi = p[of], gram[of], np.maximum(low[of], a0), np.minimum(high[of], a0 + width - 1)
                core = h.of(p - a0, p - (a0 + width - 1) + scale.length)
                hull = h.of(p - hi, p - lo + scale.length)
                for into, x in zip(columns, (np.full(len(p), k1.as_py()), np.full(len(p), k2.as_py()), p.astype(np.int32), a0.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), gram, core.view(np.int64), hull.view(np.int64)), strict=True):
                    into.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], [x.split()[0] for x in NODE.split(", ")])

    return run


def settle(nodes: DataFrame) -> DataFrame:
    """Nodes of shared intervals with ``settled``: whether another node agrees on all of its windows, and ``open``.

    Open nodes go to the next round: those not settled, and of settled ones
    that agree among themselves one witness, where others share their interval.
    """
    exact = nodes.groupBy("gram", "a0", "core", "low", "high", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "p")).alias("witness"))
    shared = exact.groupBy("gram", "a0", "core").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    kept = exact.join(shared, ["gram", "a0", "core"]).select("gram", "a0", "core", "low", "high", "hull", "witness", "kinds", (F.col("n") > 1).alias("settled"))
    speaks = (F.col("kinds") > 1) & (F.struct("k1", "k2", "p") == F.col("witness"))
    return nodes.join(kept, ["gram", "a0", "core", "low", "high", "hull"]).withColumn("open", ~F.col("settled") | speaks).drop("witness", "kinds")


def shared_anchors(long: DataFrame, scale: Scale) -> DataFrame:
    """The first round over texts (k1, k2, t): settled and open nodes of the anchors that stand twice."""
    found = long.select("k1", "k2", "t").mapInArrow(_first_round(scale), "k1 long, k2 long, p int, low int, high int, gram long, hull long")
    path = store(found, "anchors")
    rows = long.sparkSession.read.schema(found.schema).parquet(path)
    twice = rows.groupBy("gram").count().where("count > 1").select("gram")
    nodes = rows.join(if_few(stored(twice, "grams")), "gram", "left_semi").withColumn("a0", F.lit(0)).withColumn("core", F.col("gram"))
    now = stored(settle(nodes), "settled")
    remove(long.sparkSession, path)
    return now


def repeated_spans(now: DataFrame, texts: DataFrame, scale: Scale) -> DataFrame:
    """(k1, k2, spans) of the texts with repeats, from their first round: places of all repeated strings, as structs start, end, in bytes or words."""
    done = now.where("settled").select("k1", "k2", "p", "low", "high")
    width = scale.span
    while width > 1:
        width //= scale.fan
        # Copies of a row give the same nodes; the set keeps one list for both, and each row below makes its own nodes.
        still = now.where("open").groupBy("k1", "k2").agg(F.collect_set(F.struct("p", "low", "high", "gram")).alias("open"))
        below = texts.join(still, ["k1", "k2"]).select("k1", "k2", "t", "open").mapInArrow(_next_round(width, scale), NODE)
        path = store(below, "nodes")
        now = stored(settle(texts.sparkSession.read.schema(below.schema).parquet(path)), "settled")
        remove(texts.sparkSession, path)
        done = done.unionByName(now.where("settled").select("k1", "k2", "p", "low", "high"))
    return done.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("p") - F.col("high")).alias("start"), (F.col("p") - F.col("low") + scale.length).alias("end"))).alias("spans"))


def covered(spans: pa.Scalar, size: int) -> np.ndarray:
    """Which of ``size`` places stand in any of the spans."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, spans.values.field("start").to_numpy(), 1)
    np.add.at(edge, spans.values.field("end").to_numpy(), -1)
    return np.cumsum(edge)[:-1] > 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(covered(s, s.values.field("end").to_numpy().max()).sum()) for s in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["k1", "k2", "n_passage_words"])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words: one row per row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.xxhash64(F.col(doc_id), body).alias("k1"), F.xxhash64(body, F.lit(1), F.col(doc_id)).alias("k2"), F.col(doc_id).alias("doc_id"), body.cast("binary").alias("t"))
    by_bytes = shared_anchors(keyed.where(F.length("t") >= BYTES.length), BYTES)
    by_words = shared_anchors(keyed.where(F.length("t") >= 2 * WORDS.length - 1), WORDS)  # a word and a space each
    touched = stored(by_bytes.select("k1", "k2").union(by_words.select("k1", "k2")).distinct(), "ids")
    texts = stored(keyed.join(if_few(touched), ["k1", "k2"], "left_semi").select("k1", "k2", "t"), "touched")
    spans = repeated_spans(by_bytes, texts, BYTES)
    passages = repeated_spans(by_words, texts, WORDS).mapInArrow(_count, "k1 long, k2 long, n_passage_words long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(2), batch.column(3), strict=True):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                gone = covered(s, len(data))
                out.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            removed, runs, digests = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["k1", "k2", "n_removed", "n_spans", "kept"])

    cuts = texts.join(spans, ["k1", "k2"]).select("k1", "k2", "t", "spans").mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, kept string").dropDuplicates(["k1", "k2"])
    found = stored(cuts.join(passages, ["k1", "k2"], "full_outer"), "cuts")
    whole = keyed.select("doc_id", "k1", "k2", F.length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("all"))
    joined = whole.join(if_few(found), ["k1", "k2"], "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_bytes", number("n_removed"), number("n_spans"), F.coalesce("kept", "all").alias("kept_sha256"), number("n_passage_words"))
