"""Quality classifier by co-training.

Two views see each document: its text (hashed words and shape counts) and its
page metadata (language, source, recorded length). Each view has a logistic
regression, calibrated on held-out labels. Over ``ROUNDS`` rounds each view
labels the unlabelled documents it is sure of for the other one, and both are
fitted anew. A last regression over both calibrated log-odds gives the quality.

Fitting uses at most ``LABELLED`` labelled documents, those with the least hashes
of their ids, one row of each id, at about 1 kB of features each. Pseudo-labels
are chosen among all unlabelled documents: tasks score them and keep the surest,
a distributed top-k keeps the surest of all, and only the features of those
reach the driver. All documents are scored, on whole texts.

Null text, language or source count as empty, null length as 0. Without both
labels in the sample every document gets quality 1 (or 0 if all labels are 0).
A quality of ``least`` itself is kept; equal rows get equal qualities.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import if_few, stored
from .wordhash import SPACE, mix, slices, words

LABELLED = 4000
ROUNDS, PER_ROUND, SURE = 4, 200, 0.95
TEXT_BUCKETS, META_BUCKETS = 256, 256
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 mark, 5 space, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_CLASS[SPACE] = 5
_ONE_HOT = np.eye(7, dtype=np.float32)


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row a text: frequencies of hashed words, shares of character classes, and shape counts."""
    w, n = words(texts), len(texts)
    size = np.maximum(w.counts, 1)
    # Counts by 256 buckets of word, square roots of the frequencies: common words must not drown the rest.
    hashed = np.bincount(w.text * TEXT_BUCKETS + (w.hash % np.uint64(TEXT_BUCKETS)).astype(np.int64), minlength=n * TEXT_BUCKETS).reshape(n, TEXT_BUCKETS)
    out = np.zeros((n, TEXT_BUCKETS + 14), np.float32)
    out[:, :TEXT_BUCKETS] = np.sqrt(hashed / size[:, None])
    owner = np.repeat(np.arange(n), np.diff(w.text_at))
    classes = np.bincount(owner * 7 + _CLASS[w.data], minlength=n * 7).reshape(n, 7)
    classes[:, 5] -= 1  # the space after each text
    shares = classes / np.maximum(classes.sum(axis=1), 1)[:, None]
    out[:, TEXT_BUCKETS : TEXT_BUCKETS + 7] = shares * 4
    _, place = np.unique(w.hash ^ mix(w.text.astype(np.uint64)), return_index=True)
    distinct = np.bincount(w.text[place], minlength=n)[:n]
    repeats = np.zeros(n)
    if len(w.hash) > 1:
        np.add.at(repeats, w.text[1:][(w.text[1:] == w.text[:-1]) & (w.hash[1:] == w.hash[:-1])], 1)
    length = w.end - w.start
    mean = np.bincount(w.text, weights=length, minlength=n)[:n] / size
    last = w.data[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
    marks = np.bincount(w.text, weights=_CLASS[last] == 4, minlength=n)[:n] / size
    first_upper = np.bincount(w.text, weights=_CLASS[w.data[w.start]] == 2, minlength=n)[:n] / size if len(w.start) else np.zeros(n)
    out[:, TEXT_BUCKETS + 7 :] = np.stack([np.log1p(w.counts) / 5, distinct / size * 2, repeats / size * 4, mean / 8, marks * 3, first_upper * 2, (distinct / np.sqrt(size)) / 10], 1)
    return out


@functools.lru_cache(4096)
def _bucket(kind: str, value: str) -> int:
    """The bucket of a whole value."""
    return int.from_bytes(hashlib.blake2b(f"{kind}{value}".encode(), digest_size=8).digest(), "little") % META_BUCKETS


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """One row a document: hashed language and source, and its recorded length by powers of two."""
    out = np.zeros((len(lang), META_BUCKETS + 24), np.float32)
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, [_bucket("l", a or ""), _bucket("s", b or "")]] = 1
        out[i, META_BUCKETS + min(23, max(0, int(c or 0)).bit_length())] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights and intercept of a regularised logistic regression, by gradient steps with momentum of their scale (Adam)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _balance(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn scores into log-odds on held-out labels (Platt), with smoothed targets."""
    pos, neg = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-6, float(np.std(z)))
    w = logistic((z / scale)[:, None], target, np.ones(len(z)), decay=1e-3)
    return float(w[0] / scale), float(w[1])


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    both: np.ndarray
    always: float | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities by text, by metadata, and by both."""
        if self.always is not None:
            p = np.full(len(text), self.always)
            return p, p, p
        a, b = (odds(x, w) * s[0] + s[1] for x, w, s in ((text, self.text, self.text_scale), (meta, self.meta, self.meta_scale)))
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p(a), p(b), p(a * self.both[0] + b * self.both[1] + self.both[2])


#: Of a view's model and calibration, by view, and how many of each label: the surest unlabelled documents, as key and label by view, and by key both views' features.
Surest = Callable[[list[np.ndarray], list[tuple[float, float]], int], tuple[list[list[tuple[tuple, int]]], dict[tuple, tuple[np.ndarray, np.ndarray]]]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Surest, rounds: int = ROUNDS) -> Model:
    if len(y) < 10 or (y == 1).sum() < 2 or (y == 0).sum() < 2:
        zero = np.zeros(1)
        return Model(zero, zero, (1, 0), (1, 0), zero, 0.0 if len(y) and (y == 1).sum() == 0 else 1.0)
    held = np.arange(len(y)) % 4 == 0
    if min((y[held] == c).sum() for c in (0, 1)) == 0 or min((y[~held] == c).sum() for c in (0, 1)) == 0:
        order = np.argsort(y, kind="stable")
        held = np.zeros(len(y), bool)
        held[order[::2]] = True
    views = [text, meta]
    given: list[dict[tuple, tuple[np.ndarray, int]]] = [{}, {}]  # to each view: of a document's key, its features and the label the other view gave it
    for round_ in range(rounds + 1):
        models, scales = [], []
        for x, labels in zip(views, given, strict=True):
            labelled = np.concatenate([y[~held], np.array([label for _, label in labels.values()], float)])
            weight = _balance(labelled) * np.concatenate([np.ones((~held).sum()), np.full(len(labels), 0.5)])
            w = logistic(np.concatenate([x[~held], *[f[None] for f, _ in labels.values()]]), labelled, weight)
            models.append(w)
            scales.append(calibrate(odds(x[held], w), y[held]))
        if round_ == rounds:
            break
        told, features = surest(models, scales, PER_ROUND * (round_ + 1))
        for i, best in enumerate(told):
            for key, label in best:
                given[1 - i].setdefault(key, (features[key][1 - i], label))
    z = np.stack([odds(x[held], w) * s[0] + s[1] for x, w, s in zip(views, models, scales, strict=True)], 1)
    both = logistic(z, y[held].astype(float), np.ones(held.sum()), decay=1e-3)
    return Model(models[0], models[1], scales[0], scales[1], both)


#: What tells documents apart: equal rows of one id are one.
_KEY = ("doc_id", "h")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("h"), F.col("text").cast("binary").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of batches whose first columns are those of ``_keyed``: parts, and both views' features."""
    for batch in batches:
        for a, b, texts in slices(batch.column(2)):
            part = batch.slice(a, b - a)
            yield part, text_features(texts), meta_features(*(part.column(k).to_pylist() for k in (3, 4, 5)))


def _features(keyed: DataFrame) -> DataFrame:
    """doc_id, h, and both views' features; for bounded samples only."""
    shape = keyed.select("doc_id", "h", F.lit(b"").alias("x_text"), F.lit(b"").alias("x_meta")).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, meta in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), part.column(1), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], schema=arrow)

    return keyed.mapInArrow(run, shape)


def _surest(docs: DataFrame, known: DataFrame) -> Surest:
    """Over all rows of ``docs`` whose id is not in ``known``."""
    keyed = _keyed(docs)
    shape = keyed.select("doc_id", "h", F.lit(0).alias("view"), F.lit(0).alias("label"), F.lit(0.0).alias("sure")).schema
    arrow = to_arrow_schema(shape)
    ids = if_few(known.select("doc_id"))
    unlabelled = docs.select("doc_id").join(ids, "doc_id", "left_anti").limit(1).count() > 0

    def surest(models: list[np.ndarray], scales: list[tuple[float, float]], most: int):
        if not unlabelled:
            return [[], []], {}
        shared = docs.sparkSession.sparkContext.broadcast((models, scales))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, text, meta in _parts(batches):
                for view, (x, w, s) in enumerate(zip((text, meta), *shared.value, strict=True)):
                    p = 1 / (1 + np.exp(-np.clip(odds(x, w) * s[0] + s[1], -30, 30)))
                    for label, sure in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(sure >= SURE)
                        if len(at):
                            yield pa.RecordBatch.from_arrays([part.column(0).take(at).cast(arrow.field(0).type), part.column(1).take(at), pa.array(np.full(len(at), view), pa.int32()), pa.array(np.full(len(at), label), pa.int32()), pa.array(sure[at].astype(float))], schema=arrow)

        # Labelled ids go after scoring, so that only keys are joined, not texts; the features of the chosen are made again.
        scored = stored(keyed.mapInArrow(run, shape).join(ids, "doc_id", "left_anti").dropDuplicates([*_KEY, "view", "label"]), "sure")
        told: list[list[tuple[tuple, int]]] = [[], []]
        for view in (0, 1):
            for label in (1, 0):
                rows = scored.where((F.col("view") == view) & (F.col("label") == label)).orderBy(F.desc("sure"), "h", "doc_id").limit(most).select(*_KEY).collect()  # at most PER_ROUND * ROUNDS
                told[view] += [((r["doc_id"], r["h"]), label) for r in rows]
        keys = sorted({k for best in told for k, _ in best}, key=str)
        if not keys:
            return told, {}
        wanted = docs.sparkSession.createDataFrame(keys, keyed.select(*_KEY).schema)
        one = keyed.alias("a").join(F.broadcast(wanted.alias("b")), F.expr("a.doc_id <=> b.doc_id and a.h = b.h"), "left_semi")
        found = _features(one).dropDuplicates([*_KEY]).collect()  # at most 4 * PER_ROUND * ROUNDS rows
        return told, {(r["doc_id"], r["h"]): (np.frombuffer(r["x_text"], np.float32), np.frombuffer(r["x_meta"], np.float32)) for r in found}

    return surest


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Co-train on a bounded sample of ``labels`` (doc_id, quality) and on all unlabelled ``docs``."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stored(known, "labels")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # Of a repeated id the row of the least hash stands for it; it's found by hashes, so no text is moved. The sample's list is bounded, so it's broadcast.
    hashes = _keyed(docs).select(*_KEY).join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("double").alias("y"))), "doc_id").groupBy("doc_id").agg(F.min("h").alias("h"), F.first("y").alias("y"))
    hashes = stored(hashes, "sample")
    rows = _features(_keyed(docs).join(F.broadcast(hashes.select(*_KEY)), [*_KEY], "left_semi")).dropDuplicates([*_KEY]).join(F.broadcast(hashes), [*_KEY]).orderBy("y", F.xxhash64("x_text"), "doc_id").toArrow()
    y = rows["y"].to_numpy()
    text, meta = (np.stack([np.frombuffer(b.as_py(), np.float32) for b in rows[c]]) if len(y) else np.zeros((0, 1), np.float32) for c in ("x_text", "x_meta"))
    order = np.argsort(mix(np.arange(len(y), dtype=np.uint64)))
    return co_train(text[order], meta[order], y[order], _surest(docs, known))


def score(docs: DataFrame, model: Model, keep_columns: list[str], least: float | None = None) -> DataFrame:
    """``keep_columns`` of ``docs`` with quality_text, quality_meta, quality; with ``least``, only the columns, of rows of that quality or more."""
    names = ["text", "lang", "source", "n_chars"]
    spark = docs.sparkSession
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep_columns]).alias("doc"), *[F.col(c).alias(f"v_{c}") for c in names])
    row = row.withColumn("v_text", F.col("v_text").cast("binary")).withColumn("v_n_chars", F.col("v_n_chars").cast("long"))
    shape = row.select("doc", F.lit(0.0).alias("quality_text"), F.lit(0.0).alias("quality_meta"), F.lit(0.0).alias("quality")).schema
    arrow = to_arrow_schema(shape)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                p = shared.value.score(text_features(texts), meta_features(*(part.column(k).to_pylist() for k in (2, 3, 4))))
                out = pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *(pa.array(x, pa.float64()) for x in p)], schema=arrow)
                yield out if least is None else out.filter(pc.greater_equal(out.column(3), least))

    out = row.mapInArrow(run, shape)
    return out.select("doc.*") if least is not None else out.select("doc", "quality_text", "quality_meta", "quality")
