"""Spelling variants: words one edit apart, grouped by following the more frequent spelling.

Counting: a pass over the texts counts words per slice, so a frequent word is a
few rows a task before the shuffle.

Neighbours: the vocabulary is put into blocked Bloom filters, one for each word
length, and the filters are broadcast. Each word generates its deletions and
its replacements by greater letters (so each pair of neighbours comes up once,
and insertions are the deletions of the longer word). An edit's hash follows
from the word's by one addition, so only edits that the filter of their length
knows are written out as strings. These few go by a shuffle to an exact join
with the vocabulary, which takes out the false positives.

A filter has ``BITS`` bits a word. What is broadcast never exceeds ``most_bytes``:
a larger vocabulary falls into as many slices as need be, by hashes of its words,
and the edits are probed once for each slice. Filters are built by segments of
``SEGMENT`` blocks, each in a task of its own.

A form chain at least doubles n with each step, so it has at most 63; roots
are found by doubling the pointers, a written table a round.

Words are as in ``word_counts``: null texts have none, a null id counts as the
empty string; repeated rows count as often as they come; ties of n go to the
least word in code-point order. Texts are read in slices, so their length
doesn't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, store
from .wordhash import mix

LEAST_LENGTH, LEAST_COUNT, TYPO = 5, 3, 97
#: Bits of a filter for a word, bits set for a word, blocks of a segment, and the lengths that have a filter of their own.
BITS, PROBES, SEGMENT, SHARDS = 16, 6, 1024, 64
BLOCK = 512
MOST_BYTES = 64 << 20
_TEXT_SLICE, _FLUSH, _EDIT_SLICE = 4 << 20, 1 << 17, 1 << 15
#: UTF-8 characters other than ASCII and U+00C0 to U+00FF; with these gone, a letter is a-z or any byte from 128.
_OTHER, _RUN, _BREAK = re.compile(rb"(?:[\xc2\xc4-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3})+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
_LETTER = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text, a slice at a time."""
    at = 0
    while at < len(text):
        # A run is not cut: a slice goes on to the next ASCII byte that is no letter.
        cut = _BREAK.search(text, at + _TEXT_SLICE)
        end = cut.start() if cut else len(text)
        yield _RUN.findall(_OTHER.sub(b" ", text[at:end].lower()))
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    crc, counts = zlib.crc32, Counter()

    def rows() -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if len(w) >= LEAST_LENGTH and len(w) - w.count(b"\xc3") >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            head = crc((doc.as_py() or b"") + b":")
            for words in _runs(text.as_py() or b""):
                h = np.array([crc(w, head) for w in words], np.uint32)
                for i in np.flatnonzero(h % TYPO == 0):
                    letters = words[i].decode()
                    gone = int(h[i]) % len(letters)
                    words[i] = (letters[:gone] + letters[gone + 1 :]).encode()
                counts.update(words)
                if len(counts) >= _FLUSH:
                    yield rows()
                    counts.clear()
    yield rows()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences.

    A word is a maximal run ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased. Where
    97 divides the CRC-32 h of ``<doc_id>:<word>``, its letter h % length is left out.
    """
    pairs = docs.select(F.col(f"`{doc_id}`").cast("string").cast("binary").alias("id"), F.col(f"`{text}`").cast("binary").alias("b"))
    return pairs.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Letters:
    """Words of a batch as one array of Latin-1 codes, with a polynomial hash of each."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.code = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.first = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(self.code)) - self.first[self.word]
        most = int(self.length.max(initial=0)) + 1
        self.power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(most, _BASE)]))
        self.term = _LETTER[self.code] * self.power[self.place]
        upto = np.cumsum(self.term, dtype=np.uint64)
        before = (upto - self.term)[self.first] if len(words) else np.zeros(0, np.uint64)
        self.upto = upto - before[self.word]
        self.hash = self.upto[self.first + self.length - 1] if len(words) else np.zeros(0, np.uint64)


def _keys(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(length.astype(np.uint64)))


class Filters:
    """Where the bits of each length's filter lie; the bits themselves are one array of 64-bit words."""

    def __init__(self, counts: dict[int, int], slices: int):
        self.slices = slices
        self.blocks = np.zeros(SHARDS + 1, np.uint64)
        for shard, n in counts.items():
            self.blocks[shard] = max(1, -(-n * BITS // (BLOCK * slices)))
        self.at = np.cumsum(self.blocks, dtype=np.uint64) - self.blocks
        self.total = int(self.blocks.sum())

    def place(self, key: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each key, and whether its length has a filter at all."""
        shard = np.minimum(length, SHARDS)
        blocks = self.blocks[shard]
        return (self.at[shard] + (key >> np.uint64(32)) % np.maximum(blocks, np.uint64(1))).astype(np.int64), blocks > 0

    def slice_of(self, key: np.ndarray) -> np.ndarray:
        return (key & np.uint64(0xFFFFFFFF)) % np.uint64(self.slices)


def _bits(key: np.ndarray, j: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(9 * j)) & np.uint64(BLOCK - 1)).astype(np.int64)


def _known(filters: Filters, table: np.ndarray, number: int, h: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the edits that the filter of their length may hold."""
    key = _keys(h, length)
    block, has = filters.place(key, length)
    left = np.flatnonzero(has & (filters.slice_of(key) == number))
    for j in range(PROBES):
        bit = _bits(key[left], j)
        left = left[(table[block[left] * (BLOCK // 64) + (bit >> 6)] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return left


def _segments(vocabulary: DataFrame, filters: Filters, number: int) -> DataFrame:
    """(segment, data) of the filters of one slice."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Letters(batch.column(0).to_pylist())
            key = _keys(w.hash, w.length)
            mine = filters.slice_of(key) == number
            block, _ = filters.place(key, w.length)
            yield pa.RecordBatch.from_arrays([pa.array((block[mine] // SEGMENT).astype(np.int32)), pa.array((block[mine] % SEGMENT).astype(np.int32)), pa.array(key[mine].view(np.int64))], ["segment", "block", "key"])

    def build(table: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT * BLOCK, bool)
        block, key = (table.column(c).to_numpy().astype(np.int64) for c in ("block", "key"))
        for j in range(PROBES):
            bits[block * BLOCK + _bits(key.view(np.uint64), j)] = True
        return pa.table({"segment": table.column("segment")[:1], "data": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return vocabulary.select("word").mapInArrow(route, "segment int, block int, key long").groupBy("segment").applyInArrow(build, "segment int, data binary")


def _edits(filters: Filters, shared, number: int, alphabet: str):
    """(word, n, near): edits of each word that the filters may hold."""
    letters = np.frombuffer(alphabet.encode("latin-1"), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1)
            w = Letters(words)
            for a in range(0, len(w.code), _EDIT_SLICE):
                at = np.arange(a, min(a + _EDIT_SLICE, len(w.code)))
                own, place, code = w.word[at], w.place[at], w.code[at]
                # Of a run of equal letters only the first is left out.
                gone = at[(place == 0) | (code != w.code[at - 1])]
                shorter = w.upto[gone] - w.term[gone] + (w.hash[w.word[gone]] - w.upto[gone]) * _UNBASE
                gone = gone[_known(filters, table, number, shorter, w.length[w.word[gone]] - 1)]
                p, c = np.nonzero(letters[None, :] > code[:, None])
                other = w.hash[own[p]] + (_LETTER[letters[c]] - _LETTER[code[p]]) * w.power[place[p]]
                hit = _known(filters, table, number, other, w.length[own[p]])
                p, c = p[hit], c[hit]
                near = [words[w.word[i]][: w.place[i]] + words[w.word[i]][w.place[i] + 1 :] for i in gone]
                near += [words[own[i]][: place[i]] + alphabet[k] + words[own[i]][place[i] + 1 :] for i, k in zip(p, c)]
                of = pa.array(np.concatenate([w.word[gone], own[p]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), n.take(of), pa.array(near, pa.string())], ["word", "n", "near"])

    return run


def near_pairs(vocabulary: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(a, a_n, b, b_n): each two words of a stored ``vocabulary`` (word, n) one edit apart, once."""
    spark = vocabulary.sparkSession
    shard = F.least(F.char_length("word"), F.lit(SHARDS)).cast("int")
    counts = {r.shard: r["count"] for r in vocabulary.groupBy(shard.alias("shard")).count().collect()}  # at most 64 rows
    alphabet = "".join(sorted(r.c for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct().collect()))  # at most 90
    slices = max(1, -(-sum(counts.values()) * BITS // (8 * most_bytes)))
    filters, found = Filters(counts, slices), None
    for number in range(slices):
        table = np.zeros(-(-filters.total // SEGMENT) * SEGMENT * BLOCK // 8, np.uint8)
        for r in _segments(vocabulary, filters, number).collect():  # at most ``most_bytes``
            table[r.segment * SEGMENT * BLOCK // 8 :][: SEGMENT * BLOCK // 8] = np.frombuffer(r.data, np.uint8)
        shared = spark.sparkContext.broadcast(table.view(np.uint64))
        part = vocabulary.select("word", "n").mapInArrow(_edits(filters, shared, number, alphabet), "word string, n long, near string")
        found = part if found is None else found.unionByName(part)
    known = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    return found.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("near").alias("b")).join(known, "b").select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: a round doubles the pointers that aren't at their end, so a root that many words share is met once by each."""
    spark = forms.sparkSession
    path = store(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("last")), "pointers")
    while True:
        now = spark.read.parquet(path)
        if now.where("NOT last").isEmpty():
            return now.select("word", "root")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.where("NOT last").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("last"))
        new = store(now.where("last").unionByName(moved), "pointers")
        remove(spark, path)
        path = new


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``docs``.

    ``form`` is the near word of largest n if that is at least twice the word's; ``root`` the end of the chain of forms.
    """
    spark = docs.sparkSession
    vocabulary = spark.read.parquet(store(word_counts(docs, doc_id, text), "vocabulary"))
    pairs = near_pairs(vocabulary, most_bytes)
    side = lambda w, n, o, m: F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.col(o).alias("near"), F.col(m).alias("near_n"))
    both = pairs.select(F.explode(F.array(side("a", "a_n", "b", "b_n"), side("b", "b_n", "a", "a_n"))).alias("x")).select("x.*")
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near"))))
    told = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    leads = -F.col("best.neg") >= 2 * F.col("n")
    told = told.select("word", "n", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.neg")).alias("form_n"))
    words = spark.read.parquet(store(told, "forms"))
    roots = _roots(words.where("form IS NOT NULL"))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
