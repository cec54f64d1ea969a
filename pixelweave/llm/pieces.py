"""SentencePiece encoding and decoding over a relational lattice.

A text is escaped as the model asks (a space in front, spaces as U+2581) and
falls into units: leading spaces with one run of letters, of digits, or of
other characters, whatever their length. No piece of the table crosses a unit's
edge (checked when the model is read), so the best segmentation of a text is that
of its units. Units above ``LONG`` characters (a sentence of Chinese, base 64) are
not put in the lattice relation: the task that encodes a text folds them where
they stand, with the nodes of the last ``longest`` places, by the same rule.

1. distinct units of the corpus with their counts;
2. each unit's substrings of bounded length, equi-joined to the piece table
   (broadcast: its size is the vocabulary's; by 64-bit numbers, then the strings
   are compared), are the edges of its lattice;
3. edges grouped by unit are folded by Viterbi with ``aggregate``; of equal
   scores the earliest start wins; characters without a piece fall back to bytes;
4. units of many texts (at most ``HOT``, by a count threshold) are broadcast to
   the tasks that encode the texts; the others leave holes in the ids, which joins
   on unit and text, written one by one, fill. Units are told apart by 64-bit hashes there.

The scores of a BPE model are ranks of merges, not log-probabilities; they are
read as Zipf log-probabilities, -ln(rank + 1) - ln(ln(size)). A unigram model's
scores are taken as they are.

Null text is empty and has no pieces. Decoding gives the text back but for the
character U+2581 itself, which comes back as a space, as with the library.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_dir, store
from .wordhash import mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LONG, HOT = "▁", 64, 200_000
#: One unit: spaces with a run of letters, digits or other characters.
UNIT = re.compile(rf"[ {SPACE}]*+(?:[^\W\d_²]++|\d++|(?:[^\w {SPACE}]|[_²])++)|[ {SPACE}]++")
UNIT_GROUPS = 10_000  # about as many units are grouped by a task


@dataclass
class Table:
    pieces: list[tuple[str, int, float]]  # surface, id, score
    longest: int
    unknown: float  # score of a character without a piece
    bytes0: int  # id of byte 0; the others follow
    surfaces: list[str]


def read_model(path: str = MODEL) -> Table:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    whole = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    raw = {i: model.get_score(i) for i in whole}
    # Merge ranks are distinct whole numbers (or a constant for pieces no merge makes).
    ranked = sum(s == round(s) for s in raw.values()) > 0.99 * len(raw)
    score = {i: -math.log1p(min(-s, n)) - math.log(math.log(n)) for i, s in raw.items()} if ranked else raw
    pieces = [(model.id_to_piece(i), i, score[i]) for i in whole]
    crossing = [p for p, _, _ in pieces if not UNIT.fullmatch(p)]
    if crossing:
        raise ValueError(f"pieces that cross the edge of a unit: {crossing[:5]}")
    return Table(pieces, max(len(p) for p, _, _ in pieces), min(score.values()) - 10, model.piece_to_id("<0x00>"), [model.id_to_piece(i) if i in raw else "" for i in range(n)])


def units_of(text: str) -> list[str]:
    return UNIT.findall(" " + text) if text else []


def best_ids(unit: str, known: dict[str, tuple[int, float]], longest: int, unknown: float, bytes0: int) -> np.ndarray:
    """Ids of the best path of a unit of any length, spaces plain; of equal scores the earliest start wins, as in ``viterbi``."""
    n = len(unit)
    nodes, start, piece = [0.0] * (n + 1), np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int32)
    for e in range(1, n + 1):
        best = None
        for b in range(max(0, e - longest), e):
            found = known.get(unit[b:e])
            if found is None and b < e - 1:
                continue
            i, score = found or (-1, unknown)
            if best is None or nodes[b] + score > best:
                best, start[e], piece[e] = nodes[b] + score, b, i
        nodes[e] = best
    out, at = [], n
    while at:
        b = int(start[at])
        out.append([int(piece[at])] if piece[at] >= 0 else [bytes0 + x for x in unit[b:at].replace(" ", SPACE).encode()])
        at = b
    return np.array([i for x in reversed(out) for i in x], np.int32)


@functools.cache
def _classes() -> np.ndarray:
    """By code point: 0 space, 1 letter, 2 digit, 3 other, as in ``UNIT``."""
    every = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)]).tobytes().decode("utf-32-le")
    out = np.full(0x110000, 3, np.int8)
    for kind, chars in enumerate((f"[ {SPACE}]+", r"[^\W\d_²]+", r"\d+")):
        for m in re.finditer(chars, every):
            out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    out[0xD800:0xE000] = 3  # no characters
    return out


_CODE = mix(np.arange(0x3000, dtype=np.uint64)) | np.uint64(1)


def _code_hashes(code: np.ndarray) -> np.ndarray:
    out = np.take(_CODE, code, mode="clip")
    if len(code) and code.max() >= len(_CODE):
        beyond = code >= len(_CODE)
        out[beyond] = mix(code[beyond].astype(np.uint64)) | np.uint64(1)
    return out


def run_hashes(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of code points, wherever they stand."""
    power, inverse = powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    each = _code_hashes(code)
    each *= power[: len(code)]
    np.cumsum(each, out=sums[1:])
    return mix((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes in order, the place of one of each, and how often it comes."""
    order = np.argsort(h)
    each = h[order]
    new = np.flatnonzero(np.append(np.ones(min(1, len(h)), bool), each[1:] != each[:-1]))
    return each[new], order[new], np.diff(new, append=len(h))


def hashes(units: list[str]) -> np.ndarray:
    """The hashes that ``Units`` gives to whole units."""
    size = np.array([len(u) for u in units], np.int64)
    return run_hashes(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size)


@dataclass
class Units:
    """The units of some texts, cut at once by the rule of ``UNIT``."""

    body: str  # the texts, each with a space in front
    start: np.ndarray  # of each unit in body
    size: np.ndarray
    text: np.ndarray  # the text of each unit
    hash: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Units:
        body = "".join(f" {t}" for t in texts if t)
        code = np.frombuffer(body.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        kind = np.take(_classes(), code, mode="clip")
        head = np.zeros(len(code), bool)
        head[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        head[(ends - lengths)[lengths > 0]] = True
        start = np.flatnonzero(head)
        size = np.diff(start, append=len(code))
        return cls(body, start, size, np.searchsorted(ends, start, "right"), run_hashes(code, start, size))

    def strings(self, which: np.ndarray) -> pa.Array:
        """Those units, cut from the UTF-8 bytes of the body."""
        data = np.frombuffer(self.body.encode(), np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character
        start = at[self.start[which]]
        size = at[self.start[which] + self.size[which]] - start
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(ends), pa.py_buffer(data[ranges(start, size)]))


def _text_slices(column: pa.Array, chars: int = 1 << 17) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows with about ``chars`` characters, so that memory follows the longest text and not the batch."""
    first, size, held = 0, 0, []
    for i, t in enumerate(column):
        held.append((t.as_py() or "").replace(SPACE, " "))  # one character to the model
        size += len(held[-1])
        if size >= chars:
            yield first, i + 1, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, len(column), held


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker, kept for later tasks, gives Arrow's unused memory back: stages without Python run beside it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def distinct_units(docs: DataFrame, text: str = "text", merge: int = 200_000, most: int = 600_000) -> DataFrame:
    """(unit, n) of at most ``LONG`` characters. A task adds up what it has seen, every ``merge`` rows, and gives up to about ``most`` units at a time, so a unit may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held = 0, []  # rows of the first table, where it is a sum; tables of (unit, n)

        def added() -> pa.Table:
            # In Arrow's memory, which goes back to the system.
            rows = pa.concat_tables(held).group_by("unit", use_threads=False).aggregate([("n", "sum")])
            held.clear()
            return rows.select(["unit", "n_sum"]).rename_columns(["unit", "n"])

        for batch in batches:
            for _, _, texts in _text_slices(batch.column(0)):
                u = Units.of(texts)
                short = np.flatnonzero(u.size <= LONG)
                _, one, n = distinct(u.hash[short])
                held.append(pa.table({"unit": u.strings(short[one]), "n": n}))
                if sum(len(x) for x in held) - whole > merge:
                    held.append(added())
                    whole = len(held[0])
                    if whole > most:
                        yield from held.pop().to_batches()
                        whole = 0
        if held:
            yield from added().to_batches()

    return docs.select(F.col(text).alias("t")).mapInArrow(tidy(run), "unit string, n long")


def counted_units(found: DataFrame) -> DataFrame:
    """(unit, h, n) of all tasks together, with 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes(batch.column(0).to_pylist()).view(np.int64)), batch.column(1)], ["unit", "h", "n"])

    return found.groupBy("unit").agg(F.sum("n").alias("n")).mapInArrow(tidy(run), "unit string, h long, n long")


def viterbi(edges: Column) -> Column:
    """Ids of the best path. ``edges``: structs (end, start, id, score) sorted by end and start, some edge ending at each place.

    State: for each place before ``end`` its best score and the ids that lead
    there; of the best edge into ``end`` so far its score, start and id.
    """

    def settled(acc: Column) -> Column:
        """The nodes with that of ``end``."""
        return F.array_append(acc["nodes"], F.struct(acc["score"].alias("score"), F.array_append(F.get(acc["nodes"], acc["start"])["ids"], acc["id"]).alias("ids")))

    def step(acc: Column, e: Column) -> Column:
        same = e["end"] == acc["end"]
        score = e["score"] + F.when(e["start"] == acc["end"], acc["score"]).otherwise(F.get(acc["nodes"], e["start"])["score"])

        def let(score: Column) -> Column:
            # Edges into one end come by start: of equal scores the earliest start stays.
            worse = same & (score <= acc["score"])
            nodes = F.when(same | (acc["end"] == 0), acc["nodes"]).otherwise(settled(acc))
            return F.when(worse, acc).otherwise(F.struct(nodes.alias("nodes"), e["end"].alias("end"), score.alias("score"), e["start"].alias("start"), e["id"].alias("id")))

        return let(score)

    empty = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))
    start = F.struct(F.array(empty).alias("nodes"), F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id"))
    return F.aggregate(edges, start, step, lambda acc: F.element_at(settled(acc), -1)["ids"])


def piece_key(piece: Column) -> Column:
    """A 64-bit number, by which the join finds pieces faster than by strings; the strings are compared after it."""
    return F.xxhash64(piece)


def encode_units(units: DataFrame, table: Table) -> DataFrame:
    """(unit, h, n, ids) from (unit, h, n): the relational lattice of each unit, folded."""
    spark = units.sparkSession
    surface, number, score = zip(*table.pieces, strict=True)
    # From Arrow: rows of Python objects would pass through workers of their own on the executors.
    local = pa.table({"piece": [p.replace(SPACE, " ") for p in surface], "id": pa.array(number, pa.int32()), "score": pa.array(score, pa.float64())})
    pieces = spark.createDataFrame(local).withColumn("key", piece_key(F.col("piece")))
    parts = -(-max(1, units.count()) // UNIT_GROUPS)
    spread = units.repartition(max(parts, 8), "unit")
    # Two explodes and a substring stay inside generated code; a nested transform would not.
    ends = spread.select("unit", "h", "n", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("end"))
    cuts = ends.select("unit", "h", "n", "end", F.explode(F.sequence(F.greatest(F.col("end") - table.longest, F.lit(0)), F.col("end") - 1)).alias("start"))
    cuts = cuts.withColumn("cut", F.substring(F.col("unit"), F.col("start") + 1, F.col("end") - F.col("start"))).withColumn("key", piece_key(F.col("cut")))
    same = F.coalesce(F.col("piece") == F.col("cut"), F.lit(False))
    edges = cuts.join(F.broadcast(pieces), "key", "left").where(same | (F.col("end") == F.col("start") + 1))
    # An edge without a piece keeps its place as a negative id until its bytes are put in; beside the character's own piece (where keys meet) it never wins.
    edge = F.struct("end", "start", F.when(same, F.col("id")).otherwise(-F.col("end")).alias("id"), F.when(same, F.col("score")).otherwise(F.lit(table.unknown)).alias("score"))
    grouped = edges.groupBy("unit", "h", "n").agg(F.collect_list(edge).alias("edges"))
    best = grouped.select("unit", "h", "n", viterbi(F.sort_array("edges")).alias("ids"))

    def as_bytes(place: Column) -> Column:
        code = F.hex(F.encode(F.translate(F.substring(F.col("unit"), -place, F.lit(1)), " ", SPACE), "UTF-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + table.bytes0)

    ids = F.when(F.exists("ids", lambda x: x < 0), F.flatten(F.transform("ids", lambda x: F.when(x < 0, as_bytes(x)).otherwise(F.array(x))))).otherwise(F.col("ids"))
    return best.select("unit", "h", "n", ids.alias("ids"))


def own_session(spark: SparkSession) -> SparkSession:
    """A session whose tasks group their units by hash (about UNIT_GROUPS; by default all edges would be sorted) and whose shuffle files go when a table is written; the user's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 4 * UNIT_GROUPS)
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)
    return own


@dataclass
class Dictionary:
    """Units and their ids, found by 64-bit hashes: keys in order, and where those of each leading bits begin."""

    key: np.ndarray
    begin: np.ndarray
    shift: int
    at: np.ndarray  # of each key's ids in flat; one more for the end
    flat: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, ids: pa.ListArray) -> Dictionary:
        order = np.argsort(h)
        size = pc.list_value_length(ids).to_numpy(zero_copy_only=False)[order]
        bits = len(h).bit_length() + 2  # few share their leading bits
        begin = np.searchsorted(h[order], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        at = np.concatenate([[0], np.cumsum(size)])
        return cls(h[order], np.append(begin, len(h)).astype(np.int32), 64 - bits, at, ids.take(pa.array(order)).flatten().to_numpy(zero_copy_only=False).astype(np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        out = np.full(len(h), -1)
        if not len(self.key):
            return out
        top = (h >> np.uint64(self.shift)).astype(np.int64)
        place, end = self.begin.take(top), self.begin.take(top + 1)
        left = np.flatnonzero(place < end)
        place, end, h = place[left], end[left], h[left]
        while len(left):
            hit = self.key.take(place) == h
            out[left[hit]] = place[hit]
            place = place + 1
            more = np.flatnonzero(~hit & (place < end))
            left, place, end, h = left[more], place[more], end[more], h[more]
        return out


def ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers at .. at + size - 1 of each pair, one after the other."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def lacking(u: Units, common: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each unit in the dictionary (-1: it lacks, -2: too long for it); of the lacking ones, by text and hash, their numbers, and whether each is the first of its kind in its text."""
    place = common.find(u.hash)
    place[u.size > LONG] = -2
    lack = np.flatnonzero(place == -1)
    order = lack[np.lexsort((u.hash[lack].view(np.int64), u.text[lack]))]
    t, h = u.text[order], u.hash[order]
    new = (np.diff(t, prepend=-1) != 0) | (np.diff(h, prepend=h[:1]) != 0)
    return place, order, new


def coded(texts: list[str], common: Dictionary, long_ids) -> tuple[list[np.ndarray], np.ndarray]:
    """The ids of each text, and whether it lacks any unit: one that isn't common leaves a hole, -1 - k for the k-th, by hash, of those its text lacks."""
    u = Units.of(texts)
    place, order, new = lacking(u, common)
    flat, at, size = common.flat, common.at[np.maximum(place, 0)], np.where(place >= 0, np.diff(common.at)[np.maximum(place, 0)] if len(common.key) else 0, 1)
    more, end = [flat], len(flat)
    lacks = np.zeros(len(texts), bool)
    if len(order):
        t = u.text[order]
        other = np.diff(t, prepend=-1) != 0
        k = np.cumsum(new) - 1  # number of each distinct (text, unit)
        more.append((-1 - (k - np.repeat(k[other], np.diff(np.append(np.flatnonzero(other), len(t)))))).astype(np.int32))
        at[order], size[order] = end + np.arange(len(order)), 1
        end += len(order)
        lacks[t] = True
    for x in np.flatnonzero(place == -2).tolist():
        ids = long_ids(u.body[u.start[x] : u.start[x] + u.size[x]])
        more.append(ids)
        at[x], size[x] = end, len(ids)
        end += len(ids)
    pool = np.concatenate(more) if len(more) > 1 else flat
    body = pool[ranges(at, size)].astype(np.int32) if len(at) else np.zeros(0, np.int32)
    ends = np.cumsum(np.bincount(u.text, weights=size, minlength=len(texts)).astype(np.int64))
    return [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], lacks


def packed(ids: np.ndarray) -> bytes:
    """The least of the ids and 0, and what each is above it, in two bytes where that is enough, else in four."""
    low = min(0, int(ids.min(initial=0)))
    wide = int(ids.max(initial=0)) - low > 0xFFFF
    return low.to_bytes(7, "little", signed=True) + bytes([wide]) + (ids.astype(np.int64) - low).astype(np.uint32 if wide else np.uint16).tobytes()


def unpacked(x: memoryview) -> np.ndarray:
    return (np.frombuffer(x[8:], np.uint32 if x[7] else np.uint16).astype(np.int64) + int.from_bytes(x[:7], "little", signed=True)).astype(np.int32)


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table: Table | None = None, hot: int = HOT, checked: bool = False) -> DataFrame:
    """doc_id, text_sha256, ids: one row per row of ``docs``; if ``checked`` also ``round_trip``, whether decoding gives the text back."""
    spark = docs.sparkSession
    table = table or read_model()
    body = F.coalesce(F.col(text), F.lit(""))
    own, folder = own_session(spark), shared_dir(spark)

    paths: dict[str, str] = {}

    def kept(df: DataFrame, tag: str) -> DataFrame:
        """``df`` stored, as a table of the own session."""
        paths[tag] = store(df, tag, folder)
        return own.read.schema(df.schema).parquet(paths[tag])

    units = kept(counted_units(kept(distinct_units(docs.select(body.alias("t")), "t"), "seen")), "units")
    remove(own, paths.pop("seen"))
    encoded = kept(encode_units(units, table), "encoded")
    least = threshold(units, hot)
    remove(own, paths.pop("units"))
    found = encoded.where(F.col("n") >= least).select("h", "ids").toArrow().combine_chunks()  # at most ``hot`` rows
    one = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
    shared = spark.sparkContext.broadcast(Dictionary.of(one(found["h"]).to_numpy(zero_copy_only=False).view(np.uint64), one(found["ids"])))
    del found
    pieces = spark.sparkContext.broadcast([(p.replace(SPACE, " "), i, score) for p, i, score in table.pieces])
    rest = (table.longest, table.unknown, table.bytes0)
    # Texts are known by their SHA-256 (in the joins by its first 16 bytes), so that both passes over them agree however often they run.
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("key"), body.alias("t"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _text_slices(batch.column(1)):
                u = Units.of(texts)
                _, order, new = lacking(u, shared.value)
                if len(order):
                    yield pa.RecordBatch.from_arrays([pc.binary_slice(batch.column(0).slice(a, b - a), 0, 16).take(pa.array(u.text[order[new]])), pa.array(u.hash[order[new]].view(np.int64))], ["key", "h"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, whole = _cached(pieces, lambda: {p: (i, score) for p, i, score in pieces.value}), 0
        for batch in batches:
            for a, b, texts in _text_slices(batch.column(2)):
                ids, lacks = coded(texts, shared.value, lambda u: best_ids(u, table_, *rest))
                keys = batch.column(1).slice(a, b - a)
                # A text that lacks nothing meets no row; numbers in place of keys spread the copies of a hot one.
                meet = [k[:16] if lack else (whole + i).to_bytes(8, "little") for i, (k, lack) in enumerate(zip(keys.to_pylist(), lacks.tolist(), strict=True))]
                whole += len(meet)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), keys, pa.array(meet, pa.binary()), pa.array([packed(x) for x in ids], pa.binary())], ["doc_id", "key", "meet", "coded"])

    # The join and the grouping are written one after the other, so that the shuffles of one are gone when the other begins.
    missing = keyed.select("key", "t").mapInArrow(tidy(wanted), "key binary, h long")
    met = kept(encoded.where(F.col("n") < least).select("h", F.col("ids").alias("own")).join(missing, "h").select(F.col("key").alias("meet"), "h", "own"), "met")
    remove(own, paths.pop("encoded"))
    found = F.sort_array(F.collect_set(F.struct("h", "own")))  # copies of a text want the same
    grouped = met.groupBy("meet").agg(F.transform(found, lambda x: x["own"]).alias("rare"))
    path = store(grouped.mapInArrow(tidy(packed_lists), "meet binary, rare binary"), "rare", folder)
    remove(own, paths.pop("met"))  # all that is left to do reads the texts and ``rare``
    rare = spark.read.schema("meet binary, rare binary").parquet(path)
    kind = docs.schema[doc_id].dataType.simpleString()
    half = keyed.mapInArrow(tidy(first), f"doc_id {kind}, key binary, meet binary, coded binary")
    surfaces = surface_bytes(table) if checked else None

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            done = [filled(unpacked(memoryview(x.as_buffer())), unpacked(memoryview(r.as_buffer())) if r.is_valid else None) for x, r in zip(batch.column(2), batch.column(3), strict=True)]
            size = np.array([len(x) for x in done], np.int64)
            ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), np.concatenate(done))
            same = [hashlib.sha256(x[1:] if x[:1] == b" " else x).digest() == h for x, h in zip(decoded(ids.values, size, surfaces), batch.column(1).to_pylist(), strict=True)] if checked else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.hex() for x in batch.column(1).to_pylist()]), ids, *([pa.array(same)] if checked else [])], ["doc_id", "text_sha256", "ids", *["round_trip"] * checked])

    whole = half.join(rare, "meet", "left").select("doc_id", "key", "coded", "rare")
    return whole.mapInArrow(tidy(last), f"doc_id {kind}, text_sha256 string, ids array<int>" + ", round_trip boolean" * checked)


def packed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of lists of the second column, each as one: their number, their sizes, and what they hold."""
    for batch in batches:
        lists = batch.column(1)
        number, inner = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
        size, values = pc.list_value_length(inner).to_numpy(zero_copy_only=False).astype(np.int32), inner.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        at, place = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(size)])
        out = [packed(np.concatenate([np.array([b - a], np.int32), size[a:b], values[place[a] : place[b]]])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["meet", "rare"])


def filled(ids: np.ndarray, rare: np.ndarray | None) -> np.ndarray:
    """``ids`` with each hole -1 - k replaced by the k-th ids of ``rare``."""
    if rare is None:
        return ids
    size, values = rare[1 : 1 + rare[0]].astype(np.int64), rare[1 + rare[0] :]
    at, hole = np.cumsum(size) - size, ids < 0
    k = -1 - ids[hole]
    wide = np.ones(len(ids), np.int64)
    wide[hole] = size[k]
    place = np.cumsum(wide) - wide
    out = np.empty(int(wide.sum()), np.int32)
    out[place[~hole]] = ids[~hole]
    out[ranges(place[hole], size[k])] = values[ranges(at[k], size[k])]
    return out


def surface_bytes(table: Table) -> list[bytes]:
    """The bytes of each id, spaces plain."""
    surfaces = [s.replace(SPACE, " ").encode() for s in table.surfaces]
    surfaces[table.bytes0 : table.bytes0 + 256] = [bytes([b]) for b in range(256)]
    return surfaces


def decoded(flat: pa.Array, size: np.ndarray, surfaces: list[bytes]) -> Iterator[bytes]:
    """The bytes of each run of ``size`` ids."""
    bodies = pa.array(surfaces, pa.binary()).take(flat)
    places = np.frombuffer(bodies.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    data, ends = memoryview(bodies.buffers()[2] or b""), np.cumsum(size)
    return (bytes(data[a:b]) for a, b in zip(places[ends - size].tolist(), places[ends].tolist(), strict=True))


def _few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task holds at a time is a few texts and their ids."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_cache: dict = {}


def _cached(shared, build):
    """One dictionary a worker process, for the broadcast in use."""
    of = hash(tuple(shared.value))  # not its address, which another broadcast may get
    if _cache.get("of") != of:
        _cache.clear()
        _cache.update(of=of, value=build())
    return _cache["value"]


def threshold(units: DataFrame, hot: int) -> int:
    """The least count such that at most ``hot`` units have it or more."""
    steps = units.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("units"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # at most 8 * 63 rows
    total, least = 0, (1 << 62)
    for r in steps:
        total += r["units"]
        if total > hot:
            break
        least = r["least"]
    return least


def decode(encoded: DataFrame, table: Table | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids; null ids give null."""
    surfaces = surface_bytes(table or read_model())
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(schema)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            column = batch.column(at)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            texts = [(str(x[1:] if x[:1] == b" " else x, "utf-8", "replace") if there else None) for there, x in zip(column.is_valid().to_pylist(), decoded(column.flatten(), size, surfaces), strict=True)]
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema=arrow)

    return encoded.mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table: Table | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding gives the text back."""
    return encode(docs, text, doc_id, table, checked=True).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
