"""Near-duplicates by BagMinHash.

Texts are multisets of five-word shingles. For each shingle of weight w,
Poisson processes over the dyadic weight ranges [0,1), [1,2), [2,4), ... throw
points (time, slot, weight level); points at levels below w count, and a slot
keeps its least time. Two signatures agree in a slot with probability equal to
the weighted Jaccard similarity. A process stops once its time is past the
text's largest slot, so a text needs about one point a shingle.

Signatures are cut into ``BANDS`` bands of ``ROWS`` slots; texts that share a
band are candidates, and multiset overlap of the whole shingle sets decides. At
similarity 0.8 a pair misses all bands with probability 3e-6.

Equal texts are one node, whatever their number. Within a bucket each text is
first compared with one hub, for ``STARS`` rounds of hubs of other classes.
Buckets that then still hold several classes are dealt into blocks of bounded
size, and every two blocks of a bucket go to a task of their own:

1. with bitmaps alone, to find the texts that have a possible partner there, of
   another class. Bit i of a bitmap is the parity of the shingles hashed to i, so
   bitmaps differ in at most as many bits as the sets differ in shingles;
2. those texts again, with their shingles: the task compares the pairs that sizes
   and bitmaps leave, each in the first bucket it shares, joins classes as it
   finds links, and gives only links between classes that were still apart.

So no relation holds a row per pair. No bucket is dropped or cut, and no two texts
that share a band and are similar end in different classes.

Null counts as the empty text. Texts of fewer than five words are one shingle;
texts of no word have no near-duplicates but equal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_few, stored
from .wordhash import mix, shingles, slices, words

BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
SIMILAR, SHINGLE, STARS, BITS = 0.8, 5, 2, 512
#: The most texts, and about the most shingles, of a block.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 18


def weights_of(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of distinct shingles, and for every shingle its number among equals, sorted by text and hash."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(h)))
    nth = np.arange(len(h)) - np.repeat(first, weight)
    return text[first], h[first], weight, nth


def signatures(texts: int, text: np.ndarray, h: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The least time of each slot, texts x slots; infinite for texts without shingles."""
    out = np.full(texts * slots, np.inf)
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(int), 0) + 1
    of = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    seed, text, weight, time, k = mix(h[of] ^ mix(level.astype(np.uint64))), text[of], weight[of], np.zeros(len(of)), np.uint64(0)
    while len(seed):
        k += np.uint64(1)
        r = mix(seed + mix(np.full(1, k * np.uint64(3))))
        r2, r3 = mix(r), mix(r ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (slots * width)
        most = out.reshape(texts, slots).max(axis=1)
        live = time < most[text]
        seed, text, weight, time, low, width, r2, r3 = (x[live] for x in (seed, text, weight, time, low, width, r2, r3))
        counts = low + width * ((r3 >> np.uint64(11)).astype(np.float64) / 2.0**53) < weight
        np.minimum.at(out, text[counts] * slots + ((r2[counts] >> np.uint64(33)) % np.uint64(slots)).astype(np.int64), time[counts])
    return out.reshape(texts, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, texts x bands."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), bits.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ bits[:, :, r])
    return key.view(np.int64)


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_id (16 bytes of the text's SHA-256) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                owner, h = shingles(words(texts), SHINGLE)
                distinct_text, distinct_hash, weight, _ = weights_of(owner, h)
                keys = band_keys(signatures(len(texts), distinct_text, distinct_hash, weight))
                has = np.zeros(len(texts), bool)
                has[distinct_text] = True
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), keys[has].ravel())
                ids = pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, bands], ["doc_id", "text_id", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("b")).mapInArrow(run, "doc_id long, text_id binary, bands array<long>")


def text_ids(body):
    """The text_id of a text column, as ``sketches`` makes it."""
    return F.substring(F.unhex(F.sha2(F.coalesce(body, F.lit("")), 256)), 1, 16)


def parities(texts: int, text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``BITS`` parities of each text's shingles in longs, texts x BITS / 64."""
    odd = np.bincount(text * BITS + h.astype(np.int64) % BITS, minlength=texts * BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).reshape(texts, BITS // 64)


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """text_id, shingles (hashes of shingle and copy number, sorted, so that sets stand for multisets) and their ``parities`` of the texts in ``wanted``.

    ``wanted`` (text_id) is broadcast if a count shows that its ids are few; else both sides are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                owner, h = shingles(words(texts), SHINGLE)
                distinct_text, distinct_hash, weight, nth = weights_of(owner, h)
                each, of = mix(np.repeat(distinct_hash, weight) + nth.astype(np.uint64)).view(np.int64), np.repeat(distinct_text, weight)
                each = each[np.lexsort((each, of))]
                sizes = np.bincount(of, minlength=len(texts))[: len(texts)]
                sets = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), each)
                bits = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * (BITS // 64), parities(len(texts), of, each).ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets, bits], ["text_id", "shingles", "bits"])

    ids = wanted.select("text_id").distinct()
    keyed = docs.select(text_ids(F.col(text)).alias("text_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b"))
    found = keyed.join(if_few(ids), "text_id", "left_semi")
    return found.select("text_id", "b").mapInArrow(run, "text_id binary, shingles array<long>, bits array<long>").groupBy("text_id").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) of the components once ``links`` (a, b) are added. Links between the same two classes count once, so a large class isn't walked again."""
    a, b = (labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")) for end in "ab")
    classes = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    roots = components(classes.where("a != b").distinct())
    old = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return stored(old.unionByName(roots.join(labels, "node", "left_anti")), "labels")


def overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``similarity``, the weighted Jaccard similarity of their shingles."""
    left = sets.select(F.col("text_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("text_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``links`` (a, b): label is the least node of the component. Neighbours' labels spread and are shortened by one jump a round."""
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        least = stored(least, "labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(least.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def block_pairs(now: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of open buckets ``now`` (key, text_id, label) once for every two blocks they stand in: key, i, j (i <= j), second (whether of block j), text_id, label.

    A bucket falls into as many blocks as keep to ``BLOCK_TEXTS`` and ``BLOCK_SHINGLES``; texts are dealt to them by their ids.
    """
    sized = now.select("key", "text_id", "label").join(sets.select("text_id", F.size("shingles").alias("n")), "text_id")
    count = F.count(F.lit(1))
    parts = F.greatest(F.ceil(count / BLOCK_TEXTS), F.least(count, F.ceil(F.sum("n") / BLOCK_SHINGLES))).cast("int")
    own = F.pmod(F.xxhash64("text_id"), F.col("parts")).cast("int")
    dealt = sized.join(sized.groupBy("key").agg(parts.alias("parts")), "key").withColumn("own", own)
    met = dealt.select("key", "text_id", "label", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "text_id", "label")


def _possible(second: np.ndarray, label: np.ndarray, n: np.ndarray, bits: np.ndarray, alone: bool, similar: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of a pair of blocks, each text with its later partners (by size) of another class that sizes and bitmaps allow. ``alone``: a block with itself.

    Sets of n and m shingles are similar only if they differ in at most
    (n + m) * (1 - t) / (1 + t) shingles, and so their bitmaps in no more bits.
    """
    order = np.argsort(n, kind="stable")
    last = np.searchsorted(n[order], n[order] / similar + 1e-6, "right")
    for x, a in enumerate(order):
        later = order[x + 1 : last[x]]
        later = later[label[later] != label[a]] if alone else later[(label[later] != label[a]) & (second[later] != second[a])]
        if len(later):
            differ = np.bitwise_count(bits[later] ^ bits[a]).sum(axis=1, dtype=np.int64)
            later = later[differ <= (n[later] + n[a]) * ((1 - similar) / (1 + similar)) + 1e-6]
        if len(later):
            yield int(a), later


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[str, np.ndarray]]]:
    """Of grouped block pairs (key, i, j, list of structs): the key and NumPy columns of the members; lists come flat, with their offsets under ``name_at``."""
    for batch in batches:
        for r in range(batch.num_rows):
            members = batch.column(3)[r].values
            columns = {}
            for field in members.type:
                x = members.field(field.name)
                if pa.types.is_list(field.type):
                    columns[field.name], columns[f"{field.name}_at"] = x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int64)
                else:
                    columns[field.name] = x.to_numpy(zero_copy_only=False)
            columns["bits"] = columns["bits"].view(np.uint64).reshape(len(members), BITS // 64)
            columns["label"] = np.unique(columns["label"], return_inverse=True)[1]
            yield {name: batch.column(k)[r].as_py() for k, name in enumerate(("key", "i", "j"))}, columns


def _with_partners(similar: float):
    """Phase 1: the texts of a block pair that have a possible partner in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, c in _blocks(batches):
            has = np.zeros(len(c["n"]), bool)
            for a, later in _possible(c["second"], c["label"], c["n"], c["bits"], at["i"] == at["j"], similar):
                has[a] = has[later] = True
            m = int(has.sum())
            if m:
                yield pa.RecordBatch.from_arrays([*(pa.array([at[k]] * m, t) for k, t in (("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))), pa.array(c["second"][has]), pa.array(c["text_id"][has], pa.binary())], ["key", "i", "j", "second", "text_id"])

    return run


def _spanning(similar: float):
    """Phase 2: links between the classes of a block pair, none between classes already joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, c in _blocks(batches):
            root, first, second = c["label"].copy(), [], []
            bands, sets, ends = c["bands"].reshape(len(root), -1), c["shingles"], c["shingles_at"]
            for a, later in _possible(c["second"], c["label"], c["n"], c["bits"], at["i"] == at["j"], similar):
                later = later[root[later] != root[a]]
                same = bands[later] == bands[a]
                later = later[bands[a][same.argmax(axis=1)] == at["key"]]
                if not len(later):
                    continue
                own = sets[ends[a] : ends[a + 1]]
                theirs = np.concatenate([sets[ends[b] : ends[b + 1]] for b in later])
                place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                starts = np.cumsum(c["n"][later]) - c["n"][later]
                both = np.add.reduceat((own[place] == theirs).astype(np.int64), starts)
                for b in later[both / (len(own) + c["n"][later] - both) >= similar]:
                    if root[a] != root[b]:
                        root[root == root[b]] = root[a]
                        first.append(c["text_id"][a])
                        second.append(c["text_id"][b])
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary())], ["a", "b"])

    return run


def remaining_links(now: DataFrame, distinct: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) that join all classes of ``now`` (key, text_id, label) between which some two texts of one bucket are similar."""
    by = ["key", "i", "j"]
    met = stored(block_pairs(now, sets), "met")
    light = met.join(sets.select("text_id", F.size("shingles").alias("n"), "bits"), "text_id")
    hopeful = light.groupBy(*by).agg(F.collect_list(F.struct("text_id", "label", "second", "n", "bits")).alias("members")).where(F.size("members") > 1)
    found = stored(hopeful.mapInArrow(_with_partners(similar), "key long, i int, j int, second boolean, text_id binary"), "partners")
    full = found.join(met.select(*by, "text_id", "label"), [*by, "text_id"]).join(sets.select("text_id", F.size("shingles").alias("n"), "bits", "shingles"), "text_id").join(distinct.select("text_id", "bands"), "text_id")
    grouped = full.groupBy(*by).agg(F.collect_list(F.struct("text_id", "label", "second", "n", "bits", "bands", "shingles")).alias("members"))
    return grouped.mapInArrow(_spanning(similar), "a binary, b binary")


def linked_classes(distinct: DataFrame, docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(node, label) of the texts that have a near-duplicate, from ``distinct`` (text_id, bands) and the texts in ``docs``."""
    bucket = Window.partitionBy("key")
    members = distinct.select("text_id", F.explode("bands").alias("key")).withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1")
    members = stored(members.select("key", "text_id"), "buckets")
    sets = stored(shingle_sets(docs, members, text), "sets")
    labels, now = None, members.withColumn("label", F.col("text_id"))
    for star in range(STARS + 1):
        if labels is not None:
            # Buckets that still hold several classes.
            labelled = members.join(labels.select(F.col("node").alias("text_id"), "label"), "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
            open_ = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
            now = stored(labelled.join(open_, "key"), "open")
        if star < STARS:
            # The hub of round one is of the least class, of the next of the greatest.
            pick = F.min if star % 2 == 0 else F.max
            hubs = now.groupBy("key").agg(pick(F.struct("label", "text_id")).alias("hub"))
            pairs = now.join(hubs, "key").where(F.col("label") != F.col("hub.label")).select(F.least("text_id", "hub.text_id").alias("a"), F.greatest("text_id", "hub.text_id").alias("b")).distinct()
            compared = stored(overlap(pairs, sets), "compared")
            fresh = compared.where(F.col("similarity") >= similar).select("a", "b")
        else:
            fresh = stored(remaining_links(now, distinct, sets, similar), "compared")
        labels = components(fresh) if labels is None else merged(labels, fresh)
    return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """doc_id, text_id, class_id (least doc id of the class), class_size, kept: one row per row of ``docs``.

    ``kept`` holds for the rows of the least (id, text_id) in a class, null ids
    last: one row, unless rows are equal in both.
    """
    rows = stored(sketches(docs, text, doc_id), "sketches")
    # The copies of a text sketch alike; a hot text is one row a task after partial aggregation.
    distinct = stored(rows.groupBy("text_id").agg(F.first("bands").alias("bands")), "distinct")
    labels = linked_classes(distinct, docs, text, similar)
    labelled = rows.select("doc_id", "text_id").join(labels.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_id")
    classes = labelled.groupBy("label").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("class_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    return labelled.join(classes, "label").select("doc_id", "text_id", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay: one of each class."""
    found = stored(near_duplicates(docs, text, doc_id, similar).select("doc_id", "text_id", "kept"), "near")
    gone = found.where("not kept").select(F.col("doc_id").alias("g_id"), F.col("text_id").alias("g_text")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    keyed = packed.withColumn("g_text_id", text_ids(F.col("__row")[text])).withColumn("g_doc_id", F.col("__row")[doc_id].cast("long"))
    stay = keyed.join(if_few(gone), F.col("g_doc_id").eqNullSafe(F.col("g_id")) & (F.col("g_text_id") == F.col("g_text")), "left_anti")
    if not found.where("kept").groupBy("doc_id", "text_id").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["g_doc_id", "g_text_id"])
    return stay.select("__row.*")
