"""The trie of conversation prefixes, by fixed-length block hashing.

A prefix of d turns is known by d and 128 bits: the XOR of the hashes of its
turns and their places. Conversations are first grouped by whole blocks of
``BLOCK`` turns: equal blocks behind equal prefixes become one row, whatever
their number. A block that is the only one behind its prefix is a chain, and its
turns are nodes with the block's members; only blocks with siblings are taken
apart by their turns, once for each distinct block.

Sums over subtrees don't walk the trie level by level. Every leaf stands for one
path; a node belongs to the least leaf below it, so each leaf owns the lower end
of its path. A subtree's sum is then the sum of what the leaves through the node
own, less what the node's own leaf owns above it.

Skew: turns are numbered by ranges of (conversation, turn), so a conversation
of very many turns falls into many ranges; running values go by chunks and then
over the chunks; parents of very many children are broadcast, of which there are
at most ``HOT`` by the way they are chosen. Digests of members go through the ids
in order, as a stream of chunks, and hold no list of them.

Turns with a null number come first; of equal numbers the lesser (role, text)
comes first. Null roles and texts are empty. Repeated rows are repeated turns.
Rows of no conv_id belong to no conversation. Without conversations there is no
node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK, CHUNK, HOT, IDS = 4, 4096, 1000, 4096
FAMILY, SHARED = 5, 9
NODE = ["depth", "px", "py"]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and hash the turns of a sorted range."""
    last, at = None, 0
    for batch in batches:
        conv, part, role, text = (batch.column(i) for i in range(4))
        place, digest = np.zeros(batch.num_rows, np.int64), []
        for i, (c, r, t) in enumerate(zip(conv.to_pylist(), role, text)):
            at = at + 1 if c == last else 0
            last, place[i] = c, at
            r, t = r.as_py(), t.as_py()
            digest.append(hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest())
        both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        size = pc.binary_length(text).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([conv, part, pa.array(place), pa.array(both[:, 0]), pa.array(both[:, 1]), size], ["c", "part", "at", "u", "v", "bytes"])


def turns(conversations: DataFrame) -> DataFrame:
    """(c, at, u, v, bytes): each turn's place in its conversation, hash and length."""
    plain = conversations.select(F.col("conv_id").cast("long").alias("c"), "turn", *[F.coalesce(F.col(n), F.lit("")).cast("binary").alias(n) for n in ("role", "text")]).where("c IS NOT NULL")
    ranged = plain.repartitionByRange("c", "turn").sortWithinPartitions("c", "turn", "role", "text")
    local = stored(ranged.select("c", F.spark_partition_id().alias("part"), "role", "text").mapInArrow(_hashed, "c long, part int, at long, u long, v long, bytes long"), "turns")
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first conversation of a range may have begun in an earlier one.
    begun = local.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before > 0").select("c", "part", "before")
    return local.join(F.broadcast(begun), ["c", "part"], "left").select("c", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "u", "v", "bytes")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, p, x, y, bytes) of the rebuilt conversations' turns, with hashes of turn and place; and (c, length) of every conversation.

    A conversation begins with the first h turns of its family's first one, and goes on with its own after its first h.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % SHARED
    lengths = own.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    first = lengths.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = lengths.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base")).join(first, "base", "left")
    convs = stored(convs.select("c", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent")), "conversations")
    rest = own.join(convs.select("c", "h", "lent"), "c").where("at >= h").select("c", (F.col("at") - F.col("h") + F.col("lent")).alias("p"), "u", "v", "bytes")
    head = own.where(F.col("at") < SHARED - 1).withColumnRenamed("c", "base").join(convs.where("lent > 0").select("c", "base", "lent"), "base").where("at < lent").select("c", F.col("at").alias("p"), "u", "v", "bytes")
    both = rest.unionByName(head)
    hashed = both.select("c", "p", F.xxhash64("p", "u", "v").alias("x"), F.xxhash64(F.lit(1), "p", "u", "v").alias("y"), "bytes")
    return hashed, convs.select("c", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def running(df: DataFrame, key: str, order: str, values: dict[str, str], fold, join) -> DataFrame:
    """``df`` with columns (new name: column) that fold a column over the rows of the key that come before, chunk by chunk and then over the chunks; ``order`` counts from 0."""
    chunked = df.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    inside = Window.partitionBy(key, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(key, "chunk").agg(*[fold(c).alias(f"t_{name}") for name, c in values.items()])
    totals = totals.select(key, "chunk", *[fold(f"t_{name}").over(whole).alias(f"t_{name}") for name in values]).where("chunk > 0")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    local = chunked.withColumns({name: zero(fold(c).over(inside)) for name, c in values.items()}).join(totals, [key, "chunk"], "left")
    return local.select(*df.columns, *[join(F.col(name), zero(F.col(f"t_{name}"))).alias(name) for name in values])


def blocks(hashed: DataFrame) -> DataFrame:
    """(c, b, x, y, turns, bx, by): the blocks of each conversation, their own hash, their turns (p, x, y, bytes) in order, and the prefix before them."""
    turn = F.struct("p", "x", "y", "bytes")
    found = hashed.groupBy("c", F.floor(F.col("p") / BLOCK).alias("b")).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return running(found, "c", "b", {"bx": "x", "by": "y"}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def _nodes_of_block() -> Column:
    """The nodes along a block: depth, prefix, prefix of the parent, bytes of the last turn."""
    kind = "array<struct<depth:long,px:long,py:long,qx:long,qy:long,bytes:long>>"
    last = lambda a: F.element_at(a, -1)

    def step(a: Column, t: Column) -> Column:
        qx, qy = F.when(F.size(a) == 0, F.col("bx")).otherwise(F.get(a, F.size(a) - 1)["px"]), F.when(F.size(a) == 0, F.col("by")).otherwise(F.get(a, F.size(a) - 1)["py"])
        node = F.struct((t["p"] + 1).alias("depth"), qx.bitwiseXOR(t["x"]).alias("px"), qy.bitwiseXOR(t["y"]).alias("py"), qx.alias("qx"), qy.alias("qy"), t["bytes"].alias("bytes"))
        return F.concat(a, F.array(node)).cast(kind)

    return F.aggregate("turns", F.array().cast(kind), step)


def nodes(cut: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, px, py, qx, qy, bytes, n_convs, conv_id) of every node; root included."""
    # Equal blocks behind equal prefixes are one row from here on.
    same = cut.groupBy("b", "bx", "by", "x", "y", "turns").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("conv"))
    same = stored(same, "blocks")
    behind = same.groupBy("b", "bx", "by").agg(F.count(F.lit(1)).alias("k"), F.first(F.struct("x", "y", "turns", "n", "conv")).alias("only"))
    chain = behind.where("k = 1").select("b", "bx", "by", "only.*")
    # By the block as well as the prefix, so a prefix that very many blocks follow is no hot key.
    split = same.join(chain.select("b", "bx", "by", "x", "y"), ["b", "bx", "by", "x", "y"], "left_anti")
    spread = lambda df: df.select("n", "conv", F.explode(_nodes_of_block()).alias("d")).select("d.*", F.col("n").alias("n_convs"), F.col("conv").alias("conv_id"))
    refined = spread(split).groupBy(*NODE).agg(*[F.first(c).alias(c) for c in ("qx", "qy", "bytes")], F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*NODE, "qx", "qy", "bytes")], "n_convs", "conv_id")
    return spread(chain).unionByName(refined).unionByName(root)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (depth, px, py, c), sorted: the ids of a node, joined, ``IDS`` at most a row."""
    names = ["depth", "px", "py", "c", "ids"]
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        key = np.stack(columns[:3])
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        starts = np.flatnonzero(new)
        starts = np.unique(np.concatenate([np.arange(a, b, IDS) for a, b in zip(starts, np.append(starts[1:], len(new)))]).astype(np.int64))
        ids = [",".join(map(str, columns[3][a:b].tolist())) for a, b in zip(starts, np.append(starts[1:], len(new)))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in columns), pa.array(ids)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, over its chunks in order."""
    now, state = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield batch_of(done)
    if now is not None:
        yield batch_of([(now, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, px, py, ends_sha256) from (depth, px, py, c): a hot node's ids are spread over ranges, joined there, and then streamed."""
    chunks = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c").mapInArrow(_chunks, "depth long, px long, py long, c long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInArrow(_digests, "depth long, px long, py long, ends_sha256 string")


def with_parents(found: DataFrame, children: DataFrame, rows: int) -> DataFrame:
    """``found`` with ``parent_conv_id``. Parents of more than rows / ``HOT`` children, of which there are fewer than ``HOT``, are broadcast."""
    own = found.select((F.col("depth") + 1).alias("depth"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("conv_id").alias("parent_conv_id"))
    key = ["depth", "qx", "qy"]
    many = children.where(F.col("n_children") > max(1000, rows // HOT)).select((F.col("depth") + 1).alias("depth"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    hot = F.broadcast(own.join(F.broadcast(many), key, "left_semi"))
    near, rest = found.join(hot, key), found.join(hot.select(*key), key, "left_anti").join(own, key, "left")
    columns = [*found.columns, "parent_conv_id"]
    return near.select(*columns).unionByName(rest.select(*columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    hashed, lengths = rebuilt(turns(conversations))
    cut = stored(blocks(hashed), "cut")
    found = stored(nodes(cut, lengths), "nodes")
    above = F.col("depth") > 0
    children = stored(found.where(above).groupBy((F.col("depth") - 1).alias("depth"), F.col("qx").alias("px"), F.col("qy").alias("py")).agg(F.count(F.lit(1)).alias("n_children")), "children")

    # Leaves: their least member's path goes through all nodes above them.
    leaves = stored(found.join(children, NODE, "left_anti").select("conv_id", "depth"), "leaves")
    paths = cut.join(leaves.where(above).select(F.col("conv_id").alias("c")), "c", "left_semi")
    along = paths.select("c", F.explode(_nodes_of_block()).alias("d")).select("c", *[f"d.{n}" for n in NODE])
    zero = F.lit(0).cast("long")
    through = along.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_leaves"), F.min("c").alias("owner"))
    top = leaves.agg(F.count(F.lit(1)).alias("n_leaves"), F.min("conv_id").alias("owner")).where("n_leaves > 0").select(*[zero.alias(c) for c in NODE], "n_leaves", "owner")
    owned = found.join(through.unionByName(top), NODE).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
    owned = stored(running(owned, "owner", "depth", {"above": "own"}, F.sum, lambda a, b: a + b), "owned")
    totals = owned.groupBy(F.col("owner").alias("c")).agg(F.sum("own").alias("total"))
    sums = paths.join(totals, "c").select("total", F.explode(_nodes_of_block()).alias("d")).groupBy(*[F.col(f"d.{n}").alias(n) for n in NODE]).agg(F.sum("total").alias("below"))
    sums = sums.unionByName(totals.agg(F.sum("total").alias("below")).where("below IS NOT NULL").select(*[zero.alias(c) for c in NODE], "below"))

    # Where conversations end.
    ended = cut.groupBy("c").agg(F.max("b").alias("b"), F.max_by(F.element_at(_nodes_of_block(), -1), "b").alias("d"))
    ends = lengths.join(ended, "c", "left").select(*[F.coalesce(F.col(f"d.{n}"), zero).alias(n) for n in NODE], "c")
    digests = end_digests(ends)

    parents = with_parents(owned, children, found.count())
    all_ = parents.join(sums, NODE).join(children, NODE, "left").join(digests, NODE, "left")
    return all_.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("below") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
