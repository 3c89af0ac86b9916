"""Merkle manifest of a dataset, with leaf places from bitmap ranks.

Every row is a leaf: the SHA-256 of its fields.  Per group (``source``) the
leaves stand in ascending ``doc_id`` order and every three neighbours become
the hash of their concatenated digests until one node, the subroot, is left.
The subroots, in the order of their groups, become the root the same way.

Places come from bitmaps, not from sorting the leaves.  A group's bitmap is
compressed to the words of 64 ids that hold any: each task makes words of its
own rows and the shuffle merges them (``bit_or``).  Their popcounts add up to a
directory over 2**16, 2**30, 2**44 and 2**58 ids, so a running sum spans at
most 16,384 rows of one parent, however large the group.  The rank of an id is
the directory's start of its word and the popcount below its bit.

Digests then meet in keyed slot arrays: 3**7 neighbouring places are one row
and reduce seven levels at once, so a group of a third of all rows is spread
over its blocks.  On the way back down, a block hands each leaf the siblings of
its path, from which the leaf's proof and its own way up to the root are
computed.

Defined cases: a null field enters a leaf as ``-``; rows without an id come
first in their group and are never tampered with; the null group comes first;
rows that share an id within a group stand in the order of their digests
(places by ranges over those rows only; equal rows in any order, which changes
no result); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Scratch
from vigil.operators.indexing import dense_index
from vigil.operators.prefix import with_ordinal

ARITY, DEPTH = 3, 7
BLOCK = ARITY ** DEPTH
#: Bits of the directory's levels above a word of 64 ids; what is left (6 bits) are a group's top entries.
DIRECTORY = (10, 14, 14, 14)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 (hex) of the fields, each as its UTF-8 length, a colon and its value."""
    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[part(c) for c in fields.values()]), 256)


def without_line_breaks(fields: dict[str, Column]) -> Column:
    """The leaf after tampering, null for rows left alone: half of the ids lose the line breaks of their text."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, leaf_digest(fields | {"text": F.replace(fields["text"], F.lit("\n"), F.lit(""))}))


def starts(counts: DataFrame, bits: tuple[int, ...] = DIRECTORY) -> DataFrame:
    """(g, p, start) of ``counts`` (g, p, n): the sum of n over the smaller p of the same g, level by level."""
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    if not bits:
        total = F.sum("n").over(before.partitionBy("g"))
        return counts.select("g", "p", F.coalesce(total, F.lit(0)).alias("start"))
    children = counts.withColumn("up", F.shiftright("p", bits[0]))
    above = starts(children.groupBy("g", F.col("up").alias("p")).agg(F.sum("n").alias("n")), bits[1:])
    inside = children.withColumn("inside", F.coalesce(F.sum("n").over(before.partitionBy("g", "up")), F.lit(0)))
    return (inside.join(above.select("g", F.col("p").alias("up"), F.col("start").alias("above")), ["g", "up"])
            .select("g", "p", (F.col("above") + F.col("inside")).alias("start")))


def bitmap(ids: DataFrame) -> DataFrame:
    """(g, p, bits, n) of ``ids`` (g, id): the non-empty 64-id words of each group's bitmap, and their rows."""
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    return ids.groupBy("g", F.shiftright("id", 6).alias("p")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (uid, g, id, digest, ...) with ``place``: the number of rows of the same g before it, by (id, digest).

    ``uid`` tells rows apart; ``g`` is never null.
    """
    words = scratch.write(bitmap(rows.where("id is not null").select("g", "id")), "bitmap")
    nulls = rows.where("id is null").groupBy("g").agg(F.count(F.lit(1)).alias("nulls"))
    # ids that several rows share: their surplus counts too
    shared = scratch.write(
        rows.where("id is not null")
        .join(words.where("n > bit_count(bits)").select(F.col("g").alias("_g"), F.col("p").alias("_p")),
              (F.col("g") == F.col("_g")) & (F.shiftright("id", 6) == F.col("_p")), "left_semi")
        .groupBy("g", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    extra = shared.groupBy("g", F.shiftright("id", 6).alias("p")).agg(
        F.collect_list(F.struct(F.col("id").bitwiseAND(F.lit(63)).alias("bit"), (F.col("n") - 1).alias("more"))).alias("extra"))
    directory = scratch.write(
        words.join(starts(words.select("g", "p", "n")), ["g", "p"]).join(extra, ["g", "p"], "left").join(nulls, "g", "left")
        .select(F.col("g").alias("_g"), F.col("p").alias("_p"), "bits", "extra", (F.col("start") + F.coalesce("nulls", F.lit(0))).alias("start")),
        "directory")
    low = F.expr("bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int)))")
    more = F.expr("aggregate(filter(coalesce(extra, array()), x -> x.bit < (id & 63)), 0L, (a, x) -> a + x.more)")
    placed = (rows.join(directory, (F.col("g") == F.col("_g")) & (F.shiftright("id", 6) == F.col("_p")), "left")
              .withColumn("place", F.coalesce(F.col("start") + low + more, F.lit(0))))
    # among rows of one id, the order of their digests
    tied = (rows.where("id is null").select("uid", "g", "id", "digest").unionByName(
        rows.select("uid", "g", "id", "digest").join(shared.select("g", "id"), ["g", "id"], "left_semi")))
    if not tied.isEmpty():
        order = with_ordinal(tied, ["g", "id", "digest", "uid"], "at", f"{scratch.tag}-ties")
        first = order.groupBy("g", "id").agg(F.min("at").alias("first")).select(F.col("g").alias("_g"), F.col("id").alias("_id"), "first")
        order = (order.join(first, (F.col("g") == F.col("_g")) & F.col("id").eqNullSafe(F.col("_id")))
                 .select(F.col("uid").alias("_uid"), (F.col("at") - F.col("first")).alias("later")))
        placed = placed.join(order, F.col("uid") == F.col("_uid"), "left").withColumn("place", F.col("place") + F.coalesce("later", F.lit(0)))
    return placed.select(*rows.columns, F.col("place").cast("long").alias("place"))


def levels_of(n: int) -> int:
    """How many times n nodes become a third (rounded up) until one is left, at most DEPTH: those of one block."""
    k = 0
    while n > 1 and k < DEPTH:
        n, k = -(-n // ARITY), k + 1
    return k


def join_hash(parts: list[bytes]) -> bytes:
    """H of some digests: the SHA-256 of their hex texts."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def block_tree(slots: list[bytes], n: int) -> list[list[bytes]]:
    """The levels of a block, its leaves first; n: nodes of the whole level that the block is part of."""
    tree = [slots]
    for _ in range(levels_of(n)):
        row = tree[-1]
        tree.append([join_hash(row[k:k + ARITY]) for k in range(0, len(row), ARITY)])
    return tree


def paths(tree: list[list[bytes]], above: bytes) -> list[bytes]:
    """Per leaf of a block the siblings up to the root, level by level, given those above the block."""
    path = [above] * len(tree[-1])
    for row in reversed(tree[:-1]):
        path = [b"".join([*row[k - k % ARITY:k], *row[k + 1:k - k % ARITY + ARITY], path[k // ARITY]]) for k in range(len(row))]
    return path


def run_sizes(place: int, n: int) -> list[tuple[int, int]]:
    """(slot, nodes of the run) on each level from a leaf at ``place`` of n up to the top."""
    out = []
    while n > 1:
        out.append((place % ARITY, min(ARITY, n - place // ARITY * ARITY)))
        place, n = place // ARITY, -(-n // ARITY)
    return out


def fold(leaf: bytes, path: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The top that a leaf leads to, given the siblings of its path."""
    text, at = path.hex(), 0
    own = leaf.hex()
    for slot, size in runs:
        cut, end = at + 64 * slot, at + 64 * (size - 1)
        own = hashlib.sha256((text[at:cut] + own + text[cut:end]).encode()).hexdigest()
        at = end
    return bytes.fromhex(own)


def in_blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(g, n, block, items): the slot arrays of ``nodes`` (g, n, place, ``payload``), at most BLOCK slots each."""
    slot = (F.col("place") % BLOCK).cast("int").alias("slot")
    return (nodes.groupBy("g", F.floor(F.col("place") / BLOCK).cast("long").alias("block"))
            .agg(F.first("n").alias("n"), F.collect_list(F.struct(slot, *payload)).alias("items")))


def _items(batch: pa.RecordBatch, column: str) -> Iterator[tuple[list[int], pa.StructArray]]:
    """Per row of a batch its items in the order of their slots."""
    items = batch.column(column)
    flat, cut = items.flatten(), items.offsets.to_pylist()
    base = cut[0]
    slots = flat.field("slot").to_pylist()
    for a, b in zip(cut, cut[1:]):
        order = [0] * (b - a)
        for k in range(a - base, b - base):
            order[slots[k]] = k
        yield order, flat


def block_tops(blocks: DataFrame) -> DataFrame:
    """(g, n, place, digest): the node each block becomes, as a node of the next level up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, tops = batch.column("n").to_pylist(), []
            for n, (order, flat) in zip(ns, _items(batch, "items")):
                digest = flat.field("digest")
                tops.append(block_tree([digest[k].as_py() for k in order], n)[-1][0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), pa.array([-(-n // BLOCK) for n in ns], pa.int64()), batch.column("block"),
                 pa.array(tops, pa.binary())], names=["g", "n", "place", "digest"])

    return blocks.select("g", "n", "block", "items").mapInArrow(run, "g long, n long, place long, digest binary")


def handed_down(blocks: DataFrame) -> DataFrame:
    """(g, place, path) per node in ``blocks`` (with ``above``, the path of the block)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above, g, block = (batch.column(c).to_pylist() for c in ("above", "g", "block"))
            for k, (n, (order, flat)) in enumerate(zip(batch.column("n").to_pylist(), _items(batch, "items"))):
                digest = flat.field("digest")
                path = paths(block_tree([digest[i].as_py() for i in order], n), above[k])
                places = range(block[k] * BLOCK, block[k] * BLOCK + len(path))
                yield pa.RecordBatch.from_arrays([pa.array([g[k]] * len(path), pa.int64()), pa.array(places, pa.int64()),
                                                  pa.array(path, pa.binary())], names=["g", "place", "path"])

    return blocks.select("g", "n", "block", "items", "above").mapInArrow(run, "g long, place long, path binary")


def climb(nodes: DataFrame, largest: int, scratch: Scratch, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every pass over ``nodes`` (g, n, place, digest), and the tops (g, digest) of the groups."""
    passes: list[DataFrame] = []
    while not passes or largest > 1:
        passes.append(scratch.write(in_blocks(nodes, [c for c in nodes.columns if c not in ("g", "n", "place")]), f"{tag}-{len(passes)}"))
        nodes = scratch.write(block_tops(passes[-1]), f"{tag}-{len(passes)}-tops")
        largest = -(-largest // BLOCK)
    return passes, nodes.select("g", "digest")


def descend(passes: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first pass with ``above``, the siblings between each block and the root; ``tops``: (g, path) of the groups."""
    above = tops.select("g", F.lit(0).cast("long").alias("block"), F.col("path").alias("above"))
    for blocks in reversed(passes[1:]):
        above = handed_down(blocks.join(above, ["g", "block"])).select("g", F.col("place").alias("block"), F.col("path").alias("above"))
    return passes[0].join(above, ["g", "block"])


def manifest(docs: DataFrame, group: str = "source") -> DataFrame:
    """Per row doc_id, ``source`` and ``place`` (its coordinates), leaf, subroot, root, proof_sha256, folded_root and verified.

    ``proof_sha256``: H of the siblings from the leaf to the root.
    ``folded_root``: where the tampered leaf leads, given the siblings of the
    untampered tree (the leaf itself where it was left alone).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    fields = {c: F.col(c) for c in FIELDS}
    leaves = scratch.write(
        docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("id"), F.col(group).alias("label"),
                    F.unhex(leaf_digest(fields)).alias("digest"), F.unhex(without_line_breaks(fields)).alias("bent")), "leaves")
    sizes = leaves.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    groups = scratch.write(sizes.join(dense_index(sizes, "label").select(F.col("label").alias("_l"), F.col("idx").alias("g")),
                                      F.col("label").eqNullSafe(F.col("_l"))).select("label", "n", "g"), "groups")
    n_groups, largest = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    schema = ("doc_id long, source string, place long, leaf string, subroot string, root string, proof_sha256 string, "
              "folded_root string, verified boolean")
    if not n_groups:
        return spark.createDataFrame([], schema)
    rows = leaves.join(groups.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    placed = ranked(rows, scratch).select("g", "n", "place", "id", "digest", "bent")
    passes, tops = climb(placed, largest, scratch, "leaf")
    # the groups' tree: one group of its own
    upper, top = climb(tops.select(F.lit(0).cast("long").alias("g"), F.lit(n_groups).cast("long").alias("n"), F.col("g").alias("place"), "digest"),
                       n_groups, scratch, "group")
    root = top.first()["digest"]  # one digest
    down = handed_down(descend(upper, top.select("g", F.lit(b"").alias("path"))))
    paths_of = (tops.join(down.select(F.col("place").alias("g"), "path"), "g")
                .join(groups.select("g", "label"), "g").select("g", F.col("digest").alias("subroot"), "label", "path"))
    blocks = descend(passes, paths_of).join(paths_of.select("g", "subroot", "label"), "g")
    root = bytes(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            g, ns, block, above, label, subroot = (batch.column(c).to_pylist() for c in ("g", "n", "block", "above", "label", "subroot"))
            for k, (order, flat) in enumerate(_items(batch, "items")):
                flat = flat.take(pa.array(order))
                digest, bent = flat.field("digest").to_pylist(), flat.field("bent").to_pylist()
                path = paths(block_tree(digest, ns[k]), above[k])
                first = block[k] * BLOCK
                upper_runs = run_sizes(g[k], n_groups)
                folded = [fold(d if b is None else b, p, run_sizes(first + i, ns[k]) + upper_runs)
                          for i, (d, b, p) in enumerate(zip(digest, bent, path))]
                m = len(path)
                yield pa.RecordBatch.from_arrays([
                    flat.field("id"), pa.array([label[k]] * m, pa.string()), pa.array(range(first, first + m), pa.int64()),
                    pa.array([d.hex() for d in digest]), pa.array([subroot[k].hex()] * m), pa.array([root.hex()] * m),
                    pa.array([hashlib.sha256(p.hex().encode()).hexdigest() for p in path]),
                    pa.array([f.hex() for f in folded]), pa.array([f == root for f in folded])], names=names)

    return blocks.select("g", "n", "block", "items", "above", "label", "subroot").mapInArrow(run, schema)
