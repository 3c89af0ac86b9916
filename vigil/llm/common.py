"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import configure, ensure_checkpoint_dir

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Stage tables of one operator run, in a folder of its own under ``spark.checkpoint.dir``.

    A written stage cuts the lineage: a lost executor costs a reread, not a
    recomputation, and the shuffle files behind the stage can go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = configure(spark)
        self.tag = f"llm/{name}-{uuid.uuid4().hex[:12]}"
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.tag}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer on uint64 arrays (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


_GAP = np.zeros(256, bool)
_GAP[list(b" \t\n\r\x0b\x0c")] = True
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _STEP and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, step in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a UTF-8 text, in bytes."""
    inside = ~_GAP[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


_BYTES_LEFT = np.array([0] + [2 ** (8 * k) - 1 for k in range(1, 9)], np.uint64)


def word_ids(raw: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit id per word of a UTF-8 text, the same on every machine.

    A word is read eight bytes at a time; each piece is mixed with its place
    before the pieces are added up, so no pattern of letters cancels out.  Words
    of one length of at most eight bytes never share an id; others do by chance only.
    """
    start, end = spans or word_spans(raw)
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    place = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
    at = np.repeat(start, n) + 8 * place
    left = np.minimum(np.repeat(end, n) - at, 8)
    eight = np.ndarray(len(raw) + 1, "<u8", raw + b"\0" * 8, strides=(1,))  # the eight bytes from any place on
    with np.errstate(over="ignore"):
        mixed = mix64((eight[at] & _BYTES_LEFT[left]) + (place + 1).astype(np.uint64) * np.uint64(_STEP))
        return mix64(np.add.reduceat(mixed, first) + size.astype(np.uint64) * _MIX1)


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` consecutive ids; element p covers p .. p + width - 1."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(ids))
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix64(ids) * up, out=total[1:])
    return mix64((total[width:] - total[:-width]) * down[:n])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given names, each with underscores added until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``links`` (a, b).

    Contraction: in a round every node goes to the first of itself and its
    neighbours, and the links between the nodes gone to are the next, smaller
    graph, until no link is left.  The first two rounds take the order of the
    ids, which settles groups linked to their smallest node; later ones take an
    order drawn anew by a hash, in which a round leaves at most three quarters
    of the nodes on average, whatever the shape and the ids.  So the rounds
    grow with the logarithm of the nodes and need no bound; each takes at least
    one node away.  Every round is written to the shared folder.  A node with
    very many links is spread by the partial aggregate, and AQE splits its join.
    """
    links = scratch.write(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                          .where("a <> b").distinct(), f"{tag}-links")
    steps: list[DataFrame] = []
    while not steps or not links.isEmpty():
        k = len(steps)
        if k < 2:
            step = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        else:
            first = F.min(F.struct(F.xxhash64(F.lit(k), "b").alias("h"), F.col("b").alias("to")))
            own = F.struct(F.xxhash64(F.lit(k), "node").alias("h"), F.col("node").alias("to"))
            step = (links.groupBy(F.col("a").alias("node")).agg(first.alias("near"))
                    .select("node", F.least("near", own)["to"].alias("to")))
        step = scratch.write(step, f"{tag}-{k}")
        steps.append(step)
        left, right = (step.select(F.col("node").alias(f"_{c}"), F.col("to").alias(f"to_{c}")) for c in "ab")
        links = scratch.write(links.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
                              .where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(),
                              f"{tag}-links-{k}")
    labels = steps[-1].select("node", F.col("to").alias("component"))
    for k in range(len(steps) - 2, -1, -1):  # what a node went to may have gone on
        later = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        labels = scratch.write(steps[k].join(later, F.col("to") == F.col("_n"), "left")
                               .select("node", F.coalesce("_c", "to").alias("component")), f"{tag}-labels-{k}")
    if len(steps) <= 2:
        return labels  # in the order of the ids the last node of a component is its smallest
    low = labels.groupBy(F.col("component").alias("_c")).agg(F.min("node").alias("low"))
    return scratch.write(labels.join(low, F.col("component") == F.col("_c"))
                         .select("node", F.col("low").alias("component")), f"{tag}-labels")
