"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, the least
and the greatest image, so half the hash evaluations make a signature.
Signatures are cut into bands; documents that share a band are candidates.
With the default 24 bands of 4 values (48 permutations) a pair at similarity
0.8 shares no band with probability 3e-6.

Documents with equal sets are one node (the smallest id stands for them), so
copies are never paired.  Within a band candidates are not paired all with
all: every node is compared with the smallest node of its band, then with one
node of another component there, twice.  Pairs inside one component need no
check, as they change nothing.  A node with so many shingles of its own that
it cannot be similar to any other drops out.  What still differs in component
within a band is compared whole, in blocks of bounded size spread over the
tasks, and only links leave a block, one for a node and a component.  All
links are confirmed with the whole sets; nothing is capped.

Defined cases: a null text or a text without words has an empty set and is
linked with nothing; fewer words than a shingle make one shingle; rows with
one ``doc_id`` count as one document in linking and get a row each; rows with
a null ``doc_id`` are linked with nothing and are kept; extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, components, mix64, unused, utf8, window_hashes, word_ids


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, its letters A-Z in lower case."""
    w = word_ids(utf8(text).lower())  # bytes.lower changes A-Z alone
    if not len(w):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(w, min(width, len(w))))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least and greatest image of the set under each permutation, side by side."""
    out = np.empty(2 * len(a), np.uint64)
    least, most = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[None, at:at + 2048] * a[:, None] + b[:, None]
            part ^= part >> np.uint64(32)
            part *= a[:, None]
            least, most = np.minimum(least, part.min(1)), np.maximum(most, part.max(1))
    out[0::2], out[1::2] = least, most
    return out


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (fingerprint of the set) and the band keys of every row."""
    if bands * rows % 2:
        raise ValueError("bands * rows must be even: a permutation gives two values")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        rng = np.random.default_rng(20240229)
        a = rng.integers(0, 2**63, bands * rows // 2, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows // 2, np.uint64)
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingle_set(text, width)
                if not len(s):
                    out.append((doc_id, 0, None, None, None))
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                key = window_hashes(mix64(signature(s, a, b)), rows)[::rows][:bands]
                out.append((doc_id, len(s), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63,
                            mix64(key + salt).view(np.int64)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "s1", "s2", "bands"])
            yield frame.astype({"doc_id": "Int64", "s1": "Int64", "s2": "Int64"})

    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node (doc_id) and its whole set, for the nodes that need a check."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at:at + 500]
                yield pd.DataFrame({"node": part["node"], "s": [shingle_set(t, width).view(np.int64) for t in part["text"]]})

    return docs.select("node", "text").mapInPandas(run, "node long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union|."""
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), \
        sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    # the sizes alone rule out pairs without looking at the members
    near = (100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    return both.where(near).where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def nodes_of(member: DataFrame) -> DataFrame:
    return member.join(mixed_bands(member), "band").select("node").distinct()


def mixed_bands(member: DataFrame) -> DataFrame:
    """The bands whose nodes belong to several components, with their numbers of nodes."""
    return (member.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"),
                                       F.count(F.lit(1)).alias("size")).where("c1 <> c2").select("band", "size"))


def hopeless(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes that no other of ``nodes`` can be similar to: too many shingles that are theirs alone.

    With u such shingles of n, intersections have at most n - u members and unions at least n.
    """
    own = sets.join(nodes, "node")
    alone = (own.select("node", F.explode("s").alias("x")).groupBy("x")
             .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
             .groupBy("node").agg(F.count(F.lit(1)).alias("u")))
    n = F.size("s")
    return own.join(alone, "node").where(100 * (n - F.col("u")) < percent * n).select("node")


def block_links(now: DataFrame, sets: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """Links between components within each band of (band, node, component, size).

    The nodes of a band are dealt to blocks of about ``block``; each pair of
    blocks is one group, so a large band is many tasks of bounded size.
    """
    blocks = F.ceil(F.col("size") / block).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(11)), blocks)
    dealt = (now.select("band", "node", "component", own.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
             .select("band", "node", "component", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return links_between(pdf, percent)

    return (dealt.join(sets, "node").groupBy("band", "i", "j").applyInPandas(compare, "a long, b long").distinct())


def links_between(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For every node outside the largest component one link to each other component it is similar to."""
    node, comp = pdf["node"].to_numpy(), pdf["component"].to_numpy()
    values, counts = np.unique(comp, return_counts=True)
    out: set[tuple[int, int]] = set()
    if len(values) > 1:
        size = np.fromiter(map(len, pdf["s"]), np.int64, len(pdf))
        every, owner = np.concatenate(pdf["s"].to_list()), np.repeat(np.arange(len(pdf)), size)
        order = np.argsort(every, kind="stable")
        owner, (_, start, times) = owner[order], np.unique(every[order], return_index=True, return_counts=True)
        rank = np.empty(len(every), np.int64)
        rank[order] = np.repeat(np.arange(len(start)), times)
        ends = np.cumsum(size)
        for k in np.flatnonzero(comp != values[counts.argmax()]):
            mine = rank[ends[k] - size[k]:ends[k]]
            mine = mine[times[mine] > 1]
            if not len(mine):
                continue
            common = np.bincount(np.concatenate([owner[start[r]:start[r] + times[r]] for r in mine]), minlength=len(pdf))
            near = np.flatnonzero((100 * common >= percent * (size[k] + size - common)) & (comp != comp[k]))
            if len(near):
                _, first = np.unique(comp[near], return_index=True)
                out |= {(min(node[k], node[y]), max(node[k], node[y])) for y in near[first]}
    return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "minmax")
    sig = scratch.write(signatures(docs, width, bands, rows), "signatures")
    classes = (sig.where("doc_id is not null and n_shingles > 0").groupBy("s1", "s2", "n_shingles")
               .agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")))
    band = classes.select("node", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    # membership of the bands that several nodes share; everything below works on these
    member = scratch.write(band.join(shared, "band").select("band", "node", "lo").distinct(), "members")
    nodes = member.select("node").distinct()
    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node")
    sets = scratch.write(shingle_sets(chosen, width), "sets")
    copies = sig.select("doc_id", "s1", "s2", "n_shingles").where("doc_id is not null and n_shingles > 0").join(
        classes.select("s1", "s2", "n_shingles", "node"), ["s1", "s2", "n_shingles"])
    checked = scratch.write(member.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct(),
                            "pairs-0")
    links = scratch.write(confirmed(checked, sets, percent), "links-0")
    label = components(links, scratch, "comp-0")
    for k in (1, 2, 3):
        now = member.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        if k == 3:
            now = now.join(hopeless(nodes_of(now), sets, percent), "node", "left_anti")
        now = scratch.write(now.join(mixed_bands(now), "band"), f"mixed-{k}")
        if k < 3:  # against one node of another component: linear in the members
            order = F.xxhash64("node", F.lit(k))
            centre = now.groupBy("band").agg(
                F.min_by("node", order).alias("n1"), F.min_by("component", order).alias("m1"))
            pairs = (now.join(centre, "band").where("component <> m1")
                     .select(F.least("n1", "node").alias("a"), F.greatest("n1", "node").alias("b")))
            pairs = scratch.write(pairs.distinct().join(checked, ["a", "b"], "left_anti"), f"pairs-{k}")
            checked = scratch.write(checked.union(pairs), f"checked-{k}")
            found = scratch.write(confirmed(pairs, sets, percent), f"links-{k}")
        else:
            found = scratch.write(block_links(now, sets, percent), f"links-{k}")
        if not found.isEmpty():
            links = scratch.write(links.union(found), f"all-{k}")
            label = components(links, scratch, f"comp-{k}")
    # ids of rows with one id are one document: their classes meet in that id
    ids = scratch.write(copies.join(label, "node", "left")
                        .select("doc_id", F.coalesce("component", "node").alias("component"))
                        .groupBy("doc_id").agg(F.min("component").alias("component")), "ids")
    out = sig.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one document of each group stays.

    Of rows with one id those that equal the id of the component stay.
    """
    names = docs.columns
    own, other = unused(docs, "_id", "_gone")
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(other)).distinct()
    return (docs.withColumn(own, F.col("doc_id").cast("long"))
            .join(gone, F.col(own).eqNullSafe(F.col(other)), "left_anti").select(*names))
