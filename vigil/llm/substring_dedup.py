"""Removal of passages that an earlier document has, found through difference-cover anchors.

D = {0, 1, 3} is a difference cover modulo 7: for any two positions there is a
shift below 7 that brings both into D.  So it is enough to hash ``width - 6``
words at the positions of a document that are in D modulo 7; two equal windows
of ``width`` words anywhere in two documents share such an anchor at the same
shift.  Anchors that occur in one document only drop out; the others are
extended: every window of ``width`` words that holds a shared anchor is hashed
whole and grouped, and each group's smallest document keeps it.  Words under a
window that a smaller document also has are removed, judged on the input.

Rows of a shuffle are two numbers (hash, document), sorted inside each
partition and read as a stream, so no group is held in memory.  Anchors that
are frequent in a sample of the documents (at most ``max_hot``, a bounded
broadcast) are known to be shared and skip the shuffle; the frequent windows
get their smallest document from a partial aggregate and skip it likewise, so a passage
that a third of all documents hold meets in no single task.

Defined cases: a null text has no words; documents with one ``doc_id`` do not
affect each other; a null ``doc_id`` comes after all others; texts shorter
than a window lose nothing; repeated rows give a row each; extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, utf8, window_hashes, word_ids

PERIOD, COVER = 7, (0, 1, 3)
LAST = 2**63 - 1  # stands for a null doc_id


def cover_positions(n: int) -> np.ndarray:
    """The positions below n whose remainder is in the cover."""
    return np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))


def anchors(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a document."""
    h = window_hashes(ids, width - PERIOD + 1)
    at = cover_positions(len(h)) if len(ids) >= width else np.empty(0, np.int64)
    return at, h[at]


def places(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash its place in the sorted ``table``, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def open_windows(ids: np.ndarray, width: int, shared: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Hashes of the windows that hold a shared or hot (sorted) anchor within their first PERIOD places."""
    at, own = anchors(ids, width)
    if not len(own):
        return own
    found = (places(np.sort(shared), own) >= 0) | (places(hot, own) >= 0)
    if not found.any():
        return own[:0]
    h = window_hashes(ids, width)
    mark = np.zeros(len(h) + PERIOD + 1, np.int64)
    mark[at[found] + 1] = 1
    run = np.cumsum(mark)
    return h[run[PERIOD:PERIOD + len(h)] - run[:len(h)] > 0]


def covered(gone: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words lie under one of the windows ``gone`` marks."""
    edge = np.zeros(n + 1, np.int64)
    hit = np.flatnonzero(gone)
    edge[hit] += 1
    edge[hit + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def hash_rows(docs: DataFrame, of: Callable, skip: np.ndarray | None = None) -> DataFrame:
    """(h, doc): the distinct hashes ``of(row)`` of every document, without those of ``skip``."""
    skipped = None if skip is None else docs.sparkSession.sparkContext.broadcast(skip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hs, ds, size = [], [], 0
            for k, row in enumerate(pdf.itertuples(index=False)):
                h = np.unique(of(row))
                if skipped is not None and len(skipped.value):
                    h = h[places(skipped.value, h) < 0]
                hs.append(h)
                ds.append(np.full(len(h), row.doc, np.int64))
                size += len(h)
                if size > 200_000 or k == len(pdf) - 1:
                    yield pd.DataFrame({"h": np.concatenate(hs).view(np.int64), "doc": np.concatenate(ds)})
                    hs, ds, size = [], [], 0

    return docs.mapInPandas(run, "h long, doc long")


def frequent(rows: DataFrame, max_hot: int) -> np.ndarray:
    """At most ``max_hot`` hashes that at least four documents of a sample share, the most frequent first."""
    top = (rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
           .where("a <> b and n >= 4").orderBy(F.desc("n"), "h").limit(max_hot).select("h").collect())
    return np.sort(np.array([r.h for r in top], np.int64).view(np.uint64))


def least_docs(rows: DataFrame, of: np.ndarray) -> DataFrame:
    """(h, doc): the smallest document of each hash in ``of``, one row per hash and batch of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, doc = (np.asarray(batch.column(k)) for k in (0, 1))
            at = places(shared.value, h.view(np.uint64))
            hit = np.flatnonzero(at >= 0)
            hit = hit[np.lexsort((doc[hit], at[hit]))]
            first = hit[np.concatenate(([True], at[hit][1:] != at[hit][:-1]))[:len(hit)]]
            yield pa.RecordBatch.from_arrays([pa.array(h[first], pa.int64()), pa.array(doc[first], pa.int64())], names=["h", "doc"])

    return rows.mapInArrow(run, "h long, doc long")


def streamed(keep_first: bool) -> Callable:
    """Over rows sorted by (h, doc): those of hashes that several documents have.

    ``keep_first``: the rows of the smallest document too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = first = None        # the hash of the row before and its smallest document
        waiting = False              # whether that document's row has not been given out yet
        for batch in batches:
            h, doc = (np.asarray(batch.column(k)) for k in (0, 1))
            if not len(h):
                continue
            if last_h is not None:
                h, doc = np.concatenate(([last_h], h)), np.concatenate(([first], doc))
            new = np.concatenate(([True], h[1:] != h[:-1]))
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            give = later = doc > doc[start][group]
            if keep_first:
                many = np.zeros(len(start), bool)
                many[group[later]] = True
                give = later.copy()
                give[start] = many
                if last_h is not None and not waiting:
                    give[0] = False
            carried = last_h is not None and start[-1] == 0
            waiting = not later[start[-1]:].any() and (waiting if carried else True)
            last_h, first = h[-1], doc[start[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(h[give], pa.int64()), pa.array(doc[give], pa.int64())], names=["h", "doc"])

    return run


def packed(rows: DataFrame) -> DataFrame:
    """(doc, hs): the hashes of each document in one binary; a document has as many as it has words at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_doc, parts = None, []
        for batch in batches:
            h, doc = (np.asarray(batch.column(k)) for k in (0, 1))
            if not len(h):
                continue
            cut = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]))
            docs, hs = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if doc[a] != open_doc and parts:
                    docs.append(open_doc)
                    hs.append(b"".join(parts))
                    parts = []
                open_doc = doc[a]
                parts.append(h[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hs, pa.binary())], names=["doc", "hs"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([open_doc], pa.int64()), pa.array([b"".join(parts)], pa.binary())],
                                             names=["doc", "hs"])

    return rows.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, "doc long, hs binary")


def remove_repeats(docs: DataFrame, width: int = 13, sample: int = 64, max_hot: int = 50_000) -> DataFrame:
    """doc_id, n_words, n_removed and the kept ``text`` (words joined by one space) per row of ``docs``.

    ``sample``: one document in so many is looked at for frequent anchors.
    """
    if width < PERIOD + 1:
        raise ValueError(f"a window must be longer than the period of the cover, {PERIOD}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = source.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    text = source.select("doc", "text").where("text is not null")
    sampled = F.pmod(F.xxhash64("doc"), F.lit(sample)) == 0

    def own_anchors(row):
        return anchors(word_ids(utf8(row.text)), width)[1]

    hot = frequent(hash_rows(text.where(sampled), own_anchors), max_hot)
    shared = scratch.write(hash_rows(text, own_anchors, hot).repartition("h").sortWithinPartitions("h", "doc")
                           .mapInArrow(streamed(True), "h long, doc long"), "anchors")
    hot_anchors = spark.sparkContext.broadcast(hot)

    def own_windows(row):
        own = np.frombuffer(row.hs or b"", np.uint64)
        return open_windows(word_ids(utf8(row.text)), width, own, hot_anchors.value)

    windows = scratch.write(hash_rows(text.join(packed(shared), "doc", "left"), own_windows), "windows")
    hot = frequent(windows.where(sampled), max_hot)
    known = F.broadcast(spark.createDataFrame([(int(h),) for h in hot.view(np.int64)], "h long"))
    least = least_docs(windows, hot).groupBy("h").agg(F.min("doc").alias("doc")).collect()
    least = sorted((r.h % 2**64, r.doc) for r in least)
    lead = spark.sparkContext.broadcast((np.array([h for h, _ in least], np.uint64), np.array([d for _, d in least], np.int64)))
    later = scratch.write(windows.join(known, "h", "left_anti").repartition("h").sortWithinPartitions("h", "doc")
                          .mapInArrow(streamed(False), "h long, doc long"), "repeats")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                raw = utf8(row.text)
                words = raw.split()
                kept, own, (hot_h, hot_doc) = words, np.frombuffer(row.hs or b"", np.uint64), lead.value
                if len(words) >= width and (len(own) or len(hot_h)):
                    h = window_hashes(word_ids(raw), width)
                    at = places(hot_h, h)
                    gone = places(np.sort(own), h) >= 0
                    if len(hot_h):
                        gone |= (at >= 0) & (hot_doc[at] < row.doc)
                    if gone.any():
                        kept = [w for w, g in zip(words, covered(gone, len(words), width).tolist()) if not g]
                rows.append((None if row.doc == LAST else row.doc, len(words), len(words) - len(kept),
                             b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "text"]).astype({"doc_id": "Int64"})

    return source.select("doc", "text").join(packed(later), "doc", "left").mapInPandas(
        cut, "doc_id long, n_words long, n_removed long, text string")
