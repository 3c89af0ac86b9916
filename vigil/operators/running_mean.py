"""The running edge mean (GRF10): each step rounded, missing latencies counted but not added.

Per edge, in ``seq`` order: the k-th row with a latency r >= 0 makes the mean
``round((mean * (k - 1) + r) / k, 2)``; k counts every row of the edge.  The
result depends on the order and cannot be merged from parts, so rows are dealt
by edge, sorted inside their partition and folded as a stream: the state is one
edge, one count and one mean, carried from batch to batch.  All rows of an edge
pass through one task: its time grows with the largest edge (about a
microsecond a row), its memory does not.  ``graph_edges`` has the plain mean,
which is combined map-side and has no such limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ["source", "target", "count", "running_mean"]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edge, count, mean = None, 0, 0.0
    for batch in batches:
        done = []
        for source, target, latency in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
            if (source, target) != edge:
                if edge is not None:
                    done.append((*edge, count, mean))
                edge, count, mean = (source, target), 0, 0.0
            count += 1
            if latency is not None and latency >= 0:
                mean = round((mean * (count - 1) + latency) / count, 2)
        if done:
            yield _batch(done)
    if edge is not None:
        yield _batch([(*edge, count, mean)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=NAMES)


def edge_running_mean(graph_logs: DataFrame) -> DataFrame:
    """(source, target, count, running_mean) per edge of the graph logs."""
    rows = graph_logs.where((F.col("source_node") != "") & (F.col("target_node") != "")).select(
        F.col("source_node").alias("source"), F.col("target_node").alias("target"), F.col("response_time_ms").cast("long").alias("latency"), "seq")
    return (rows.repartition("source", "target").sortWithinPartitions("source", "target", "seq").select("source", "target", "latency")
            .mapInArrow(_fold, "source string, target string, count long, running_mean double"))
