"""Quality rules per document, and verdicts per host from shrunken failure rates.

The rules of a document are fixed counts over its words and lines.  Rule
failures are summed by host (``source``) with a partial aggregate, so a host
with a third of all rows is one row per task in the shuffle.  A beta prior is
fitted to all hosts by moments; each host's failure rate is shrunk towards it,
so a small host is judged by the prior.  Verdicts are joined back to the
documents.

Defined cases: a null text has no words and fails; a null ``source`` is a host
of its own; rows are judged one by one, so repeated rows count each and give a
row each; a null ``doc_id`` is carried through; other columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, utf8, window_hashes, word_ids

SYMBOLS = b"#*$%&|<>"
GAPS = b" \t\n\r\x0b\x0c"
STAGE = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(ids: np.ndarray, width: int = 5) -> int:
    """Words inside any window of ``width`` words that occurs twice or more in the text."""
    h = window_hashes(ids, width)
    if len(h) < 2:
        return 0
    _, where, count = np.unique(h, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[where] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
            text = text if isinstance(text, str) else ""
            raw = utf8(text)
            ids = word_ids(raw)
            lines = [x for x in raw.split(b"\n") if x.strip()]
            rows.append((doc_id, source, len(ids), len(text) - (len(raw) - len(raw.translate(None, GAPS))),
                         len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                         repeat_words(ids)))
        out = pd.DataFrame(rows, columns=["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                          "n_repeat_words"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def beta_prior(rates: DataFrame) -> tuple[float, float]:
    """(a, b) of a beta prior by moments over hosts: mean and the variance beyond sampling noise."""
    total, failed, hosts = rates.agg(F.sum("n"), F.sum("failed"), F.count(F.lit(1))).first()
    if not total:
        return 1.0, 1.0
    mean = min(max(failed / total, 1e-4), 1 - 1e-4)
    moments = rates.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.lit(mean), 2)) / total,
                        F.sum(F.col("n") * F.col("n")) / total).first()
    noise = mean * (1 - mean) * (hosts - 1) / total
    spread = (moments[0] - noise) / max(1 - (moments[1] / total), 1e-9)
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 1e4) if spread > 0 else 1e4
    return mean * strength, (1 - mean) * strength


def apply_rules(docs: DataFrame, min_words: int = 10, max_repeat_pct: int = 20, max_symbol_pct: int = 10,
                bad_host_rate: float = 0.5) -> DataFrame:
    """Rule counts, ``base_failed``, the host's shrunken rate and ``kept`` per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "host-rules")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = scratch.write(docs.select(F.col("doc_id").cast("long"), source.alias("source"), "text")
                         .mapInPandas(measure, STAGE), "rows")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    symbol = 100 * F.col("n_symbols") > max_symbol_pct * F.col("word_chars")
    rows = rows.withColumn("base_failed", base).withColumn("rule_failed", base | symbol)
    rates = scratch.write(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                                     F.sum(F.col("rule_failed").cast("long")).alias("failed")), "hosts")
    a, b = beta_prior(rates)
    hosts = rates.select(F.col("source").alias("_host"),
                         ((F.col("failed") + a) / (F.col("n") + a + b)).alias("host_rate"))
    out = rows.join(hosts, F.col("source").eqNullSafe(F.col("_host")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("host_rate") < bad_host_rate)).alias("kept"),
                      F.round("host_rate", 6).alias("host_rate"))
