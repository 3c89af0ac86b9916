"""Quality score from preference pairs (Bradley-Terry), thresholded at a score quantile.

Each document has a score w . x over features of its text.  Training pairs
put a document labelled 1 over one labelled 0; the logistic loss on the
difference of their features gives w (no intercept: a constant cancels).  The
threshold is a quantile of the scores of all labelled training documents, the
one with the best balanced accuracy; the reported score is the logistic of the
distance to it, moved so that the threshold reads ``cut``.

Training uses only labels whose crc32(doc_id as text) mod 5 is not 0, and at
most ``max_labelled`` documents (half of each class, chosen by a hash of the
id); the threshold and all scores cover all documents.

Defined cases: a null text is scored as empty; null ids or labels, and ids
with contradicting labels, are not learned from; rows are scored one by one
(repeated rows alike); an id that is null is carried through and is not held
out; other columns are ignored.  Without labels of both classes every score
is 0.5.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, unused, utf8, word_ids, word_spans
from vigil.llm.host_rules import repeat_words

FEATURES = ("log_words", "distinct_words", "bigrams", "repeat5", "longest_run", "word_chars", "short_words", "symbols",
            "pipes", "bangs", "digits", "upper", "dup_lines", "line_words", "ends")
#: Characters counted by the three symbol features.
_SYMBOL, _PIPE, _BANG, _DIGIT = b"#*$%&<>@^~{}[]\\=_", b"|", b"!?", b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _share(raw: bytes, chars: bytes) -> float:
    return (len(raw) - len(raw.translate(None, chars))) / max(1, len(raw))


def text_features(text: str) -> list[float]:
    """The features of FEATURES; a text without words has zeros but for distinct shares of 1."""
    raw = utf8(text)
    spans = word_spans(raw)
    n = len(spans[0])
    if not n:
        return [0.0, 1.0, 1.0] + [0.0] * (len(FEATURES) - 3)
    w = word_ids(raw, spans)
    pairs = w[:-1] * np.uint64(31) + w[1:]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    change = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
    lengths = spans[1] - spans[0]
    return [float(np.log1p(n)), len(np.unique(w)) / n ** 0.75 if n > 20 else 1.0,
            len(np.unique(pairs)) / max(1, n - 1) if n > 1 else 1.0, repeat_words(w) / n,
            float(np.log1p(np.diff(change).max() - 1)), float(min(lengths.mean(), 30)), float((lengths <= 1).mean()),
            _share(raw, _SYMBOL), _share(raw, _PIPE), _share(raw, _BANG), _share(raw, _DIGIT), _share(raw, _UPPER),
            1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
            sum(x.rstrip()[-1:] in b".!?:;\"" for x in lines) / len(lines)]


def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        x = [text_features(t) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_hash": pdf["text_hash"], "x": x})


def fit_pairs(good: np.ndarray, bad: np.ndarray, per_row: int = 4, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """w that minimizes the mean logistic loss of -(good - bad) . w plus a ridge, by Newton steps."""
    n = max(len(good), len(bad))
    order = np.random.default_rng(0)
    d = np.concatenate([good[order.permutation(n) % len(good)] - bad[order.permutation(n) % len(bad)]
                        for _ in range(per_row)])
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 4 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def quantile_threshold(pooled: list[float], bad: list[float], good: list[float]) -> float:
    """The pooled score quantile with the best balanced accuracy; between equal ones, the middle."""
    t = np.unique(np.asarray(pooled))
    value = (np.searchsorted(np.asarray(bad), t, "left") / len(bad)
             + 1 - np.searchsorted(np.asarray(good), t, "left") / len(good))
    best = t[value >= value.max() - 1e-9]
    below = t[t < best[0]]
    return float((best[0] + (below[-1] if len(below) else best[0])) / 2) if len(best) == 1 else float((best[0] + best[-1]) / 2)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, cut: float = 0.3) -> DataFrame:
    """doc_id, text_hash, held_out, score in 0 .. 1 and predicted (score >= ``cut``) per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
                         .mapInPandas(featurize, "doc_id long, text_hash long, x array<double>"), "features")
    known = (labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long"))
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).where("quality = _q").drop("_q")
             .where(~held_out()))
    train = scratch.write(rows.join(known, "doc_id").select("doc_id", "quality", "x"), "train")
    pick = [train.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled // 2)
            .select("x").toPandas()["x"] for q in (0, 1)]
    out = rows.withColumn("held_out", held_out())
    if not len(pick[0]) or not len(pick[1]):
        return out.select("doc_id", "text_hash", "held_out", F.lit(0.5).alias("score"), F.lit(int(0.5 >= cut)).alias("predicted"))
    bad, good = (np.stack([np.asarray(v, float) for v in p]) for p in pick)
    both = np.concatenate([bad, good])
    scale = both.std(0) + 1e-6
    w = fit_pairs(good / scale, bad / scale) / scale

    def raw(x: str):
        return sum((F.col(x)[k] * float(v) for k, v in enumerate(w)), F.lit(0.0))

    at = F.lit([k / 1000 for k in range(1001)])
    r = train.select("quality", raw("x").alias("r"))
    q = r.agg(F.percentile_approx("r", at, 100_000), F.percentile_approx(F.when(F.col("quality") == 0, F.col("r")), at, 100_000),
              F.percentile_approx(F.when(F.col("quality") == 1, F.col("r")), at, 100_000)).first()
    t = quantile_threshold(*q)
    shift = float(np.log(cut / (1 - cut)))
    score = 1 / (1 + F.exp(-(raw("x") - t + shift)))
    return (out.withColumn("score", score)
            .select("doc_id", "text_hash", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted")))


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted per row of ``docs``."""
    return score_rows(docs, labels, **options).drop("text_hash")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose own score reaches the threshold; rows of one id and text have one score."""
    names = docs.columns
    own, th, bad_id, bad_th = unused(docs, "_id", "_th", "_bad", "_bad_th")
    bad = (score_rows(docs, labels, **options).where("predicted = 0")
           .select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_th)).distinct())
    return (docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(th, F.xxhash64("text"))
            .join(bad, F.col(own).eqNullSafe(F.col(bad_id)) & (F.col(th) == F.col(bad_th)), "left_anti").select(*names))
