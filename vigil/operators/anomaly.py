"""Isolation-forest anomaly channel (DET8), trained and scored on Spark.

Method: Liu, Ting & Zhou, "Isolation Forest" (ICDM 2008) -- ``n_trees``
random trees, each grown on ``sample_size`` rows with random axis splits up
to depth ceil(log2(sample_size)); the score of a row is
``-2 ** (-E[h(x)] / c(sample_size))`` (negative, more negative = more
anomalous), the convention the detection thresholds use.

Distribution:
* subsampling: a pool of about ``oversample * sample_size * n_trees`` rows
  (all, if there are fewer) by a hash of ``seq``; every tree draws from the
  whole pool on its own, by a hash of ``seq`` and tree, and keeps its
  ``sample_size`` lowest -- bounded groups, the same for any file layout;
* growing: ``groupBy(tree).applyInPandas`` -- one small group per tree;
* scoring: the fitted trees (a few thousand numbers) are broadcast and an
  Arrow ``pandas_udf`` scores each batch; no row leaves its partition.  A small
  forest can be scored as a column expression instead (``score_in_plan``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.scalars import safe_float

FEATURES = ["http_response_code", "response_time_ms", "load_val", "L_V1"]
TREE_SCHEMA = ("tree long, node long, feature int, threshold double, left long, right long, "
               "size long, depth int")


def feature_columns() -> list[Column]:
    """The four model features, float-cast with 0.0 for null/blank/bad (DET9)."""
    return [safe_float("http_status").alias("http_response_code"),
            safe_float("response_time_ms").alias("response_time_ms"),
            safe_float("load_val").alias("load_val"),
            safe_float("L_V1").alias("L_V1")]


def average_path(n: float) -> float:
    """c(n): average unsuccessful-search path length in a BST of n items."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(seed * 1_000_003 + tree)
    x = pdf[FEATURES].to_numpy(dtype=float)
    rows = []

    def build(idx: np.ndarray, depth: int) -> int:
        node = len(rows)
        rows.append(None)
        sub = x[idx]
        lo, hi = sub.min(axis=0) if len(idx) else None, sub.max(axis=0) if len(idx) else None
        splittable = [] if len(idx) <= 1 or depth >= max_depth else [f for f in range(x.shape[1]) if hi[f] > lo[f]]
        if not splittable:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(rng.choice(splittable))
        thr = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < thr
        rows[node] = (tree, node, f, thr, -1, -1, len(idx), depth)
        left = build(idx[mask], depth + 1)
        right = build(idx[~mask], depth + 1)
        rows[node] = (tree, node, f, thr, left, right, len(idx), depth)
        return node

    build(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


@dataclass
class IsolationForestModel:
    trees: pd.DataFrame        # TREE_SCHEMA rows
    sample_size: int

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` (<= 0) computed from the model features of ``df``."""
        spark = df.sparkSession
        per_tree = {}
        for t, g in self.trees.groupby("tree"):
            g = g.sort_values("node")
            per_tree[int(t)] = {
                "feature": g["feature"].to_numpy(np.int64), "threshold": g["threshold"].to_numpy(float),
                "left": g["left"].to_numpy(np.int64), "right": g["right"].to_numpy(np.int64),
                # path length charged at a leaf: its depth plus c(size) for the unsplit rest
                "leaf": g["depth"].to_numpy(float) + np.array([average_path(v) for v in g["size"]]),
            }
        bc = spark.sparkContext.broadcast(per_tree)
        norm = average_path(self.sample_size)

        @F.pandas_udf(T.DoubleType())
        def iforest_score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            x = np.column_stack([a.to_numpy(float), b.to_numpy(float), c.to_numpy(float), d.to_numpy(float)])
            total = np.zeros(len(x))
            for t in bc.value.values():
                feat, thr, left, right = t["feature"], t["threshold"], t["left"], t["right"]
                node = np.zeros(len(x), dtype=np.int64)
                active = feat[node] >= 0
                while active.any():
                    i = np.where(active)[0]
                    n = node[i]
                    go_left = x[i, feat[n]] < thr[n]
                    node[i] = np.where(go_left, left[n], right[n])
                    active = feat[node] >= 0
                total += t["leaf"][node]
            mean = total / max(len(bc.value), 1)
            return pd.Series(-np.power(2.0, -mean / norm) if norm > 0 else -np.ones(len(x)))

        feats = feature_columns()
        return df.withColumn("anomaly_score", iforest_score(*feats))


    def path_length(self) -> Column:
        """Mean path length over the trees as one expression of the model features: a CASE per tree."""
        feats, total = feature_columns(), F.lit(0.0)
        for _, tree in self.trees.groupby("tree"):
            rows = {int(r.node): r for r in tree.itertuples(index=False)}

            def walk(node: int, rows=rows) -> Column:
                r = rows[node]
                if r.feature < 0:
                    return F.lit(float(r.depth) + average_path(float(r.size)))
                return F.when(feats[int(r.feature)] < float(r.threshold), walk(int(r.left))).otherwise(walk(int(r.right)))
            total = total + walk(0)
        return total / max(self.trees["tree"].nunique(), 1)

    def score_in_plan(self, df: DataFrame, max_nodes: int = 2000) -> DataFrame:
        """``score`` without Python workers: the forest as a column expression, for forests of at most ``max_nodes`` nodes.

        Larger ones would not fit generated code; ``score`` takes them.
        """
        if len(self.trees) > max_nodes:
            raise ValueError(f"{len(self.trees)} nodes: a forest of more than {max_nodes} is scored by score()")
        norm = average_path(self.sample_size)
        return df.withColumn("anomaly_score", -F.pow(F.lit(2.0), -self.path_length() / norm) if norm > 0 else F.lit(-1.0))


def forest_of(rows: list[tuple], sample_size: int) -> IsolationForestModel:
    """A forest from (tree, node, feature, threshold, left, right, size, depth) rows; feature -1 marks a leaf."""
    names = [c.split()[0] for c in TREE_SCHEMA.split(", ")]
    return IsolationForestModel(pd.DataFrame(rows, columns=names), sample_size)


def _drawn(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` of its range."""
    return hashed < F.lit(int(-2**63 + share * 2**64)) if share < 1 else F.lit(True)


def fit_isolation_forest(df: DataFrame, n_trees: int = 100, sample_size: int = 256, seed: int = 42,
                         oversample: float = 4.0) -> IsolationForestModel:
    """Fit on the model features of ``df`` (normalized logs)."""
    feats = df.select(F.col("seq"), *feature_columns())
    total = feats.count()
    if total == 0:
        return IsolationForestModel(pd.DataFrame(columns=[
            "tree", "node", "feature", "threshold", "left", "right", "size", "depth"]), sample_size)
    psi = min(sample_size, total)
    wanted = int(oversample * psi * n_trees)
    pool = feats.where(_drawn(F.xxhash64("seq", F.lit(seed)), wanted / total))
    key = F.xxhash64("seq", "tree", F.lit(seed + 1))
    dealt = (pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)).cast("array<bigint>")))
             .withColumn("_h", key).where(_drawn(F.col("_h"), oversample * psi / min(total, wanted))))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "seq")))
    chosen = ranked.filter(F.col("_r") <= psi).select("tree", *FEATURES)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    trees = (chosen.groupBy("tree")
             .applyInPandas(lambda pdf: _grow(pdf, seed, max_depth), schema=TREE_SCHEMA)
             .toPandas())
    return IsolationForestModel(trees, psi)
