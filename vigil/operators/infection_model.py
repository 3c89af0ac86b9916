"""Node infection probability from a boosted-tree classifier (ATT5, ATT6).

Per-node features (mean/max latency, log count, error count) are one
``groupBy(node)`` aggregate; the label is the registry's ``is_infected``.
MLlib's ``GBTClassifier`` trains distributed; ``vector_to_array`` extracts
P(infected) as a plain column for the attribution blend
``0.6 * p + 0.4 * heuristic``.  Nodes join on the canonical node id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.attribution import node_features
from vigil.operators.sizing import written_table

FEATURES = ["avg_response_time", "max_response_time", "log_count", "error_count"]


def training_frame(detected: DataFrame, registry: DataFrame) -> DataFrame:
    feats = node_features(detected).na.fill(0.0, FEATURES)
    labels = registry.select("node_id", F.coalesce(F.col("is_infected"), F.lit(False)).cast("double").alias("label"))
    return feats.join(labels, "node_id")


def fit_infection_model(train: DataFrame, max_iter: int = 20, max_depth: int = 4, seed: int = 42) -> PipelineModel:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[assembler, gbt]).fit(train)


def infection_probability(model: PipelineModel, detected: DataFrame) -> DataFrame:
    """(node_id, ml_probability) for every node with logs."""
    feats = node_features(detected).na.fill(0.0, FEATURES)
    scored = model.transform(feats)
    return scored.select("node_id", vector_to_array("probability")[1].alias("ml_probability"))


def fold_of(node_id: str, folds: int, seed: int = 42) -> Column:
    """The fold of a node, by a hash of its id: the same in every run and layout."""
    return F.pmod(F.xxhash64(F.col(node_id), F.lit(seed)), F.lit(folds))


def out_of_fold_probability(detected: DataFrame, registry: DataFrame, folds: int = 3, max_iter: int = 20, max_depth: int = 4,
                            seed: int = 42) -> DataFrame:
    """(node_id, ml_probability): every node scored by the model whose training left its fold out (ATT6).

    So no node's own label enters its score.  Nodes without a label are scored
    the same way.  A fold whose training rows hold one class only gets that
    class's share; without any labelled row the probability is null.
    """
    feats = written_table(node_features(detected).na.fill(0.0, FEATURES).withColumn("_fold", fold_of("node_id", folds, seed)), "node-features")
    labels = registry.select(F.col("node_id").alias("_id"), F.coalesce(F.col("is_infected"), F.lit(False)).cast("double").alias("label"))
    train = written_table(feats.join(labels, F.col("node_id") == F.col("_id")).drop("_id"), "infection-training")
    share = {r["_fold"]: (r["n"], r["infected"]) for r in train.groupBy("_fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("infected")).collect()}  # one row per fold
    scored = []
    for fold in range(folds):
        n = sum(v[0] for f, v in share.items() if f != fold)
        infected = sum(v[1] for f, v in share.items() if f != fold)
        rows = feats.where(F.col("_fold") == fold)
        if 0 < infected < n:
            model = fit_infection_model(train.where(F.col("_fold") != fold), max_iter, max_depth, seed)
            scored.append(model.transform(rows).select("node_id", vector_to_array("probability")[1].alias("ml_probability")))
        else:
            scored.append(rows.select("node_id", F.lit(infected / n if n else None).cast("double").alias("ml_probability")))
    return reduce(DataFrame.unionByName, scored)
