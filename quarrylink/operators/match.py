"""Scoring of pairs: boosted trees, pluggable scorers, thresholds, clusters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylink.sources.scratch import written


def hash_split(df: DataFrame, by: str = "query_id", valid: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_valid: all rows of a key fall on one side."""
    return df.withColumn("is_valid", F.pmod(F.xxhash64(F.col(by), F.lit(seed)), F.lit(10_000)) < int(valid * 10_000))


def train(features: DataFrame, inputs: list[str], label: str = "label", trees: int = 20, depth: int = 5, step: float = 0.05, weight: str | None = None, seed: int = 42) -> PipelineModel:
    """Boosted trees with a held-out fifth of the queries for early stopping."""
    ready = hash_split(features.na.fill(0, inputs))
    trees_of = GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="is_valid", minInstancesPerNode=5)
    if weight:
        trees_of = trees_of.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), trees_of]).fit(ready)


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    neg, pos = df.agg(F.sum(1 - F.col(label)), F.sum(label)).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, float(max(0.5 * (neg or 0) / max(pos or 0, 1), 1.0))).otherwise(1.0))


def score(model: PipelineModel, features: DataFrame, inputs: list[str]) -> DataFrame:
    return model.transform(features.na.fill(0, inputs)).withColumn("probability_match", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def cross_validated(features: DataFrame, inputs: list[str], folds: int = 5, by: str = "query_id", seed: int = 42, **options) -> DataFrame:
    """Every row with its fold and the probability of a model that saw no row of the fold; a key is in one fold."""
    fold = F.pmod(F.xxhash64(F.col(by), F.lit(seed + 1)), F.lit(folds)).cast("int")
    dealt = written(features.withColumn("fold", fold), "folds")
    out = None
    for i in range(folds):
        model = train(dealt.where(F.col("fold") != i), inputs, seed=seed, **options)
        part = score(model, dealt.where(F.col("fold") == i), inputs)
        out = part if out is None else out.unionByName(part)
    return out


def importances(model: PipelineModel, inputs: list[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(inputs, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def score_pairs(pairs: DataFrame, scorer: Callable, left: str, right: str, out: str = "ce_score") -> DataFrame:
    """Scores text pairs with ``scorer(left texts, right texts) -> scores``, a batch at a time."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scorer(a.fillna("").tolist(), b.fillna("").tolist()), dtype=float)

    return pairs.withColumn(out, run(left, right))


def lexical_scorer(left: list[str], right: list[str]) -> list[float]:
    """Default scorer where no neural model is at hand: token Jaccard."""
    return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in ((set(x.split()), set(y.split())) for x, y in zip(left, right, strict=True))]


def matches(scored: DataFrame, queries: DataFrame, threshold: float, score_col: str = "score", id_col: str = "entity_id") -> DataFrame:
    """Every query id with its comma-joined matches, best first; '' where there is none."""
    kept = scored.where(F.col(score_col) >= threshold)
    lists = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col(score_col)).alias("s"), "candidate_id"))).alias("r"))
    lists = lists.select("query_id", F.concat_ws(",", "r.candidate_id").alias("matched_entity_ids"))
    left = queries.select(F.col(id_col).alias("source1_entity_id"))
    return left.join(lists, left["source1_entity_id"] == lists["query_id"], "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))


def duplicate_clusters(df: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """cluster_key, members of records with equal lower-cased, stripped name and address."""
    key = F.concat_ws("||", *[F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("business_name", "business_address")])
    return df.groupBy(key.alias("cluster_key")).agg(F.array_sort(F.collect_set(id_col)).alias("members")).where(F.size("members") > 1)


def expand(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each candidate replaced by all members of its cluster, query-side ids left out."""
    members = clusters.select(F.explode("members").alias("candidate_id"), "members")
    all_of = F.explode(F.coalesce("members", F.array("candidate_id"))).alias("candidate_id")
    return pairs.select("query_id", "candidate_id").join(members, "candidate_id", "left").select("query_id", all_of).where(~F.col("candidate_id").startswith("S1-")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) by hash-to-min with pointer jumping; ``edges`` has a, b."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("next"))
        step = step.join(jump, step["label"] == jump["at"], "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        step = written(step, "labels")
        labels = step.select("node", "label")
        if not step.where("label <> old").take(1):
            return labels.select("node", F.col("label").alias("component"))
