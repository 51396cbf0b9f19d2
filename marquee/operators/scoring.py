"""Scores of multi-label predictions, votes over models and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.values import ratio
from marquee.runtime import write_once


def outcomes(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, label, t, p): 1 where the label is true, 1 where it is predicted."""
    both = truth.select(key, "label", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        predicted.select(key, "label", F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    return both.groupBy(key, "label").agg(F.max("t").alias("t"), F.max("p").alias("p"))


def confusion(truth: DataFrame, predicted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """tn, fp, fn and tp of each label that occurs in the truth; ``rows`` holds all scored keys."""
    n = rows.agg(F.countDistinct(key)).scalar()
    counted = outcomes(truth, predicted, key).groupBy("label").agg(
        F.count_if((F.col("p") == 1) & (F.col("t") == 0)).alias("fp"),
        F.count_if((F.col("p") == 0) & (F.col("t") == 1)).alias("fn"),
        F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("tp"),
    )
    known = counted.filter(F.col("tp") + F.col("fn") > 0)
    return known.select("label", (n - F.col("fp") - F.col("fn") - F.col("tp")).alias("tn"), "fp", "fn", "tp")


def _or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def precision() -> Column:
    return _or_zero(ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def recall() -> Column:
    return _or_zero(ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def f1() -> Column:
    return _or_zero(ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")))


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; a division by zero is 0."""
    return counts.select(
        "label", precision().alias("precision"), recall().alias("recall"), f1().alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def multilabel_metrics(counts: DataFrame) -> DataFrame:
    """Micro, macro and weighted F1 and Hamming loss from the confusion counts."""
    support = F.col("tp") + F.col("fn")
    wrong = F.col("fp") + F.col("fn")
    return counts.agg(
        _or_zero(ratio(F.sum("tp") * 2, F.sum(F.col("tp") * 2 + wrong))).alias("f1_micro"),
        F.avg(f1()).alias("f1_macro"),
        _or_zero(ratio(F.sum(f1() * support), F.sum(support))).alias("f1_weighted"),
        ratio(F.sum(wrong), F.sum(F.col("tn") + F.col("tp") + wrong)).alias("hamming_loss"),
    )


def subset_accuracy(truth: DataFrame, predicted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Share of rows whose predicted label set is the true one."""
    wrong = outcomes(truth, predicted, key).filter("t <> p").agg(F.countDistinct(key)).scalar()
    return rows.agg((F.lit(1.0) - ratio(wrong, F.countDistinct(key))).alias("subset_accuracy"))


# ---------------------------------------------------------------- ROC

def roc_points(scores: DataFrame) -> DataFrame:
    """ROC points of (label, score, truth) rows: (label, score, pos, neg, fpr, tpr), one per distinct score.

    Equal scores are counted before any shuffle. Running sums are exact and need no single task for a label: the distinct scores
    are range-partitioned by label and score, the totals of each label in each partition are summed in order, and sums inside
    a partition are added to them.
    """
    points = scores.groupBy("label", "score").agg(
        F.sum(F.col("truth").cast("long")).alias("pos"),
        F.sum(F.lit(1) - F.col("truth").cast("long")).alias("neg"),
    )
    order = [F.col("label"), F.col("score").desc()]
    # written, so that the partitions stay what they are
    placed = write_once(
        points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    )
    above = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("label")  # one row a partition
    sums = placed.groupBy("label", "part").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn")).select(
        F.col("label").alias("_label"), F.col("part").alias("_part"),
        F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("neg_above"),
        F.sum("bp").over(every).alias("all_pos"),
        F.sum("bn").over(every).alias("all_neg"),
    )
    inside = Window.partitionBy("label", "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("part") == F.col("_part"))
    return placed.join(sums, same).select(
        "label", "score", "pos", "neg", "all_pos", "all_neg",
        (F.col("neg_above") + F.sum("neg").over(inside)).alias("fp"),
        (F.col("pos_above") + F.sum("pos").over(inside)).alias("tp"),
    ).withColumn("fpr", ratio(F.col("fp"), F.col("all_neg"))).withColumn("tpr", ratio(F.col("tp"), F.col("all_pos")))


def auc_by_label(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve per label; a tie counts half, a label of one class only is null."""
    pairs_won = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / F.lit(2.0))
    return roc_points(scores).groupBy("label").agg(
        ratio(F.sum(pairs_won), F.max("all_pos").cast("double") * F.max("all_neg")).alias("auc")
    )


def top_labels_by_auc(areas: DataFrame, n: int = 5) -> DataFrame:
    return areas.orderBy(F.desc_nulls_last("auc"), "label").limit(n)


# ---------------------------------------------------------------- models side by side


def soft_vote(scores: DataFrame, weights: dict[str, float], key: str, threshold: float = 0.5) -> DataFrame:
    """(key, label, score) rows of model scores, weights normalised to 1, with the vote score > threshold."""
    total = float(sum(weights.values()))
    pairs = F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, w / total)])
    voted = scores.filter(F.col("model").isin(list(weights))).groupBy(key, "label").agg(
        F.sum(F.col("score") * F.try_element_at(pairs, F.col("model"))).alias("score")
    )
    return voted.withColumn("vote", (F.col("score") > threshold).cast("int"))


def threshold_labels(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Labels whose probability reaches the threshold; without a probability the hard prediction counts."""
    sure = F.coalesce(F.col("score") >= threshold, F.col("prediction") == 1)
    return scores.filter(sure)


def hybrid_labels(
    vector_labels: DataFrame, model_labels: DataFrame | None, key: str, weight_vector: float = 0.5,
    weight_model: float = 0.5, least: float = 0.5,
) -> DataFrame:
    """Labels of two predictors, each adding its weight, kept from ``least`` on.

    Without a model, the vector labels are the answer.
    """
    if model_labels is None:
        return vector_labels.select(key, "label").distinct().withColumn("score", F.lit(weight_vector))
    both = (
        vector_labels.select(key, "label").distinct().withColumn("w", F.lit(weight_vector))
        .unionByName(model_labels.select(key, "label").distinct().withColumn("w", F.lit(weight_model)))
    )
    return both.groupBy(key, "label").agg(F.sum("w").alias("score")).filter(F.col("score") >= least)


def predicted_by(
    method: str, vector_labels: DataFrame | None, model_labels: DataFrame | None, key: str, **weights
) -> DataFrame:
    """(key, label) of a whole table by ``vector``, ``ml`` or ``hybrid`` prediction."""
    if method == "vector":
        return vector_labels.select(key, "label").distinct()
    if method == "ml":
        return model_labels.select(key, "label").distinct()
    if method == "hybrid":
        return hybrid_labels(vector_labels, model_labels, key, **weights).select(key, "label")
    raise ValueError(f"unknown method: {method}")


METRICS = ["f1_micro", "f1_macro", "f1_weighted", "hamming_loss"]


def leaderboard(metrics: DataFrame, by: str = "f1_micro") -> DataFrame:
    """Models by one metric, best first; Hamming loss ascends, ties keep the order of evaluation.

    ``metrics`` has (position, model, metric, value) rows.
    """
    wide = metrics.groupBy("position", "model").pivot("metric", METRICS).agg(F.first("value"))
    order = F.asc(by) if by == "hamming_loss" else F.desc(by)
    rank = F.row_number().over(Window.orderBy(order, "position"))
    # one row per model: the window sees as many rows as models were trained
    return wide.withColumn("rank", rank)


def metrics_long(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return wide.unpivot(ids, values, "metric", "value")


def merge_importances(importances: DataFrame, models: list[str], top_n: int = 20) -> DataFrame:
    """Per model the ``top_n`` features, divided by the model's best, averaged over the models.

    ``importances`` has (model, feature, importance) rows; a feature a model lacks counts 0. A model
    without a positive importance is left out.
    """
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature"))
    top = importances.withColumn("rank", rank).filter(F.col("rank") <= top_n)
    best = F.max("importance").over(Window.partitionBy("model"))
    shares = top.withColumn("best", best).filter("best > 0").withColumn("share", F.col("importance") / F.col("best"))
    wide = shares.groupBy("feature").pivot("model", models).agg(F.first("share")).fillna(0.0, subset=models)
    used = shares.agg(F.countDistinct("model")).scalar()
    mean = sum((F.col(f"`{m}`") for m in models[1:]), F.col(f"`{models[0]}`")) / used
    return wide.withColumn("average_importance", mean).orderBy(F.desc("average_importance"), "feature").limit(top_n)
