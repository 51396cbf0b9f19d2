"""Feature importance of fitted models."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.operators.scoring import f1
from marquee.runtime import stable_hash

BLOCK = 10_000


def weights_of(model) -> np.ndarray | None:
    """Importances of a fitted binary model: of the trees, or absolute coefficients."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    return None


def direct_importance(spark: SparkSession, models: dict[str, object], names: list[str], top_n: int) -> DataFrame | None:
    """Mean importance of each feature over the labels' models, the best ``top_n``."""
    found = [w for w in (weights_of(m) for m in models.values()) if w is not None]
    if not found:
        return None
    if any(len(w) != len(names) for w in found):
        raise ValueError("importances and feature names differ in number")
    rows = [(n, float(v)) for n, v in zip(names, np.mean(found, axis=0))]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top_n)


def above_mean(importances: DataFrame) -> DataFrame:
    """Features whose importance reaches the mean."""
    return importances.filter(F.col("importance") >= importances.agg(F.avg("importance")).scalar())


def permutation_importance(
    df: DataFrame, key: str, label: str, vector: str, model, names: list[str], repeats: int = 5, seed: int = 42,
) -> DataFrame:
    """Mean drop of F1 when one feature's values are moved to other rows, as (feature, importance).

    Rows fall into hash blocks of about ``BLOCK`` rows; inside a block, in an order drawn per repeat,
    each row takes its successor's values. One window a repeat serves all features: the moved vector
    travels whole, and every feature swaps in its own value. All scores come from one aggregation.
    """
    rows = df.select(key, F.col(label).cast("int").alias("truth"), vector_to_array(vector).alias("x"))
    blocks = df.count() // BLOCK + 1
    place = F.pmod(stable_hash(seed, F.col(key)), F.lit(blocks))
    moved = None
    for r in range(repeats):
        by = Window.partitionBy("block").orderBy(stable_hash(seed + r + 1, F.col(key)), key)
        first = F.first("x").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        other = F.coalesce(F.lead("x").over(by), first)
        part = rows.withColumn("block", place).select("truth", "x", other.alias("y"), F.lit(r).alias("repeat"))
        moved = part if moved is None else moved.unionByName(part)
    spread = moved.select(
        "truth", "repeat", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j")
    )
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get("y", i)).otherwise(v))
    scored = model.transform(spread.select("truth", "repeat", "j", array_to_vector(swapped).alias("features")))
    whole = model.transform(rows.select("truth", F.lit(-1).alias("repeat"), F.lit(-1).alias("j"), array_to_vector("x").alias("features")))
    columns = ["truth", "repeat", "j", F.col("prediction").cast("int").alias("guess")]
    counted = scored.select(*columns).unionByName(whole.select(*columns)).groupBy("j", "repeat").agg(
        F.count_if(F.expr("truth = 1 AND guess = 1")).alias("tp"),
        F.count_if(F.expr("truth = 0 AND guess = 1")).alias("fp"),
        F.count_if(F.expr("truth = 1 AND guess = 0")).alias("fn"),
    ).withColumn("f1", f1())
    # from here on there are as many rows as features, and one for the untouched rows
    means = counted.groupBy("j").agg(F.avg("f1").alias("f1"))
    base = F.max(F.when(F.col("j") == -1, F.col("f1"))).over(Window.partitionBy(F.lit(0)))
    drops = means.withColumn("importance", base - F.col("f1")).filter("j >= 0")
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return drops.select(feature.alias("feature"), "importance")


def analyze_importance(
    spark: SparkSession, runs: dict[str, dict[str, object]], names: list[str], df: DataFrame, key: str, top_n: int = 20,
    repeats: int = 2, permute: bool = True,
) -> DataFrame:
    """(model, method, feature, importance) of all models by every method that fits them."""
    parts = []
    for name, models in runs.items():
        direct = direct_importance(spark, models, names, len(names))
        tables = {}
        if direct is not None:
            tables["direct"] = direct.orderBy(F.desc("importance"), "feature").limit(top_n)
            tables["above_mean"] = above_mean(direct).orderBy(F.desc("importance"), "feature").limit(top_n)
        if permute:
            drops = None
            for label, model in models.items():
                one = permutation_importance(df, key, label, "features", model, names, repeats)
                drops = one if drops is None else drops.unionByName(one)
            mean = drops.groupBy("feature").agg(F.avg("importance").alias("importance"))
            tables["permutation"] = mean.orderBy(F.desc("importance"), "feature").limit(top_n)
        for method, table in tables.items():
            parts.append(table.select(F.lit(name).alias("model"), F.lit(method).alias("method"), "feature", "importance"))
    result = spark.createDataFrame([], "model string, method string, feature string, importance double")
    for part in parts:
        result = result.unionByName(part)
    return result
