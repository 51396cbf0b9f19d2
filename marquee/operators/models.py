"""Feature pipelines, one binary model per label, evaluation and parameter search with Spark ML."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    PCA,
    CountVectorizerModel,
    Normalizer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import word_tokens
from marquee.operators.features import totals_by_term, vocabulary, with_bigrams
from marquee.operators.scoring import class_report, confusion, multilabel_metrics, threshold_labels
from marquee.runtime import stable_hash, write_once

# ---------------------------------------------------------------- features


class TermLister(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Words and neighbouring pairs of a text column."""

    @keyword_only
    def __init__(self, inputCol: str = None, outputCol: str = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        words = word_tokens(F.coalesce(F.col(self.getInputCol()), F.lit("")))
        return df.withColumn(out, words).withColumn(out, with_bigrams(F.col(out)))


class TfIdfWeighter(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """(1 + ln tf) * idf of a count vector."""

    idf = Param(Params._dummy(), "idf", "weight of each term", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol: str = None, outputCol: str = None, idf: list[float] = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        idf = F.lit(np.asarray(self.getOrDefault(self.idf)))
        counts = vector_to_array(F.col(self.getInputCol()))
        weights = F.zip_with(counts, idf, lambda n, w: F.when(n > 0, (F.ln(n) + 1) * w).otherwise(0.0))
        return df.withColumn(self.getOutputCol(), array_to_vector(weights))


@dataclass
class Features:
    """A fitted feature pipeline and the names of its columns, in order."""

    model: PipelineModel
    names: list[str]


def fit_features(
    df: DataFrame, key: str, text: str, category: str | None, labels: list[str], max_features: int = 300,
    keep: int | None = 100, min_df: int = 1, max_df: float = 1.0,
) -> Features:
    """Fit TF-IDF of ``text`` and one-hot of ``category``, cut to the ``keep`` best by chi-squared.

    ``labels`` are 0/1 columns. Only the vocabulary (``max_features`` rows) and one sum vector per
    label come to the driver.
    """
    lister = TermLister(inputCol=text, outputCol="_terms")
    n = df.count()
    totals = totals_by_term(df.select(text), word_tokens(F.coalesce(F.col(text), F.lit(""))), bigrams=True)
    terms = sorted((r["term"], r["df"]) for r in vocabulary(totals, F.lit(n), max_features, min_df, max_df).collect())
    idf = [math.log((1 + n) / (1 + d)) + 1 for _, d in terms]
    vocab = [t for t, _ in terms]
    stages = [
        lister,
        CountVectorizerModel.from_vocabulary(vocab, inputCol="_terms", outputCol="_counts", minTF=1.0),
        TfIdfWeighter(inputCol="_counts", outputCol="_weights", idf=idf),
        Normalizer(inputCol="_weights", outputCol="_text", p=2.0),
    ]
    names, blocks = list(vocab), ["_text"]
    if category is not None:
        indexer = StringIndexer(inputCol=category, outputCol="_place", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df)
        # dropping the last category drops the one kept for null and unseen values
        stages += [indexer, OneHotEncoder(inputCol="_place", outputCol="_place_hot", dropLast=True)]
        names += [f"loc_{c}" for c in indexer.labels]
        blocks.append("_place_hot")
    stages.append(VectorAssembler(inputCols=blocks, outputCol="_all"))
    if keep is None:
        stages.append(VectorSlicer(inputCol="_all", outputCol="features", indices=list(range(len(names)))))
        return Features(Pipeline(stages=stages).fit(df), names)
    wide = Pipeline(stages=stages).fit(df)
    best = np.argsort(-chi2_of_columns(wide.transform(df), "_all", labels), kind="stable")[:keep]
    best = sorted(int(i) for i in best)
    slicer = VectorSlicer(inputCol="_all", outputCol="features", indices=best)
    return Features(PipelineModel(stages=[*wide.stages, slicer]), [names[i] for i in best])


def chi2_of_columns(df: DataFrame, vector: str, labels: list[str]) -> np.ndarray:
    """Chi-squared of every vector column against 0/1 label columns; one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        Summarizer.sum(F.col(vector)).alias("total"),
        *[Summarizer.sum(F.col(vector), F.col(l).cast("double")).alias(f"sum_{i}") for i, l in enumerate(labels)],
        *[F.sum(l).alias(f"n_{i}") for i, l in enumerate(labels)],
    ).first()
    total = row["total"].toArray()
    scores = np.zeros(len(total))
    for i, _ in enumerate(labels):
        expected = total * (row[f"n_{i}"] / row["n"])
        # a weighted sum divides nothing: it is the mass of the rows that carry the label
        observed = row[f"sum_{i}"].toArray()
        scores += np.divide((observed - expected) ** 2, expected, out=np.zeros_like(expected), where=expected > 0)
    return scores


# ---------------------------------------------------------------- models


def families(n_features: int) -> dict[str, Callable[[], Estimator]]:
    """Binary classifiers by name, simplest first."""
    common = {"featuresCol": "features", "labelCol": "target"}
    return {
        "logistic_regression": lambda: LogisticRegression(maxIter=100, regParam=0.01, **common),
        "multinomial_nb": lambda: NaiveBayes(modelType="multinomial", **common),
        "decision_tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=42, **common),
        "random_forest": lambda: RandomForestClassifier(numTrees=20, seed=42, **common),
        "linear_svm": lambda: LinearSVC(maxIter=50, **common),
        "gradient_boosting": lambda: GBTClassifier(maxIter=10, seed=42, **common),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[n_features, 16, 2], maxIter=50, seed=42, **common),
    }


def fit_per_label(
    train: DataFrame, labels: list[str], make: Callable[[], Estimator], threads: int = 4
) -> dict[str, object]:
    """One fitted binary model per 0/1 label column; a few fits run at once."""
    def fit(label: str):
        return make().fit(train.select("features", F.col(label).cast("double").alias("target")))

    with ThreadPool(min(threads, len(labels))) as pool:
        return dict(zip(labels, pool.map(fit, labels)))


def predict_per_label(df: DataFrame, models: dict[str, object], key: str) -> DataFrame:
    """(key, label, score, prediction); score is null for models without a probability.

    All models are applied to the same rows, then the columns are turned into rows: no join, no
    second scan.
    """
    cells = []
    for i, (label, model) in enumerate(models.items()):
        model = model.copy()
        model.setPredictionCol(f"_p{i}")
        score = F.lit(None).cast("double")
        if model.hasParam("rawPredictionCol"):
            model.setRawPredictionCol(f"_r{i}")
        if model.hasParam("probabilityCol"):
            model.setProbabilityCol(f"_s{i}")
            score = F.get(vector_to_array(F.col(f"_s{i}")), F.lit(1))
        df = model.transform(df)
        cells.append(F.struct(F.lit(label).alias("label"), score.alias("score"), F.col(f"_p{i}").cast("int").alias("prediction")))
    return df.select(key, F.inline(F.array(*cells)))


def true_labels(df: DataFrame, key: str, labels: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(l).alias("label"), F.col(l).alias("truth")) for l in labels]
    return df.select(key, F.inline(F.array(*cells))).filter("truth = 1").select(key, "label")


@dataclass
class Run:
    """Fitted models of several families with their scores."""

    models: dict[str, dict[str, object]] = field(default_factory=dict)
    metrics: list[tuple] = field(default_factory=list)
    reports: list[tuple] = field(default_factory=list)  # (position, model, label, precision, recall, f1, support)
    predictions: dict[str, DataFrame] = field(default_factory=dict)
    best: str | None = None


def evaluate_models(
    train: DataFrame, test: DataFrame, key: str, labels: list[str], chosen: dict[str, Callable[[], Estimator]],
    threshold: float = 0.5,
) -> Run:
    """Fit, predict and score every chosen family; the first of the highest micro-F1 is the best."""
    run = Run()
    rows = test.select(key)
    truth = true_labels(test, key, labels)
    top = -1.0
    for position, (name, make) in enumerate(chosen.items()):
        run.models[name] = fit_per_label(train, labels, make)
        scores = predict_per_label(test, run.models[name], key)
        run.predictions[name] = scores
        chosen_labels = threshold_labels(scores, threshold).select(key, "label")
        counts = write_once(confusion(truth, chosen_labels, rows, key))
        run.reports += [(position, name, *r) for r in class_report(counts).orderBy("label").collect()]
        row = multilabel_metrics(counts).first()
        run.metrics += [(position, name, m, row[m]) for m in row.asDict()]
        if (row["f1_micro"] or 0.0) > top:
            top, run.best = row["f1_micro"] or 0.0, name
    return run


def fold_column(key: str, folds: int, seed: int = 42) -> Column:
    return F.pmod(stable_hash(seed, F.col(key)), F.lit(folds)).cast("int")


def tune(
    train: DataFrame, key: str, label: str, estimator: Estimator, grid: dict, draws: int = 10, folds: int = 3,
    seed: int = 42, parallelism: int = 4,
):
    """Random search: ``draws`` sampled parameter sets, k-fold cross-validated by F1.

    Returns the fitted CrossValidatorModel and the tried parameter maps.
    """
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    picked = random.Random(seed).sample(every, min(draws, len(every)))
    data = train.select("features", F.col(label).cast("double").alias("target"), fold_column(key, folds, seed).alias("fold"))
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=picked,
        evaluator=MulticlassClassificationEvaluator(labelCol="target", metricName="f1"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=seed,
    )
    return search.fit(data), picked


@dataclass
class Tuned:
    """The best of the drawn parameter sets, its models fitted on all rows, and every fold's score."""

    params: dict[str, object]
    models: dict[str, object]
    scores: list[tuple]  # (draw, parameters, fold, micro-F1)


def tune_labels(
    train: DataFrame, key: str, labels: list[str], make: Callable[..., Estimator], grid: dict[str, list], draws: int = 10,
    folds: int = 3, seed: int = 42, run: Run | None = None, name: str | None = None,
) -> Tuned:
    """Random search over all labels together: the drawn parameters of the highest mean micro-F1 of their folds, the first of equals.

    A fold's true and false positives are summed over its labels before the ratio. ``make`` builds the estimator from the
    parameters of ``grid``. The best is fitted again on all rows; where a ``run`` and a family's ``name`` are given, it takes that place there.
    """
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    picked = random.Random(seed).sample(every, min(draws, len(every)))
    kept = train.select(key, "features", *labels, fold_column(key, folds, seed).alias("_fold"))
    rows, scores, means = write_once(kept), [], []
    for draw, params in enumerate(picked):
        for fold in range(folds):
            test = rows.filter(F.col("_fold") == fold)
            fits = fit_per_label(rows.filter(F.col("_fold") != fold), labels, lambda: make(**params))
            found = predict_per_label(test, fits, key).filter("prediction = 1").select(key, "label")
            counts = confusion(true_labels(test, key, labels), found, test.select(key), key)
            scores.append((draw, params, fold, multilabel_metrics(counts).first()["f1_micro"] or 0.0))
        means.append(sum(s[3] for s in scores[-folds:]) / folds)
    params = picked[max(range(len(picked)), key=means.__getitem__)]
    tuned = Tuned(params, fit_per_label(rows, labels, lambda: make(**params)), scores)
    if run is not None:
        run.models[name] = tuned.models
    return tuned


# ---------------------------------------------------------------- projections


def project(df: DataFrame, vector: str, n: int = 2) -> tuple[DataFrame, list[float]]:
    """Principal components of an array column, centred first; with the explained variance shares."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False)
    model = Pipeline(stages=[centred, PCA(k=n, inputCol="_c", outputCol="_p")]).fit(rows)
    parts = vector_to_array("_p")
    out = model.transform(rows).select("*", *[F.get(parts, F.lit(i)).alias(f"pc{i + 1}") for i in range(n)])
    return out.drop("_v", "_c", "_p"), [float(x) for x in model.stages[-1].explainedVariance]
