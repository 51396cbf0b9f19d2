"""Prediction of a whole table by neighbours, by fitted models and by both, scored side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators import models, scoring, vectors

MOST_LABELS = 1_000
METHODS = ["vector", "ml", "hybrid"]


def signed_parts(vector: str) -> Column:
    """A vector's positive and negative parts one after the other: nothing below zero, as count models need it."""
    x = F.col(vector).cast("array<double>")
    return array_to_vector(F.concat(
        F.transform(x, lambda v: F.greatest(v, F.lit(0.0))), F.transform(x, lambda v: F.greatest(-v, F.lit(0.0)))
    ))


def vector_predictions(
    rows: DataFrame, known: DataFrame, key: str, vector: str, label: str, k: int = 5, share: float = 0.5, digits: int | None = None
) -> DataFrame:
    """(key, label) of ``rows``: what the ``k`` nearest rows of ``known`` vote for."""
    found = vectors.knn(
        rows.select(F.col(key).alias("qid"), vector), known.select(F.col(key).alias("id"), vector, F.col(label).alias("label")),
        k, vector=vector, payload=["label"], digits=digits,
    )
    votes = vectors.label_vote(vectors.with_similarity(found), share=share)
    return votes.select(F.col("qid").alias(key), "label")


def model_predictions(
    rows: DataFrame, known: DataFrame, key: str, features: Column, label: str, make: Callable[[], Estimator], threshold: float = 0.5
) -> DataFrame | None:
    """(key, label) of ``rows`` by one binary model a label of ``known``, or None where no label can be learned.

    A label that no row or every row carries has nothing to be told from and gets no model. The labels themselves
    reach the driver (``MOST_LABELS`` at most); rows with a null label are rows without any.
    """
    counts = known.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 2).collect()
    total = sum(r["n"] for r in counts)
    labels = sorted(r["label"] for r in counts if r["label"] is not None and r["n"] < total)
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not labels:
        return None
    names = {f"is_{i}": x for i, x in enumerate(labels)}
    targets = [F.coalesce(F.col(label) == x, F.lit(False)).cast("int").alias(n) for n, x in names.items()]
    fitted = models.fit_per_label(known.select(features.alias("features"), *targets), list(names), make)
    scores = models.predict_per_label(rows.select(key, features.alias("features")), fitted, key)
    own = F.array(*[F.lit(x) for x in labels])
    chosen = scoring.threshold_labels(scores, threshold)
    return chosen.select(key, F.get(own, F.expr("cast(substring(label, 4) as int)")).alias("label"))


def score_methods(
    truth: DataFrame, rows: DataFrame, key: str, vector_labels: DataFrame, model_labels: DataFrame | None, **weights
) -> DataFrame:
    """(method, f1_micro, f1_macro, f1_weighted, hamming_loss) of the vector, ml and hybrid prediction of all ``rows``.

    The predictions are aligned by key: a row that a method gives no label counts as predicted without any. Without a model the
    hybrid answers with the neighbours' labels, and there is no row for the models.
    """
    out = None
    for method in METHODS:
        if method == "ml" and model_labels is None:
            continue
        predicted = scoring.predicted_by(method, vector_labels, model_labels, key, **(weights if method == "hybrid" else {}))
        own = scoring.multilabel_metrics(scoring.confusion(truth, predicted, rows, key)).select(F.lit(method).alias("method"), "*")
        out = own if out is None else out.unionByName(own)
    return out
