"""Saved model runs: models by family and label, scores, names, feature pipelines."""

from __future__ import annotations

import importlib
import json
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.models import Features, Run

REPORT_SCHEMA = "position int, model string, label string, precision double, recall double, f1 double, support long"
METRIC_SCHEMA = "position int, model string, metric string, value double"
RUN_SCHEMA = (
    "run string, dataset string, saved_at string, best_only boolean, model_count int, best string, info string"
)


def safe(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def save_run(
    spark: SparkSession, root: str, run: Run, dataset: str, feature_names: list[str], labels: list[str],
    features: Features | None = None, data: DataFrame | None = None, best_only: bool = False, stamp: str | None = None,
) -> str:
    """Write all models of a run, or the best one, and a row in the list of runs; returns the folder."""
    stamp = stamp or datetime.now().strftime("%Y%m%d_%H%M%S")
    name = f"{safe(dataset)}_{'best_' if best_only else ''}{stamp}"
    folder = f"{root}/runs/{name}"
    kept = {run.best: run.models[run.best]} if best_only else run.models
    for family, models in kept.items():
        for label, model in models.items():
            model.write().overwrite().save(f"{folder}/models/{safe(family)}/{label}")
    metrics = [m for m in run.metrics if m[1] in kept]
    spark.createDataFrame(metrics, METRIC_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/metrics")
    reports = [r for r in run.reports if r[1] in kept]
    spark.createDataFrame(reports, REPORT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/reports")
    if features is not None:
        features.model.write().overwrite().save(f"{folder}/features")
    if data is not None:
        data.write.mode("overwrite").parquet(f"{folder}/data")
    classes = {f: {l: f"{type(m).__module__}.{type(m).__name__}" for l, m in ms.items()} for f, ms in kept.items()}
    info = json.dumps({"feature_names": feature_names, "labels": labels, "classes": classes, "has_features": features is not None})
    row = [(name, dataset, stamp, best_only, len(kept), run.best, info)]
    spark.createDataFrame(row, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/list")
    return folder


def saved_runs(spark: SparkSession, root: str) -> DataFrame:
    """Saved runs, newest first."""
    return spark.read.schema(RUN_SCHEMA).parquet(f"{root}/list").orderBy(F.desc("saved_at"), "run")


def newest_per_dataset(spark: SparkSession, root: str) -> DataFrame:
    """The newest run of each dataset."""
    runs = spark.read.schema(RUN_SCHEMA).parquet(f"{root}/list")
    return runs.groupBy("dataset").agg(F.max(F.struct("saved_at", "run")).alias("r")).select("dataset", "r.*")


def load_model(path: str, class_name: str):
    module, _, name = class_name.rpartition(".")
    return getattr(importlib.import_module(module), name).load(path)


def load_run(spark: SparkSession, root: str, name: str | None = None) -> tuple[Run, dict]:
    """All models, scores and class reports of a run, the newest by default, with its feature and label names."""
    runs = saved_runs(spark, root)
    row = (runs.filter(F.col("run") == name) if name else runs).first()
    if row is None:
        raise ValueError(f"no saved run {name or ''} in {root}")
    folder, info = f"{root}/runs/{row['run']}", json.loads(row["info"])
    run = Run(best=row["best"])
    for family, classes in info["classes"].items():
        run.models[family] = {l: load_model(f"{folder}/models/{safe(family)}/{l}", c) for l, c in classes.items()}
    run.metrics = [tuple(r) for r in spark.read.schema(METRIC_SCHEMA).parquet(f"{folder}/metrics").collect()]
    if "has_features" in info:  # runs saved before had no reports
        run.reports = [tuple(r) for r in spark.read.schema(REPORT_SCHEMA).parquet(f"{folder}/reports").collect()]
    return run, info


def load_features(spark: SparkSession, root: str, name: str | None = None) -> Features:
    """The feature pipeline saved with a run; by default that of the newest run that has one."""
    runs = saved_runs(spark, root)
    if name:
        row = runs.filter(F.col("run") == name).first()
    else:
        row = runs.filter(F.get_json_object("info", "$.has_features") == "true").first()
    if row is None:
        raise ValueError(f"no saved features {name or ''} in {root}")
    return Features(PipelineModel.load(f"{root}/runs/{row['run']}/features"), json.loads(row["info"])["feature_names"])
