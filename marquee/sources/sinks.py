"""Writers and snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.readers import path_exists


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are written as JSON text."""
    flat = [F.to_json(n).alias(n) if t.startswith(("array", "struct", "map")) else F.col(f"`{n}`") for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summaries(df: DataFrame, path: str) -> None:
    """Objects ``{title: {original_plot, summary, timestamp}}``, one per line."""
    record = F.struct("original_plot", "summary", F.col("timestamp").cast("string").alias("timestamp"))
    df.select(F.to_json(F.create_map(F.col("title"), record)).alias("value")).write.mode("overwrite").text(path)


def save_snapshot(df: DataFrame, path: str, **metadata) -> None:
    """The table with its vectors as Parquet, and one row of metadata beside it."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    row = [(json.dumps({"columns": df.columns, **metadata}),)]
    df.sparkSession.createDataFrame(row, "metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """The saved table and its metadata; None where there is no snapshot."""
    if not path_exists(spark, f"{path}/metadata"):
        return None
    row = spark.read.schema("metadata string").json(f"{path}/metadata").first()
    return spark.read.parquet(f"{path}/rows"), json.loads(row["metadata"])


def save_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    """Predictor parameters as a one-row JSON table."""
    spark.createDataFrame([(json.dumps(parameters),)], "parameters string").coalesce(1).write.mode("overwrite").json(path)


def load_parameters(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("parameters string").json(path).first()["parameters"])
