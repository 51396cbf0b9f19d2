"""Enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.runtime import broadcast_rows, skew_join


def unique_side(df: DataFrame, key: Column, columns: list[str], order: str) -> DataFrame:
    """One row per key, that of the lowest ``order``; combined before the shuffle."""
    first = F.min_by(F.struct(*columns), F.col(order))
    return df.groupBy(key.alias("_key")).agg(first.alias("_r")).select("_key", "_r.*")


def enrich_left(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, columns: list[str], order: str
) -> DataFrame:
    """Left join on case-folded keys against one right row per key; hot keys are spread."""
    unique = unique_side(right, F.lower(right_key), columns, order)
    return skew_join(left.withColumn("_key", F.lower(left_key)), unique, ["_key"], "left").drop("_key")


def lookup(df: DataFrame, dimension: DataFrame, left_key: str, key: str, value: str, name: str) -> DataFrame:
    """Add ``name`` from a dimension by key; a miss is null.

    No broadcast hint: the size Spark knows or finds at run time decides.
    """
    pairs = dimension.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias(name))
    return df.join(pairs, df[left_key] == pairs["_k"], "left").drop("_k")


def keep_top_keys(df: DataFrame, name: str, k: int) -> DataFrame:
    """Rows of the ``k`` most frequent keys."""
    top = (
        df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc(name)).limit(k).select(name)
    )
    return df.join(broadcast_rows(top, k), name, "left_semi")


def compare_outputs(left: DataFrame, right: DataFrame, key: str, column: str, names: tuple[str, str]) -> DataFrame:
    """Two result sets side by side for the keys both hold."""
    return left.select(key, F.col(column).alias(names[0])).join(
        right.select(key, F.col(column).alias(names[1])), key, "inner"
    )


def align_categories(df: DataFrame, name: str, categories: list[str], prefix: str = "loc") -> DataFrame:
    """0/1 columns of a fixed category list; null and unseen values are all zeros."""
    return df.select(
        "*", *[F.coalesce((F.col(name) == c).cast("int"), F.lit(0)).alias(f"{prefix}_{c}") for c in categories]
    )


def union_align(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns matched by name, absent ones null."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def key_union(*columns: DataFrame) -> DataFrame:
    """Distinct values of several one-column tables."""
    result = columns[0]
    for table in columns[1:]:
        result = result.union(table)
    return result.distinct()
