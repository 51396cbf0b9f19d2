"""Profiles, filters, counts, cross-tabulations and rankings over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import word_count
from marquee.functions.values import ratio, return_on
from marquee.runtime import broadcast_rows, stable_hash

# ---------------------------------------------------------------- profiles


def null_profile(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, with count and percent; one pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return (
        counts.select("_n", F.explode(rows).alias("r"))
        .select(
            "r.column", "r.nulls",
            (F.lit(100.0) * ratio(F.col("r.nulls"), F.col("_n"))).alias("percent"),
        )
        .filter("nulls > 0")
    )


def schema_report(df: DataFrame) -> DataFrame:
    """Column names and types in order, with the row count."""
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type")) for i, n, t in fields
    ])
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select("row_count", F.inline(rows)).select("position", "column", "type", "row_count")


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


# ---------------------------------------------------------------- filters


def fill_strings(df: DataFrame, value: str = "") -> DataFrame:
    return df.fillna(value, subset=[n for n, t in df.dtypes if t == "string"])


def drop_value(df: DataFrame, name: str, value: str = "unknown", keep_null: bool = True) -> DataFrame:
    """Drop rows whose column equals ``value`` in any case; nulls stay unless asked otherwise."""
    differs = F.lower(F.col(name)) != F.lit(value.lower())
    return df.filter(F.coalesce(differs, F.lit(keep_null)))


def drop_empty_labels(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.size(name) > 0)


def conflicts(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose second source is known and differs from the first, a missing first one included."""
    return df.filter(F.col(right).isNotNull() & ~F.col(left).eqNullSafe(F.col(right)))


def drop_short(df: DataFrame, name: str, words: int = 20) -> DataFrame:
    return df.filter(word_count(F.col(name)) >= words)


SORTED_SAMPLE = 10_000
PICK_BUCKETS = 1 << 14


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows picked by a hash of the key: the same rows on any partitioning.

    A small sample is a sorted limit. For a big one the hashes are counted in 16,384 buckets; whole
    buckets are taken up to the one in which ``n`` is reached, and only that one is sorted.
    """
    picked = df.withColumn("_pick", stable_hash(seed, F.col(key)))
    if n <= SORTED_SAMPLE:
        return picked.orderBy("_pick", key).limit(n).drop("_pick")
    bucket = F.shiftright("_pick", 18).cast("int")
    taken, last = 0, None
    for row in picked.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect():
        if taken + row["n"] > n:
            last = row["b"]
            break
        taken += row["n"]
    if last is None:
        return df
    edge = picked.filter(bucket == last).orderBy("_pick", key).limit(n - taken)
    return picked.filter(bucket < last).unionByName(edge).drop("_pick")


# ---------------------------------------------------------------- counts


def value_counts(df: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value; nulls are not counted."""
    counted = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.orderBy(F.desc("n"), F.asc(name))
    return ordered.limit(k) if k is not None else ordered


def exploded(df: DataFrame, array: str | Column, name: str, *keep: str) -> DataFrame:
    """One row per array element; rows with an empty array stay with a null."""
    return df.select(*keep, F.explode_outer(array).alias(name))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts of row x column with 0 for absent pairs; the fixed value list keeps the schema stable."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0)


def pair_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    """Count of each pair and its share within the row value, in long form.

    The window runs over the counted pairs, so a row value costs as many rows as it has labels.
    """
    counted = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(row))
    return counted.withColumn("share", ratio(F.col("n"), total))


def top_per_group(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent keys of each group; null and empty keys are left out."""
    counted = (
        df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .groupBy(group, key)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc(key)))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def best_per_key(df: DataFrame, key: str, measure: str, tie: str, k: int) -> DataFrame:
    """The row with the highest measure of each key (lowest ``tie`` first), then the top ``k`` of all.

    ``max`` of a struct is combined before the shuffle, so a hot key sends one row per task.
    """
    rest = [c for c in df.columns if c not in (key, measure, tie)]
    best = F.max(F.struct(
        F.coalesce(F.col(measure), F.lit(0)).alias(measure),
        (-F.col(tie)).alias("_tie"),
        *rest,
    ))
    picked = df.groupBy(key).agg(best.alias("b"))
    return (
        picked.select(key, f"b.{measure}", (-F.col("b._tie")).alias(tie), *[f"b.{c}" for c in rest])
        .orderBy(F.desc(measure), F.asc(key))
        .limit(k)
    )


def pair_counts(df: DataFrame, left: str, right: str, k: int) -> DataFrame:
    counted = df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), left, right).limit(k)


# ---------------------------------------------------------------- weighted pivots and metrics


def weighted_pairs(df: DataFrame, owner: str, labels: str, by: str, values: list) -> DataFrame:
    """Sum of weights of each owner and label of ``values``, as (owner, label, weight).

    ``by='owner'`` weighs a row 1/(rows of its owner), ``by='label'`` 1/(rows of its label). The
    weights are constant within a pair, so counts of pairs, owners and labels are all it takes and
    no detail row is shuffled. Rows without an owner count for the label, but give no pair.
    """
    rows = df.select(F.col(owner).alias("owner"), F.explode(labels).alias("label")).filter(F.col("label").isin(values))
    pairs = rows.filter("owner IS NOT NULL").groupBy("owner", "label").agg(F.count(F.lit(1)).alias("n"))
    if by == "owner":
        sizes = (
            df.filter(F.col(owner).isNotNull())
            .groupBy(F.col(owner).alias("owner")).agg(F.count(F.lit(1)).alias("size"))
        )
        joined = pairs.join(sizes, "owner")
    else:
        sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        joined = pairs.join(broadcast_rows(sizes, len(values)), "label")
    return joined.select("owner", "label", ratio(F.col("n"), F.col("size")).alias("weight"))


def weighted_pivot(df: DataFrame, owner: str, labels: str, by: str, values: list) -> DataFrame:
    """Weighted pairs with owners as rows and ``values`` as columns, 0 for absent pairs.

    An owner none of whose labels is in ``values`` has no row.
    """
    pairs = weighted_pairs(df, owner, labels, by, values)
    return pairs.groupBy("owner").pivot("label", values).agg(F.sum("weight")).fillna(0.0)


def group_metrics(df: DataFrame, key: str, budget: str, revenue: str, others: list[str]) -> DataFrame:
    """Mean budget, revenue and other measures of each group, its size and return on budget."""
    means = df.groupBy(key).agg(
        F.avg(budget).alias("avg_budget"),
        F.avg(revenue).alias("avg_revenue"),
        *[F.avg(c).alias(f"avg_{c}") for c in others],
        F.count(F.lit(1)).alias("n"),
    )
    return means.withColumn("roi", return_on(F.col("avg_revenue"), F.col("avg_budget")))


def yearly_metrics(
    df: DataFrame, year: str, measures: list[str], min_rows: int = 10, first: int = 1960, last: int = 2017
) -> DataFrame:
    """Means of each year with enough rows; the year range is filtered before the aggregation."""
    means = df.filter(F.col(year).between(first, last)).groupBy(year).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in measures], F.count(F.lit(1)).alias("n")
    )
    return means.filter(F.col("n") >= min_rows)
