"""Column functions for coercion, buckets, ratios and defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(col: Column) -> Column:
    """A double, or null where the text is no number."""
    return col.try_cast("double")


def year_of(col: Column) -> Column:
    """Year of a ``yyyy-MM-dd`` text; null where it is no date."""
    return F.year(F.try_to_date(col, "yyyy-MM-dd"))


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decode(code: Column, names: dict, default: str) -> Column:
    pairs = list(names.items())
    first = F.when(code == pairs[0][0], pairs[0][1])
    return reduce(lambda acc, p: acc.when(code == p[0], p[1]), pairs[1:], first).otherwise(default)


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def return_on(revenue: Column, budget: Column) -> Column:
    return ratio(revenue - budget, budget)


def metadata_string(*cols: Column) -> Column:
    return F.concat_ws(" ", *cols)


def default_to(col: Column, value) -> Column:
    """Null takes the default; 0 stays 0."""
    return F.coalesce(col, F.lit(value))
