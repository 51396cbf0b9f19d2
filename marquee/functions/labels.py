"""Column functions for multi-valued label strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.fixed_values import LABEL_ALIASES, LABEL_OVERRIDES, MAIN_LABELS

BLANKS = " \t\n\r\f\x0b"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def canonical_labels(col: Column, aliases: dict[str, list[str]] = LABEL_ALIASES) -> Column:
    """Sorted canonical labels of a string; tokens match an alias whole, or else every alias they hold."""
    pairs = F.array(*[
        F.struct(F.lit(spelling.lower()).alias("alias"), F.lit(label).alias("label"))
        for label, spellings in aliases.items() for spelling in spellings
    ])

    def of_token(token: Column) -> Column:
        exact = F.filter(pairs, lambda p: p["alias"] == token)
        partial = F.filter(pairs, lambda p: F.contains(token, p["alias"]))
        found = F.when(F.size(exact) > 0, exact).otherwise(partial)
        return F.transform(found, lambda p: p["label"])

    tokens = F.transform(F.split(F.lower(col), "[,/;]"), strip)
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, of_token))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def clean_label_list(col: Column) -> Column:
    """Lower-cased parts of a label string, split at ``/``, ``&`` and commas; null gives an empty list."""
    separated = F.regexp_replace(F.lower(col), "[/&]", ",")
    kept = F.regexp_replace(separated, "[^a-z0-9, ]+", "")
    return F.coalesce(F.transform(F.split(kept, ","), strip), empty_strings())


def similarity_ratio(left: Column, right: Column) -> Column:
    """100 * (1 - edit distance / longer length); two empty strings give 0."""
    longer = F.greatest(F.length(left), F.length(right))
    share = F.try_divide(F.levenshtein(left, right).cast("double"), longer.cast("double"))
    return F.coalesce(F.lit(100.0) * (F.lit(1.0) - share), F.lit(0.0))


def map_to_main(
    labels: Column,
    targets: list[str] = MAIN_LABELS,
    overrides: dict[str, str] = LABEL_OVERRIDES,
    threshold: float = 80.0,
) -> Column:
    """Map raw labels to ``targets``: by hand first, else the closest target above ``threshold``."""
    wanted = F.array(*[F.lit(t) for t in sorted(targets)])
    by_hand = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])

    def closest(label: Column) -> Column:
        scored = F.transform(
            wanted, lambda t: F.struct(similarity_ratio(label, t).alias("score"), t.alias("target"))
        )
        # reduce keeps the first of equal scores, so ties go to the alphabetically first target
        best = F.aggregate(
            scored,
            F.struct(F.lit(threshold).alias("score"), F.lit(None).cast("string").alias("target")),
            lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a),
        )
        return F.coalesce(F.try_element_at(by_hand, label), best["target"])

    mapped = F.transform(labels, lambda label: closest(strip(label)))
    return F.array_sort(F.array_distinct(F.array_compact(mapped)))


def split_names(col: Column) -> Column:
    """Trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(col, ","), strip), lambda n: F.length(n) > 0)


def parse_list_literal(col: Column) -> Column:
    """Strings of a list literal such as ``['a', "b's"]``; anything else gives an empty list."""
    quoted = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    text = strip(col)
    items = F.transform(
        F.regexp_extract_all(text, F.lit(quoted), F.lit(0)),
        lambda q: F.regexp_replace(q.substr(F.lit(2), F.length(q) - 2), r"\\(.)", "$1"),
    )
    is_list = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
    return F.when(is_list, items).otherwise(empty_strings())


def as_label_array(df: DataFrame, name: str) -> Column:
    """A label column as an array, whether it holds arrays, list literals or comma lists."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name)
    col = F.col(name)
    is_literal = F.startswith(strip(col), F.lit("["))
    return F.when(is_literal, parse_list_literal(col)).otherwise(F.transform(F.split(col, ","), strip))


def primary_label(labels: Column) -> Column:
    return F.get(labels, F.lit(0))


def union_names(left: Column, right: Column) -> Column:
    """Sorted union of two name lists without repeats; null counts as empty."""
    return F.array_sort(F.array_union(F.coalesce(left, empty_strings()), F.coalesce(right, empty_strings())))
