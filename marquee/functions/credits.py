"""Column functions for people: JSON credits and free-text cast lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.labels import empty_strings, split_names, strip

CAST_SCHEMA = "array<struct<name:string,gender:int,popularity:double,character:string>>"
CREW_SCHEMA = "array<struct<name:string,job:string>>"
NAMED_SCHEMA = "array<struct<id:long,name:string>>"


def director_of_line(col: Column, marker: str = "Director") -> Column:
    """The rest of the line after ``Director:``; null without the marker."""
    pattern = rf"{marker}:\s*([^\r\n]+)"
    return F.when(F.rlike(col, F.lit(pattern)), strip(F.regexp_extract(col, pattern, 1)))


def cast_of_line(col: Column, marker: str = "Cast", other_marker: str = "Director") -> Column:
    """Names after ``Cast:``; without either marker the whole string is the name list."""
    pattern = rf"{marker}:\s*([^\r\n]+)"
    other = rf"{other_marker}:\s*([^\r\n]+)"
    return (
        F.when(F.rlike(col, F.lit(pattern)), split_names(F.regexp_extract(col, pattern, 1)))
        .when(F.rlike(col, F.lit(other)), empty_strings())
        .when(col.isNotNull(), split_names(col))
        .otherwise(empty_strings())
    )


def parse_objects(col: Column, schema: str, mend_quotes: bool = True) -> Column:
    """A JSON array of objects; what cannot be parsed is an empty array."""
    text = F.replace(col, F.lit("''"), F.lit("'")) if mend_quotes else col
    return F.coalesce(F.from_json(text, schema), F.array().cast(schema))


def first_with_job(crew: Column, job: str = "Director") -> Column:
    return F.get(F.filter(crew, lambda m: m["job"] == job), F.lit(0))["name"]


def all_with_job(crew: Column, job: str = "Director") -> Column:
    return F.array_join(F.transform(F.filter(crew, lambda m: m["job"] == job), lambda m: m["name"]), ", ")


def top_names(people: Column, n: int) -> Column:
    """Names of the first ``n`` people, those without a name left out."""
    named = F.filter(F.slice(people, 1, n), lambda m: m["name"].isNotNull())
    return F.transform(named, lambda m: m["name"])


def names_of(objects: Column) -> Column:
    return F.transform(F.filter(objects, lambda o: o["name"].isNotNull()), lambda o: o["name"])


def gender_label(code: Column) -> Column:
    return F.when(code == 1, "Female").when(code == 2, "Male").otherwise("Unknown")
