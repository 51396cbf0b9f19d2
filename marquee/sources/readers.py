"""Readers. Every schema is given; none is inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.credits import CAST_SCHEMA, CREW_SCHEMA, all_with_job, parse_objects, top_names
from marquee.functions.labels import canonical_labels
from marquee.functions.values import to_number

WIKI_SCHEMA = (
    "`Release Year` string, Title string, `Origin/Ethnicity` string, Director string, Cast string, "
    "Genre string, `Wiki Page` string, Plot string"
)
WIKI_NAMES = {
    "Release Year": "year", "Title": "title", "Origin/Ethnicity": "origin", "Director": "director",
    "Cast": "cast", "Genre": "genre", "Wiki Page": "wiki_url", "Plot": "plot",
}
CREDITS_SCHEMA = "movie_id long, title string, cast string, crew string"
TMDB_SCHEMA = (
    "id long, genres string, budget double, revenue double, vote_average double, popularity double, release_date string"
)
SUMMARY_MAP = "map<string,struct<original_plot:string,summary:string,timestamp:string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with quoted, possibly many-line fields; a quote inside a field is doubled.

    A file with fields over several lines is read by one task, so big tables should be many files;
    without ``multi_line`` files are split.

    With a header, columns are taken by name, so files may hold more columns in another order.
    """
    reader = spark.read.option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    if not header:
        return reader.schema(schema).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    raw = reader.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in wanted if f.name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "country string, country_code string", header=False)


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """The film table with standard names, numeric year and canonical genre lists."""
    named = read_csv(spark, path, WIKI_SCHEMA).withColumnsRenamed(WIKI_NAMES)
    return named.withColumn("year", to_number(F.col("year")).cast("int")).withColumn(
        "genre", canonical_labels(F.col("genre"))
    )


def read_credits(spark: SparkSession, path: str) -> DataFrame:
    """Credits with directors and the first five cast names as text."""
    raw = read_csv(spark, path, CREDITS_SCHEMA)
    cast = parse_objects(F.col("cast"), CAST_SCHEMA, mend_quotes=False)
    crew = parse_objects(F.col("crew"), CREW_SCHEMA, mend_quotes=False)
    return raw.select(
        F.col("movie_id").alias("id"), "title", cast.alias("cast"), crew.alias("crew"),
        all_with_job(crew).alias("director"), F.array_join(top_names(cast, 5), ", ").alias("cast_names"),
    )


KINDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"wiki": read_wiki, "tmdb": read_credits}


def load(spark: SparkSession, path: str, kind: str = "wiki") -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"unsupported data source: {kind}")
    return KINDS[kind](spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def load_or(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """The source if its path exists, else the fallback."""
    return read(spark, path) if path_exists(spark, path) else fallback()


def read_summaries(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """(title, original_plot, summary, timestamp) of JSON objects keyed by title.

    A file holds one object, over any number of lines, or with ``per_line`` one object a line, which
    is how they are written here, so that a big file is read by many tasks.
    """
    text = spark.read.text(path, wholetext=not per_line)
    pairs = text.select(F.explode(F.from_json("value", SUMMARY_MAP)).alias("title", "r"))
    return pairs.select(
        "title", "r.original_plot", "r.summary", F.try_to_timestamp(F.col("r.timestamp")).alias("timestamp")
    )
