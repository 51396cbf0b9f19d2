"""Summary corpora: preparation, batched generation, splits, token ids, reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.text import word_count, word_tokens
from marquee.functions.values import ratio
from marquee.operators.features import split_column
from marquee.operators.tables import drop_short, seeded_sample
from marquee.runtime import broadcast_rows, write_once


def corpus(
    df: DataFrame, key: str, title: str, text: str, sample: int | None = None, seed: int = 42, min_words: int = 20
) -> DataFrame:
    """Rows fit for a summary: sampled where asked, complete, and long enough."""
    picked = seeded_sample(df, key, sample, seed) if sample is not None else df
    return drop_short(picked.dropna(subset=[title, text]), text, min_words)


def lead_sentences(n: int = 3) -> Callable[[list[str]], list[str]]:
    """A generator that answers with the first ``n`` sentences."""
    def generate(texts: list[str]) -> list[str]:
        return [" ".join(re.split(r"(?<=[.!?])\s+", t.strip())[:n]) for t in texts]
    return generate


def generate(
    df: DataFrame, text: str, make: Callable[[list[str]], list[str]], batch_size: int = 10
) -> DataFrame:
    """Add ``summary`` and ``error`` from a batch function; a failing batch is retried text by text.

    A text that fails has a null summary and the error's message.
    """
    schema = T.StructType([
        *df.schema.fields, T.StructField("summary", T.StringType()), T.StructField("error", T.StringType())
    ])

    def attempt(texts: list[str]) -> tuple[list[str | None], list[str | None]]:
        try:
            made = list(make(texts))
            if len(made) != len(texts):
                raise ValueError(f"{len(made)} summaries for {len(texts)} texts")
            return made, [None] * len(texts)
        except Exception as error:
            if len(texts) == 1:
                return [None], [str(error)]
            parts = [attempt([t]) for t in texts]
            return [p[0][0] for p in parts], [p[1][0] for p in parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch_size):
                part = rows.iloc[at:at + batch_size]
                made, errors = attempt(part[text].tolist())
                yield part.assign(summary=made, error=errors)

    return df.mapInPandas(run, schema)


def latest_per_title(df: DataFrame, title: str, time: str, tie: str) -> DataFrame:
    """The last written row of each title."""
    rest = [c for c in df.columns if c not in (title, time, tie)]
    return df.groupBy(title).agg(F.max(F.struct(time, tie, *rest)).alias("r")).select(title, "r.*")


def split_corpus(df: DataFrame, key: str, test: float = 0.1, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``part``: test, validation or train."""
    parts = [("test", test), ("validation", validation), ("train", 1.0 - test - validation)]
    return df.withColumn("part", split_column(key, parts, seed))


PAD, UNKNOWN, FIRST_ID = 0, 1, 2


def token_vocabulary(df: DataFrame, text: str, size: int = 30_000) -> DataFrame:
    """(term, id) of the ``size`` most frequent words, numbered from 2 by frequency."""
    words = df.select(F.explode_outer(word_tokens(F.col(text), [])).alias("term")).filter("term IS NOT NULL")
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "term").limit(size)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "term"))
    # the window numbers ``size`` rows at most
    return broadcast_rows(top.select("term", (place + FIRST_ID - 1).alias("id")), size)


VOCABULARY_BYTES = 32 << 20


def padded_ids(df: DataFrame, key: str, text: str, terms: DataFrame, length: int, name: str = "ids") -> DataFrame:
    """(key, ids): the first ``length`` words as ids, unknown words 1, filled up with 0.

    The cut at ``length`` is what the operator is for; a row holds at most that many ids. ``key`` names a row. A vocabulary of
    at most ``VOCABULARY_BYTES``, as measured, goes to the tasks and words are looked up where they lie; a larger one is joined.
    """
    words = df.select(key, F.slice(word_tokens(F.coalesce(F.col(text), F.lit("")), []), 1, length).alias("w"))
    terms = write_once(terms.select("term", F.col("id").cast("int").alias("id")))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 12), F.lit(0))).first()[0]
    if size > VOCABULARY_BYTES:
        return joined_ids(words, key, terms, length, name)
    held = df.sparkSession.sparkContext.broadcast(terms.toArrow().to_pydict())
    schema = T.StructType([words.schema[key], T.StructField(name, T.ArrayType(T.IntegerType()))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = pa.array(held.value["term"], pa.string()), np.array([*held.value["id"], UNKNOWN], np.int32)
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            found = pc.index_in(lists.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.string()), value_set=known)
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            out = np.full((len(lists), length), PAD, np.int32)
            out[row, np.arange(len(row)) - (ends[:-1] - ends[0])[row]] = ids[found.fill_null(len(ids) - 1).to_numpy()]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * length, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=[key, name])

    return words.mapInArrow(number, schema)


def joined_ids(words: DataFrame, key: str, terms: DataFrame, length: int, name: str = "ids") -> DataFrame:
    """(key, ids) of (key, w) by a join with a vocabulary of any size."""
    placed = words.select(key, F.posexplode_outer("w").alias("pos", "term"))
    numbered = placed.join(terms.withColumnRenamed("id", "_id"), "term", "left").select(
        key, "pos", F.when(F.col("term").isNotNull(), F.coalesce("_id", F.lit(UNKNOWN))).alias("_id")
    )
    rows = numbered.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "_id")))).alias("r")
    )
    ids = F.transform("r", lambda r: r["_id"])
    return rows.select(key, F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(length) - F.size("r"))).alias(name))


def length_report(df: DataFrame, key: str, source: str, summary: str) -> DataFrame:
    """Words of source and summary, and their ratio."""
    return df.select(
        key, word_count(F.col(source)).alias("source_words"), word_count(F.col(summary)).alias("summary_words")
    ).withColumn("ratio", ratio(F.col("summary_words"), F.col("source_words")))
