"""Text and label features in long form: TF-IDF, label matrices, chi-squared, splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.fixed_values import STOP_WORDS
from marquee.functions.text import word_tokens
from marquee import runtime
from marquee.runtime import skew_join, spread, stable_hash, write_once


WORDS_AT_ONCE = 1 << 17
VOCABULARY_BYTES = 32 << 20
BATCH_ROWS = "512"


def _counted(lists: pa.ListArray, bigrams: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For some rows at a time: row, number of the term and its count, for all distinct terms of each row, and the terms.

    A piece holds about ``WORDS_AT_ONCE`` words, one row at least. Neighbouring pairs are counted as pairs of numbers and
    spelled once each.
    """
    ends = lists.offsets.to_numpy().astype(np.int64)
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS_AT_ONCE, "right")) - 1)
        last = min(last, len(lists))
        words = lists.values.slice(ends[first], ends[last] - ends[first]).dictionary_encode()
        terms, code = words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
        if bigrams and len(code):
            near = row[1:] == row[:-1]
            pairs, which = np.unique((code[:-1] * len(terms) + code[1:])[near], return_inverse=True)
            left, right = (terms.take(pa.array(side)) for side in np.divmod(pairs, len(terms)))
            code, row = np.append(code, len(terms) + which), np.append(row, row[:-1][near])
            terms = pa.concat_arrays([terms, pc.binary_join_element_wise(left, right, " ")])
        found, tf = np.unique(row * len(terms) + code, return_counts=True)
        row, code = np.divmod(found, max(1, len(terms)))
        yield row, code, tf, terms
        first = last


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by their neighbouring pairs."""
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), last), F.slice(tokens, F.lit(2), last), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, pairs)


def _words(df: DataFrame, key: str, words: Column) -> DataFrame:
    # long texts make a batch as large as its rows are many
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.select(key, F.coalesce(F.array_compact(words), F.array().cast("array<string>")).alias("_words"))


def term_counts(df: DataFrame, key: str, words: Column, bigrams: bool = False) -> DataFrame:
    """(key, term, tf) of every row, counted where the row lies: no text and no word is shuffled.

    ``key`` names a row; two rows of one key are two texts. Null words, and rows without words, have no terms.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, code, tf, terms in _counted(batch.column(1), bigrams):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), terms.take(pa.array(code)), pa.array(tf)], names=[key, "term", "tf"]
                )

    rows = _words(df, key, words)
    schema = T.StructType([rows.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.mapInArrow(count, schema)


def term_totals(counts: DataFrame) -> DataFrame:
    """(term, cf, df) of (key, term, tf): occurrences, and rows that hold the term."""
    return counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def totals_by_term(df: DataFrame, words: Column, bigrams: bool = False) -> DataFrame:
    """(term, cf, df) over all rows; no counts of single rows leave a task."""
    return _totals_of_words(_words(df.withColumn("_row", F.lit(0)), "_row", words), bigrams)


def _totals_of_words(rows: DataFrame, bigrams: bool) -> DataFrame:
    """(term, cf, df) of (key, words), added up in the tasks before terms are shuffled."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, code, tf, terms in _counted(batch.column(0), bigrams):
                cf = np.bincount(code, tf, len(terms)).astype(np.int64)
                rows_of = np.bincount(code, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([terms, pa.array(cf), pa.array(rows_of)], names=["term", "cf", "df"])

    parts = rows.select("_words").mapInArrow(total, "term string, cf long, df long")
    return parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def vocabulary(
    totals: DataFrame, n_rows: Column, max_features: int | None, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """(term, df) of the ``max_features`` most frequent terms of (term, cf, df) whose row frequency is in range."""
    kept = totals.filter((F.col("df") >= min_df) & (F.col("df") <= n_rows * F.lit(max_df)))
    if max_features is not None:
        kept = kept.orderBy(F.desc("cf"), "term").limit(max_features)
    return kept.select("term", "df")


def tfidf(
    df: DataFrame,
    key: str,
    text: str,
    max_features: int | None = 300,
    min_df: int = 1,
    max_df: float = 1.0,
    sublinear: bool = True,
    bigrams: bool = True,
    stop_words: list[str] = STOP_WORDS,
) -> DataFrame:
    """L2-normalised TF-IDF weights as (key, term, weight).

    Weight before the norm: (1 + ln tf) or tf, times ln((1 + n) / (1 + df)) + 1.

    Texts are cut into words once. Terms are counted inside the row; what is shuffled are totals by term, added up in the
    tasks; only a table smaller than a few MB a core is dealt out first (``runtime.spread``). A vocabulary of at most ``VOCABULARY_BYTES``, as measured, goes to the tasks, and rows are weighted and normalised where they
    lie; with a larger one the counts of (key, term) are joined. ``key`` names a row. Rows without any term of the vocabulary have no weights.
    """
    rows = write_once(_words(spread(df.select(key, text)), key, word_tokens(F.col(text), stop_words)))
    n_rows = F.lit(rows.count())
    kept = vocabulary(_totals_of_words(rows, bigrams), n_rows, max_features, min_df, max_df)
    kept = write_once(kept.withColumn("idf", smooth_idf(n_rows, F.col("df"))))
    size = kept.agg(F.coalesce(F.sum(F.octet_length("term") + 12), F.lit(0))).first()[0]
    if size > VOCABULARY_BYTES:
        return whole_weights(term_counts(rows, key, F.col("_words"), bigrams), kept, key, sublinear)
    return _weights_in_row(rows, kept, key, sublinear, bigrams)


def _weights_in_row(rows: DataFrame, kept: DataFrame, key: str, sublinear: bool, bigrams: bool) -> DataFrame:
    """(key, term, weight) of (key, words) with a vocabulary (term, idf) that fits in a task; nothing is shuffled."""
    table = kept.select("term", "idf").toArrow().combine_chunks()
    held = rows.sparkSession.sparkContext.broadcast((table.column("term").to_pylist(), table.column("idf").to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = pa.array(held.value[0], pa.string()), held.value[1]
        for batch in batches:
            for row, code, tf, terms in _counted(batch.column(1), bigrams):
                place = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy()[code]
                used = place >= 0
                row, code, tf, place = row[used], code[used], tf[used], place[used]
                weight = (1.0 + np.log(tf) if sublinear else tf.astype(float)) * idf[place]
                norm = np.sqrt(np.bincount(row, weight * weight, len(batch)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), terms.take(pa.array(code)), pa.array(weight / norm[row])],
                    names=[key, "term", "weight"],
                )

    schema = T.StructType([rows.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    return rows.mapInArrow(weigh, schema)


def smooth_idf(n_rows: Column, df: Column) -> Column:
    return F.ln((n_rows + F.lit(1.0)) / (df + F.lit(1.0))) + F.lit(1.0)


def term_weight(sublinear: bool) -> Column:
    tf = F.col("tf").cast("double")
    return (F.lit(1.0) + F.ln(tf) if sublinear else tf) * F.col("idf")


def whole_weights(counts: DataFrame, idf: DataFrame, key: str, sublinear: bool = False) -> DataFrame:
    """Normalised tf * idf over a vocabulary of any size, keeping the other columns of ``idf``.

    ``idf`` has (term, df, idf, ...); its row frequencies tell which terms are hot and must be spread.
    """
    hot = idf.filter(F.col("df") >= runtime.HOT_ROWS).select("term", F.col("df").alias("_rows"))
    joined = skew_join(counts, idf, ["term"], hot=hot).withColumn("weight", term_weight(sublinear))
    return normalised(joined.drop("tf", "df", "idf"), key)


def normalised(weights: DataFrame, key: str) -> DataFrame:
    """Divide by the L2 norm of the row; a row holds at most its own distinct terms."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weights.withColumn("weight", F.col("weight") / norm)


def field_terms(fields: dict[str, Column], stop_words: list[str] = ()) -> Column:
    """Terms of several text fields, each marked with its field name."""
    def marked(name: str, col: Column) -> Column:
        words = F.coalesce(word_tokens(col, list(stop_words)), F.array().cast("array<string>"))
        return F.transform(words, lambda t: F.concat(F.lit(f"{name}:"), t))

    return F.concat(*[marked(name, col) for name, col in fields.items()])


# ---------------------------------------------------------------- labels


def label_rows(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(key, label), one row per distinct label of a row."""
    return df.select(key, F.explode(F.array_distinct(labels)).alias("label"))


def label_matrix(df: DataFrame, key: str, labels: str, classes: list[str]) -> DataFrame:
    """0/1 column per class, classes sorted."""
    return df.select(key, *[
        F.coalesce(F.array_contains(labels, c).cast("int"), F.lit(0)).alias(str(c)) for c in sorted(classes)
    ])


def chi2_scores(weights: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Chi-squared of each term against a multi-label target, as (term, chi2).

    Observed mass is summed by (label, term), expected is P(label) times the term's total. Pairs that
    never occur add their expected mass, so the sum runs over the occurring pairs only:
    total * sum P(label) + sum((o - e)^2 / e - e). ``labels`` must hold a row per (key, label); keys
    without any label have to appear with a null label, so that they count as rows.
    """
    keyed = weights.join(labels.select(key).distinct(), key, "left_semi")
    totals = keyed.groupBy("term").agg(F.sum("weight").alias("total"))
    observed = keyed.join(labels.filter("label IS NOT NULL"), key).groupBy("label", "term").agg(F.sum("weight").alias("o"))
    n_rows = labels.agg(F.countDistinct(key)).scalar()
    chances = labels.filter("label IS NOT NULL").groupBy("label").agg((F.count(F.lit(1)) / n_rows).alias("p"))
    expected = F.col("p") * F.col("total")
    extra = (
        observed.join(chances, "label").join(totals, "term")
        .groupBy("term", "total")
        .agg(F.sum((F.col("o") - expected) * (F.col("o") - expected) / expected - expected).alias("extra"))
    )
    all_chances = chances.agg(F.sum("p")).scalar()
    return totals.join(extra.drop("total"), "term", "left").select(
        "term", (F.col("total") * all_chances + F.coalesce("extra", F.lit(0.0))).alias("chi2")
    )


def keep_best_terms(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("chi2"), "term").limit(k)


# ---------------------------------------------------------------- splits


def split_column(key: str, parts: list[tuple[str, float]], seed: int = 42) -> Column:
    """Name of the part a row falls in, from a hash of its key; shares are in ten-thousandths."""
    place = F.pmod(stable_hash(seed, F.col(key)), F.lit(10_000))
    col, upto = None, 0
    for name, share in parts[:-1]:
        upto += round(share * 10_000)
        col = F.when(place < upto, name) if col is None else col.when(place < upto, name)
    return F.lit(parts[-1][0]) if col is None else col.otherwise(parts[-1][0])
