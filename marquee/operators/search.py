"""TF-IDF cosine search of many queries over a whole corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.features import smooth_idf, term_counts, term_totals, vocabulary, whole_weights
from marquee.runtime import block_rows, spread, write_once

DOC_BLOCK = 16_384
QUERY_BLOCK = 512


def tfidf_search(
    docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, doc_terms: Column, query_terms: Column, k: int,
    digits: int | None = None,
) -> DataFrame:
    """The ``k`` documents of highest cosine for each query, as (query_key, doc_key, score, rank).

    ``digits`` rounds the scores before ranking, for callers whose ties have to be those of rounded numbers.

    ``doc_terms`` and ``query_terms`` are arrays of words made from the columns of their table.
    Document frequencies come from the corpus; query terms the corpus does not know are dropped. Documents are reduced to the terms
    that queries use, both sides are cut into blocks of bounded size, and each block pair keeps its
    k best, so no term list is ever joined with all its documents and queries.
    """
    # written once: cutting text into words costs more than reading the counts again
    counts = write_once(term_counts(spread(docs), doc_key, doc_terms))
    n_docs = docs.count()
    idf = vocabulary(term_totals(counts), F.lit(n_docs), None).withColumn("idf", smooth_idf(F.lit(n_docs), F.col("df")))
    idf = write_once(idf)
    query_weights = write_once(whole_weights(term_counts(queries, query_key, query_terms), idf, query_key))
    # numbers instead of words go to the blocks; they are written, so they stay what they are
    asked = write_once(query_weights.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    # the norm of a document needs all its terms, its score only those that are asked for
    doc_weights = whole_weights(counts, idf.join(asked, "term", "left"), doc_key).filter("number IS NOT NULL")

    def as_rows(weights: DataFrame, key: str, name: str) -> DataFrame:
        pairs = F.collect_list(F.struct("number", "weight"))
        return weights.groupBy(F.col(key).alias(name)).agg(pairs.alias("_p")).select(
            name, F.col("_p.number").alias("numbers"), F.col("_p.weight").alias("weights")
        )

    n_blocks = n_docs // block_rows(docs.sparkSession, n_docs, DOC_BLOCK) + 1
    n_groups = queries.count() // QUERY_BLOCK + 1
    left = as_rows(doc_weights, doc_key, "id").select(
        "*", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("cblock"),
        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("qblock"),
    )
    right = as_rows(query_weights.join(asked, "term"), query_key, "qid").select(
        "*", F.pmod(F.xxhash64("qid"), F.lit(n_groups)).cast("int").alias("qblock"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("cblock"),
    )
    schema = T.StructType([
        T.StructField("qid", queries.schema[query_key].dataType),
        T.StructField("id", docs.schema[doc_key].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def block(doc_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if doc_rows.empty or query_rows.empty:
            return pd.DataFrame({f.name: pd.Series(dtype="object") for f in schema.fields})
        known = np.unique(np.concatenate(query_rows["numbers"].to_list()))
        numbers = np.concatenate(doc_rows["numbers"].to_list())
        weights = np.concatenate(doc_rows["weights"].to_list())
        row = np.repeat(np.arange(len(doc_rows)), doc_rows["numbers"].map(len))
        place = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
        used = known[place] == numbers
        place, weights, row = place[used], weights[used], row[used]
        ids = doc_rows["id"].to_numpy()
        out = []
        for qid, asked_numbers, asked_weights in zip(query_rows["qid"], query_rows["numbers"], query_rows["weights"]):
            wanted = np.zeros(len(known))
            wanted[np.searchsorted(known, asked_numbers)] = asked_weights
            scores = np.bincount(row, wanted[place] * weights, len(ids))
            near = np.flatnonzero(scores > 0)
            if digits is not None:
                scores = np.round(scores, digits)
            if len(near) > k:
                near = near[scores[near] >= -np.partition(-scores[near], k - 1)[k - 1]]
            near = near[np.lexsort((ids[near], -scores[near]))][:k]
            out.append(pd.DataFrame({"qid": qid, "id": ids[near], "score": scores[near]}))
        return pd.concat(out)

    best = left.groupBy("cblock", "qblock").cogroup(right.groupBy("cblock", "qblock")).applyInPandas(block, schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return (
        best.withColumn("rank", rank).filter(F.col("rank") <= k)
        .withColumnsRenamed({"qid": query_key, "id": doc_key})
    )
