"""Exact nearest neighbours, label votes and centroids over tables of vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.runtime import block_rows, stable_hash, write_once

BLOCK_VALUES = 4_000_000  # numbers in the vectors of a block: 32 MB
QUERY_CHUNK = 256
CHUNK_VALUES = 1 << 20  # distances in work at once: 8 MB for each of their matrices
STRETCH = 64
ROWS_PER_CELL = 50_000
MAX_CELLS = 2048


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1).astype(np.float64, copy=False)


def _chunk(rows: int) -> int:
    """Queries whose distances to so many rows are in work at once."""
    return max(1, min(QUERY_CHUNK, CHUNK_VALUES // max(1, rows)))


def _squared_distances(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared L2 distances by one matrix product, and a bound on their errors."""
    squares = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :]
    error = squares * (4 * (left.shape[1] + 4) * np.finfo(np.float64).eps)
    return np.maximum(squares - 2.0 * left @ right.T, 0.0), error


def _best_of_block(
    asked: np.ndarray, vectors: np.ndarray, qids: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool, digits: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query, by query and rank, ties by id.

    The matrix product and a bound on its error only choose candidates: the k-th smallest upper bound is taken from the least of
    stretches of rows, which is no smaller than that of all rows. Candidates get their squared differences added up one by one in
    the order of the positions, so a distance does not depend on the block it is computed in.
    """
    slack = 4 * (vectors.shape[1] + 4) * np.finfo(np.float64).eps
    own, others = (asked**2).sum(1), (vectors**2).sum(1)
    near = (-2.0 * asked) @ vectors.T
    if exclude_self:
        near[qids[:, None] == ids[None, :]] = np.inf
    upper = near + others * (1 + slack)
    if len(ids) >= 2 * STRETCH * k:
        upper = np.fmin.reduceat(upper, np.arange(0, len(ids), STRETCH), axis=1)
    least = np.full(len(asked), np.inf)
    if upper.shape[1] > k:
        least = np.partition(upper, k - 1, axis=1)[:, k - 1] + 2 * slack * own + (0.0 if digits is None else 10.0**-digits)
    near += others * (1 - slack)
    query, row = np.nonzero((near <= least[:, None]) & np.isfinite(near))
    exact = np.zeros(len(row))
    for at in range(0, len(row), most := max(1, CHUNK_VALUES // max(1, vectors.shape[1]))):
        piece = slice(at, at + most)
        exact[piece] = np.cumsum((vectors[row[piece]] - asked[query[piece]]) ** 2, axis=1)[:, -1]
    if digits is not None:
        exact = np.round(exact, digits)
    order = np.lexsort((ids[row], exact, query))
    query, row, exact = query[order], row[order], exact[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], row[best], exact[best]


def _pivots(corpus: DataFrame, key: str, vector: str, cells: int) -> np.ndarray:
    """At most ``cells`` distinct corpus vectors, picked by a hash of the key."""
    picked = corpus.orderBy(stable_hash(11, F.col(key)), key).limit(cells).select(vector).collect()
    return np.unique(np.asarray([r[0] for r in picked], dtype=np.float64), axis=0)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_key: str = "qid",
    key: str = "id",
    vector: str = "embedding",
    payload: list[str] = (),
    exclude_self: bool = False,
    cells: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """The ``k`` nearest corpus rows of every query by squared L2, as (query_key, key, payload, d2, rank).

    Distances are exact to double precision; ``digits`` rounds them before ranking, for callers whose ties have to be
    those of rounded numbers. A vector that is null, empty or holds a null is no row and no query; vectors of
    different length are an error. Each input is computed once, as it is written first.

    Exact, with a corpus smaller than ``k`` giving fewer rows. Neither side is collected or broadcast:
    both are cut into blocks of bounded size, each block pair is one matrix product that keeps its k
    best, and the bests are merged by rank. On a big corpus, rows belong to the cell of their nearest
    pivot (at most 2048), and the triangle inequality leaves out the cells that cannot hold a
    neighbour (Lu et al., "Efficient Processing of k Nearest Neighbor Joins using MapReduce", 2012).
    A cell that holds many rows is just cut into more blocks.
    """
    whole = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    corpus = write_once(corpus.select(F.col(key).alias("id"), F.col(vector).alias("v"), *payload).filter(whole))
    queries = write_once(queries.select(F.col(query_key).alias("qid"), F.col(vector).alias("v")).filter(whole))
    wanted = k + 1 if exclude_self else k
    counts = [F.count(F.lit(1)).alias("rows"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")]
    held, asked_for = corpus.agg(*counts).first(), queries.agg(*counts).first()
    lengths = {r[c] for r in (held, asked_for) if r["rows"] for c in ("least", "most")}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different length: {sorted(lengths)}")
    dim, sized = max(lengths, default=1), held["rows"]
    n_cells = cells or max(1, min(MAX_CELLS, sized // ROWS_PER_CELL))
    spark, most = corpus.sparkSession, max(1024, BLOCK_VALUES // dim)

    if n_cells == 1:
        placed, visits = corpus.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0))
        corpus_sizes, query_sizes = {0: sized}, {0: asked_for["rows"]}
    else:
        pivots = _pivots(corpus, "id", "v", n_cells)
        placed = write_once(_place(corpus, pivots))
        visits = write_once(_visits(queries, placed, pivots, wanted, digits))
        corpus_sizes, query_sizes = _cell_sizes(placed), _cell_sizes(visits)
    per_block = block_rows(spark, sized, most)
    blocks = {c: size // per_block + 1 for c, size in corpus_sizes.items()}
    groups = {c: size // most + 1 for c, size in query_sizes.items()}
    n = max([*blocks, *groups, 0]) + 1
    n_blocks = F.array(*[F.lit(blocks.get(c, 0)) for c in range(n)])
    n_groups = F.array(*[F.lit(groups.get(c, 0)) for c in range(n)])

    def spread(parts, name):
        """Copies for 0..parts-1; a cell without partners is left out."""
        return F.explode(F.when(parts > 0, F.sequence(F.lit(0), parts - 1))).alias(name)

    cell = F.col("cell")
    left = placed.select(
        "id", "v", *payload, "cell",
        F.pmod(F.xxhash64("id"), F.get(n_blocks, cell)).cast("int").alias("cblock"),
        spread(F.get(n_groups, cell), "qblock"),
    )
    right = visits.select(
        "qid", "v", "cell",
        F.pmod(F.xxhash64("qid"), F.get(n_groups, cell)).cast("int").alias("qblock"),
        spread(F.get(n_blocks, cell), "cblock"),
    )
    fields = {f.name: f for f in corpus.schema.fields}
    schema = T.StructType([
        T.StructField("qid", queries.schema["qid"].dataType),
        T.StructField("id", fields["id"].dataType),
        *[fields[p] for p in payload],
        T.StructField("d2", T.DoubleType()),
    ])
    names = list(payload)

    def block(corpus_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not len(corpus_rows) or not len(query_rows):
            kinds = [query_rows.schema.field("qid").type, *[corpus_rows.schema.field(c).type for c in ("id", *names)], pa.float64()]
            return pa.table([pa.array([], t) for t in kinds], names=schema.names)
        vectors, asked = _matrix(corpus_rows["v"]), _matrix(query_rows["v"])
        ids, qids = corpus_rows["id"].to_numpy(), query_rows["qid"].to_numpy()
        found = []
        step = _chunk(len(ids))
        for at in range(0, len(qids), step):
            part = slice(at, at + step)
            query, row, d2 = _best_of_block(asked[part], vectors, qids[part], ids, k, exclude_self, digits)
            found.append((query + at, row, d2))
        query, row, d2 = (np.concatenate(x) for x in zip(*found))
        columns = [query_rows["qid"].take(pa.array(query)), *[corpus_rows[c].take(pa.array(row)) for c in ("id", *names)]]
        return pa.table([*columns, pa.array(d2)], names=schema.names)

    near = (
        left.groupBy("cell", "cblock", "qblock")
        .cogroup(right.groupBy("cell", "cblock", "qblock"))
        .applyInArrow(block, schema)
    )
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id"))
    return (
        near.withColumn("rank", rank).filter(F.col("rank") <= k)
        .withColumnsRenamed({"qid": query_key, "id": key})
    )


def _cell_sizes(df: DataFrame) -> dict[int, int]:
    """Rows per cell, at most ``MAX_CELLS`` numbers."""
    return {r["cell"]: r["n"] for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def _place(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Corpus rows with the cell of their nearest pivot and the distance to it."""
    schema = T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), QUERY_CHUNK):
                part = rows.iloc[start:start + QUERY_CHUNK]
                d = np.sqrt(_squared_distances(_stack(part["v"]), pivots)[0])
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype(np.int32), r=d[np.arange(len(part)), cell])

    return corpus.mapInPandas(place, schema)


def _visits(queries: DataFrame, placed: DataFrame, pivots: np.ndarray, k: int, digits: int | None = None) -> DataFrame:
    """(qid, v, cell) for the cells that can hold one of the k nearest rows of a query.

    From each cell the k smallest and the largest distance to the pivot are read, at most
    2048 * (k + 1) numbers. A query's k-th neighbour is no farther than the k-th smallest of
    (distance to the pivot + distance of the row to the pivot), and no row of a cell is nearer than
    the distance to the pivot minus the largest distance in the cell.
    """
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("r"))
    nearest = placed.select("cell", "r").withColumn("rank", rank).filter(F.col("rank") <= k).collect()
    largest = placed.groupBy("cell").agg(F.max("r").alias("r")).collect()
    near_cell = np.array([r["cell"] for r in nearest])
    near_r = np.array([r["r"] for r in nearest])
    max_r = np.full(len(pivots), -np.inf)
    for row in largest:
        max_r[row["cell"]] = row["r"]
    widest = float(np.linalg.norm(pivots, axis=1).max(initial=0.0) + max_r.max(initial=0.0))
    schema = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), QUERY_CHUNK):
                part = rows.iloc[start:start + QUERY_CHUNK]
                x = _stack(part["v"])
                d = np.sqrt(_squared_distances(x, pivots)[0])
                bound = np.full(len(part), np.inf)
                if len(near_r) >= k:
                    bound = np.partition(d[:, near_cell] + near_r[None, :], k - 1, axis=1)[:, k - 1]
                # the slack covers the errors of the distances, which grow with the lengths of the vectors
                slack = 1e-5 * (np.linalg.norm(x, axis=1) + widest) + (0.0 if digits is None else 10.0 ** (-digits / 2))
                reach = (d - max_r[None, :]) <= (bound + slack)[:, None]
                yield part.assign(cells=[np.flatnonzero(m).astype(np.int32).tolist() for m in reach])

    return queries.mapInPandas(choose, schema).select("qid", "v", F.explode("cells").alias("cell"))


def with_similarity(neighbours: DataFrame) -> DataFrame:
    """Add 1 - d2/100, and the cosine that unit vectors have at that distance."""
    return neighbours.withColumn("similarity_score", F.lit(1.0) - F.col("d2") / 100.0).withColumn(
        "cosine", F.lit(1.0) - F.col("d2") / 2.0
    )


def above(neighbours: DataFrame, threshold: float | None, score: str = "similarity_score") -> DataFrame:
    """Rows at or above the threshold; no threshold keeps all, 0 means 0."""
    return neighbours if threshold is None else neighbours.filter(F.col(score) >= threshold)


def cut_to(neighbours: DataFrame, k: int, query_key: str = "qid") -> DataFrame:
    """The first ``k`` rows left per query, ranked anew."""
    again = F.row_number().over(Window.partitionBy(query_key).orderBy("rank"))
    return neighbours.withColumn("rank", again).filter(F.col("rank") <= k)


def bounded_k(col, default: int = 5, least: int = 1, most: int = 10):
    """A wanted number of rows, kept within limits."""
    return F.least(F.greatest(F.coalesce(col, F.lit(default)), F.lit(least)), F.lit(most))


def context_json(neighbours: DataFrame, query_key: str, columns: list[str], n: int = 3) -> DataFrame:
    """The ``n`` best rows of each query as one JSON text."""
    rows = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    best = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return neighbours.filter(F.col("rank") <= n).groupBy(query_key).agg(F.to_json(best).alias("context"))


def label_vote(
    neighbours: DataFrame, query_key: str = "qid", label: str = "label", score: str = "similarity_score",
    share: float = 0.5,
) -> DataFrame:
    """Labels whose summed similarity is at least ``share`` of the query's best label."""
    scored = neighbours.groupBy(query_key, label).agg(F.sum(score).alias("score"))
    top = F.max("score").over(Window.partitionBy(query_key))
    return scored.withColumn("top", top).filter(F.col("score") >= F.col("top") * share).drop("top")


def centroids(df: DataFrame, label: str, vector: str, min_rows: int = 10) -> DataFrame:
    """Mean vector of each label with enough rows, as (label, n, centroid)."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    grouped = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), mean.alias("m")
    )
    return grouped.filter(F.col("n") >= min_rows).select("label", "n", vector_to_array("m").alias("centroid"))


LABEL_BLOCK = 512


def centroid_cosines(means: DataFrame) -> DataFrame:
    """Cosine of every two label centroids, as (label, other, cosine); the result is the matrix, one row per cell.

    Labels are dealt into blocks, and every two blocks meet in one matrix product of unit centroids. A label without direction
    has null cosines.
    """
    means = write_once(means.select("label", "centroid"))
    blocks = means.count() // LABEL_BLOCK + 1
    own = F.pmod(F.xxhash64("label"), F.lit(blocks))
    dealt = means.withColumns({"own": own, "with": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    dealt = dealt.withColumns({"low": F.least("own", "with"), "high": F.greatest("own", "with")})
    schema = T.StructType([
        T.StructField("label", means.schema["label"].dataType), T.StructField("other", means.schema["label"].dataType),
        T.StructField("cosine", T.DoubleType()),
    ])

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        x = _stack(frame["centroid"])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)
        label, place = frame["label"].to_numpy(), frame["own"].to_numpy()
        first, second = np.flatnonzero(place == low), np.flatnonzero(place == high)
        cells = pd.DataFrame({
            "label": np.repeat(label[first], len(second)), "other": np.tile(label[second], len(first)), "cosine": (x[first] @ x[second].T).ravel(),
        })
        if low != high:
            cells = pd.concat([cells, cells.rename(columns={"label": "other", "other": "label"})])
        return cells[["label", "other", "cosine"]]

    cells = dealt.groupBy("low", "high").applyInPandas(product, schema)
    return cells.withColumn("cosine", F.nullif("cosine", F.lit(float("nan"))))


def embed(
    df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], batch_size: int = 32, name: str = "embedding"
) -> DataFrame:
    """Add a vector column from a batch encoder, ``batch_size`` texts a call."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch_size):
                part = rows.iloc[at:at + batch_size]
                yield part.assign(**{name: list(encoder(part[text].fillna("").tolist()))})

    return df.mapInPandas(run, schema)


@lru_cache(maxsize=200_000)
def _number_and_sign(word: str) -> tuple[int, float]:
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16), 1.0 if int(digest[8], 16) < 8 else -1.0


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed word counts: md5 of the word gives its place and its sign."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in re.split(r"[ \t\n\r\f\v]+", text.lower()):
                if word:
                    number, sign = _number_and_sign(word)
                    out[row, number % dim] += sign
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return encode
