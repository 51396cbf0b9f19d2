"""Quality scores by random Fourier features, ridge regression and isotonic calibration (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import prepare, slices, text_or_empty, texts_of
from marquee.llm.shingles import words
from marquee.runtime import write_once

FOURIER = 256
TRAINING_ROWS = 200_000
RIDGE = 1e-3
STATISTICS = 17
_CLASSES = np.zeros((256, 8))
for _i, _bytes in enumerate([
    range(97, 123), range(65, 91), range(48, 58), [32], [10], [33, 63],
    [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-"], range(128, 256),
]):
    _CLASSES[list(_bytes), _i] = 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics a text, over the whole text: sizes, shares of kinds of bytes, words and repetition."""
    rows = len(offsets) - 1
    hashes, places = words(data, offsets)
    out = np.zeros((rows, STATISTICS))
    for i in range(rows):
        part = data[offsets[i] : offsets[i + 1]]
        own = hashes[places[i] : places[i + 1]]
        n, m = max(len(part), 1), max(len(own), 1)
        counts = np.bincount(part, minlength=256)
        shares = counts @ _CLASSES / n
        letters = counts[counts > 0] / n
        distinct, times = np.unique(own, return_counts=True)
        pairs = np.unique(own[:-1] * np.uint64(31) + own[1:]) if len(own) > 1 else own
        out[i] = [
            np.log1p(len(part)), np.log1p(len(own)), *shares, shares[1] / max(shares[0] + shares[1], 1e-9),
            n / m, len(distinct) / m, len(pairs) / max(m - 1, 1), (times.max() if len(times) else 0) / m,
            -(letters * np.log(letters)).sum(), (counts[46] + counts[44]) / m,
        ]
    return out


def _measured(df: DataFrame) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for first, last in slices(offsets):
                values = statistics(data, offsets[first : last + 1])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, values.size + 1, STATISTICS, dtype=np.int32)), pa.array(values.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=["doc_id", "x"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(measure, "doc_id long, x array<double>")


class Fourier:
    """cos(Wx + b) of scaled statistics: products of two such rows approach the Gaussian kernel of the two texts."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = 7, width: float = 3.0):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = draw.normal(0, 1 / width, (len(mean), features))
        self.b = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z, np.ones((len(z), 1))])


def normal_equations(rows: DataFrame, features: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over ``rows`` (x, y): one matrix a task, added up by row of the matrix."""
    size = len(features.b) + len(features.mean) + 1

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for frame in frames:
            if len(frame):
                z = features(np.stack(frame["x"].to_numpy()))
                total += z.T @ np.column_stack([z, frame["y"].to_numpy()])
        yield pd.DataFrame({"i": np.arange(size), "v": list(total)})

    summed = [F.sum(F.element_at("v", k + 1)).alias(f"v{k}") for k in range(size + 1)]
    parts = rows.mapInPandas(add, "i int, v array<double>").groupBy("i").agg(*summed).orderBy("i").toPandas()
    total = parts.drop(columns="i").to_numpy(np.float64)
    return total[:, :-1], total[:, -1]


def isotonic(scores: np.ndarray, label_sum: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to ``label_sum / n`` in the order of ``scores`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for i, (s, m) in enumerate(zip(label_sum, n)):
        blocks.append([s, m, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, m2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + m2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, s / m) for s, m, k in blocks]) if blocks else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(
    df: DataFrame, labels: DataFrame, threshold: float = 0.3, features: int = FOURIER, training_rows: int = TRAINING_ROWS
) -> DataFrame:
    """Per document: (doc_id, held_out, score, predicted), learnt from ``labels`` (doc_id, quality).

    Statistics of each whole text are computed once and written. A ridge regression on random Fourier
    features of them is fitted by the normal equations, summed in every task, over labelled documents whose
    crc32(doc_id) mod 5 is not 0: all of them, or, beyond ``training_rows``, those with the smallest hashes.
    Isotonic regression on the same rows turns its output into a probability. doc_id, lang and source
    never enter a score.

    A null text counts as empty and is scored like one. A null doc_id or label is scored but not learnt
    from, and not held out; labels of a repeated doc_id count once, by their mean. Repeated rows get equal scores. Without
    any label the score is 0.5. Other columns play no part.
    """
    spark = df.sparkSession
    prepare(spark)
    measured = write_once(_measured(df))
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).dropna()
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("y").alias("y"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    n = known.count()
    if n > training_rows:
        known = known.filter(order < int((1 << 30) * (training_rows / n)))
    train = write_once(measured.join(known, "doc_id").select("x", "y"))
    spread = train.select(*[F.element_at("x", k + 1).alias(f"x{k}") for k in range(STATISTICS)])
    first = spread.agg(
        F.count(F.lit(1)), *[f(c) for c in spread.columns for f in (F.avg, F.stddev_pop)]
    ).first()
    if not first[0]:
        constant = measured.select("doc_id", F.lit(0.5).alias("score"))
        return constant.select(
            "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
        )
    mean, deviation = np.array(first[1::2]), np.array(first[2::2])
    fourier = Fourier(mean, np.where(deviation > 1e-9, deviation, 1.0), features)
    gram, right = normal_equations(train, fourier)
    weights = np.linalg.solve(gram + RIDGE * first[0] * np.eye(len(gram)) / 100, right)

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(fourier(np.stack(x.to_numpy())) @ weights if len(x) else np.zeros(0))

    step = F.round(raw("x") * 512).cast("int").alias("step")
    curve = train.select("y", step).groupBy("step").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("step").toPandas()
    places = curve["step"].to_numpy() / 512
    fitted = isotonic(places, curve["s"].to_numpy(), curve["n"].to_numpy())

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series(np.zeros(0))
        values = fourier(np.stack(x.to_numpy())) @ weights
        return pd.Series(np.clip(np.interp(values, places, fitted), 0, 1))

    scored = measured.select("doc_id", score("x").alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
