"""Language of every document: family first, then one-versus-one linear SVMs inside it (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import mix, prepare, release, slices, text_or_empty, texts_of
from marquee.llm.quality import held_out

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 500
LANGUAGES = 2000
FITTED_ROWS = 128  # texts of the sample that are in double precision at a time
FAMILY_SIZE = 4
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[~_LETTER] = 32


def profile(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Per text: root shares of hashed runs of two and three bytes, digits and signs as one mark, unit length."""
    low = int(offsets[0])
    part = _LOWER[data[low : int(offsets[-1])]].astype(np.uint64)
    out = np.zeros((len(offsets) - 1, dimensions), np.float32)
    if len(part) < 3:
        part = np.append(part, np.full(3, 32, np.uint64))
    two = part[:-1] * np.uint64(257) + part[1:]
    codes = [mix(two) % np.uint64(dimensions), mix(two[:-1] * np.uint64(257) + part[2:]) % np.uint64(dimensions)]
    for i, (a, b) in enumerate(zip(offsets[:-1] - low, offsets[1:] - low)):
        for width, code in zip((2, 3), codes):
            if b - a >= width:
                out[i] += np.bincount(code[a : b - width + 1].astype(np.int64), minlength=dimensions)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _profiles(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray]]:
    release()
    data, offsets = texts_of(batch.column(batch.schema.get_field_index(name)))
    for first, last in slices(offsets):
        yield first, last, profile(data, offsets[first : last + 1])


def families(centres: np.ndarray, size: int = FAMILY_SIZE) -> list[list[int]]:
    """Languages in groups: the closest two groups join while their centres are nearer than usual and small enough."""
    groups = [[i] for i in range(len(centres))]
    if len(groups) < 3:
        return [list(range(len(centres)))] if groups else []
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    usual = np.mean(gaps[np.triu_indices(len(centres), 1)])
    while len(groups) > 2:
        gap = {
            (a, b): np.mean([gaps[i, j] for i in groups[a] for j in groups[b]])
            for a, b in combinations(range(len(groups)), 2) if len(groups[a]) + len(groups[b]) <= size
        }
        if not gap or min(gap.values()) > usual:
            break
        a, b = min(gap, key=gap.get)
        groups[a] += groups.pop(b)
    return groups


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a linear SVM (last one: bias), by averaged subgradient steps on the hinge loss in a fixed order.

    The steps are in double precision over ``FITTED_ROWS`` rows at a time, so that ``x`` is neither widened nor copied whole.
    """
    w, mean = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    pull = y * np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    for t in range(1, rounds * 10 + 1):
        step = penalty * w
        for i in range(0, len(x), FITTED_ROWS):
            z, own = x[i : i + FITTED_ROWS].astype(np.float64), y[i : i + FITTED_ROWS]
            force = np.where((z @ w[:-1] + w[-1]) * own < 1, pull[i : i + FITTED_ROWS], 0.0)
            step[:-1] -= force @ z
            step[-1] -= force.sum()
        w -= 1 / (penalty * (t + 20)) * step
        if t > rounds * 5:
            mean += w
    return mean / (rounds * 5)


class Discriminator:
    """Family by one-versus-rest SVMs, then the language by votes of the SVM of each pair within the family."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        names = sorted(set(languages))
        at = np.array([names.index(n) for n in languages])
        self.names = names
        centres = np.array([x[at == i].mean(axis=0) for i in range(len(names))])
        self.groups = families(centres) if names else []
        family = np.zeros(len(names), int)
        for k, g in enumerate(self.groups):
            family[g] = k
        self.top = None
        if len(self.groups) > 1:
            self.top = np.array([svm(x, np.where(family[at] == k, 1.0, -1.0)) for k in range(len(self.groups))], np.float32)
        self.pairs = {}
        for g in self.groups:
            for a, b in combinations(g, 2):
                rows = (at == a) | (at == b)
                self.pairs[a, b] = svm(x[rows], np.where(at[rows] == a, 1.0, -1.0)).astype(np.float32)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's language, and a score between 0 and 1 from the smaller of the deciding margins."""
        z = np.hstack([x, np.ones((len(x), 1), np.float32)])
        rows = np.arange(len(z))
        family, margin = np.zeros(len(z), int), np.full(len(z), 1.0)
        if self.top is not None:
            values = z @ self.top.T
            family = values.argmax(axis=1)
            margin = np.partition(values, -2, axis=1)[:, -1] - np.partition(values, -2, axis=1)[:, -2]
        language = np.zeros(len(z), int)
        for k, group in enumerate(self.groups):
            own = rows[family == k]
            votes = np.zeros((len(own), len(group)))
            sums = np.zeros((len(own), len(group)))
            for (i, a), (j, b) in combinations(enumerate(group), 2):
                value = z[own] @ self.pairs[a, b]
                votes[:, i] += value > 0
                votes[:, j] += value <= 0
                sums[:, i] += value
                sums[:, j] -= value
            order = votes + 0.5 * np.tanh(sums / max(len(group), 1))
            best = order.argmax(axis=1)
            language[own] = np.array(group)[best]
            if len(group) > 1:
                margin[own] = np.minimum(margin[own], np.abs(sums[np.arange(len(own)), best]) / (len(group) - 1))
        return language, 1 / (1 + np.exp(-3 * margin))


def learn(df: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Discriminator | None:
    """Fit on at most ``sample`` texts a language: those with the smallest hashes of the learnable rows.

    The sample is the stated bound of the training set; the rank filter is applied in every task before the shuffle.
    """
    rows = df.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    drawn = F.xxhash64("doc_id", "text").alias("h")
    picked = rows.select("lang", drawn).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    picked = picked.filter(F.col("rank") <= sample).groupBy("lang").agg(F.max("h").alias("last"))
    bounds = picked.limit(LANGUAGES + 1).collect()
    if len(bounds) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not bounds:
        return None
    small = df.sparkSession.createDataFrame([(b["lang"], b["last"]) for b in bounds], "lang string, last long")
    chosen = rows.select("lang", "text", drawn).join(F.broadcast(small), "lang").filter(F.col("h") <= F.col("last"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, values in _profiles(batch, "text"):
                blobs = [v.astype(np.float16).tobytes() for v in values]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary())], names=["lang", "h", "x"])

    # Arrow columns hold the sample once; rows would hold it on the driver's heap and again as Python objects
    found = chosen.select("lang", "h", "text").mapInArrow(measure, "lang string, h long, x binary").toArrow()
    order = pc.sort_indices(found, sort_keys=[(c, "ascending") for c in found.column_names]).to_pylist()
    languages = found.column("lang").to_pylist()
    order = [i for _, own in groupby(order, key=lambda i: languages[i]) for i in islice(own, sample)]
    x = np.empty((len(order), DIMENSIONS), np.float32)
    for k, i in enumerate(order):
        x[k] = np.frombuffer(found.column("x")[i].as_buffer(), np.float16)
    del found
    return Discriminator(x, [languages[i] for i in order])


def identify(df: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``df`` with held_out, lang_pred and score.

    The family of a text is found first, then its language by one-versus-one linear SVMs within the family.
    Families come from the languages' own centres. Training takes text and lang of rows whose crc32(doc_id) mod 5 is not
    0, at most ``sample`` a language; every text is predicted as a whole. doc_id, lang and source never enter a prediction.

    ``und`` with score 0 is returned for a null text, a text without a letter, and for all texts when nothing can be
    learnt. A null doc_id is not held out. Repeated rows get equal answers. Input columns with an added name are replaced.
    """
    prepare(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c in ("held_out", "lang_pred", "score")])
    model = learn(df, sample)
    base = df.withColumn("held_out", held_out(F.col("doc_id")))
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang int, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        release()
        languages, scores = np.zeros(len(text), np.int32), np.zeros(len(text))
        data, offsets = texts_of(pa.array(text, pa.string()))
        for first, last in slices(offsets):
            languages[first:last], scores[first:last] = shared.value(profile(data, offsets[first : last + 1]))
        return pd.DataFrame({"lang": languages, "score": scores})

    # so marked, Spark does not copy the prediction into a later filter and compute it twice, in twice the workers
    predict = predict.asNondeterministic()
    names = F.array(*[F.lit(n) for n in model.names])
    known: Column = F.col("text").rlike(r"\p{L}")
    return (
        base.withColumn("_llm_p", predict(text_or_empty()))
        .withColumn("lang_pred", F.when(known, F.element_at(names, F.col("_llm_p.lang") + 1)).otherwise(UNKNOWN))
        .withColumn("score", F.when(known, F.col("_llm_p.score")).otherwise(0.0))
        .drop("_llm_p")
    )
