"""Entity dictionaries, labelled queries, dictionary tagging and span scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.fixed_values import FALLBACK_CAST, FALLBACK_DIRECTORS, LABEL_ALIASES, QUERY_TEMPLATES
from marquee.functions.labels import split_names, strip
from marquee.functions.values import ratio
from marquee.runtime import BROADCAST_ROWS, dense_index, skew_join, stable_hash, write_once

BROADCAST_BYTES = 32 << 20
FILTER_BITS = 1 << 28
PIECE_WORDS = 1 << 17
LABELS = ["DIRECTOR", "CAST", "GENRE"]


def entity_dictionary(catalog: DataFrame, director: str, cast: str, genres: list[str]) -> DataFrame:
    """(label, entity): distinct directors, cast names longer than two characters, and genres."""
    directors = catalog.select(F.lit("DIRECTOR").alias("label"), strip(F.col(director)).alias("entity"))
    people = catalog.select(F.lit("CAST").alias("label"), F.explode_outer(split_names(F.col(cast))).alias("entity"))
    named = directors.filter(F.length("entity") > 0).unionByName(people.filter(F.length("entity") > 2)).distinct()
    return named.unionByName(genre_rows(catalog.sparkSession, genres))


def genre_rows(spark: SparkSession, genres: list[str]) -> DataFrame:
    return spark.createDataFrame([("GENRE", g) for g in sorted(set(genres))], "label string, entity string")


def fallback_dictionary(spark: SparkSession) -> DataFrame:
    """The built-in names, for when there is no catalog."""
    rows = [("DIRECTOR", n) for n in FALLBACK_DIRECTORS] + [("CAST", n) for n in FALLBACK_CAST]
    rows += [("GENRE", g) for g in LABEL_ALIASES if g != "unknown"]
    return spark.createDataFrame(rows, "label string, entity string")


def generate_queries(samples: DataFrame, key: str, dictionary: DataFrame, seed: int = 42) -> DataFrame:
    """One labelled query per sample row: (key, text, entities) with template and names drawn by hash.

    A second name of the same kind differs from the first where the dictionary holds another one.
    """
    # written once: the catalog behind it is scanned no second time
    indexed = write_once(dense_index(dictionary.distinct(), "label", "entity", "place"))
    sizes = {r["label"]: r["n"] for r in indexed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = [t for t, _ in QUERY_TEMPLATES]
    slots = [[(f"{{{n}}}", label) for n, label in s] for _, s in QUERY_TEMPLATES]
    if any(label not in sizes for s in slots for _, label in s):
        raise ValueError("the dictionary lacks a kind of entity the templates ask for")
    all_slots = F.array(*[F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(l).alias("label")) for s, l in row]) for row in slots])
    slots_of = F.get(all_slots, F.col("t"))
    number = F.pmod(stable_hash(seed, F.col(key)), F.lit(len(texts))).cast("int")
    size = F.element_at(F.create_map(*[F.lit(x) for p in sizes.items() for x in p]), F.col("label"))
    first = F.pmod(stable_hash(seed + 1, F.col(key)), size)
    step = F.when(size > 1, F.pmod(stable_hash(seed + 2, F.col(key)), size - 1) + 1).otherwise(0)
    same_kind = F.col("pos") * (F.get(slots_of, F.lit(0))["label"] == F.col("label")).cast("int")
    # templates and slots follow from their number, so what is shuffled is numbers and names
    asked = samples.select(key, number.alias("t")).select(key, "t", F.posexplode(slots_of).alias("pos", "s")).select(
        key, "t", "pos", "s.label"
    ).withColumn("place", F.pmod(first + same_kind * step, size))
    # a small kind is asked for by many queries an entry: it goes to the tasks, and no entry gets all its queries in one of them
    is_small = F.col("label").isin([label for label, n in sizes.items() if n <= BROADCAST_ROWS])
    named = asked.filter(is_small).join(F.broadcast(indexed.filter(is_small)), ["label", "place"]).unionByName(
        asked.filter(~is_small).join(indexed.filter(~is_small), ["label", "place"])
    )
    filled = named.groupBy(key, "t").agg(F.sort_array(F.collect_list(F.struct("pos", "label", "entity"))).alias("picks"))
    template = F.get(F.array(*[F.lit(t) for t in texts]), F.col("t"))
    text = F.aggregate("picks", template, lambda acc, p: F.replace(acc, F.get(slots_of, p["pos"])["slot"], p["entity"]))
    return mark_spans(filled.select(key, text.alias("text"), "picks"), key, "text", "picks")


def mark_spans(df: DataFrame, key: str, text: str, picks: str) -> DataFrame:
    """Add ``entities``: for each pick in order, its first occurrence that overlaps no earlier pick's.

    That occurrence is the first one of the text or the first one after the end of an earlier span.
    """
    body = F.col(text)

    def add(spans: Column, pick: Column) -> Column:
        length = F.length(pick["entity"])
        froms = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        starts = F.transform(froms, lambda at: F.position(pick["entity"], body, at + 1) - 1)
        clear = F.filter(
            starts, lambda at: (at >= 0) & ~F.exists(spans, lambda s: (at < s["end"]) & (s["start"] < at + length))
        )
        start = F.array_min(clear)
        span = F.struct(start.alias("start"), (start + length).alias("end"), pick["label"].alias("label"))
        return F.when((length > 0) & start.isNotNull(), F.concat(spans, F.array(span))).otherwise(spans)

    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return df.select(key, text, F.array_sort(F.aggregate(picks, none, add)).alias("entities"))


def spans_valid(text: Column, entities: Column) -> Column:
    """Whether all spans lie in the text, are not empty and do not overlap."""
    ordered = F.array_sort(entities)
    nexts = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    overlap = F.exists(
        F.zip_with(ordered, nexts, lambda a, b: F.coalesce(a["end"] > b["start"], F.lit(False))), lambda x: x
    )
    outside = F.exists(
        entities, lambda e: (e["start"] < 0) | (e["end"] > F.length(text)) | (e["start"] >= e["end"])
    )
    return ~overlap & ~outside


# ---------------------------------------------------------------- tagging

_HEAD = r"^[\s/\"'(\[‘“]+"
_EDGE = _HEAD + r"|(?:['’]s)?[\s\"'.,!?;:)\]’”]*$"
_WORD = r"[\s/]*[^\s/]+"


def words_of(text: Column) -> Column:
    """Words cut at white space and slashes, each with what stands before it, so that lengths add up to places."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def normal_token(token: Column) -> Column:
    """The word in lower case, without quotes, brackets and marks at its ends and without a possessive s."""
    return F.lower(F.regexp_replace(token, _EDGE, ""))


def normal_name(name: Column) -> Column:
    return F.array_join(F.transform(words_of(strip(name)), normal_token), " ")


def _hashes(values: pa.Array | list[str]) -> np.ndarray:
    """A 64-bit hash of each string, the same in every worker."""
    return pd.util.hash_array(np.asarray(values.to_pylist() if isinstance(values, pa.Array) else values, object), categorize=False)


def _bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Three bits of the filter for each 64-bit hash, in 32-bit steps of one another."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(j) * step) % np.uint64(bits) for j in range(3)]).astype(np.int64)


def bloom_filter(df: DataFrame, column: str, rows: int) -> np.ndarray:
    """A Bloom filter of the values of ``column``, as bytes: 10 bits a value, ``FILTER_BITS`` at most.

    Every task sets the bits of its own rows, and equal stretches of the bit field are united before they reach the driver.
    """
    bits = 1 << max(13, min(FILTER_BITS.bit_length() - 1, (rows * 10).bit_length()))
    stretch = 1 << 13

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _bits_of(_hashes(batch.column(0)), bits):
                np.bitwise_or.at(field, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = field.reshape(-1, stretch // 8)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "bits"]
        )

    def united(table: pa.Table) -> pa.Table:
        fields = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.bitwise_or.reduce(fields).tobytes()], pa.binary())})

    hashed = df.select(column).mapInArrow(own, "part long, bits binary")
    field = np.zeros((bits // stretch, stretch // 8), np.uint8)
    for row in hashed.groupBy("part").applyInArrow(united, "part long, bits binary").collect():
        field[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return field.ravel()


def may_hold(df: DataFrame, column: str, field: np.ndarray) -> DataFrame:
    """The rows whose ``column`` may be a value of the filter; none that is one goes."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        return pd.Series(_in_filter(values.tolist(), shared.value))

    return df.filter(held(F.col(column)))


def _in_filter(values: list[str], field: np.ndarray) -> np.ndarray:
    at = _bits_of(_hashes(values), len(field) * 8)
    return ((field[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0).astype(bool)


def _in_pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], list[str], np.ndarray]]:
    """Rows of a batch (key, words, normal words) with about ``PIECE_WORDS`` words at a time: the row of each word, words, normal words, words to the row's end."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PIECE_WORDS, "right")))
        sizes = np.diff(ends[first:last], prepend=before)
        row = np.repeat(np.arange(first, last), sizes)
        part = batch.slice(first, last - first)
        words, normal = (part.column(c).flatten().to_pylist() for c in (1, 2))
        yield row, words, normal, ends[row] - before - np.arange(len(row))
        first = last


def _runs(normal: list[str], left: np.ndarray, n: int) -> tuple[np.ndarray, list[str]]:
    """Places and texts of all runs of ``n`` words that end in their row."""
    if n == 1:
        return np.arange(len(normal)), normal
    at = np.flatnonzero(left >= n)
    return at, [" ".join(normal[i : i + n]) for i in at.tolist()]


def _placed(batch: pa.RecordBatch, row: np.ndarray, words: list[str], at: list[int], n: list[int]) -> list[pa.Array]:
    """For runs of ``n`` words from ``at``: key, number of the first word, number of words, characters before it, the text."""
    chars = np.cumsum([0, *map(len, words)])
    at = np.array(at, np.int64)
    first = np.searchsorted(row, row[at])
    raw = ["".join(words[i : i + k]) for i, k in zip(at.tolist(), n)]
    return [
        batch.column(0).take(pa.array(row[at])), pa.array(at - first, pa.int32()), pa.array(n, pa.int32()),
        pa.array(chars[at] - chars[first], pa.int32()), pa.array(raw, pa.string()),
    ]


def tag(queries: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, start, end, label, surface) of dictionary entries in each text.

    Runs of 1 to n words are matched to the dictionary where the text lies, n being the length of the longest entry. A dictionary of at most
    ``BROADCAST_BYTES`` goes to the tasks, and nothing is shuffled. A larger one is made a Bloom filter first, and only the runs that it
    lets through become rows and are shuffled to the dictionary, frequent ones spread over tasks.
    Overlaps are settled per text: longest first, then leftmost.
    """
    names = dictionary.select("label", normal_name(F.col("entity")).alias("run")).filter("run <> ''")
    names = write_once(names.groupBy("run").agg(F.min("label").alias("label")))
    sizes = names.groupBy(F.size(F.split("run", " ")).alias("n")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("run") + 12).alias("bytes")
    ).collect()
    lengths = sorted((r["n"] for r in sizes), reverse=True)
    if not lengths:
        return queries.select(key).limit(0).selectExpr(
            key, "0 AS start", "0 AS end", "'' AS label", "'' AS surface"
        )
    words = queries.select(key, words_of(F.col(text)).alias("_words"))
    words = words.select(key, "_words", F.transform("_words", normal_token).alias("_normal"))
    if sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES:
        chosen = _tagged_in_place(words, key, lengths, names)
    else:
        chosen = _tagged_by_join(words, key, lengths, names, sum(r["rows"] for r in sizes))
    surface = F.regexp_replace("raw", _EDGE, "")
    start = F.col("at") + F.length("raw") - F.length(F.regexp_replace("raw", _HEAD, ""))
    return chosen.select(key, start.alias("start"), "label", surface.alias("surface")).select(
        key, "start", (F.col("start") + F.length("surface")).alias("end"), "label", "surface"
    )


_RUN = "i int, n int, at int, raw string"


def _tagged_in_place(words: DataFrame, key: str, lengths: list[int], names: DataFrame) -> DataFrame:
    """(key, i, n, at, raw, label) of the runs that stay, settled inside the row. ``lengths``: longest first."""
    table = names.select("run", "label").toArrow()
    shared = words.sparkSession.sparkContext.broadcast(dict(zip(table["run"].to_pylist(), table["label"].to_pylist())))
    schema = T.StructType([words.schema[key], *T.StructType.fromDDL(f"{_RUN}, label string")])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for row, own, normal, left in _in_pieces(batch):
                taken = bytearray(len(own))
                at, n, labels = [], [], []
                for k in lengths:
                    for i, run in zip(*_runs(normal, left, k)):
                        if run in known and not any(taken[i : i + k]):
                            taken[i : i + k] = b"\1" * k
                            at.append(i)
                            n.append(k)
                            labels.append(known[run])
                yield pa.RecordBatch.from_arrays(
                    [*_placed(batch, row, own, at, n), pa.array(labels, pa.string())], names=schema.names
                )

    return words.mapInArrow(settle, schema)


def _tagged_by_join(words: DataFrame, key: str, lengths: list[int], names: DataFrame, rows: int) -> DataFrame:
    """As ``_tagged_in_place``, with a dictionary of any size."""
    shared = words.sparkSession.sparkContext.broadcast(bloom_filter(names, "run", rows))
    schema = T.StructType([words.schema[key], *T.StructType.fromDDL(f"{_RUN}, run string")])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own, normal, left in _in_pieces(batch):
                at, n, found = [], [], []
                for k in lengths:
                    places, runs = _runs(normal, left, k)
                    may = np.flatnonzero(_in_filter(runs, shared.value)) if runs else places
                    at += places[may].tolist()
                    n += [k] * len(may)
                    found += [runs[j] for j in may.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*_placed(batch, row, own, at, n), pa.array(found, pa.string())], names=schema.names
                )

    hits = skew_join(write_once(words.mapInArrow(sift, schema)), names, ["run"]).select(key, "i", "n", "at", "raw", "label")
    # runs that touch no other are settled alone, so a long text is no long list
    order = Window.partitionBy(key).orderBy("i", "n")
    reached = F.max(F.col("i") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("i") >= reached, F.lit(True)).cast("int")
    clustered = hits.withColumn("_opens", opens).withColumn("_cluster", F.sum("_opens").over(order))
    candidates = clustered.groupBy(key, "_cluster").agg(F.collect_list(F.struct(
        (-F.col("n")).alias("longest"), F.col("i"), F.col("n"), F.col("at"), F.col("raw"), F.col("label")
    )).alias("found"))
    kept = F.aggregate(
        F.array_sort("found"),
        F.filter(F.col("found"), lambda _: F.lit(False)),
        lambda acc, s: F.when(
            F.exists(acc, lambda o: (s["i"] < o["i"] + o["n"]) & (o["i"] < s["i"] + s["n"])), acc
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return candidates.select(key, F.explode(kept).alias("s")).select(key, "s.i", "s.n", "s.at", "s.raw", "s.label")


def grouped_entities(tags: DataFrame, key: str) -> DataFrame:
    """One row per text: label -> surface strings in order, for each of the three labels."""
    def of(label: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct("start", "surface"))))
        return F.transform(rows, lambda r: r["surface"]).alias(label)
    return tags.groupBy(key).agg(*[of(label) for label in LABELS])


def span_scores(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 of exact spans."""
    columns = [key, "start", "end", "label"]
    both = gold.select(*columns, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        predicted.select(*columns, F.lit(0).alias("g"), F.lit(1).alias("p"))
    ).groupBy(*columns).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counted = both.agg(
        F.count_if(F.expr("g = 1 AND p = 1")).alias("tp"), F.count_if(F.expr("g = 0 AND p = 1")).alias("fp"),
        F.count_if(F.expr("g = 1 AND p = 0")).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return counted.select(
        "tp", "fp", "fn",
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), zero).alias("f1"),
    )


def compare_taggers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entities found by two taggers, per label."""
    both = first.select("label", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        second.select("label", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return both.groupBy("label").agg(F.sum("a").alias("first_total"), F.sum("b").alias("second_total"))
