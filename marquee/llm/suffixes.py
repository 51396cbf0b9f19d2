"""Suffix array of the token streams of many hosts, by prefix doubling in Spark, and the repeats found in it."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee import runtime
from marquee.llm.common import mix, slices, texts_of
from marquee.llm.shingles import _POWERS, words
from marquee.runtime import input_bytes, skew_join, write_once

HELD_MARKS = 1 << 21
LOOKUP_BYTES = 32 << 20


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` neighbours."""
    size = max(0, len(hashes) - width + 1)
    out = np.zeros(size, np.uint64)
    for j in range(width):
        out += hashes[j : j + size] * _POWERS[j]
    return mix(out)


def _suffixes(batch: pa.RecordBatch, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch (host, content, group, stream), a slice of rows at a time: first row, row after the last, and for each suffix of ``run`` tokens or
    more its row in the slice, its place, a hash of its first ``run`` tokens, and its mark, both mixed with the group.

    The mark is the least hash among the shorter runs inside the first ``run`` tokens (winnowing): equal prefixes of a host have equal marks, and
    neighbours mostly share one.
    """
    near = (run + 1) // 2
    groups = batch.column(2).to_numpy().view(np.uint64)
    data, offsets = texts_of(batch.column(3))
    for first, last in slices(offsets):
        hashes, places = words(data, offsets[first : last + 1])
        n = np.maximum(np.diff(places) - run + 1, 0)
        row = np.repeat(np.arange(last - first), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = places[:-1][row] + at
        short = _rolled(hashes, run - near + 1)
        size = max(0, len(hashes) - run + 1)
        least = reduce(np.minimum, [short[j : j + size] for j in range(near)])
        yield first, last, row, at, mix(_rolled(hashes, run)[begin] ^ groups[first + row]), mix(least[begin] ^ groups[first + row])


def _packed(marks: np.ndarray, most: int) -> pa.RecordBatch:
    """(bucket, marks): the first 36 bits of the marks, sorted, by their first 12 bits; of each the other 24, none more than ``most`` times."""
    marks = np.sort(marks >> np.uint64(28))
    keep = np.ones(len(marks), bool)
    keep[most:] = marks[most:] != marks[:-most]
    marks = marks[keep]
    buckets, n = np.unique(marks >> np.uint64(24), return_counts=True)
    raw = np.ascontiguousarray(marks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3])
    offsets = (np.concatenate([[0], np.cumsum(n)]) * 3).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), packed], names=["bucket", "marks"])


def _repeated(raws: list[bytes], most: int) -> bytes | None:
    """The bits of one bucket, set for the marks that come ``most`` times or more; None if there are none."""
    wide = np.zeros((sum(map(len, raws)) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, 3)
    marks = np.sort(wide.view("<u4").ravel())
    marks = marks[most - 1 :][marks[most - 1 :] == marks[: max(0, len(marks) - most + 1)]]
    if not len(marks):
        return None
    bits = np.zeros(1 << 16, bool)
    bits[marks >> 8] = True
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _filter(streams: DataFrame, run: int, contents: int) -> np.ndarray:
    """A field of 2^28 bits with those set that a mark in ``contents`` or more streams has; it may hold others, and copies of a stream count.

    A task sends its marks packed by bucket, three bytes a mark, once for neighbours that share it. The field takes 32 MB at any size of the
    input; the fewer repeats there are, the fewer other marks get through.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, row, _, _, marks in _suffixes(batch, run):
                new = np.ones(len(marks), bool)
                new[1:] = (np.diff(row) != 0) | (marks[1:] != marks[:-1])
                held.append(marks[new])
                size += len(held[-1])
                if size >= HELD_MARKS:
                    yield _packed(np.concatenate(held), contents)
                    held, size = [], 0
        if held:
            yield _packed(np.concatenate(held), contents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[bucket].append(raw)
        bits = {bucket: _repeated(raws, contents) for bucket, raws in found.items()}
        bits = {bucket: x for bucket, x in bits.items() if x is not None}
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(list(bits.values()), pa.binary())], names=["bucket", "bits"])

    sent = streams.mapInArrow(send, "bucket int, marks binary").repartition("bucket")
    field = np.zeros((1 << 12, 1 << 13), np.uint8)
    for row in sent.mapInArrow(count, "bucket int, bits binary").collect():
        field[row["bucket"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return field.ravel()


def windows(streams: DataFrame, run: int, contents: int) -> DataFrame:
    """(host, content, places): place and a hash of the first ``run`` tokens of the suffixes of a token stream, in order.

    Suffixes whose mark is in fewer than ``contents`` streams of the host are left out, as their first ``run`` tokens are in no more. Equal contents of a host give one row.
    """
    streams = streams.select("host", "content", F.xxhash64("host").alias("group"), "stream")
    shared = streams.sparkSession.sparkContext.broadcast(_filter(streams, run, contents))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for first, last, row, at, prefixes, marks in _suffixes(batch, run):
                bit = (marks >> np.uint64(36)).astype(np.int64)
                hit = np.flatnonzero(field[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                ends = np.cumsum(np.bincount(row[hit], minlength=last - first))
                place = pa.StructArray.from_arrays([pa.array(at[hit], pa.int32()), pa.array(prefixes[hit].view(np.int64))], names=["at", "prefix"])
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), place)
                rows = pa.array(np.arange(first, last))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), places], names=["host", "content", "places"]
                )

    places = streams.mapInArrow(cut, "host string, content long, places array<struct<at:int,prefix:long>>")
    places = write_once(places.withColumn("id", F.monotonically_increasing_id()))
    first = write_once(places.groupBy("host", "content").agg(F.min("id").alias("id")).select("id"))
    if input_bytes(places.sparkSession, first.written_to) <= LOOKUP_BYTES:
        return places.join(F.broadcast(first), "id", "left_semi").drop("id")
    return write_once(places.join(first, "id", "left_semi").drop("id"))


def _ranked(names: DataFrame, order: list[str]) -> DataFrame:
    """Different prefixes sorted in ranges, each with its place in that order as ``named``; written, so that it stays."""
    return write_once(names.orderBy(*order).withColumn("named", F.monotonically_increasing_id()))


def _hot(names: DataFrame, keys: list[str]) -> DataFrame:
    return names.filter(F.col("n") >= runtime.HOT_ROWS).select(*keys, F.col("n").alias("_rows"))


def _lists(n: np.ndarray, fields: dict[str, np.ndarray]) -> pa.ListArray:
    """Lists of ``n`` structs each."""
    structs = pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), structs)


def _fields(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a column of lists of structs, and the fields."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return row, [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]


def _pairs(places: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and the ranks of both halves of prefixes of twice the width, by row and place.

    A suffix whose second half has no rank is left out: that half stands in too few contents.
    """
    row, (at, rank) = _fields(places)
    key = (row << 32) + at
    order = np.argsort(key)
    key, row, at, rank = key[order], row[order], at[order], rank[order]
    hit = np.minimum(np.searchsorted(key, key + width), len(key) - 1)
    whole = np.flatnonzero(key[hit] == key + width)
    return row[whole], at[whole], rank[whole], rank[hit[whole]]


def _paired(places: DataFrame, width: int) -> DataFrame:
    """(host, content, suffixes of at, rank, second): prefixes of twice the width, as the ranks of their halves."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, rank, second = _pairs(batch.column(2), width)
            rows, n = np.unique(row, return_counts=True)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), _lists(n, {"at": at, "rank": rank, "second": second})],
                names=["host", "content", "suffixes"],
            )

    places = places.select("host", "content", "places")
    return places.mapInArrow(pair, "host string, content long, suffixes array<struct<at:int,rank:long,second:long>>")


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _counted(places: DataFrame, width: int) -> DataFrame:
    """(rank, second, n, least): in how many contents a prefix of twice the width stands, once in a content; added up in the tasks first."""

    def totals(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rank, second, least = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((second, rank))
        first = _firsts(rank[by], second[by])
        n = np.diff(np.append(first, len(by)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rank[by][first], second[by][first], n, least[by][first])], names=["rank", "second", "n", "least"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            row, _, rank, second = _pairs(batch.column(1), width)
            by = np.lexsort((second, rank, row))
            once = by[_firsts(row[by], rank[by], second[by])]
            held.append((rank[once], second[once], batch.column(0).to_numpy()[row[once]]))
            size += len(once)
            if size >= HELD_MARKS:
                yield totals(held)
                held, size = [], 0
        if held:
            yield totals(held)

    counted = places.select("least", "places").mapInArrow(count, "rank long, second long, n long, least long")
    return counted.groupBy("rank", "second").agg(F.sum("n").alias("n"), F.max("least").alias("least"))


def _looked_up(suffixes: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(host, content, least, places) by search in the sorted names, which go to the tasks; nothing is shuffled."""
    table = names.select(*keys, "least", "named").toArrow()
    columns = [table.column(k).to_numpy() for k in keys]
    uniques = [np.unique(c) for c in columns]

    def joint(values: list[np.ndarray], uniques: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The places of a row's keys among the different values, as one number, and whether all are there."""
        out, there = np.zeros(len(values[0]), np.int64), np.ones(len(values[0]), bool)
        for value, unique in zip(values, uniques):
            place = np.minimum(np.searchsorted(unique, value), len(unique) - 1)
            there &= unique[place] == value
            out = (out << 32) + place
        return out, there

    known, _ = joint(columns, uniques)
    order = np.argsort(known)
    shared = names.sparkSession.sparkContext.broadcast(
        (uniques, known[order], table.column("least").to_numpy()[order], table.column("named").to_numpy()[order])
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uniques, known, least, named = shared.value
        for batch in batches:
            row, (at, *values) = _fields(batch.column(2))
            wanted, there = joint(values[: len(uniques)], uniques)
            found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = np.flatnonzero(there & (known[found] == wanted))
            rows, first, n = np.unique(row[hit], return_index=True, return_counts=True)
            places = _lists(n, {"at": at[hit], "rank": named[found[hit]]})
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(least[found[hit[first]]]), places],
                names=["host", "content", "least", "places"],
            )

    return suffixes.mapInArrow(
        look, "host string, content long, least long, places array<struct<at:int,rank:long>>"
    )


def _placed(suffixes: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(host, content, least, places) of the suffixes whose prefix has a rank; written.

    Names that take ``LOOKUP_BYTES`` at most are looked up inside the rows; more of them are joined.
    """
    if input_bytes(names.sparkSession, names.written_to) <= LOOKUP_BYTES:
        return write_once(_looked_up(suffixes, names, [k for k in keys if k != "host"]))
    ranked = skew_join(suffixes.select("host", "content", F.inline("suffixes")), names.drop("n"), keys, "inner", _hot(names, keys))
    place = F.struct(F.col("at"), F.col("named").alias("rank"))
    return write_once(ranked.groupBy("host", "content").agg(
        F.max("least").alias("least"), F.collect_list(place).cast("array<struct<at:int,rank:long>>").alias("places")
    ))


def _longest(levels: list[DataFrame], run: int) -> DataFrame:
    """(host, content, spans): for each suffix with a rank the longest prefix that has one."""

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            lengths, ats = lists.flatten().flatten()
            n = ats.value_lengths().to_numpy()
            row, length, at = np.repeat(owner, n), np.repeat(lengths.to_numpy(), n), ats.flatten().to_numpy()
            by = np.lexsort((-length, at, row))
            by = by[_firsts(row[by], at[by])]
            spans = _lists(np.bincount(row[by], minlength=len(lists)), {"at": at[by], "length": length[by]})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], names=["host", "content", "spans"])

    wide = [
        p.select("host", "content", F.struct(F.lit(run << j).alias("length"), F.col("places.at").alias("at")).alias("level"))
        for j, p in enumerate(levels)
    ]
    found = reduce(DataFrame.unionAll, wide).groupBy("host", "content").agg(F.collect_list("level").alias("levels"))
    return found.mapInArrow(longest, "host string, content long, spans array<struct<at:int,length:int>>")


def repeats(streams: DataFrame, run: int, contents: int, share: float) -> DataFrame:
    """(host, content, spans): the suffixes of a stream whose first ``run`` tokens, or more, the host repeats.

    ``streams`` holds (host, content, stream); equal contents of a host count once. Repeated is what stands in ``contents`` or more of
    the host's streams and in ``share`` of them or more. ``spans`` are (at, length) by place, in tokens: the longest repeated
    prefix among those of ``run``, 2 ``run``, 4 ``run``, ... tokens. Streams without any are left out.

    Suffixes are sorted by their first ``run`` tokens, then by twice as many, and so on (Manber and Myers): the different
    prefixes of a round are sorted over range partitions, their place in that order is the rank of all suffixes that begin
    so, and a pair of ranks is a prefix of the next round. Suffixes whose prefix is not repeated go no further; the rounds end
    when none is. Prefixes are counted in the tasks before they are shuffled, once in a content, so neither a host nor
    a menu with a third of all pages gathers in one task. The first ``run`` tokens are told apart, and ordered, by a 64-bit hash.
    Suffixes that a filter shows to be in too few streams are left out before anything of them is shuffled (``windows``).
    """
    cut = windows(streams, run, contents)
    counted = cut.select("host", F.explode(F.array_distinct("places.prefix")).alias("prefix"))
    counted = counted.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= contents)
    least = F.greatest(F.lit(contents), F.ceil(F.lit(share) * F.count(F.lit(1)))).cast("long").alias("least")
    counted = skew_join(write_once(counted), write_once(cut.groupBy("host").agg(least)), ["host"]).filter("n >= least")
    names, keys = _ranked(counted, ["host", "prefix"]), ["host", "prefix"]
    suffixes = cut.select("host", "content", F.col("places").alias("suffixes"))
    levels: list[DataFrame] = []
    while not names.isEmpty():
        levels.append(_placed(suffixes, names, keys))
        width, keys = run << len(levels) - 1, ["rank", "second"]
        names = _ranked(_counted(levels[-1], width).filter("n >= least"), keys)
        suffixes = _paired(levels[-1], width)
    if not levels:
        return cut.limit(0).selectExpr("host", "content", "array(struct(0 AS at, 0 AS length)) AS spans")
    return _longest(levels, run)
