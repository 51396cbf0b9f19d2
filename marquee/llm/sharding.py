"""Shards of near-equal bytes by histogram sort (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import prepare, text_or_empty, without
from marquee.runtime import write_once

OVERHEAD = 16
PROBES = 32
CELLS_PER_SHARD = 8
CELL_BYTES = 256 << 20
MOST_CELLS = 1 << 19
TOLERANCE = 0.02
GROUP_SLACK = 0.05
_GROUP = 1 << 23
_TOP = 1 << 63


def sort_key(text: Column, doc_id: Column) -> Column:
    """63 bits: 40 of the text, so that equal texts are neighbours, then 23 of the doc_id to cut a large group."""
    high = F.shiftleft(F.pmod(F.xxhash64(text), F.lit(1 << 40)), 23)
    return high + F.pmod(F.xxhash64(doc_id), F.lit(_GROUP))


def _below(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe, added up in every task and then over the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(probes)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for frame in frames:
            at = np.searchsorted(shared.value, frame["key"].to_numpy(), "right")
            np.add.at(size, at, frame["size"].to_numpy())
            n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        yield pd.DataFrame({"at": used, "size": size[used], "n": n[used]})

    found = (
        rows.mapInPandas(count, "at long, size long, n long").groupBy("at")
        .agg(F.sum("size").alias("size"), F.sum("n").alias("n")).toPandas()
    )
    totals = np.zeros((2, len(probes) + 1), np.int64)
    totals[0, found["at"]], totals[1, found["at"]] = found["size"], found["n"]
    size, n = totals.cumsum(axis=1)[:, :-1]
    return size, n


def splitters(rows: DataFrame, cells: int, total: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut ``rows`` (key, size) into ``cells`` of equal bytes, and the rows below each key.

    Every round counts the exact bytes below a set of candidate keys, 32 in each open interval, and keeps
    the interval that holds the target. A splitter is settled when its bytes miss the target by at
    most ``tolerance`` of a cell, or when no key is left between its bounds.
    """
    targets = np.arange(1, cells) * (total / cells)
    low, high = np.zeros(cells - 1, np.int64), np.full(cells - 1, _TOP - 1, np.int64)
    best = np.zeros(cells - 1, np.int64)
    miss, rows_below = np.full(cells - 1, np.inf), np.zeros(cells - 1, np.int64)
    probes = np.array([i * _TOP // (cells * PROBES) for i in range(1, cells * PROBES)], np.int64)
    while len(probes):
        size, n = _below(rows, probes)
        after = np.searchsorted(size, targets)
        for side in (after - 1, after):
            ok = (side >= 0) & (side < len(probes))
            at = np.clip(side, 0, len(probes) - 1)
            gap = np.where(ok, np.abs(size[at] - targets), np.inf)
            nearer = gap < miss
            best, rows_below = np.where(nearer, probes[at], best), np.where(nearer, n[at], rows_below)
            miss = np.minimum(miss, gap)
        before = after - 1
        low = np.where(before >= 0, np.maximum(low, probes[np.clip(before, 0, None)]), low)
        high = np.where(after < len(probes), np.minimum(high, probes[np.clip(after, None, len(probes) - 1)]), high)
        open_ones = (miss > tolerance * total / cells) & (high - low > 1)
        # shares of the interval without overflow: (high - low) / (PROBES + 1) first
        parts = [
            np.unique(a + np.maximum((b - a) // (PROBES + 1), 1) * np.arange(1, PROBES + 1))
            for a, b in zip(low[open_ones], high[open_ones])
        ]
        probes = np.unique(np.concatenate([p[p < b] for p, b in zip(parts, high[open_ones])])) if parts else probes[:0]
    order = np.argsort(best, kind="stable")
    return best[order], rows_below[order]


def at_group_borders(
    rows: DataFrame, cuts: np.ndarray, rows_below: np.ndarray, total: int, slack: float
) -> tuple[np.ndarray, np.ndarray]:
    """Move each splitter to the nearer border of the group of equal texts it cuts, if that misses the target by ``slack`` bytes at most."""
    down = cuts - cuts % _GROUP
    probes = np.unique(np.concatenate([down, down + _GROUP]))
    size, n = _below(rows, probes)
    target = np.arange(1, len(cuts) + 1) * (total / (len(cuts) + 1))
    for border in (down, down + _GROUP):
        at = np.searchsorted(probes, border)
        gap = np.abs(size[at] - target)
        better = gap <= slack
        cuts, rows_below = np.where(better, border, cuts), np.where(better, n[at], rows_below)
        slack = np.where(better, gap, slack)
    cuts, rows_below = np.maximum.accumulate(cuts), np.maximum.accumulate(rows_below)
    return cuts, rows_below


def shard(df: DataFrame, shards: int = 40) -> DataFrame:
    """All rows of ``df`` with size, text_crc32, law, shard, slot and grown_shard.

    Rows are ordered by a key of the text's and the doc_id's hash and cut so that shards hold near-equal bytes.
    Equal texts are neighbours: a border moves to the edge of their group where that misses the equal size by
    5 % of a shard at most, else it cuts the group. Keys and sizes are written once; the rounds of the histogram sort read only those. A shard is cut further into cells, more
    of them with more bytes, and the one exchange deals out cells, so that no task holds a
    shard. ``slot`` counts a shard's rows from 0 by key, doc_id and text hash.

    Size is the UTF-8 bytes of the text plus 16; a null text has none and the same key as an empty one. Rows
    with equal doc_id and text have equal keys and neighbouring slots; if they alone outweigh a shard, it stays larger. A null doc_id
    is a value like any other. An empty table gives an empty result. Input columns with an added name
    are replaced.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    prepare(df.sparkSession)
    base = without(df, *added, "_llm_key").withColumns({
        "size": F.octet_length(text_or_empty()).cast("long") + OVERHEAD,
        "_llm_key": sort_key(text_or_empty(), F.col("doc_id")),
    })
    keys = write_once(base.select(F.col("_llm_key").alias("key"), "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(CELLS_PER_SHARD, min(MOST_CELLS // shards, -(-total // (shards * CELL_BYTES))))
    cuts, rows_below = splitters(keys, shards * per_shard, total) if total else (np.zeros(0, np.int64),) * 2
    if total:
        cuts, rows_below = at_group_borders(keys, cuts, rows_below, total, GROUP_SLACK * total / shards)
    shared = df.sparkSession.sparkContext.broadcast(cuts)  # at most MOST_CELLS keys

    @F.pandas_udf("long")
    def cell(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(), "right"))

    starts = np.concatenate([[0], rows_below])
    firsts = [int(x - starts[i - i % per_shard]) for i, x in enumerate(starts)]
    offsets = df.sparkSession.createDataFrame(
        pd.DataFrame({"_llm_cell": np.arange(len(firsts)), "_llm_first": firsts}), "_llm_cell long, _llm_first long"
    )
    in_cell = Window.partitionBy("_llm_cell").orderBy("_llm_key", "doc_id", "text_crc32")
    return (
        base.withColumns({
            "text_crc32": F.crc32(F.encode(text_or_empty(), "UTF-8")),
            "law": F.lit("bytes"),
            "_llm_cell": cell("_llm_key"),
        })
        .withColumn("_llm_row", F.row_number().over(in_cell))
        .join(F.broadcast(offsets), "_llm_cell")
        .withColumns({
            "shard": F.expr(f"cast(_llm_cell div {per_shard} as int)"),
            "slot": F.col("_llm_first") + F.col("_llm_row") - 1,
            "grown_shard": F.lit(None).cast("int"),
        })
        .drop("_llm_cell", "_llm_first", "_llm_row", "_llm_key")
    )
