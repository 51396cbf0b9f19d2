"""What the operators of this subpackage share: Arrow text buffers, bounded batches, 64-bit mixing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "512"
SLICE_BYTES = 512 << 10


def prepare(spark: SparkSession) -> None:
    """Arrow batches of at most 512 rows, so that a batch of long texts fits beside a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(df: DataFrame, *added: str) -> DataFrame:
    """``df`` without columns that carry names an operator adds; the operator's own win."""
    return df.drop(*[c for c in df.columns if c in added])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its offsets, nulls as empty texts; no copy of the bytes."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, such as a tokenizer with the words it remembers."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Let go of what this worker keeps for other work; Spark hands the same workers to one stage after the other."""
    _KEPT.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
