"""Vector codes by dual-tree Lloyd: one small codebook for each part of the vectors (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.runtime import HOT_ROWS, skew_join, write_once

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK_BYTES = 4 << 20
LEAF_ROWS = 16
LARGEST = 1 << 25  # integers up to here keep every sum of squares below 2^63


class Tree:
    """A balanced tree of boxes over the rows of ``points``, cut at the median of the widest side, level by level.

    ``points`` come back in tree order (``order`` says whose they are). Level k has 2^k nodes; node i of a level has
    the children 2i and 2i + 1 of the next. Every node keeps its corners, its number of points and their sum. With leaves of
    one point some nodes are empty unless the points are a power of two.
    """

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        """With ``order``, ``points`` stand in the order of an earlier tree and are not sorted again."""
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(n / leaf)))) if n > leaf else 0
        self.order, starts = np.arange(n), np.zeros(1, np.int64)
        for _ in range(self.depth):
            ends = np.append(starts[1:], n)
            if order is None:
                placed = points[self.order]
                side = (np.maximum.reduceat(placed, starts) - np.minimum.reduceat(placed, starts)).argmax(axis=1)
                node = np.repeat(np.arange(len(starts)), ends - starts)
                self.order = self.order[np.lexsort((placed[np.arange(n), side[node]], node))]
            starts = np.stack([starts, (starts + ends) // 2], axis=1).ravel()
        self.points = points[self.order]
        self.order = self.order if order is None else order
        self.starts = [starts[:: 1 << (self.depth - level)] for level in range(self.depth + 1)]
        self.low = [np.minimum.reduceat(self.points, s) for s in self.starts]
        self.high = [np.maximum.reduceat(self.points, s) for s in self.starts]
        self.sums = [np.add.reduceat(self.points, s) for s in self.starts]
        self.counts = [np.diff(np.append(s, n)) for s in self.starts]


def _bounds(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of two boxes, row by row."""
    near = np.maximum(0, np.maximum(low - other_high, other_low - high))
    far = np.maximum(high - other_low, other_high - low)
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def _beaten(low: np.ndarray, high: np.ndarray, entry: np.ndarray, rival: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Where every point of the box is nearer to ``rival`` than to ``entry``, or as near and ``entry`` has the higher index."""
    slope = 2 * (entry - rival)
    most = np.maximum(slope * low, slope * high).sum(axis=1) + (rival * rival).sum(axis=1) - (entry * entry).sum(axis=1)
    return (most < 0) | ((most == 0) & later)


def assign(tree: Tree, book: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Nearest entry of ``book`` for every point of ``tree``, ties to the lower index, in pieces of whole nodes.

    A piece (level, nodes, entries) assigns whole nodes of that level; level -1 assigns single points by their place.
    Two trees go down together, one over the points and one over the entries: a pair of nodes is dropped when its
    least distance exceeds the greatest distance of another pair of the same node, or when one entry
    beats the other in the whole box. A node left with one entry is assigned whole. Points of leaves left with several
    entries get integer distances to those. All bounds are integers, so no point is decided by rounding.
    """
    entries = Tree(book, 1)
    index, place = entries.order, entries.starts[-1]
    level = below = 0
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        single = below == entries.depth
        low, high = tree.low[level][a], tree.high[level][a]
        near, far = _bounds(low, high, entries.low[below][b], entries.high[below][b])
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
        keep = near <= np.minimum.reduceat(far, first)[group]
        if single:
            # the entry nearest to the middle of the box is the one that may beat the others; doubled to stay integer
            mine, number = entries.points[place[b]], index[place[b]]
            gap = low + high - 2 * mine
            rank = np.lexsort((number, (gap * gap).sum(axis=1), group))
            rival = rank[first][group]
            keep &= ~(_beaten(low, high, mine, mine[rival], number > number[rival]) & (b != b[rival]))
        a, b, group = a[keep], b[keep], group[keep]
        if single:
            alone = np.bincount(group, minlength=len(first))[group] == 1
            if alone.any():
                yield level, a[alone], index[place[b[alone]]]
            a, b = a[~alone], b[~alone]
        if not len(a):
            return
        if level == tree.depth and single:
            break
        if not single:
            a, b = np.repeat(a, 2), np.stack([2 * b, 2 * b + 1], axis=1).ravel()
            below += 1
            some = entries.counts[below][b] > 0
            a, b = a[some], b[some]
        if level < tree.depth:
            order = np.argsort(np.concatenate([2 * a, 2 * a + 1]), kind="stable")
            a, b = np.concatenate([2 * a, 2 * a + 1])[order], np.concatenate([b, b])[order]
            level += 1
        else:
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
    starts = tree.starts[level]
    nodes, which = np.unique(a, return_inverse=True)
    open_to = np.zeros((len(nodes), len(book)), bool)
    open_to[which, index[place[b]]] = True
    sizes = tree.counts[level][nodes]
    places = np.repeat(starts[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    gap = tree.points[places][:, None, :] - book[None, :, :]
    distance = (gap * gap).sum(axis=2)
    distance[~np.repeat(open_to, sizes, axis=0)] = np.iinfo(np.int64).max
    yield -1, places, distance.argmin(axis=1)


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of points of each entry, and the sum of them."""
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    for level, at, entry in assign(tree, book):
        np.add.at(counts, entry, tree.counts[level][at] if level >= 0 else 1)
        np.add.at(sums, entry, tree.sums[level][at] if level >= 0 else tree.points[at])
    return counts, sums


def codes(tree: Tree, book: np.ndarray) -> np.ndarray:
    """The entry of each point, in the order the points had before the tree."""
    placed = np.zeros(len(tree.points), np.int64)
    for level, at, entry in assign(tree, book):
        if level < 0:
            placed[at] = entry
            continue
        sizes, starts = tree.counts[level][at], tree.starts[level][at]
        placed[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = np.repeat(entry, sizes)
    out = np.empty_like(placed)
    out[tree.order] = placed
    return out


_KEPT = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def _kept(df: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, embedding) of the rows whose vector is whole, and the length that most vectors have."""
    rows = df.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).filter(_KEPT)
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    usual = sizes.filter((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows, usual["n"] if usual else 0


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, one row a vector."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return x.astype(np.int64).reshape(-1, width)


def _blocks(rows: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """Blocks of about 4 MB of vectors: (ids, labels, orders, vectors).

    ``vectors`` holds the integer components, one part after the other, each part's rows in the order of a tree over
    them, and ``orders`` these orders. The trees are sorted once here; later rounds read them as they are.
    """
    own, most = width // parts, max(1, BLOCK_BYTES // (8 * width))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x = _integers(table.column(2), width, scale)
        trees = [Tree(x[:, p * own : (p + 1) * own], LEAF_ROWS) for p in range(parts)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(i)) for i in range(2)]
        orders = b"".join(t.order.astype("<i4").tobytes() for t in trees)
        vectors = b"".join(t.points.astype("<i4").tobytes() for t in trees)
        return pa.RecordBatch.from_arrays(
            [*lists, pa.array([orders], pa.binary()), pa.array([vectors], pa.binary())], names=["ids", "labels", "orders", "vectors"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, most - rows_held))
                batch = batch.slice(len(held[-1]))
                rows_held += len(held[-1])
                if rows_held == most:
                    yield block(held)
                    held, rows_held = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(cut, "ids array<long>, labels array<string>, orders binary, vectors binary")


def _trees(orders: bytes, vectors: bytes, parts: int) -> list[Tree]:
    order = np.frombuffer(orders, "<i4").reshape(parts, -1)
    x = np.frombuffer(vectors, "<i4").reshape(parts, order.shape[1], -1).astype(np.int64)
    return [Tree(x[p], LEAF_ROWS, order[p]) for p in range(parts)]


def _lloyd(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; ``books`` has the axes part, entry, component."""
    shape = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            for orders, vectors in zip(batch.column(0), batch.column(1)):
                for p, tree in enumerate(_trees(orders.as_py(), vectors.as_py(), shape[0])):
                    own = totals(tree, books[p])
                    counts[p] += own[0]
                    sums[p] += own[1]
        columns = [*np.indices(shape).reshape(3, -1), np.repeat(counts.ravel(), shape[2]), sums.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "n", "total"])

    found = blocks.select("orders", "vectors").mapInArrow(add, "part long, entry long, place long, n long, total long")
    found = found.groupBy("part", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    after = books.copy()
    for row in found.filter("n > 0").collect():  # one row a component of the codebooks
        after[row["part"], row["entry"], row["place"]] = int(row["total"]) // row["n"]
    return after


def compress(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all whole vectors, (vec_id, label, code, error), and the codebooks (part, entry, component).

    Components become floor(scale * x) and vectors are cut into equal consecutive ``parts``. Each part's codebook starts as
    that part of the vectors with the smallest vec_ids (fewer entries where there are fewer vectors); ``rounds`` times every
    part goes to its nearest entry, ties to the lower index, and an entry becomes the floor of its parts' mean, or
    stays if it has none. At last parts are assigned once more. ``code`` is a binary of one byte a part (256 entries at most);
    ``error`` the squared distances summed over the parts.

    Rows lie in blocks of about 4 MB with one tree a part, built and written once. A round reads the blocks, adds up whole
    nodes (see ``assign``) inside each task, and only sums as large as the codebooks are shuffled and reach the driver.

    Rows whose vector is null or holds null or non-finite components are dropped. The length that most vectors have, a
    positive multiple of ``parts``, is that of the codebooks; vectors of another length, empty ones too, are returned with
    null code and error. Null vec_ids come after all others, equal ones in the order of their vectors; repeated rows are coded each, a
    null label is a label. A component beyond 2^25 / scale raises an error, as sums of squares would not fit 64 bits.
    An empty table gives no rows and codebooks without entries. Other columns play no part.
    """
    if entries > 256:
        raise ValueError("a code has one byte a part: 256 entries at most")
    rows, width = _kept(df, parts)
    usual = rows.filter(F.size("embedding") == width)
    others = rows.filter(F.size("embedding") != width).select(
        "vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")
    )
    if not width:
        return others, np.zeros((parts, 0, 0), np.int64)
    first = usual.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = np.floor(scale * np.array([r["embedding"] for r in first], np.float64)).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    blocks = write_once(_blocks(usual, width, parts, scale))
    for _ in range(rounds):
        books = _lloyd(blocks, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                trees = _trees(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), parts)
                own, error = np.zeros((len(trees[0].order), parts), np.uint8), np.zeros(len(trees[0].order), np.int64)
                for p, tree in enumerate(trees):
                    own[:, p] = codes(tree, books[p])
                    gap = tree.points - books[p][own[tree.order, p]]
                    error[tree.order] += (gap * gap).sum(axis=1)
                places = pa.array(np.arange(0, own.size + 1, parts, dtype=np.int32)).buffers()[1]
                bytes_of = pa.Array.from_buffers(pa.binary(), len(own), [None, places, pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, bytes_of, pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    return blocks.mapInArrow(code, "vec_id long, label string, code binary, error long").unionByName(others), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal numbers, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame) -> DataFrame:
    """Per whole vector: (vec_id, code, error, label_error, codebooks_sha256); see ``compress``.

    ``code`` has two lower-case hex digits a part. ``label_error`` is the error of all vectors of the same label, those
    without label together; it is added up by label first, and labels of very many rows are joined in many parts.
    """
    coded, books = compress(df)
    label = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit(""))
    coded = write_once(coded.select("vec_id", label.alias("label"), F.lower(F.hex("code")).alias("code"), "error"))
    sums = write_once(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows")))
    hot = sums.filter(F.col("_rows") >= HOT_ROWS).select("label", "_rows")
    joined = skew_join(coded, sums.select("label", "label_error"), ["label"], hot=hot)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
