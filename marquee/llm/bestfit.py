"""Packing of whole documents by bulk-synchronous best fit (operator 11)."""

from __future__ import annotations

import bisect
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import kept, prepare, text_or_empty, texts_of
from marquee.runtime import write_once

WINDOW = 2048
END = 0
CELL_ROWS = 16384
MOST_CELLS = 1 << 15
BULK = 4
CLOSE = 128
# the pattern by which byte-level vocabularies cut a text before merging; a fixed value of the public format
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLACED, DOCUMENT, GAP, CLOSED = 0, 1, 2, 3


def _bytes_by_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts, equal to those of the tokenizers library for a byte-level vocabulary file.

    Where the file's merges stand in the order of their ids, as ranks do, the merging is done by tiktoken over the same
    vocabulary, in a quarter of the time; any other file goes through the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        vocabulary = {t: i for t, i in file["model"]["vocab"].items() if t not in self.special}
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in file["model"]["merges"]]
        splitter = file.get("pre_tokenizer") or {}
        ranked = merged == sorted(set(merged)) and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space")
        self.size = max([*vocabulary.values(), *self.special.values()], default=0) + 1
        if ranked and file.get("normalizer") is None:
            import tiktoken

            signs = _bytes_by_sign()
            ranks = {bytes(signs[c] for c in t): i for t, i in vocabulary.items()}
            encoding = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
            self.ids = lambda text: encoding.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _encoder(path: str) -> Encoder:
    return kept(f"bestfit {path}", lambda: Encoder(path))


PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces_of(df: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32, ids): documents as token ids, those longer than ``window`` in pieces.

    All pieces but a document's first are full. ``item`` numbers them in the whole table; ``ids`` are little-endian
    32-bit integers.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(tokenizer).ids
        item = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            rows: list[tuple] = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                ids = np.array([*ids_of(data[a:b].tobytes().decode()), end], "<u4")
                cuts = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
                for piece, (start, stop) in enumerate(zip(cuts[:-1], cuts[1:])):
                    blob = ids[start:stop].tobytes()
                    rows.append((item, doc_id, piece, start, stop - start, zlib.crc32(blob), blob))
                    item += 1
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(encode, PIECES)


SWEPT = "what int, cell int, rank long, id long, size int, sequence long, offset int"


def sweep(rows: list[tuple[int, int, int]], window: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best fit within one cell. ``rows``: (size, kind, id) from large to small, a gap before a document of its size.

    The gaps met so far lie on a stack, the smallest on top: it is the successor of every document that comes next. A gap that
    is cut goes back on the stack while it still holds a document of that size, and waits for its new size
    otherwise. Gives lists by kind of (id, size, sequence, offset): documents placed, documents left, gaps that smaller
    documents of other cells may take, and gaps that are cut below the sizes of this cell.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {PLACED: [], DOCUMENT: [], GAP: [], CLOSED: []}
    stack: list[tuple[int, int]] = []
    waiting: list[tuple[int, int]] = []
    for size, kind, own in rows:
        while waiting and -waiting[0][0] >= size:
            gap, sequence = heapq.heappop(waiting)
            stack.append((-gap, sequence))
        if kind == GAP:
            stack.append((size, own))
        elif not stack:
            out[DOCUMENT].append((own, size, None, None))
        else:
            gap, sequence = stack.pop()
            out[PLACED].append((own, size, sequence, window - gap))
            gap -= size
            if gap >= size:
                stack.append((gap, sequence))
            elif gap:
                heapq.heappush(waiting, (-gap, sequence))
    out[GAP] = [(sequence, gap, None, None) for gap, sequence in reversed(stack)]
    out[CLOSED] = [(sequence, -gap, None, None) for gap, sequence in waiting]
    return out


def allot(cells: dict[int, dict[int, dict]], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Which gaps serve the documents that their own cells left, by ranks: the same sweep over cells.

    ``cells``: by cell (from large sizes to small) and kind the number ``n`` of rows left, the ``least`` and ``most`` size. Gives
    (gap_cell, gap_from, doc_cell, doc_from, doc_to, each): the gaps from this rank on take ``each`` documents, one gap after the other.

    Gaps move in runs of ranks with the size that all of a run surely have. A cell's documents take the run that is the
    successor of their greatest size. If the cell's sizes are close together, the run comes back with what it surely has left, for this
    cell and the smaller ones; else that is known too badly and has to wait for the next round.
    ``each`` is one, or a part of what surely fits where the documents are far smaller.
    """
    runs: list[tuple[int, int, int, int]] = []
    out = []
    smallest = min((c[DOCUMENT]["least"] for c in cells.values() if DOCUMENT in c), default=0)
    for cell in sorted(cells):
        documents, gaps = cells[cell].get(DOCUMENT), cells[cell].get(GAP)
        done = 0
        close = documents and documents["most"] - documents["least"] <= window // CLOSE
        while documents and done < documents["n"]:
            at = bisect.bisect_left(runs, (documents["most"],))
            if at == len(runs):
                break
            least, other, first, last = runs.pop(at)
            each = max(1, least // (BULK * documents["most"]))
            take = min(-(-(documents["n"] - done) // each), last - first)
            until = min(documents["n"], done + take * each)
            out.append((other, first, cell, done, until, each))
            done = until
            if first + take < last:
                bisect.insort(runs, (least, other, first + take, last))
            if close and least - each * documents["most"] >= smallest:
                bisect.insort(runs, (least - each * documents["most"], other, first, first + take))
        if gaps:
            bisect.insort(runs, (gaps["least"], cell, 0, gaps["n"]))
    return out


def _swept(rows: DataFrame, cells: int, window: int) -> DataFrame:
    """One sweep of each cell of ``rows`` (size, kind, id); cells are ranges of sizes, equal sizes dealt out by hash."""
    order = [F.col("size").desc(), F.col("kind").desc(), F.xxhash64("id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns])]
        cell = TaskContext.get().partitionId()
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        for what, found in sweep(own, window).items():
            if found:
                columns = [[what] * len(found), [cell] * len(found), range(len(found)), *zip(*found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SWEPT.split(", ")]
                )

    rows = rows.select("size", "kind", "id")
    dealt = rows.repartitionByRange(cells, *order) if cells > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, SWEPT)


def _met(swept: DataFrame, allotted: list[tuple], window: int) -> DataFrame:
    """What cells left, after ``allotted`` puts documents into gaps: the columns of ``swept``."""
    names = ["turn", "gap_cell", "gap_from", "doc_cell", "doc_from", "doc_to", "each"]
    table = swept.sparkSession.createDataFrame(
        [(i, *a) for i, a in enumerate(allotted)], ", ".join(f"{n} long" for n in names)
    )
    here = (F.col("cell") == F.col("doc_cell")) & (F.col("rank") >= F.col("doc_from")) & (F.col("rank") < F.col("doc_to"))
    documents = swept.filter(F.col("what") == DOCUMENT).join(F.broadcast(table), here, "left")  # runs of gaps of so many cells
    documents = documents.withColumn("gap_rank", F.expr("gap_from + (rank - doc_from) div each"))
    gaps = swept.filter(F.col("what") == GAP).withColumns(
        {"turn": F.lit(-1).cast("long"), "gap_cell": F.col("cell").cast("long"), "gap_rank": F.col("rank")}
    )
    columns = [*swept.columns, "turn", "gap_cell", "gap_rank"]
    put = documents.filter("turn is not null").select(*columns).unionByName(gaps.select(*columns))
    gap = Window.partitionBy("gap_cell", "gap_rank")  # one gap and the documents it takes
    before = gap.orderBy("turn", "rank").rowsBetween(Window.unboundedPreceding, -1)
    document = F.col("what") == DOCUMENT
    taken = F.when(document, F.col("size")).otherwise(0)
    put = put.withColumns({
        "_gap": F.max(F.when(~document, F.col("size"))).over(gap), "_id": F.max(F.when(~document, F.col("id"))).over(gap),
        "_all": F.sum(taken).over(gap), "_before": F.sum(taken).over(before),
    })
    put = put.select(
        F.when(document, F.lit(PLACED)).otherwise(F.lit(CLOSED)).alias("what"), "cell", "rank", "id",
        F.when(document, F.col("size")).otherwise(F.col("_gap") - F.col("_all")).cast("int").alias("size"),
        F.when(document, F.col("_id")).alias("sequence"),
        F.when(document, window - F.col("_gap") + F.col("_before")).cast("int").alias("offset"),
    )
    return put.unionByName(documents.filter("turn is null").select(*swept.columns))


def best_fit(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, sequence, offset) of ``items`` (item, size), sizes from 1 to ``window`` less 1, in few sequences.

    Rounds over documents and gaps together: both are sorted by size in ranges, each range is swept from large to
    small so that a document takes the smallest gap that holds it, and what a range leaves is matched between ranges by rank
    (``allot``); cut gaps take part in the next round. When a round places nothing, no document left fits any gap, and as many empty
    sequences are added as the documents left need at least: for their tokens, one for each above half a sequence, and one for two
    above a third. A round's exchange has 16 bytes a row; gaps that no document left fits into go out. The driver
    holds a few numbers a range (at most ``MOST_CELLS``) and run of gaps.
    """
    spark = items.sparkSession
    state = items.select(F.col("size").cast("int").alias("size"), F.lit(DOCUMENT).alias("kind"), F.col("item").alias("id"))
    need = [
        F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("tokens"),
        F.count(F.when(F.col("size") * 2 > window, 1)).alias("halves"), F.count(F.when(F.col("size") * 3 > window, 1)).alias("thirds"),
    ]
    documents = [items.agg(*need).first()]
    left = rows = documents[0]["n"]
    fresh, stuck = 0, True
    written: list[DataFrame] = []
    while left:
        if stuck:
            tokens, halves, thirds = (sum(r[c] for r in documents) for c in ("tokens", "halves", "thirds"))
            new = max(-(-tokens // window), halves, -(-thirds // 2))
            empty = spark.range(fresh, fresh + new).select(F.lit(window).alias("size"), F.lit(GAP).alias("kind"), "id")
            state, fresh, rows = state.unionByName(empty), fresh + new, rows + new
        cells = min(MOST_CELLS, -(-rows // CELL_ROWS))
        swept = write_once(_swept(state, cells, window))
        found: dict[int, dict[int, dict]] = {}
        for r in swept.groupBy("cell", "what").agg(*need).collect():
            found.setdefault(r["cell"], {})[r["what"]] = r.asDict()
        allotted = allot(found, window)
        after = swept
        written.append(swept)
        if allotted:
            after = write_once(_met(swept, allotted, window))
            written.append(after)
        documents = [c[DOCUMENT] for c in found.values() if DOCUMENT in c]
        stuck = not allotted and not any(PLACED in c for c in found.values())
        left = sum(r["n"] for r in documents) - sum(until - done for _, _, _, done, until, _ in allotted)
        rows = left + sum(c[what]["n"] for c in found.values() for what in (GAP, CLOSED) if what in c)
        open_rows = after.filter(F.col("what") != PLACED)
        if allotted:
            open_rows = open_rows.unionByName(swept.filter(F.col("what") == CLOSED))
        kind = F.when(F.col("what") == DOCUMENT, F.lit(DOCUMENT)).otherwise(F.lit(GAP))
        least = min((r["least"] for r in documents), default=window)
        state = open_rows.filter(F.col("size") >= least).select("size", kind.alias("kind"), "id")
    placed = items.select("item", F.lit(0).cast("long").alias("sequence"), F.lit(0).alias("offset")).limit(0)
    for table in written:
        own = table.filter(F.col("what") == PLACED)
        placed = placed.unionByName(own.select(F.col("id").alias("item"), "sequence", "offset"))
    return placed


def pack(df: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all documents in sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids).

    ``tokenizer`` is the path of a vocabulary file; the id ``end`` closes every document. Only documents of more than ``window``
    tokens are cut: all their pieces but the first are full sequences of their own, with negative numbers. Every other piece is
    placed whole by ``best_fit``. A sequence holds at most ``window`` tokens, without gaps from offset 0.

    Texts are tokenized once; ids are written and move only if the caller reads them.

    A null or empty text is the end id alone. A null doc_id is kept and repeated rows are packed each. An empty table gives no rows.
    Other columns play no part.
    """
    prepare(df.sparkSession)
    pieces = write_once(pieces_of(df, tokenizer, window, end))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    full = pieces.filter(F.col("length") == window).withColumns(
        {"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")}
    )
    short = pieces.filter(F.col("length") < window)
    placed = best_fit(short.select("item", F.col("length").alias("size")), window)
    placed = short.join(placed, "item").withColumns({"sequence_id": F.col("sequence"), "offset": F.col("offset").cast("long")})
    return full.select(*columns).unionByName(placed.select(*columns))


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: (sequence_id, length, ids); a group holds at most one window's tokens."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(ordered, F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
