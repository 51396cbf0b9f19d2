"""Packing into windows of fixed length with the same mixture of sources in each (operator 6)."""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import kept, prepare, slices, text_or_empty, texts_of
from marquee.llm.shingles import word_bounds, word_hashes
from marquee.runtime import write_once

WINDOW = 4096
END = 2
MOST_SOURCES = 100_000
CACHED_RUNS = 300_000
LEARNED_RUNS = 4096
GATHERED_BYTES = 2 << 20
# the pattern by which these vocabularies cut a text; a fixed value of the public format, which _run_bounds follows
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_QUOTE = ord("'")


def _kind(c: str) -> int:
    """What a character is to the pattern; U+0130 is two characters when lowered, and left to the tokenizer like all beyond U+024F."""
    if "\xa1" <= c <= "\u024f" and c != "\u0130" or "!" <= c <= "~":
        return _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else _SIGN
    return _SPACE if c in "\t\n\v\f\r " else _OTHER


_KINDS = np.array([_kind(chr(c)) for c in range(0x280)], np.uint8)
_BYTE_KINDS = np.where(np.arange(256) < 0x80, _KINDS[:256], _OTHER).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _kinds(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind of each byte's character; a word that holds a character of ``_OTHER`` is all of that kind."""
    kinds = _BYTE_KINDS[part]
    first = np.flatnonzero((part >= 0xC2) & (part <= 0xC9))  # of the two bytes of U+0080 to U+027F
    own = _KINDS[(part[first].astype(np.int64) & 0x1F) << 6 | part[first + 1] & 0x3F]
    kinds[first] = kinds[first + 1] = own
    odd = np.flatnonzero(kinds == _OTHER)
    if len(odd):
        words = np.unique(np.searchsorted(starts, odd, "right") - 1)
        lengths = ends[words] - starts[words]
        kinds[np.arange(int(lengths.sum())) + np.repeat(starts[words] - np.cumsum(lengths) + lengths, lengths)] = _OTHER
    return kinds


def _run_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each run and the byte after it, counted from the first text's; whether it is a whole word for the
    tokenizer; where each text's runs begin."""
    low = int(offsets[0])
    part, bounds = data[low : int(offsets[-1])], offsets - low
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    starts, ends, _ = word_bounds(data, offsets)
    kinds = _kinds(part, starts, ends)
    first = np.empty(len(part), bool)
    first[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    first |= (kinds == _DIGIT) & ((part < 0x80) | (part >= 0xC0))  # each digit is a run
    first[starts] = True
    first &= kinds != _SPACE
    # a sign of one quote with letters of the same word behind it
    heads = np.zeros(len(part) + 2, bool)
    heads[starts] = True
    quotes = np.flatnonzero((part[:-1] == _QUOTE) & (kinds[:-1] == _SIGN) & first[:-1] & (kinds[1:] == _LETTER) & ~heads[1:-2])
    if len(quotes):
        one = _LOWER[part[quotes + 1]]
        two = np.where(heads[quotes + 2], 0, _LOWER[part[np.minimum(quotes + 2, len(part) - 1)]])
        short = np.isin(one, [*b"stmd"])
        long = np.isin(one * np.int64(256) + two, [a << 8 | b for a, b in (b"re", b"ve", b"ll")]) & (quotes + 2 < len(part))
        first[quotes[short | long] + 1] = False
        after = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        after = after[after < len(part)]
        first[after] |= kinds[after] == _LETTER
    runs = np.flatnonzero(first)
    last = kinds != _SPACE
    last[:-1] &= first[1:] | (kinds[1:] == _SPACE)
    return runs, np.flatnonzero(last) + 1, kinds[runs] == _OTHER, np.searchsorted(runs, bounds)


class _Remembered(dict):
    """Ids by text. When full, the entries that came first stay, as frequent ones come early."""

    def make_room(self, most: int) -> None:
        if len(self) > most:
            first = dict(islice(self.items(), most // 2))
            self.clear()
            self.update(first)


class Encoder:
    """Ids of texts, equal to the tokenizer's own for each whole text.

    White space separates tokens of these vocabularies, so a text's ids are those of its words one after the
    other, and a word's those of its runs of letters, digits and signs. The runs of many texts are cut by the kinds of their
    bytes and the different ones found by their hashes at once; what is new of them goes through the vocabulary's merges in
    one call, where every run ends in a token that is marked as a word's end, and is remembered up to a bound. Words with other
    than Latin characters, and texts that spell a special token, go through the tokenizer whole, as do all texts where a file
    cuts or prepares them in another way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=0) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_runs = bool(self.ends.any()) and _cuts_as_known(self.tokenizer)
        if self.by_runs:  # runs are lowered and cut already: only spaces are left to cut at
            to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.normalizer = normalizers.Sequence([])
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), to_bytes])
        self.runs = _Remembered()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_runs(self, runs: list[bytes]) -> None:
        text = b" ".join(runs).decode().lower()
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(runs):
            self.runs.update((r, self.whole(r.decode())) for r in runs)
            return
        data, start = ids.tobytes(), 0
        for run, end in zip(runs, ends.tolist()):
            self.runs[run] = data[start:end]
            start = end

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with ``end`` behind it, and where each text's begin."""
        low = int(offsets[0])
        part = data[low : int(offsets[-1])]
        raw = part.tobytes()
        if not self.by_runs or any(s.encode() in raw for s in self.special):
            texts = [raw[a - low : b - low].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids = [np.append(np.frombuffer(self.whole(t), "<u4"), np.uint32(end)) for t in texts]
            return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        starts, ends, whole, places = _run_bounds(data, offsets)
        _, first, which = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True)
        gc.disable()  # many short lists and no cycles: collections in between would walk all that is remembered
        try:
            own = self._ids_of_runs(raw, part, starts[first], ends[first], whole[first])
        finally:
            gc.enable()
        pool = np.frombuffer(b"".join(own) + np.array([end], "<u4").tobytes(), "<u4")
        lengths = np.array([*map(len, own), 4], np.int64) // 4
        begins = np.cumsum(lengths) - lengths
        stream = np.insert(which, places[1:], len(own))  # the end follows each text's words
        sizes = lengths[stream]
        to = np.cumsum(sizes)
        ids = pool[np.arange(int(to[-1])) - np.repeat(to - sizes - begins[stream], sizes)]
        counts = np.append(0, to)
        return ids, counts[places + np.arange(len(places))]

    def _ids_of_runs(self, raw: bytes, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> list[bytes]:
        lowered, known = _LOWER[part].tobytes(), self.runs
        runs = [lowered[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        found = list(map(known.get, runs))
        new = [i for i, x in enumerate(found) if x is None]
        cut = []
        for i in new:
            if whole[i]:  # as written: lowered it might spell a special token
                known[runs[i]] = self.whole(raw[starts[i] : ends[i]].decode())
            else:
                cut.append(runs[i])
        for k in range(0, len(cut), LEARNED_RUNS):
            self._learn_runs(cut[k : k + LEARNED_RUNS])
        for i in new:
            found[i] = known[runs[i]]
        known.make_room(CACHED_RUNS)
        return found


def _cuts_as_known(tokenizer) -> bool:
    """Whether a file's texts are composed, lowered and cut as ``Encoder`` does it."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    steps = [json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    to_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    return steps == [
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, spaces, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [split, to_bytes]},
    ]


def _encoder(path: str) -> Encoder:
    return kept(f"packing {path}", lambda: Encoder(path))


def tokenized(df: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, source, chunk, before, n, ids) of every document.

    ``chunk`` is the number of the input partition and ``before`` the tokens of the same source earlier in it, so that
    a running total over the whole corpus needs only one row for each chunk and source.
    """
    vocabulary = path

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(vocabulary)
        chunk = TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        for batch in _gathered(batches):
            data, offsets = texts_of(batch.column(2))
            for first, last in slices(offsets, GATHERED_BYTES):
                part = batch.slice(first, last - first)
                ids, places = ids_of(data, offsets[first : last + 1], end)
                counts = np.diff(places)
                before = []
                for source, n in zip(part.column(1).to_pylist(), counts.tolist()):
                    before.append(seen.get(source, 0))
                    seen[source] = before[-1] + n
                width = 2 if ids_of.size <= 65536 else 4
                blob = pa.py_buffer(ids.astype(f"<u{width}").tobytes())
                bounds = pa.py_buffer((places * width).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(counts), chunk)), pa.array(before, pa.int64()),
                     pa.array(counts), pa.Array.from_buffers(pa.binary(), len(counts), [None, bounds, blob])],
                    names=["doc_id", "source", "chunk", "before", "n", "ids"],
                )

    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        text_or_empty().alias("text"),
    )
    return rows.mapInArrow(encode, "doc_id long, source string, chunk long, before long, n long, ids binary")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``GATHERED_BYTES`` from smaller ones, in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Mixture:
    """Deficit round-robin over source queues, in closed form.

    In round r every queue is served up to the whole tokens of its fair share of ``window * r``; the fraction is
    its deficit, carried to the next round. When a queue runs dry the others share its part by their
    weights. The rounds one after the other, sources in order within a round, are the stream that is cut into
    windows, so the place of any token follows from its source and its place in the queue.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.weights, self.window = totals, weights, window
        self.tokens = sum(totals)
        order = sorted((i for i in range(len(totals)) if totals[i]), key=lambda i: Fraction(totals[i], weights[i]))
        self.steps: list[tuple[int, Fraction, int]] = []  # position, virtual time, weight of the queues not dry
        position, time, active = Fraction(0), Fraction(0), sum(weights[i] for i in order)
        for i in order:
            until = Fraction(totals[i], weights[i])
            if until > time:
                self.steps.append((position, time, active))
                position, time = position + (until - time) * active, until
            active -= weights[i]
        self.rounds: dict[int, tuple[list[int], list[int]]] = {}

    def served(self, rounds: int) -> list[int]:
        """Tokens of each queue served after so many rounds."""
        x = rounds * self.window
        if x >= self.tokens:
            return self.totals
        at = max(k for k, s in enumerate(self.steps) if s[0] <= x)
        position, time, active = self.steps[at]
        time = time + (x - position) / active
        top, below = time.numerator, time.denominator
        return [min(t, w * top // below) for t, w in zip(self.totals, self.weights)]

    def starts(self, r: int) -> tuple[list[int], list[int]]:
        """For round r (from 0): tokens each queue had served before it, and where its part of the round begins."""
        if r not in self.rounds:
            if len(self.rounds) * len(self.totals) > 200_000:
                self.rounds.clear()
            before, after = self.served(r), self.served(r + 1)
            place, places = sum(before), []
            for a, b in zip(before, after):
                places.append(place)
                place += b - a
            self.rounds[r] = before, places
        return self.rounds[r]

    def round_of(self, source: int, token: int) -> int:
        """The round that serves this token of the queue."""
        low, high = 0, -(-self.tokens // self.window)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.served(middle)[source] <= token else (low, middle)
        return low


def pack(df: DataFrame, tokenizer: str, window: int = WINDOW, weights: dict[str | None, int] | None = None) -> DataFrame:
    """Pieces of all documents in windows: (doc_id, source, start, length, doc_tokens, sequence_id, offset, ids).

    ``tokenizer`` is the path of a vocabulary file; the id 2 ends every document. Each source is a queue of its
    documents in the order of the input; a window takes tokens from the queues in the proportions of ``weights``
    (default: of all tokens by source, so that the mixture holds to the last window). Documents
    are cut where a window or a source's turn ends. Only the last window is not full. ``ids`` holds a piece's ids as
    little-endian 32-bit integers.

    Texts are tokenized once; ids are written and not shuffled. A running total over chunks by source gives each document its
    place in its queue, and ``Mixture`` the windows of its tokens. The table of totals by chunk is joined by
    Spark as its size allows; the driver holds one total a source (at most 100,000 sources, an error beyond).

    A null or empty text is the end id alone. A null source is a queue of its own. A null doc_id is kept. Repeated rows are packed
    each. An empty table gives no piece. Other columns play no part.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = write_once(tokenized(df, tokenizer))
    chunks = rows.groupBy("source", "chunk").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("source", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("queued"))
    offsets = write_once(offsets.withColumnsRenamed({"source": "_s", "chunk": "_c"}))
    found = rows.groupBy("source").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [r["n"] for r in found]
    given = totals if weights is None else [weights[r["source"]] for r in found]
    place = {r["source"]: i for i, r in enumerate(found)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(totals, given, window)
        turns: dict[int, tuple[int, int, int, int]] = {}  # of each queue: the round last met, and its place
        for batch in batches:
            out: list[tuple] = []
            for doc_id, source, n, first, ids in zip(*[c.to_pylist() for c in batch.columns]):
                values = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()  # n is 1 at least
                s, done = place[source], 0
                r, begin, end, start = turns.get(s, (0, 0, 0, 0))
                while done < n:
                    token = first + done
                    if not begin <= token < end:
                        if end and token == end and mixture.starts(r + 2)[0][s] > token:
                            r += 1
                        else:
                            r = mixture.round_of(s, token)
                        before, places = mixture.starts(r)
                        begin, end, start = before[s], mixture.starts(r + 1)[0][s], places[s]
                    at = start + token - begin
                    take = min(n - done, end - token, window - at % window)
                    out.append((doc_id, source, done, take, n, at // window, at % window, values[4 * done : 4 * (done + take)]))
                    done += take
                turns[s] = r, begin, end, start
            if out:
                names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c"))
    return (
        rows.join(offsets, same)
        .select("doc_id", "source", "n", (F.col("queued") + F.col("before")).alias("first"), "ids")
        .mapInArrow(
            cut, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
        )
    )


def crc32_of(ids: Column) -> Column:
    """Unsigned crc32 of the bytes of ``ids``."""
    return F.crc32(ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The windows themselves: (sequence_id, length, ids), ids as little-endian 32-bit integers in order of place.

    A group holds at most one window's tokens, whatever the size of the corpus.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(ordered, F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
