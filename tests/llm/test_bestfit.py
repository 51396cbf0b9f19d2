"""Operator 11: ids against the tokenizers library, sequences against plain best fit."""

import bisect
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from marquee.llm import bestfit  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece int, length long, item long"


def plain(sizes, window):
    """Best fit, large ones first, one after the other; the number of sequences."""
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        rest = (gaps.pop(at) if at < len(gaps) else window) - size
        opened += at == len(gaps) and rest == window - size and True
        bisect.insort(gaps, rest)
    return len(gaps)


def sizes(kind, rows, window):
    draw = np.random.default_rng(7)
    return {
        "even": draw.integers(1, window, rows), "small": draw.geometric(0.03, rows).clip(1, window - 1),
        "hot": np.where(draw.random(rows) < 0.4, window * 2 // 5, draw.integers(1, window, rows)),
        "ones": np.ones(rows, int), "halves": np.full(rows, window // 2 + 1), "mixed": (draw.lognormal(4.6, 1.2, rows).astype(int)).clip(1, window - 1),
    }[kind]


@pytest.mark.parametrize("kind", ["even", "small", "hot", "ones", "halves", "mixed"])
@pytest.mark.parametrize("cell", [150, 100_000])
def test_best_fit(spark, monkeypatch, kind, cell):
    """Many cells and one: each item once, no overlap, no more than one in twenty sequences above plain best fit."""
    monkeypatch.setattr(bestfit, "CELL_ROWS", cell)
    window, own = 512, sizes(kind, 700, 512)
    items = spark.createDataFrame([(i * 3, int(n)) for i, n in enumerate(own)], "item long, size long")
    got = bestfit.best_fit(items, window).collect()
    assert sorted(r.item for r in got) == [i * 3 for i in range(700)]
    placed = {}
    for r in got:
        placed.setdefault(r.sequence, []).append((r.offset, int(own[r.item // 3])))
    for parts in placed.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= window
    best = plain(own.tolist(), window)
    assert len(placed) <= best * (1.05 if cell < 1000 else 1.0) + 1


def test_sweep_is_best_fit_in_one_cell():
    draw = np.random.default_rng(3)
    for _ in range(50):
        own = draw.integers(1, 64, 40).tolist()
        gaps = draw.integers(1, 64, 15).tolist()
        rows = sorted([(g, bestfit.GAP, i) for i, g in enumerate(gaps)] + [(s, bestfit.DOCUMENT, i) for i, s in enumerate(own)], reverse=True)
        found = bestfit.sweep(rows, 64)
        left, expected = sorted(gaps), 0
        for size in sorted(own, reverse=True):
            at = bisect.bisect_left(left, size)
            if at < len(left):
                bisect.insort(left, left.pop(at) - size)
                expected += 1
        assert len(found[bestfit.PLACED]) == expected
        rest = sorted(size for what in (bestfit.GAP, bestfit.CLOSED) for _, size, _, _ in found[what])
        assert rest == [x for x in left if x]


def test_allotted_documents_surely_fit():
    """Sizes drawn within the bounds of each cell always fit the gaps they are allotted to."""
    draw = np.random.default_rng(5)
    for _ in range(200):
        edges = np.sort(draw.integers(1, 200, 7))[::-1]
        cells, docs, gaps = {}, {}, {}
        for c in range(6):
            low, high = int(edges[c + 1]), int(edges[c])
            docs[c] = sorted(draw.integers(low, high + 1, draw.integers(0, 9)).tolist(), reverse=True)
            gaps[c] = sorted(draw.integers(low, high + 1, draw.integers(0, 5)).tolist())
            cells[c] = {
                what: {"n": len(x), "least": min(x), "most": max(x)} for what, x in ((bestfit.DOCUMENT, docs[c]), (bestfit.GAP, gaps[c])) if x
            }
        room = {c: list(g) for c, g in gaps.items()}
        served = set()
        for other, first, cell, done, until, each in bestfit.allot(cells, 1000):
            for rank in range(done, until):
                assert (cell, rank) not in served
                served.add((cell, rank))
                at = first + (rank - done) // each
                room[other][at] -= docs[cell][rank]
                assert room[other][at] >= 0


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    own, theirs = bestfit.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ["", " ", "It's  a test\n\n of 12 345 words", "a" * 30_000, "\t \n" * 5_000, "x<|endoftext|>y", "汉字 é ü ٣  z", "!?" * 4_000]:
        assert own.ids(text) == theirs.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_through_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Words, and MORE words"
    assert bestfit.Encoder(path).ids(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_pack(spark):
    """Nulls, empty and long texts, repeated rows, clashing names: every id of every document in exactly one piece."""
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(PATH)
    words = " ".join(f"word{i % 97} and" for i in range(4000))
    texts = [(0, None), (1, ""), (2, "one two"), (2, "one two"), (None, "no number"), (3, words), (4, words[:9000]), (5, "a" * 20_000)]
    texts += [(10 + i, words[i * 13 : i * 13 + 40 * i]) for i in range(80)]
    df = spark.createDataFrame([(d, t, 9, 9, 9) for d, t in texts], SCHEMA).repartition(3)
    pieces = bestfit.pack(df, PATH, 256).cache()
    rows = pieces.collect()
    by_doc = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and 0 <= r.offset <= 256 - r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts:
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in by_doc[doc_id]), key=lambda r: (r.piece, r.offset))
        if doc_id == 2:
            assert len(own) == 2 and own[0].ids == own[1].ids and (own[0].sequence_id, own[0].offset) != (own[1].sequence_id, own[1].offset)
            continue
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 256 for r in own[1:])
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    for r in bestfit.sequences(pieces).collect():
        parts = sorted((p for p in rows if p.sequence_id == r.sequence_id), key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert r.length <= 256 and r.ids == b"".join(p.ids for p in parts)
    assert bestfit.pack(df.limit(0), PATH).collect() == []
