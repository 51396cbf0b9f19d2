"""Operator 12 against plain comparison of all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marquee.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, id long, form string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\u0080" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best and counts[best] >= 10 * n else None, n, len(others)]
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts.get(form)))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in rows], SCHEMA).repartition(4)
    got = spelling.spelling_variants(df).collect()
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(found) == len(got) and found == plain(rows)
    return found


def test_edits_ties_accents_and_chains(spark):
    draw = np.random.default_rng(1)
    letters = list("abcdefgéÿ")
    base = ["".join(draw.choice(letters, draw.integers(6, 12))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaab", "abababab", "Étésansfin"]
    words = list(base)
    for w in base:
        for _ in range(6):
            i = int(draw.integers(0, len(w)))
            c = str(draw.choice(letters))
            words.append([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]][int(draw.integers(0, 3))])
    rows = []
    for i, w in enumerate(words):
        times = int(draw.choice([2, 3, 20, 45, 400]))
        rows += [(int(d), f"{w.upper() if i % 5 == 0 else w}, 1{w}2 {'kurz'}") for d in draw.integers(0, 10**6, times)]
    found = check(spark, rows + [(None, None), (None, ""), (5, None)])
    assert any(r[1] and r[2] != r[1] for r in found) and any(r[4] > 3 for r in found)


def test_long_runs_null_ids_and_repeated_rows(spark):
    """Words below, at and above the length from which rotations are hashed, near each other across it."""
    rows = []
    for size in (62, 63, 64, 65, 66, 300):
        w = "".join(chr(ord("a") + (i * i + size // 100) % 26) for i in range(size))
        for i, v in enumerate([w, w[:-1], w + "z", w[:30] + "q" + w[31:], w[:30] + w[31:], w[:5] + w[5] + w[5:]]):
            rows += [(k, v) for k in range(2 if i else 25)]
    rows += [(None, "Nothing Nothing nothing"), (None, "Nothing Nothing nothing"), (7, "aaaaaaa " * 3 + "aaaaaaaa " * 40 + "aaaaaaaaa " * 500)] * 2
    found = check(spark, rows)
    assert max(len(r[0]) for r in found) > 290


def test_very_long_run_takes_room_in_proportion():
    keys = [list(spelling._keys_of("ab" * n)) for n in (500, 1000)]
    assert len(keys[1]) == 4001 and max(len(k) for k, _, _ in keys[1]) <= 64 and len({k for k, _, _ in keys[1]}) > 2000


def test_text_bytes_are_letters_only_where_they_are():
    found = spelling.runs_of(1, "× times×seven÷s Ābcdefgh €ééééééé ABCDEFG".encode())
    expected = {w.lower().encode() if w.isascii() else w.encode() for w in re.findall("[A-Za-zÀ-ÿ]{7,}", "× times×seven÷s Ābcdefgh €ééééééé ABCDEFG")}
    assert set(found) <= expected and len(found) >= 3


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("held", [1, 7])
def test_counts_do_not_depend_on_what_a_task_holds(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", held)
    df = spark.createDataFrame([(i, "repeated another wonderful repeated") for i in range(30)], "doc_id long, text string")
    assert sum(r.n for r in spelling.word_counts(df).collect()) >= 4 * 30 - 30
