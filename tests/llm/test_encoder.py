"""Token ids of operator 6: runs are cut as the vocabulary cuts them, and work follows the different runs."""

import json
import random
import sys

import public_tokenizers
import pyarrow as pa
import pytest

from marquee.llm import packing
from marquee.llm.common import texts_of
from marquee.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)


def _same(encoder: packing.Encoder, texts: list[str | None]) -> None:
    ids, at = encoder(*texts_of(pa.array(texts, pa.string())), 2)
    want = encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == want[i].ids + [2], repr(text)
    assert at[-1] == len(ids)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def test_runs_are_cut_as_the_pattern_cuts_them(encoder):
    signs = [chr(c) for c in range(0x300)]
    _same(encoder, signs)
    _same(encoder, [f"X{c}y {c}'s {c * 3}1{c}" for c in signs])
    draw = random.Random(4)
    letters = "''''stmdrevlSTMDREVL aAé1²¼.!& \n\tİſÑȺ́\x00\x1c\x85日<|>"
    _same(encoder, ["".join(draw.choices(letters, k=draw.randint(0, 12))) for _ in range(20_000)])
    for last in ("'", "'s", "'r", "'re", "a'l", "a'll", "é", "日", "", None):
        _same(encoder, [last])
        _same(encoder, ["x", last, "s", last])


def test_work_follows_the_different_runs_not_the_words(encoder):
    draw = random.Random(5)
    runs = ["".join(draw.choices("abcdefghijklmnop", k=8)) for _ in range(200)]
    words = [f"{a}.{b}" for a in runs for b in runs]
    data, offsets = texts_of(pa.array([" ".join(words)]))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        encoder(data, offsets, 2)
    finally:
        sys.setprofile(None)
    assert calls < 5_000  # 201 runs in 40,000 words
    _same(encoder, [" ".join(words)])


def test_few_runs_are_remembered_and_ids_stay_right(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_RUNS", 50)
    small, draw = packing.Encoder(PATH), random.Random(6)
    for _ in range(20):
        _same(small, [" ".join(f"w{draw.randint(0, 400):x}'s" for _ in range(60)) for _ in range(3)])
        assert len(small.runs) <= 50


def test_a_file_that_cuts_otherwise_goes_through_its_tokenizer(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file), encoding="utf-8")
    _same(packing.Encoder(str(other)), ["it's 1234 and a1b2", "", "don't"])
