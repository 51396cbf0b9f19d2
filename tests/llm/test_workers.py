"""What a Python worker holds while it reads texts, and what it keeps for the stage after."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from marquee.llm import common, language, neardup, packing
from marquee.llm.queries import VOCABULARY


def _batch() -> pa.RecordBatch:
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 9_000, 2_500)) for _ in range(512)]
    return pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])


def test_memory_of_a_batch_of_texts_is_bounded():
    batch = _batch()
    tracemalloc.start()
    n = sum(len(hashes) for _, _, hashes, _ in neardup._rows(batch, "text"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 512 * (2_500 - 4) and most < 48 << 20


def test_the_next_stage_lets_go_of_the_tokenizer():
    path = public_tokenizers.path(VOCABULARY)
    few = pa.RecordBatch.from_arrays([pa.array(["one two three four five six", None])], names=["text"])
    for read in (neardup._rows, language._profiles):
        encoder = packing._encoder(path)
        assert packing._encoder(path) is encoder
        assert len(list(read(few, "text"))) == 1
        assert packing._encoder(path) is not encoder
    common.release()
