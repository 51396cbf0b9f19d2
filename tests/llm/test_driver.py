"""What the driver's Python holds while the pipeline's stages run."""

import tracemalloc

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from marquee.llm import common, language, neardup, packing
from marquee.llm.queries import VOCABULARY


def _peak(work) -> tuple:
    tracemalloc.start()
    out = work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_document_frequency_makes_no_row_objects(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2_000)), lambda i: F.hex(F.xxhash64(i, "id"))))
    docs = spark.range(200).select(words.alias("text"))
    (n, counts), most = _peak(lambda: neardup.document_frequency(docs))
    assert n == 200 and len(counts) == neardup.IDF_BUCKETS and 190_000 < np.count_nonzero(counts) and most < 16 << 20


def test_an_svm_neither_copies_nor_widens_its_sample():
    draw = np.random.default_rng(2)
    x = draw.random((1_500, language.DIMENSIONS), np.float32)
    y = np.where(np.arange(1_500) % 3 == 0, 1.0, -1.0)
    x[y > 0, :40] += 2
    w, most = _peak(lambda: language.svm(x, y, rounds=2))
    assert most < x.nbytes / 2
    # the same steps in plain Python numbers of numpy, over the whole sample
    z, plain, mean = np.hstack([x, np.ones((1_500, 1), np.float32)]).astype(np.float64), np.zeros(4_097), np.zeros(4_097)
    balance = np.where(y > 0, 0.5 / 500, 0.5 / 1_000)
    for t in range(1, 21):
        off = (z @ plain) * y < 1
        plain = plain - 1 / (1e-3 * (t + 20)) * (1e-3 * plain - z[off].T @ (y[off] * balance[off]))
        mean += plain * (t > 10)
    assert np.abs(w - mean / 10).max() < 1e-9


def test_the_sample_of_a_language_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"{'the cat and the hat' if i % 2 else 'le chat et le chien'} {i}", ["fr", "en"][i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = language.learn(docs, 20), language.learn(docs.repartition(7).orderBy(F.desc("doc_id")), 20)
    assert a.names == b.names == ["en", "fr"]
    assert a.pairs.keys() == b.pairs.keys() and all(np.array_equal(a.pairs[k], b.pairs[k]) for k in a.pairs)


def test_packing_loads_no_tokenizer_on_the_driver(spark):
    common.release()
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, None)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, public_tokenizers.path(VOCABULARY)).collect()
    assert sorted((p.doc_id, p.length, len(p.ids)) for p in pieces) == [(1, 4, 16), (2, 1, 4)]
    assert not common._KEPT
