"""Exact ROC over many partitions, blocked centroid products, the subgraph of the largest component."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import graph, importance, scoring, vectors


def test_roc_is_exact_over_partitions_ties_and_one_class(spark):
    draw = np.random.default_rng(2)
    rows = [("x", float(s), int(t)) for s, t in zip(draw.integers(0, 60, 900) / 60, draw.integers(0, 2, 900))]
    rows += [("y", 0.5, 1), ("y", 0.25, 1), ("z", 0.5, 0)]
    df = spark.createDataFrame(rows, "label string, score double, truth int").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {(r["label"], r["score"]): r for r in scoring.roc_points(df).collect()}
        areas = {r["label"]: r["auc"] for r in scoring.auc_by_label(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    own = [(s, t) for n, s, t in rows if n == "x"]
    assert len(found) == len({s for s, _ in own}) + 3
    for s in {s for s, _ in own}:
        r = found["x", s]
        assert r["tp"] == sum(t for q, t in own if q >= s) and r["fp"] == sum(1 - t for q, t in own if q >= s)
    won = sum((a > b) + (a == b) / 2 for a, t in own if t for b, u in own if not u)
    assert areas["x"] == pytest.approx(won / sum(t for _, t in own) / sum(1 - t for _, t in own))
    assert areas["y"] is None and areas["z"] is None


@pytest.mark.parametrize("block", [2, 512])
def test_centroid_cosines_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "LABEL_BLOCK", block)
    x = np.random.default_rng(1).normal(size=(7, 5))
    x[3] = 0
    means = spark.createDataFrame([(i, 20, v.tolist()) for i, v in enumerate(x)], "label int, n long, centroid array<double>")
    found = vectors.centroid_cosines(means).collect()
    assert len(found) == 49 and dict(vectors.centroid_cosines(means).dtypes)["label"] == "int"
    for r in found:
        a, b = x[r["label"]], x[r["other"]]
        if 3 in (r["label"], r["other"]):
            assert r["cosine"] is None
        else:
            assert r["cosine"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_largest_subgraph(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("a", "d", 1), ("d", "e", 2), ("x", "y", 9), ("x", "z", 9), ("y", "z", 9)]
    df = spark.createDataFrame(edges, "src string, dst string, weight long")
    found = sorted((r["src"], r["dst"], r["edge_width"]) for r in graph.largest_subgraph(df, 3).collect())
    # x, y and z have the higher degrees and lie outside; b is the first of the nodes of degree 1
    assert found == [("a", "b", 2.0), ("a", "d", 1.0)]


def test_models_without_importances_give_no_rows(spark):
    empty = importance.analyze_importance(spark, {"none": {}}, ["a"], spark.range(1).select(F.col("id")), "id", permute=False)
    assert empty.collect() == [] and empty.columns == ["model", "method", "feature", "importance"]


@pytest.mark.parametrize("exclude_self", [False, True])
def test_neighbours_of_a_block_are_exact_and_its_memory_is_bounded(exclude_self):
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(40_000, 8))
    rows[500:900], rows[7], rows[8, 2] = rows[3], 1e3, np.nan
    ids, few = np.arange(len(rows))[::-1].copy(), np.r_[0:12, 500:520]
    step = vectors._chunk(len(rows))
    assert step * len(rows) <= vectors.CHUNK_VALUES
    tracemalloc.start()
    parts = [few[at : at + step] for at in range(0, len(few), step)]
    found = [vectors._best_of_block(rows[p], rows, ids[p], ids, 6, exclude_self, 9) for p in parts]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 8 * vectors.CHUNK_VALUES
    got = {int(p[q]): [] for p in parts for q in range(len(p))}
    for p, (query, row, d2) in zip(parts, found):
        for q, r, d in zip(query, row, d2):
            got[int(p[q])].append((d, int(ids[r])))
    for q in few:
        exact = np.round(np.cumsum((rows - rows[q]) ** 2, axis=1)[:, -1], 9)
        near = sorted((d, int(i)) for d, i in zip(exact, ids) if np.isfinite(d) and not (exclude_self and i == ids[q]))
        assert got[int(q)] == near[:6]
