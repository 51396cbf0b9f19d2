"""Operator 13 against plain Lloyd."""

import hashlib

import numpy as np
import pytest

from marquee.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def plain(vectors, parts=8, entries=16, rounds=6, scale=4096):
    """All distances of all parts to all entries in every round."""
    x = np.floor(scale * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64)
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        gap = x[:, :, None, :] - books[None]
        distance = (gap * gap).sum(axis=3)
        code = distance.argmin(axis=2)
        if turn == rounds:
            return code, distance.min(axis=2).sum(axis=1), books
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)


def clouds(rows, width, seed, copies=0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(7, width))
    x = middle[draw.integers(0, 7, rows)] * 0.2 + draw.normal(size=(rows, width)) * 0.05
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    return x.astype(np.float32).tolist()


@pytest.mark.parametrize("points, leaf", [(1, 16), (15, 16), (17, 16), (700, 16), (16, 1), (13, 1)])
def test_tree_holds_every_point_once(points, leaf):
    x = np.random.default_rng(points).integers(-50, 50, (points, 3))
    tree = codes.Tree(x, leaf)
    assert sorted(tree.order.tolist()) == list(range(points)) and (tree.points == x[tree.order]).all()
    again = codes.Tree(tree.points, leaf, tree.order)
    for level in range(tree.depth + 1):
        assert tree.counts[level].sum() == points and (leaf == 1 or tree.counts[level].min() >= 1)
        some = tree.counts[level] > 0
        assert (tree.sums[level][some].sum(axis=0) == x.sum(axis=0)).all()
        assert (tree.low[level] == again.low[level]).all() and (tree.high[level] == again.high[level]).all()
    assert tree.counts[-1].max() <= leaf


@pytest.mark.parametrize("spread", [1, 3, 40, 4000])
def test_assignment_equals_all_distances(spread):
    """Narrow spreads make ties and equal entries; wide ones let whole nodes go."""
    for seed in range(12):
        draw = np.random.default_rng([seed, spread])
        points = draw.integers(-spread, spread + 1, (draw.integers(1, 900), draw.integers(1, 9)))
        points[: len(points) // 3] = points[0]
        book = points[draw.integers(0, len(points), draw.integers(1, 17))] + draw.integers(0, 2)
        gap = points[:, None] - book[None]
        expected = (gap * gap).sum(axis=2).argmin(axis=1)
        tree = codes.Tree(points, codes.LEAF_ROWS)
        assert (codes.codes(tree, book) == expected).all()
        counts, sums = codes.totals(tree, book)
        assert (counts == np.bincount(expected, minlength=len(book))).all()
        assert all((sums[e] == points[expected == e].sum(axis=0)).all() for e in range(len(book)))


def test_whole_nodes_are_assigned_where_parts_lie_in_clouds():
    points = np.concatenate([np.random.default_rng(i).integers(0, 30, (300, 4)) + 10_000 * i for i in range(5)])
    tree = codes.Tree(points, codes.LEAF_ROWS)
    pieces = list(codes.assign(tree, points[::300]))
    assert sum(len(at) for level, at, _ in pieces if level < 0) < 100 < 1300 < sum(tree.counts[k][at].sum() for k, at, _ in pieces if k >= 0)
    assert sum(len(at) for level, at, _ in pieces if level >= 0) < 40


def test_vector_codes(spark, monkeypatch):
    """Several blocks, repeated rows, nulls in every column, other lengths and clashing names."""
    monkeypatch.setattr(codes, "BLOCK_BYTES", 8 * 16 * 50)
    vectors = clouds(240, 16, 4, copies=60)
    rows = [(i, v, i % 3 if i % 7 else None, "x", 1) for i, v in enumerate(vectors)]
    bad = [
        (-1, None, 1, "x", 1), (-2, [None] + vectors[0][1:], 1, "x", 1), (-3, [float("nan")] + vectors[0][1:], 1, "x", 1),
        (-4, [float("-inf")] + vectors[0][1:], None, "x", 1), (-5, [], 2, "x", 1), (-6, vectors[0][:8], 2, "x", 1),
    ]
    expected_code, error, books = plain(vectors)
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    got = {r.vec_id: r for r in codes.vector_codes(df).collect()}
    assert sorted(got) == [-6, -5, *range(300)]
    by_label = {}
    for i in range(300):
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + int(error[i])
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    for i in range(300):
        assert got[i].code == "".join(f"{c:02x}" for c in expected_code[i])
        assert (got[i].error, got[i].label_error, got[i].codebooks_sha256) == (error[i], by_label[rows[i][2]], sha)
    assert got[-5].code is None and got[-6].error is None and got[-6].label_error == by_label[2]


def test_few_rows_equal_ids_and_null_ids(spark):
    vectors = clouds(3, 8, 9)
    df = spark.createDataFrame(
        [(None, vectors[2], 1, "", 0), (5, vectors[0], 1, "", 0), (5, vectors[1], None, "", 0), (5, vectors[0], 1, "", 0)], SCHEMA
    )
    got = codes.vector_codes(df).collect()
    assert len(got) == 4 and {r.error for r in got} == {0}
    order = sorted([vectors[0], vectors[0], vectors[1]]) + [vectors[2]]
    expected_code, _, books = plain(order)
    digest = codes.digest(books)
    assert {(r.vec_id, r.code, r.codebooks_sha256) for r in got} == {
        (v, "".join(f"{c:02x}" for c in expected_code[order.index(x)]), digest)
        for v, x in [(None, vectors[2]), (5, vectors[0]), (5, vectors[1])]
    }


def test_empty_and_too_large(spark):
    assert codes.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        codes.vector_codes(spark.createDataFrame([(1, [1e6] * 8, 1, "", 0)], SCHEMA)).collect()
