import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee import runtime
from marquee.operators import features, graph, joins, scoring, search, tables, vectors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- skew


def test_skew_join_spreads_hot_keys_and_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    left = spark.range(300).select(F.col("id").alias("x"), F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    left = left.unionByName(spark.createDataFrame([(1000, None)], "x long, k string"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(runtime.skew_join(left, right, ["k"], how).select("x")) == rows(left.join(right, "k", how).select("x"))
    assert [tuple(r) for r in runtime.hot_keys(left, ["k"]).collect()] == [("hot", 200)]
    with pytest.raises(ValueError):
        runtime.skew_join(left, right, ["k"], "full")


def test_shuffles_are_sized_by_the_input(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    size = runtime.input_bytes(spark, str(tmp_path / "t"))
    assert size > 1000
    assert runtime.size_shuffles(spark, str(tmp_path / "t"), bytes_per_task=size // 50) >= 50
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_dense_index_numbers_every_key_once(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "a").otherwise("b").alias("g"), F.concat(F.lit("n"), "id").alias("k"))
    found = runtime.dense_index(df, "g", "k", "i", buckets=16).collect()
    for group, size in (("a", 400), ("b", 100)):
        assert sorted(r["i"] for r in found if r["g"] == group) == list(range(size))


# ---------------------------------------------------------------- tables


def test_profiles_and_filters(spark):
    df = spark.createDataFrame([("a", None, "x"), (None, None, "y"), ("Unknown", 1, None)], "p string, q int, r string")
    assert rows(tables.null_profile(df).withColumn("percent", F.round("percent", 6))) == [("p", 1, 33.333333), ("q", 2, 66.666667), ("r", 1, 33.333333)]
    assert tables.drop_value(df, "p").count() == 2 and tables.drop_value(df, "p", keep_null=False).count() == 1
    assert rows(tables.fill_strings(df).select("p", "r")) == [("", "y"), ("Unknown", ""), ("a", "x")]
    assert tables.conflicts(df, "p", "r").count() == 2
    assert [r["type"] for r in tables.schema_report(df).collect()] == ["string", "int", "string"]
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.require_columns(df, ["p", "z"])
    lists = spark.createDataFrame([(["a"],), ([],), (None,)], "l array<string>")
    assert tables.drop_empty_labels(lists, "l").count() == 1
    assert tables.exploded(lists, "l", "v").count() == 3
    short = spark.createDataFrame([("The Matrix", "a b c"), ("Long", "w " * 20)], "Title string, Plot string")
    assert [r["Title"] for r in tables.drop_short(short, "Plot").collect()] == ["Long"]


def test_sample_is_the_same_on_any_partitioning(spark, monkeypatch):
    df = spark.range(1000)
    sorted_limit = rows(tables.seeded_sample(df, "id", 333))
    monkeypatch.setattr(tables, "SORTED_SAMPLE", 10)
    assert rows(tables.seeded_sample(df, "id", 333)) == sorted_limit
    first = rows(tables.seeded_sample(df, "id", 50))
    assert first == rows(tables.seeded_sample(df.repartition(7), "id", 50)) and len(first) == 50
    assert tables.seeded_sample(df, "id", 2000).count() == 1000


def test_rankings_and_ties(spark):
    df = spark.createDataFrame([("d1", "b"), ("d1", "a"), ("d1", "a"), ("d1", "b"), ("d1", ""), ("d1", None), ("d2", "c")], "g string, k string")
    assert rows(tables.top_per_group(df, "g", "k", 1)) == [("d1", "a", 2, 1), ("d2", "c", 1, 1)]
    assert [tuple(r) for r in tables.value_counts(df, "k", 2).collect()] == [("a", 2), ("b", 2)]
    people = spark.createDataFrame([("A", None, 1, "x"), ("A", 5.0, 3, "y"), ("A", 5.0, 2, "z"), ("B", None, 4, "w")], "name string, pop double, id int, c string")
    assert [tuple(r) for r in tables.best_per_key(people, "name", "pop", "id", 20).collect()] == [("A", 5.0, 2, "z"), ("B", 0.0, 4, "w")]
    assert rows(tables.first_per_key(people, "name", [F.col("id")]).select("name", "id")) == [("A", 1), ("B", 4)]


def test_weighted_pivots(spark):
    films = spark.createDataFrame([("P", ["x", "y"]), ("P", ["x"]), ("Q", ["y"]), (None, ["y"])], "d string, l array<string>")
    assert rows(tables.weighted_pivot(films, "d", "l", "owner", ["x", "y"])) == [("P", 1.0, 0.5), ("Q", 0.0, 1.0)]
    wide = tables.weighted_pivot(films, "d", "l", "label", ["x", "y"])
    assert rows(wide.select("owner", F.round("x", 9), F.round("y", 9))) == [("P", 1.0, 0.333333333), ("Q", 0.0, 0.333333333)]


def test_metrics(spark):
    films = spark.createDataFrame([("a", 0.0, 5.0, 1), ("b", 2.0, 5.0, 2), ("b", 4.0, 7.0, 3)], "g string, b double, r double, v int")
    assert rows(tables.group_metrics(films, "g", "b", "r", ["v"])) == [("a", 0.0, 5.0, 1.0, 1, None), ("b", 3.0, 6.0, 2.5, 2, 1.0)]
    years = spark.createDataFrame([(1959, 1.0)] * 12 + [(1990, 2.0)] * 10 + [(1991, 3.0)] * 9 + [(None, 1.0)], "y int, v double")
    assert rows(tables.yearly_metrics(years, "y", ["v"])) == [(1990, 2.0, 10)]


# ---------------------------------------------------------------- joins


def test_enrich_left_does_not_fan_out(spark):
    films = spark.createDataFrame([(1, "Heat", None), (2, "HEAT", "X"), (3, "None", None)], "id int, title string, director string")
    credits = spark.createDataFrame([(2, "heat", "Second"), (1, "Heat", "First")], "cid int, t string, other string")
    joined = joins.enrich_left(films, credits, F.col("title"), F.col("t"), ["other"], "cid")
    assert rows(joined.select("id", F.coalesce("director", "other"))) == [(1, "First"), (2, "X"), (3, None)]


def test_small_joins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    assert rows(joins.align_categories(df, "c", ["a", "z"]).drop("c")) == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]
    dim = spark.createDataFrame([("a", "AAA")], "k string, v string")
    assert rows(joins.lookup(df, dim, "c", "k", "v", "iso").select("id", "iso")) == [(1, "AAA"), (2, None), (3, None)]
    assert joins.union_align(df, spark.createDataFrame([(9.0,)], "z double")).count() == 4


# ---------------------------------------------------------------- graph


def test_edges_and_subgraph(spark):
    films = spark.createDataFrame([(["b", "a", "c"],), (["a", "b"],), (["a"],), ([],), (list("abcdef"),)], "people array<string>")
    edges = {(r["src"], r["dst"]): r["weight"] for r in graph.co_edges(films).collect()}
    assert edges[("a", "b")] == 3 and ("a", "f") not in edges and len(edges) == 10
    nodes = {r["node"]: (r["degree"], r["node_size"]) for r in graph.subgraph_nodes(graph.co_edges(films), 3).collect()}
    assert nodes == {"a": (2, 70), "b": (2, 70), "c": (2, 70)}
    widths = {r["edge_width"] for r in graph.top_subgraph(graph.co_edges(films), 2).collect()}
    assert {float(w) for w in widths} == {2.0}


@pytest.mark.parametrize("hot", [200_000, 3])
def test_components_match_union_find(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    draw = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 120, (80, 2)) if a != b]
    pairs += [(200 + i, 201 + i) for i in range(30)] + [(300, 301 + i) for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs], "src long, dst long")
    found = graph.components(edges)
    assert dict(rows(found)) == {n: find(n) for n in parent}
    assert graph.components(edges.limit(0)).count() == 0
    biggest = {}
    for n in parent:
        biggest.setdefault(find(n), []).append(n)
    best = min(biggest, key=lambda c: (-len(biggest[c]), c))
    assert [n for (n,) in rows(graph.largest_component(found))] == sorted(biggest[best])


# ---------------------------------------------------------------- features


def test_tfidf_against_hand_weights(spark):
    docs = spark.createDataFrame([(1, "red red Fox"), (2, "fox, dog"), (3, ""), (4, None)], "id int, text string")
    found = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(docs, "id", "text", 10, bigrams=False).collect()}
    idf = lambda df: np.log(5 / (1 + df)) + 1
    red, fox, dog = (1 + np.log(2)) * idf(1), idf(2), idf(1)
    assert found == pytest.approx({
        (1, "red"): red / np.hypot(red, fox), (1, "fox"): fox / np.hypot(red, fox),
        (2, "fox"): fox / np.hypot(fox, dog), (2, "dog"): dog / np.hypot(fox, dog),
    })
    whole = features.tfidf(docs, "id", "text", None, bigrams=False)
    assert {(r["id"], r["term"]): r["weight"] for r in whole.collect()} == pytest.approx(found)
    pairs = features.tfidf(docs, "id", "text", 2, bigrams=True).select("term").distinct()
    assert rows(pairs) == [("fox",), ("red",)]


def test_tfidf_is_one_result_on_both_paths(spark, monkeypatch):
    """Lookup inside the row and join with the vocabulary; pieces of one word; a long row, null words, two rows of one key."""
    texts = [(1, "aa bb aa bb cc"), (2, "bb cc"), (2, "bb cc"), (3, None), (4, "dd " * 3000), (5, "")]
    docs = spark.createDataFrame(texts, "id int, text string")
    near = sorted((r["id"], r["term"], r["weight"]) for r in features.tfidf(docs.filter("id <> 2"), "id", "text", None).collect())
    monkeypatch.setattr(features, "VOCABULARY_BYTES", 0)
    monkeypatch.setattr(features, "WORDS_AT_ONCE", 1)
    far = sorted((r["id"], r["term"], r["weight"]) for r in features.tfidf(docs.filter("id <> 2"), "id", "text", None).collect())
    assert [x[:2] for x in near] == [x[:2] for x in far] and np.allclose([x[2] for x in near], [x[2] for x in far])
    words = F.split("text", " ")
    counts = features.term_counts(docs.filter("id < 4"), "id", words, bigrams=True)
    expected = [(1, "aa", 2), (1, "aa bb", 2), (1, "bb", 2), (1, "bb aa", 1), (1, "bb cc", 1), (1, "cc", 1)]
    assert rows(counts) == expected + sorted([(2, "bb", 1), (2, "bb cc", 1), (2, "cc", 1)] * 2)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    totals = {r["term"]: (r["cf"], r["df"]) for r in features.term_totals(counts).collect()}
    assert totals["bb"] == (4, 3) and totals["bb aa"] == (1, 1)
    assert features.tfidf(docs.limit(0), "id", "text").count() == 0


def test_chi2_counts_absent_pairs(spark):
    weights = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (2, "b", 2.0), (3, "b", 1.0)], "id int, term string, weight double")
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, None)], "id int, label string")
    # P(x)=2/3, P(y)=1/3; a: o(x)=2, o(y)=1, total 2; b: o(x)=2, o(y)=2, total 3
    expected = {"a": (2 - 4 / 3) ** 2 / (4 / 3) + (1 - 2 / 3) ** 2 / (2 / 3), "b": 0.0 + 1.0}
    assert dict(rows(features.chi2_scores(weights, labels, "id"))) == pytest.approx(expected)
    absent = spark.createDataFrame([(1, "c", 3.0), (2, "d", 1.0)], "id int, term string, weight double")
    none = spark.createDataFrame([(1, None), (2, "x")], "id int, label string")
    assert dict(rows(features.chi2_scores(absent, none, "id"))) == pytest.approx({"c": 1.5, "d": 0.5})


def test_search_ranks_by_cosine(spark, monkeypatch):
    docs = spark.createDataFrame([
        (1, "The quick brown fox jumps over the lazy dog."), (2, "Never jump over the lazy dog quickly."),
        (3, "A fast brown fox leaps over a sleepy dog."),
    ], "id int, text string")
    queries = spark.createDataFrame([(10, "fox jumps over dog"), (11, "zebra")], "qid int, text string")
    from marquee.functions.text import word_tokens

    words = word_tokens(F.col("text"), [])
    monkeypatch.setattr(search, "block_rows", lambda *a: 1)
    monkeypatch.setattr(runtime, "HOT_ROWS", 2)
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        found = search.tfidf_search(docs, queries, "id", "qid", words, words, 2).collect()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert [(r["qid"], r["id"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(10, 1, 1), (10, 3, 2)]


def test_split_shares(spark):
    parts = spark.range(20_000).select(features.split_column("id", [("test", 0.1), ("validation", 0.1), ("train", 0.8)]).alias("p"))
    counts = {r["p"]: r["count"] for r in parts.groupBy("p").count().collect()}
    assert sum(counts.values()) == 20_000 and abs(counts["test"] - 2000) < 200 and abs(counts["validation"] - 2000) < 200


# ---------------------------------------------------------------- vectors


def brute(queries, corpus, k, same):
    out = []
    for q, v in queries:
        d = sorted((round(float(((v - w) ** 2).sum()), 9), c) for c, w in corpus if not (same and c == q))
        out += [(q, c, i + 1) for i, (_, c) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("cells", [1, 6])
def test_knn_is_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(vectors, "block_rows", lambda *a: 37)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(5, 4)) * 10
    points = [(i, centres[i % 5] + draw.normal(size=4)) for i in range(300)]
    points += [(300 + i, points[0][1]) for i in range(150)]  # a third of the rows are copies
    table = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in points], "id long, embedding array<double>, label int")
    queries = table.select(F.col("id").alias("qid"), "embedding")
    found = vectors.knn(queries, table, 4, payload=["label"], exclude_self=True, cells=cells)
    assert rows(found.select("qid", "id", "rank")) == brute(points, points, 4, True)
    assert found.filter("label <> id % 3").count() == 0


def test_knn_ranks_small_vectors_and_leaves_out_broken_ones(spark):
    table = spark.createDataFrame(
        [(1, [3e-6, 0.0]), (2, [0.0, 2e-6]), (3, [1e-6, 0.0]), (4, None), (5, []), (6, [None, 1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1e-6, 1e-7]), (1, None)], "qid long, embedding array<double>")
    for cells in (1, 2):
        found = vectors.knn(queries, table, 2, cells=cells).collect()
        assert sorted((r["qid"], r["id"], r["rank"]) for r in found) == [(0, 1, 2), (0, 3, 1)]
        assert min(r["d2"] for r in found) == pytest.approx(1e-14)
    with pytest.raises(ValueError):
        vectors.knn(queries, spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), 1)


def test_knn_computes_each_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        seen.add(len(texts))
        return np.array([[float(len(t)), 1.0] for t in texts])

    table = vectors.embed(spark.createDataFrame([(i, "a" * i) for i in range(40)], "id long, text string"), "text", encode)
    asked = spark.createDataFrame([(0, [3.0, 1.0])], "qid long, embedding array<double>")
    assert [r["id"] for r in vectors.knn(asked, table, 1, cells=3).collect()] == [3] and seen.value == 40


def test_knn_prunes_cells(spark):
    draw = np.random.default_rng(2)
    table = spark.createDataFrame([(i, (draw.normal(size=2) + 50 * (i % 4)).tolist()) for i in range(200)], "id long, v array<double>")
    pivots = np.array([[0.0, 0], [50, 50], [100, 100], [150, 150]])
    visits = vectors._visits(table.select(F.col("id").alias("qid"), "v"), vectors._place(table, pivots), pivots, 3)
    assert visits.count() == 200


def test_knn_with_few_rows(spark):
    table = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, embedding array<double>")
    found = vectors.with_similarity(vectors.knn(table.withColumnRenamed("id", "qid"), table, 5))
    assert rows(found.select("qid", "id", "d2", "similarity_score")) == [(1, 1, 0.0, 1.0), (1, 2, 9.0, 0.91), (2, 1, 9.0, 0.91), (2, 2, 0.0, 1.0)]
    assert vectors.knn(table.withColumnRenamed("id", "qid"), table.limit(0), 5).count() == 0
    assert vectors.above(found, 0).count() == vectors.above(found, None).count() == 4 and vectors.above(found, 0.95).count() == 2


def test_label_vote(spark):
    near = spark.createDataFrame([
        (1, "Sci-Fi", 0.9), (1, "Adventure", 0.9), (1, "Sci-Fi", 0.8), (1, "Action", 0.8), (1, "Adventure", 0.7),
    ], "qid int, label string, similarity_score double")
    found = {r["label"]: round(r["score"], 6) for r in vectors.label_vote(near).collect()}
    assert found == {"Sci-Fi": 1.7, "Adventure": 1.6}


def test_centroids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 2.0]), ("b", [0.0, 4.0]), ("c", [1.0, 1.0])], "l string, v array<double>")
    means = vectors.centroids(df, "l", "v", 2)
    assert rows(means.select("label", "n")) == [("a", 2), ("b", 2)]
    cosines = {(r["label"], r["other"]): round(r["cosine"], 6) for r in vectors.centroid_cosines(means).collect()}
    assert cosines == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.707107, ("b", "a"): 0.707107}


def test_embed_in_batches(spark):
    df = spark.createDataFrame([(i, f"word{i} same") for i in range(70)] + [(70, None), (71, " ")], "id int, t string")
    sizes = []

    found = vectors.embed(df, "t", vectors.hashed_encoder(16), 8).collect()
    norms = {r["id"]: round(sum(x * x for x in r["embedding"]), 6) for r in found}
    assert norms[70] == norms[71] == 0.0 and all(norms[i] in (0.0, 1.0) for i in range(70)) and not sizes
    assert vectors.hashed_encoder(16)(["a b"]).tolist() == vectors.hashed_encoder(16)(["A  b "]).tolist()


# ---------------------------------------------------------------- scores


def test_scores_of_the_evaluation_fixture(spark):
    truth = spark.createDataFrame([(1, "Sci-Fi"), (1, "Adventure"), (2, "Action"), (2, "Thriller")], "id int, label string")
    guess = spark.createDataFrame([(i, l) for i in (1, 2) for l in ("Sci-Fi", "Adventure")] + [(2, "Elsewhere")], "id int, label string")
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    counts = scoring.confusion(truth, guess, ids, "id")
    assert rows(counts) == [("Action", 1, 0, 1, 0), ("Adventure", 0, 1, 0, 1), ("Sci-Fi", 0, 1, 0, 1), ("Thriller", 1, 0, 1, 0)]
    metrics = scoring.multilabel_metrics(counts).first()
    assert tuple(metrics) == pytest.approx((0.5, 1 / 3, 1 / 3, 0.5))
    assert {r["label"]: r["f1"] for r in scoring.class_report(counts).collect()}["Sci-Fi"] == pytest.approx(2 / 3)
    assert scoring.subset_accuracy(truth, guess, ids, "id").first()[0] == 0.5


def test_auc_with_ties_and_many_scores(spark):
    draw = np.random.default_rng(5)
    score = np.round(draw.random(3000), 2) + (draw.random(3000) < 0.3) * draw.random(3000)
    truth = (draw.random(3000) < score / 2).astype(int)
    df = spark.createDataFrame([("x", float(s), int(t)) for s, t in zip(score, truth)] + [("one", 0.5, 1)], "label string, score double, truth int")
    won = np.mean([(s > score[truth == 0]).mean() + (s == score[truth == 0]).mean() / 2 for s in score[truth == 1]])
    found = dict(rows(scoring.auc_by_label(df)))
    assert found["x"] == pytest.approx(won) and found["one"] is None
    points = scoring.roc_points(df).filter("label = 'x'").orderBy(F.desc("score")).collect()
    assert points[-1]["fpr"] == points[-1]["tpr"] == 1.0
    assert all(a["fp"] <= b["fp"] and a["tp"] <= b["tp"] for a, b in zip(points, points[1:]))


def test_votes(spark):
    scores = spark.createDataFrame([(1, "x", "a", 0.8), (1, "x", "b", 0.2), (2, "x", "a", 1.0), (2, "x", "b", 1.0)], "id int, label string, model string, score double")
    found = {r["id"]: (round(r["score"], 6), r["vote"]) for r in scoring.soft_vote(scores, {"a": 1, "b": 1}, "id").collect()}
    assert found == {1: (0.5, 0), 2: (1.0, 1)}
    first = spark.createDataFrame([(1, "p"), (1, "q")], "id int, label string")
    second = spark.createDataFrame([(1, "q"), (1, "r")], "id int, label string")
    mixed = {r["label"]: round(r["score"], 6) for r in scoring.hybrid_labels(first, second, "id", 0.4, 0.6).collect()}
    assert mixed == {"q": 1.0, "r": 0.6}
    assert scoring.hybrid_labels(first, None, "id").count() == 2
    by = {m: rows(scoring.predicted_by(m, first, second, "id")) for m in ("vector", "ml", "hybrid")}
    assert by == {"vector": [(1, "p"), (1, "q")], "ml": [(1, "q"), (1, "r")], "hybrid": [(1, "p"), (1, "q"), (1, "r")]}
    with pytest.raises(ValueError, match="unknown method"):
        scoring.predicted_by("guess", first, second, "id")
    hard = spark.createDataFrame([(1, "a", 0.5, 0), (1, "b", 0.4, 1), (1, "c", None, 1)], "id int, label string, score double, prediction int")
    assert [r["label"] for r in scoring.threshold_labels(hard).orderBy("label").collect()] == ["a", "c"]


def test_leaderboard_and_importances(spark):
    values = [("a", 0.7, 0.3), ("b", 0.8, 0.2), ("c", 0.8, 0.1)]
    metrics = spark.createDataFrame([
        (i, m, name, v) for i, (m, f, h) in enumerate(values)
        for name, v in zip(scoring.METRICS, (f, f, f, h))
    ], "position int, model string, metric string, value double")
    order = lambda df: [r["model"] for r in df.orderBy("rank").collect()]
    assert order(scoring.leaderboard(metrics)) == ["b", "c", "a"]
    assert order(scoring.leaderboard(metrics, "hamming_loss")) == ["c", "b", "a"]
    imps = spark.createDataFrame([("m", "x", 4.0), ("m", "y", 2.0), ("n", "y", 1.0), ("z", "x", 0.0)], "model string, feature string, importance double")
    found = scoring.merge_importances(imps, ["m", "n", "z"]).collect()
    assert [(r["feature"], r["average_importance"]) for r in found] == [("y", 0.75), ("x", 0.5)]
