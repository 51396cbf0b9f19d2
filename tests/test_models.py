import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from marquee.operators import features, importance, models
from marquee.sources import registry

LABELS = ["x", "y"]


@pytest.fixture(scope="module")
def films(spark):
    draw = np.random.default_rng(0)
    words = ["space", "laser", "love", "kiss", "town", "road", "night"]
    rows = []
    for i in range(160):
        x, y = int(i % 2 == 0), int(i % 3 == 0)
        text = ["space laser"] * x + ["love kiss"] * y + list(draw.choice(words[4:], 4))
        rows.append((i, " ".join(text), ["de", "en", None][i % 3], x, y))
    return spark.createDataFrame(rows, "id int, text string, place string, x int, y int").cache()


@pytest.fixture(scope="module")
def prepared(films):
    fitted = models.fit_features(films, "id", "text", "place", LABELS, 50, 8, 2, 0.9)
    rows = fitted.model.transform(films).select("id", *LABELS, "features").cache()
    return fitted, rows


def test_feature_names_and_weights(spark, films, prepared):
    fitted, rows = prepared
    assert len(fitted.names) == 8 and {"love", "kiss", "love kiss", "loc_de"} <= set(fitted.names)
    whole = models.fit_features(films, "id", "text", None, LABELS, 50, None, 2, 0.9)
    expected = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(films, "id", "text", 50, 2, 0.9).collect()}
    found = {}
    for r in whole.model.transform(films).select("id", vector_to_array("features").alias("v")).collect():
        found.update({(r["id"], n): v for n, v in zip(whole.names, r["v"]) if v})
    assert found == pytest.approx(expected)


def test_chi2_of_columns_matches_long_form(spark, films):
    long = features.tfidf(films, "id", "text", 50, 2, 0.9)
    labels = films.select("id", F.explode_outer(F.array_compact(F.array(*[F.when(F.col(l) == 1, l) for l in LABELS]))).alias("label"))
    expected = {r["term"]: r["chi2"] for r in features.chi2_scores(long, labels, "id").collect()}
    whole = models.fit_features(films, "id", "text", None, LABELS, 50, None, 2, 0.9)
    scores = models.chi2_of_columns(whole.model.transform(films), "features", LABELS)
    assert dict(zip(whole.names, scores)) == pytest.approx(expected)


def test_evaluate_save_and_load(spark, films, prepared, tmp_path):
    fitted, rows = prepared
    train, test = rows.filter("id < 120"), rows.filter("id >= 120")
    chosen = {n: m for n, m in models.families(len(fitted.names)).items() if n in ("logistic_regression", "linear_svm", "decision_tree")}
    run = models.evaluate_models(train, test, "id", LABELS, chosen)
    scores = {(m, n): v for _, m, n, v in run.metrics}
    top = max(scores[(m, "f1_micro")] for m in chosen)
    assert run.best == next(m for m in chosen if scores[(m, "f1_micro")] == top)
    assert run.predictions["linear_svm"].filter("score IS NOT NULL").count() == 0
    root = str(tmp_path / "registry")
    assert registry.safe("Wiki-Films A") == "wiki_films_a"
    registry.save_run(spark, root, run, "Films", fitted.names, LABELS, fitted, test, stamp="20240101_000000")
    registry.save_run(spark, root, run, "Films", fitted.names, LABELS, best_only=True, stamp="20240102_000000")
    saved = registry.saved_runs(spark, root).collect()
    assert [(r["run"], r["best_only"], r["model_count"]) for r in saved] == [
        ("films_best_20240102_000000", True, 1), ("films_20240101_000000", False, 3)]
    assert registry.newest_per_dataset(spark, root).first()["run"] == "films_best_20240102_000000"
    best, info = registry.load_run(spark, root)
    assert list(best.models) == [run.best] and info["labels"] == LABELS
    again, info = registry.load_run(spark, root, "films_20240101_000000")
    assert sorted(again.reports) == sorted(run.reports) and {r[1] for r in best.reports} == {run.best}
    counted = {l: test.filter(F.col(l) == 1).count() for l in LABELS}
    assert {(m, l): s for _, m, l, *_, s in run.reports} == {(m, l): counted[l] for m in chosen for l in LABELS}
    prep = registry.load_features(spark, root)  # the newest run has no features, the one before has
    assert prep.names == info["feature_names"]
    with pytest.raises(ValueError):
        registry.load_features(spark, root, "nothing")
    fresh = prep.model.transform(films.filter("id >= 120"))
    guess = lambda df, ms: sorted(tuple(r) for r in models.predict_per_label(df, ms, "id").select("id", "label", "prediction").collect())
    assert guess(fresh, again.models["decision_tree"]) == guess(test, run.models["decision_tree"])
    with pytest.raises(ValueError):
        registry.load_run(spark, root, "nothing")


def test_all_families_fit(prepared):
    fitted, rows = prepared
    for name, make in models.families(len(fitted.names)).items():
        if name in ("multinomial_nb", "random_forest", "gradient_boosting", "mlp"):
            fits = models.fit_per_label(rows, ["x"], make)
            assert models.predict_per_label(rows, fits, "id").filter("score >= 0.5").count() > 0, name


def test_tune_draws_without_repeats(prepared):
    _, rows = prepared
    base = LogisticRegression(maxIter=5, featuresCol="features", labelCol="target")
    found, tried = models.tune(rows, "id", "x", base, {base.regParam: [0.01, 0.1, 1.0]}, draws=2, folds=2)
    assert len(tried) == 2 and tried[0] != tried[1] and len(found.avgMetrics) == 2


def test_tuning_over_all_labels_sums_counts_and_puts_the_best_back(prepared):
    _, rows = prepared
    make = lambda depth: DecisionTreeClassifier(maxDepth=depth, seed=1, featuresCol="features", labelCol="target")
    run = models.Run(models={"tree": {}})
    tuned = models.tune_labels(rows, "id", LABELS, make, {"depth": [1, 0]}, draws=5, folds=2, run=run, name="tree")
    table = rows.withColumn("fold", models.fold_column("id", 2))
    for _, params, fold, score in tuned.scores:
        tp = wrong = 0
        for label in LABELS:
            data = table.withColumn("target", F.col(label).cast("double"))
            model = make(**params).fit(data.filter(F.col("fold") != fold))
            for r in model.transform(data.filter(F.col("fold") == fold)).select("target", "prediction").collect():
                tp += r["target"] == r["prediction"] == 1
                wrong += r["target"] != r["prediction"]
        assert score == pytest.approx(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
    assert len(tuned.scores) == 4 and tuned.params == {"depth": 1} and run.models["tree"] is tuned.models
    assert set(tuned.models) == set(LABELS) and tuned.models["x"].getMaxDepth() == 1


def test_importance(spark, prepared):
    fitted, rows = prepared
    fits = models.fit_per_label(rows, ["x"], models.families(len(fitted.names))["logistic_regression"])
    drops = {r["feature"]: r["importance"] for r in importance.permutation_importance(rows, "id", "x", "features", fits["x"], fitted.names, 2).collect()}
    assert len(drops) == 8 and drops["kiss"] == pytest.approx(0.0, abs=0.05)
    table = importance.analyze_importance(spark, {"lr": fits}, fitted.names, rows, "id", 3, 1)
    by_method = {}
    for r in table.collect():
        by_method.setdefault(r["method"], []).append(r["importance"])
    assert set(by_method) == {"direct", "above_mean", "permutation"} and len(by_method["direct"]) == 3
    with pytest.raises(ValueError):
        importance.direct_importance(spark, fits, ["a"], 3)


def test_permutation_sees_the_only_useful_feature(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("x"), array_to_vector(F.array(
        (F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double"))).alias("features"))
    fits = models.fit_per_label(df, ["x"], models.families(2)["decision_tree"])
    drops = {r["feature"]: r["importance"] for r in importance.permutation_importance(df, "id", "x", "features", fits["x"], ["a", "b"], 3).collect()}
    assert drops["b"] == 0.0 and 0.3 < drops["a"] < 0.7


def test_projection_is_centred(spark):
    draw = np.random.default_rng(1)
    points = draw.normal(size=(80, 3)) * [5, 1, 0.1] + 100
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, v array<double>")
    out, shares = models.project(df, "v", 2)
    centred = points - points.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    expected = np.abs(centred @ vt[:2].T)
    found = np.abs(np.array([[r["pc1"], r["pc2"]] for r in out.orderBy("id").collect()]))
    assert np.allclose(found, expected, atol=1e-6) and shares == pytest.approx(list((s**2 / (s**2).sum())[:2]))


def test_terms_are_counted_in_small_pieces(spark):
    import pyarrow as pa

    sizes = []
    lists = pa.array([[f"w{i % 7}" for i in range(1000)]] * 700)
    for row, code, tf, terms in features._counted(lists, True):
        sizes.append(int(tf[code < 7].sum()))
    assert sum(sizes) == 700_000 and max(sizes) <= 1 << 17
    df = spark.createDataFrame([(i, "red blue red") for i in range(5)], "id int, text string")
    got = {r["term"]: (r["cf"], r["df"]) for r in features.totals_by_term(df, F.split("text", " "), True).collect()}
    assert got == {"red": (10, 5), "blue": (5, 5), "red blue": (5, 5), "blue red": (5, 5)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"
