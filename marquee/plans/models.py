"""Fitted models: evaluation, search, importance, projection."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marquee.operators import hybrid, importance, models, scoring
from marquee.operators.features import split_column
from marquee.plans.common import query
from marquee.plans.vectors import DIST, F1_SQL
from marquee.runtime import write_once
from marquee.sources.readers import table

LABELS = ["quality", "toxic"]


def _prepared(spark, folder, max_features=300, keep=100):
    """Rated documents with their fitted features, split 80/20."""
    rated = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    features = models.fit_features(rated, "doc_id", "text", "lang", LABELS, max_features, keep, 2, 0.9)
    rows = features.model.transform(rated).select("doc_id", *LABELS, "features")
    rows = write_once(rows.withColumn("part", split_column("doc_id", [("train", 0.8), ("test", 0.2)])))
    return features, rows.filter("part = 'train'"), rows.filter("part = 'test'")


@query()
def train_eval_models(spark, folder):
    """Leaderboard of seven model families over the rated documents."""
    features, train, test = _prepared(spark, folder)
    run = models.evaluate_models(train, test, "doc_id", LABELS, models.families(len(features.names)))
    metrics = spark.createDataFrame(run.metrics, "position int, model string, metric string, value double")
    return scoring.leaderboard(metrics)


@query()
def predict_labels(spark, folder):
    """Labels of every document by logistic regression fitted on the rated ones."""
    features, train, _ = _prepared(spark, folder)
    fitted = models.fit_per_label(train, LABELS, models.families(len(features.names))["logistic_regression"])
    everything = features.model.transform(table(spark, folder, "documents"))
    scores = models.predict_per_label(everything, fitted, "doc_id")
    chosen = scoring.threshold_labels(scores, 0.5)
    return chosen.select("doc_id", "label", F.round("score", 4).alias("score"))


@query()
def tune_model(spark, folder):
    """Ten drawn parameter sets of logistic regression, three folds each."""
    _, train, _ = _prepared(spark, folder)
    base = LogisticRegression(maxIter=30, featuresCol="features", labelCol="target")
    grid = {base.regParam: [0.001, 0.01, 0.1, 1.0], base.elasticNetParam: [0.0, 0.5, 1.0]}
    found, tried = models.tune(train, "doc_id", "quality", base, grid, draws=10, folds=3)
    results = [
        (i, float(p[base.regParam]), float(p[base.elasticNetParam]), float(m))
        for i, (p, m) in enumerate(zip(tried, found.avgMetrics))
    ]
    return spark.createDataFrame(results, "draw int, reg_param double, elastic_net double, f1 double").orderBy(F.desc("f1"), "draw")


@query()
def permutation_importance(spark, folder):
    """Direct, above-mean and permutation importance of vector dimensions over all labels."""
    vectors = table(spark, folder, "embeddings")
    labels = [r["label"] for r in vectors.select("label").distinct().filter("label is not null").orderBy("label").collect()]
    rows = write_once(vectors.select(
        "vec_id", *[F.coalesce((F.col("label") == x).cast("int"), F.lit(0)).alias(f"is_{x}") for x in labels],
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    ))
    names = [f"x{i:02d}" for i in range(rows.first()["features"].size)]
    runs = {
        name: models.fit_per_label(rows, [f"is_{x}" for x in labels], models.families(len(names))[name])
        for name in ("logistic_regression", "decision_tree")
    }
    return importance.analyze_importance(spark, runs, names, rows, "vec_id", top_n=10, repeats=2)


@query()
def pca_project(spark, folder):
    """Two principal components of every vector, with the label and the explained shares."""
    out, shares = models.project(table(spark, folder, "embeddings"), "embedding", 2)
    return out.select(
        "vec_id", "label", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"),
        *[F.lit(round(s, 6)).alias(f"share{i + 1}") for i, s in enumerate(shares)],
    )


# Neighbours in the training part, one multinomial naive Bayes a label in closed form, and the labels that either gives
METHODS_SQL = f"""
    e AS (SELECT vec_id, label, embedding, ('0x' || substring(md5('42:' || vec_id), 1, 8))::BIGINT % 10000 < 8000 AS train FROM embeddings),
    t AS (SELECT vec_id, label FROM e WHERE NOT train),
    n AS (SELECT a.vec_id, b.label, round({DIST}, 9) AS d2 FROM e a JOIN e b ON NOT a.train AND b.train
          QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DIST}, 9), b.vec_id) <= 5),
    vote AS (SELECT vec_id, label FROM (SELECT vec_id, label, sum(1 - d2 / 100) AS s FROM n GROUP BY 1, 2)
             QUALIFY s >= 0.5 * max(s) OVER (PARTITION BY vec_id)),
    x AS (SELECT vec_id, label, train, unnest(list_concat(list_transform(embedding, lambda v: greatest(v::DOUBLE, 0)),
                 list_transform(embedding, lambda v: greatest(-v::DOUBLE, 0)))) AS v, generate_subscripts(list_concat(embedding, embedding), 1) AS i FROM e),
    one AS (SELECT label, i, sum(v) AS s FROM x WHERE train AND label IS NOT NULL GROUP BY 1, 2),
    whole AS (SELECT i, sum(v) AS s FROM x WHERE train GROUP BY 1),
    rows_ AS (SELECT label, count(*) AS n, (SELECT count(*) FROM e WHERE train) AS n_all FROM e WHERE train AND label IS NOT NULL GROUP BY 1),
    sums AS (SELECT label, sum(one.s) AS s, sum(whole.s) AS s_all, count(*) AS k FROM one JOIN whole USING (i) GROUP BY 1),
    theta AS (SELECT label, i, ln(one.s + 1) - ln(sums.s + k) - ln(whole.s - one.s + 1) + ln(s_all - sums.s + k) AS w
              FROM one JOIN whole USING (i) JOIN sums USING (label)),
    bayes AS (SELECT x.vec_id, theta.label FROM x JOIN theta USING (i) JOIN rows_ r ON r.label = theta.label WHERE NOT train AND r.n < r.n_all
              GROUP BY x.vec_id, theta.label HAVING sum(v * w) + any_value(ln(r.n + 1) - ln(r.n_all - r.n + 1)) >= 0),
    p AS (SELECT 'vector' AS method, * FROM vote UNION ALL SELECT 'ml', * FROM bayes
          UNION ALL SELECT 'hybrid', * FROM (SELECT * FROM vote UNION SELECT * FROM bayes)),
    m AS (SELECT unnest(['vector', 'ml', 'hybrid']) AS method),
    o AS (SELECT method, label, vec_id, max(p) AS p, max(t) AS t FROM (
            SELECT method, label, vec_id, 1 AS p, 0 AS t FROM p UNION ALL SELECT method, label, vec_id, 0, 1 FROM m, t) GROUP BY 1, 2, 3),
    cf AS (SELECT method, label, count(*) FILTER (p = 1 AND t = 0) AS fp, count(*) FILTER (p = 0 AND t = 1) AS fn, count(*) FILTER (p = 1 AND t = 1) AS tp,
           (SELECT count(*) FROM t) - count(*) AS tn FROM o GROUP BY 1, 2 HAVING sum(t) > 0)
"""


@query(f"""
    WITH {METHODS_SQL} SELECT method, round(2.0 * sum(tp)::DOUBLE / sum(2 * tp + fp + fn), 6) AS f1_micro, round(avg({F1_SQL}), 6) AS f1_macro,
    round(sum({F1_SQL} * (tp + fn)) / sum(tp + fn), 6) AS f1_weighted, round(sum(fp + fn)::DOUBLE / sum(tn + fp + fn + tp), 6) AS hamming_loss
    FROM cf GROUP BY method
""")
def method_scores(spark, folder):
    """Held-out vectors labelled by their neighbours, by naive Bayes and by both, each scored over the whole part."""
    rows = table(spark, folder, "embeddings").withColumn("part", split_column("vec_id", [("train", 0.8), ("test", 0.2)]))
    known, rest = (rows.filter(F.col("part") == p).select("vec_id", "embedding", "label") for p in ("train", "test"))
    make = models.families(0)["multinomial_nb"]
    near = write_once(hybrid.vector_predictions(rest, known, "vec_id", "embedding", "label", 5, digits=9))
    fitted = hybrid.model_predictions(rest, known, "vec_id", hybrid.signed_parts("embedding"), "label", make)
    truth = rest.select("vec_id", "label")
    scores = hybrid.score_methods(truth, truth, "vec_id", near, fitted if fitted is None else write_once(fitted))
    return scores.select("method", *[F.round(m, 6).alias(m) for m in scoring.METRICS])
