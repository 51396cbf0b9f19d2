"""Nearest neighbours, neighbour votes, centroids, scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import entities, scoring, vectors
from marquee.plans.common import query
from marquee.sources.readers import table

DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def near_sql(k: int) -> str:
    """CTE n(qid, id, label, d2, rank): the k nearest other rows of every row."""
    return f"""
    n AS (SELECT a.vec_id AS qid, b.vec_id AS id, b.label, round({DIST}, 9) AS d2,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DIST}, 9), b.vec_id) AS rank
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= {k})
    """


def neighbours(spark, folder, k):
    """Every row against all others."""
    rows = table(spark, folder, "embeddings")
    found = vectors.knn(
        rows.select(F.col("vec_id").alias("qid"), "embedding"), rows.select(F.col("vec_id").alias("id"), "embedding", "label"),
        k, payload=["label"], exclude_self=True, digits=9,
    )
    return vectors.with_similarity(found)


@query(f"""
    WITH {near_sql(5)} SELECT qid, id, round(d2, 6) AS d2, round(1 - d2 / 100, 6) AS similarity_score,
    round(1 - d2 / 2, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM n
""")
def knn_l2(spark, folder):
    near = neighbours(spark, folder, 5)
    return near.select(
        "qid", "id", F.round("d2", 6).alias("d2"), F.round("similarity_score", 6).alias("similarity_score"),
        F.round("cosine", 6).alias("cosine"), "rank",
    )


@query(f"WITH {near_sql(10)} SELECT qid, id, CAST(rank AS INTEGER) AS rank FROM n WHERE 1 - d2 / 2 >= 0.3")
def knn_threshold(spark, folder):
    return vectors.above(neighbours(spark, folder, 10), 0.3, "cosine").select("qid", "id", "rank")


@query(f"""
    WITH {near_sql(15)}, kept AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank
    FROM n WHERE contains('genre ' || label, '1') OR contains('genre ' || label, '7')) SELECT * FROM kept WHERE rank <= 5
""")
def knn_overfetch_filter(spark, folder):
    """Three times the wanted rows, filtered by entities after ranking, cut to the wanted number."""
    near = neighbours(spark, folder, 15)
    genre = F.concat(F.lit("genre "), F.col("label").cast("string"))
    hit = text.matches_entities(genre, F.array(F.lit("1"), F.lit("7")))
    return vectors.cut_to(near.filter(hit), 5).select("qid", "id", "rank")


@query(f"""
    WITH {near_sql(10)} SELECT qid, id, CAST(rank AS INTEGER) AS rank FROM n JOIN embeddings q ON q.vec_id = n.qid
    WHERE rank <= least(greatest(q.label * 2 - 3, 1), 10)
""")
def knn_bounded_k(spark, folder):
    """Each query asks for its own number of rows, kept between 1 and 10."""
    near = neighbours(spark, folder, 10)
    asked = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("qid"), vectors.bounded_k(F.col("label") * 2 - 3).alias("k")
    )
    return near.join(asked, "qid").filter("rank <= k").select("qid", "id", "rank")


@query(f"""
    WITH {near_sql(3)} SELECT qid, '[' || string_agg('{{"id":' || id || ',"label":' || label || '}}', ',' ORDER BY rank) || ']' AS context
    FROM n GROUP BY qid
""")
def context_rows(spark, folder):
    return vectors.context_json(neighbours(spark, folder, 3), "qid", ["id", "label"])


VOTE_SQL = f"""
    {near_sql(5)},
    v AS (SELECT qid, label, sum(1 - d2 / 100) AS score FROM n GROUP BY 1, 2),
    vote AS (SELECT qid, label, score FROM v QUALIFY score >= 0.5 * max(score) OVER (PARTITION BY qid))
"""


@query(f"WITH {VOTE_SQL} SELECT qid, label, round(score, 6) AS score FROM vote")
def knn_label_vote(spark, folder):
    return vectors.label_vote(neighbours(spark, folder, 5)).select("qid", "label", F.round("score", 6).alias("score"))


# The second predictor of the hybrid: the label of the nearest row alone.
HYBRID_SQL = f"""
    {VOTE_SQL}, second AS (SELECT qid, label FROM n WHERE rank = 1),
    both_ AS (SELECT qid, label, 0.4::DOUBLE AS w FROM vote UNION ALL SELECT qid, label, 0.6::DOUBLE FROM second),
    hybrid AS (SELECT qid, label, sum(w) AS score FROM both_ GROUP BY 1, 2 HAVING sum(w) >= 0.5)
"""


@query(f"WITH {HYBRID_SQL} SELECT qid, label, round(score, 6) AS score FROM hybrid")
def hybrid_labels(spark, folder):
    near = neighbours(spark, folder, 5)
    mixed = scoring.hybrid_labels(vectors.label_vote(near), near.filter("rank = 1"), "qid", 0.4, 0.6)
    return mixed.select("qid", "label", F.round("score", 6).alias("score"))


@query(f"""
    WITH {VOTE_SQL} SELECT e.vec_id, e.label, coalesce(string_agg(CAST(vote.label AS VARCHAR), '|' ORDER BY vote.label), '') AS predicted
    FROM embeddings e LEFT JOIN vote ON e.vec_id = vote.qid GROUP BY 1, 2
""")
def predicted_beside(spark, folder):
    """Predicted labels beside the original one."""
    votes = vectors.label_vote(neighbours(spark, folder, 5)).groupBy(F.col("qid").alias("vec_id")).agg(
        F.sort_array(F.collect_list("label")).alias("p"))
    rows = table(spark, folder, "embeddings").select("vec_id", "label").join(votes, "vec_id", "left")
    names = F.transform("p", lambda x: x.cast("string"))
    return rows.select("vec_id", "label", F.coalesce(F.array_join(names, "|"), F.lit("")).alias("predicted"))


# ---------------------------------------------------------------- centroids

CENTROID_SQL = """
    x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    c AS (SELECT label, pos, avg(v) AS v FROM x WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1, 2)
"""


@query(f"""
    WITH {CENTROID_SQL} SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(v, 6) AS value FROM c
""")
def label_centroids(spark, folder):
    means = vectors.centroids(table(spark, folder, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("value"))


@query(f"""
    WITH {CENTROID_SQL}, u AS (SELECT label, pos, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM c)
    SELECT a.label, b.label AS other, round(sum(a.v * b.v), 6) AS cosine FROM u a JOIN u b ON a.pos = b.pos GROUP BY 1, 2
""")
def centroid_cosine(spark, folder):
    means = vectors.centroids(table(spark, folder, "embeddings"), "label", "embedding")
    return vectors.centroid_cosines(means).select("label", "other", F.round("cosine", 6).alias("cosine"))


# ---------------------------------------------------------------- scores of the neighbour vote

CONFUSION_SQL = f"""
    {VOTE_SQL},
    o AS (SELECT coalesce(e.vec_id, v.qid) AS id, coalesce(e.label, v.label) AS label, CAST(e.vec_id IS NOT NULL AS INT) AS t,
          CAST(v.qid IS NOT NULL AS INT) AS p FROM embeddings e FULL JOIN vote v ON e.vec_id = v.qid AND e.label = v.label),
    cf AS (SELECT label, (SELECT count(*) FROM embeddings) - count(*) AS tn, count(*) FILTER (p = 1 AND t = 0) AS fp,
           count(*) FILTER (p = 0 AND t = 1) AS fn, count(*) FILTER (p = 1 AND t = 1) AS tp FROM o GROUP BY 1)
"""


def _scored(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    return rows, vectors.label_vote(neighbours(spark, folder, 5))


def vote_confusion(spark, folder):
    truth, votes = _scored(spark, folder)
    return scoring.confusion(truth, votes, truth, "qid")


@query(f"WITH {CONFUSION_SQL} SELECT * FROM cf")
def confusion(spark, folder):
    return vote_confusion(spark, folder)


F1_SQL = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"


@query(f"""
    WITH {CONFUSION_SQL} SELECT round(2.0 * sum(tp)::DOUBLE / sum(2 * tp + fp + fn), 6) AS f1_micro, round(avg({F1_SQL}), 6) AS f1_macro,
    round(sum({F1_SQL} * (tp + fn)) / sum(tp + fn), 6) AS f1_weighted, round(sum(fp + fn)::DOUBLE / sum(tn + fp + fn + tp), 6) AS hamming_loss
    FROM cf
""")
def multilabel_metrics(spark, folder):
    found = scoring.multilabel_metrics(vote_confusion(spark, folder))
    return found.select(*[F.round(c, 6).alias(c) for c in scoring.METRICS])


@query(f"""
    WITH {CONFUSION_SQL} SELECT label, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS "precision",
    round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({F1_SQL}::DOUBLE, 6) AS f1, tp + fn AS support FROM cf
""")
def class_report(spark, folder):
    found = scoring.class_report(vote_confusion(spark, folder))
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""
    WITH {CONFUSION_SQL} SELECT round(1 - count(DISTINCT id)::DOUBLE / (SELECT count(*) FROM embeddings), 6) AS subset_accuracy
    FROM o WHERE t <> p
""")
def subset_accuracy(spark, folder):
    truth, votes = _scored(spark, folder)
    return scoring.subset_accuracy(truth, votes, truth, "qid").select(F.round("subset_accuracy", 6).alias("subset_accuracy"))


# ---------------------------------------------------------------- ROC

# Score of a document for a label: shares of two letters, which have many ties and distinct values.
ROC_SQL = """
    s AS (SELECT 'quality' AS label, (n_chars // 10) / 100.0::DOUBLE AS score, quality AS truth FROM labels l JOIN documents d ON l.doc_id = d.doc_id
          UNION ALL SELECT 'toxic', (n_chars % 97) / 97.0::DOUBLE, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def _label_scores(spark, folder):
    rated = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    cells = F.array(
        F.struct(F.lit("quality").alias("label"), (F.floor(F.col("n_chars") / 10) / 100.0).cast("double").alias("score"), F.col("quality").alias("truth")),
        F.struct(F.lit("toxic").alias("label"), (F.col("n_chars") % 97 / 97.0).cast("double").alias("score"), F.col("toxic").alias("truth")),
    )
    return rated.select(F.inline(cells))


@query(f"""
    WITH {ROC_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS r FROM s)
    SELECT label, round((sum(r) FILTER (truth = 1) - sum(truth) * (sum(truth) + 1) / 2.0) / (sum(truth)::DOUBLE * sum(1 - truth)), 6) AS auc
    FROM r GROUP BY 1
""")
def auc_by_label(spark, folder):
    found = scoring.top_labels_by_auc(scoring.auc_by_label(_label_scores(spark, folder)), 5)
    return found.select("label", F.round("auc", 6).alias("auc"))


@query(f"""
    WITH {ROC_SQL}, d AS (SELECT label, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM s GROUP BY 1, 2),
    c AS (SELECT label, score, sum(neg) OVER w AS fp, sum(pos) OVER w AS tp, sum(neg) OVER (PARTITION BY label) AS an,
          sum(pos) OVER (PARTITION BY label) AS ap FROM d WINDOW w AS (PARTITION BY label ORDER BY score DESC))
    SELECT label, score, round(fp::DOUBLE / an, 6) AS fpr, round(tp::DOUBLE / ap, 6) AS tpr FROM c
""")
def roc_points(spark, folder):
    found = scoring.roc_points(_label_scores(spark, folder))
    return found.select("label", "score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


# ---------------------------------------------------------------- models side by side

MODEL_SCORES_SQL = """
    s AS (SELECT doc_id, label, model, score FROM (
        SELECT doc_id, 'quality' AS label, 'long' AS model, least(n_chars / 4000.0, 1)::DOUBLE AS score FROM documents
        UNION ALL SELECT doc_id, 'quality', 'source', (ascii(right(source, 1)) - 48) / 10.0::DOUBLE FROM documents
        UNION ALL SELECT doc_id, 'quality', 'lang', CASE WHEN lang = 'en' THEN 0.9 ELSE 0.2 END FROM documents))
"""
VOTE_WEIGHTS = {"long": 2.0, "source": 1.0, "lang": 1.0}


def _model_scores(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    cell = lambda model, score: F.struct(F.lit("quality").alias("label"), F.lit(model).alias("model"), score.cast("double").alias("score"))
    return docs.select("doc_id", F.inline(F.array(
        cell("long", F.least(F.col("n_chars") / 4000.0, F.lit(1.0))),
        cell("source", (F.ascii(F.right("source", F.lit(1))) - 48) / 10.0),
        cell("lang", F.when(F.col("lang") == "en", 0.9).otherwise(0.2)),
    )))


@query(f"""
    WITH {MODEL_SCORES_SQL}, v AS (SELECT doc_id, label, sum(score * CASE model WHEN 'long' THEN 0.5 ELSE 0.25 END) AS score FROM s GROUP BY 1, 2)
    SELECT doc_id, label, round(score::DOUBLE, 6) AS score, CAST(score > 0.5 AS INTEGER) AS vote FROM v
""")
def soft_vote(spark, folder):
    found = scoring.soft_vote(_model_scores(spark, folder), VOTE_WEIGHTS, "doc_id")
    return found.select("doc_id", "label", F.round("score", 6).alias("score"), "vote")


@query(f"WITH {MODEL_SCORES_SQL} SELECT doc_id, label, model FROM s WHERE score >= 0.5")
def threshold_labels(spark, folder):
    scores = _model_scores(spark, folder).withColumn("prediction", F.lit(0))
    return scoring.threshold_labels(scores, 0.5).select("doc_id", "label", "model")


METRIC_ROWS_SQL = f"""
    {MODEL_SCORES_SQL},
    j AS (SELECT s.model, CAST(s.score >= 0.5 AS INT) AS p, l.quality AS t FROM s JOIN labels l ON s.doc_id = l.doc_id),
    m AS (SELECT model, count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p <> t) AS wrong, count(*) AS n FROM j GROUP BY 1),
    wide AS (SELECT CASE model WHEN 'long' THEN 0 WHEN 'source' THEN 1 ELSE 2 END AS position, model,
             round(2.0 * tp::DOUBLE / (2 * tp + wrong), 6) AS f1, round(wrong::DOUBLE / n, 6) AS hamming_loss FROM m)
"""


def _model_metrics(spark, folder):
    """Scores of the three fixed scorers against the quality label, one row per model."""
    rated = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("t"))
    guess = (F.col("score") >= 0.5).cast("int")
    rows = _model_scores(spark, folder).join(rated, "doc_id").select("model", guess.alias("p"), "t")
    counted = rows.groupBy("model").agg(
        F.count_if(F.expr("p = 1 AND t = 1")).alias("tp"), F.count_if(F.expr("p = 1 AND t = 0")).alias("fp"),
        F.count_if(F.expr("p = 0 AND t = 1")).alias("fn"), F.count(F.lit(1)).alias("n"),
    )
    position = F.when(F.col("model") == "long", 0).when(F.col("model") == "source", 1).otherwise(2)
    f1 = F.round(scoring.f1(), 6)
    return counted.select(
        position.alias("position"), "model", f1.alias("f1_micro"), f1.alias("f1_macro"), f1.alias("f1_weighted"),
        F.round((F.col("fp") + F.col("fn")) / F.col("n"), 6).alias("hamming_loss"),
    )


@query(f"""
    WITH {METRIC_ROWS_SQL} SELECT position, model, f1 AS f1_micro, f1 AS f1_macro, f1 AS f1_weighted, hamming_loss,
    CAST(row_number() OVER (ORDER BY f1 DESC, position) AS INTEGER) AS rank FROM wide
""")
def leaderboard(spark, folder):
    rows = scoring.metrics_long(_model_metrics(spark, folder), ["position", "model"], scoring.METRICS)
    return scoring.leaderboard(rows)


@query(f"""
    WITH {METRIC_ROWS_SQL} SELECT model, 'f1_micro' AS metric, f1 AS value FROM wide
    UNION ALL SELECT model, 'hamming_loss', hamming_loss FROM wide
""")
def metrics_long(spark, folder):
    wide = _model_metrics(spark, folder).select("model", "f1_micro", "hamming_loss")
    return scoring.metrics_long(wide, ["model"], ["f1_micro", "hamming_loss"])


LABEL_MODELS = [f"label_{i}" for i in range(10)]
IMPORTANCE_SQL = f"""
    {CENTROID_SQL}, i AS (SELECT 'label_' || label AS model, 'x' || lpad(CAST(pos - 1 AS VARCHAR), 2, '0') AS feature,
    round(abs(v), 9) AS importance FROM c),
    top AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) <= 20),
    sh AS (SELECT *, importance / max(importance) OVER (PARTITION BY model) AS s FROM top)
"""


@query(f"""
    WITH {IMPORTANCE_SQL}
    SELECT feature, {", ".join(f"round(coalesce(max(s) FILTER (model = '{m}'), 0), 6) AS {m}" for m in LABEL_MODELS)},
           round(sum(s) / {len(LABEL_MODELS)}, 6) AS average_importance
    FROM sh GROUP BY 1 ORDER BY sum(s) / {len(LABEL_MODELS)} DESC, feature LIMIT 20
""")
def importance_merge(spark, folder):
    """Feature importance of all labels: how far each label's mean vector leans to each dimension."""
    means = vectors.centroids(table(spark, folder, "embeddings"), "label", "embedding")
    rows = means.select(F.concat(F.lit("label_"), "label").alias("model"), F.posexplode("centroid").alias("pos", "v")).select(
        "model", F.concat(F.lit("x"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("feature"),
        F.round(F.abs("v"), 9).alias("importance"))
    found = scoring.merge_importances(rows, LABEL_MODELS)
    return found.select("feature", *[F.round(c, 6).alias(c) for c in (*LABEL_MODELS, "average_importance")])


# ---------------------------------------------------------------- text vectors

DIM = 64


@query(rf"""
    WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \t\n\r\f\v]+')) AS word FROM documents),
    h AS (SELECT doc_id, md5(word) AS m FROM w WHERE word <> ''),
    c AS (SELECT doc_id, CAST(('0x' || substring(m, 1, 8))::BIGINT % {DIM} AS INTEGER) AS pos,
          sum(CASE WHEN ('0x' || substring(m, 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY 1, 2)
    SELECT doc_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM c
    QUALIFY v <> 0
""")
def text_embed(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = vectors.embed(docs, "text", vectors.hashed_encoder(DIM)).select("doc_id", F.posexplode("embedding").alias("pos", "v"))
    return rows.filter("v <> 0").select("doc_id", "pos", F.round("v", 6).alias("value"))


HASHED_SQL = rf"""
    hw AS (SELECT doc_id, 'd' AS kind, unnest(string_split_regex(lower(text), '[ \t\n\r\f\v]+')) AS word FROM documents
           UNION ALL SELECT item_id, 'q', unnest(string_split_regex(lower(text), '[ \t\n\r\f\v]+')) FROM asks),
    hm AS (SELECT doc_id, kind, md5(word) AS m FROM hw WHERE word <> ''),
    hc AS (SELECT doc_id, kind, ('0x' || substring(m, 1, 8))::BIGINT % {DIM} AS pos,
           sum(CASE WHEN ('0x' || substring(m, 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE AS v FROM hm GROUP BY 1, 2, 3),
    hv AS (SELECT doc_id, kind, pos, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, kind)) AS v FROM hc QUALIFY v <> 0)
"""


@query(f"""
    WITH asks AS (SELECT item_id, 'src' || item_id % 20 AS source, 'Find en texts by src' || item_id % 20 || ' like ' || text AS text FROM benchmark),
    {HASHED_SQL},
    dots AS (SELECT q.doc_id AS item_id, d.doc_id, sum(q.v * d.v) AS dot FROM hv q JOIN hv d ON q.pos = d.pos AND q.kind = 'q' AND d.kind = 'd' GROUP BY 1, 2),
    near AS (SELECT item_id, doc_id, round(greatest(2 - 2 * dot, 0), 9) AS d2,
             row_number() OVER (PARTITION BY item_id ORDER BY round(greatest(2 - 2 * dot, 0), 9), doc_id) AS rank FROM dots QUALIFY rank <= 15),
    kept AS (SELECT n.item_id, n.doc_id, n.d2, CAST(row_number() OVER (PARTITION BY n.item_id ORDER BY n.rank) AS INTEGER) AS rank
             FROM near n JOIN documents d USING (doc_id) JOIN asks a USING (item_id)
             WHERE contains(lower(d.source), a.source) AND contains(lower(d.lang), 'en'))
    SELECT item_id, doc_id, round(1 - d2 / 100, 6) AS similarity_score, rank FROM kept WHERE rank <= 5
""")
def entity_search(spark, folder):
    """Text queries from end to end: entities tagged, vectors made, 3k neighbours, entity filter, cut to k."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    asks = table(spark, folder, "benchmark").select("item_id", F.concat(
        F.lit("Find en texts by src"), (F.col("item_id") % 20).cast("string"), F.lit(" like "), "text").alias("text"))
    names = docs.select(F.lit("DIRECTOR").alias("label"), F.col("source").alias("entity")).distinct().unionByName(
        docs.select(F.lit("GENRE").alias("label"), F.col("lang").alias("entity")).distinct())
    found = entities.grouped_entities(entities.tag(asks, "item_id", "text", names), "item_id")
    encode = vectors.hashed_encoder(DIM)
    corpus = vectors.embed(docs, "text", encode).select(F.col("doc_id").alias("id"), "embedding", "source", "lang")
    queries = vectors.embed(asks, "text", encode).select(F.col("item_id").alias("qid"), "embedding")
    near = vectors.with_similarity(vectors.knn(queries, corpus, 15, payload=["source", "lang"], digits=9))
    wanted = near.join(found, near.qid == found.item_id).filter(
        text.matches_entities(F.col("source"), F.array_distinct("DIRECTOR"))
        & text.matches_entities(F.col("lang"), F.array_distinct("GENRE")))
    best = vectors.cut_to(wanted, 5)
    return best.select("item_id", F.col("id").alias("doc_id"), F.round("similarity_score", 6).alias("similarity_score"), "rank")
