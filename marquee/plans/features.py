"""TF-IDF, search, label features, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.fixed_values import STOP_WORDS
from marquee.functions import text
from marquee.operators import features, joins, search
from marquee.plans.common import query, text_list
from marquee.sources.readers import table

WORD_SQL = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}_]{{2,}}')"


def tfidf_sql(max_features: int, min_df: int, max_df: float, source: str = "documents") -> str:
    """CTEs that end in w(doc_id, term, weight)."""
    return f"""
    tok AS (SELECT doc_id, list_filter({WORD_SQL.format('text')}, lambda t: NOT list_contains([{text_list(STOP_WORDS)}], t)) AS t
            FROM {source}),
    terms AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok),
    cnt AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
    vocab AS (SELECT term, count(*) AS df FROM cnt GROUP BY 1
              HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT count(*) FROM {source})
              ORDER BY sum(tf) DESC, term LIMIT {max_features}),
    raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM {source})) / (1 + df)) + 1) AS x
            FROM cnt JOIN vocab USING (term)),
    w AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)
    """


@query(f"WITH {tfidf_sql(300, 5, 0.8)} SELECT doc_id, term, round(weight, 6) AS weight FROM w")
def tfidf_long(spark, folder):
    weights = features.tfidf(table(spark, folder, "documents"), "doc_id", "text", 300, 5, 0.8)
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def search_sql(doc_terms: str, query_terms: str, k: int) -> str:
    return f"""
    WITH d AS (SELECT doc_id, unnest({doc_terms}) AS term FROM documents),
    q AS (SELECT item_id, unnest({query_terms}) AS term FROM benchmark),
    dc AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
    idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dc GROUP BY 1),
    dx AS (SELECT doc_id, term, tf * idf AS x FROM dc JOIN idf USING (term)),
    dw AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM dx),
    qx AS (SELECT item_id, term, count(*) * any_value(idf) AS x FROM q JOIN idf USING (term) GROUP BY 1, 2),
    qw AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM qx),
    s AS (SELECT item_id, doc_id, round(sum(dw.w * qw.w), 9) AS s FROM dw JOIN qw USING (term) GROUP BY 1, 2)
    SELECT item_id, doc_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS INTEGER) AS rank
    FROM s WHERE s > 0 QUALIFY rank <= {k}
    """


PLAIN_WORDS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}')"


@query(search_sql(PLAIN_WORDS, PLAIN_WORDS, 2))
def tfidf_search(spark, folder):
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    words = text.word_tokens(F.col("text"), [])
    found = search.tfidf_search(docs, items, "doc_id", "item_id", words, words, 2, digits=9)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


FIELD_WORDS = (
    f"list_concat(list_transform({PLAIN_WORDS}, lambda t: 'plot:' || t), "
    "['origin:' || lang, 'director:' || source])"
)
FIELD_QUERY = f"list_concat(list_transform({PLAIN_WORDS}, lambda t: 'plot:' || t), ['origin:en', 'director:src' || item_id % 20])"


@query(search_sql(FIELD_WORDS, FIELD_QUERY, 3))
def tfidf_field_search(spark, folder):
    docs, items = table(spark, folder, "documents").drop("n_chars"), table(spark, folder, "benchmark")
    of_doc = {"plot": F.col("text"), "origin": F.col("lang"), "director": F.col("source")}
    of_item = {"plot": F.col("text"), "origin": F.lit("en"), "director": F.concat(F.lit("src"), F.col("item_id") % 20)}
    found = search.tfidf_search(
        docs, items, "doc_id", "item_id", features.field_terms(of_doc), features.field_terms(of_item), 3, digits=9)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- labels


def rated_documents(spark, folder):
    """Documents with a rating and their label list."""
    found = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    rated = table(spark, folder, "labels")
    return table(spark, folder, "documents").join(rated, "doc_id").withColumn("labels", found)


@query(f"""
    WITH rated AS (SELECT d.* FROM documents d JOIN labels l ON d.doc_id = l.doc_id), {tfidf_sql(300, 2, 0.9, 'rated')},
    lab AS (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END],
            lambda x: x IS NOT NULL)) AS label FROM labels),
    tot AS (SELECT term, sum(weight) AS t FROM w GROUP BY 1),
    p AS (SELECT label, count(*)::DOUBLE / (SELECT count(*) FROM labels) AS p FROM lab GROUP BY 1),
    o AS (SELECT label, term, sum(weight) AS o FROM w JOIN lab USING (doc_id) GROUP BY 1, 2)
    SELECT term, round(sum((coalesce(o, 0) - p * t) * (coalesce(o, 0) - p * t) / (p * t)), 6) AS chi2
    FROM (SELECT * FROM tot, p) x LEFT JOIN o USING (label, term) GROUP BY term ORDER BY round(chi2, 9) DESC, term LIMIT 100
""")
def chi2_rank(spark, folder):
    rated = rated_documents(spark, folder)
    weights = features.tfidf(rated, "doc_id", "text", 300, 2, 0.9)
    labels = rated.select("doc_id", F.explode_outer("labels").alias("label"))
    scores = features.chi2_scores(weights, labels, "doc_id")
    best = features.keep_best_terms(scores.withColumn("chi2", F.round("chi2", 9)), 100)
    return best.select("term", F.round("chi2", 6).alias("chi2"))


@query("""
    SELECT d.doc_id, CAST(coalesce(quality, 0) = 1 AS INTEGER) AS quality, CAST(coalesce(toxic, 0) = 1 AS INTEGER) AS toxic
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def multilabel_matrix(spark, folder):
    return features.label_matrix(rated_documents(spark, folder), "doc_id", "labels", ["toxic", "quality"])


@query("""
    SELECT doc_id, CAST(lang = 'de' AS INTEGER) AS loc_de, CAST(lang = 'en' AS INTEGER) AS loc_en,
           CAST(lang = 'fr' AS INTEGER) AS loc_fr FROM documents
""")
def one_hot(spark, folder):
    """Categories known from training; the fourth language is unseen and all zeros."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return joins.align_categories(docs, "lang", ["de", "en", "fr"]).drop("lang")


@query("""
    SELECT doc_id, CASE WHEN h < 8000 THEN 'train' ELSE 'test' END AS part, CASE WHEN h < 1000 THEN 'test' WHEN h < 2000
           THEN 'validation' ELSE 'train' END AS three_way
    FROM (SELECT doc_id, ('0x' || substring(md5('42:' || doc_id), 1, 8))::BIGINT % 10000 AS h FROM documents)
""")
def hash_split(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", features.split_column("doc_id", [("train", 0.8), ("test", 0.2)]).alias("part"),
        features.split_column("doc_id", [("test", 0.1), ("validation", 0.1), ("train", 0.8)]).alias("three_way"),
    )
