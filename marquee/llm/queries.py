"""The queries of this subpackage over the given tables, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marquee.llm import bestfit, codes, fingerprints, language, mixing, neardup, packing, pages, quality, secrets, sharding, spelling, vectors

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        if sql is not None:
            SQL[make.__name__] = sql
        return make
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query()
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


@query()
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


# every pair of a label, and components by reaching the smallest vec_id
@query("""
    WITH RECURSIVE good AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.v, b.v) >= 0.98
    ), reach AS (
        SELECT vec_id, vec_id AS other FROM embeddings
        UNION
        SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
    ), named AS (
        SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
    ), degrees AS (
        SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM named LEFT JOIN degrees USING (vec_id)
""")
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_table(spark, sf_dir, "documents"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select(
        "doc_id", "start", "length", packing.crc32_of(pieces["ids"]).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


@query()
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


@query()
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


@query()
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY)).drop("ids")


# crc32 byte by byte over a table of 256 entries; near words by their texts without one letter
@query("""
    WITH RECURSIVE crc_table AS MATERIALIZED (
        SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t
        FROM range(256) AS r(b)
    ), runs AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
    ), lowered AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM runs WHERE length(run) >= 7 GROUP BY ALL
    ), hashed AS (
        SELECT run, n, xor(4294967295, list_reduce(
            flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda ch: CASE WHEN unicode(ch) < 128
                THEN [unicode(ch)::BIGINT] ELSE [(192 | (unicode(ch) >> 6))::BIGINT, (128 | (unicode(ch) & 63))::BIGINT] END)),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h
        FROM lowered, crc_table
    ), edited AS (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
        FROM hashed
    ), words AS MATERIALIZED (
        SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), cut AS MATERIALIZED (
        SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 100) AS r(i) WHERE i <= length(word)
    ), near AS MATERIALIZED (
        SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
        UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
    ), best AS (
        SELECT word, count(*) AS n_near, (max(n))::BIGINT AS m FROM near GROUP BY word
    ), forms AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN m END AS form_n,
            CASE WHEN m >= 10 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = m) END AS form
        FROM words w LEFT JOIN best USING (word)
    ), walk AS (
        SELECT word, word AS here, 0 AS step FROM forms
        UNION ALL
        SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL
    ), ends AS (
        SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word
    )
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
""")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def _lloyd_sql() -> str:
    """Plain Lloyd over all parts and entries, one pair of tables a round."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
            SELECT n, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM (
                SELECT n, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                FROM parts JOIN b{k} USING (p)
            ) GROUP BY n, p
        )"""

    def moved(k: int) -> str:
        return f"""s{k} AS MATERIALIZED (
            SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM parts JOIN a{k} USING (n, p), range(1, 9) AS r(i) GROUP BY p, e, i
        ), b{k + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(m, c) AS c FROM b{k} LEFT JOIN (
                SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{k} GROUP BY p, e
            ) USING (p, e)
        )"""

    rounds = ", ".join(f"{assigned(k)}, {moved(k)}" for k in range(6))
    return f"""
        WITH good AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS n
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT n, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM good, range(8) AS r(p)
        ), b0 AS MATERIALIZED (
            SELECT p, n - 1 AS e, v AS c FROM parts WHERE n <= 16
        ), {rounds}, {assigned(6)}, coded AS (
            SELECT n, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY n
        ), sha AS (
            SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM coded JOIN good USING (n), sha
    """


@query(_lloyd_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(_table(spark, sf_dir, "embeddings"))
