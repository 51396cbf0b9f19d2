"""Entities, summary corpora and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.fixed_values import QUERY_TEMPLATES, ROUTING_KEYWORDS
from marquee.functions import text
from marquee.operators import conversations, entities, summaries
from marquee.plans.common import query, text_list
from marquee.plans.features import PLAIN_WORDS
from marquee.runtime import write_once
from marquee.sources.readers import table

# ---------------------------------------------------------------- entities


def _dictionary(spark, folder):
    """Directors are suppliers, people are customers, genres are the words of part names."""
    suppliers = table(spark, folder, "supplier").select(
        F.concat(F.lit("Sam "), F.substring_index("s_name", "#", -1)).alias("director"), F.lit("").alias("people"))
    customers = table(spark, folder, "customer").select(
        F.lit("").alias("director"), F.concat(F.lit("Cy "), F.substring_index("c_name", "#", -1), F.lit(", X")).alias("people"))
    people = entities.entity_dictionary(suppliers.unionByName(customers), "director", "people", [])
    words = table(spark, folder, "part").select(F.lit("GENRE").alias("label"), F.explode(F.split("p_name", " ")).alias("entity"))
    return people.unionByName(words.distinct())


DICTIONARY_SQL = """
    dict AS (SELECT DISTINCT 'DIRECTOR' AS label, 'Sam ' || split_part(s_name, '#', 2) AS entity FROM supplier
             UNION ALL SELECT DISTINCT 'CAST', 'Cy ' || split_part(c_name, '#', 2) FROM customer
             UNION ALL SELECT DISTINCT 'GENRE', unnest(string_split(p_name, ' ')) FROM part)
"""


@query(f"WITH {DICTIONARY_SQL} SELECT label, entity FROM dict")
def entity_dictionary(spark, folder):
    return _dictionary(spark, folder)


def _generated(spark, folder):
    """One labelled query per order."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    return write_once(entities.generate_queries(orders, "o_orderkey", _dictionary(spark, folder)))


HASH = "('0x' || substring(md5('{0}:' || o_orderkey), 1, 8))::BIGINT"
TEMPLATE_ROWS = ", ".join(
    f"({i}, {text_list([t])}, {p}, {text_list(['{' + n + '}', label])})"
    for i, (t, slots) in enumerate(QUERY_TEMPLATES) for p, (n, label) in enumerate(slots)
)
GENERATED_SQL = f"""
    {DICTIONARY_SQL},
    b AS (SELECT *, ('0x' || substring(md5('0:' || entity), 1, 8))::BIGINT % 1024 AS bucket FROM dict),
    idx AS (SELECT label, entity, row_number() OVER (PARTITION BY label ORDER BY bucket, entity) - 1 AS place FROM b),
    size AS (SELECT label, count(*) AS n FROM dict GROUP BY 1),
    tpl(t, template, pos, slot, label) AS (VALUES {TEMPLATE_ROWS}),
    s AS (SELECT o_orderkey, {HASH.format(42)} % 12 AS t, {HASH.format(43)} AS h1, {HASH.format(44)} AS h2 FROM orders),
    ask AS (SELECT o_orderkey, template, pos, slot, tpl.label, n, (h1 % n + CASE WHEN pos = 1 AND tpl.label = first_label
            THEN h2 % (n - 1) + 1 ELSE 0 END) % n AS place
            FROM s JOIN tpl USING (t) JOIN size USING (label) JOIN (SELECT t, label AS first_label FROM tpl WHERE pos = 0) f USING (t)),
    pick AS (SELECT ask.*, idx.entity FROM ask JOIN idx USING (label, place)),
    two AS (SELECT o_orderkey, any_value(template) AS template, max(slot) FILTER (pos = 0) AS s1, max(entity) FILTER (pos = 0) AS e1,
            max(label) FILTER (pos = 0) AS l1, max(slot) FILTER (pos = 1) AS s2, max(entity) FILTER (pos = 1) AS e2,
            max(label) FILTER (pos = 1) AS l2 FROM pick GROUP BY 1),
    txt AS (SELECT *, CASE WHEN s2 IS NULL THEN replace(template, s1, e1) ELSE replace(replace(template, s1, e1), s2, e2) END AS text FROM two),
    p1 AS (SELECT *, instr(text, e1) - 1 AS a1, instr(text, e1) - 1 + length(e1) AS b1, instr(text, e2) - 1 AS a2 FROM txt),
    p2 AS (SELECT *, CASE WHEN a2 + length(e2) <= a1 OR a2 >= b1 THEN a2
                          ELSE b1 + instr(substring(text, b1 + 1), e2) - 1 END AS c2 FROM p1),
    gold AS (SELECT o_orderkey, text, a1 AS start, b1 AS "end", l1 AS label FROM p2
             UNION ALL SELECT o_orderkey, text, c2, c2 + length(e2), l2 FROM p2 WHERE e2 IS NOT NULL)
"""


@query(f"""
    WITH {GENERATED_SQL} SELECT o_orderkey, text, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", label FROM gold
""")
def ner_generate(spark, folder):
    made = _generated(spark, folder)
    return made.select("o_orderkey", "text", F.inline("entities"))


@query(f"WITH {GENERATED_SQL} SELECT count(DISTINCT o_orderkey) AS n, 0::BIGINT AS broken FROM gold")
def ner_validate(spark, folder):
    made = _generated(spark, folder)
    valid = entities.spans_valid(F.col("text"), F.col("entities"))
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_if(~valid).alias("broken"))


def _tags(spark, folder, made):
    return entities.tag(made.select("o_orderkey", "text"), "o_orderkey", "text", _dictionary(spark, folder))


# Dictionary entries do not nest, so the tags are the words and word pairs that are entries.
TAG_SQL = f"""
    {GENERATED_SQL},
    names AS (SELECT lower(entity) AS run, min(label) AS label FROM dict GROUP BY 1),
    words AS (SELECT DISTINCT o_orderkey, string_split(text, ' ') AS w FROM gold),
    spots AS (SELECT o_orderkey, w, unnest(range(len(w))) AS i FROM words),
    run AS (SELECT o_orderkey, w, i, 1 AS n, lower(w[i + 1]) AS run FROM spots
            UNION ALL SELECT o_orderkey, w, i, 2, lower(w[i + 1] || ' ' || w[i + 2]) FROM spots WHERE i + 2 <= len(w)),
    tag AS (SELECT o_orderkey, CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(w[1:i], ' ')) + 1 END AS start, label,
            array_to_string(w[i + 1:i + n], ' ') AS surface FROM run JOIN names USING (run))
"""


@query(f"""
    WITH {TAG_SQL} SELECT o_orderkey, CAST(start AS INTEGER) AS start, CAST(start + length(surface) AS INTEGER) AS "end", label, surface FROM tag
""")
def ner_tag(spark, folder):
    return _tags(spark, folder, _generated(spark, folder))


@query(f"""
    WITH {TAG_SQL} SELECT o_orderkey, coalesce(string_agg(surface, '|' ORDER BY start) FILTER (label = 'DIRECTOR'), '') AS directors,
    coalesce(string_agg(surface, '|' ORDER BY start) FILTER (label = 'CAST'), '') AS people,
    coalesce(string_agg(surface, '|' ORDER BY start) FILTER (label = 'GENRE'), '') AS genres FROM tag GROUP BY 1
""")
def ner_entities(spark, folder):
    found = entities.grouped_entities(_tags(spark, folder, _generated(spark, folder)), "o_orderkey")
    return found.select(
        "o_orderkey", F.array_join("DIRECTOR", "|").alias("directors"), F.array_join("CAST", "|").alias("people"),
        F.array_join("GENRE", "|").alias("genres"),
    )


@query(f"""
    WITH {TAG_SQL},
    g AS (SELECT DISTINCT o_orderkey, start, "end", label FROM gold),
    p AS (SELECT o_orderkey, start, start + length(surface) AS "end", label FROM tag),
    c AS (SELECT (SELECT count(*) FROM g JOIN p USING (o_orderkey, start, "end", label)) AS tp, (SELECT count(*) FROM g) AS g,
          (SELECT count(*) FROM p) AS p)
    SELECT tp, p - tp AS fp, g - tp AS fn, round(tp::DOUBLE / p, 6) AS "precision", round(tp::DOUBLE / g, 6) AS recall,
           round(2.0 * tp::DOUBLE / (p + g), 6) AS f1 FROM c
""")
def ner_score(spark, folder):
    made = _generated(spark, folder)
    found = entities.span_scores(made.select("o_orderkey", F.inline("entities")), _tags(spark, folder, made), "o_orderkey")
    return found.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
    WITH {TAG_SQL} SELECT label, count(*) AS first_total, count(*) FILTER (label <> 'GENRE') AS second_total FROM tag GROUP BY 1
""")
def ner_compare(spark, folder):
    """The whole dictionary against one without genres."""
    made = _generated(spark, folder)
    names = _dictionary(spark, folder).filter("label <> 'GENRE'")
    fewer = entities.tag(made.select("o_orderkey", "text"), "o_orderkey", "text", names)
    return entities.compare_taggers(_tags(spark, folder, made), fewer)


# ---------------------------------------------------------------- summaries

WORDS_SQL = r"CASE WHEN length({0}) > 0 THEN len(string_split_regex({0}, '[ \t\n\r\f\v]+')) ELSE 0 END"
STRIPPED = r"regexp_replace({0}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


@query(f"""
    SELECT doc_id, source FROM (SELECT *, {STRIPPED.format('text')} AS t FROM (SELECT * FROM documents
    ORDER BY ('0x' || substring(md5('7:' || doc_id), 1, 8))::BIGINT, doc_id LIMIT 150)) WHERE {WORDS_SQL.format('t')} >= 20
""")
def summary_corpus(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return summaries.corpus(docs, "doc_id", "source", "text", sample=150, seed=7).select("doc_id", "source")


@query()
def summary_batch(spark, folder):
    """Lead-sentence summaries of all documents that are long enough."""
    docs = summaries.corpus(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")
    made = summaries.generate(docs, "text", summaries.lead_sentences(3))
    return made.select("doc_id", "summary", "error")


@query(f"""
    SELECT doc_id, CAST({WORDS_SQL.format('a')} AS INTEGER) AS source_words, CAST({WORDS_SQL.format('b')} AS INTEGER) AS summary_words,
           round({WORDS_SQL.format('b')}::DOUBLE / nullif({WORDS_SQL.format('a')}, 0), 6) AS ratio
    FROM (SELECT doc_id, {STRIPPED.format('text')} AS a, {STRIPPED.format("CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END")} AS b FROM documents)
""")
def length_report(spark, folder):
    """Words of each document and of its first 500 characters."""
    docs = table(spark, folder, "documents").select("doc_id", "text", text.truncate(F.col("text"), 500).alias("short"))
    report = summaries.length_report(docs, "doc_id", "text", "short")
    return report.withColumn("ratio", F.round("ratio", 6))


@query("""
    SELECT source AS title, doc_id, CASE WHEN h < 1000 THEN 'test' WHEN h < 2000 THEN 'validation' ELSE 'train' END AS part
    FROM (SELECT *, ('0x' || substring(md5('42:' || source), 1, 8))::BIGINT % 10000 AS h FROM documents
          QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) = 1)
""")
def summary_split(spark, folder):
    """The last written row per title, split three ways."""
    docs = table(spark, folder, "documents").select(F.col("source").alias("title"), "n_chars", "doc_id")
    latest = summaries.latest_per_title(docs, "title", "n_chars", "doc_id")
    return summaries.split_corpus(latest, "title").select("title", "doc_id", "part")


@query(f"""
    WITH w AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
    v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) + 1 AS id FROM (SELECT unnest(w) AS term FROM w) GROUP BY 1
          QUALIFY id <= 30001),
    x AS (SELECT doc_id, unnest(w[1:128]) AS term, generate_subscripts(w[1:128], 1) AS pos FROM w),
    y AS (SELECT doc_id, pos, coalesce(v.id, 1) AS id FROM x LEFT JOIN v USING (term)),
    z AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM y GROUP BY 1)
    SELECT w.doc_id, array_to_string(list_resize(coalesce(z.ids, []), 128, 0), ' ') AS ids FROM w LEFT JOIN z USING (doc_id)
""")
def pad_tokens(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ids = summaries.padded_ids(docs, "doc_id", "text", summaries.token_vocabulary(docs, "text"), 128)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


# ---------------------------------------------------------------- conversations

EXCHANGE_SQL = f"""
    x AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS r FROM conversations u LEFT JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
    k AS (SELECT *, list_bool_or(list_transform([{text_list(ROUTING_KEYWORDS)}], lambda k: contains(lower(q), k))) AS routed FROM x)
"""


@query(f"""
    WITH {EXCHANGE_SQL} SELECT conv_id, count(*) AS total_turns, count(*) FILTER (routed) AS database_accesses, min(turn) AS started_at,
    round((count(*) - count(*) FILTER (routed))::DOUBLE / count(*) * 100, 1) AS efficiency FROM k GROUP BY 1
""")
def conv_stats(spark, folder):
    turns = conversations.with_route(conversations.exchanges(table(spark, folder, "conversations")))
    return conversations.conversation_stats(turns, F.col("routed") == 1)


@query("""
    SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3
""")
def last_n_turns(spark, folder):
    log = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return conversations.last_turns(log, 3)


SYSTEM_TEXT = "Answer from the catalog."


@query(f"""
    WITH {EXCHANGE_SQL}, h AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20),
    s AS (SELECT conv_id, string_agg('[User]' || chr(10) || {STRIPPED.format('q')} || chr(10) || chr(10) || '[Assistant]' || chr(10) ||
          coalesce({STRIPPED.format('r')}, '') || chr(10) || chr(10), '' ORDER BY turn) AS t FROM h GROUP BY 1),
    c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT conv_id, '[System]' || chr(10) || '{SYSTEM_TEXT}' || chr(10) || chr(10) || coalesce(t, '') || '[User]' || chr(10) ||
           'What next in ' || conv_id || '?' || chr(10) || chr(10) || '[Assistant]' || chr(10) AS prompt
    FROM c LEFT JOIN s USING (conv_id)
""")
def conv_messages(spark, folder):
    log = table(spark, folder, "conversations")
    current = log.select("conv_id").distinct().withColumn(
        "query", F.concat(F.lit("What next in "), F.col("conv_id").cast("string"), F.lit("?")))
    prompts = conversations.prompt_messages(conversations.exchanges(log), current, SYSTEM_TEXT)
    return prompts.select("conv_id", text.transcript(F.col("messages")).alias("prompt"))


@query(f"""
    WITH {EXCHANGE_SQL} SELECT conv_id, turn, md5(q) AS query, md5(r) AS response, CAST(routed AS INTEGER) AS calls,
    CAST(routed AS INTEGER) AS database_accessed, CASE WHEN routed THEN len(string_split(q, ' ')) % 5 ELSE 0 END AS num_retrieved FROM k
""")
def turn_records(spark, folder):
    turns = conversations.with_route(conversations.exchanges(table(spark, folder, "conversations")))
    retrieved = F.when(F.col("routed") == 1, (F.size(F.split("user_message", " ")) % 5).cast("long"))
    found = conversations.turn_record(turns, retrieved, F.col("routed"))
    return found.select(
        "conv_id", "turn", F.md5(F.col("query").cast("binary")).alias("query"),
        F.md5(F.col("response").cast("binary")).alias("response"), "calls", "database_accessed",
        F.col("num_retrieved").cast("long").alias("num_retrieved"),
    )
