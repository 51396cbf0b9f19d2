"""Profiles, label clean-up, text functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.fixed_values import (
    LABEL_ALIASES,
    ROUTING_KEYWORDS,
    STOP_WORDS,
    SUMMARY_PROMPT,
)
from marquee.functions import credits, labels, text, values
from marquee.operators import tables
from marquee.plans.common import query, text_list, value_rows
from marquee.sources.readers import table

# ---------------------------------------------------------------- profiles


@query("""
    WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    c AS (SELECT count(*) AS n, count(*) - count(doc_id) AS a, count(*) - count(lang) AS b,
                 count(*) - count(quality) AS q, count(*) - count(toxic) AS t FROM j),
    r AS (SELECT 'doc_id' AS "column", a AS nulls, n FROM c UNION ALL SELECT 'lang', b, n FROM c
          UNION ALL SELECT 'quality', q, n FROM c UNION ALL SELECT 'toxic', t, n FROM c)
    SELECT "column", nulls, round(100.0 * nulls::DOUBLE / n, 6) AS percent FROM r WHERE nulls > 0
""")
def null_profile(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    found = tables.null_profile(docs.join(table(spark, folder, "labels"), "doc_id", "left"))
    return found.withColumn("percent", F.round("percent", 6))


@query("""
    SELECT * FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'),
                          (3, 'source', 'string'), (4, 'n_chars', 'bigint')) v(position, "column", "type"),
                  (SELECT count(*) AS row_count FROM documents)
""")
def schema_report(spark, folder):
    return tables.schema_report(table(spark, folder, "documents"))


@query("""
    SELECT count(*) AS n, min(n_chars) AS least, max(n_chars) AS most,
           count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources,
           (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS suppliers
    FROM documents
""")
def basic_stats(spark, folder):
    suppliers = table(spark, folder, "lineitem").agg(F.countDistinct("l_suppkey")).scalar()
    return table(spark, folder, "documents").agg(
        F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"),
        F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"),
    ).withColumn("suppliers", suppliers)


@query("""
    WITH j AS (SELECT d.doc_id, coalesce(CASE l.quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END, 'Unknown') AS rating
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT rating, count(*) AS n FROM j WHERE rating <> 'low' GROUP BY rating
""")
def fill_and_filter(spark, folder):
    rating = values.decode(F.col("quality"), {0: "low", 1: "high"}, None).alias("rating")
    docs = table(spark, folder, "documents").select("doc_id")
    rated = docs.join(table(spark, folder, "labels"), "doc_id", "left").select("doc_id", rating)
    return tables.value_counts(tables.drop_value(rated.fillna({"rating": "Unknown"}), "rating", "low"), "rating")


@query("""
    WITH j AS (SELECT o.o_orderkey, o.o_orderstatus AS a, CASE WHEN o.o_totalprice > 250000 THEN NULL ELSE
               l.l_linestatus END AS b FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey)
    SELECT a, b, count(*) AS n FROM j WHERE b IS NOT NULL AND a IS DISTINCT FROM b GROUP BY a, b
""")
def source_conflicts(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linestatus")
    both = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_orderstatus").alias("a"), F.when(F.col("o_totalprice") <= 250000, F.col("l_linestatus")).alias("b")
    )
    return tables.conflicts(both, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- labels

PART_ALIASES = {
    "colour": ["red", "blue"], "fastener": ["bolt", "rod"], "jewel": ["ring"], "big": ["large", "econom"],
    "little": ["small"], "age": ["old", "new"], "tool": ["anvil", "gear"], "unknown": ["unknown"],
}
PART_ALIAS_ROWS = value_rows([(a, label) for label, spellings in PART_ALIASES.items() for a in spellings])


@query(f"""
    WITH alias(a, label) AS (VALUES {PART_ALIAS_ROWS}),
    tok AS (SELECT p_partkey, unnest(list_transform(string_split_regex(lower(p_name || ', ' || p_type || ';' || p_brand),
                   '[,/;]'), lambda x: trim(x))) AS t FROM part),
    distinct_tok AS (SELECT DISTINCT t FROM tok),
    exact AS (SELECT t, label FROM distinct_tok JOIN alias ON t = a),
    partial AS (SELECT t, label FROM distinct_tok JOIN alias ON contains(t, a) WHERE t NOT IN (SELECT t FROM exact)),
    hit AS (SELECT * FROM exact UNION ALL SELECT * FROM partial),
    found AS (SELECT p_partkey, string_agg(DISTINCT label, '|' ORDER BY label) AS l FROM tok JOIN hit USING (t) GROUP BY 1)
    SELECT p.p_partkey, coalesce(f.l, 'unknown') AS labels FROM part p LEFT JOIN found f ON p.p_partkey = f.p_partkey
""")
def label_extract(spark, folder):
    raw = F.concat("p_name", F.lit(", "), "p_type", F.lit(";"), "p_brand")
    found = labels.canonical_labels(raw, PART_ALIASES)
    return table(spark, folder, "part").select("p_partkey", F.array_join(found, "|").alias("labels"))


GENRE_ALIAS_ROWS = value_rows([(a, label) for label, spellings in LABEL_ALIASES.items() for a in spellings])


@query(f"""
    WITH alias(a, label) AS (VALUES {GENRE_ALIAS_ROWS}),
    tok AS (SELECT page_id, unnest(list_transform(string_split_regex(lower(url), '[,/;]'),
                   lambda x: trim(x, ' \t\n\r\f\v'))) AS t FROM pages),
    distinct_tok AS (SELECT DISTINCT t FROM tok),
    exact AS (SELECT t, label FROM distinct_tok JOIN alias ON t = a),
    partial AS (SELECT t, label FROM distinct_tok JOIN alias ON contains(t, a) WHERE t NOT IN (SELECT t FROM exact)),
    hit AS (SELECT * FROM exact UNION ALL SELECT * FROM partial),
    found AS (SELECT page_id, string_agg(DISTINCT label, '|' ORDER BY label) AS l FROM tok JOIN hit USING (t) GROUP BY 1)
    SELECT p.page_id, coalesce(f.l, 'unknown') AS labels FROM pages p LEFT JOIN found f ON p.page_id = f.page_id
""")
def genre_extract(spark, folder):
    found = labels.canonical_labels(F.col("url"))
    return table(spark, folder, "pages").select("page_id", F.array_join(found, "|").alias("labels"))


@query("""
    SELECT page_id, list_aggregate(list_transform(string_split(regexp_replace(regexp_replace(lower(url), '[/&]', ',', 'g'),
           '[^a-z0-9, ]+', '', 'g'), ','), lambda x: trim(x)), 'string_agg', '|') AS parts,
           list_aggregate(list_filter(list_transform(string_split(replace(url, '/', ','), ','), lambda x: trim(x)),
           lambda x: length(x) > 0), 'string_agg', '|') AS names
    FROM pages
""")
def label_clean_split(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        F.array_join(labels.clean_label_list(F.col("url")), "|").alias("parts"),
        F.array_join(labels.split_names(F.replace(F.col("url"), F.lit("/"), F.lit(","))), "|").alias("names"),
    )


FUZZY_TARGETS = ["anvils", "bolts", "rings", "rods", "widgets", "gears", "plates", "gizmos", "cold", "olden"]
FUZZY_OVERRIDES = {"hot": "warm", "new": "fresh"}


@query(f"""
    WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part),
    words AS (SELECT DISTINCT w FROM w),
    target(t) AS (SELECT unnest([{text_list(FUZZY_TARGETS)}])),
    scored AS (SELECT w, t, 100.0 * (1.0 - levenshtein(w, t)::DOUBLE / greatest(length(w), length(t))) AS s FROM words, target),
    best AS (SELECT w, t FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s DESC, t) AS r FROM scored WHERE s > 80) WHERE r = 1),
    m AS (SELECT words.w, coalesce(CASE words.w WHEN 'hot' THEN 'warm' WHEN 'new' THEN 'fresh' END, t) AS m
          FROM words LEFT JOIN best ON words.w = best.w)
    SELECT p.p_partkey, coalesce(x.mapped, '') AS mapped FROM part p LEFT JOIN
    (SELECT p_partkey, string_agg(DISTINCT m, '|' ORDER BY m) AS mapped FROM w JOIN m USING (w) GROUP BY 1) x ON p.p_partkey = x.p_partkey
""")
def fuzzy_label_map(spark, folder):
    mapped = labels.map_to_main(F.split("p_name", " "), FUZZY_TARGETS, FUZZY_OVERRIDES)
    return table(spark, folder, "part").select("p_partkey", F.array_join(mapped, "|").alias("mapped"))


@query("""
    SELECT p_partkey, split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || '''s|' || p_type AS items,
           3 AS n, split_part(p_name, ' ', 1) AS first_item, p_type || '|' || p_brand AS plain
    FROM part
""")
def literal_list_parse(spark, folder):
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    literal = F.concat(F.lit("['"), word(1), F.lit("', \""), word(2), F.lit("'s\", '"), "p_type", F.lit("']"))
    rows = table(spark, folder, "part").select(
        "p_partkey", literal.alias("literal"), F.concat("p_type", F.lit(", "), "p_brand").alias("plain")
    )
    items = labels.as_label_array(rows, "literal")
    return rows.select(
        "p_partkey", F.array_join(items, "|").alias("items"), F.size(items).alias("n"),
        labels.primary_label(items).alias("first_item"), F.array_join(labels.as_label_array(rows, "plain"), "|").alias("plain"),
    )


@query("""
    SELECT label, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS label FROM part) GROUP BY label
""")
def label_frequency(spark, folder):
    parts = table(spark, folder, "part").select(F.split("p_name", " ").alias("words"))
    return tables.value_counts(tables.exploded(parts, "words", "label"), "label")


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS label FROM part")
def label_set(spark, folder):
    parts = table(spark, folder, "part").select(F.split("p_name", " ").alias("words"))
    return tables.exploded(parts, "words", "label").distinct().orderBy("label")


# ---------------------------------------------------------------- text

CLEAN_SQL = r"""coalesce(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '<[^>]+>', '', 'g'),
              '[^a-z \t\n\r\f\v]', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), '')"""


@query(f"SELECT page_id, {CLEAN_SQL.format('html')} AS cleaned FROM pages")
def text_clean(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query("SELECT doc_id, md5(strip_accents(text)) AS digest, length(strip_accents(text)) AS n FROM documents")
def strip_accents(spark, folder):
    plain = text.strip_accents(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(plain.cast("binary")).alias("digest"), F.length(plain).cast("long").alias("n")
    )


@query(f"""
    WITH c AS (SELECT doc_id, {CLEAN_SQL.format('text')} AS cleaned FROM documents)
    SELECT doc_id, coalesce(list_aggregate(list_filter(string_split(cleaned, ' '), lambda t: length(t) >= 3
           AND regexp_full_match(t, '[a-z]+') AND NOT list_contains([{text_list(STOP_WORDS)}], t)), 'string_agg', ' '), '') AS kept
    FROM c
""")
def token_filter(spark, folder):
    cleaned = table(spark, folder, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))
    return cleaned.select("doc_id", text.keep_tokens(F.col("cleaned")).alias("kept"))


@query("""
    SELECT p_partkey,
           CASE WHEN p_size % 3 < 2 THEN p_brand END AS director,
           CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 1) || '|' || p_type
                           WHEN 1 THEN '' ELSE p_name || '|' || p_type END AS people
    FROM part
""")
def marker_extract(spark, folder):
    line = (
        F.when(F.col("p_size") % 3 == 0, F.concat(
            F.lit("Director:  "), "p_brand", F.lit("\r\nCast: "), F.split_part("p_name", F.lit(" "), F.lit(1)),
            F.lit(", , "), "p_type", F.lit(" ")))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("Director: "), "p_brand", F.lit("  ")))
        .otherwise(F.concat("p_name", F.lit(" ,"), "p_type"))
    )
    return table(spark, folder, "part").select("p_partkey", line.alias("line")).select(
        "p_partkey", credits.director_of_line(F.col("line")).alias("director"),
        F.array_join(credits.cast_of_line(F.col("line")), "|").alias("people"),
    )


@query(r"""
    SELECT page_id, CASE WHEN regexp_matches(html, '<title>[^<]+') THEN regexp_extract(html, '<title>([^<]+)', 1) END AS title,
           len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages
""")
def page_markers(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        F.when(F.rlike("html", F.lit("<title>[^<]+")), F.regexp_extract("html", "<title>([^<]+)", 1)).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"),
    )


@query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CASE WHEN event_type = 'error' THEN NULL WHEN value < 20 THEN 'user ' || user_id ELSE event_type END AS director,
           CASE WHEN event_type = 'error' THEN '' WHEN value < 20 THEN 'user ' || user_id
                ELSE event_type || ', user ' || user_id END AS directors,
           CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|user ' || user_id END AS names
    FROM events
""")
def json_parse(spark, folder):
    job = F.when(F.col("value") < 20, "Writer").otherwise("Director")
    crew = F.when(F.col("event_type") == "error", F.lit("[{\"name\":")).otherwise(F.concat(
        F.lit('[{"name":"'), "event_type", F.lit('","job":"'), job, F.lit('"},{"name":"user '),
        F.col("user_id").cast("string"), F.lit('","job":"Director"},{"job":"Editor"}]')))
    people = credits.parse_objects(crew, credits.CREW_SCHEMA)
    rows = table(spark, folder, "events").select("event_id", "props", people.alias("crew"))
    return rows.select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"),
        credits.first_with_job(F.col("crew")).alias("director"), credits.all_with_job(F.col("crew")).alias("directors"),
        F.array_join(credits.top_names(F.col("crew"), 3), "|").alias("names"),
    )


@query("""
    SELECT role, count(*) AS n FROM (SELECT CASE WHEN value < 20 THEN 'Unknown' ELSE 'Male' END AS role FROM events
    UNION ALL SELECT CASE user_id % 3 WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' ELSE 'Unknown' END FROM events) GROUP BY 1
""")
def nested_categories(spark, folder):
    """Gender distribution over an exploded cast list."""
    cast = F.concat(
        F.lit('[{"name":"'), "event_type", F.when(F.col("value") < 20, '"},').otherwise('","gender":2},'),
        F.lit('{"name":"user","gender":'), (F.col("user_id") % 3).cast("string"), F.lit("}]"))
    people = table(spark, folder, "events").select(F.explode(credits.parse_objects(cast, credits.CAST_SCHEMA)).alias("p"))
    return tables.value_counts(people.select(credits.gender_label(F.col("p.gender")).alias("role")), "role")


@query("""
    SELECT doc_id, 'The movie titled ''' || doc_id || ''' was directed by ' || source || '. It falls under the ''' || lang
           || ''' genres and was released in ' || n_chars || '. Plot summary: ' || substring(text, 1, 1000) AS body,
           'Title: ' || doc_id || ' Director: ' || source || ' Cast: ' || lang AS credits
    FROM documents
""")
def template_text(spark, folder):
    title = F.col("doc_id").cast("string")
    body = text.embedding_text(title, F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", body.alias("body"), text.credits_text(title, F.col("source"), F.col("lang")).alias("credits")
    )


@query("""
    SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS short FROM documents
""")
def truncate_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.truncate(F.col("text"), 200).alias("short"))


@query("""
    SELECT doc_id, md5(regexp_replace(text, '(?i)' || lang, '**' || lang || '**', 'g')) AS digest,
           len(regexp_extract_all(text, '(?i)' || lang)) AS hits FROM documents
""")
def highlight(spark, folder):
    marked = text.highlight(F.col("text"), F.col("lang"))
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(marked.cast("binary")).alias("digest"),
        F.regexp_count("text", F.concat(F.lit("(?iu)"), "lang")).cast("long").alias("hits"),
    )


PROMPT_HEAD, PROMPT_REST = SUMMARY_PROMPT.replace("{words}", "75").split("{title}")
PROMPT_MIDDLE, PROMPT_TAIL = PROMPT_REST.split("{plot}")


@query(f"""
    SELECT doc_id, md5({text_list([PROMPT_HEAD])} || source || {text_list([PROMPT_MIDDLE])} || text ||
           {text_list([PROMPT_TAIL])}) AS prompt, md5('summarize: ' || source || ': ' || text) AS model_input FROM documents
""")
def prompt_text(spark, folder):
    prompt = text.summary_prompt(F.col("source"), F.col("text"), 150, non_spoiler=False)
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(prompt.cast("binary")).alias("prompt"),
        F.md5(text.summarize_input(F.col("source"), F.col("text")).cast("binary")).alias("model_input"),
    )


@query("""
    SELECT doc_id, CASE WHEN length(s) < 10 OR starts_with(lower(s), 'summarize') THEN
           CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END ELSE s END AS summary
    FROM (SELECT doc_id, text, CASE WHEN lang = 'fr' THEN 'Summarize: it' WHEN lang = 'de' THEN 'kurz'
          ELSE 'A text of ' || source || ' in ' || lang END AS s FROM documents)
""")
def summary_guard(spark, folder):
    summary = F.when(F.col("lang") == "fr", " Summarize: it").when(F.col("lang") == "de", " kurz ").otherwise(
        F.concat(F.lit("A text of "), "source", F.lit(" in "), "lang", F.lit(" \n")))
    return table(spark, folder, "documents").select("doc_id", text.guarded_summary(summary, F.col("text")).alias("summary"))


@query(f"""
    SELECT conv_id, turn, CAST(list_bool_or(list_transform([{text_list(ROUTING_KEYWORDS)}], lambda k: contains(lower(text), k)))
           AS INTEGER) AS routed FROM conversations WHERE role = 'user'
""")
def keyword_route(spark, folder):
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", text.has_keyword(F.col("text")).cast("int").alias("routed"))


@query("""
    SELECT p_partkey FROM part
    WHERE (contains(lower(p_brand), 'brand#1') OR contains(lower(p_brand), 'brand#2'))
      AND (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt'))
      AND contains(lower(p_type), 'promo')
""")
def entity_filter(spark, folder):
    wanted = lambda *names: F.array(*[F.lit(n) for n in names])
    return table(spark, folder, "part").filter(
        text.matches_entities(F.col("p_brand"), wanted("Brand#1", "Brand#2"))
        & text.matches_entities(F.col("p_name"), wanted("Ring", "bolt"))
        & text.matches_entities(F.col("p_type"), wanted("promo"))
        & text.matches_entities(F.col("p_type"), F.array().cast("array<string>"))
    ).select("p_partkey")


@query("""
    SELECT doc_id FROM documents WHERE contains(lower(text), 'ther') OR contains(lower(source), 'ther')
    ORDER BY doc_id LIMIT 5
""")
def substring_search(spark, folder):
    hit = text.any_field_contains([F.col("text"), F.col("source")], F.lit("Ther"))
    return table(spark, folder, "documents").filter(hit).select("doc_id").orderBy("doc_id").limit(5)


@query("SELECT p_partkey, replace(replace(lower(p_name || '-' || p_type), ' ', '_'), '-', '_') AS name, "
       "p_type || ' ' || p_brand || ' ' || p_name AS metadata FROM part")
def names_and_metadata(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", text.safe_name(F.concat("p_name", F.lit("-"), "p_type")).alias("name"),
        values.metadata_string(F.col("p_type"), F.col("p_brand"), F.col("p_name")).alias("metadata"),
    )


# ---------------------------------------------------------------- codes, dates, numbers


@query("""
    SELECT CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Unknown' END AS status, count(*) AS n
    FROM orders GROUP BY 1
""")
def code_decode(spark, folder):
    status = values.decode(F.col("o_orderstatus"), {"F": "Filled", "O": "Open"}, "Unknown")
    return tables.value_counts(table(spark, folder, "orders").select(status.alias("status")), "status")


@query("""
    WITH t AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
                      CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE substring(o_orderpriority, 1, 1) END AS p FROM orders)
    SELECT CAST(year(TRY_CAST(d AS DATE)) AS INTEGER) AS year, TRY_CAST(p AS DOUBLE) AS priority, count(*) AS n FROM t GROUP BY 1, 2
""")
def coerce_date_year(spark, folder):
    day = F.when(F.col("o_orderpriority") == "5-LOW", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    number = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1))
    rows = table(spark, folder, "orders").select(values.year_of(day).alias("year"), values.to_number(number).alias("priority"))
    return rows.groupBy("year", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT CAST(floor(year(o_orderdate) / 10.0) * 10 AS INTEGER) AS decade, count(*) AS n FROM orders
    WHERE year(o_orderdate) > 1900 GROUP BY 1
""")
def decade_bucket(spark, folder):
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")).filter("year > 1900")
    return years.groupBy(values.decade_of(F.col("year")).alias("decade")).agg(F.count(F.lit(1)).alias("n")).orderBy("decade")


@query(r"""
    SELECT doc_id, CAST(len(string_split_regex(t, '[ \t\n\r\f\v]+')) AS INTEGER) AS words FROM
    (SELECT doc_id, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS t FROM documents)
    WHERE length(t) > 0 AND len(string_split_regex(t, '[ \t\n\r\f\v]+')) >= 20
""")
def min_words(spark, folder):
    docs = tables.drop_short(table(spark, folder, "documents"), "text", 20)
    return docs.select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("""
    SELECT doc_id, lang, source FROM documents
    ORDER BY ('0x' || substring(md5('42:' || doc_id), 1, 8))::BIGINT, doc_id LIMIT 100
""")
def seeded_sample(spark, folder):
    return tables.seeded_sample(table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id", 100)
