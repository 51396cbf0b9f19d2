"""Joins, aggregations, rankings and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import labels, values
from marquee.operators import graph, joins, tables
from marquee.plans.common import query
from marquee.sources.readers import table

LANGS = ["de", "en", "es", "fr"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WORDS = [
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large",
    "new", "old", "plate", "red", "ring", "rod", "small", "widget",
]

# ---------------------------------------------------------------- joins


@query("""
    WITH o AS (SELECT o_orderkey, 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS title,
                      CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS director, o_orderstatus AS s FROM orders),
    c AS (SELECT lower(c_name) AS k, c_mktsegment AS seg, c_nationkey AS nat FROM customer
          QUALIFY row_number() OVER (PARTITION BY lower(c_name) ORDER BY c_custkey) = 1)
    SELECT o_orderkey, coalesce(o.director, c.seg) AS director,
           array_to_string(list_sort(list_distinct(list_filter([o.s, 'F', CAST(c.nat AS VARCHAR)], lambda x: x IS NOT NULL))), '|') AS people
    FROM o LEFT JOIN c ON lower(o.title) = c.k
""")
def left_enrich(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("director"),
        F.array("o_orderstatus", F.lit("F")).alias("people"),
    )
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name"), F.col("c_mktsegment").alias("other_director"),
        F.array(F.col("c_nationkey").cast("string")).alias("other_people"),
    )
    joined = joins.enrich_left(
        orders, customers, F.col("title"), F.col("c_name"), ["other_director", "other_people"], "c_custkey"
    )
    return joined.select(
        "o_orderkey", F.coalesce("director", "other_director").alias("director"),
        F.array_join(labels.union_names(F.col("people"), F.col("other_people")), "|").alias("people"),
    )


@query("""
    SELECT s_suppkey, n_name AS country, r_name AS code FROM supplier
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'
""")
def lookup_country(spark, folder):
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region").filter("r_name <> 'ASIA'")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    named = joins.lookup(suppliers, nation, "s_nationkey", "n_nationkey", "n_name", "country")
    placed = joins.lookup(named, nation, "s_nationkey", "n_nationkey", "n_regionkey", "region")
    return joins.lookup(placed, region, "region", "r_regionkey", "r_name", "code").select("s_suppkey", "country", "code")


@query("""
    WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 10)
    SELECT l_suppkey, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
    WHERE l_suppkey IN (SELECT l_suppkey FROM top) GROUP BY 1, 2
""")
def semi_topk(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    return joins.keep_top_keys(lines, "l_suppkey", 10).groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_counts_topk(spark, folder):
    return tables.value_counts(table(spark, folder, "lineitem"), "l_suppkey", 20)


@query("""
    SELECT a.doc_id, a.body AS first_text, b.body AS second_text FROM
    (SELECT doc_id, lang || source AS body FROM documents) a
    JOIN (SELECT doc_id, 'q' || quality AS body FROM labels) b ON a.doc_id = b.doc_id
""")
def compare_outputs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.concat("lang", "source").alias("body"))
    rated = table(spark, folder, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("body"))
    return joins.compare_outputs(docs, rated, "doc_id", "body", ("first_text", "second_text"))


@query("""
    SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
    UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier
""")
def union_align(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return joins.union_align(customers, suppliers)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def key_union(spark, folder):
    return joins.key_union(
        table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation")),
        table(spark, folder, "supplier").select("s_nationkey"),
    )


# ---------------------------------------------------------------- cross-tabulations and metrics


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{v}') AS {v}" for v in LANGS) + " FROM documents GROUP BY 1")
def crosstab(spark, folder):
    return tables.crosstab(table(spark, folder, "documents"), "source", "lang", LANGS)


@query("""
    SELECT source, lang, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY source), 6) AS share
    FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
""")
def crosstab_share(spark, folder):
    return tables.pair_shares(table(spark, folder, "documents"), "source", "lang").withColumn("share", F.round("share", 6))


@query("""
    WITH r AS (SELECT CAST(floor(year(o_orderdate) / 10.0) * 10 AS INTEGER) AS decade, o_orderpriority AS p FROM orders)
    SELECT decade, """ + ", ".join(f"count(*) FILTER (p = '{v}') AS \"{v}\"" for v in PRIORITIES) + """
    FROM r WHERE decade BETWEEN 1900 AND 2020 GROUP BY 1
""")
def decade_label_pivot(spark, folder):
    decade = values.decade_of(F.year("o_orderdate")).alias("decade")
    rows = table(spark, folder, "orders").select(decade, "o_orderpriority").filter(F.col("decade").between(1900, 2020))
    return tables.crosstab(rows, "decade", "o_orderpriority", PRIORITIES)


def _lines_with_words(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_suppkey", "words")


WEIGHT_SQL = """
    WITH d AS (SELECT l_suppkey AS owner, string_split(p_name, ' ') AS words FROM lineitem JOIN part ON l_partkey = p_partkey),
    e AS (SELECT owner, unnest(words) AS label FROM d),
    o AS (SELECT owner, count(*) AS c FROM d GROUP BY 1), g AS (SELECT label, count(*) AS c FROM e GROUP BY 1),
    w AS (SELECT e.owner, e.label, 1.0::DOUBLE / {0}.c AS w FROM e JOIN {0} USING ({1}))
    SELECT owner, """ + ", ".join(f"round(coalesce(sum(w) FILTER (label = '{v}'), 0), 9) AS \"{v}\"" for v in WORDS) + """
    FROM w GROUP BY owner
"""


@query(WEIGHT_SQL.format("o", "owner"))
def weighted_pivot_by_owner(spark, folder):
    found = tables.weighted_pivot(_lines_with_words(spark, folder), "l_suppkey", "words", "owner", WORDS)
    return found.select("owner", *[F.round(w, 9).alias(w) for w in WORDS])


@query(WEIGHT_SQL.format("g", "label"))
def weighted_pivot_by_label(spark, folder):
    found = tables.weighted_pivot(_lines_with_words(spark, folder), "l_suppkey", "words", "label", WORDS)
    return found.select("owner", *[F.round(w, 9).alias(w) for w in WORDS])


@query("""
    WITH r AS (SELECT unnest(string_split(p_name, ' ')) AS label, l_quantity * p_retailprice AS budget,
                      l_extendedprice AS revenue, l_discount AS discount, l_tax AS tax
               FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT label, round(avg(budget), 2) AS avg_budget, round(avg(revenue), 2) AS avg_revenue, round(avg(discount), 6) AS avg_discount,
           round(avg(tax), 6) AS avg_tax, count(*) AS n, round((avg(revenue) - avg(budget)) / avg(budget), 6) AS roi
    FROM r GROUP BY label
""")
def group_metrics_roi(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.explode(F.split("p_name", " ")).alias("label"), (F.col("l_quantity") * F.col("p_retailprice")).alias("budget"),
        F.col("l_extendedprice").alias("revenue"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )
    found = tables.group_metrics(rows, "label", "budget", "revenue", ["discount", "tax"])
    return found.select(
        "label", F.round("avg_budget", 2).alias("avg_budget"), F.round("avg_revenue", 2).alias("avg_revenue"),
        F.round("avg_discount", 6).alias("avg_discount"), F.round("avg_tax", 6).alias("avg_tax"), "n",
        F.round("roi", 6).alias("roi"),
    )


@query("""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 2) AS avg_o_totalprice, count(*) AS n FROM orders
    WHERE year(o_orderdate) BETWEEN 1960 AND 2017 GROUP BY 1 HAVING count(*) >= 10
""")
def yearly_metrics(spark, folder):
    rows = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    found = tables.yearly_metrics(rows, "year", ["o_totalprice"], 10, 1960, 2017)
    return found.select("year", F.round("avg_o_totalprice", 2).alias("avg_o_totalprice"), "n")


@query("""
    SELECT * FROM (SELECT o_custkey, o_totalprice, o_orderkey, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1)
    ORDER BY o_totalprice DESC, o_custkey LIMIT 20
""")
def best_per_key_topk(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderkey", "o_orderpriority")
    return tables.best_per_key(orders, "o_custkey", "o_totalprice", "o_orderkey", 20)


@query("""
    SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def newest_per_key(spark, folder):
    """The newest event of each user."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    newest = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r"))
    return newest.select("user_id", "r.event_id", "r.event_type")


@query("""
    SELECT * FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey, count(*) AS n,
           CAST(row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY count(*) DESC, l_suppkey) AS INTEGER) AS rank
    FROM lineitem GROUP BY year(l_shipdate), l_suppkey) WHERE rank <= 5
""")
def topk_per_group(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.year("l_shipdate").alias("year"), "l_suppkey")
    return tables.top_per_group(rows, "year", "l_suppkey", 5)


@query("""
    WITH r AS (SELECT l.l_returnflag AS flag, c.c_mktsegment AS segment, d.lang FROM documents d
               JOIN orders o ON d.doc_id = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
               JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
    SELECT lang, segment, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang), 6) AS share
    FROM r GROUP BY 1, 2
""")
def joined_shares(spark, folder):
    """Share of each customer segment within a language, over documents, orders and their lines."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    lines = table(spark, folder, "lineitem").select("l_orderkey")
    rows = (
        docs.join(orders, docs.doc_id == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(lines, lines.l_orderkey == orders.o_orderkey)
    )
    return tables.pair_shares(rows, "lang", "segment").withColumn("share", F.round("share", 6))


# ---------------------------------------------------------------- graphs

TOP_FIVE = """
    p AS (SELECT l_orderkey AS film, l_suppkey AS person, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_suppkey) AS r FROM lineitem QUALIFY r <= 5),
    edges AS (SELECT least(a.person, b.person) AS src, greatest(a.person, b.person) AS dst, count(*) AS weight
              FROM p a JOIN p b ON a.film = b.film AND a.r < b.r WHERE a.person <> b.person GROUP BY 1, 2)
"""


def _order_casts(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return graph.leading_people(lines, "l_orderkey", "l_suppkey", [F.col("l_linenumber"), F.col("l_suppkey")])


@query("""
    WITH p AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS r
               FROM lineitem QUALIFY r <= 5)
    SELECT o_custkey AS director, l_suppkey AS actor, count(*) AS n FROM orders JOIN p ON o_orderkey = l_orderkey
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20
""")
def pair_counts(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("director"))
    casts = _order_casts(spark, folder)
    rows = orders.join(casts, orders.o_orderkey == casts.l_orderkey).select("director", F.explode("people").alias("actor"))
    return tables.pair_counts(rows, "director", "actor", 20)


@query(f"WITH {TOP_FIVE} SELECT src, dst, weight FROM edges")
def co_edges(spark, folder):
    return graph.co_edges(_order_casts(spark, folder))


DEGREE_SQL = f"""
    WITH {TOP_FIVE},
    ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges),
    deg AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1),
    top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 100),
    sub AS (SELECT * FROM edges WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top))
"""


@query(DEGREE_SQL + "SELECT src, dst, weight, 0.5::DOUBLE + 0.5::DOUBLE * weight AS edge_width FROM sub")
def degree_subgraph(spark, folder):
    return graph.top_subgraph(graph.co_edges(_order_casts(spark, folder)), 100).withColumn(
        "edge_width", F.col("edge_width").cast("double"))


@query(DEGREE_SQL + """, inner_ends AS (SELECT src AS node FROM sub UNION ALL SELECT dst FROM sub)
    SELECT top.node, count(i.node) AS degree, 50 + 10 * count(i.node) AS node_size
    FROM top LEFT JOIN inner_ends i ON top.node = i.node GROUP BY 1
""")
def subgraph_nodes(spark, folder):
    return graph.subgraph_nodes(graph.co_edges(_order_casts(spark, folder)), 100)


def _part_edges(spark, folder):
    """Parts that are among the five dearest lines of a supplier."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
    casts = graph.leading_people(lines, "l_suppkey", "l_partkey", [F.desc("l_extendedprice"), F.col("l_partkey")])
    return graph.co_edges(casts)


COMPONENT_SQL = """
    WITH RECURSIVE p AS (SELECT l_suppkey AS film, l_partkey AS person, row_number() OVER (PARTITION BY l_suppkey
          ORDER BY l_extendedprice DESC, l_partkey) AS r FROM lineitem QUALIFY r <= 5),
    e AS (SELECT DISTINCT a.person AS x, b.person AS y FROM p a JOIN p b ON a.film = b.film AND a.person <> b.person),
    reach(node, root) AS (SELECT x, x FROM e UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node),
    labels AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
"""


@query(COMPONENT_SQL + "SELECT node, component FROM labels")
def components(spark, folder):
    return graph.components(_part_edges(spark, folder))


@query(COMPONENT_SQL + """SELECT node FROM labels WHERE component = (SELECT component FROM labels GROUP BY 1
    ORDER BY count(*) DESC, component LIMIT 1)""")
def largest_component(spark, folder):
    return graph.largest_component(graph.components(_part_edges(spark, folder)))


@query(COMPONENT_SQL + """,
    big AS (SELECT node FROM labels WHERE component = (SELECT component FROM labels GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)),
    people AS (SELECT DISTINCT film, person FROM p),
    edges AS (SELECT a.person AS src, b.person AS dst, count(*) AS weight FROM people a JOIN people b ON a.film = b.film AND a.person < b.person
              WHERE a.person IN (SELECT node FROM big) GROUP BY 1, 2),
    deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
    top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 100)
    SELECT src, dst, weight, 0.5::DOUBLE + 0.5::DOUBLE * weight AS edge_width FROM edges
    WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)
""")
def largest_subgraph(spark, folder):
    """The 100 parts of highest degree in the largest component; at any size there are more."""
    return graph.largest_subgraph(_part_edges(spark, folder), 100).withColumn("edge_width", F.col("edge_width").cast("double"))
