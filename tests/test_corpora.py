import pytest
from pyspark.sql import functions as F

from marquee.fixed_values import QUERY_TEMPLATES
from marquee import runtime
from marquee.operators import conversations, entities, summaries

SPANS = "array<struct<start:int,end:int,label:string>>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def dictionary(spark):
    return entities.fallback_dictionary(spark)


def test_dictionary_rules(spark):
    catalog = spark.createDataFrame([("A B", "C D, Al, E F"), ("A B", "C D"), ("", None), (None, "G H")], "director string, cast string")
    found = entities.entity_dictionary(catalog, "director", "cast", ["war", "war"])
    assert rows(found) == [("CAST", "C D"), ("CAST", "E F"), ("CAST", "G H"), ("DIRECTOR", "A B"), ("GENRE", "war")]


def test_generated_queries_are_valid_and_tagged_back(spark):
    names = dictionary(spark)
    made = entities.generate_queries(spark.range(600), "id", names)
    assert made.count() == 600
    valid = entities.spans_valid(F.col("text"), F.col("entities"))
    assert made.filter(valid).count() == 600
    texts = [r["text"] for r in made.collect()]
    assert not any("{" in t for t in texts) and len({t.split(" ")[0] for t in texts}) == 3
    # every span is an entity of its label
    spans = made.select("id", "text", F.inline("entities")).withColumn("entity", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    assert spans.join(names, ["label", "entity"], "left_anti").count() == 0
    two = [i for i, (_, s) in enumerate(QUERY_TEMPLATES) if len(s) == 2]
    assert len(two) == 5
    # two names of one kind differ
    assert spans.groupBy("id", "label", "entity").count().filter("count > 1").count() == 0
    tags = entities.tag(made.select("id", "text"), "id", "text", names)
    score = entities.span_scores(made.select("id", F.inline("entities")), tags, "id").first()
    assert score["fn"] == 0 and score["recall"] == 1.0 and score["precision"] == 1.0


def test_spans_avoid_overlap(spark):
    picks = F.array(
        F.struct(F.lit("warm war").alias("entity"), F.lit("DIRECTOR").alias("label")),
        F.struct(F.lit("war").alias("entity"), F.lit("GENRE").alias("label")),
    )
    df = spark.createDataFrame([(1, "a warm war and war"), (2, "a warm war only"), (3, "war, warm war")], "id int, text string")
    found = entities.mark_spans(df.withColumn("picks", picks), "id", "text", "picks")
    got = {r["id"]: [tuple(s) for s in r["entities"]] for r in found.collect()}
    assert got == {1: [(2, 10, "DIRECTOR"), (15, 18, "GENRE")], 2: [(2, 10, "DIRECTOR")], 3: [(0, 3, "GENRE"), (5, 13, "DIRECTOR")]}


def test_spans_of_any_number_of_picks(spark):
    names = ["A", "B", "C", "", "A", None]
    picks = F.array(*[F.struct(F.lit(n).cast("string").alias("entity"), F.lit("CAST").alias("label")) for n in names])
    df = spark.createDataFrame([(1, "A B C A"), (2, "C"), (3, None)], "id int, text string")
    found = entities.mark_spans(df.withColumn("picks", picks), "id", "text", "picks")
    got = {r["id"]: [tuple(s)[:2] for s in r["entities"]] for r in found.collect()}
    assert got == {1: [(0, 1), (2, 3), (4, 5), (6, 7)], 2: [(0, 1)], 3: []}


def test_tagging_of_real_text(spark):
    names = spark.createDataFrame([("CAST", "Tom Hanks"), ("GENRE", "drama"), ("GENRE", "comedy")], "label string, entity string")
    df = spark.createDataFrame([
        (1, "I like\nTom\t Hanks movies"), (2, "films of Tom Hanks's"), (3, "drama/comedy by \u201cTom Hanks\u201d."), (4, "Tom Hanks\u2019s  (drama)"),
    ], "id int, text string")
    assert rows(entities.tag(df, "id", "text", names).select("id", "start", "end", "surface")) == [
        (1, 7, 17, "Tom\t Hanks"), (2, 9, 18, "Tom Hanks"), (3, 0, 5, "drama"), (3, 6, 12, "comedy"), (3, 17, 26, "Tom Hanks"),
        (4, 0, 9, "Tom Hanks"), (4, 14, 19, "drama"),
    ]


def test_span_validation(spark):
    df = spark.createDataFrame([
        ("Find action movies", [(5, 11, "GENRE")]), ("I love sci-fi films by Ridley Scott", [(7, 13, "GENRE"), (23, 35, "DIRECTOR")]),
        ("I want movies directed by James Cameron", [(27, 40, "DIRECTOR")]), ("abcdef", [(0, 3, "X"), (2, 4, "Y")]),
        ("abc", [(2, 2, "X")]), ("abc", [(-1, 2, "X")]), ("abc", []),
    ], f"text string, entities {SPANS}")
    assert [r[0] for r in df.select(entities.spans_valid(F.col("text"), F.col("entities"))).collect()] == [True, True, False, False, False, False, True]


@pytest.mark.parametrize("hot", [200_000, 2])
def test_tagging_takes_longest_first(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    names = spark.createDataFrame([("CAST", "Michael B. Jordan"), ("CAST", "Jordan Peele"), ("GENRE", "drama"), ("GENRE", "crime drama")], "label string, entity string")
    df = spark.createDataFrame([
        (1, "films with michael b. jordan peele, (crime Drama)!"), (2, "nothing here"), (3, "Drama"), (4, "drama drama"), (5, None),
    ], "id int, text string")
    tags = entities.tag(df, "id", "text", names)
    assert rows(tags) == [
        (1, 11, 28, "CAST", "michael b. jordan"), (1, 37, 48, "GENRE", "crime Drama"), (3, 0, 5, "GENRE", "Drama"),
        (4, 0, 5, "GENRE", "drama"), (4, 6, 11, "GENRE", "drama"),
    ]
    grouped = {r["id"]: (r["DIRECTOR"], r["CAST"], r["GENRE"]) for r in entities.grouped_entities(tags, "id").collect()}
    assert grouped[1] == ([], ["michael b. jordan"], ["crime Drama"]) and grouped[4][2] == ["drama", "drama"]
    assert rows(entities.compare_taggers(tags, tags.filter("label = 'CAST'"))) == [("CAST", 1, 1), ("GENRE", 4, 0)]
    assert entities.tag(df, "id", "text", names.limit(0)).count() == 0


# ---------------------------------------------------------------- summaries


def test_corpus_rules(spark):
    df = spark.createDataFrame([(1, "T", "w " * 25), (2, None, "w " * 25), (3, "U", "short"), (4, "V", None)], "id int, title string, plot string")
    assert rows(summaries.corpus(df, "id", "title", "plot").select("id")) == [(1,)]


def test_generation_keeps_going_after_a_failure(spark):
    def make(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 7 else f"t{i}") for i in range(25)], "id int, plot string").coalesce(1)
    found = {r["id"]: (r["summary"], r["error"]) for r in summaries.generate(df, "plot", make, 10).collect()}
    assert found[7] == (None, "no") and found[6] == ("T6", None) and len(found) == 25
    assert summaries.lead_sentences(2)(["One. Two!  Three? Four."]) == ["One. Two!"]


def test_latest_and_split(spark):
    df = spark.createDataFrame([("A", "2024-01-02", 1, "new"), ("A", "2024-01-01", 2, "old"), ("B", "2024-01-01", 3, "b")], "title string, t string, id int, s string")
    assert rows(summaries.latest_per_title(df, "title", "t", "id").select("title", "s")) == [("A", "new"), ("B", "b")]


def test_padded_ids(spark):
    df = spark.createDataFrame([(1, "b a a c"), (2, "a"), (3, ""), (4, None)], "id int, text string")
    df = df.withColumn("text", F.regexp_replace("text", "([abc])", "$1$1"))
    terms = summaries.token_vocabulary(df, "text", 2)
    assert rows(terms) == [("aa", 2), ("bb", 3)]
    assert rows(summaries.padded_ids(df, "id", "text", terms, 3)) == [(1, [3, 2, 2]), (2, [2, 0, 0]), (3, [0, 0, 0]), (4, [0, 0, 0])]
    empty = summaries.padded_ids(df, "id", "text", terms.limit(0), 2)
    assert rows(empty) == [(1, [1, 1]), (2, [1, 0]), (3, [0, 0]), (4, [0, 0])]


def test_padded_ids_joined_are_the_same(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9)) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(texts, "id int, text string").repartition(4)
    terms = summaries.token_vocabulary(df, "text", 10)
    looked_up = rows(summaries.padded_ids(df, "id", "text", terms, 6))
    monkeypatch.setattr(summaries, "VOCABULARY_BYTES", 0)
    assert rows(summaries.padded_ids(df, "id", "text", terms, 6)) == looked_up


def test_length_report(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b"), (2, "", None)], "id int, a string, b string")
    assert rows(summaries.length_report(df, "id", "a", "b")) == [(1, 4, 2, 0.5), (2, 0, 0, None)]


# ---------------------------------------------------------------- conversations


def test_conversations(spark):
    log = spark.createDataFrame(
        [(1, 0, "system", "s")] + [(1, 2 * i + 1, "user", "any film?" if i == 0 else f"hello {i}") for i in range(4)]
        + [(1, 2 * i + 2, "assistant", f"a{i}") for i in range(3)] + [(2, 0, "user", "hi")],
        "conv_id int, turn int, role string, text string",
    )
    turns = conversations.with_route(conversations.exchanges(log))
    stats = {r["conv_id"]: tuple(r) for r in conversations.conversation_stats(turns, F.col("routed") == 1).select("conv_id", "total_turns", "database_accesses", "efficiency", "started_at").collect()}
    assert stats == {1: (1, 4, 1, 75.0, 1), 2: (2, 1, 0, 100.0, 0)}
    assert rows(conversations.last_turns(turns, 2).select("conv_id", "turn")) == [(1, 5), (1, 7), (2, 0)]
    current = spark.createDataFrame([(1, "now?"), (3, "first?")], "conv_id int, query string")
    prompts = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in conversations.prompt_messages(turns, current, "sys", 2).collect()}
    assert prompts == {
        1: [("system", "sys"), ("user", "hello 2"), ("assistant", "a2"), ("user", "hello 3"), ("assistant", ""), ("user", "now?")],
        3: [("system", "sys"), ("user", "first?")],
    }
    records = conversations.turn_record(turns, F.lit(None).cast("int"), F.col("routed")).filter("turn = 1").first()
    assert (records["calls"], records["database_accessed"], records["num_retrieved"]) == (1, 1, 0)
    timed = log.filter("conv_id = 1").withColumn("at", F.timestamp_seconds(F.col("turn") * 3 + 100))
    found = conversations.turn_record(conversations.exchanges(timed, "at"), F.lit(0), F.lit(0))
    seconds = {r["turn"]: (r["s"], r["processing_seconds"]) for r in found.withColumn("s", F.unix_seconds("asked_at")).collect()}
    assert seconds == {1: (103, 3.0), 3: (109, 3.0), 5: (115, 3.0), 7: (121, None)}
    results = spark.createDataFrame([(1, [["a", "b"], ["c"], []]), (2, []), (3, None)], "id int, r array<array<string>>")
    assert rows(results.select("id", conversations.retrieved_rows(F.col("r")))) == [(1, 3), (2, 0), (3, 0)]


def test_bloom_filter_loses_nothing(spark):
    names = spark.range(3000).selectExpr("concat('name ', id) AS run").repartition(5)
    field = entities.bloom_filter(names, "run", 3000)
    every = spark.range(30_000).selectExpr("concat('name ', id) AS run", "id")
    left = {r["id"] for r in entities.may_hold(every, "run", field).collect()}
    assert set(range(3000)) <= left and len(left) < 3000 + 27_000 * 0.05


def test_large_dictionaries_tag_as_small_ones_do(spark, monkeypatch):
    names = spark.createDataFrame(
        [("CAST", "Ann Lee"), ("CAST", "Lee"), ("GENRE", "sci-fi"), ("DIRECTOR", "Ann Lee Park"), ("GENRE", "war")], "label string, entity string"
    )
    texts = [(1, "Films by Ann Lee Park/Lee and \"war\" or sci-fi's best, Ann  Lee!"), (2, None), (3, ""), (4, "Lee " * 500), (5, "nothing here")]
    df = spark.createDataFrame(texts, "id int, text string")

    def found():
        return sorted((r["id"], r["start"], r["end"], r["label"], r["surface"]) for r in entities.tag(df, "id", "text", names).collect())

    small = found()
    assert [(x[3], x[4]) for x in small if x[0] == 1][:3] == [("DIRECTOR", "Ann Lee Park"), ("CAST", "Lee"), ("GENRE", "war")]
    assert all(texts[x[0] - 1][1][x[1] : x[2]] == x[4] for x in small) and sum(x[0] == 4 for x in small) == 500
    monkeypatch.setattr(entities, "BROADCAST_BYTES", 0)
    assert found() == small


def test_tagging_in_place_shuffles_nothing_and_cuts_long_batches(spark, monkeypatch):
    names = spark.createDataFrame(
        [("CAST", "a b"), ("GENRE", "b c d"), ("DIRECTOR", "d"), ("CAST", "é x")], "label string, entity string"
    )
    texts = [(1, "a b c d"), (2, None), (3, "a b d d"), (4, ""), (5, "É X, (a b)"), (6, "a"), (7, "b c")]
    df = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    want = [(1, 2, 7, "GENRE", "b c d"), (3, 0, 3, "CAST", "a b"), (3, 4, 5, "DIRECTOR", "d"), (3, 6, 7, "DIRECTOR", "d"),
            (5, 0, 3, "CAST", "É X"), (5, 6, 9, "CAST", "a b")]
    for words in (1, 5, 1 << 17):
        monkeypatch.setattr(entities, "PIECE_WORDS", words)
        for most in (32 << 20, 0):
            monkeypatch.setattr(entities, "BROADCAST_BYTES", most)
            tags = entities.tag(df, "id", "text", names)
            assert rows(tags) == want
            assert ("Exchange" in tags._jdf.queryExecution().toString()) == (most == 0)


def test_names_of_small_and_large_kinds_are_drawn_alike(spark, monkeypatch):
    names = entities.fallback_dictionary(spark)
    made = entities.generate_queries(spark.range(300), "id", names)
    assert "template#" not in made._jdf.queryExecution().optimizedPlan().toString()  # no text is shuffled but the names
    whole = sorted(map(str, made.collect()))
    monkeypatch.setattr(entities, "BROADCAST_ROWS", 0)
    assert len(whole) == 300 and sorted(map(str, entities.generate_queries(spark.range(300), "id", names).collect())) == whole
