from pyspark.sql import functions as F

from marquee.functions import credits, labels, text, values


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()["y"]


def test_canonical_labels(spark):
    cases = {
        "Romantic Comedy": ["comedy", "romance"], "Sci-Fi/Action": ["action", "sci-fi"], "warm tale": ["war"],
        "xyz": ["unknown"], None: ["unknown"], "drama; Musicals": ["drama", "music"],
    }
    for given, expected in cases.items():
        assert one(spark, labels.canonical_labels, given) == expected


def test_clean_label_list(spark):
    assert one(spark, labels.clean_label_list, "[Action]/Sci-Fi & (War), x!") == ["action", "scifi", "war", "x"]
    assert one(spark, labels.clean_label_list, None) == []


def test_map_to_main(spark):
    given = ["kung fu", "comedyy", "zzz", "romance", "scifi", ""]
    # scifi: one insertion in six letters is 83.3
    assert one(spark, labels.map_to_main, given, "array<string>") == ["action", "comedy", "romance", "sci-fi"]


def test_list_literals(spark):
    assert one(spark, labels.parse_list_literal, """['a b', "it's", 'x\\'y']""") == ["a b", "it's", "x'y"]
    assert one(spark, labels.parse_list_literal, "a, b") == []
    df = spark.createDataFrame([("['p', 'q']",), ("p, q",)], "l string")
    assert [r[0] for r in df.select(labels.as_label_array(df, "l")).collect()] == [["p", "q"]] * 2


def test_cast_lines(spark):
    cases = {
        "Director: A B\r\nCast: C D, E F": ("A B", ["C D", "E F"]),
        "C D, E F": (None, ["C D", "E F"]), "Director: A B": ("A B", []), None: (None, []),
    }
    for given, expected in cases.items():
        found = one(spark, lambda c: F.struct(credits.director_of_line(c), credits.cast_of_line(c)), given)
        assert tuple(found) == expected


def test_credits(spark):
    crew = """[{"name":"W","job":"Writer"},{"name":"A","job":"Director"},{"name":"B","job":"Director"}]"""
    def directors(c):
        people = credits.parse_objects(c, credits.CREW_SCHEMA)
        return F.struct(credits.first_with_job(people), credits.all_with_job(people))
    assert tuple(one(spark, directors, crew)) == ("A", "A, B")
    assert tuple(one(spark, directors, "[")) == (None, "")
    assert tuple(one(spark, directors, None)) == (None, "")
    cast = """[{"name":"A"},{"character":"x"},{"name":"C"},{"name":"D"}]"""
    names = lambda c: credits.top_names(credits.parse_objects(c, credits.CAST_SCHEMA), 3)
    assert one(spark, names, cast) == ["A", "C"]
    assert one(spark, names, cast.replace('"A"', "\"O''N\"")) == ["O'N", "C"]
    assert one(spark, lambda c: credits.names_of(credits.parse_objects(c, credits.NAMED_SCHEMA)), """[{"id":1,"name":"Drama"}]""") == ["Drama"]
    assert [one(spark, credits.gender_label, g, "int") for g in (1, 2, 0, None)] == ["Female", "Male", "Unknown", "Unknown"]


def test_text(spark):
    assert one(spark, text.clean_text, " <b>It's</b>\n 3 CATS ") == "its cats"
    assert one(spark, text.clean_text, None) == ""
    assert one(spark, text.keep_tokens, "the cats ran to 9th street") == "cats ran street"
    assert one(spark, lambda c: text.keep_tokens(c, lemmas={"cats": "cat"}), "the cats ran") == "cat ran"
    assert one(spark, text.strip_accents, "Amélie Ångström é ß") == "Amelie Angstrom e ß"
    assert one(spark, text.word_tokens, "The Café, a straße 42") == ["cafe", "straße", "42"]
    assert [one(spark, text.word_count, t) for t in ("", "  ", " a  b ", None)] == [0, 0, 2, 0]
    assert one(spark, lambda c: text.truncate(c, 3), "abcd") == "abc..."
    assert one(spark, lambda c: text.truncate(c, 4), "abcd") == "abcd"
    assert one(spark, lambda c: text.highlight(c, F.lit("nolan (x$)")), "By Nolan (X$) and NOLAN") == "By **nolan (x$)** and NOLAN"
    assert one(spark, text.has_keyword, "Any good films?") is True
    assert one(spark, text.has_keyword, "hello") is False
    assert one(spark, text.safe_name, "Linear SVM-x") == "linear_svm_x"
    assert one(spark, lambda c: text.guarded_summary(c, F.lit("p" * 300)), "Summarize: it is all here") == "p" * 200 + "..."
    assert one(spark, lambda c: text.guarded_summary(c, F.lit("p")), " long enough text ") == "long enough text"
    prompt = one(spark, lambda c: text.summary_prompt(c, F.lit("Once."), 150), "T")
    assert 'movie "T"' in prompt and "approximately 75 words" in prompt and "Original plot: Once." in prompt
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(" s ").alias("text")), F.struct(F.lit("user").alias("role"), F.lit("u").alias("text")))
    assert one(spark, lambda c: text.transcript(messages), "") == "[System]\ns\n\n[User]\nu\n\n[Assistant]\n"


def test_embedding_text(spark):
    found = one(spark, lambda c: text.embedding_text(c, F.lit("D"), F.lit("drama"), F.lit(1999), F.repeat(F.lit("x"), 1200)), "T")
    assert found == "The movie titled 'T' was directed by D. It falls under the 'drama' genres and was released in 1999. Plot summary: " + "x" * 1000


def test_entity_predicates(spark):
    rows = [("Christopher Nolan",), (None,)]
    df = spark.createDataFrame(rows, "d string")
    wanted = F.array(F.lit("nolan"))
    none = F.array().cast("array<string>")
    assert [r[0] for r in df.select(text.matches_entities(F.col("d"), wanted)).collect()] == [True, False]
    assert [r[0] for r in df.select(text.matches_entities(F.col("d"), none)).collect()] == [True, True]
    films = spark.createDataFrame([
        ("Inception", 2010, "Sci-Fi", "Christopher Nolan"), ("The Matrix", 1999, "Sci-Fi", "Wachowski Sisters"),
        ("Interstellar", 2014, "Sci-Fi", "Christopher Nolan"), ("Blade Runner 2049", 2017, "Sci-Fi", "Denis Villeneuve"),
        ("Dune", 2021, "Sci-Fi", "Denis Villeneuve"),
    ], "title string, year int, genre string, director string")
    search = lambda q: films.filter(text.any_field_contains([F.col("title"), F.col("genre"), F.col("director")], F.lit(q))).count()
    assert (search("christopher nolan"), search("sci-fi")) == (2, 5)


def test_values(spark):
    assert one(spark, values.to_number, "x") is None and one(spark, values.to_number, "7") == 7.0
    assert one(spark, values.year_of, "2010-07-16") == 2010 and one(spark, values.year_of, "soon") is None
    assert one(spark, values.decade_of, 1999, "int") == 1990
    assert one(spark, lambda c: values.return_on(c, F.lit(0.0)), 5.0, "double") is None
    assert one(spark, lambda c: values.decode(c, {"a": "A"}, "?"), "b") == "?"
    assert one(spark, lambda c: values.default_to(c, 5), 0, "int") == 0
