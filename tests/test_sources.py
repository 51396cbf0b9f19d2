import datetime
import json

import pytest

import __spark_entry__ as entry
from marquee.sources import readers, sinks

WIKI = '''Title,Release Year,Origin/Ethnicity,Director,Cast,Genre,Wiki Page,Plot
"The ""Big"" One",1999,American,A B,"C D, E F",Romantic Comedy,http://x,"Line one.
Line two, with comma."
Odd,unknown,British,,,,http://y,
'''
CREDITS = '''movie_id,title,cast,crew
7,Heat,"[{""name"": ""A""}, {""name"": ""B""}, {""name"": ""C""}, {""name"": ""D""}, {""name"": ""E""}, {""name"": ""F""}]","[{""job"": ""Director"", ""name"": ""M""}, {""job"": ""Writer"", ""name"": ""W""}]"
8,Broken,[,
'''


def test_film_table(spark, tmp_path):
    path = tmp_path / "wiki.csv"
    path.write_text(WIKI)
    rows = readers.load(spark, str(path)).collect()
    assert rows[0]["title"] == 'The "Big" One' and rows[0]["plot"] == "Line one.\nLine two, with comma."
    assert (rows[0]["year"], rows[0]["genre"]) == (1999, ["comedy", "romance"])
    assert (rows[1]["year"], rows[1]["genre"], rows[1]["director"]) == (None, ["unknown"], None)
    with pytest.raises(ValueError, match="unsupported data source"):
        readers.load(spark, str(path), "imdb")
    with pytest.raises(ValueError, match="missing columns: nope"):
        readers.read_csv(spark, str(path), "nope string")


def test_credits_and_fallback(spark, tmp_path):
    path = tmp_path / "credits.csv"
    path.write_text(CREDITS)
    rows = {r["id"]: r for r in readers.load(spark, str(path), "tmdb").collect()}
    assert (rows[7]["director"], rows[7]["cast_names"]) == ("M", "A, B, C, D, E")
    assert (rows[8]["director"], rows[8]["cast_names"]) == ("", "")
    spare = lambda: spark.createDataFrame([("spare",)], "title string")
    assert readers.load_or(spark, str(tmp_path / "none.csv"), readers.read_credits, spare).first()["title"] == "spare"
    assert readers.load_or(spark, str(path), readers.read_credits, spare).count() == 2


def test_headerless_lookup(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("American,United States\nFrench,France\n")
    assert [tuple(r) for r in readers.read_lookup(spark, str(path)).collect()] == [("American", "United States"), ("French", "France")]


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"", ["x", "y"])], "t string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = readers.read_csv(spark, str(tmp_path / "out"), "t string, l string").first()
    assert (back["t"], json.loads(back["l"])) == ('a,"b"', ["x", "y"])


def test_keyed_summaries(spark, tmp_path):
    path = tmp_path / "s.json"
    records = {f"T{i}": {"original_plot": "p", "summary": f"s{i}", "timestamp": f"2024-01-0{i + 1}T00:00:00"} for i in range(3)}
    path.write_text(json.dumps(records, indent=2))
    df = readers.read_summaries(spark, str(path))
    assert sorted(r["summary"] for r in df.collect()) == ["s0", "s1", "s2"]
    assert df.filter("title = 'T1'").first()["timestamp"] == datetime.datetime(2024, 1, 2)
    sinks.write_summaries(df, str(tmp_path / "out"))
    assert sorted(map(str, readers.read_summaries(spark, str(tmp_path / "out"), per_line=True).collect())) == sorted(map(str, df.collect()))


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert sinks.load_snapshot(spark, path) is None
    df = spark.createDataFrame([(1, [0.5, 1.5])], "id int, embedding array<double>")
    sinks.save_snapshot(df, path, model="hashed")
    back, info = sinks.load_snapshot(spark, path)
    assert back.first()["embedding"] == [0.5, 1.5] and info == {"columns": ["id", "embedding"], "model": "hashed"}
    sinks.save_parameters(spark, path + "/p", {"threshold": 0.7, "k": 5})
    assert sinks.load_parameters(spark, path + "/p") == {"threshold": 0.7, "k": 5}


def test_entry_and_names(spark):
    found = entry.entry(spark)
    assert found.columns == ["lang", "segment", "n", "share"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
