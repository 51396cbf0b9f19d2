"""Operator 5: an edit of one word changes the likeness little, wherever it stands."""

from marquee.llm import fingerprints


def test_one_word_put_in_front_of_a_long_line(spark):
    words = [f"word{i * i % 97}{'abcdefgh'[i % 8]}" for i in range(400)]
    text = " ".join(words)
    rows = [(1, text), (2, "extra " + text), (3, " ".join(words[:200] + ["more"] + words[200:])), (4, " ".join(f"other{i}z" for i in range(400)))]
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] > 0.75 and got[2] > 0.75 and got[3] < 0.4
