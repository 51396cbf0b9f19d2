"""Repeats of a host by the suffix array, against a plain search, and what they take from pages."""

import math

import numpy as np

from marquee.llm import pages, suffixes


def _plain(streams, run, contents, share):
    """For each suffix the longest prefix of run, 2 run, 4 run, ... tokens that enough streams of the host hold."""
    out = {}
    for host in {h for h, _, _ in streams}:
        own = {c: s.split() for h, c, s in streams if h == host}
        least = max(contents, math.ceil(share * len(own)))
        for content, tokens in own.items():
            spans = []
            for at in range(len(tokens)):
                width, length = run, 0
                while at + width <= len(tokens):
                    part = tokens[at : at + width]
                    if sum(any(t[j : j + width] == part for j in range(len(t) - width + 1)) for t in own.values()) < least:
                        break
                    length, width = width, 2 * width
                if length:
                    spans.append((at, length))
            if spans:
                out[host, content] = spans
    return out


def test_repeats_equal_a_plain_search(spark):
    r = np.random.default_rng(1)
    streams = []
    for host in "ab":
        parts = [" ".join(f"{host}{x}" for x in r.integers(0, 2, n)) for n in (3, 11, 20, 24)]
        streams += [(host, c, " ".join([*r.choice(parts, 2), *map(str, r.integers(0, 9, 3)), *r.choice(parts, 1)])) for c in range(10)]
    df = spark.createDataFrame(streams, "host string, content long, stream string")
    found = {(x.host, x.content): [tuple(s) for s in x.spans] for x in suffixes.repeats(df, 3, 3, 0.4).collect()}
    assert found == _plain(streams, 3, 3, 0.4)
    assert {length for spans in found.values() for _, length in spans} >= {3, 6, 12}


def test_every_page_goes_through_the_suffix_array(spark):
    menu = " ".join(f"link{i}" for i in range(20))
    rows = [(i, f"http://h.org/{i}", f"<nav>{menu} own{i}</nav><article>text{i} {menu}</article>") for i in range(4)]
    rows += [(9, "http://h.org/9", f"<p>{menu} last</p>"), (10, "http://k.org/", f"<nav>{menu}</nav><article>x</article>")]
    found = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i].text for i in range(4)] == [f"text{i} {menu}" for i in range(4)] and found[9].text == "last"
    assert {i: r.n_repeated for i, r in found.items()} == {0: 20, 1: 20, 2: 20, 3: 20, 9: 20, 10: 0}


def _pages(spark, rows, **more):
    return {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **more).collect()}


def test_equal_menus_of_different_articles_are_repeated(spark):
    menu = " ".join(f"link{i}" for i in range(20))
    rows = [(i, f"http://h.org/{i}", f"<nav>{menu}</nav><article>text{i}</article>") for i in range(4)]
    rows += [(9, "http://h.org/9", f"<p>{menu} last</p>")] + [(20 + i, f"http://c.org/{i}", f"<nav>{menu}</nav><article>copy</article>") for i in range(4)]
    found = _pages(spark, rows)
    assert found[9].text == "last" and [found[i].n_repeated for i in (0, 1, 2, 3, 9)] == [20] * 5
    assert [found[20 + i].n_repeated for i in range(4)] == [0] * 4


def test_articles_go_through_the_suffix_array_and_stay_whole(spark):
    said = " ".join(f"said{i}" for i in range(12))
    rows = [(i, f"http://h.org/{i}", f"<main><p>own{i}</p><p>{said}</p><p>end{i}</p></main><p>{said}</p>") for i in range(3)]
    rows += [(3, "http://h.org/3", f"<p>{said} {said}</p>"), (4, "http://k.org/", f"<article>{said}</article>")]
    rows += [(5 + i, f"http://l.org/{i}", f"<nav>{i}</nav><article>{said}</article>") for i in range(4)]
    rows += [(10 + i, f"http://m.org/{i}", f"<article>own{i} {said}</article>") for i in range(4)] + [(14, "http://m.org/", f"<p>{said}</p>")]
    found = _pages(spark, rows)
    assert [found[i].n_repeated_main for i in (0, 1, 2, 3, 4, 5, 8, 10, 13, 14)] == [12, 12, 12, 0, 0, 0, 0, 12, 12, 0]
    assert [found[i].n_repeated for i in range(5)] == [12, 12, 12, 24, 0]
    assert all(found[i].text == f"own{i}\n\n{said}\n\nend{i}" for i in range(3)) and found[3].text == "" and found[14].text == said


def test_large_tables_are_joined(spark, monkeypatch):
    r = np.random.default_rng(3)
    parts = [" ".join(f"w{x}" for x in r.integers(0, 50, n)) for n in (9, 17, 40, 70)]
    draw = lambda: " ".join([*map(str, r.integers(0, 99, 4)), *r.choice(parts, 2)])
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<p>{draw()}</p>" + (f"<article>{draw()}</article>" if i % 3 else "")) for i in range(60)]
    small = _pages(spark, rows)
    for module, name in ((suffixes, "LOOKUP_BYTES"), (pages, "BROADCAST_BYTES")):
        monkeypatch.setattr(module, name, -1)
    assert _pages(spark, rows) == small and sum(x.n_repeated_main for x in small.values()) > 500
    streams = [("h", i, draw()) for i in range(12)] * 2
    df = spark.createDataFrame(streams, "host string, content long, stream string")
    found = {(x.host, x.content): [tuple(s) for s in x.spans] for x in suffixes.repeats(df, 8, 3, 0.01).collect()}
    assert found == _plain(streams[:12], 8, 3, 0.01)


def test_the_filter_lets_every_repeat_through(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HELD_MARKS", 1 << 12)
    r = np.random.default_rng(5)
    phrase = " ".join(f"p{i}" for i in range(8))
    streams = [(f"h{i % 2}", i, " ".join([*map(str, r.integers(0, 10**9, 60)), phrase if i < 6 else "", *map(str, r.integers(0, 10**9, 60))])) for i in range(400)]
    df = spark.createDataFrame(streams, "host string, content long, stream string")
    assert sum(len(x.places) for x in suffixes.windows(df, 8, 3).collect()) < 200
    found = {(x.host, x.content): [tuple(s) for s in x.spans] for x in suffixes.repeats(df, 8, 3, 0.01).collect()}
    assert found == {(f"h{i % 2}", i): [(60, 8)] for i in range(6)}
