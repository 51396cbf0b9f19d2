"""Main text of web pages: markup, and what pages of a host repeat, by a suffix array (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import prepare
from marquee.llm.markup import blocks
from marquee.llm.suffixes import repeats
from marquee.runtime import input_bytes, skew_join, write_once

RUN = 8
PAGES = 3
SHARE = 0.01
BROADCAST_BYTES = 8 << 20


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def _parsed(df: DataFrame) -> DataFrame:
    """(page_id, url, host, main, free, beside, outside, article): blocks by zone; a hash of what stands outside the article and in it, and one of the article.

    A page without a host, or without text in the zone, has null there.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [blocks(page) for page in frame["html"]]
            out = frame.drop(columns="html")
            for i, name in enumerate(("main", "free", "beside")):
                out[name] = pd.Series([f[i] for f in found], dtype=object, index=out.index)
            yield out

    rows = df.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        _host(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    zones = rows.mapInPandas(
        parse, "page_id long, url string, host string, main array<string>, free array<string>, beside array<string>"
    )
    outside, article = _stream("free", "beside"), _stream("main")
    return zones.withColumns({
        "outside": F.when((F.col("host") != "") & (outside != ""), F.xxhash64(F.lower(outside), F.lower(article))),
        "article": F.when((F.col("host") != "") & (article != ""), F.xxhash64(F.lower(article))),
    })


def _stream(*zones: str) -> Column:
    return F.array_join(F.concat(*zones), " ")


def _covers(spans: DataFrame) -> DataFrame:
    """(host, content, n, spans): overlapping spans as one, and how many tokens lie in them."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            at, length = (x.to_numpy() for x in lists.flatten().flatten())
            begin = (row << 32) + at
            reach = np.maximum.accumulate(begin + length)
            new = np.ones(len(begin), bool)
            new[1:] = begin[1:] > reach[:-1]
            first = np.flatnonzero(new)
            size = reach[np.append(first[1:], len(begin)) - 1] - begin[first] if len(first) else first
            ends = np.cumsum(np.bincount(row[first], minlength=len(batch)))
            n = np.bincount(row[first], size, len(batch)).astype(np.int64)
            united = pa.StructArray.from_arrays([pa.array(at[first], pa.int32()), pa.array(size, pa.int32())], names=["at", "length"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), united)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), lists], names=["host", "content", "n", "spans"]
            )

    return spans.mapInArrow(unite, "host string, content long, n long, spans array<struct<at:int,length:int>>")


def _joined(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a written table that is broadcast while it takes little, so that no text is shuffled then."""
    if input_bytes(rows.sparkSession, found.written_to) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), keys, "left")
    return skew_join(rows, found, keys, "left")


def _covered(spans: list | None) -> set[int]:
    """The places of all tokens that lie in one of the (at, length) spans."""
    gone: set[int] = set()
    for span in () if spans is None else spans:
        gone.update(range(span["at"], span["at"] + span["length"]))
    return gone


def _without(texts: list[str], gone: set[int]) -> list[str]:
    """The blocks without the tokens at these places; what is left of a block stays a block."""
    out, at = [], 0
    for text in texts:
        tokens = text.split()
        kept = " ".join(t for i, t in enumerate(tokens, at) if i not in gone)
        at += len(tokens)
        if kept:
            out.append(kept)
    return out


def main_text(df: DataFrame, run: int = RUN, pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """Per page: (page_id, url, text, n_chars, n_repeated, n_repeated_main): the article's blocks joined by blank lines.

    Scripts, styles, comments and markup go; so do elements beside the article: menus, page headers, footers,
    sidebars, forms, notices, adverts, reader comments, by tag or by the words of class, id and role, and hidden ones. What
    stands in an article or main element is the text, whole. A page without such an element keeps its remaining blocks, less
    every run of ``run`` or more tokens that its host repeats: that stand outside the article in ``pages`` or more different pages of the
    host, and in ``share`` of them or more. A phrase that two pages have in common stays.

    All text of all pages with a host goes through the suffix array of their host (``suffixes.repeats``), what stands outside the article and the
    article each among their like. Outside, pages with equal text count once, article included, so copies of a page do not empty each
    other, while one menu over many articles is repeated. Equal articles count once. ``n_repeated`` is the number of a page's tokens outside the article
    that lie in a repeated run, ``n_repeated_main`` that of the article's tokens; these stay in the text.

    Character references are decoded, white space inside a block becomes one blank. A null or empty html gives an
    empty text. Pages whose url is null or names no host have no host and no repeats. Each row is returned. Other columns
    play no part.
    """
    prepare(df.sparkSession)
    parsed = write_once(_parsed(df), compression="zstd")
    # no host holds a slash
    streams = parsed.filter(F.col("outside").isNotNull()).select("host", F.col("outside").alias("content"), _stream("free", "beside").alias("stream"))
    streams = streams.unionAll(
        parsed.filter(F.col("article").isNotNull()).select(F.concat("host", F.lit("/")), "article", _stream("main"))
    )
    covers = write_once(_covers(repeats(streams, run, pages, share)))
    in_article = F.col("host").endswith("/")
    outside = write_once(covers.filter(~in_article).select("host", F.col("content").alias("outside"), F.col("n").alias("n_repeated"), "spans"))
    article = write_once(covers.filter(in_article).select(
        F.rtrim(F.col("host"), F.lit("/")).alias("host"), F.col("content").alias("article"), F.col("n").alias("n_repeated_main")
    ))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [
                "\n\n".join(_without(list(free), _covered(spans))) if text is None else text
                for text, free, spans in zip(frame["text"], frame["free"], frame["spans"])
            ]
            yield frame[["page_id", "url"]].assign(text=texts, n_repeated=frame["n_repeated"], n_repeated_main=frame["n_repeated_main"])

    bare = F.size("main") == 0
    rows = parsed.select(
        "page_id", "url", "host", "outside", "article",
        F.when(~bare, F.array_join("main", "\n\n")).alias("text"), F.when(bare, F.col("free")).alias("free"),
    )
    rows = _joined(_joined(rows, outside, ["host", "outside"]), article, ["host", "article"])
    counts = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("n_repeated", "n_repeated_main")]
    rows = rows.select("page_id", "url", "text", "free", F.when(F.col("text").isNull(), F.col("spans")).alias("spans"), *counts).mapInPandas(
        keep, "page_id long, url string, text string, n_repeated long, n_repeated_main long"
    )
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated", "n_repeated_main")
