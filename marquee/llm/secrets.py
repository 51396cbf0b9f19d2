"""Secrets in whole texts, told from copied examples by how many repositories and owners hold them (operator 9)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from marquee.llm.common import prepare, text_or_empty
from marquee.runtime import write_once

KINDS = ("assign", "access", "hex", "key")
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 10
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")


_NO_SPANS = "cast(array() as array<struct<start:bigint,end:bigint,kind:string,live:boolean>>)"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of assignments, access keys and long hex runs, by start and kind."""
    found = []
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), m.end(), "assign", m.group(2)))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.group()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.group()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def key_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Runs of 20 or more key characters with letters and digits that no base span touches, of varied characters."""
    found = []
    for m in _KEY.finditer(text):
        if len(set(m.group())) >= 10 and not any(s < m.end() and m.start() < e for s, e, _, _ in base):
            found.append((m.start(), m.end(), "key", m.group()))
    return found


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def _candidates(df: DataFrame, repository: str, owner: str) -> DataFrame:
    """One row per document, with the spans and hashes of its candidates in arrays; most are empty."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base = base_spans(text)
                spans = base + key_spans(text, base)
                rows.append((
                    [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans],
                    [hashlib.md5(s[3].encode()).hexdigest() for s in spans],
                ))
            out = frame.drop(columns="text")
            for i, name in enumerate(("starts", "ends", "kinds", "hashes")):
                out[name] = pd.Series([r[i] for r in rows], dtype=object, index=out.index)
            yield out

    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"),
    )
    return rows.mapInPandas(
        scan, "doc_id long, repository string, owner string, tie long, starts array<long>, ends array<long>, "
        "kinds array<string>, hashes array<string>",
    )


def _judged(
    df: DataFrame, repository: str, owner: str, example_owners: int, example_repositories: int
) -> tuple[DataFrame, DataFrame]:
    """All documents with their candidates, and those that have any with each candidate's verdict."""
    prepare(df.sparkSession)
    rows = write_once(_candidates(df, repository, owner))
    none = F.lit("")
    each = rows.filter(F.size("hashes") > 0).select(
        F.coalesce("repository", none).alias("repository"), F.coalesce("owner", none).alias("owner"),
        F.explode("hashes").alias("hash"),
    )
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    places = each.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    known = write_once(owners.join(places, "hash"))

    held = rows.filter(F.size("hashes") > 0).withColumn("_row", F.monotonically_increasing_id())
    held = write_once(held)
    spans = held.select("_row", F.posexplode("hashes").alias("at", "hash")).join(known, "hash")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    verdicts = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", live.alias("live")))).alias("seen"))
    marked = held.join(verdicts, "_row").withColumn(
        "all",
        F.transform("seen", lambda s: F.struct(
            F.element_at("starts", s["at"] + 1).alias("start"), F.element_at("ends", s["at"] + 1).alias("end"),
            F.element_at("kinds", s["at"] + 1).alias("kind"), s["live"].alias("live"),
        )),
    )
    return rows, marked


def find_secrets(
    df: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live_spans.

    Candidates are the base spans and, beside them, key-like runs. The hash of each candidate's value is counted
    over the corpus by distinct repositories and owners: a value that ``example_owners`` or more owners hold, or
    ``example_repositories`` or more repositories, is a copied example; one that fewer of both hold looks live. Repositories
    decide where the corpus has too few owners, or one owner holds most of it. ``spans`` holds all base spans, and the key-like runs that look
    live; ``live_spans`` those of ``spans`` that look live. Places are code points, ends exclusive.

    The texts are read once; what is counted and joined is the few candidates. Owners of a value are counted
    as distinct pairs first, so a value that a third of the corpus holds is combined in every task.

    A null text is empty. Null repositories and owners count as one more value. Documents without spans have empty
    strings and the sha256 of the empty string. Repeated rows give equal rows each. Other columns play no part.
    """
    rows, marked = _judged(df, repository, owner, example_owners, example_repositories)
    empty = rows.filter(F.size("hashes") == 0).select("doc_id", F.expr(_NO_SPANS).alias("all"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def joined(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("all", lambda s: s["kind"] != "key")
    chosen = F.filter("all", lambda s: (s["kind"] != "key") | s["live"])
    live = F.filter("all", lambda s: s["live"])
    return marked.select("doc_id", "all").unionByName(empty).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(chosen).alias("spans"),
        F.size(live).cast("long").alias("n_live"), (F.size("all") - F.size(live)).cast("long").alias("n_example"),
        joined(live).alias("live_spans"),
    )


def redact(
    df: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, mark: str = "[secret]",
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """``df`` with every live-looking secret of the texts replaced by ``mark``, and n_chars, where there is one, counted anew.

    Texts without a candidate pass as they are and are not shuffled; copied examples stay.
    """
    @F.pandas_udf(BooleanType())
    def suspicious(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            base = base_spans(text)
            found.append(bool(base or key_spans(text, base)))
        return pd.Series(found, dtype=bool)

    @F.pandas_udf(StringType())
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            end, parts = 0, []
            for span in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if span["start"] >= end:
                    parts += [text[end : span["start"]], mark]
                elif span["end"] <= end:
                    continue
                end = span["end"]
            out.append("".join(parts) + text[end:])
        return pd.Series(out, dtype=object)

    marked = _judged(df, repository, owner, example_owners, example_repositories)[1]
    live = marked.select(
        F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), F.filter("all", lambda s: s["live"]).alias("_live")
    ).filter(F.size("_live") > 0).dropDuplicates(["_d", "_t"])
    seen = df.withColumn("_seen", suspicious(text_or_empty()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text_or_empty()) == F.col("_t"))
    dirty = seen.filter("_seen").join(live, same, "left")
    text = F.when(F.col("_live").isNotNull(), replaced(text_or_empty(), F.coalesce("_live", F.expr(_NO_SPANS)))).otherwise(F.col("text"))
    dirty = dirty.withColumn("text", text).drop("_d", "_t", "_live", "_seen")
    if "n_chars" in df.columns:
        dirty = dirty.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return seen.filter("not _seen").drop("_seen").unionByName(dirty)
