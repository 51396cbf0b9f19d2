"""Homomorphic multiset fingerprints of documents (operator 5), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import text_or_empty
from marquee.runtime import write_once

EXACT = 8
COUNTERS = 128
# a run ends with a word whose last sign is one of these, every fourth of ASCII, or with its line or 16th word: where it ends does
# not depend on what comes before, so a word put in or taken out changes two runs at most
RUNS = r"(?:[^\s]++(?<![$(,048<@DHLPTX\\`dhlptx|])[^\S\n]++){0,15}[^\s]++"
_PAIRS = COUNTERS // 2


def _items(text: Column) -> Column:
    """Paragraphs of a text (lines that are not blank), and the runs of words they are made of."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))
    return F.concat(
        F.transform(paragraphs, lambda p: F.struct(F.lit(True).alias("whole"), p.alias("value"))),
        F.transform(runs, lambda r: F.struct(F.lit(False).alias("whole"), r.alias("value"))),
    )


def _sums(whole: Column, value: Column) -> list[Column]:
    """The wide vector of one item, summed: 8 lanes of 32 bits for paragraphs, 128 counters and a count for runs.

    Lanes are summed as 64-bit numbers, two counters of 32 bits in each, so no sum can overflow below 2^31 items.
    """
    exact = [F.sum(F.when(whole, F.pmod(F.xxhash64(value, F.lit(i)), F.lit(1 << 32))).otherwise(0)) for i in range(EXACT)]
    pairs = []
    for j in range(_PAIRS):
        bits = F.shiftrightunsigned(F.xxhash64(value, F.lit(100 + j // 32)), j % 32).bitwiseAND(F.lit((1 << 32) + 1))
        pairs.append(F.sum(F.when(~whole, bits).otherwise(0)))
    return [*exact, *pairs, F.sum(F.when(~whole, 1).otherwise(0).cast("long"))]


def vector(lanes: Column) -> Column:
    """The fingerprint's entries as one array: 8 lanes modulo 2^32, 128 counters modulo 2^16, the count modulo 2^32."""
    exact = F.transform(F.slice(lanes, 1, EXACT), lambda x: F.pmod(x, F.lit(1 << 32)))
    packed = F.slice(lanes, EXACT + 1, _PAIRS)
    low = F.transform(packed, lambda x: F.pmod(x, F.lit(1 << 16)))
    high = F.transform(packed, lambda x: F.pmod(F.shiftright(x, 32), F.lit(1 << 16)))
    return F.concat(exact, low, high, F.array(F.pmod(F.element_at(lanes, EXACT + _PAIRS + 1), F.lit(1 << 32))))


def packed(entries: Column) -> Column:
    """The entries as they are written and shuffled: 32 and 16 bits each, as signed numbers of that width."""
    def signed(x, bits):
        return F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x)

    wide = F.concat(F.slice(entries, 1, EXACT), F.slice(entries, EXACT + COUNTERS + 1, 1))
    return F.struct(
        F.transform(wide, lambda x: signed(x, 32).cast("int")).alias("wide"),
        F.transform(F.slice(entries, EXACT + 1, COUNTERS), lambda x: signed(x, 16).cast("short")).alias("counters"),
    )


def unpacked(name: str) -> Column:
    wide = F.transform(F.col(name)["wide"], lambda x: F.pmod(x.cast("long"), F.lit(1 << 32)))
    counters = F.transform(F.col(name)["counters"], lambda x: F.pmod(x.cast("long"), F.lit(1 << 16)))
    return F.concat(F.slice(wide, 1, EXACT), counters, F.slice(wide, EXACT + 1, 1))


def text_form(entries: Column) -> Column:
    def digits(x, n):
        return F.lpad(F.lower(F.hex(x)), n, "0")

    return F.concat(
        F.array_join(F.transform(F.slice(entries, 1, EXACT), lambda x: digits(x, 8)), ""),
        F.array_join(F.transform(F.slice(entries, EXACT + 1, COUNTERS), lambda x: digits(x, 4)), ""),
        digits(F.element_at(entries, EXACT + COUNTERS + 1), 8),
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Entries of the texts of ``a`` and ``b`` together, or with ``sign`` -1 of ``a`` without the paragraphs of ``b``."""
    return F.transform(
        F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        lambda p, i: F.pmod(
            p["x"] + sign * p["y"],
            F.when((i >= EXACT) & (i < EXACT + COUNTERS), F.lit(1 << 16)).otherwise(F.lit(1 << 32)),
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common runs, 2 |a and b| / (|a| + |b|) over multisets, from 0 to 1; 1 for equal vectors.

    Each counter counts the runs whose hash has a bit set; twice it less the number of runs is a sum of random signs,
    and the mean product of two such sums estimates the size of the common part.
    """
    def total(products):
        return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")

    # a lambda holds no more than its own argument: what stands inside is computed again for every entry
    x, y = (F.slice(v, EXACT + 1, COUNTERS) for v in (a, b))
    n, m = (F.element_at(v, EXACT + COUNTERS + 1).cast("double") for v in (a, b))
    sx, sy = total(x), total(y)
    # sums of (2c - n)(2d - m), (2c - n)^2 and (2d - m)^2 over the counters
    both = 4 * total(F.zip_with(x, y, lambda p, q: p * q)) - 2 * m * sx - 2 * n * sy + COUNTERS * n * m
    own = 4 * total(F.transform(x, lambda p: p * p)) - 4 * n * sx + COUNTERS * n * n
    other = 4 * total(F.transform(y, lambda q: q * q)) - 4 * m * sy + COUNTERS * m * m
    each = own + other
    close = F.when(each > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * both / each))).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(close)


def _order(rows: DataFrame) -> DataFrame:
    """Each distinct row with its length and the row after it by doc_id and text hash, the last one with the first.

    The rows are range-partitioned and numbered inside their partition; one count a partition makes the numbers global.
    """
    distinct = rows.groupBy("doc_id", "id", "tie").agg(F.max("n").alias("n"))
    placed = write_once(
        distinct.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33).alias("part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    firsts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    total = placed.count()
    ranked = placed.withColumn("part", part).join(firsts, "part")
    ranked = write_once(ranked.withColumn("rank", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first", "at"))
    after = ranked.select(
        F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("rank"), F.col("id").alias("next_id"), F.col("tie").alias("next_tie")
    )
    return write_once(ranked.join(after, "rank").drop("rank"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is a wide vector summed over the paragraphs of the whole text, modulo powers of two: it does
    not depend on their order, and ``combine`` adds or takes away paragraphs without the text. Eight lanes of hashes of whole
    paragraphs tell multisets of paragraphs apart; 128 counters of hash bits of the paragraphs' runs of words (see ``RUNS``)
    let ``likeness`` estimate how much two texts share.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next
    document by doc_id (after the last: the first). Only those heads and the narrow table of the order move besides the
    one exchange of texts.

    A null text is empty; empty and blank texts have the zero vector, and likeness 1 among themselves. A null doc_id
    comes first. Rows with equal doc_id stand in the order of a text hash; rows equal in both count
    as one document for what is next, and each is returned. A single document is its own next one. Other columns play no part.
    """
    null = F.col("doc_id").isNull()
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select(
        "doc_id", F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64(null, "text").alias("tie"), "text"
    )
    order = _order(rows.select("doc_id", "id", "tie", F.length("text").cast("long").alias("n")))
    # one exchange of the texts, that both joins below read
    texts = rows.select("id", "tie", "text", F.monotonically_increasing_id().alias("row")).repartition("id", "tie")
    quarter = F.expr("cast(floor(n / 4) as int)")
    nexts = order.withColumnsRenamed({"id": "_i", "tie": "_t"})
    heads = (
        texts.withColumnsRenamed({"id": "next_id", "tie": "next_tie"}).join(nexts, ["next_id", "next_tie"])
        .groupBy(F.col("_i").alias("id"), F.col("_t").alias("tie"), "doc_id", "n", "next_id", "next_tie")
        .agg(F.min(F.struct("row", F.expr("substring(text, 1, cast(floor(n / 4) as int))").alias("head"))).alias("h"))
    )
    edited = texts.join(heads, ["id", "tie"]).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - quarter), F.col("h.head"))
    )
    keys = ["id", "tie", "row", "doc_id", "n", "next_id", "next_tie", "sha", "which"]
    both = edited.withColumn("sha", F.sha2("edited", 256)).withColumn(
        "v", F.explode(F.array(
            F.struct(F.lit(0).alias("which"), F.col("text").alias("body")),
            F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")),
        ))
    ).select(*keys[:-1], "v.which", "v.body")
    # a blank text keeps its row: one whole paragraph without text adds nothing
    blank = F.array(F.struct(F.lit(None).cast("boolean").alias("whole"), F.lit("").alias("value")))
    items = both.select(*keys, F.explode(F.concat(_items(F.col("body")), blank)).alias("i"))
    lane = _sums(F.col("i.whole"), F.col("i.value"))
    sums = items.groupBy(*keys).agg(*[s.alias(f"s{k}") for k, s in enumerate(lane)])
    entries = vector(F.array(*[f"s{k}" for k in range(len(lane))]))
    pair = F.sort_array(F.collect_list(F.struct("which", entries.alias("v"))))
    own, changed = F.col("p")[0]["v"], F.col("p")[1]["v"]
    found = write_once(
        sums.groupBy(*keys[:-1]).agg(pair.alias("p")).select(
            *keys[:-1], packed(own).alias("own"), packed(changed).alias("changed"),
            likeness(own, changed).alias("near_edited"),
        )
    )
    nexts = found.select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("own").alias("after"))
    joined = found.join(nexts.dropDuplicates(["next_id", "next_tie"]), ["next_id", "next_tie"])
    return joined.select(
        "doc_id", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        text_form(unpacked("own")).alias("fingerprint"), text_form(unpacked("changed")).alias("edited_fingerprint"),
        "near_edited", likeness(unpacked("own"), unpacked("after")).alias("near_next"),
    )
