"""Mixing sources to target weights by min-cost flow over membership patterns (operator 7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import text_or_empty, without
from marquee.runtime import write_once

REPEATS = 3
WEIGHTS = (5, 2, 1)
MOST_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the total by weight; a source stops at ``repeats`` times its size, and the others share the rest."""
    out, total = [0.0] * len(sizes), float(sum(sizes))
    open_ones = [i for i, s in enumerate(sizes) if s]
    left = total
    while open_ones:
        weight = sum(weights[i] for i in open_ones)
        full = [i for i in open_ones if left * weights[i] / weight > repeats * sizes[i]]
        if not full:
            for i in open_ones:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in full)
        open_ones = [i for i in open_ones if i not in full]
    return out


def min_cost_flow(supply: np.ndarray, late: np.ndarray, room: np.ndarray, quotas: np.ndarray) -> np.ndarray:
    """Words from each pattern (row) to each source (column) that meet ``quotas`` at the least cost of repetition.

    ``supply`` is a pattern's distinct text, ``room`` what its documents in each source may give; a pattern's first
    use counts as use ``late + 1``. The k-th use of a text costs more than the one before, the same for all patterns, so the cheapest flow comes from raising the
    allowed number of uses one by one and augmenting each time to the greatest flow (successive shortest paths:
    cost depends only on which use of the text a path adds). A path goes from a pattern with text to spare to a
    source, then from source to source by re-routing what a pattern gives, to one with quota left.
    """
    patterns, sources = room.shape
    flow = np.zeros((patterns, sources), np.int64)
    need = quotas.astype(np.int64).copy()
    limit = room.sum(axis=1)

    def add(amounts: np.ndarray, most: int) -> np.ndarray:
        """As much of ``amounts`` as adds up to ``most``, from the first on."""
        return np.clip(most - (np.cumsum(amounts) - amounts), 0, amounts)

    use = 0
    while need.sum() > 0:
        use += 1
        allowed = np.minimum(supply * np.maximum(use - late, 0), limit)
        if use > 1 and (supply * np.maximum(use - 1 - late, 0) >= limit).all():
            break
        while need.sum() > 0:
            spare = allowed - flow.sum(axis=1)
            reach: dict[int, int | None] = {}
            fresh = np.minimum(spare[:, None], room - flow).clip(0).sum(axis=0)
            queue = [s for s in range(sources) if fresh[s] > 0]
            for s in queue:
                reach[s] = None
            goal = next((s for s in queue if need[s] > 0), None)
            while goal is None and queue:
                s = queue.pop(0)
                moves = np.minimum(flow[:, s][:, None], room - flow).sum(axis=0)
                for t in range(sources):
                    if moves[t] > 0 and t not in reach:
                        reach[t] = s
                        queue.append(t)
                        if need[t] > 0 and goal is None:
                            goal = t
            if goal is None:
                break
            path = [goal]
            while reach[path[-1]] is not None:
                path.append(reach[path[-1]])
            path.reverse()
            amount = min(int(need[goal]), int(fresh[path[0]]))
            for a, b in zip(path, path[1:]):
                amount = min(amount, int(np.minimum(flow[:, a], room[:, b] - flow[:, b]).sum()))
            for a, b in reversed(list(zip(path, path[1:]))):
                moved = add(np.minimum(flow[:, a], room[:, b] - flow[:, b]), amount)
                flow[:, a] -= moved
                flow[:, b] += moved
            flow[:, path[0]] += add(np.minimum(spare, room[:, path[0]] - flow[:, path[0]]).clip(0), amount)
            need[goal] -= amount
    return flow


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of each group by ``order`` (its first column: a hash below 2^32).

    A group is cut by the hash into about as many buckets as the square root of its rows, so neither a
    bucket nor the list of a group's buckets is large even for a group that holds a third of all rows.
    """
    sizes = write_once(df.groupBy(*group).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_parts")))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    sized = df.join(sizes.withColumnsRenamed({c: f"_g_{c}" for c in group}), same).drop(*[f"_g_{c}" for c in group])
    sized = write_once(sized.withColumn("_part", F.expr(f"cast({order[0]} * _parts div 4294967296 as long)")))
    parts = sized.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = write_once(parts.select(
        *[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_g_part"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
    ))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(parts, [*same, F.col("_part") == F.col("_g_part")])
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop(
        "_parts", "_part", "_inside", "_before", "_g_part", *[f"_g_{c}" for c in group]
    )


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """``df`` with size, source_size, target and taken (words that the mix takes of the document, repeats counted).

    Sources in order of code points, null last, take ``weights`` in turn. Texts that several sources hold make sources
    overlap: the first document of a text in each source belongs to the pattern of all sources that hold the
    text; its further copies in a source can only repeat it, the later the more copies there are. Words are added up by pattern and source; a min-cost flow
    on that small table routes them to the sources' targets, using a text again only where no unused one
    is left. Within a pattern the texts stand in seeded order; each source takes the next stretch after the one
    before it, going round again when the texts end, and no document more than ``repeats`` times.

    The driver holds one row a pattern and source. The 100,000 patterns with most words are kept as they are;
    documents of any rarer one count for their own source alone, which changes no target and drops no row.

    A null or empty text has size 0 and takes 0. Rows are told apart by doc_id, source and text; repeated rows count each and get equal
    answers, rounded down, so they may miss a word each. Input columns with an added name are replaced. An empty table gives an empty result.
    """
    spark = df.sparkSession
    added = ("size", "source_size", "target", "taken")
    text = F.md5(text_or_empty())
    rows = write_once(df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.unhex(text).alias("hash"), word_count(text_or_empty()).alias("size"),
    ))
    distinct = rows.groupBy("doc_id", "source", "hash", "size").agg(F.count(F.lit(1)).alias("copies"))
    distinct = write_once(distinct)
    firsts = distinct.groupBy("hash", "source").agg(
        F.min(F.struct("doc_id", "size")).alias("m"), F.sum("copies").alias("n")
    ).select("hash", "source", "m.doc_id", "n")
    sets = write_once(
        firsts.groupBy("hash").agg(
            F.xxhash64(F.to_json(F.sort_array(F.collect_set(F.coalesce("source", F.lit("\U0010ffff")))))).alias("pattern"),
            F.ceil(F.log2(F.sum("n"))).cast("long").alias("level"),
        )
    )
    firsts = firsts.join(sets, "hash").withColumnsRenamed({"hash": "_h", "source": "_s", "doc_id": "_d"})
    same = (F.col("hash") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s"))
    marked = distinct.join(write_once(firsts), same)
    # a further copy within its source can only repeat a text; its pattern is minus the log of the text's copies
    marked = marked.withColumn("pattern", F.when(F.col("doc_id").eqNullSafe(F.col("_d")), F.col("pattern")).otherwise(-F.col("level")))
    marked = marked.select("doc_id", "source", "hash", "size", "copies", "pattern")

    words = F.sum(F.col("size") * F.col("copies")).alias("words")
    widest = marked.groupBy("pattern").agg(words).orderBy(F.desc("words"), "pattern").limit(MOST_PATTERNS).select("pattern")
    kept = F.broadcast(widest.withColumn("_kept", F.lit(True)))
    own = F.xxhash64(F.lit("own"), F.coalesce("source", F.lit("\U0010ffff")))
    marked = marked.join(kept, "pattern", "left").withColumn("pattern", F.when(F.col("_kept"), F.col("pattern")).otherwise(own)).drop("_kept")
    marked = write_once(marked)

    cells = marked.groupBy("pattern", "source").agg(words).toPandas()
    names = sorted(cells["source"].unique(), key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    sizes = [int(cells.loc[cells["source"].isna() if s is None else cells["source"] == s, "words"].sum()) for s in names]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], repeats)
    patterns = sorted(cells["pattern"].unique())
    at = {p: i for i, p in enumerate(patterns)}
    held = np.zeros((len(patterns), len(names)), np.int64)
    for p, s, w in cells.itertuples(index=False):
        held[at[p], place[None if pd.isna(s) else s]] = w
    supply, late = held.max(axis=1, initial=0), np.zeros(len(patterns), np.int64)
    for p, i in at.items():
        if -64 < p < 0:  # copies of a text with 2^k of them: used like its k-th repetition
            supply[i], late[i] = held[i].sum(), -p
    quotas = np.minimum(np.floor(np.array(wanted) + 0.5), repeats * np.array(sizes)).astype(np.int64)
    flow = min_cost_flow(supply, late, held * repeats, quotas)
    ahead = np.cumsum(flow, axis=1) - flow
    answer = pd.DataFrame(
        [
            (p, names[j], sizes[j], wanted[j], int(held[at[p], j]), int(flow[at[p], j]), int(ahead[at[p], j]))
            for p in patterns for j in range(len(names)) if held[at[p], j]
        ],
        columns=["_p", "_s", "source_size", "target", "_held", "_flow", "_ahead"],
    )
    kinds = "_p long, _s string, source_size long, target double, _held long, _flow long, _ahead long"
    table = spark.createDataFrame(answer.astype({"_s": object}).where(answer.notna(), None), kinds) if len(answer) else spark.createDataFrame([], kinds)
    by_source = spark.createDataFrame(
        [(s, sizes[j], float(wanted[j])) for j, s in enumerate(names)], "_s string, source_size long, target double"
    )

    cell = marked.filter("size > 0").withColumns({
        "order": F.pmod(F.xxhash64(F.lit(seed), "hash"), F.lit(1 << 32)), "all": F.col("size") * F.col("copies"),
    })
    placed = running_total(cell, ["pattern", "source"], ["order", "hash", "doc_id"], "all", "before")
    # a cell is a ring of _held words; its source takes _flow words of it from _ahead on
    joined = placed.join(table, (F.col("pattern") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    start = F.expr("_ahead % _held")
    rest = F.expr("_flow % _held")

    def inside(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(b, F.col("before") + F.col("all")) - F.greatest(a, F.col("before")))

    covered = inside(start, F.least(start + rest, F.col("_held"))) + inside(F.lit(0), F.greatest(start + rest - F.col("_held"), F.lit(0)))
    words = F.expr("_flow div _held") * F.col("all") + covered
    taken = write_once(joined.select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("hash").alias("_h"),
        (words / F.col("copies")).cast("long").alias("taken"),
    ))
    base = without(df, *added).withColumns({"_llm_hash": F.unhex(text), "size": word_count(text_or_empty())})
    row = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & F.col("source").cast("string").eqNullSafe(F.col("_s"))
        & (F.col("_llm_hash") == F.col("_h"))
    )
    chosen = base.join(taken, row, "left").drop("_d", "_s", "_h", "_llm_hash")
    of_source = F.col("source").cast("string").eqNullSafe(F.col("_s"))
    return (
        chosen.join(F.broadcast(by_source), of_source, "left").drop("_s")
        .withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    )
