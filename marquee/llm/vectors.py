"""Near-duplicate vectors by sorted projection passes (operator 4)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import prepare
from marquee.llm.sharding import splitters
from marquee.operators.graph import components
from marquee.runtime import write_once

SIMILARITY = 0.98
NEIGHBOURS = 16
MISSED = 1e-4
CELL_ROWS = 4096
BLOCK_ROWS = 1024
_SIGNS, _TIES, _LABELS, _PASSES = 34, 14, 9, 6  # bits of the sort key, 63 in all


def passes_for(rows: int, least: float, neighbours: int = NEIGHBOURS, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold has stayed apart in all of them with probability ``missed``.

    Two vectors agree in one random sign with probability 1 - angle / pi, and meet in a pass when they
    share the prefix that leaves about ``neighbours`` others in evenly spread rows; see ``dense_links`` for other rows.
    """
    agree = 1 - math.acos(least) / math.pi
    meet = agree ** max(1.0, math.log2(max(rows, 2) / neighbours))
    return max(2, min(1 << _PASSES, math.ceil(math.log(missed) / math.log(1 - meet)))) if meet < 1 else 2


def prefix_signs(rows: int, neighbours: int = NEIGHBOURS) -> int:
    """Signs of the prefix that ``passes_for`` reckons with, rounded down: a shorter prefix is shared more often."""
    return min(_SIGNS, max(1, int(math.log2(max(rows, 2) / neighbours)) if rows > neighbours else 1))


def _rows(df: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, good): good where the vector can link."""
    good = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists("embedding", lambda x: x != 0)
    return df.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).withColumn("good", F.coalesce(good, F.lit(False)))


def _units(df: DataFrame) -> DataFrame:
    """(vec_id, label, node, unit) of the rows that can link: unit vectors as bytes of doubles, node the key of equal rows."""
    same = F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>"))))

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.drop(columns="embedding")
            units = []
            for x in frame["embedding"]:
                x = np.asarray(x, np.float64)
                x = x / np.abs(x).max()
                units.append((x / np.linalg.norm(x)).tobytes())
            out["unit"] = units
            yield out

    return _rows(df).filter("good").select("vec_id", "label", same.alias("node"), "embedding").mapInPandas(
        scale, "vec_id long, label string, node binary, unit binary"
    )


def _keys(node: list[bytes], label: list[str], x: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """Sort keys of one pass: the pass, the label, signs of random projections in order, and a random tie."""
    draw = np.random.default_rng([seed, turn, x.shape[1]])
    signs = (x @ draw.normal(size=(x.shape[1], _SIGNS)) > 0) @ (1 << np.arange(_SIGNS - 1, -1, -1, dtype=np.int64))
    names = {v: _short(v.encode(), b"%d" % x.shape[1]) % (1 << _LABELS) for v in set(label)}
    labels = np.array([names[v] for v in label], np.int64)
    ties = np.array([_short(n, b"%d" % turn) % (1 << _TIES) for n in node], np.int64)
    return (((np.int64(turn) << _LABELS | labels) << _SIGNS | signs) << _TIES) | ties


def _short(*parts: bytes) -> int:
    """A 16-bit hash that is the same in every task."""
    return int.from_bytes(hashlib.md5(b"/".join(parts)).digest()[:2], "big")


def _by_dimension(units: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = units.map(len).to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(units.iloc[rows]), np.float64).reshape(len(rows), -1)


def _neighbours(frame: pd.DataFrame, least: float, width: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs at most ``width`` places apart in key order, of one pass and label, whose cosine is ``least`` or more."""
    frame = frame.sort_values(["key", "node"], kind="stable")
    for rows, x in _by_dimension(frame["unit"]):
        node, label = frame["node"].to_numpy()[rows], frame["label"].to_numpy()[rows]
        turn = frame["key"].to_numpy()[rows] >> (_LABELS + _SIGNS + _TIES)
        for step in range(1, min(width, len(rows) - 1) + 1):
            close = np.einsum("ij,ij->i", x[:-step], x[step:]) >= least
            for i in np.flatnonzero(close & (turn[:-step] == turn[step:])):
                if label[i] == label[i + step] and node[i] != node[i + step]:
                    yield min(node[i], node[i + step]), max(node[i], node[i + step])


def links_of(unique: DataFrame, rows: int, least: float = SIMILARITY, width: int = NEIGHBOURS, seed: int = 5) -> DataFrame:
    """Pairs (src, dst) of nodes found by the passes. ``unique``: (node, label, unit), one row a node.

    All passes are one sort: the key begins with the pass. Splitters that cut the keys into cells of equal
    rows are found by counting (see sharding), one exchange deals out the cells, and each compares windows
    of ``width`` neighbours. What lies at a border between two cells is compared in a second, small step.
    """
    spark = unique.sparkSession
    turns = passes_for(rows, least, width)
    cells = max(1, rows * turns // CELL_ROWS)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, x in _by_dimension(frame["unit"]):
                part = frame.iloc[at]
                nodes, labels = part["node"].tolist(), part["label"].tolist()
                for turn in range(turns):
                    yield part.assign(key=_keys(nodes, labels, x, turn, seed))

    every = unique.select("node", "label", "unit").mapInPandas(keyed, "node binary, label string, unit binary, key long")
    keyed_nodes = write_once(every.select("key", "node"))
    keys = keyed_nodes.select("key", F.lit(1).cast("long").alias("size"))
    cuts = splitters(keys, cells, rows * turns, 0.1)[0] if cells > 1 else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def cell(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(), "right"))

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        own = int(frame["cell"].iloc[0])
        frame = frame.sort_values(["key", "node"], kind="stable").reset_index(drop=True)
        pairs = sorted(set(_neighbours(frame, least, width)))
        found = pd.DataFrame({"src": [p[0] for p in pairs], "dst": [p[1] for p in pairs], "border": -1})
        edges = [found]
        for border, part in ((own - 1, frame.head(width)), (own, frame.tail(width))):
            edges.append(part[["node", "label", "unit", "key"]].assign(border=border))
        out = pd.concat(edges, ignore_index=True)[["src", "dst", "border", "node", "label", "unit", "key"]]
        return out.astype(object).where(out.notna(), None)

    kinds = "src binary, dst binary, border long, node binary, label string, unit binary, key long"
    compared = write_once(
        every.withColumn("cell", cell("key")).groupBy("cell").applyInPandas(within, kinds)
    )

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(set(_neighbours(frame.drop_duplicates(["key", "node"]), least, width)))
        return pd.DataFrame({"src": [p[0] for p in pairs], "dst": [p[1] for p in pairs]}).astype(object)

    inner = compared.filter("border = -1").select("src", "dst").filter("src is not null")
    borders = compared.filter(f"border >= 0 and border < {cells - 1} and node is not null")
    outer = borders.groupBy("border").applyInPandas(across, "src binary, dst binary")
    links = write_once(inner.unionByName(outer).distinct())
    shift = _SIGNS + _TIES - prefix_signs(rows, width)
    return write_once(links.unionByName(dense_links(keyed_nodes, unique, links, shift, least, width)).distinct())


def _forest(x: np.ndarray, least: float, left: int) -> list[tuple[int, int]]:
    """Pairs (i, j) that hold together what links of cosine ``least`` join among the rows of ``x``.

    Only links between the first ``left`` rows and the others count, or all where ``left`` is 0.
    """
    close = x @ x.T >= least
    if left:
        close[:left, :left] = False
        close[left:, left:] = False
    fresh, out = np.ones(len(x), bool), []
    for root in range(len(x)):
        if not fresh[root]:
            continue
        fresh[root] = False
        grown = [root]
        while grown:
            i = grown.pop()
            new = np.flatnonzero(close[i] & fresh)
            fresh[new] = False
            out += [(i, int(j)) for j in new]
            grown += new.tolist()
    return out


def dense_links(
    keyed: DataFrame, unique: DataFrame, links: DataFrame, shift: int, least: float = SIMILARITY, width: int = NEIGHBOURS,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs (src, dst) that join what windows miss in dense parts: runs of one prefix that are longer than a window.

    ``keyed``: (key, node) of all passes; ``shift``: bits of the key behind the prefix. All vectors of such a run are compared in blocks, a matrix
    product each, unless ``links`` make one component of them. So two vectors with one prefix in any pass are always
    compared, however many share it, and the chance to miss a pair does not depend on the density. A run of m vectors
    takes (m / block)^2 / 2 products; a product gives as many pairs as hold its components together, not every link.
    """
    spread = keyed.select(F.shiftright("key", shift).alias("run"), "node")
    long = write_once(spread.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > width + 1).select("run"))
    named = write_once(components(links))
    members = spread.join(long, "run").join(unique.select("node", "label", F.length("unit").alias("bytes")), "node")
    members = write_once(
        members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    group = ["run", "label", "bytes"]
    open_runs = members.groupBy(*group).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / block).alias("blocks")
    )
    open_runs = write_once(open_runs.filter("low < high").select(*group, "blocks"))
    placed = members.join(open_runs, group).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})
    dealt = dealt.select(*group, "first", "second", "own", "node").join(unique.select("node", "unit"), "node")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["own", "node"], kind="stable")
        first, second = int(frame["first"].iloc[0]), int(frame["second"].iloc[0])
        x = np.frombuffer(b"".join(frame["unit"]), np.float64).reshape(len(frame), -1)
        left = int((frame["own"] == first).sum()) if first != second else 0
        node = frame["node"].tolist()
        pairs = [sorted((node[i], node[j])) for i, j in _forest(x, least, left)] if first == second or 0 < left < len(x) else []
        return pd.DataFrame({"src": [p[0] for p in pairs], "dst": [p[1] for p in pairs]}).astype(object)

    return dealt.groupBy(*group, "first", "second").applyInPandas(join, "src binary, dst binary").distinct()


def direct_links(members: DataFrame, least: float = SIMILARITY, block: int = BLOCK_ROWS) -> DataFrame:
    """(node, n): how many other vectors, copies counted, have cosine ``least`` or more with the node's.

    ``members``: (component, node, label, copies, unit) of the nodes that the passes linked. Links lie inside
    components, so each is cut into blocks by hash and every two blocks are one matrix product that gives
    counts; no pair is written. A component of m nodes takes (m / block)^2 / 2 products, each its own group.
    """
    sizes = write_once(members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    placed = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        found: dict[bytes, int] = {}
        for rows, x in _by_dimension(frame["unit"]):
            own, copies = frame["own"].to_numpy()[rows], frame["copies"].to_numpy()[rows]
            node, label = frame["node"].to_numpy()[rows], frame["label"].to_numpy()[rows]
            a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
            close = (x[a] @ x[b].T >= least) & (label[a][:, None] == label[b][None, :])
            if low == high:
                np.fill_diagonal(close, False)
            sides = [(a, close @ copies[b])] + ([(b, copies[a] @ close)] if low != high else [])
            for side, n in sides:
                for i, k in zip(side, n):
                    found[node[i]] = found.get(node[i], 0) + int(k)
        return pd.DataFrame({"node": list(found), "n": list(found.values())}).astype({"n": "int64", "node": object})

    counted = dealt.select("component", "low", "high", "own", "node", "label", "copies", "unit")
    counted = counted.groupBy("component", "low", "high").applyInPandas(count, "node binary, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(df: DataFrame, least: float = SIMILARITY, width: int = NEIGHBOURS) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors are compared only with those of the same label, by cosine in double precision. Equal vectors of a
    label are one node from the start. In every pass the nodes are sorted by label and the concatenated signs of random
    projections, and each is compared with its ``width`` neighbours; the number of passes grows with the logarithm of
    the rows so that a pair at the threshold is missed once in 10,000. Where more vectors than a window share the prefix
    of signs that this reckons with, all that share it are compared in blocks. Verified pairs of all passes are united into
    components, named by their smallest vec_id; n_links counts all direct links inside the component.

    A vector that is null, empty, zero, or holds a null or non-finite number, and one with a null label, link with
    nothing: n_links 0, its own vec_id, kept. Vectors of different length do not link. Repeated rows are copies and
    link with each other. Other columns play no part.
    """
    spark = df.sparkSession
    prepare(spark)
    units = write_once(_units(df))
    unique = units.groupBy("node", "label").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.min("unit").alias("unit")
    )
    unique = write_once(unique)
    rows = unique.count()
    alone = _rows(df).filter("not good").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if not rows:
        return alone
    links = links_of(unique, rows, least, width)
    groups = write_once(components(links))
    members = unique.join(groups, "node").select("component", "node", "label", "copies", "unit")
    counted = direct_links(members, least)
    named = unique.select("node", "vec_id", "copies").join(groups, "node", "left").join(counted, "node", "left")
    named = write_once(named.withColumn("component", F.coalesce("component", "node")))
    firsts = write_once(named.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    known = write_once(named.join(firsts, "component").select(
        F.col("node").alias("_node"), "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    ))
    linked = units.select("vec_id", "node").join(known, F.col("node") == F.col("_node"))
    linked = linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
