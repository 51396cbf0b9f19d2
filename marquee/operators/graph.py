"""Co-appearance graphs: edges, degrees, subgraphs and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.runtime import broadcast_rows, delete_written, write_once


def leading_people(df: DataFrame, film: str, person: str, order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` people of each film as an array.

    The rank filter is applied in every task before the shuffle, so a film with many rows sends
    ``n`` of them per task.
    """
    rank = F.row_number().over(Window.partitionBy(film).orderBy(*order))
    top = df.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    ranked = F.sort_array(F.collect_list(F.struct("_rank", person)))
    return top.groupBy(film).agg(F.transform(ranked, lambda r: r[person]).alias("people"))


def co_edges(df: DataFrame, people: str = "people", top: int = 5) -> DataFrame:
    """Edges (src, dst, weight) between the first ``top`` people of each film, src < dst.

    Pairs are made inside the row from at most ``top`` names, then counted.
    """
    names = F.slice(people, 1, top)

    def partners(a: Column, i: Column) -> Column:
        return F.transform(
            F.slice(names, i + 2, F.lit(top)),
            lambda b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")),
        )

    pairs = df.select(F.inline_outer(F.flatten(F.transform(names, partners))))
    return pairs.filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def top_subgraph(edges: DataFrame, k: int = 100) -> DataFrame:
    """Edges between the ``k`` nodes of highest degree, with edge width 0.5 + 0.5 * weight."""
    top = broadcast_rows(degrees(edges).orderBy(F.desc("degree"), "node").limit(k).select("node"), k)
    inside = edges.join(top.withColumnRenamed("node", "src"), "src", "left_semi")
    inside = inside.join(top.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.select("src", "dst", "weight", (F.lit(0.5) + F.col("weight") * 0.5).alias("edge_width"))


def subgraph_nodes(edges: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` nodes of highest degree with their degree inside the subgraph and node size."""
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(k).select("node")
    inside = degrees(top_subgraph(edges, k))
    joined = top.join(inside, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    return joined.withColumn("node_size", F.col("degree") * 10 + 50)


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) with the smallest b of its a, as m.

    The smallest are written first: then both sides of the join are dealt out alike, and adaptive
    execution can split the pairs of a node that has very many.
    """
    return pairs.join(write_once(pairs.groupBy("a").agg(F.min("b").alias("m"))), "a")


def _state(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """Component of every node, named by its smallest node, as (node, component).

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014) until the pairs no longer change; the number of pairs never exceeds the
    number of edges, and rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder and the one before it deleted; only a count and a checksum reach the driver.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    pairs = write_once(pairs.filter("a <> b").distinct())
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, as the smallest of its nodes and the join with them would each compute it
        large = write_once(
            _with_smallest(both)
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        near = _with_smallest(large)
        small = (
            near.select("a", F.col("m").alias("b"))
            .union(near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        finished, pairs = pairs, write_once(small)
        previous, state = state, _state(pairs)
        delete_written(finished)
        delete_written(large)
        if state == previous:
            break
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes of the biggest component, the lowest name on ties."""
    biggest = (
        labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "component").limit(1).select("component")
    )
    return labels.join(F.broadcast(biggest), "component", "left_semi").select("node")


def largest_subgraph(edges: DataFrame, k: int = 100) -> DataFrame:
    """``top_subgraph`` of the largest component alone.

    An edge lies in the component of either end, so one join keeps the edges; they are written once for the
    components and the degrees.
    """
    edges = write_once(edges)
    nodes = write_once(largest_component(write_once(components(edges))))
    inside = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    return top_subgraph(write_once(inside), k)
