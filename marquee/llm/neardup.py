"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import mix, prepare, release, slices, text_or_empty, texts_of
from marquee.llm.shingles import WIDTH, shingles
from marquee.operators.graph import components
from marquee.runtime import write_once

IDF_BUCKETS = 1 << 18
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SLOT = 4
MET_WHOLE = 3  # members of a bucket of one slot whose pairs all meet: the smallest with both, and those two
MET_BLOCK = 256  # texts of one side of a group that meets in a task
MET_MARKS = 1 << 19
ROUNDING = 1e-6


def _node() -> F.Column:
    """The text's own key: equal texts are one node from the start."""
    return F.unhex(F.md5(text_or_empty()))


def _rows(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    release()
    data, offsets = texts_of(batch.column(batch.schema.get_field_index(name)))
    for first, last in slices(offsets):
        yield first, last, *shingles(data, offsets[first : last + 1])


def document_frequency(df: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each hash bucket of shingles occurs.

    As in a hashed TF-IDF, shingles share 2^18 buckets, so what reaches the driver is bounded at any size
    of the corpus while every shingle of every document is counted. Each task adds up its own documents. The counts come
    as Arrow columns, 4 MB: as rows they would be as many objects, on the driver's heap and again in its Python.
    """
    prepare(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(IDF_BUCKETS, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for first, last, hashes, bounds in _rows(batch, "text"):
                bucket = (hashes & np.uint64(IDF_BUCKETS - 1)).astype(np.int64)
                pairs = np.repeat(np.arange(last - first), np.diff(bounds)) * IDF_BUCKETS + bucket
                counts += np.bincount(np.unique(pairs) % IDF_BUCKETS, minlength=IDF_BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(counts[used], docs))], names=["bucket", "n"]
        )

    found = (
        df.select(text_or_empty().alias("text")).mapInArrow(count, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    counts = np.zeros(IDF_BUCKETS + 1, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return int(counts[-1]), counts[:-1]


def idf_of(docs: int, counts: np.ndarray) -> np.ndarray:
    return (np.log((1 + docs) / (1 + counts)) + 1).astype(np.float32)


def weighted(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text in order, and their weights (1 + ln tf) * idf."""
    own, n = np.unique(hashes, return_counts=True)
    weights = idf[(own & np.uint64(IDF_BUCKETS - 1)).astype(np.int64)]
    return own, weights * (1 + np.log(n)).astype(np.float32)


def _gamma() -> np.ndarray:
    """65,536 quantiles of the Gamma(2, 1) law, from which both draws of the sampling come."""
    x = np.concatenate([np.geomspace(1e-7, 1, 200_000), np.linspace(1, 40, 400_000)[1:]])
    return np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    """Consistent weighted samples (Ioffe 2010): two sets agree on one with their weighted Jaccard similarity."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = (draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.shift = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None]
        gamma = _gamma()
        self.r = gamma.astype(np.float32)
        self.per_r = (1 / gamma).astype(np.float32)
        self.log_c = np.log(gamma).astype(np.float32)

    def _block(self, hashes: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest ln a of each sample over the block, and the sample."""
        x = hashes[None, :] * self.factor + self.shift
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        fields = x.view(np.uint16).reshape(*x.shape, 4)  # four independent 16-bit draws
        r = self.r[fields[..., 3]]
        beta = fields[..., 2].astype(np.float32)
        beta *= np.float32(2**-16)
        t = self.per_r[fields[..., 3]]
        t *= logs
        t += beta
        np.floor(t, out=t)
        a = t - beta
        a += 1
        a *= r
        np.subtract(self.log_c[fields[..., 1]], a, out=a)
        at = a.argmin(axis=1)
        line = np.arange(len(at))
        picked = mix(hashes[at] ^ (t[line, at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return a[line, at], picked

    def keys(self, hashes: np.ndarray, weights: np.ndarray, block: int = 1024) -> np.ndarray:
        """One key a band."""
        best, sample = None, None
        logs = np.log(weights)
        for i in range(0, len(hashes), block):
            a, picked = self._block(hashes[i : i + block], logs[i : i + block])
            if best is None:
                best, sample = a, picked
            else:
                less = a < best
                best, sample = np.where(less, a, best), np.where(less, picked, sample)
        parts = sample.reshape(self.bands, self.rows)
        key = np.zeros(self.bands, np.uint64)
        for j in range(self.rows):
            key = mix(key * np.uint64(31) + parts[:, j])
        return key.view(np.int64)


def bands(df: DataFrame, idf: np.ndarray) -> DataFrame:
    """(band, key, node) of every text that has words; texts are read in place, none is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(idf)  # 1 MB at any size of the corpus

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        band = np.arange(sampler.bands, dtype=np.int32)
        for batch in batches:
            nodes = batch.column(0)
            at, keys = [], []
            for first, last, hashes, bounds in _rows(batch, "text"):
                for i in range(last - first):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    if len(own):
                        at.append(first + i)
                        keys.append(sampler.keys(*weighted(own, shared.value)))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(band, len(at))), pa.array(np.concatenate(keys)),
                        nodes.take(pa.array(np.repeat(np.array(at), sampler.bands))),
                    ],
                    names=["band", "key", "node"],
                )

    return (
        df.select(_node().alias("node"), text_or_empty().alias("text"))
        .mapInArrow(sample, "band int, key long, node binary").distinct()
    )


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is ``least`` or more. ``texts``: (node, text), one a node."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for key, name in (("a", "text_a"), ("b", "text_b")):
                nodes = batch.column(batch.schema.get_field_index(key)).to_pylist()
                place: dict[bytes, int] = {}
                firsts = [i for i, x in enumerate(nodes) if place.setdefault(x, i) == i]
                column = batch.column(batch.schema.get_field_index(name)).take(pa.array(firsts, pa.int64()))
                data, offsets = texts_of(column)
                sets = {}
                for first, last in slices(offsets):
                    hashes, bounds = shingles(data, offsets[first : last + 1])
                    for i in range(last - first):
                        sets[nodes[firsts[first + i]]] = weighted(hashes[bounds[i] : bounds[i + 1]], shared.value)
                sides.append([sets[x] for x in nodes])
            keep = []
            for i, ((h, w), (g, v)) in enumerate(zip(*sides)):
                _, x, y = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                both = np.minimum(w[x], v[y]).sum(dtype=np.float64)
                either = w.sum(dtype=np.float64) + v.sum(dtype=np.float64) - both
                if both >= least * either:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary")


def _meetings(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes to compare, a number that grows with the members and never with a bucket's square.

    ``members``: (band, key, node). Each one meets the smallest of its bucket, and the one after it in a slot of
    about four that a hash of band and node gives it.
    """
    key = ["band", "key"]
    buckets = write_once(members.groupBy(*key).agg(
        F.min("node").alias("leader"), F.ceil(F.count(F.lit(1)) / SLOT).alias("slots")
    ))
    placed = members.join(buckets, key).withColumn("slot", F.pmod(F.xxhash64("band", "node"), F.col("slots")))
    after = F.lead("node").over(Window.partitionBy(*key, "slot").orderBy("node"))
    met = placed.withColumn("next", after).select("node", F.explode(F.array("leader", "next")).alias("other"))
    return met.filter("node <> other").select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    ).distinct()


def shingle_rows(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, token, weight) of every distinct shingle of ``texts`` (node, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, hashes, bounds in _rows(batch, "text"):
                own = [weighted(hashes[bounds[i] : bounds[i + 1]], shared.value) for i in range(last - first)]
                rows = pa.array(first + np.repeat(np.arange(last - first), [len(t) for t, _ in own]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array(np.concatenate([t for t, _ in own]).view(np.int64)),
                     pa.array(np.concatenate([w for _, w in own]).astype(np.float64))],
                    names=["node", "token", "weight"],
                )

    return texts.select("node", "text").mapInArrow(cut, "node binary, token long, weight double")


def prefixes(texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """(node, total, marks): the rarest shingles of each text, one of which it shares with any similar text.

    Shingles are put in one order for all ``texts`` (node, text): by how many of these texts hold them, counted exactly, rare
    ones first. A mark is (token, weight, rest), ``rest`` the weight from this shingle on. Two texts of similarity ``least`` share
    a weight of at least ``least`` times the greater total, and none of it comes before their first common shingle, so that
    one has this much rest in both. Shingles of one text only are in the order and make no mark.
    """
    rows = write_once(shingle_rows(texts, idf))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("node").orderBy("n", "token")
    ranked = rows.join(counts, "token").withColumns({
        "total": F.sum("weight").over(Window.partitionBy("node")),
        "before": F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    }).withColumn("rest", F.col("total") - F.col("before"))
    marks = ranked.filter((F.col("n") > 1) & (F.col("rest") >= least * (1 - ROUNDING) * F.col("total")))
    return marks.groupBy("node").agg(
        F.first("total").alias("total"), F.collect_list(F.struct("token", "weight", "rest")).alias("marks")
    )


def _similar_enough(left: pa.Table, right: pa.Table, least: float) -> np.ndarray:
    """Places (i, j) of rows of prefixes that may be similar: they share marks, and weight enough may be shared in all."""
    sides = []
    for rows in (left, right):
        marks = rows.column("marks").combine_chunks()
        at = np.repeat(np.arange(len(rows)), marks.value_lengths().to_numpy(zero_copy_only=False))
        fields = [marks.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("token", "weight", "rest")]
        sides.append((at, *fields, rows.column("total").to_numpy()))
    (at, token, weight, rest, total), (at_r, token_r, weight_r, rest_r, total_r) = sides
    order = np.argsort(token_r, kind="stable")
    at_r, token_r, weight_r, rest_r = at_r[order], token_r[order], weight_r[order], rest_r[order]
    low, high = np.searchsorted(token_r, token, "left"), np.searchsorted(token_r, token, "right")
    shape = len(left) * len(right)
    first, both = np.zeros(shape), np.zeros(shape)
    after, after_r = np.full(shape, np.inf), np.full(shape, np.inf)
    ends = np.cumsum(high - low)
    done = 0
    while done < len(token):  # so many shared marks at a time
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + MET_MARKS, "right")))
        n = (high - low)[done:until]
        mine = np.repeat(np.arange(done, until), n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[done:until], n)
        pair = at[mine] * len(right) + at_r[other]
        np.maximum.at(first, pair, np.minimum(rest[mine], rest_r[other]))
        both += np.bincount(pair, np.minimum(weight[mine], weight_r[other]), shape)
        np.minimum.at(after, pair, (rest - weight)[mine])
        np.minimum.at(after_r, pair, (rest_r - weight_r)[other])
        done = until
    # what two similar texts share is this much of both totals; before their first common shingle there is none of it
    needed = least / (1 + least) * (1 - ROUNDING) * (total[:, None] + total_r[None, :]).ravel()
    enough = (both > 0) & (first >= needed) & (both + np.minimum(after, after_r) >= needed)
    return np.stack(np.divmod(np.flatnonzero(enough), max(1, len(right))), axis=1)


def _unmet(marked: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Pairs (a, b) of different classes that can be similar, in all buckets left with several classes.

    ``marked``: (band, key, node, component). No bucket is sampled: pairs left out share no shingle that similar texts
    must share, or too little weight. The members outside the largest class of a bucket meet each other and the largest class in
    blocks, one group of at most two blocks a task; shared shingles are matched inside the task, so that the rows dealt
    out grow with the members and only pairs that may be similar leave it. Buckets of up to ``MET_WHOLE`` members have met in all pairs before.
    """
    key = ["band", "key"]
    counts = marked.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"))
    left = counts.groupBy(*key).agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    left = left.filter((F.col("classes") > 1) & (F.col("n") > MET_WHOLE))
    left = write_once(left.select(
        *key, F.col("main.component").alias("largest"), F.ceil(F.col("main.n") / MET_BLOCK).alias("main_blocks"),
        F.ceil((F.col("n") - F.col("main.n")) / MET_BLOCK).alias("blocks"),
    ))
    members = write_once(marked.join(left, key))
    marks = write_once(prefixes(texts.join(members.select("node").distinct(), "node", "left_semi"), idf, least))
    members = members.withColumn("main", F.col("component") == F.col("largest"))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("main_blocks")).otherwise(F.col("blocks"))))
    zero = F.lit(0).cast("long")
    # groups (low, high, with_main): two blocks outside the largest class, or one of them and one of the largest class
    with_others = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda i: F.struct(
        F.least(i, F.col("own")).alias("low"), F.greatest(i, F.col("own")).alias("high"), F.lit(False).alias("with_main")))
    with_main = F.transform(F.sequence(zero, F.col("main_blocks") - 1), lambda i: F.struct(
        F.col("own").alias("low"), i.alias("high"), F.lit(True).alias("with_main")))
    as_main = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda i: F.struct(
        i.alias("low"), F.col("own").alias("high"), F.lit(True).alias("with_main")))
    groups = F.when(F.col("main"), as_main).otherwise(F.concat(with_others, with_main))
    dealt = members.select(*key, "node", "component", "main", "own", F.explode(groups).alias("g"))
    dealt = dealt.select(*key, "g.low", "g.high", "g.with_main", "node", "component", "main", "own").join(marks, "node")

    def meet(table: pa.Table) -> pa.Table:
        low, high, with_main = (table.column(c)[0].as_py() for c in ("low", "high", "with_main"))
        own, main = table.column("own").to_numpy(), table.column("main").to_numpy(zero_copy_only=False)
        sides = [table.filter(pa.array(~main & (own == low))), table.filter(pa.array((main == with_main) & (own == high)))]
        pairs = set()
        if len(sides[0]) and len(sides[1]):
            (a, first), (b, second) = ([s.column(c).to_pylist() for c in ("node", "component")] for s in sides)
            for i, j in _similar_enough(*sides, least).tolist():
                if first[i] != second[j]:
                    pairs.add((min(a[i], b[j]), max(a[i], b[j])))
        pairs = sorted(pairs)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    met = dealt.groupBy(*key, "low", "high", "with_main").applyInArrow(meet, "a binary, b binary")
    return met.distinct()


def _classes(df: DataFrame, least: float) -> DataFrame:
    """(node, class_id, keeper, class_size) of every distinct text; see ``near_duplicates``."""
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    idf = idf_of(*document_frequency(docs))
    buckets = write_once(bands(docs, idf))
    several = buckets.groupBy("band", "key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    several = write_once(several.filter("leader < last").select("band", "key", "leader"))
    shared = write_once(buckets.join(several, ["band", "key"]))
    named = write_once(
        docs.select(_node().alias("node"), "doc_id").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    )
    chosen = named.join(shared.select("node").distinct(), "node", "left_semi").withColumnsRenamed({"node": "_n", "doc_id": "_d"})
    texts = docs.select(_node().alias("node"), "doc_id", text_or_empty().alias("text"))
    # the doc_id is part of the key, so that the copies of one text are not all sent to one task
    same = (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    texts = write_once(texts.join(chosen, same, "left_semi").select("node", "text").dropDuplicates(["node"]))

    key = ["band", "key"]
    tried, links, members = None, None, shared.select(*key, "node")
    while True:
        pairs = _meetings(members)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = write_once(pairs)
        found = write_once(verified(pairs, texts, idf, least))
        if links is not None and found.isEmpty():
            break
        links = found if links is None else write_once(links.unionByName(found))
        tried = pairs if tried is None else write_once(tried.unionByName(pairs))
        classes = write_once(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        marked = shared.join(classes, "node", "left").select(*key, "node", F.coalesce("component", "node").alias("component"))
        marked = write_once(marked)
        counts = marked.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"))
        split = counts.groupBy(*key).agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("classes"))
        split = write_once(split.filter("classes > 2").select(*key, F.col("main.component").alias("main")))
        members = write_once(marked.join(split, key).filter("component <> main").select(*key, "node"))

    unmet = write_once(_unmet(marked, texts, idf, least).join(tried, ["a", "b"], "left_anti"))
    found = write_once(verified(unmet, texts, idf, least))
    if not found.isEmpty():  # else the classes stand: the last round linked no more
        links = links.unionByName(found)
        classes = write_once(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))

    named = write_once(
        named.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    sizes = write_once(
        named.groupBy("component").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"), F.sum("copies").alias("class_size")
        ).select("component", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("keeper"), "class_size")
    )
    return write_once(named.select("node", "component").join(sizes, "component").drop("component"))


def near_duplicates(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: (doc_id, class_id, class_size, kept).

    Documents of equal text are one class. Classes are linked when the weighted Jaccard similarity of
    their TF-IDF shingles of five words is ``least`` or more; linked classes are one class, named by its smallest
    doc_id. ``kept`` is true for the document that names the class.

    Each text gets 64 consistent weighted samples in 16 bands of four. Texts that share a band are
    candidates: each meets the smallest of its bucket and, in every band, another one drawn by hash, so comparisons
    grow with the members and not with the square of a bucket. Those outside the largest class of their bucket meet
    again among themselves until a round links no more. Buckets left with several classes are then settled without
    sampling: all their texts of different classes are compared that share one of their rarest shingles and enough
    weight, as similar texts must. Links that only join members of one class are not needed.

    Null and empty texts are equal to each other and to nothing else. Texts under five words are one shingle.
    Repeated rows are copies. Rows without doc_id get the class of their text; a class without any doc_id has
    class_id null and keeps all its rows. Other columns play no part.
    """
    named = _classes(df, least)
    ids = df.select(_node().alias("node"), F.col("doc_id").cast("long").alias("doc_id")).join(named, "node")
    return ids.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicate(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stay: of every class of ``near_duplicates`` the one that names it, once."""
    named = _classes(df, least).filter("node = keeper").select(F.col("node").alias("_llm_node"), F.col("class_id").alias("_llm_class"))
    rows = df.join(named, _node() == F.col("_llm_node"))
    rows = rows.filter(F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_class")))
    return rows.dropDuplicates(["_llm_node"]).drop("_llm_node", "_llm_class")
