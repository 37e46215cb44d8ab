"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import arrow_map, guarded, hot_keys, materialize, read_table, small_batches, spread_join
from quernstone.llm.shingles import mixed, normal, shingles

SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**3)**10 = 0.9992.
BANDS, ROWS = 10, 3
#: Document frequencies are counted in so many hashed classes, in each of two tables whose hashes differ, whatever the corpus.
CLASSES, TABLES = 1 << 19, 2
_TABLE = 1 << 16


@cache
def _variates() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma distribution with shape 2, and their logarithms."""
    u = (np.arange(_TABLE) + 0.5) / _TABLE
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(1e-9, x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12))
    return x.astype(np.float32), np.log(x).astype(np.float32)


def _class_of(h: np.ndarray, table: int) -> np.ndarray:
    return ((h >> np.uint64(45 - 19 * table)) % np.uint64(CLASSES)).astype(np.int64)


class Frequencies:
    """Document frequencies of shingles: of a class's count, what exceeds the load that chance gives a class, the lesser of both tables.

    A class holds its shingle and, by chance, others. The load of others is that of the median class; it varies by
    the distance to the class at 84 %, a standard deviation of a normal distribution. What exceeds the median by less than three of
    those counts as one document. So however many shingles share a class, a passage of many documents stands out: with 10**9
    shingles a class holds 2,000 others, give or take 45, and a frequency above 135 documents is told within that.
    """

    def __init__(self, counts: np.ndarray, docs: int) -> None:
        self.docs = docs = max(1, docs)
        middle, high = np.percentile(counts, (50, 84), axis=1)[:, :, None]
        over = counts - middle
        df = np.where(over > 3 * (high - middle), np.maximum(1.0, over), 1.0)
        rarest = max(1e-9, float(np.log((1 + docs) / 2)))
        self.factor = (1 + np.log((1 + docs) / (1 + np.minimum(df, docs))) / rarest).astype(np.float32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """1 + idf / idf of a shingle of one document, idf being ln((1 + documents) / (1 + frequency)): 1 to 2."""
        return np.maximum(self.factor[0][_class_of(h, 0)], self.factor[1][_class_of(h, 1)])


def weights(found: np.ndarray, idf: Frequencies) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights: frequency in the text times the factor of their document frequency."""
    distinct, tf = np.unique(found, return_counts=True)
    return distinct, (tf * idf(distinct)).astype(np.float32)


def bands_of(texts: list[bytes], idf: Frequencies) -> list[list[int]]:
    """Band hashes of each normal text; none without words.

    Sample k of a text is the shingle and step with the least ln c - r (t + 1 - b), t being floor(ln w / r + b),
    where r and c (gamma) and b (uniform) follow from the shingle and k alone.
    """
    r_table, log_c = _variates()
    out: list[list[int]] = []
    group: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> None:
        full = [x for x in group if len(x[0])]
        if full:
            s = np.concatenate([x[0] for x in full])
            lw = np.log(np.concatenate([x[1] for x in full]))
            sizes = np.array([len(x[0]) for x in full])
            at = np.r_[0, np.cumsum(sizes)[:-1]]
            bands = np.zeros((BANDS, len(full)), np.uint64)
            for k in range(BANDS * ROWS):
                h = mixed(s * np.uint64(2 * k + 1) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
                r = r_table[h >> np.uint64(48)]
                b = ((h & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(_TABLE)
                t = np.floor(lw / r + b)
                a = log_c[(h >> np.uint64(24)) & np.uint64(0xFFFF)] - r * (t + 1 - b)
                hits = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, at), sizes))
                first = hits[np.searchsorted(hits, at)]  # the lowest shingle, if several tie
                sample = mixed(s[first] ^ mixed(t[first].astype(np.int64).view(np.uint64) + np.uint64(k)))
                bands[k // ROWS] = mixed(bands[k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + sample)
            bands = mixed(bands + np.arange(BANDS, dtype=np.uint64)[:, None])
        made = iter(bands.T.view(np.int64).tolist() if full else [])
        out.extend(next(made) if len(x[0]) else [] for x in group)
        group.clear()

    size = 0
    for found in shingles(texts):
        group.append(weights(found, idf))
        size += len(found)
        if size > 200_000:
            flush()
            size = 0
    flush()
    return out


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs, held, size = np.zeros((TABLES, CLASSES), np.int64), 0, [], 0

    def add() -> None:
        every = np.concatenate(held) if held else np.zeros(0, np.uint64)
        for t in range(TABLES):
            total[t] += np.bincount(_class_of(every, t), minlength=CLASSES)
        held.clear()

    for batch in batches:
        for found in shingles([normal(x) for x in batch.column("text").to_pylist()]):
            held.append(np.unique(found))
            docs, size = docs + 1, size + len(found)
            if size > 1_000_000:
                add()
                size = 0
    add()
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some], pa.int32()), pa.array(np.r_[docs, total.ravel()[some]], pa.int64())], names=["class", "n"])


def inverse_frequencies(docs: DataFrame) -> Frequencies:
    """From all documents; the driver gets a number for each class."""
    rows = small_batches(docs.select("text")).mapInArrow(_class_counts, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(TABLES * CLASSES)
    which, n = rows.column("class").to_numpy(), rows.column("n").to_numpy()
    counts[which[which >= 0]] = n[which >= 0]
    return Frequencies(counts.reshape(TABLES, CLASSES), int(n[which == -1].sum()))


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of least over sum of greatest weights."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(one[1][i], two[1][j]).sum(dtype=float))
    return least / max(1e-30, float(one[1].sum(dtype=float)) + float(two[1].sum(dtype=float)) - least)


def verified(pairs: DataFrame, texts: DataFrame, idf: Frequencies, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) whose texts (node, text) reach the similarity. Texts are shuffled at every size, so that the plan is the same at each."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_ta").to_pylist(), batch.column("_tb").to_pylist()):
                if x != last:  # pairs with one leader follow each other
                    last, own = x, weights(next(shingles([normal(x)])), idf)
                keep.append(similarity(own, weights(next(shingles([normal(y)])), idf)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = spread_join(pairs, right, "b", "a", hot_keys(pairs, "b"), "merge")
    return spread_join(both, left, "a", "b", hot_keys(pairs, "a"), "merge").select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp for the ends of links (a, b): the least node that can be reached. Labels spread along links and jump to their label's label, until no link has two."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "comp", F.lit(None).cast("long").alias("_was"))
        step = told.union(labels.select("node", "comp", F.col("comp").alias("_was"))).groupBy("node").agg(F.min("comp").alias("comp"), F.max("_was").alias("_was"))
        step = materialize(step, "labels")
        if step.where("comp <> _was").isEmpty():
            return labels
        jump = step.select(F.col("node").alias("_to"), F.col("comp").alias("_next"))
        labels = materialize(step.join(jump, step["comp"] == jump["_to"], "left").select("node", F.least("comp", "_next").alias("comp")), "labels")


def _stars(bucket: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs of each node of a bucket with the bucket's least and greatest node: twice the nodes at most."""
    ends = bucket.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi")
    joined = spread_join(bucket, ends, "key", "node", hot)
    return joined.select(F.explode(F.array("_lo", "_hi")).alias("_end"), "node").where("_end <> node").select(F.least("_end", "node").alias("a"), F.greatest("_end", "node").alias("b")).distinct()


#: Nodes of a block; a band is compared block against block, so that no task gets a whole band.
BLOCK = 200


def _block_pairs(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, comp, key, band, side, pair: the nodes of every two blocks of a band that hold a pair not tested yet, side being 0, 1, or 2 if a block meets itself.

    A class above BLOCK nodes has blocks of its own, which need not meet each other; smaller classes share blocks.
    Bands of two nodes are tested whole by _stars, and bands of one class need no test.
    """
    placed = shared.withColumn("comp", F.col("node")) if labels is None else shared.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_keys = sizes.groupBy("key").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_classes"), F.sum(F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)).alias("_small")).where("_all > 2 and _classes > 1")
    sizes = sizes.join(open_keys.select("key", "_small"), "key").withColumn("own", F.when(F.col("n") > BLOCK, F.col("comp")).otherwise(F.lit(-1)))
    dealt = placed.join(sizes, ["key", "comp"]).withColumn("_by", F.when(F.col("own") < 0, F.xxhash64("comp")).otherwise(F.xxhash64("node")))
    dealt = dealt.withColumn("block", F.pmod("_by", F.ceil(F.when(F.col("own") < 0, F.col("_small")).otherwise(F.col("n")) / BLOCK)))
    dealt = materialize(dealt.select("key", "band", "node", "comp", "own", "block"), "near-dealt")
    blocks = dealt.select("key", "own", "block").distinct()
    other = blocks.select("key", F.col("own").alias("_own"), F.col("block").alias("_block"))
    met = blocks.join(other, "key").where("own < _own or (own = -1 and _own = -1 and block <= _block)")
    met = materialize(met.withColumn("pair", F.monotonically_increasing_id()), "near-blocks")
    same = (F.col("own") == F.col("_own")) & (F.col("block") == F.col("_block"))
    ends = met.select("key", "own", "block", "pair", F.when(same, 2).otherwise(0).alias("side")).union(met.where(~same).select("key", F.col("_own").alias("own"), F.col("_block").alias("block"), "pair", F.lit(1).alias("side")))
    return dealt.join(ends, ["key", "own", "block"]).select("node", "comp", "band", "side", "pair")


def _compare(side: np.ndarray, comp: np.ndarray, bands: np.ndarray, band: int, own: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links between nodes of two blocks, enough to join every two that reach the similarity and are not joined yet. Pairs that share an earlier band are tested there."""
    sizes = np.array([len(x[0]) for x in own])
    at = np.r_[0, np.cumsum(sizes)]
    vocabulary, ids = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
    w = np.concatenate([x[1] for x in own]).astype(float)
    total = np.add.reduceat(w, at[:-1])
    comp, links = comp.copy(), []
    right = np.flatnonzero(side > 0)
    look = np.zeros(len(vocabulary))
    for x in np.flatnonzero(side != 1):
        ys = right[right > x] if side[x] == 2 else right
        ys = ys[(comp[ys] != comp[x]) & (np.minimum(total[ys], total[x]) >= least * (1 - 1e-6) * np.maximum(total[ys], total[x]))]
        if band and len(ys):
            ys = ys[~(bands[ys, :band] == bands[x, :band]).any(1)]
        if not len(ys):
            continue
        mine = slice(at[x], at[x + 1])
        look[ids[mine]] = w[mine]
        n = sizes[ys]
        first = np.cumsum(n) - n
        places = np.arange(n.sum()) + np.repeat(at[ys] - first, n)
        common = np.add.reduceat(np.minimum(look[ids[places]], w[places]), first)
        look[ids[mine]] = 0
        for y in ys[common >= least * (total[x] + total[ys] - common)]:
            if comp[y] != comp[x]:
                links.append((int(x), int(y)))
                comp[comp == comp[y]] = comp[x]
    return links


def _rest(shared: DataFrame, labels: DataFrame | None, texts: DataFrame, idf: Frequencies, least: float) -> DataFrame:
    """Links (a, b) that join all pairs of different classes that share a band and reach the similarity. Texts (node, text, _bands) meet each two blocks once, not each pair."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        own = [weights(x, idf) for x in shingles([normal(x) for x in table.column("text").to_pylist()])]
        bands = np.array(table.column("_bands").to_pylist(), np.int64)
        found = _compare(table.column("side").to_numpy(), table.column("comp").to_numpy(), bands, table.column("band")[0].as_py(), own, least)
        a, b = (np.array([node[x[i]] for x in found], np.int64) for i in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    met = _block_pairs(shared, labels).join(texts.hint("merge"), "node")
    return met.groupBy("pair").applyInArrow(run, "a long, b long")


def _classified(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """docs with _row, a stable number, and _digest of the normal text; and _digest, class_id, _comp of every digest."""
    clean = docs.drop("class_id", "_row", "_comp")
    idf = inverse_frequencies(clean)

    def features(batch: pa.RecordBatch) -> dict:
        texts = [normal(x) for x in batch.column("text").to_pylist()]
        return {"_digest": pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()), "_bands": pa.array(bands_of(texts, idf), pa.list_(pa.int64()))}

    fields = [T.StructField("_digest", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType()))]
    rows = materialize(arrow_map(clean, fields, features).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    nodes = materialize(rows.groupBy("_digest").agg(F.min("_row").alias("node"), F.min("doc_id").alias("_first")), "near-nodes")
    banded = rows.select("_row", F.posexplode("_bands").alias("band", "key")).join(nodes.select(F.col("node").alias("_row")), "_row", "left_semi")
    banded = materialize(banded.select("band", "key", F.col("_row").alias("node")), "near-bands")
    # a key that one node has alone says nothing
    hot = hot_keys(banded, "key")
    several = banded.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    shared = materialize(spread_join(banded, several, "key", "node", hot).select("band", "key", "node"), "near-bands")
    involved = shared.select(F.col("node").alias("_row")).distinct()
    texts = materialize(rows.select("_row", "text", "_bands").join(involved.hint("merge"), "_row", "left_semi").withColumnRenamed("_row", "node"), "near-texts")
    found = materialize(verified(materialize(_stars(shared, hot), "near-pairs"), texts, idf, least), "near-links")
    labels = None if found.isEmpty() else components(found)
    # what shares a band and is still apart
    found = materialize(_rest(shared, labels, texts, idf, least), "near-links")
    if not found.isEmpty():
        labels = components(found if labels is None else found.union(labels.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))))
    if labels is None:
        placed = nodes.withColumn("comp", F.col("node"))
    else:
        placed = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(placed, "near-classes")
    named = placed.groupBy("comp").agg(F.min("_first").alias("class_id"))
    return rows.drop("_bands"), placed.join(named, "comp").select("_digest", "class_id", F.col("comp").alias("_comp"))


@guarded
def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Each row of docs (doc_id, text, others) with class_id: the least doc_id of its class.

    Texts equal up to white space and the case of A-Z are one node. Nodes that share a band are tested against the
    band's least and greatest node. Then every pair of different classes that shares a band is tested, block against
    block, so no pair that shares a band is left out; neither copies nor what is linked by then are paired with each
    other. Two searches for components, whatever the groups: each step of them is a job. Null and empty texts are copies of each other; a null doc_id
    names no class unless its class has no other. Repeated rows are copies. Columns named like a result are
    replaced. An empty table gives none.
    """
    rows, member = _classified(docs, least)
    return rows.join(member, "_digest").drop("_digest", "_row", "_comp")


@guarded
def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near duplicates: that with the least doc_id, the first of repeated ones. Texts are shuffled once, to meet the rows that stay."""
    rows, member = _classified(docs, least)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    chosen = rows.select("doc_id", "_row", "_digest").join(member, "_digest").groupBy("_comp").agg(F.min_by("_row", order).alias("_row"))
    return rows.join(materialize(chosen.select("_row"), "near-chosen").hint("merge"), "_row", "left_semi").select(*docs.columns)


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id")
