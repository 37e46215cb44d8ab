"""Benchmark passages in documents by a distributed positional inverted index, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import guarded, materialize, read_table, text_or_empty

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ("doc_id", "_th")


def split_words(text: Column) -> Column:
    """Words of a text, with an empty string before the first or after the last where a separator stands there."""
    return F.split(F.translate(text, UPPER, LOWER), SEPARATORS)


def count_words(words: Column) -> Column:
    """Length of what split_words() gives, without the empty strings at its ends."""
    n = F.size(words)
    return (n - (words[0] == "").cast("int") - ((n > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def test_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item, win, len, off, word: each window of width words of an item, a row for each word; a shorter item is one window. Numbers are given once, in a table."""
    words = F.filter(split_words(text_or_empty()), lambda w: w != "")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("_w")).where(F.size("_w") > 0).distinct()
    starts = items.withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - width + 1))))
    cut = starts.select("item", F.slice("_w", F.col("_at"), width).alias("_w")).distinct()
    numbered = materialize(cut.withColumn("win", F.monotonically_increasing_id()), "test-numbers")
    return numbered.select("item", "win", F.size("_w").alias("len"), F.posexplode("_w").alias("off", "word"))


@dataclass
class PositionalIndex:
    """postings (doc_id, _th, pos, term) of the training texts for every term of the tests, and ranked test windows."""

    postings: DataFrame
    ranked: DataFrame

    def of_terms(self, terms: DataFrame) -> DataFrame:
        return self.postings.join(terms.select("term").distinct(), "term", "left_semi")


def build_index(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> PositionalIndex:
    """Stores the postings as a table, and ranks the terms of each window from the rarest by their number of postings.

    A posting list of a word that no test has would never be read, so none is stored. Tables of the tests are
    written before they are joined: Spark broadcasts them only if their files are below its limit.
    """
    windows = materialize(test_windows(benchmark, width), "test-windows")
    terms = materialize(windows.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "test-terms")
    exploded = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.posexplode(split_words(F.col("text"))).alias("pos", "word"))
    postings = materialize(exploded.join(terms, "word").select("doc_id", "_th", "pos", "term"), "postings")
    seen = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-counts")
    rank = F.row_number().over(Window.partitionBy("win").orderBy("df", "word", "off"))
    ranked = windows.join(terms, "word").join(seen, "term", "left").fillna({"df": 0}).withColumn("rank", rank)
    return PositionalIndex(postings, materialize(ranked.drop("word"), "test-ranks"))


def _on(left: DataFrame, right: DataFrame, *more: str) -> list[Column]:
    return [left["doc_id"].eqNullSafe(right["doc_id"]), *(left[c] == right[c] for c in ("_th", *more))]


def _narrow(found: DataFrame, postings: DataFrame) -> DataFrame:
    """Rows of found whose (pos, term) is a posting of their document."""
    return found.join(postings, _on(found, postings, "pos", "term"), "left_semi")


def window_starts(index: PositionalIndex) -> DataFrame:
    """doc_id, _th, win, len, start: where a window would begin by a posting of its rarest term, less the term's offset."""
    first = index.ranked.where("rank = 1").select("term", "win", "len", "off")
    at = index.postings.join(first, "term").select(*DOC, "win", "len", (F.col("pos") - F.col("off")).alias("start"))
    return materialize(at.distinct(), "starts")


def _items(index: PositionalIndex, found: DataFrame) -> DataFrame:
    return found.join(index.ranked.where("rank = 1").select("win", "item"), "win").drop("win")


def exact_matches(index: PositionalIndex, starts: DataFrame | None = None) -> DataFrame:
    """doc_id, _th, item, start, len of every place where a whole window occurs.

    The postings of a window's rarest term, less the term's offset, are where it may start; those of the second
    rarest term thin them out; the other terms are then looked up in the postings of the documents that are left.
    """
    ranked = index.ranked
    starts = window_starts(index) if starts is None else starts
    second = ranked.where("rank = 2").select("win", "off", "term")
    wanted = starts.join(second, "win").select(*DOC, "win", "len", "start", "term", (F.col("start") + F.col("off")).alias("pos"))
    pairs = materialize(_narrow(wanted, index.of_terms(second)).drop("term", "pos"), "starts")
    left = materialize(pairs.where("len > 2").select(*DOC).distinct(), "starts")
    others = ranked.where("rank > 2").select("win", "off", "term")
    postings = index.postings.join(left, _on(index.postings, left), "left_semi")
    wanted = pairs.where("len > 2").join(others, "win").withColumn("pos", F.col("start") + F.col("off"))
    whole = _narrow(wanted, postings).groupBy(*DOC, "win", "len", "start").agg(F.count(F.lit(1)).alias("n")).where("n = len - 2").drop("n")
    names = [*DOC, "win", "len", "start"]
    every = whole.select(names).unionByName(pairs.where("len = 2").select(names)).unionByName(starts.where("len = 1").select(names))
    return _items(index, every)


#: How far a term may stand from its place in a proximity match.
SLOP = 5


def _near(wanted: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """Rows of wanted with a posting of their term within slop of pos in their document, compared in cells of slop + 1 places and the cells around."""
    cell = F.floor(F.col("pos") / (slop + 1))
    spread = wanted.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    own = postings.select(*DOC, "term", cell.alias("_cell"), F.col("pos").alias("_at"))
    both = spread.join(own, _on(spread, own, "term", "_cell")).where(F.abs(F.col("_at") - F.col("pos")) <= slop)
    return both.select(*(spread[c] for c in wanted.columns))


def proximity_matches(index: PositionalIndex, slop: int = SLOP, starts: DataFrame | None = None) -> DataFrame:
    """doc_id, _th, item, start, len of every place where each term of a window stands within slop words of its place in it; the rarest term is the anchor.

    As with exact matches the second rarest term thins places out before the others are looked up. Exact matches are among these.
    """
    ranked = index.ranked
    starts = window_starts(index) if starts is None else starts
    names = [*DOC, "win", "len", "start"]
    second = ranked.where("rank = 2").select("win", "off", "term")
    wanted = starts.join(second, "win").select(*names, "term", (F.col("start") + F.col("off")).alias("pos"))
    pairs = materialize(_near(wanted, index.of_terms(second), slop).select(names).distinct(), "near-starts")
    left = materialize(pairs.where("len > 2").select(*DOC).distinct(), "near-starts")
    postings = index.postings.join(left, _on(index.postings, left), "left_semi")
    others = ranked.where("rank > 2").select("win", "off", "term")
    wanted = pairs.where("len > 2").join(others, "win").withColumn("pos", F.col("start") + F.col("off"))
    whole = _near(wanted.select(*names, "off", "term", "pos"), postings, slop).groupBy(names).agg(F.count_distinct("off").alias("n")).where("n = len - 2")
    every = whole.select(names).unionByName(pairs.where("len = 2").select(names)).unionByName(starts.where("len = 1").select(names))
    return _items(index, every)


@guarded
def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Each row of docs (doc_id, text and others) with n_words, n_hit, n_items, items_sha256, contaminated, and n_near: the items with a proximity match; texts don't travel.

    Null texts have no words and null test texts no windows; a null item_id is an item with an empty name.
    Documents are told apart by doc_id (null is a value) and a 64-bit hash of the text, so repeated rows get
    the same result each. Columns named like a result are replaced. Empty tables give no hits or no rows.
    """
    words = split_words(F.col("text"))
    whole = docs.withColumn("text", text_or_empty())
    index = build_index(whole.select("doc_id", "text"), benchmark, width)
    starts = window_starts(index)
    found = materialize(exact_matches(index, starts), "matches")
    near = proximity_matches(index, slop, starts).select(*DOC, "item").distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("_near"))
    places = found.select(*DOC, F.explode(F.expr("sequence(start, start + len - 1)")).alias("p")).distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("_hit"))
    items = found.select(*DOC, "item").distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("_sha"))
    both = places.join(items, _on(places, items)).select(places["doc_id"], places["_th"], "_hit", "_items", "_sha")
    hits = near.join(both, _on(near, both), "left")  # an exact match is a proximity match
    hits = materialize(hits.select(near["doc_id"].alias("_id"), near["_th"].alias("_h"), "_near", "_hit", "_items", "_sha"), "hits")
    keep = [c for c in docs.columns if c not in ("text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")]
    base = whole.select(*keep, F.xxhash64("text").alias("_th"), count_words(words).alias("n_words"))
    joined = base.join(hits, base["doc_id"].eqNullSafe(hits["_id"]) & (base["_th"] == hits["_h"]), "left")
    none = F.lit(0)
    return joined.select(
        *keep, "n_words", F.coalesce("_hit", none).cast("long").alias("n_hit"), F.coalesce("_items", none).cast("long").alias("n_items"),
        F.coalesce("_sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("_hit").isNotNull().alias("contaminated"), F.coalesce("_near", none).cast("long").alias("n_near"),
    )


@guarded
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows of docs in which no window of the benchmark occurs."""
    whole = docs.select("doc_id", text_or_empty().alias("text"))
    bad = materialize(exact_matches(build_index(whole, benchmark, width)).select(*DOC).distinct(), "contaminated")
    hash_of = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (hash_of == bad["_th"]), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM wins), hits AS (
  SELECT g.doc_id, g.i, g.n, wins.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)) g
  JOIN wins ON g.g = wins.g AND g.n = wins.n
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id
), lists AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS l FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), terms AS (
  SELECT item_id, l, unnest(l) AS word, unnest(generate_series(0, len(l) - 1)) AS o FROM lists
), posts AS (
  SELECT * FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d) WHERE word IN (SELECT word FROM terms)
), rare AS (
  SELECT item_id, l, word, o FROM (SELECT *, row_number() OVER (PARTITION BY item_id, l ORDER BY coalesce(df, 0), word, o) AS r FROM terms LEFT JOIN (SELECT word, count(*) AS df FROM posts GROUP BY word) USING (word)) WHERE r = 1
), starts AS (
  SELECT DISTINCT doc_id, item_id, l, pos - o AS s FROM rare JOIN posts USING (word)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM starts JOIN d USING (doc_id)
  WHERE len(list_filter(generate_series(0, len(l) - 1), lambda o: s + o + 5 >= 1 AND list_contains(w[greatest(1, s + o - 5):greatest(1, s + o + 5)], l[o + 1]))) = len(l) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
