"""Sources mixed to target weights: whole passes, then a subset whose words sum to the remaining budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import guarded, materialize, number_within, read_table

SEED = 17
#: Weights of the sources in the order of their code points, repeating.
WEIGHTS = (3, 1, 2)
#: The share of all words that the mix takes, and how often a document may be taken.
SHARE, MOST_COPIES = 1.5, 2
#: The dynamic program starts once the remaining budget is at most so many times the longest document.
TABLE_SPAN = 4


def subset_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to budget from below as can be reached.

    Lengths count in units of their common divisor. Even shares of every length come first; single documents, longest first, then lower the remaining budget
    to TABLE_SPAN times the longest length; bounded-knapsack dynamic programming over powers of two of each
    length's remaining documents settles it. If that misses the budget by more than least_gap() says any subset must, each length gives back a
    document, then two, and so on until it doesn't or nothing is left to give: either way the sum is the best there is.
    """
    unit = int(np.gcd.reduce(lengths))
    lengths, budget = lengths // unit, budget // unit
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    longest = int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= TABLE_SPAN * longest:
            break
        more = min(int(counts[i] - take[i]), max(0, (left - (TABLE_SPAN - 1) * longest) // int(lengths[i])))
        take[i] += more
        left -= more * int(lengths[i])
    best, gap, back, least = take, left, 0, least_gap(lengths, counts, budget)
    while True:
        kept = take - np.minimum(take, back)
        tried, missed = _filled(lengths, counts, kept, budget - int((lengths * kept).sum()))
        if missed < gap or not back:
            best, gap = tried, missed
        back = max(1, 2 * back)
        if gap <= least or not kept.any():
            return best


def least_gap(lengths: np.ndarray, counts: np.ndarray, budget: int) -> int:
    """No subset comes nearer to budget from below: what the lengths leave over in multiples of the commonest one, taken as often as one likes, plus any subset of the others."""
    most = int(np.argmax(counts))
    step = int(lengths[most])
    rest = np.zeros(step, bool)
    rest[0] = True
    for i in np.argsort(-counts, kind="stable"):
        free, k = (0 if i == most else min(int(counts[i]), step - 1)), 1
        while free > 0 and not rest.all():
            k = min(k, free)
            rest |= np.roll(rest, k * int(lengths[i]) % step)
            free, k = free - k, 2 * k
    return int(((budget - np.flatnonzero(rest)) % step).min())


def _filled(lengths: np.ndarray, counts: np.ndarray, kept: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """kept and more documents, whose words come as near to left from below as the others allow; and how many words are missed."""
    by = np.full(left + 1, -1, dtype=np.int32)  # the piece that first reached a sum
    by[0] = -2
    pieces: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        free, k = min(int(counts[i] - kept[i]), left // int(lengths[i])), 1
        while free > 0 and by[left] == -1:
            k = min(k, free)
            step = k * int(lengths[i])
            if step <= left:
                fresh = (by[:-step] != -1) & (by[step:] == -1)
                by[step:][fresh] = len(pieces)
                pieces.append((int(i), k))
            free, k = free - k, 2 * k
        if by[left] != -1:
            break
    at = int(np.flatnonzero(by != -1)[-1])
    take, missed = kept.copy(), left - at
    while at:
        i, k = pieces[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take, missed


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: share of all words by weight, none above most times its source's words.

    Sources that reach their cap come first by words for each weight; what is left is shared by the weights of the rest.
    The windows here hold one row for each source.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = Window.orderBy("_room", F.col(source).asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("_w", weight).withColumn("_room", most * F.col("source_size") / F.col("_w"))
    filled = ranked.withColumn(
        "_level",
        (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)),
    )
    level = F.max(F.when(F.col("_room") >= F.col("_level"), F.col("_level"))).over(everything)
    return filled.select(source, "source_size", F.least(most * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w")).cast("double").alias("target"))


@guarded
def mix(docs: DataFrame, size: Column, source: str = "source", tie: tuple[str, ...] = ("doc_id",), seed: int = SEED, **targets) -> DataFrame:
    """Each row of docs with size, source_size, target and copies (how often the mix takes it).

    Documents of one source and length are alike to the budget; a seeded hash of tie picks among them. A null
    source is a source of its own, last in order. A document of size 0 (null or empty text) is never taken.
    Rows that agree in tie are interchangeable. Columns of docs named like a result are replaced. An empty
    table gives none. Rows are shuffled once, by source, length and a hashed bucket. A source is planned in one task from
    a row for each of its lengths: as many as its longest document has words at most.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    sized = docs.drop("source_size", "target", "copies").withColumn("size", size.cast("long")).withColumn("_s", key)
    counts = materialize(sized.groupBy("_s", F.col(source).alias("_source"), "size").agg(F.count(F.lit(1)).alias("_n")), "mix-counts")
    sums = counts.groupBy("_s", "_source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    goals = source_targets(sums, "_source", **targets).withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))).drop("_source")
    # One group for each source, of one row for each length; the documents of a source never come together.
    wanted = counts.drop("_source").join(goals, "_s").groupBy("_s").applyInPandas(_plan, "_s string, size long, source_size long, target double, _passes long, _more long")
    hashed = sized.withColumn("_h", F.xxhash64(F.lit(seed), *tie))
    ranked = number_within(hashed, ["_s", "size"], ["_h", *tie], "_rank", attach=materialize(wanted, "mix-plan"))
    return ranked.withColumn("copies", F.col("_passes") + (F.col("_rank") < F.col("_more")).cast("long")).drop("_s", "_h", "_rank", "_passes", "_more")


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """For one source: whole passes over it, and how many documents of each length are taken once more."""
    frame = frame.sort_values("size", ignore_index=True)
    frame["_passes"] = frame["_more"] = 0
    some = frame["size"] > 0
    lengths, counts = frame.loc[some, "size"].to_numpy(np.int64), frame.loc[some, "_n"].to_numpy(np.int64)
    if len(lengths):
        passes, budget = divmod(round(frame["target"].iloc[0]), int((lengths * counts).sum()))
        frame.loc[some, "_passes"] = passes
        frame.loc[some, "_more"] = subset_counts(lengths, counts, budget)
    return frame[["_s", "size", "source_size", "target", "_passes", "_more"]]


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; taken is the words that the mix takes from each, repeats counted."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", word_count().cast("long").alias("size"), "source")
    mixed = mix(materialize(docs, "mix-sizes"), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
