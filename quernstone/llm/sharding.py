"""Shards of a fixed capacity by best-fit-decreasing bin packing of groups that stay whole."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import guarded, materialize, number_within, read_table

#: Group sizes keep so many leading bits and are rounded up beyond them: under 2**-12 of a size, and at most 4,096 classes for each power of two.
SIZE_BITS = 13


class OpenBins:
    """A balanced tree (treap) of bins by remaining capacity, then number."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _priority(number: int) -> int:
        return (number * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64 * 0xBF58476D1CE4E5B9 % 2**64

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]

    def put(self, remaining: int, number: int) -> None:
        low, high = self._split(self.root, (remaining, number))
        self.root = self._merge(self._merge(low, [(remaining, number), self._priority(number), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity that holds size."""
        found, node = None, self.root
        while node is not None:
            found, node = (node[0], node[2]) if node[0][0] >= size else (found, node[3])
        if found is not None:
            low, rest = self._split(self.root, found)
            self.root = self._merge(low, self._split(rest, (found[0], found[1] + 1))[1])
        return found


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, most: float = math.inf) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first, end, bin): items first to end - 1 of that size go into bin. None if it takes more than most bins.

    sizes are (size, number of items). Equal items follow each other into the tightest bin while they fit,
    as one by one, so a run costs one step. An item above the capacity gets a bin of its own.
    """
    bins, opened, runs = OpenBins(), 0, []
    for size, count in sorted(sizes, reverse=True):
        first = 0
        while first < count:
            remaining, number = bins.take_tightest(size) or (max(capacity, size), opened)
            if number == opened:
                opened += 1
                if opened > most:
                    return None
            fits = min(count - first, remaining // size)
            runs.append((size, first, first + fits, number))
            if remaining - fits * size:
                bins.put(remaining - fits * size, number)
            first += fits
    return runs


def even_bins(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """best_fit_decreasing() with the least capacity, to about 1 in 4,000, that needs no more than so many bins.

    Items above their even share are set apart, one to a bin, and the rest share the other bins evenly.
    """
    apart: list[tuple[int, int, int, int]] = []
    rest, left = dict(sizes), shards
    while left > 1 and rest and (top := max(rest)) * left > sum(s * n for s, n in rest.items()) and sum(rest.values()) > 1:
        taken = sum(r[0] == top for r in apart)
        apart.append((top, taken, taken + 1, shards - left))
        left -= 1
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
    total = sum(s * n for s, n in rest.items())
    low = max(math.ceil(total / left), max(rest, default=1))
    high, runs = low, None
    while (runs := best_fit_decreasing(rest.items(), high, left)) is None:
        high += max(1, high // 256)
    while high - low > max(1, high // 4096):
        middle = (low + high) // 2
        if (tried := best_fit_decreasing(rest.items(), middle, left)) is None:
            low = middle
        else:
            high, runs = middle, tried
    skip = {size: sum(r[0] == size for r in apart) for size in {r[0] for r in apart}}
    return apart + [(s, a + skip.get(s, 0), b + skip.get(s, 0), n + shards - left) for s, a, b, n in runs]


def _size_class(size):
    step = F.greatest(F.lit(0), F.length(F.bin(size)) - SIZE_BITS)
    unit = F.pow(F.lit(2.0), step).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def assign_groups(groups: DataFrame, group: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """group (unique, not null) and its shard: into so many shards of even size, or into as few of that capacity as best fit finds.

    The driver gets how many groups have each size class, bounded by SIZE_BITS whatever the rows, packs those and
    sends runs of ranks within a class back; Spark numbers groups only in classes that more than one shard shares.
    """
    spark = groups.sparkSession
    sized = groups.select(group, _size_class(F.col(size)).alias("_class"))
    sizes = [tuple(r) for r in sized.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()]
    runs = best_fit_decreasing(sizes, capacity) if shards is None else even_bins(sizes, shards)
    whole = dict(sizes)
    alone = [(s, b) for s, lo, hi, b in runs if hi - lo == whole[s]]
    parts = [r for r in runs if r[2] - r[1] != whole[r[0]]]
    first = sized.join(spark.createDataFrame(alone, "_class long, shard int"), "_class").select(group, "shard")
    if not parts:
        return first
    table = spark.createDataFrame(parts, "_class long, _lo long, _hi long, shard int")
    ranked = number_within(sized.join(table.select("_class").distinct(), "_class", "left_semi"), ["_class"], [group], "_rank")
    second = ranked.join(table, (ranked["_class"] == table["_class"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).select(group, "shard")
    return first.unionByName(second)


@guarded
def shard_texts(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, text: str = "text") -> DataFrame:
    """Each row of docs with size, text_crc32, shard and slot (gapless from 0 in each shard).

    Equal texts are one group and share a shard. A null text is an empty one: size 1, crc32 of nothing.
    Repeated rows each take a slot. Columns of docs named like a result are replaced; texts don't travel:
    only columns other than the text are kept. An empty table gives none.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c not in (text, "size", "text_crc32", "shard", "slot")]
    narrow = materialize(docs.select(
        *keep, (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(value, 256)).alias("_group"),
    ), "shard-sizes")
    groups = materialize(narrow.groupBy("_group").agg(F.sum("size").alias("_bytes")), "shard-groups")
    placed = materialize(narrow.join(assign_groups(groups, "_group", "_bytes", shards, capacity), "_group"), "shard-placed")
    return number_within(placed, ["shard"], [*(c for c, kind in placed.dtypes if c in keep and not kind.startswith("map")), "_group"], "slot").drop("_group")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts stay together."""
    placed = shard_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
