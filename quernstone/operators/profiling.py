"""Profiles of all columns of all files from one count of their distinct values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as X

COLUMN = ["file", "column"]
TOP, MASKS, SAMPLE = 10, 3, 15


def to_cells(df: DataFrame, file: str, row: Column, columns: list[str] | None = None) -> DataFrame:
    """file, column, col_pos, row, value: one row for each cell of a wide table, as text. row numbers the rows."""
    names = columns or df.columns
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("col_pos"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)))
    return df.select(F.lit(file).alias("file"), row.cast("long").alias("row"), F.explode(cells).alias("_c")).select("file", "_c.column", "_c.col_pos", "row", "_c.value")


def value_counts(cells: DataFrame) -> DataFrame:
    """file, column, raw-trimmed value v (null for null markers), marker, n, first_row; the one shuffle of a profile."""
    trimmed = X.ws_trim(F.col("value"))
    marker = F.when(X.is_null_marker(F.col("value")) & (trimmed != ""), trimmed)
    return cells.select(*COLUMN, "row", X.present(F.col("value")).alias("v"), marker.alias("marker")).groupBy(*COLUMN, "v", "marker").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


def column_counts(counts: DataFrame) -> DataFrame:
    """Totals, distinct values, lengths and the null markers found, for each column."""
    has, n, v = F.col("v").isNotNull(), F.col("n"), F.col("v")
    sums = counts.groupBy(*COLUMN).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(has, n)), F.lit(0)).alias("non_null"), F.count("v").alias("distinct"),
        F.min(F.length(v)).cast("long").alias("min_length"), F.max(F.length(v)).cast("long").alias("max_length"),
        F.round(F.sum(F.length(v) * n) / F.sum(F.when(has, n)), 2).alias("mean_length"), F.array_join(F.sort_array(F.collect_set("marker")), ",").alias("null_markers"),
    )
    return sums.withColumn("null_count", F.col("total") - F.col("non_null")).withColumn("cardinality_ratio", F.coalesce(F.try_divide("distinct", "non_null"), F.lit(0.0)))


def type_tests(v: Column) -> dict[str, Column]:
    return {"integer": v.rlike(f"(?U){X.INTEGER}"), "number": v.rlike(f"(?U){X.NUMBER}"), "boolean": F.lower(v).isin(*X.BOOLEAN_WORDS), "email": v.rlike(X.EMAIL), "phone": v.rlike(X.PHONE)}


def type_rates(counts: DataFrame) -> DataFrame:
    """file, column, type, parse_rate above 0; string is always 1."""
    v = F.col("v")
    tests = type_tests(v) | {"string": F.lit(True)}
    rates = counts.where(v.isNotNull()).groupBy(*COLUMN).agg(*((F.sum(F.when(t, F.col("n")).otherwise(0)) / F.sum("n")).alias(k) for k, t in tests.items()))
    return rates.unpivot(COLUMN, list(tests), "type", "parse_rate").where("parse_rate > 0")


def _totals(counts: DataFrame) -> DataFrame:
    """_all: filled cells of each column; a row a column, so that no task holds the values of one."""
    return counts.where("v is not null").groupBy(*COLUMN).agg(F.sum("n").alias("_all"))


def date_rates(counts: DataFrame) -> DataFrame:
    """file, column, format, rate, decidable (some day read so is above 12); formats that read nothing are left out."""
    v, n = F.col("v"), F.col("n")
    parsed = F.array(*(F.struct(F.lit(f).alias("format"), F.try_to_timestamp(v, F.lit(p)).alias("at")) for f, p in X.DATE_FORMATS.items()))
    read = counts.where(v.isNotNull()).select(*COLUMN, "n", F.explode(parsed).alias("p")).where("p.at is not null")
    sums = read.groupBy(*COLUMN, F.col("p.format").alias("format")).agg(F.sum(n).alias("_read"), F.bool_or(F.day("p.at") > 12).alias("decidable"))
    return sums.join(_totals(counts), COLUMN).select(*COLUMN, "format", (F.col("_read") / F.col("_all")).alias("rate"), "decidable")


def best_dates(rates: DataFrame) -> DataFrame:
    """file, column, date_rate, date_formats: the best rate and every format within 1e-9 of it, in name order."""
    top = F.max("rate").over(Window.partitionBy(*COLUMN))
    return rates.withColumn("_top", top).where(F.col("rate") >= F.col("_top") - 1e-9).groupBy(*COLUMN).agg(F.max("rate").alias("date_rate"), F.sort_array(F.collect_list("format")).alias("date_formats"))


def masks(counts: DataFrame, k: int = MASKS) -> DataFrame:
    """file, column, mask, n, coverage of the k commonest masks; ties by mask."""
    by = counts.where("v is not null").groupBy(*COLUMN, X.mask(F.col("v")).alias("mask")).agg(F.sum("n").alias("n"))
    top = by.withColumn("rank", F.row_number().over(Window.partitionBy(*COLUMN).orderBy(F.desc("n"), "mask"))).where(F.col("rank") <= k)
    return top.join(_totals(counts), COLUMN).select(*COLUMN, "mask", "n", (F.col("n") / F.col("_all")).alias("coverage"), "rank")


def top_values(counts: DataFrame, k: int = TOP, ties: str = "first_row") -> DataFrame:
    """file, column, v, n, rank of the k commonest values; ties keep first-seen order. Spark cuts each partition to k before it shuffles."""
    ranked = counts.where("v is not null").withColumn("rank", F.row_number().over(Window.partitionBy(*COLUMN).orderBy(F.desc("n"), ties, "v")))
    return ranked.where(F.col("rank") <= k).select(*COLUMN, "v", "n", "first_row", "rank")


def sample_values(counts: DataFrame, seed: int = 0, size: int = SAMPLE) -> DataFrame:
    """file, column, sample: five common, five by seeded hash, longest, shortest and three rarest values, each once.

    Random values come by hash order: the same in every run, though not those of another generator.
    """
    own = Window.partitionBy(*COLUMN)
    orders = {0: [F.desc("n"), F.col("first_row")], 1: [F.xxhash64("v", F.lit(seed))], 2: [F.desc(F.length("v")), F.col("v")], 3: [F.length("v"), F.col("v")], 4: [F.col("n"), F.desc("first_row")]}
    limits = {0: 5, 1: 5, 2: 1, 3: 1, 4: 3}
    some = counts.where("v is not null").select(*COLUMN, "v", "n", "first_row")
    picked = None
    for i, by in orders.items():
        part = some.withColumn("at", F.row_number().over(own.orderBy(*by))).where(F.col("at") <= limits[i]).select(*COLUMN, "v", F.lit(i).alias("kind"), "at")
        picked = part if picked is None else picked.union(part)
    first = picked.groupBy(*COLUMN, "v").agg(F.min(F.struct("kind", "at")).alias("k"))
    return first.groupBy(*COLUMN).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), 1, size).alias("sample"))


def profile_columns(cells: DataFrame) -> DataFrame:
    """One row for each column with its counts, types, dates, masks, top values and sample; bounded in size, so a driver may collect it."""
    counts = value_counts(cells)
    types = type_rates(counts).groupBy(*COLUMN).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "parse_rate")))).alias("types"))
    dates = date_rates(counts)
    every = dates.groupBy(*COLUMN).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("format", "rate")))).alias("date_rates"), F.sort_array(F.collect_set(F.when(F.col("decidable"), F.col("format")))).alias("decidable"))
    shapes = masks(counts).groupBy(*COLUMN).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "mask", "coverage"))), lambda x: F.struct(x["mask"], x["coverage"])).alias("masks"))
    tops = top_values(counts).groupBy(*COLUMN).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "v", "n"))), lambda x: F.struct(x["v"], x["n"])).alias("top"))
    position = cells.groupBy(*COLUMN).agg(F.min("col_pos").alias("col_pos"))
    out = column_counts(counts).join(position, COLUMN)
    for part in (types, every, best_dates(dates), shapes, tops, sample_values(counts)):
        out = out.join(part, COLUMN, "left")
    return out


def mask_regex(shape: str) -> str | None:
    """Pattern that a mask stands for, or None without a class of characters."""
    classes = {"#": "[0-9]", "A": "[A-Z]", "a": "[a-z]", "_": r"\s"}
    parts = re.findall(r"(.)(\{\d+\})?", shape, re.S)
    if not any(c in "#Aa" for c, _ in parts):
        return None
    return "^" + "".join(classes.get(c, re.escape(c)) + n for c, n in parts) + "$"
