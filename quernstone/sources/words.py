"""Tables from positioned words (recorded or recognised pages): lines by vertical gaps, cells by horizontal gaps, columns by the nearest centre."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A gap of more than this share of a page's median word height starts a line; a page with so many characters needs no recognition.
LINE_GAP, NATIVE_CHARS = 0.7, 60
CONFIDENT = 0.80
WORD = "struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>"


class OcrEngine(Protocol):
    """Plug-in: words (text, x0, y0, x1, y1, confidence) of a page image."""

    def recognize(self, png: bytes, page: int) -> Iterable[tuple[str, float, float, float, float, float]]: ...


def read_recorded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """words (file, page, text, x0, y0, x1, y1, confidence) of recorded recognitions: JSON files, each a list of pages {page, words: [{text, x0, y0, x1, y1, confidence}]}.

    A missing confidence counts as certain; words without text or place are left out. A file is a document, so it fits a task.
    """
    pages = spark.read.schema(f"page int, words array<{WORD}>").option("multiLine", True).json(paths).withColumn("file", F.col("_metadata.file_name"))
    each = pages.select("file", "page", F.inline("words"))
    return each.fillna(1.0, ["confidence"]).where((F.trim("text") != "") & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull())


def lines(words: DataFrame) -> DataFrame:
    """words (file, page, text, x0, y0, x1, y1, confidence) with line, numbered down each page. A page is one group: it holds a page's words."""
    page = Window.partitionBy("file", "page")
    centre = words.withColumn("_c", (F.col("y0") + F.col("y1")) / 2).withColumn("_h", F.median(F.col("y1") - F.col("y0")).over(page))
    down = page.orderBy("_c", "x0")
    fresh = F.coalesce((F.col("_c") - F.lag("_c").over(down) > LINE_GAP * F.col("_h")).cast("int"), F.lit(0))
    return centre.withColumn("_new", fresh).withColumn("line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_c", "_h", "_new")


def gap_threshold(gaps: list[float]) -> float:
    """The gap that tells cells from words: below the first jump of 1.8 times among sorted positive gaps, else half the least."""
    some = sorted(g for g in gaps if g > 0)
    for low, high in zip(some, some[1:]):
        if high / low >= 1.8:
            return high * 0.9
    return some[0] * 0.5 if some else 0.0


def cells(lined: DataFrame) -> DataFrame:
    """file, page, line, cell, text, x0, x1, confidence: words of a line joined across small gaps; a cell is as sure as its least sure word."""

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x0", ignore_index=True)
        gaps = (frame["x0"].shift(-1) - frame["x1"]).dropna().tolist()
        limit = gap_threshold(gaps)
        number = [0]
        for g in gaps:
            number.append(number[-1] + (g > limit if limit else 0))
        own = frame.assign(cell=number).groupby("cell", as_index=False).agg(text=("text", " ".join), x0=("x0", "min"), x1=("x1", "max"), confidence=("confidence", "min"))
        return own.assign(file=frame["file"].iloc[0], page=frame["page"].iloc[0], line=frame["line"].iloc[0])[["file", "page", "line", "cell", "text", "x0", "x1", "confidence"]]

    return lined.groupBy("file", "page", "line").applyInPandas(split, "file string, page int, line long, cell long, text string, x0 double, x1 double, confidence double")


def grid(split: DataFrame) -> DataFrame:
    """split with column: the nearest of the column centres that lines of the commonest width give (the wider on ties)."""
    widths = split.groupBy("file", "page", "line").agg(F.count(F.lit(1)).alias("width"))
    modal = widths.groupBy("file", "page", "width").agg(F.count(F.lit(1)).alias("n")).groupBy("file", "page").agg(F.max_by("width", F.struct("n", "width")).alias("width"))
    shown = split.join(widths, ["file", "page", "line"]).join(modal, ["file", "page", "width"], "left_semi")
    centres = shown.groupBy("file", "page", F.col("cell").alias("column")).agg(((F.avg("x0") + F.avg("x1")) / 2).alias("_centre"))
    near = split.join(centres, ["file", "page"]).groupBy("file", "page", "line", "cell", "text", "x0", "x1", "confidence").agg(F.min_by("column", F.struct(F.abs(F.col("_centre") - (F.col("x0") + F.col("x1")) / 2), "column")).alias("column"))
    return near


def table_rows(placed: DataFrame) -> DataFrame:
    """file, page, line, column, name, text, confidence: cells of grid() as a document's table, named by its header.

    Lines of one filled cell are titles or notes. The width that most of the others have (the wider on ties) is the table's;
    its first line is the header, and later lines with at least half as many cells, two at least, are rows. Cells outside the header's
    columns, and repeats of the header on later pages, are no data.
    """
    filled = placed.where(F.trim("text") != "")
    widths = filled.groupBy("file", "page", "line").agg(F.count_distinct("column").alias("_w")).where("_w > 1")
    modal = widths.groupBy("file", "_w").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(F.max_by("_w", F.struct("n", "_w")).alias("_width"))
    sized = widths.join(modal, "file")
    at = F.struct("page", "line")
    head = sized.where("_w = _width").groupBy("file").agg(F.min(at).alias("_head"))
    body = sized.join(head, "file").where((at > F.col("_head")) & (F.col("_w") >= F.greatest(F.lit(2), F.floor(F.col("_width") / 2)))).select("file", "page", "line")
    names = filled.join(head, "file").where(at == F.col("_head")).groupBy("file", "column").agg(F.first(F.trim("text")).alias("name"))
    cells_ = filled.join(body, ["file", "page", "line"]).join(names, ["file", "column"])
    again = cells_.groupBy("file", "page", "line").agg(F.bool_and(F.trim("text") == F.col("name")).alias("_again")).where("_again").select("file", "page", "line")
    return cells_.join(again, ["file", "page", "line"], "left_anti").select("file", "page", "line", "column", "name", F.trim("text").alias("text"), "confidence")


def records(rows: DataFrame) -> DataFrame:
    """file, page, line, values (name to text) and confidence (name to the cell's) of table_rows(): a record a line. Of columns with one name the first filled one counts."""
    one = rows.groupBy("file", "page", "line", "name").agg(F.min_by("text", "column").alias("text"), F.min_by("confidence", "column").alias("confidence"))
    pairs = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", c))))
    return one.groupBy("file", "page", "line").agg(pairs("text").alias("values"), pairs("confidence").alias("confidence"))


def as_records(rows: DataFrame) -> DataFrame:
    """table_rows() as files.read_records() gives records, with confidence (column to the sureness of its cell): rows are numbered down a document, path names the page.

    A header that no row fills is no column. unionByName(allowMissingColumns=True) puts them beside the records of files, whose cells are certain.
    """
    least = rows.groupBy("file", "name").agg(F.min("column").alias("column")).groupBy("file")
    order = least.agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "name"))), lambda c: c["name"]).alias("col_order"))
    down = Window.partitionBy("file").orderBy("page", "line")  # a document, which fits a task
    made = records(rows).withColumn("row", F.row_number().over(down)).join(order, "file")
    none = F.lit(None).cast("string")
    return made.select(
        F.concat("file", F.lit("##"), F.col("row").cast("string")).alias("record_id"), "file", none.alias("sheet"), "row", F.concat(F.lit("page "), F.col("page").cast("string")).alias("path"),
        F.col("values").alias("cells"), "col_order", "confidence",
    )


def needs_ocr(pages: DataFrame) -> DataFrame:
    """pages (file, page, chars) that have too few characters to be read as text."""
    return pages.where(F.coalesce("chars", F.lit(0)) < NATIVE_CHARS)


def unsure_cells(placed: DataFrame, least: float = CONFIDENT) -> DataFrame:
    return placed.where(F.col("confidence") < least)
