"""Large delimited exports, read in ranges by many tasks: the same records, ids and row numbers as files.read_csv() gives for the whole file.

Spark's text source cuts a file into ranges of lines and reaches any store that Spark reads. A quoted field may run over lines, so a line's
meaning depends on whether a field is open where it begins: one bit. A first pass reads every range under both values of it and
keeps what comes of each; the ranges' results are composed in order, which tells the true bit and the first row number of every range;
a second pass parses. A record that runs over the end of a range leaves a piece there and in each range that it reaches, and these few are put together by a shuffle.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.files import RECORDS, UnsupportedInput, decode, delimiter, grid_row, headers_of, literal_path, sniff

#: Lines that tell a file's delimiter.
HEAD_LINES = 20
#: Bytes that cp1252 gives no character.
_NOT_CP1252 = bytes([0x81, 0x8D, 0x8F, 0x90, 0x9D])
_PIECES = "file string, number long, range_start long, content binary"


def open_after(line: bytes, quoted: bool, sep: bytes) -> bool:
    """Whether a quoted field is open after line (without its end), if one was (quoted) or was not open before it."""
    at = 0
    while True:
        if quoted or line[at : at + 1] == b'"':
            at += not quoted
            while True:
                at = line.find(b'"', at) + 1
                if not at:
                    return True
                if line[at : at + 1] != b'"':
                    break
                at += 1
            quoted = False
        at = line.find(sep, at) + 1  # a quote further on in this field is a plain character
        if not at:
            return False


@dataclass
class Range:
    """What a range of lines does: for either state before it (no field open, one open) the state after it and how many records start in it; and which encodings its bytes rule out."""

    after: list[bool] = field(default_factory=lambda: [False, True])
    starts: list[int] = field(default_factory=lambda: [0, 0])
    utf8: bool = True
    cp1252: bool = True
    size: int = 0

    def add(self, lines: list[bytes], sep: bytes) -> None:
        done = 0
        for i in [i for i, line in enumerate(lines) if b'"' in line]:
            for s in (0, 1):
                self.starts[s] += 0 if self.after[s] else i - done + 1
                self.after[s] = open_after(lines[i], self.after[s], sep)
            done = i + 1
        for s in (0, 1):
            self.starts[s] += 0 if self.after[s] else len(lines) - done
        text = b"\n".join(lines)
        self.size += len(text) + 1
        if self.utf8 and not text.isascii():
            try:
                text.decode()
            except UnicodeDecodeError:
                self.utf8 = False
        self.cp1252 = self.cp1252 and len(text.translate(None, _NOT_CP1252)) == len(text)


@dataclass
class Place:
    """Where a range stands in its file: the number of the first record that starts in it, and whether a field is open before and after it."""

    first: int
    before: bool
    after: bool


def placed(ranges: Iterable[tuple[int, Range]]) -> dict[int, Place]:
    """Start of each range of one file to its place."""
    out, number, quoted = {}, 0, False
    for start, r in sorted(ranges, key=lambda x: x[0]):
        out[start] = Place(number, quoted, r.after[quoted])
        number, quoted = number + r.starts[quoted], r.after[quoted]
    return out


def encoding_of(ranges: Iterable[Range]) -> str:
    ranges = list(ranges)
    return "utf-8" if all(r.utf8 for r in ranges) else "cp1252" if all(r.cp1252 for r in ranges) else "latin-1"


def parsed(lines: Iterator[bytes], place: Place, sep: bytes, encoding: str) -> Iterator[tuple[int, list[str] | None, bytes | None]]:
    """(number, cells, None) of each record that lies within a range, (number, None, bytes) of the pieces of the one that began before it and the one that ends after it."""
    csv.field_size_limit(sys.maxsize)
    number = place.first
    if place.before:
        piece, quoted = [], True
        for line in lines:
            piece.append(line)
            quoted = open_after(line, quoted, sep)
            if not quoted:
                break
        yield number - 1, None, b"\n".join(piece)
        if quoted:
            return
    own: list[bytes] = []

    def fed() -> Iterator[str]:
        for line in lines:
            own.append(line)
            yield line.decode(encoding) + "\n"

    held = None  # the last record read: it may be the one that runs on
    for cells in csv.reader(fed(), delimiter=sep.decode()):
        if held is not None:
            yield held[0], held[1], None
        held = number, cells, own[:]
        own.clear()
        number += 1
    if held is not None:
        yield (held[0], None, b"\n".join(held[2])) if place.after else (held[0], held[1], None)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[list[bytes]]]]:
    """Lists of lines of one range after the other; a range's lines stand together and in order in its task."""

    def lists() -> Iterator[tuple[tuple[str, int], list[bytes]]]:
        for batch in batches:
            rows = zip(batch.column("file").to_pylist(), batch.column("range_start").to_pylist(), batch.column("line").to_pylist())
            for key, own in groupby(rows, key=lambda r: r[:2]):
                yield key, [r[2] for r in own]

    for key, own in groupby(lists(), key=lambda x: x[0]):
        yield key, (lines for _, lines in own)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    about = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range_start"), F.col("_metadata.file_size").alias("file_size"))
    return spark.read.text([literal_path(p) for p in paths], lineSep="\n").select(*about, F.col("value").cast("binary").alias("line"))


@dataclass
class Export:
    """How one file is read."""

    name: str
    sep: bytes
    encoding: str
    headers: list[str]
    ranges: dict[int, Place]
    #: Whether a line feed ends the file.
    ended: bool


def _ended(size: int, ranges: list[tuple[int, Range]]) -> bool:
    """Whether each line of a file of size bytes has its end; the mark of byte order, of three bytes, is no part of a line."""
    return size - sum(r.size for _, r in ranges) in (0, 3)


def _summaries(lines: DataFrame, seps: dict[str, bytes]) -> dict[str, list[tuple[int, Range]]]:
    """Ranges of each file. One row for each range, of some 100 bytes, comes to the driver, which lists the ranges of every scan anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), lists in _by_range(batches):
            r = Range()
            for own in lists:
                r.add(own, seps[file])
            yield pa.RecordBatch.from_pylist([{"file": file, "range_start": start, "after": r.after, "starts": r.starts, "utf8": r.utf8, "cp1252": r.cp1252, "size": r.size}])

    out: dict[str, list[tuple[int, Range]]] = {}
    for r in lines.mapInArrow(run, "file string, range_start long, after array<boolean>, starts array<long>, utf8 boolean, cp1252 boolean, size long").collect():
        out.setdefault(r.file, []).append((r.range_start, Range(list(r.after), list(r.starts), r.utf8, r.cp1252, r["size"])))
    return out


def _separator(head: bytes, encoding: str | None = None) -> bytes:
    return delimiter((head.decode(encoding) if encoding else decode(head)) or "").encode()


def _first_record(lines: list[bytes], sep: bytes) -> list[bytes] | None:
    """Lines of the first record, or None if it may run on beyond lines, which are all there are if they are fewer than HEAD_LINES."""
    quoted = False
    for i, line in enumerate(lines, 1):
        quoted = open_after(line, quoted, sep)
        if not quoted:
            return lines[:i]
    return None if len(lines) >= HEAD_LINES else lines


def read_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records (files.RECORDS) of delimited files, each read in ranges of spark.sql.files.maxPartitionBytes; two passes over the text, and a shuffle of the records that cross from one range to another.

    Lines end with a line feed, alone or after a carriage return; a carriage return by itself outside quotes is an
    error that names the file, as it is for read_csv(). A cell may be as long as a string. A file without a filled header gives no records.
    """
    if not paths:
        return spark.createDataFrame([], RECORDS)
    lines = _lines(spark, paths)
    heads: dict[str, bytes] = {}
    sizes: dict[str, int] = {}
    for path in paths:  # one small job for each large file; it reads the file's first lines only
        if first := _lines(spark, [path]).limit(HEAD_LINES).collect():
            heads[first[0].file] = b"\n".join(bytes(r.line) for r in first)
            sizes[first[0].file] = first[0].file_size
    seps = {file: _separator(head) for file, head in heads.items()}
    ranges = _summaries(lines, seps)
    encodings = {file: encoding_of(r for _, r in own) for file, own in ranges.items()}
    told = {file: _separator(heads[file], encodings[file]) for file in seps}
    if told != seps:  # the whole file's encoding shows another delimiter than the head alone
        seps, ranges = told, _summaries(lines, told)
    plan = {file: Export(unquote(file.rsplit("/", 1)[-1]), seps[file], encodings[file], [], placed(own), _ended(sizes[file], own)) for file, own in ranges.items()}
    rows = _numbered(lines, plan)
    for file, export in plan.items():
        head = _first_record(heads[file].split(b"\n"), export.sep)
        if head is None:  # the header runs on beyond the first lines
            found = [r.cells for r in rows.where((F.col("file") == file) & (F.col("number") == 0)).collect()]
        else:
            found = [cells for _, cells, _ in parsed(iter(head), Place(0, False, False), export.sep, export.encoding)]
        export.headers = headers_of(found[0]) if found else []
    shared = {file: (e.name, e.headers) for file, e in plan.items() if e.headers}
    return _records(rows.where("number > 0"), shared)


def _numbered(lines: DataFrame, plan: dict[str, Export]) -> DataFrame:
    """file, number and cells of every record, header and blank ones included."""
    plan = lines.sparkSession.sparkContext.broadcast(plan)
    cells = pa.schema([("file", pa.string()), ("number", pa.int64()), ("range_start", pa.int64()), ("content", pa.binary()), ("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), lists in _by_range(batches):
            export, out, held = plan.value[file], [], 0
            try:
                for number, row, piece in parsed((line for own in lists for line in own), export.ranges[start], export.sep, export.encoding):
                    out.append({"file": file, "number": number, "range_start": start, "content": piece, "cells": row})
                    held += 1
                    if held == 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=cells)
                        out, held = [], 0
            except csv.Error as e:
                raise UnsupportedInput(f"{export.name}, near row {export.ranges[start].first}: {e}") from e
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=cells)

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("range_start")
        file = table["file"][0].as_py()
        export = plan.value[file]
        text = b"\n".join(table["content"].to_pylist()).split(b"\n")
        ((_, row, _),) = parsed(iter(text), Place(0, False, False), export.sep, export.encoding)
        if not export.ended and reduce(lambda quoted, line: open_after(line, quoted, export.sep), text, False):
            row[-1] = row[-1][:-1]  # the file ends within a field, and not by a line feed
        return pa.Table.from_pylist([{"file": file, "number": table["number"][0].as_py(), "cells": row}], schema=pa.schema([cells.field(i) for i in (0, 1, 4)]))

    out = lines.mapInArrow(run, f"{_PIECES}, cells array<string>")
    whole = out.where("content is null").select("file", "number", "cells")
    # One group for each record that crosses a range's end: one for each range at most.
    crossing = out.where("content is not null").select("file", "number", "range_start", "content").groupBy("file", "number").applyInArrow(joined, "file string, number long, cells array<string>")
    return whole.unionByName(crossing)


def _records(rows: DataFrame, headers: dict[str, tuple[str, list[str]]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(headers)
    schema = pa.schema(
        [("record_id", pa.string()), ("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("path", pa.string()), ("cells", pa.map_(pa.string(), pa.string())), ("col_order", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, number, row in zip(*(batch.column(c).to_pylist() for c in ("file", "number", "cells"))):
                name, own = shared.value.get(file, (None, None))
                if own and (cells := grid_row(own, row)) is not None:
                    out.append((f"{name}##{number}", name, None, number, None, list(cells.items()), list(dict.fromkeys(own))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, RECORDS)


def is_export(spark: SparkSession, path: str, name: str) -> bool:
    """Whether a file's first lines say that it is delimited text."""
    first = _lines(spark, [path]).limit(HEAD_LINES).collect()
    return sniff(name, b"\n".join(bytes(r.line) for r in first)) == "csv"
