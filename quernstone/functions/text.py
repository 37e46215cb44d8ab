"""Column expressions over text cells; each stays inside code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers that mean no value, words that mean a boolean, and shapes of typed cells.
NULL_MARKERS = ("", "-", "--", "n/a", "na", "null", "none", "nil", "nan", "#n/a", "?")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1", "t", "f")
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?[0-9][0-9\s\-().]{6,}[0-9]$"
INTEGER = r"^[+-]?\d+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"
NOISE = r"[\s\-().]"
#: Date formats in order: the strftime form that schemas use, and Spark's pattern.
DATE_FORMATS = {
    "%Y-%m-%d": "yyyy-M-d", "%d/%m/%Y": "d/M/yyyy", "%m/%d/%Y": "M/d/yyyy", "%d-%m-%Y": "d-M-yyyy", "%m-%d-%Y": "M-d-yyyy", "%Y/%m/%d": "yyyy/M/d",
    "%d.%m.%Y": "d.M.yyyy", "%d %b %Y": "d MMM yyyy", "%d %B %Y": "d MMMM yyyy", "%b %d, %Y": "MMM d, yyyy", "%Y%m%d": "yyyyMMdd",
}
_TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM"}


def ws_trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    """Runs of two or more white-space characters become one space; a single tab stays."""
    return F.regexp_replace(c, r"(?U)\s{2,}", " ")


def is_null_marker(c: Column) -> Column:
    return F.lower(ws_trim(c)).isin(*NULL_MARKERS)


def present(c: Column) -> Column:
    """The trimmed value, or null where it is null or a null marker."""
    return F.when(~is_null_marker(c), ws_trim(c))


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits only: the key by which names and enum values agree."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def mask(c: Column) -> Column:
    """Shape of a value: digits #, upper case A, other letters a, white space _, others themselves; runs as c{n}."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\p{L}&&[^\p{Lu}]]", "a"), r"\p{Lu}", "A"), r"\p{Nd}", "#"), r"(?U)\s", "_")
    runs = F.regexp_extract_all(shape, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.concat(F.substring(r, 1, 1), F.lit("{"), F.length(r).cast("string"), F.lit("}"))).otherwise(r)), "")


def email_domain_lower(c: Column) -> Column:
    """The part after the first @ in lower case; a value without @ stays."""
    at = F.instr(c, "@")
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at), F.lower(F.substr(c, at + 1)))).otherwise(c)


def number_text(c: Column) -> Column:
    """Without the separators that people type into numbers."""
    return F.regexp_replace(c, "[, ]", "")


def prefix_match(c: Column, pattern: str) -> Column:
    """Whether the pattern matches from the start, as re.match does; its classes are Unicode's."""
    return c.rlike(f"(?U)^(?:{pattern})")


def relaxed_match(c: Column, pattern: str) -> Column:
    return prefix_match(c, pattern) | prefix_match(F.regexp_replace(c, rf"(?U){NOISE}", ""), pattern)


def java_pattern(fmt: str) -> str:
    """Spark's pattern for a strftime format."""
    if fmt in DATE_FORMATS:
        return DATE_FORMATS[fmt]
    for token, letters in _TOKENS.items():
        fmt = fmt.replace(token, letters)
    return fmt


def read_date(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(ws_trim(c), F.lit(java_pattern(fmt)))


def render_date(c: Column, fmt: str = "%Y-%m-%d") -> Column:
    shown = fmt
    for token, letters in _TOKENS.items():
        shown = shown.replace(token, letters)
    return F.date_format(c, shown)


def reading_label(example: Column, fmt: str) -> Column:
    """What a reading of a date means to people: which part comes first, and the day it gives; a date that doesn't read so names the format."""
    first = {"%d": "Day first", "%m": "Month first"}.get(fmt[:2], fmt)
    return F.concat(F.lit(f"{first} — "), example, F.lit(" is "), F.coalesce(render_date(read_date(example, fmt), "d MMMM yyyy"), F.lit(fmt)))


def clean_header(c: Column, position: Column) -> Column:
    """The trimmed header, or column_{i+1} where it is blank."""
    return F.coalesce(F.nullif(ws_trim(c), F.lit("")), F.concat(F.lit("column_"), (position + 1).cast("string")))


def header_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", " ")), "[^a-z0-9]+"), lambda t: t != "")


def content_key(*parts: Column) -> Column:
    """Parts joined by |, nulls as empty, so that positions keep their meaning."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def source_label(file: Column, sheet: Column, row: Column, column: Column, page: Column | None = None, path: Column | None = None) -> Column:
    """Where a value came from, parts that are absent left out."""
    said = [file, sheet]
    if page is not None:
        said.append(F.concat(F.lit("page "), page.cast("string")))
    said.append(F.concat(F.lit("row "), row.cast("string")))
    if path is not None:
        said.append(path)
    said.append(F.concat(F.lit("column "), column))
    return F.concat_ws(" · ", *said)


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode normal form C; Spark has none built in, so this is the one Python function of the cleanup chain."""
    return _nfc(c)
