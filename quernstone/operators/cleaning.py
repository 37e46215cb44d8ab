"""Safe cleanup of values as generated expressions: every rule is a step that is recorded, and what no rule settles is reported, not guessed."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.schema import Field

STEPS = "array<struct<rule:string,before:string,after:string>>"


@dataclass
class ColumnPlan:
    """How a column's dates read: one format, or several that its values cannot tell apart."""

    date_format: str | None = None
    ambiguous: list[str] = field(default_factory=list)


@dataclass
class PlannedDates:
    """The same for cells of many columns: arrays of formats that stand in the cell's own row. known: all that may."""

    ambiguous: Column
    formats: Column
    known: list[str]


def plan_column(profile: Any, target: Field) -> ColumnPlan:
    """The single best date format, or the only one among the best that some day above 12 proves; else the best ones are ambiguous."""
    if target.type not in ("date", "datetime") or not profile.date_formats:
        return ColumnPlan()
    best = [f for f in X.DATE_FORMATS if f in profile.date_formats]
    if len(best) == 1:
        return ColumnPlan(best[0])
    proven = [f for f in best if f in (profile.decidable or [])]
    return ColumnPlan(proven[0]) if len(proven) == 1 else ColumnPlan(None, best)


def _step(rule: str, before: Column, after: Column) -> Column:
    return F.when(~before.eqNullSafe(after), F.struct(F.lit(rule).alias("rule"), before.alias("before"), after.alias("after")))


def clean(raw: Column, target: Field, plan: ColumnPlan | PlannedDates | None = None) -> Column:
    """struct<value, unsafe, alternatives, steps> for one cell: value as text in canonical form, unsafe why none is safe."""
    plan = plan or ColumnPlan()
    ascii_only = ~raw.rlike(r"[^\x00-\x7F]")
    composed = F.when(ascii_only, raw).otherwise(X.nfc(raw))
    return _typed(composed, raw, target, plan)


def clean_ascii(raw: Column, target: Field, plan: ColumnPlan | None = None) -> Column:
    """clean() without the Unicode step, all native."""
    return _typed(raw, raw, target, plan or ColumnPlan())


def _readings(c: Column, shown: str, formats: Column | list[str], known: list[str]) -> Column:
    """c as a date by each of formats; those of a column stand for some of known."""
    if isinstance(formats, Column):
        return F.transform(formats, lambda f: F.coalesce(*(F.when(f == k, X.render_date(X.read_date(c, k), shown)) for k in known)))
    return F.array(*(X.render_date(X.read_date(c, f), shown) for f in formats)).cast("array<string>")


def _typed(composed: Column, raw: Column, target: Field, plan: ColumnPlan | PlannedDates) -> Column:
    trimmed = X.ws_trim(composed)
    collapsed = X.collapse_ws(trimmed)
    blank = F.lower(collapsed).isin(*X.NULL_MARKERS)
    none, no_choice = F.lit(None).cast("string"), F.array().cast("array<string>")
    rule, value, unsafe, choices = "keep", collapsed, none, no_choice
    if target.case_sensitive:
        if target.pattern:
            unsafe = F.when(~X.prefix_match(collapsed, target.pattern), "pattern")
    elif target.type == "email":
        rule, value = "email_domain_lowercase", X.email_domain_lower(collapsed)
    elif target.type == "enum":
        rule = "canonical_enum"
        value = F.coalesce(*(F.when(X.alnum_key(collapsed) == "".join(c for c in a.casefold() if c.isascii() and c.isalnum()), F.lit(a)) for a in target.allowed))
        unsafe = F.when(value.isNull(), "not an allowed value")
        choices = F.when(value.isNull(), F.array(*map(F.lit, target.allowed))).otherwise(no_choice)
    elif target.type in ("integer", "number"):
        rule = "strip_number_separators"
        stripped = X.number_text(collapsed)
        typed = stripped.try_cast("bigint" if target.type == "integer" else "double")
        value = F.when(typed.isNotNull(), stripped)
        unsafe = F.when(typed.isNull(), f"not a {target.type}")
    elif target.type in ("date", "datetime"):
        shown, own = target.date_format, plan if isinstance(plan, PlannedDates) else None
        parts = {"raw": raw, "composed": composed, "trimmed": trimmed, "collapsed": collapsed, "blank": blank} | ({"ambiguous": own.ambiguous, "formats": own.formats} if own else {})
        # a lambda's variable is computed once, so that no format is parsed twice; nor may a Python function stand inside
        cell = F.array(F.struct(*(v.alias(k) for k, v in parts.items())))
        dated = F.transform(cell, lambda c: F.struct(
            *(c[k].alias(k) for k in ("raw", "composed", "trimmed", "collapsed", "blank")),
            _readings(c["collapsed"], shown, c["ambiguous"] if own else plan.ambiguous, own.known if own else []).alias("torn"),
            _readings(c["collapsed"], shown, c["formats"] if own else [*([plan.date_format] if plan.date_format else []), shown], own.known if own else []).alias("reads"),
        ))
        return F.get(F.transform(dated, lambda c: _outcome(c["raw"], c["composed"], c["trimmed"], c["collapsed"], c["blank"], "normalise_date", *_dated(c["torn"], c["reads"]))), 0)
    elif target.pattern:
        rule = "strip_pattern_punctuation"
        bare = F.regexp_replace(collapsed, rf"(?U){X.NOISE}", "")
        value = F.when(X.prefix_match(collapsed, target.pattern), collapsed).when(X.prefix_match(bare, target.pattern), bare)
        unsafe = F.when(value.isNull(), "pattern")
    return _outcome(raw, composed, trimmed, collapsed, blank, rule, value, unsafe, choices)


def _dated(ambiguous: Column, reads: Column) -> tuple[Column, Column, Column]:
    """value, unsafe and alternatives of a date from its readings by formats that its column cannot tell apart, and by the others."""
    readings = F.array_sort(F.array_distinct(F.array_compact(ambiguous)))
    torn = F.size(readings) > 1
    value = F.when(~torn, F.get(F.array_compact(reads), 0))
    return value, F.when(torn, "ambiguous date").when(value.isNull(), "not a date"), F.when(torn, readings).otherwise(F.array().cast("array<string>"))


def _outcome(raw: Column, composed: Column, trimmed: Column, collapsed: Column, blank: Column, rule: str, value: Column, unsafe: Column, choices: Column) -> Column:
    none, no_choice = F.lit(None).cast("string"), F.array().cast("array<string>")
    absent = raw.isNull() | blank
    steps = F.array_compact(F.array(
        _step("unicode_nfc", raw, composed), _step("trim_boundary_whitespace", composed, trimmed), _step("collapse_repeated_whitespace", trimmed, collapsed),
        F.when(raw.isNotNull() & blank & (collapsed != ""), F.struct(F.lit("null_marker").alias("rule"), collapsed.alias("before"), none.alias("after"))),
        F.when(~absent & value.isNotNull(), _step(rule, collapsed, value)),
    ))
    return F.struct(F.when(~absent, value).alias("value"), F.when(~absent, unsafe).alias("unsafe"), F.when(~absent, choices).otherwise(no_choice).alias("alternatives"), F.coalesce(steps, F.array().cast(STEPS)).alias("steps"))


def project(rows: DataFrame, mapping: dict[str, str], fields: dict[str, Field], plans: dict[str, ColumnPlan] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One cleaned struct for each mapped field of a file's rows; headers in name order, so that a later one wins a field that two feed."""
    chosen = {mapping[h]: h for h in sorted(mapping)}
    return rows.select(*keep, *(clean(F.col(f"`{h}`").cast("string"), fields[f], (plans or {}).get(h)).alias(f) for f, h in chosen.items()))


def fill_constants(rows: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Constants for fields that a file does not have at all; a field that is there stays, null or not."""
    return rows.select("*", *(F.lit(v).alias(f) for f, v in constants.items() if f not in rows.columns))


def override_values(rows: DataFrame, overrides: DataFrame, key: str, name: str) -> DataFrame:
    """rows with field name replaced where overrides (record_key, field, value) has one; an override may set null."""
    own = overrides.where(F.col("field") == name).select(F.col("record_key").alias("_k"), F.col("value").alias("_v"), F.lit(True).alias("_set"))
    return rows.join(own, rows[key] == F.col("_k"), "left").withColumn(name, F.when(F.col("_set"), F.col("_v")).otherwise(F.col(name))).drop("_k", "_v", "_set")


def map_values(cells: DataFrame, value_map: DataFrame) -> DataFrame:
    """cells (file, column, value) with mapped: the answer for that file, column and raw value, past all cleanup."""
    own = value_map.select("file", "column", F.col("raw").alias("value"), F.col("answer").alias("mapped"))
    return cells.join(own, ["file", "column", "value"], "left")


def drop_blank_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with some cell that is more than white space."""
    return rows.where(F.greatest(*(F.length(X.ws_trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))) for c in columns), F.lit(0)) > 0)


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Records of every source in order; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
