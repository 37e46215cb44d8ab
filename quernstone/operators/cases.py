"""Review cases: what evidence cannot settle, as typed rows keyed by content, and the answers that are replayed over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import content_key
from quernstone.operators.tables import gapless

# The classes of cases. The last two are declared and never raised here.
CLASSES = (
    "AMBIGUOUS_MAPPING", "UNMAPPED_REQUIRED", "AMBIGUOUS_VALUE", "UNCERTAIN_IDENTITY", "CONFLICTING_FACTS", "MISSING_REQUIRED", "VALIDATION_UNRESOLVED", "UNRESOLVED_REFERENCE",
    "LOW_CONFIDENCE_EXTRACTION", "CROSS_RUN_COLLISION", "DELIVERY_PERMANENT_FAILURE",
)
CASE = ["class", "file", "column", "field", "record_key", "headline", "options", "blocks"]
WORTH_CHECKING = ("AMBIGUOUS_VALUE", "VALIDATION_UNRESOLVED", "UNRESOLVED_REFERENCE", "CONFLICTING_FACTS", "UNCERTAIN_IDENTITY", "LOW_CONFIDENCE_EXTRACTION")


def case_rows(df: DataFrame, kind: Column, file: Column, column: Column, name: Column, record: Column, headline: Column, options: Column, blocks: Column, told_by: Column | None = None) -> DataFrame:
    """Cases with case_key, by which answers find them again: what they are about, never a cell's value if a record and field say that; told_by tells apart cases that agree in all of it."""
    none = lambda c: c.cast("string")
    made = df.select(none(kind).alias("class"), none(file).alias("file"), none(column).alias("column"), none(name).alias("field"), none(record).alias("record_key"), none(headline).alias("headline"), options.cast("array<string>").alias("options"), blocks.cast("bigint").alias("blocks"), none(F.lit(None) if told_by is None else told_by).alias("_told"))
    more = F.coalesce("_told", F.when(F.col("record_key").isNull(), F.col("headline")))
    return made.withColumn("case_key", content_key(F.col("class"), F.col("record_key"), F.col("field"), F.concat_ws(":", "file", "column"), more)).drop("_told")


def value_cases(unsafe: DataFrame) -> DataFrame:
    """Cases of unsafe values (file, column, field, type, raw, unsafe, alternatives, record_id, confidence).

    An unsure reading is LOW_CONFIDENCE_EXTRACTION by cell; an ambiguous date is one case for its column; a value
    that is none of the allowed ones is one case for each raw value of a column; anything else is one for each cell.
    blocks counts the records that wait, by an aggregate: a case never holds a list of all of them.
    """
    low = F.col("confidence") < 0.80
    kind = F.when(low, "LOW_CONFIDENCE_EXTRACTION").when(F.size("alternatives") > 0, "AMBIGUOUS_VALUE").otherwise("VALIDATION_UNRESOLVED")
    whole_column = ~F.coalesce(low, F.lit(False)) & (F.col("unsafe") == "ambiguous date")
    by_value = ~F.coalesce(low, F.lit(False)) & (F.col("type") == "enum")
    marked = unsafe.withColumn("_kind", kind).withColumn("_raw", F.when(~whole_column, F.col("raw"))).withColumn("_record", F.when(~whole_column & ~by_value, F.col("record_id")))
    grouped = marked.groupBy("_kind", "file", "column", "field", "_raw", "_record").agg(F.count_distinct("record_id").alias("_n"), F.first("alternatives").alias("_options"), F.first("unsafe").alias("_why"))
    return case_rows(grouped, F.col("_kind"), F.col("file"), F.col("column"), F.col("field"), F.col("_record"), F.concat_ws(": ", "_why", "_raw"), F.when(F.col("_why") != "ambiguous date", F.col("_options")).otherwise(F.array().cast("array<string>")), F.col("_n"))


def reference_cases(missing: DataFrame, codes: DataFrame, options: int = 8) -> DataFrame:
    """One case for each unresolved reference (record_id, field, rule, value), with the first codes in order as choices."""
    few = codes.orderBy("code").limit(options).agg(F.array_sort(F.collect_list("code")).alias("_codes"))
    return case_rows(missing.crossJoin(F.broadcast(few)), F.lit("UNRESOLVED_REFERENCE"), F.lit(None), F.lit(None), F.col("field"), F.col("record_id"), F.concat_ws(" ", "rule", "value"), F.col("_codes"), F.lit(1))


def issue_cases(issues: DataFrame, open_cells: DataFrame) -> DataFrame:
    """Cases of issues (record_id, field, rule, value) whose cell has no case yet (open_cells: record_id, field)."""
    rest = issues.join(open_cells.select("record_id", "field").distinct(), ["record_id", "field"], "left_anti")
    return case_rows(rest, F.when(F.col("rule") == "required", "MISSING_REQUIRED").otherwise("VALIDATION_UNRESOLVED"), F.lit(None), F.lit(None), F.col("field"), F.col("record_id"), F.concat_ws(" ", "rule", "value"), F.array(), F.lit(1), F.col("rule"))


def identity_cases(folded: DataFrame) -> DataFrame:
    open_pairs = folded.where("case_with is not null")
    return case_rows(open_pairs, F.lit("UNCERTAIN_IDENTITY"), F.lit(None), F.lit(None), F.lit(None), F.col("record_id"), F.col("case_with"), F.array(F.lit("merge"), F.lit("separate")), F.lit(2), F.col("case_with"))


def conflict_cases(found: DataFrame) -> DataFrame:
    return case_rows(found, F.lit("CONFLICTING_FACTS"), F.lit(None), F.lit(None), F.col("field"), F.col("survivor"), F.col("values"), F.split("values", r"\|"), F.lit(1))


def numbered(cases: DataFrame) -> DataFrame:
    """cases with case_id: case-001 and on, in the order of their keys, whatever their number. Answers go by case_key."""
    return gapless(cases, ["case_key"], "_seq").withColumn("case_id", F.format_string("case-%03d", "_seq")).drop("_seq")


def worth_checking(cases: DataFrame, n: int = 10) -> DataFrame:
    """The n cases that most records wait for, of the classes that a look at the data may settle: a report."""
    return cases.where(F.col("class").isin(*WORTH_CHECKING)).orderBy(F.desc("blocks"), "case_key").limit(n)


def class_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class")


def unanswered(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    return cases.join(decisions.select("case_key").distinct(), "case_key", "left_anti")


def unmatched(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Decisions whose case never came up."""
    return decisions.join(cases.select("case_key").distinct(), "case_key", "left_anti")


@dataclass
class Overrides:
    """Answers by content. Small, so they stay on the driver and become expressions and small tables.

    values are of one row (record id, field); facts are of the entity that a row belongs to, whichever row stands for it.
    """

    column_map: dict[tuple[str, str], str | None] = field(default_factory=dict)
    constants: dict[tuple[str | None, str], str] = field(default_factory=dict)
    values: dict[tuple[str, str], str | None] = field(default_factory=dict)
    facts: dict[tuple[str, str], str | None] = field(default_factory=dict)
    value_map: dict[tuple[str, str, str], str | None] = field(default_factory=dict)
    date_formats: dict[tuple[str, str], str] = field(default_factory=dict)
    identity: dict[tuple[str, str], bool] = field(default_factory=dict)
    authority: list[str] = field(default_factory=list)
    excluded: set[str] = field(default_factory=set)
    ignored_files: set[str] = field(default_factory=set)


class RefusedDecision(ValueError):
    """An answer that a case cannot take."""


def check_decision(case: dict, action: str, value: str | None = None, recommended: str | None = None) -> str | None:
    """The value to apply: approving takes the recommended option and is refused without one."""
    if action == "approve":
        if recommended is None:
            raise RefusedDecision(f"{case['case_key']}: nothing is recommended, so there is nothing to approve")
        return recommended
    return value


def recommended_reading(checked: DataFrame) -> DataFrame:
    """format, rows, agree, recommended: the one reading that agrees with other files, if only one does; checked: of cross_check()."""
    supported = checked.agg(F.count_if(F.col("agree") > 0).alias("_n"))
    return checked.crossJoin(F.broadcast(supported)).withColumn("recommended", (F.col("_n") == 1) & (F.col("agree") > 0)).drop("_n")  # one row


def enrich(cases: DataFrame, suggestions: DataFrame) -> DataFrame:
    """cases with suggested values (case_key, value) put after the options they have; nothing measured is displaced."""
    own = suggestions.groupBy("case_key").agg(F.array_sort(F.collect_set("value")).alias("_more"))
    joined = cases.join(own, "case_key", "left")
    return joined.withColumn("options", F.array_distinct(F.concat(F.coalesce("options", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")


def apply_decision(overrides: Overrides, case: dict, action: str, value: str | None = None) -> Overrides:
    """One answer: reject excludes the record (or ignores a whole file); the others go by the class of the case."""
    kind, file, column, name, record = case["class"], case.get("file"), case.get("column"), case.get("field"), case.get("record_key")
    if action == "reject":
        if kind == "UNMAPPED_REQUIRED" and file and not name:
            overrides.ignored_files.add(file)
        elif kind == "AMBIGUOUS_MAPPING":
            overrides.column_map[file, column] = None
        elif record:
            overrides.excluded.add(record)
    elif kind == "AMBIGUOUS_MAPPING":
        overrides.column_map[file, column] = value
    elif kind == "UNMAPPED_REQUIRED":
        if action == "map":
            overrides.column_map[file, value] = name
        else:
            overrides.constants[file, name] = value
    elif kind == "UNCERTAIN_IDENTITY":
        overrides.identity[tuple(sorted((record, case["headline"])))] = value == "merge"
    elif kind == "CONFLICTING_FACTS" and action == "prefer_file":
        overrides.authority = [value, *(a for a in overrides.authority if a != value)]
    elif kind in ("CONFLICTING_FACTS", "MISSING_REQUIRED") or kind in ("VALIDATION_UNRESOLVED", "UNRESOLVED_REFERENCE") and not column:
        overrides.facts[record, name] = value
    elif kind == "AMBIGUOUS_VALUE" and case["headline"].startswith("ambiguous date"):
        overrides.date_formats[file, column] = value
    elif file and column and not record:
        overrides.value_map[file, column, case["headline"].partition(": ")[2]] = value
    else:
        overrides.values[record, name] = value
    return overrides
