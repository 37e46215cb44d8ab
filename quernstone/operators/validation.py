"""Declared constraints over records: one issue row for each broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.schema import Field, TargetSchema
from quernstone.operators.tables import written

ISSUE = "array<struct<field:string,rule:string,value:string>>"


def field_issues(f: Field) -> list[Column]:
    """Checks of one field, null where it passes; a blank value meets only the requirement to be there."""
    v = F.col(f"`{f.name}`").cast("string")
    blank = F.coalesce(v, F.lit("")) == ""
    said = lambda rule, bad: F.when(bad, F.struct(F.lit(f.name).alias("field"), F.lit(rule).alias("rule"), v.alias("value")))
    out = [said("required", blank)] if f.required else []
    checks: dict[str, Column] = {}
    if f.type == "email":
        checks["type:email"] = ~v.rlike(X.EMAIL)
    elif f.type == "integer":
        checks["type:integer"] = v.try_cast("bigint").isNull()
    elif f.type == "number":
        checks["type:number"] = v.try_cast("double").isNull()
    elif f.type == "enum":
        checks["type:enum"] = ~v.isin(*f.allowed)
    if f.pattern:
        checks["pattern"] = ~X.prefix_match(v, f.pattern)
    if f.max_length is not None:
        checks["max_length"] = F.length(v) > f.max_length
    if f.min_length is not None:
        checks["min_length"] = F.length(v) < f.min_length
    number = v.try_cast("double")
    if f.minimum is not None:
        checks["minimum"] = number < f.minimum
    if f.maximum is not None:
        checks["maximum"] = number > f.maximum
    return out + [said(rule, ~blank & bad) for rule, bad in checks.items()]


def record_issues(records: DataFrame, schema: TargetSchema, record_id: str = "record_id") -> DataFrame:
    """record_id, field, rule, value: all issues that a record shows by itself, in one narrow pass."""
    checks = [c for f in schema.fields if f.name in records.columns for c in field_issues(f)]
    return records.select(F.col(record_id).alias("record_id"), F.explode(F.array_compact(F.array(*checks)).cast(ISSUE)).alias("i")).select("record_id", "i.field", "i.rule", "i.value")


def uniqueness_issues(records: DataFrame, f: Field, record_id: str = "record_id", names: int = 3) -> DataFrame:
    """record_id, field, rule, value, others: every member of a group that shares a value, with up to three other members.

    Only the least ids of a group are kept, by an aggregate, so a group of any size stays small.
    """
    v = F.col(f"`{f.name}`").cast("string")
    key = v if f.case_sensitive else F.lower(v)
    own = records.where(F.coalesce(v, F.lit("")) != "").select(F.col(record_id).alias("record_id"), v.alias("value"), key.alias("_k"))
    least = Window.partitionBy("_k").orderBy("record_id")
    few = own.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= names + 1).groupBy("_k").agg(F.array_sort(F.collect_list("record_id")).alias("_few"))
    groups = own.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").join(few, "_k")
    others = F.slice(F.array_remove("_few", F.col("record_id")), 1, names)
    return own.join(groups, "_k").select("record_id", F.lit(f.name).alias("field"), F.lit("unique").alias("rule"), "value", F.concat_ws(",", F.transform(others, lambda x: x.cast("string"))).alias("others"))


def missing_references(records: DataFrame, f: str, known: DataFrame, code: str, record_id: str = "record_id") -> DataFrame:
    """Records whose filled reference is no known code. Spark broadcasts known if its measured size allows, else joins by shuffle."""
    v = F.col(f"`{f}`")
    filled = records.where(v.isNotNull() & (v.cast("string") != "")).select(F.col(record_id).alias("record_id"), v.alias("value"))
    gone = filled.join(known.select(F.col(code).alias("value")).distinct(), "value", "left_anti")
    return gone.select("record_id", F.lit(f).alias("field"), F.lit("reference:missing").alias("rule"), F.col("value").cast("string").alias("value"))


def self_references(records: DataFrame, f: str, identity: str, record_id: str = "record_id") -> DataFrame:
    """reference:self where a record names itself, reference:missing where it names no record's identity."""
    v, own = F.col(f"`{f}`"), F.col(f"`{identity}`")
    filled = records.where(v.isNotNull() & (v.cast("string") != "")).select(F.col(record_id).alias("record_id"), v.alias("value"), own.alias("_own"))
    known = records.select(own.alias("value")).where(own.isNotNull()).distinct().withColumn("_known", F.lit(True))
    rule = F.when(F.col("value") == F.col("_own"), "reference:self").when(F.col("_known").isNull(), "reference:missing")
    return filled.join(known, "value", "left").withColumn("rule", rule).where("rule is not null").select("record_id", F.lit(f).alias("field"), "rule", F.col("value").cast("string").alias("value"))


def hold_dependents(records: DataFrame, parent: str, identity: str, state: str = "state") -> DataFrame:
    """identity, root of every ready record that reaches a blocked one by its parents; root is the blocked one.

    Each round doubles how far every record looks up its chain, so a chain of n takes log2(n) joins; a record leaves
    once it meets a blocked one (held) or one that is neither blocked nor ready. Rounds end when none is left, or when
    the longest chain that the ready records could form is passed, as only circles are left then. Rounds are checkpointed.
    """
    blocked = written(records.where(F.col(state) == "blocked").select(F.col(identity).alias("_at")).distinct().withColumn("_blocked", F.lit(True)))
    ready = written(records.where(F.col(state) == "ready").where(F.col(identity).isNotNull() & F.col(parent).isNotNull()).select(F.col(identity).alias("id"), F.col(parent).alias("at")).distinct())
    held, ways, reach, longest = None, ready, 1, ready.count()
    while True:
        marked = written(ways.join(blocked, ways["at"] == blocked["_at"], "left").drop("_at"))
        new = marked.where("_blocked").select("id", F.col("at").alias("root"))
        held = new if held is None else held.union(new)
        open_ways = marked.where("_blocked is null").select("id", "at")
        if reach > longest or open_ways.isEmpty():
            return held.distinct()
        # a way that meets a settled one ends where that ends
        onward = open_ways.select(F.col("id").alias("_from"), F.col("at").alias("_to")).union(held.select(F.col("id").alias("_from"), F.col("root").alias("_to")))
        ways = written(open_ways.join(onward, open_ways["at"] == onward["_from"]).select("id", F.col("_to").alias("at")).distinct())
        reach *= 2


def final_states(records: DataFrame) -> DataFrame:
    """state: excluded, else blocked with an open case or an issue, else ready; records: excluded, open_cases, issues."""
    return records.withColumn("state", F.when(F.col("excluded"), "excluded").when((F.col("open_cases") > 0) | (F.col("issues") > 0), "blocked").otherwise("ready"))


def run_status(counts: DataFrame) -> DataFrame:
    """One status for each run from its counts: processing, ready, blocked, delivered, excluded, failed."""
    c = F.col
    status = (
        F.when(c("processing") > 0, "processing").when((c("blocked") > 0) & (c("delivered") > 0), "partially_delivered").when(c("blocked") > 0, "awaiting_review")
        .when((c("ready") > 0) & (c("delivered") == 0), "ready_to_send").when((c("ready") > 0) | (c("failed") > 0), "partially_delivered")
        .when((c("delivered") > 0) & (c("excluded") > 0), "completed_with_exclusions").when(c("delivered") > 0, "completed").otherwise("nothing_to_send")
    )
    return counts.withColumn("status", status)
