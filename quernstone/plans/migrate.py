"""The whole run: records of messy files and a target schema become states of entities and a queue of cases."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import cases as C
from quernstone.operators import cleaning, matching, profiling, scoring, validation
from quernstone.operators.cases import Overrides
from quernstone.operators.delivery import audit_id
from quernstone.operators.tables import written
from quernstone.schema import TargetSchema
from quernstone.sources.files import record_cells

#: A source of votes: (file, profiles, schema) to {column: {field: vote}}. None by default: the engine decides alone.
VoteSource = Callable[[str, list[Any], TargetSchema], dict[str, dict[str, float]]]


@dataclass
class Evidence:
    """What the columns of all files look like; answers change none of it."""

    profiles: list[Any]
    #: Codes of each lookup that some column's commonest values hold.
    known: dict[str, set[str]]
    #: Votes of each file.
    cast: dict[str, dict[str, dict[str, float]]]


@dataclass
class RunResult:
    mappings: list[scoring.Mapping]
    plans: dict[tuple[str, str], cleaning.ColumnPlan]
    built: DataFrame
    entities: DataFrame
    issues: DataFrame
    cases: DataFrame
    folded: DataFrame
    #: survivor, field, source (record_id, file, row): which record gave a field; what an answer settles keeps the source it had.
    sources: DataFrame
    #: What a later run over the same records takes over where answers leave it as it is.
    stages: Stages | None = None

    def ready(self) -> DataFrame:
        return self.entities.where("state = 'ready'")

    def blocked(self) -> DataFrame:
        return self.entities.where("state = 'blocked'")


@dataclass
class Stages:
    """Tables of a run as they stand before answers about whole entities are put in, and the answers behind them."""

    overrides: Overrides
    evidence: Evidence
    fed: dict[str, list[Feed]]
    built: DataFrame
    values: DataFrame
    #: Pairs that are merged or asked about, and reconcile() of them with its components.
    pairs: DataFrame
    folded: DataFrame
    merged: DataFrame
    sources: DataFrame
    torn: DataFrame


def gather(records: DataFrame, lookups: DataFrame, schema: TargetSchema, votes: VoteSource | None = None) -> Evidence:
    """Profiles are collected: some KB a column, whatever the rows."""
    profiles = sorted(profiling.profile_columns(record_cells(records)).collect(), key=lambda p: (p.file, p.col_pos))
    seen = sorted({t.v for p in profiles for t in p.top or []})
    known: dict[str, set[str]] = {n: set() for n in (r.name for r in lookups.select("name").distinct().collect())}
    for r in lookups.where(F.col("code").isin(seen)).collect() if seen else []:
        known[r.name].add(r.code)
    cast = {f: votes(f, [p for p in profiles if p.file == f], schema) for f in {p.file for p in profiles}} if votes else {}
    return Evidence(profiles, known, cast)


def map_columns(evidence: Evidence, schema: TargetSchema, overrides: Overrides):
    """Mappings and column plans of the files that aren't ignored."""
    profiles = [p for p in evidence.profiles if p.file not in overrides.ignored_files]
    mappings = scoring.resolve_within_file([scoring.rank_column(p, schema, evidence.known, evidence.cast.get(p.file, {}).get(p.column)) for p in profiles])
    names = {f.name for f in schema.fields}
    for m in mappings:
        if (m.file, m.column) in overrides.column_map:
            forced = overrides.column_map[m.file, m.column]
            m.chosen, m.status = (forced, "human") if forced in names else (None, "unmapped")
    plans = {}
    for p, m in zip(profiles, mappings):
        if m.chosen:
            plan = cleaning.plan_column(p, schema[m.chosen])
            if (m.file, m.column) in overrides.date_formats:
                plan = cleaning.ColumnPlan(overrides.date_formats[m.file, m.column])
            plans[m.file, m.column] = plan
    return mappings, plans


#: How one file feeds one field: the column, the date formats that its values cannot tell apart and those that it has, answers to single values, and the constant of a field that no column feeds.
FEED = "struct<column:string,ambiguous:array<string>,formats:array<string>,answers:map<string,string>,constant:string>"
#: Files whose feeds are broadcast, some KB each; with more, Spark joins them as any other table.
BROADCAST_FILES = 2000
Feed = tuple[str | None, list[str], list[str], dict[str, str | None], str | None]


def feeds(mappings: list[scoring.Mapping], plans: dict, schema: TargetSchema, overrides: Overrides) -> dict[str, list[Feed]]:
    """For each file of which some column feeds a field: how each field of the schema is fed, in its order."""
    chosen: dict[str, dict[str, str]] = {}
    for m in sorted((m for m in mappings if m.chosen), key=lambda m: m.column):
        chosen.setdefault(m.file, {})[m.chosen] = m.column
    answers: dict[tuple[str, str], dict[str, str | None]] = {}
    for (file, column, raw), value in overrides.value_map.items():
        answers.setdefault((file, column), {})[raw] = value
    out = {}
    for file in dict.fromkeys(m.file for m in mappings if m.file in chosen):
        out[file] = []
        for f in schema.fields:
            column = chosen[file].get(f.name)
            plan = plans.get((file, column)) or cleaning.ColumnPlan()
            constant = overrides.constants.get((file, f.name), overrides.constants.get((None, f.name)))
            formats = [*([plan.date_format] if plan.date_format else []), f.date_format] if f.type in ("date", "datetime") else []
            out[file].append((column, list(plan.ambiguous), formats, answers.get((file, column), {}) if column else {}, None if column else constant))
    return out


def build(records: DataFrame, fed: dict[str, list[Feed]], schema: TargetSchema) -> DataFrame:
    """record_id, file, row and a struct for each field: value, unsafe, alternatives, steps, raw, column and confidence.

    One projection of records whatever the number of files: feeds() stand in a table with a row for each file, and a cell is looked up by the column that its row names.
    """
    if not fed:
        raise ValueError("no column of any file feeds a field")
    names = [f"_feed{i}" for i in range(len(schema.fields))]
    table = records.sparkSession.createDataFrame([(file, *own) for file, own in fed.items()], f"_file string, {', '.join(f'{n} {FEED}' for n in names)}")
    rows = records.join(F.broadcast(table) if len(fed) <= BROADCAST_FILES else table, F.col("file") == F.col("_file"))
    made = []
    for i, (f, name) in enumerate(zip(schema.fields, names)):
        feed = F.col(name)
        raw = F.element_at("cells", feed["column"])
        sure = F.coalesce(F.element_at("confidence", feed["column"]), F.lit(1.0)) if "confidence" in records.columns else F.lit(1.0)
        known = list(dict.fromkeys(x for own in fed.values() for x in (*own[i][1], *own[i][2])))
        c = cleaning.clean(raw, f, cleaning.PlannedDates(feed["ambiguous"], feed["formats"], known) if f.type in ("date", "datetime") else None)
        own = F.struct(c["value"].alias("value"), c["unsafe"].alias("unsafe"), c["alternatives"].alias("alternatives"), c["steps"].alias("steps"), raw.alias("raw"), feed["column"].alias("column"), sure.alias("confidence"))
        answered = F.map_contains_key(feed["answers"], F.coalesce(raw, F.lit(""))) & raw.isNotNull()
        made.append(F.when(feed["column"].isNull(), _fixed(feed["constant"], F.lit(None), F.lit(None))).when(answered, _fixed(F.element_at(feed["answers"], raw), raw, feed["column"])).otherwise(own).alias(f.name))
    return rows.select("record_id", "file", "row", *made)


def _fixed(value, raw, column):
    none = F.array()
    return F.struct(
        value.cast("string").alias("value"), F.lit(None).cast("string").alias("unsafe"), none.cast("array<string>").alias("alternatives"),
        none.cast(cleaning.STEPS).alias("steps"), raw.cast("string").alias("raw"), column.cast("string").alias("column"), F.lit(1.0).alias("confidence"),
    )


def _read_values(built: DataFrame, names: list[str], overrides: Overrides) -> DataFrame:
    """record_id, file, row and each field's value, answers to single cells put in."""
    values = built.select("record_id", "file", "row", *(F.col(f"{n}.value").alias(n) for n in names))
    for n in names:
        own = [(k, v) for (k, f), v in overrides.values.items() if f == n]
        if own:
            table = built.sparkSession.createDataFrame([(k, n, v) for k, v in own], "record_key string, field string, value string")
            values = cleaning.override_values(values, table, "record_id", n)
    return values


def _first_stages(records: DataFrame, evidence: Evidence, fed: dict, schema: TargetSchema, overrides: Overrides, human: DataFrame | None) -> Stages:
    names = [f.name for f in schema.fields]
    built = written(build(records, fed, schema))
    values = written(_read_values(built, names, overrides))
    pairs = written(matching.matched_pairs(values, schema))
    folded = written(matching.reconcile(pairs, human, with_component=True))
    return Stages(copy.deepcopy(overrides), evidence, fed, built, values, pairs, folded, *_entities(values, folded, names))


def _entities(values: DataFrame, folded: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    merged = written(matching.merge_records(values, folded, names, ["file", "row"]).withColumnRenamed("survivor", "record_id"))
    return merged, written(matching.field_sources(values, folded, names, ["file", "row"])), written(matching.conflicts(values, folded, names))


def _next_stages(last: Stages, records: DataFrame, fed: dict, schema: TargetSchema, overrides: Overrides, human: DataFrame | None) -> Stages:
    """The stages of a run with other answers: equal to _first_stages(), but only what the new answers touch is made anew.

    A file whose feeds changed is projected again. Records whose values changed are paired again with their blocks. Components that such
    records, their pairs before or now, or an answer about identity touch are folded again; what they merge to is merged again. All else is taken over.
    """
    spark, names, old = records.sparkSession, [f.name for f in schema.fields], last.overrides
    stale = sorted(f for f in {*fed, *last.fed} if fed.get(f) != last.fed.get(f))
    built, values = last.built, last.values
    if stale:
        again = {f: fed[f] for f in stale if f in fed}
        kept = built.where(~F.col("file").isin(*stale))
        built = written(kept.unionByName(build(records.where(F.col("file").isin(*again)), again, schema)) if again else kept)
    told = {k for k, _ in overrides.values.items() ^ old.values.items()}
    ids = [(k,) for k in sorted({record for record, _ in told})]
    touched = spark.createDataFrame(ids, "record_id string")
    if stale or ids:
        values = written(_read_values(built, names, overrides))
        if stale:
            was, now = (v.where(F.col("file").isin(*stale)).select("record_id", F.struct("row", *names).alias(n)) for v, n in ((last.values, "_was"), (values, "_now")))
            changed = was.join(now, "record_id", "full").where(~F.col("_was").eqNullSafe(F.col("_now"))).select("record_id")
            touched = touched.union(changed).distinct()
        touched = written(touched)
    pairs, ends = last.pairs, touched
    if stale or ids:
        gone = lambda side: touched.select(F.col("record_id").alias(side))
        stay = pairs.join(gone("left_id"), "left_id", "left_anti").join(gone("right_id"), "right_id", "left_anti")
        fresh = written(matching.matched_pairs(values, schema, only=touched))
        left = pairs.join(gone("left_id"), "left_id", "left_semi").unionByName(pairs.join(gone("right_id"), "right_id", "left_semi"))
        both = left.select("left_id", "right_id").unionByName(fresh.select("left_id", "right_id"))
        ends = written(touched.union(both.select("left_id")).union(both.select("right_id")).distinct())
        pairs = written(stay.select(*fresh.columns).unionByName(fresh))
    asked = sorted({x for pair, _ in overrides.identity.items() ^ old.identity.items() for x in pair})
    if not (stale or ids or asked):
        return Stages(copy.deepcopy(overrides), last.evidence, fed, built, values, pairs, last.folded, last.merged, last.sources, last.torn)
    ends = ends.union(spark.createDataFrame([(x,) for x in asked], "record_id string"))
    comps = last.folded.join(ends, "record_id", "left_semi").select("comp").distinct()
    area = written(ends.union(last.folded.join(comps, "comp", "left_semi").select("record_id")).distinct())
    part = pairs.join(area.select(F.col("record_id").alias("left_id")), "left_id", "left_semi")
    fresh = written(matching.reconcile(part, human, with_component=True))
    folded = written(last.folded.join(area, "record_id", "left_anti").select(*fresh.columns).unionByName(fresh))
    own = _entities(values.join(area, "record_id", "left_semi"), fresh, names)
    merged = written(last.merged.join(area, "record_id", "left_anti").unionByName(own[0]))
    gone = area.select(F.col("record_id").alias("survivor"))
    sources, torn = (written(was.join(gone, "survivor", "left_anti").unionByName(now)) for was, now in ((last.sources, own[1]), (last.torn, own[2])))
    return Stages(copy.deepcopy(overrides), last.evidence, fed, built, values, pairs, folded, merged, sources, torn)


def run(records: DataFrame, lookups: DataFrame, schema: TargetSchema, overrides: Overrides | None = None, votes: VoteSource | None = None, last: RunResult | None = None) -> RunResult:
    """Profiles, maps, cleans, reconciles and validates records (of sources.files.read_records, or words.as_records) and says what waits for an answer.

    Records may carry confidence (column to the sureness of its reading): a value that can't be cleaned and was read unsurely is asked about as such.

    Running it again with the same input and answers gives the same rows. Answers are looked up by content, so
    a decision about a case that no longer arises does nothing. last: a run over the same records, lookups, schema and votes with fewer answers; what
    the others don't touch is taken from its stages.
    """
    overrides = overrides or Overrides()
    spark = records.sparkSession
    if overrides.ignored_files:
        records = records.where(~F.col("file").isin(*overrides.ignored_files))
    stages = last.stages if last else None
    evidence = stages.evidence if stages else gather(records, lookups, schema, votes)
    mappings, plans = map_columns(evidence, schema, overrides)
    fed, names = feeds(mappings, plans, schema, overrides), [f.name for f in schema.fields]
    if not fed:
        raise ValueError("no column of any file feeds a field")
    human = spark.createDataFrame([(a, b, m) for (a, b), m in overrides.identity.items()], "left_id string, right_id string, merge boolean") if overrides.identity else None
    stages = _next_stages(stages, records, fed, schema, overrides, human) if stages else _first_stages(records, evidence, fed, schema, overrides, human)
    built, values, merged, sources, torn = stages.built, stages.values, stages.merged, stages.sources, stages.torn
    folded = stages.folded.drop("comp")
    if overrides.authority:
        placed = values.join(matching.survivor_of(folded), "record_id").join(torn.select("survivor").distinct(), "survivor", "left_semi")
        each = reduce(DataFrame.unionByName, (placed.select(F.col("survivor").alias("entity"), F.lit(n).alias("field"), "file", matching.filled(F.col(n)).alias("value")) for n in names))
        settled = matching.prefer(each.where("value is not null"), overrides.authority).where("value is not null").withColumnRenamed("entity", "survivor")
        settled = written(settled.join(torn.select("survivor", "field"), ["survivor", "field"], "left_semi"))
        merged, torn = _settle(merged, settled, names), torn.join(settled, ["survivor", "field"], "left_anti")
    if overrides.facts:
        told = spark.createDataFrame([(k, f, v) for (k, f), v in overrides.facts.items()], "record_id string, field string, value string")
        facts = told.join(matching.survivor_of(folded), "record_id", "left").select(F.coalesce("survivor", "record_id").alias("survivor"), "field", "value").dropDuplicates(["survivor", "field"])
        merged, torn = _settle(merged, facts, names), torn.join(facts, ["survivor", "field"], "left_anti")
    if overrides.authority or overrides.facts:
        merged, torn = written(merged), written(torn)

    long = reduce(DataFrame.unionByName, (built.select("record_id", "file", F.lit(n).alias("field"), F.lit(schema[n].type).alias("type"), f"{n}.column", f"{n}.raw", f"{n}.unsafe", f"{n}.alternatives", f"{n}.confidence") for n in names))
    answered = {*overrides.values, *overrides.facts}
    unsafe = long.where("unsafe is not null")
    if answered:
        unsafe = unsafe.join(spark.createDataFrame(list(answered), "record_id string, field string"), ["record_id", "field"], "left_anti")
    issues = validation.record_issues(merged, schema)
    queue = [C.value_cases(unsafe), C.identity_cases(folded), C.conflict_cases(torn), mapping_cases(spark, mappings), gap_cases(spark, mappings, schema)]
    for f in schema.fields:
        if f.unique:
            issues = issues.unionByName(validation.uniqueness_issues(merged, f).drop("others"))
        if f.reference:
            target = f.reference.split(".", 1)[0]
            if target == schema.entity:
                gone = validation.self_references(merged, f.name, schema.identity)
                codes = merged.select(F.col(schema.identity).alias("code")).where("code is not null")
            else:
                codes = lookups.where(F.col("name") == target).select("code")
                if codes.isEmpty():
                    continue
                gone = validation.missing_references(merged, f.name, codes, "code")
            issues = issues.unionByName(gone)
            queue.append(C.reference_cases(gone, codes))
    issues = written(issues)
    open_cells = unsafe.select("record_id", "field").unionByName(issues.where("rule like 'reference%'").select("record_id", "field"))
    queue.append(C.issue_cases(issues, open_cells))
    cases = written(_recommend(reduce(DataFrame.unionByName, queue), mappings, plans, built, values, folded))

    waiting = unsafe.select("record_id").union(folded.where("case_with is not null").select("record_id")).union(torn.select("survivor"))
    counted = merged.join(waiting.groupBy("record_id").agg(F.count(F.lit(1)).alias("open_cases")), "record_id", "left").join(issues.groupBy("record_id").agg(F.count(F.lit(1)).alias("issues")), "record_id", "left").fillna(0, ["open_cases", "issues"])
    out = F.col("record_id").isin(*overrides.excluded) | F.coalesce(F.col(schema.identity).isin(*overrides.excluded), F.lit(False)) if overrides.excluded else F.lit(False)
    states = validation.final_states(counted.withColumn("excluded", out))
    for f in schema.fields:
        if f.reference and f.reference.split(".", 1)[0] == schema.entity:
            states = written(states)
            held = validation.hold_dependents(states, f.name, schema.identity).select(F.col("id").alias("_held")).distinct()
            joined = states.join(held, states[schema.identity] == held["_held"], "left")
            states = joined.withColumn("state", F.when(F.col("_held").isNotNull(), "blocked").otherwise(F.col("state"))).drop("_held")
    return RunResult(mappings, plans, built, states.drop("excluded", "open_cases", "issues"), issues, cases, folded, sources, stages)


def audit(result: RunResult, run_id: str) -> DataFrame:
    """id, run_id, actor, action, summary, record_id, field, before, after: what a run did, one row for each applied mapping, cleaning step, merge and question.

    Ids come from what a row says, so running again, as every replay does, adds nothing to a log that holds them; the log is as
    long as the steps are many and is never collected.
    """
    none = F.lit(None).cast("string")

    def told(df: DataFrame, actor, action: str, summary, record=none, name=none, before=none, after=none, more=none) -> DataFrame:
        row = df.select(F.lit(run_id).alias("run_id"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), summary.alias("summary"), record.alias("record_id"), name.alias("field"), before.alias("before"), after.alias("after"), more.cast("string").alias("_more"))
        return row.select(audit_id(F.col("run_id"), F.col("action"), F.col("summary"), F.col("record_id"), F.col("field"), F.col("_more")).alias("id"), *row.columns[:-1])

    names = [c for c, kind in result.built.dtypes if kind.startswith("struct<value:")]
    mapped = result.built.sparkSession.createDataFrame([(m.file, m.column, m.chosen, m.status) for m in result.mappings if m.chosen], "file string, column string, chosen string, status string")
    summary = F.format_string("%s of %s feeds %s", "column", "file", "chosen")
    parts = [told(mapped.where(F.col("status") == s), who, f"mapping.{s}_applied", summary, name=F.col("chosen")) for s, who in (("human", "human"), ("auto", "agent"))]
    for n in names:
        steps = result.built.select("record_id", F.posexplode(f"{n}.steps").alias("_at", "_step"))
        parts.append(told(steps, "agent", "cleanup.applied", F.concat(F.lit(f"{n}: "), F.col("_step.rule")), F.col("record_id"), F.lit(n), F.col("_step.before"), F.col("_step.after"), F.col("_at")))
    merges = result.folded.where("case_with is null and record_id <> survivor")
    parts.append(told(merges, "agent", "records.merged", F.concat(F.lit("same entity as "), "survivor"), F.col("record_id")))
    parts.append(told(result.cases, "agent", "escalation.raised", F.concat_ws(": ", "class", "headline"), F.col("record_key"), F.col("field"), more=F.col("case_key")))
    return reduce(DataFrame.unionByName, parts)


def _settle(merged: DataFrame, answers: DataFrame, names: list[str]) -> DataFrame:
    """merged (record_id, fields) with the values of answers (survivor, field, value; null is a value): one row for each entity that has some."""
    wide = answers.groupBy("survivor").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_told"))
    joined = merged.join(wide, merged["record_id"] == wide["survivor"], "left").drop("survivor")
    told = F.coalesce("_told", F.create_map().cast("map<string,string>"))
    return joined.select("record_id", *(F.when(F.map_contains_key(told, n), F.element_at(told, n)).otherwise(F.col(n)).alias(n) for n in names), *(c for c in merged.columns if c not in ("record_id", *names)))


def _recommend(cases: DataFrame, mappings: list, plans: dict, built: DataFrame, values: DataFrame, folded: DataFrame) -> DataFrame:
    """cases with recommended: for a column of dates that read in several ways, the one reading that agrees with other files' dates of the same entities, if only one does; null otherwise."""
    spark, found = cases.sparkSession, []
    placed = values.join(matching.survivor_of(folded), "record_id")
    for m in mappings:
        plan = plans.get((m.file, m.column))
        if plan is None or len(plan.ambiguous) < 2:
            continue
        waiting = built.where((F.col("file") == m.file) & (F.col(f"{m.chosen}.unsafe") == "ambiguous date")).select("record_id", F.col(f"{m.chosen}.raw").alias("value"))
        waiting = waiting.join(matching.survivor_of(folded), "record_id").select(F.col("survivor").alias("entity"), "value")
        known = placed.where(F.col("file") != m.file).select(F.col("survivor").alias("entity"), F.col(m.chosen).alias("known")).where("known is not null").distinct()
        checked = C.recommended_reading(matching.cross_check(waiting, known, plan.ambiguous)).where("recommended").collect()  # a row at most
        found += [(m.file, m.column, "AMBIGUOUS_VALUE", r.format) for r in checked]
    if not found:
        return cases.withColumn("recommended", F.lit(None).cast("string"))
    return cases.join(F.broadcast(spark.createDataFrame(found, "file string, column string, class string, recommended string")), ["file", "column", "class"], "left")


def mapping_cases(spark, mappings: list[scoring.Mapping]) -> DataFrame:
    """AMBIGUOUS_MAPPING for columns in review, with the three best candidates as choices."""
    rows = [(m.file, m.column, [c.field for c in m.candidates[:3]]) for m in mappings if m.status == "review"]
    df = spark.createDataFrame(rows, "file string, column string, options array<string>")
    return C.case_rows(df, F.lit("AMBIGUOUS_MAPPING"), F.col("file"), F.col("column"), F.lit(None), F.lit(None), F.lit(None), F.col("options"), F.lit(0))


def gap_cases(spark, mappings: list[scoring.Mapping], schema: TargetSchema) -> DataFrame:
    """UNMAPPED_REQUIRED for each file and required field it lacks; one for the file if it supplies under 30% of them, one for the field if no file has it."""
    required = [f.name for f in schema.fields if f.required]
    fed: dict[str, set[str]] = {}
    for m in mappings:
        fed.setdefault(m.file, set()).update([m.chosen] if m.chosen else [])
    rows, anywhere = [], set().union(*fed.values()) if fed else set()
    for file, own in sorted(fed.items()):
        if required and len(own & set(required)) / len(required) < 0.30:
            rows.append((file, None, "this file does not look like the target"))
        else:
            rows += [(file, f, "no column feeds this field") for f in required if f in anywhere and f not in own]
    rows += [(None, f, "no file feeds this field") for f in required if f not in anywhere]
    df = spark.createDataFrame(rows, "file string, field string, headline string")
    return C.case_rows(df, F.lit("UNMAPPED_REQUIRED"), F.col("file"), F.lit(None), F.col("field"), F.lit(None), F.col("headline"), F.array(), F.lit(0))


def replay(records: DataFrame, lookups: DataFrame, schema: TargetSchema, decisions: list[dict], votes: VoteSource | None = None, last: RunResult | None = None) -> tuple[RunResult, list[dict]]:
    """Runs until no decision (case_key, action, value) meets a new case: a run more than there are decisions at most. Returns the last run and the decisions that met none, or were refused: approving where nothing is recommended (these say why).

    Records are written once; each run after the first makes anew only what the answers since then touch. last: an earlier result over the same
    records, whose answers hold on and whose open cases the first decisions may meet.
    """
    if last is None:
        records = written(records)
    overrides, left, result = copy.deepcopy(last.stages.overrides) if last else Overrides(), list(decisions), last
    while True:
        if result is None:
            result = run(records, lookups, schema, overrides, votes)
        keys = [d["case_key"] for d in left]
        found = {r.case_key: r.asDict() for r in result.cases.where(F.col("case_key").isin(*keys)).collect()} if keys else {}
        met, later = False, []
        for d in left:
            if d["case_key"] not in found or d.get("refused"):
                later.append(d)
                continue
            case = found[d["case_key"]]
            try:
                value = C.check_decision(case, d["action"], d.get("value"), case["recommended"])
            except C.RefusedDecision as why:
                later.append({**d, "refused": str(why)})
                continue
            C.apply_decision(overrides, case, d["action"], value)
            met = True
        left = later
        if not met:
            return result, left
        result = run(records, lookups, schema, overrides, votes, result)
