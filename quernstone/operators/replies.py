"""Recorded replies of a model, found by the content of what was asked, and the votes in them; nothing here calls a model.

A store has one row for each reply: key, payload (JSON text of a proposal), steps (JSON text, of investigations) and call (what an
audit tells of it). A run asks by joining its requests with the store, so a repeated run gives the same votes without a network.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.recommend import model_view
from quernstone.schema import TargetSchema

KEY_LENGTH = 32
# Names and shapes of the proposals, and how many parts each may have.
CALL = "struct<provider:string,model:string,prompt_version:string,latency_ms:bigint,input_tokens:bigint,output_tokens:bigint,cached:boolean>"
PROPOSALS = {
    "MappingVote": "struct<source_column:string,votes:array<struct<target_field:string,vote:double,reason:string>>>",
    "FileAssignment": "struct<assignments:array<struct<source_column:string,target_field:string,confidence:double,runner_up:string,reason:string>>>",
    "Finding": "struct<settled:boolean,suggestion:string,conclusion:string>",
}
MOST_VOTES, MOST_ASSIGNMENTS = 5, 60
INVESTIGATION = "/investigate"
REQUEST = "file string, column string, model string, version string, kind string, system string, user string"


def _quoted(text: Column) -> Column:
    """text as a JSON string of ASCII characters: short escapes where JSON has them, else the units of UTF-16."""

    def escape(c: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        short = reduce(lambda e, x: e.when(c == x[0], x[1]), [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")], F.when(c == '"', '\\"'))
        return short.when(c.rlike(r"[^\x20-\x7E]"), units).otherwise(c)

    plain = ~text.rlike(r'[^\x20-\x7E]|["\\]')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escape), "")), F.lit('"'))


def request_key(model: Column, version: Column, kind: Column, system: Column, user: Column) -> Column:
    """First 32 hex digits of the sha256 of the five texts as a JSON array; a missing text counts as an empty one."""
    parts = [_quoted(F.coalesce(p, F.lit(""))) for p in (model, version, kind, system, user)]
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256), 1, KEY_LENGTH)


def read_store(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The store in folders of JSON files, each a reply and named by its key. Of a key in several folders one reply counts."""
    text = spark.read.text(paths, wholetext=True, pathGlobFilter="*.json")
    rows = text.select(
        F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("key"), F.get_json_object("value", "$.payload").alias("payload"),
        F.get_json_object("value", "$.steps").alias("steps"), F.from_json(F.get_json_object("value", "$.call"), CALL).alias("call"),
    )
    return rows.groupBy("key").agg(F.min(F.struct("payload", "steps", "call")).alias("r")).select("key", "r.*")


def _usable(kind: Column, payload: Column) -> Column:
    """Whether a payload has the shape that its kind asks for, with shares from 0 to 1; text for a number is none."""
    share = lambda c: c.isNotNull() & c.between(0.0, 1.0)
    vote, file, finding = (F.from_json(payload, PROPOSALS[k]) for k in ("MappingVote", "FileAssignment", "Finding"))
    votes, assigned = F.coalesce(vote["votes"], F.array()), F.coalesce(file["assignments"], F.array())
    good_vote = lambda v: v["target_field"].isNotNull() & v["reason"].isNotNull() & share(v["vote"])
    good_place = lambda a: a["source_column"].isNotNull() & a["reason"].isNotNull() & share(a["confidence"])
    checks = {
        "MappingVote": vote["source_column"].isNotNull() & (F.size(votes) <= MOST_VOTES) & F.forall(votes, good_vote),
        "FileAssignment": file.isNotNull() & (F.size(assigned) <= MOST_ASSIGNMENTS) & F.forall(assigned, good_place),
        "Finding": finding["settled"].isNotNull() & finding["conclusion"].isNotNull(),
    }
    found = reduce(lambda e, k: e.when(kind == k, checks[k]), checks, F.when(payload.isNull(), False))
    return F.coalesce(found, F.lit(False))


def replay(requests: DataFrame, store: DataFrame) -> DataFrame:
    """requests (model, version, kind, system, user and more) with key, payload, steps, call and state: replayed, missing (nothing recorded) or invalid (of another shape than kind asks for; its payload is dropped)."""
    keyed = requests.withColumn("key", request_key(*(F.col(c) for c in ("model", "version", "kind", "system", "user"))))
    found = keyed.join(store.select("key", "payload", "steps", "call", F.lit(True).alias("_held")), "key", "left")
    state = F.when(F.col("_held").isNull(), "missing").when(_usable(F.col("kind"), F.col("payload")), "replayed").otherwise("invalid")
    replayed = found.withColumn("state", state).drop("_held")
    return replayed.withColumn("payload", F.when(F.col("state") == "replayed", F.col("payload"))).withColumn("call", F.when(F.col("call").isNotNull(), F.col("call").withField("cached", F.lit(True))))


def to_record(replayed: DataFrame) -> DataFrame:
    """Each different request that a live run must still record: key, model, version, kind, system, user."""
    return replayed.where("state <> 'replayed'").select("key", "model", "version", "kind", "system", "user").dropDuplicates(["key"])


def _proposed(replayed: DataFrame, kind: str) -> DataFrame:
    return replayed.where((F.col("state") == "replayed") & (F.col("kind") == kind)).withColumn("_p", F.from_json("payload", PROPOSALS[kind]))


def _each_vote(replayed: DataFrame, *keep: str) -> DataFrame:
    return _proposed(replayed, "MappingVote").select(*keep, F.posexplode("_p.votes").alias("_at", "_v")).select(*keep, "_at", F.col("_v.target_field").alias("field"), F.col("_v.vote").alias("vote"))


def column_votes(replayed: DataFrame, fields: list[str], by: tuple[str, ...] = ("file", "column")) -> DataFrame:
    """by, field, vote of replies that judged one column each. Names that fields lack are dropped; of a field named twice in a reply the last vote counts."""
    known = _each_vote(replayed, *by, "key").where(F.col("field").isin(fields))
    return known.groupBy(*by, "key", "field").agg(F.max_by("vote", "_at").alias("vote")).drop("key")


def rejected_names(replayed: DataFrame, fields: list[str], by: tuple[str, ...] = ("file", "column")) -> DataFrame:
    """by, field: names that a reply made up, for the audit; they are never votes."""
    return _each_vote(replayed, *by).where(~F.col("field").isin(fields)).select(*by, "field").distinct()


def file_votes(replayed: DataFrame, columns: DataFrame, fields: list[str]) -> DataFrame:
    """file, column, field, vote of replies that placed all columns of a file at once.

    A column that columns (file, column) lacks is dropped, as is a field that fields lacks. A second choice has the lesser of the
    confidence and its complement, to four digits. Of a column that is placed twice the last placing with a known field counts.
    """
    each = _proposed(replayed, "FileAssignment").select("file", F.posexplode("_p.assignments").alias("_at", "_a"))
    first, second, sure = F.col("_a.target_field"), F.col("_a.runner_up"), F.col("_a.confidence")
    chosen = F.when(first.isin(fields), F.struct(first.alias("field"), sure.alias("vote")))
    other = F.when(second.isin(fields) & ~second.eqNullSafe(first), F.struct(second.alias("field"), F.round(F.least(sure, 1 - sure), 4).alias("vote")))
    votes = each.select("file", F.col("_a.source_column").alias("column"), "_at", F.array_compact(F.array(chosen, other)).alias("_votes")).where(F.size("_votes") > 0)
    last = votes.groupBy("file", "column").agg(F.max_by("_votes", "_at").alias("_votes")).join(columns.select("file", "column").distinct(), ["file", "column"], "left_semi")
    return last.select("file", "column", F.explode("_votes").alias("_v")).select("file", "column", "_v.field", "_v.vote")


def opinions(store: DataFrame, fields: list[str]) -> DataFrame:
    """column, field, vote, replies: what a store says of columns by their names alone, the mean of the replies that name the field. For runs whose prompts differ from the recorded ones."""
    held = store.withColumn("kind", F.lit("MappingVote")).withColumn("state", F.when(_usable(F.lit("MappingVote"), F.col("payload")), "replayed"))
    named = held.withColumn("column", F.from_json("payload", PROPOSALS["MappingVote"])["source_column"])
    return column_votes(named, fields, by=("column",)).groupBy("column", "field").agg(F.avg("vote").alias("vote"), F.count(F.lit(1)).alias("replies"))


def findings(replayed: DataFrame, *keep: str) -> DataFrame:
    """keep, settled, suggestion, conclusion, steps of recorded investigations; their requests have a version that ends in INVESTIGATION. A suggestion of one that settles nothing is none."""
    found = _proposed(replayed, "Finding").where(F.col("version").endswith(INVESTIGATION))
    return found.select(*keep, "_p.settled", F.when(F.col("_p.settled"), F.col("_p.suggestion")).alias("suggestion"), "_p.conclusion", "steps")


def column_requests(spark: SparkSession, profiles: list[Any], schema: TargetSchema, model: str, version: str, system: str, user: str) -> DataFrame:
    """A request a column: system and user are texts in which {schema} and {profile} stand for the fields and for the short view of the column. Values of the data only ever enter user."""
    said = system.replace("{schema}", schema_text(schema))
    rows = [(p.file, p.column, model, version, "MappingVote", said, user.replace("{profile}", json.dumps(model_view(p), ensure_ascii=False))) for p in profiles]
    return spark.createDataFrame(rows, REQUEST)


def file_requests(spark: SparkSession, profiles: list[Any], schema: TargetSchema, model: str, version: str, system: str, user: str) -> DataFrame:
    """A request a file, its columns in order: as column_requests, with {file} and {columns} in user."""
    said, files = system.replace("{schema}", schema_text(schema)), defaultdict(list)
    for p in sorted(profiles, key=lambda p: (p.file, p.col_pos)):
        files[p.file].append(model_view(p))
    rows = [(f, None, model, version, "FileAssignment", said, user.replace("{file}", f).replace("{columns}", json.dumps(views, ensure_ascii=False))) for f, views in files.items()]
    return spark.createDataFrame(rows, REQUEST)


def schema_text(schema: TargetSchema) -> str:
    """A line for each field: its name, type and rules."""
    lines = []
    for f in schema.fields:
        rules = [("required", f.required), ("unique", f.unique), (f"one of {', '.join(f.allowed or [])}", f.allowed), (f"like {f.pattern}", f.pattern), (f"found in {f.reference}", f.reference)]
        lines.append("; ".join([f"{f.name}: {f.type}", *(text for text, holds in rules if holds)]))
    return "\n".join(lines)


def vote_source(votes: DataFrame):
    """A source of votes for migrate.run out of votes (file or none, column, field, vote). They are collected: some fields a column, whatever the rows."""
    cast: dict[tuple[str | None, str], dict[str, float]] = defaultdict(dict)
    by_file = "file" in votes.columns
    for r in votes.collect():
        cast[r.file if by_file else None, r.column][r.field] = r.vote

    def source(file: str, profiles: list[Any], schema: TargetSchema) -> dict[str, dict[str, float]]:
        names, found = {f.name for f in schema.fields}, {}
        for p in profiles:
            own = {f: v for f, v in cast.get((file if by_file else None, p.column), {}).items() if f in names}
            if own:
                found[p.column] = own
        return found

    return source
