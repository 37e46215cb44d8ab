"""Delivery, retry and rollback derived from an append-only log of attempts."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import prefix_match
from quernstone.operators.tables import gapless, written

SUCCESS, RETRYABLE = ("accepted", "duplicate"), ("transient", "uncertain")
ATTEMPTS, BACKOFF = 3, (0.5, 1.5)


def idempotency_key(run: Column, key: Column, generation: Column) -> Column:
    return F.concat_ws("|", run, key, F.concat(F.lit("gen"), generation.cast("string")))


def classify(status: Column, outcome: Column) -> Column:
    """Outcome of an attempt from its HTTP status (null: timeout) and the answer's own outcome."""
    return F.when(status.isNull() | (status == 500), "uncertain").when(status == 409, "conflict").when(status >= 400, "transient").otherwise(F.coalesce(outcome, F.lit("transient")))


def payload_hash(payload: Column) -> Column:
    """First 16 hex digits over the map's entries in key order."""
    return F.substring(F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload)))), 256), 1, 16)


def current_generation(log: DataFrame) -> DataFrame:
    """log (key, generation, at, outcome, ...) with its key's highest generation; an aggregate, then a join that AQE may broadcast."""
    top = log.groupBy("key").agg(F.max("generation").alias("current_generation"))
    return log.join(top, "key")


def _last_of(log: DataFrame, outcomes: tuple[str, ...]) -> DataFrame:
    return log.where(F.col("outcome").isin(*outcomes)).groupBy("key").agg(F.max_by("outcome", F.struct("at", "seq")).alias("last"))


def _last_now(log: DataFrame, relevant: Column, *what: str) -> DataFrame:
    """key and the columns what of the last relevant attempt, where that is of the key's current generation; one aggregate, no join."""
    row = F.when(relevant, F.struct("generation", *what))
    last = log.groupBy("key").agg(F.max("generation").alias("_now"), F.max_by(row, F.when(relevant, F.struct("generation", "at", "seq"))).alias("_r"))
    return last.where(F.col("_r.generation") == F.col("_now")).select("key", *(f"_r.{w}" for w in what))


def accepted_keys(log: DataFrame) -> DataFrame:
    """key that the destination holds now: at the current generation the last of accepted, duplicate and rolled_back is no rollback."""
    return _last_now(log, F.col("outcome").isin(*SUCCESS, "rolled_back"), "outcome").where("outcome <> 'rolled_back'").select("key")


def failed_keys(log: DataFrame) -> DataFrame:
    """key whose last of rejected, accepted and duplicate is a rejection."""
    return _last_of(log, (*SUCCESS, "rejected")).where("last = 'rejected'").select("key")


def latest_accepted(log: DataFrame) -> DataFrame:
    """key, target_id, seq of the last accepted attempt of the current generation that has a target: what one undo takes back."""
    return _last_now(log, F.col("outcome").isin(*SUCCESS) & F.col("target_id").isNotNull(), "target_id", "seq")


def to_send(ready: DataFrame, log: DataFrame) -> DataFrame:
    """Ready records whose key the destination does not hold."""
    return ready.join(accepted_keys(log), "key", "left_anti")


def push(ready: DataFrame, log: DataFrame, runs: DataFrame, asked: bool = False) -> DataFrame:
    """What a push sends of ready (run_id, key, ...): records that the destination does not hold, of runs (run_id, version: of an approved schema or null, paused).

    A run without an approved schema sends nothing. A paused run, one whose delivery was undone, sends only if it is asked to.
    """
    open_runs = runs.where("version is not null") if asked else runs.where("version is not null and not coalesce(paused, false)")
    return to_send(ready.join(open_runs.select("run_id", "version"), "run_id"), log)


def undo(log: DataFrame, at: Column, refused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tombstones of one undo without those of refused keys (key), which the destination did not take back; and one row of counts: undone, kept, and paused, as the run then waits."""
    rows = roll_back(log, at)
    marked = rows.join(refused.select("key").distinct().withColumn("_kept", F.lit(True)), "key", "left")
    report = marked.agg(F.count_if(F.col("_kept").isNull()).alias("undone"), F.count_if("_kept").alias("kept")).withColumn("paused", F.col("undone") + F.col("kept") > 0)
    return marked.where("_kept is null").drop("_kept"), report


def payload_errors(rules: dict[str, Any]) -> Column:
    """Names of the fields of a payload map that break a destination's rules (schema.destination_rules()): required, allowed, pattern."""
    v = lambda name: F.coalesce(F.col("payload")[name], F.lit(""))
    checks = [F.when(v(n) == "", F.lit(n)) for n in rules.get("required", [])]
    checks += [F.when((v(n) != "") & ~v(n).isin(*allowed), F.lit(n)) for n, allowed in rules.get("allowed", {}).items()]
    checks += [F.when((v(n) != "") & ~prefix_match(v(n), pattern), F.lit(n)) for n, pattern in rules.get("patterns", {}).items()]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def known_rules(registered: DataFrame) -> DataFrame:
    """run_id, version, rules for each run: its own registration, else the version's by any run (the latest); registered: run_id, version, rules, at."""
    own = registered.groupBy("run_id", "version").agg(F.max_by("rules", "at").alias("_own"))
    every = registered.groupBy("version").agg(F.max_by("rules", "at").alias("_any"))
    runs = registered.select("run_id").distinct().crossJoin(F.broadcast(every.select("version").distinct()))  # runs by versions: metadata
    return runs.join(own, ["run_id", "version"], "left").join(every, "version", "left").select("run_id", "version", F.coalesce("_own", "_any").alias("rules"))


def list_records(target: DataFrame, run_id: str | None = None, natural_key: str | None = None, rolled_back: bool = False) -> DataFrame:
    """What a destination holds, oldest first; rolled-back records only if asked for."""
    for name, value in (("run_id", run_id), ("natural_key", natural_key)):
        if value is not None:
            target = target.where(F.col(name) == value)
    return (target if rolled_back else target.where("state = 'accepted'")).orderBy("received_at", "record_id")


Send = Callable[[DataFrame, int], DataFrame]


def deliver(ready: DataFrame, send: Send, reconcile: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS, backoff: tuple[float, ...] = BACKOFF) -> DataFrame:
    """The log of up to so many attempts for each ready record (key and payload): attempt and outcome are added.

    send(records, attempt) returns the records with an outcome; it is any sink, a table or foreachPartition over
    HTTP. Before a retry, uncertain records that reconcile(records) finds at the destination (key) become
    duplicates. Each attempt is checkpointed, as sending again to know what was sent would not do.
    """
    log, pending = None, ready
    for n in range(1, attempts + 1):
        sent = written(send(pending, n).withColumn("attempt", F.lit(n)))
        unsure = sent.where("outcome = 'uncertain'")
        found = reconcile(unsure).select("key").distinct().withColumn("_found", F.lit(True))
        settled = written(sent.join(found, "key", "left").withColumn("outcome", F.when((F.col("outcome") == "uncertain") & F.col("_found"), "duplicate").otherwise(F.col("outcome"))).drop("_found"))
        log = settled if log is None else log.unionByName(settled)
        pending = settled.where(F.col("outcome").isin(*RETRYABLE)).drop("outcome", "attempt")
        if n == attempts or pending.isEmpty():
            return log
        time.sleep(backoff[min(n - 1, len(backoff) - 1)] if backoff else 0)
    return log


def rehearse(send: Send, failures: dict[str, tuple[str, int]]) -> Send:
    """A sender for tests: keys in failures (outcome, number of attempts) fail so often first; uncertain ones are stored all the same."""

    def run(records: DataFrame, attempt: int) -> DataFrame:
        fails = [(k, o) for k, (o, n) in failures.items() if attempt <= n]
        planned = records.sparkSession.createDataFrame(fails, "key string, _fails string")
        marked = records.join(planned, "key", "left")
        stored = send(marked.where("_fails is null or _fails = 'uncertain'").drop("_fails"), attempt)
        said = stored.select("key", F.col("outcome").alias("_said"))  # what fails keeps its payload for the next attempt
        return marked.join(said, "key", "left").withColumn("outcome", F.coalesce("_fails", "_said")).drop("_fails", "_said")

    return run


def accept(incoming: DataFrame, stored: DataFrame, known_versions: DataFrame, rules: dict[str, Any] | list[str]) -> DataFrame:
    """incoming (idempotency_key, payload map, version) with outcome: duplicate or conflict for a known key, unknown schema, rejected, else accepted.

    Repeats within incoming count in the order of seq: the first is judged, later ones as repeats of it.
    """
    first = Window.partitionBy("idempotency_key").orderBy("seq")
    hashed = incoming.withColumn("hash", payload_hash(F.col("payload")))
    judged = hashed.withColumn("_first", F.first("hash").over(first)).withColumn("_n", F.row_number().over(first))
    old = stored.select(F.col("idempotency_key"), F.col("hash").alias("_old"))
    versions = known_versions.select("version").distinct().withColumn("_known", F.lit(True))
    joined = judged.join(old, "idempotency_key", "left").join(versions, "version", "left")
    missing = F.size(payload_errors(rules if isinstance(rules, dict) else {"required": rules})) > 0
    before = F.coalesce("_old", F.when(F.col("_n") > 1, F.col("_first")))
    outcome = F.when(before == F.col("hash"), "duplicate").when(before.isNotNull(), "conflict").when(F.col("_known").isNull(), "unknown_schema").when(missing, "rejected").otherwise("accepted")
    return joined.withColumn("outcome", outcome).drop("_old", "_known", "_first", "_n")


def append_attempts(log: DataFrame, path: str) -> None:
    """The sink: attempts are appended to a Parquet table; readers drop repeated ids."""
    log.write.mode("append").parquet(path)


def read_log(spark, path: str, ids: tuple[str, ...] = ("key", "generation", "seq")) -> DataFrame:
    return spark.read.parquet(path).dropDuplicates(list(ids))


def target_state(log: DataFrame) -> DataFrame:
    """record_id, state: tombstones win over the acceptance before them; latest event of each record."""
    return log.where(F.col("outcome").isin("accepted", "rolled_back")).groupBy("record_id").agg(F.max_by("outcome", F.struct("at", "seq")).alias("state"))


def roll_back(log: DataFrame, at: Column) -> DataFrame:
    """The tombstones of one undo: a rolled_back row at the next generation for each record the destination holds."""
    held = latest_accepted(log).join(accepted_keys(log), "key", "left_semi")
    now = log.groupBy("key").agg(F.max("generation").alias("generation"), F.max("seq").alias("_seq"))
    return held.join(now, "key").select("key", (F.col("generation") + 1).alias("generation"), F.lit("rolled_back").alias("outcome"), "target_id", at.alias("at"), (F.col("_seq") + 1).alias("seq"))


def buckets(log: DataFrame) -> DataFrame:
    """outcome bucket and number of attempts."""
    b = F.when(F.col("outcome").isin("accepted", "duplicate", "rejected", "uncertain"), F.col("outcome")).otherwise("failed")
    return log.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def audit_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def append_rows(log: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """log (id, seq and more) with those of rows whose id it lacks, numbered on from its last seq in order: a replay of what the log holds adds nothing, and numbers have no gaps. A repeated id among rows counts once."""
    new = rows.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti")
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return log.unionByName(gapless(new, [*order, "id"], "seq", last).select(*log.columns))


def latest_rows(log: DataFrame, n: int = 500, by: str = "at") -> DataFrame:
    """The newest n rows: what the log's report shows."""
    return log.orderBy(F.desc(by), F.desc("seq")).limit(n)
