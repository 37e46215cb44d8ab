"""Queries over recorded replies and deliveries, made from the rows of the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.operators import replies, sending
from quernstone.plans.queries import query, set_checkpoints, table

KINDS = ["click", "view", "purchase"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def _keyed(rows):
    return rows.withColumn("key", replies.request_key(*(F.col(c) for c in ("model", "version", "kind", "system", "user")))).select("key", "payload", F.lit(None).cast("string").alias("steps"), F.lit(None).cast(replies.CALL).alias("call"))


@query(r"""WITH e AS (SELECT event_id, event_type, user_id % 7 AS told, CAST(user_id % 100 AS DOUBLE) / 100 AS share,
    left(sha256('["m", "v1", "MappingVote", "' || event_type || '\n\u00e9", "' || replace(props, '"', '\"') || user_id || '"]'), 32) AS key FROM events)
SELECT event_id, key, CASE told WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' ELSE 'replayed' END AS state,
  CASE WHEN told > 1 AND event_type IN ('click', 'view', 'purchase') THEN share END AS vote FROM e""")
def replayed_votes(spark, sf_dir):
    """Every event asks about its type; replies are recorded for six of seven users, one of them with a share above 1."""
    u = F.col("user_id")
    asks = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.lit("m").alias("model"), F.lit("v1").alias("version"), F.lit("MappingVote").alias("kind"),
        F.concat("event_type", F.lit("\né")).alias("system"), F.concat("props", u.cast("string")).alias("user"),
    )
    share = F.when(u % 7 == 1, 1.5).otherwise((u % 100).cast("double") / 100)
    vote = lambda name, v: F.struct(name.alias("target_field"), v.alias("vote"), F.lit("said").alias("reason"))
    reply = F.to_json(F.struct(F.col("event_type").alias("source_column"), F.array(vote(F.col("event_type"), share), vote(F.lit("made up"), F.lit(1.0))).alias("votes")))
    store = _keyed(asks.where(u % 7 != 0).select("model", "version", "kind", "system", "user", reply.alias("payload")).distinct())
    replayed = replies.replay(asks, store)
    votes = replies.column_votes(replayed, KINDS, by=("event_id",)).drop("field")
    return replayed.select("event_id", "key", "state").join(votes, "event_id", "left")


@query("""WITH o AS (SELECT o_custkey AS file, CAST(o_orderkey AS VARCHAR) AS col, o_orderpriority AS field, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS sure FROM orders),
ok AS (SELECT file FROM o GROUP BY file HAVING count(*) <= 60)
SELECT file, col AS "column", field, CASE WHEN second THEN round(least(sure, 1 - sure), 4) ELSE sure END AS vote FROM (
  SELECT file, col, field, sure, false AS second FROM o WHERE field IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  UNION ALL SELECT file, col, '2-HIGH', sure, true FROM o WHERE field <> '2-HIGH') WHERE file IN (SELECT file FROM ok)""")
def placed_columns(spark, sf_dir):
    """The orders of a customer as the columns of a file, placed by one recorded reply a file."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").cast("string").alias("column"), F.col("o_orderpriority").alias("field"), ((F.col("o_orderkey") % 101).cast("double") / 100).alias("sure"))
    place = F.struct(F.col("column").alias("source_column"), F.col("field").alias("target_field"), F.col("sure").alias("confidence"), F.lit("2-HIGH").alias("runner_up"), F.lit("said").alias("reason"))
    said = orders.groupBy("file").agg(F.to_json(F.struct(F.sort_array(F.collect_list(place)).alias("assignments"))).alias("payload"))
    asks = said.select("file", F.lit("m").alias("model"), F.lit("w1").alias("version"), F.lit("FileAssignment").alias("kind"), F.lit("place").alias("system"), F.col("file").cast("string").alias("user"), "payload")
    return replies.file_votes(replies.replay(asks.drop("payload"), _keyed(asks)), orders, PRIORITIES)


@query("""WITH c AS (SELECT c_custkey AS k, 'u' || c_custkey AS key, c_custkey % 10 AS d FROM customer)
SELECT key, seq, CASE WHEN d = 0 AND k % 20 = 0 THEN 'duplicate' WHEN d = 0 THEN 'uncertain' WHEN d = 1 THEN 'conflict' WHEN d = 2 THEN 'rejected' WHEN d = 3 THEN 'transient' ELSE 'accepted' END AS outcome,
  CASE WHEN d > 3 THEN 'T' || key END AS target_id
FROM c, (SELECT unnest([1, 2, 3]) AS seq) WHERE seq = 1 OR d = 3 OR (d = 0 AND k % 20 <> 0)""")
def delivered_waves(spark, sf_dir):
    """All customers are posted to a destination that answers by their number; it has every second one whose answer never came."""
    set_checkpoints(spark)
    k, key = F.col("c_custkey"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    ready = table(spark, sf_dir, "customer").select(F.lit("run1").alias("run_id"), key.alias("key"), F.lit(0).cast("long").alias("generation"), F.create_map(F.lit("k"), k.cast("string"), F.lit("name"), "c_name").alias("payload"))

    def transport():
        answers = {0: (None, None), 1: (409, None), 2: (200, "rejected"), 3: (503, None)}
        return lambda _, payload: (*answers[d], None) if (d := int(payload["k"]) % 10) in answers else (200, "accepted", f"Tu{payload['k']}")

    path = f"{spark.sparkContext.getCheckpointDir()}/attempts-{uuid.uuid4().hex}"
    held = lambda unsure: unsure.where(F.col("payload")["k"].cast("int") % 20 == 0)
    return sending.deliver_in_waves(ready, path, sending.sender(transport), held, waves=2, backoff=()).select("key", "seq", "outcome", "target_id")
