"""A sink for deliveries: records are posted by many tasks at a bounded rate, in waves that each leave their attempts in a log."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quernstone.operators import delivery
from quernstone.operators.delivery import Send
from quernstone.operators.tables import written

#: Posts one record: (idempotency key, payload) to (HTTP status or None for a timeout, the answer's outcome or None, target id or None).
Post = Callable[[str, Any], tuple[int | None, str | None, str | None]]
#: Opens a connection, once a task.
Transport = Callable[[], Post]
LOG = ("key", "generation", "idempotency_key", "outcome", "target_id", "at", "seq")


def sender(transport: Transport, parallel: int = 8, rate: float | None = None) -> Send:
    """A send for deliver(): each record (idempotency_key, payload and more) is posted once by one of parallel tasks, all of them together at most rate times a second.

    The answer's status, outcome and target_id are added. A post that ends in a timeout or a broken connection is uncertain; any
    other error fails its task, and Spark posts the task's records again under the same idempotency keys, which the destination answers as duplicates.
    """
    least = parallel / rate if rate else 0.0

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        post, due = transport(), time.monotonic()
        for batch in batches:
            answers = []
            for key, payload in zip(batch["idempotency_key"], batch["payload"]):
                now = time.monotonic()
                if now < due:
                    time.sleep(due - now)
                due = max(now, due) + least
                try:
                    answers.append(post(key, dict(payload) if payload is not None else None))
                except (TimeoutError, ConnectionError):
                    answers.append((None, None, None))
            status, said, target = zip(*answers) if answers else ((), (), ())
            texts = {"_status": [None if s is None else str(s) for s in status], "_said": said, "target_id": target}
            yield batch.assign(**{c: pd.Series(list(v), index=batch.index, dtype=object) for c, v in texts.items()})

    def send(records: DataFrame, attempt: int) -> DataFrame:
        records = records.drop("target_id")  # of an attempt before
        schema = StructType([*records.schema.fields, *(StructField(c, StringType()) for c in ("_status", "_said", "target_id"))])
        answered = records.repartition(parallel, "idempotency_key").mapInPandas(posted, schema)
        return answered.withColumn("outcome", delivery.classify(F.col("_status").cast("int"), F.col("_said"))).drop("_status", "_said")

    return send


def surviving(send: Send, failures: list[Exception]) -> Send:
    """send, but records of a job that fails for good come back as uncertain: some were posted, and only the destination knows which. Its error is added to failures."""

    def run(records: DataFrame, attempt: int) -> DataFrame:
        try:
            return written(send(records, attempt))
        except AnalysisException:  # nothing was posted
            raise
        except (PySparkException, Py4JJavaError) as error:
            failures.append(error)
            logging.getLogger(__name__).warning("attempt %s: the job failed, its records are uncertain", attempt)
            return records.withColumn("target_id", F.lit(None).cast("string")).withColumn("outcome", F.lit("uncertain"))

    return run


def read_attempts(spark, path: str) -> DataFrame:
    """The log at path, without rows if nothing was delivered yet."""
    shape = "key string, generation long, idempotency_key string, outcome string, target_id string, at timestamp, seq long"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(path).dropDuplicates(["key", "generation", "seq"])


def deliver_in_waves(ready: DataFrame, path: str, send: Send, reconcile: Callable[[DataFrame], DataFrame], waves: int = 8, attempts: int = delivery.ATTEMPTS, backoff: tuple[float, ...] = delivery.BACKOFF) -> DataFrame:
    """Delivers ready (run_id, key, generation, payload) and returns the log at path (LOG), to which each wave appends its attempts.

    A wave is the records of one class of their keys' hash. One whose job fails leaves its records uncertain: reconcile(records)
    says which the destination has (key), the others are posted again; if every attempt of it fails so, the last error is raised once the log has them. If the driver is lost, so are the attempts of one wave at
    most; run again, only records that the log doesn't hold as accepted or rejected are posted, and those that were accepted unseen are
    duplicates, so none is lost or stored twice. Attempts of a key are numbered on from those in the log. A key of null is not delivered.
    Of a key that stands in ready twice the least row is delivered.
    """
    spark = ready.sparkSession
    keyed = ready.where("key is not null").withColumn("key", F.col("key").cast("string")).withColumn("generation", F.col("generation").cast("long"))
    keyed = keyed.withColumn("idempotency_key", delivery.idempotency_key(F.col("run_id").cast("string"), F.col("key"), F.col("generation")))
    log = read_attempts(spark, path)
    done = log.where(F.col("outcome").isin(*delivery.SUCCESS, "rejected", "conflict")).select("key", "generation").distinct()
    before = log.groupBy("key").agg(F.max("seq").alias("_before"))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("generation", "idempotency_key", "payload"), F.struct("generation", "idempotency_key", F.sha2(F.to_json("payload"), 256))).alias("_r")).select("key", "_r.*")
    pending = first.join(done, ["key", "generation"], "left_anti").join(before, "key", "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    pending = written(pending.withColumn("_wave", F.pmod(F.xxhash64("key"), F.lit(waves))))
    for n in range(waves):
        wave = pending.where(F.col("_wave") == n)
        if wave.isEmpty():
            continue
        failures: list[Exception] = []
        log = delivery.deliver(wave, surviving(send, failures), reconcile, attempts, backoff)
        rows = log.withColumn("at", F.current_timestamp()).withColumn("seq", (F.col("_before") + F.col("attempt")).cast("long"))
        delivery.append_attempts(rows.select(*LOG), path)
        if len(failures) == attempts:
            raise failures[-1]
    return read_attempts(spark, path)
