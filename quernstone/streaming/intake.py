"""Continuous intake: the batch operators applied to files and attempts as they arrive. An extension; the run itself is a batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.sources.files import RECORDS, SIDECAR, UnsupportedInput, _rows


def watch_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the records of files that appear in folder; unreadable files give none."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).load(folder)
    named = found.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).where(~F.col("name").endswith(SIDECAR)).select("name", "content")

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                try:
                    out.extend(_rows(r.name, bytes(r.content)))
                except UnsupportedInput:
                    continue
            yield pd.DataFrame(out, columns=["record_id", "file", "sheet", "row", "path", "cells", "col_order"])

    return named.mapInPandas(run, RECORDS)


def run_batches(records: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls handle(batch, id) for all that is there and stops; a restart takes up after the last whole batch."""
    return records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_attempts(attempts: DataFrame, within: str = "1 hour") -> DataFrame:
    """Attempts (idempotency_key, at, ...) without repeats of a key inside the watermark; state is dropped behind it."""
    return attempts.withWatermark("at", within).dropDuplicatesWithinWatermark(["idempotency_key"])
