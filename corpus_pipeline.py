"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, host_rules, mixing, near_dups, sharding
from quernstone.llm.common import materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own base rules nor their host's verdict reject."""
    return host_rules.judge(docs).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id."""
    return near_dups.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(docs.select(*COLUMNS), mixing.word_count(), tie=("doc_id", "n_chars"))
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, int(copies))"))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of the mix; equal texts share a shard."""
    return sharding.shard_texts(docs.select("doc_id", "text"), SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing", mix_sources), ("sharding", shard)]

#: Weighted sampling and fitted budgets have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, "pipeline")
    return docs
