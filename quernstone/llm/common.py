"""Pieces that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ASCII white space that separates words: space and tab to carriage return.
SPACES = " \t\n\r\x0b\x0c"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's. A local one is made only where none is set and Spark runs on one machine, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_quern_dir", None) or f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark._quern_dir = found
    return found


_PLAIN = re.compile("[A-Za-z][A-Za-z0-9_]*")


def guarded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator(docs, ...), which may use names that start with _ for itself: columns of docs with such or odd names go by others meanwhile, in arguments that name them too."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (n for n in map("carried{}".format, range(2 * len(taken))) if n not in taken)
        odd = {c: next(free) for c in docs.columns if not _PLAIN.fullmatch(c)}
        if not odd:
            return operator(docs, *args, **kwargs)
        told = lambda a: odd.get(a, a) if isinstance(a, str) else type(a)(map(told, a)) if isinstance(a, (tuple, list)) else a
        out = operator(docs.withColumnsRenamed(odd), *map(told, args), **{k: told(a) for k, a in kwargs.items()})
        return out.withColumnsRenamed({v: k for k, v in odd.items() if v in out.columns})

    return run


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, so a lost executor costs one stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables that materialize() wrote in this process and returns how many; for a caller whose results are written, as results read them."""
    hadoop, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(hadoop).delete(path, True)
    return gone


#: Rows that go to Python at once: with documents of some KB, a few MB.
BATCH = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session was told to hand BATCH rows at most to Python at once, from now on; a lower setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return df


def arrow_map(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], dict], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns that make() computes from each batch; columns in drop, or named like a new one, go."""
    new = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.values()], names=[*names, *made])

    return small_batches(df).mapInArrow(run, T.StructType([*keep, *fields]))


def number_within(df: DataFrame, keys: list[str], tie: list[str], out: str, buckets: int = 1024, attach: DataFrame | None = None) -> DataFrame:
    """df with out: a gapless number from 0 within keys (not null), the same in every run.

    Rows of a key are dealt into hashed buckets that are numbered apart, so that no task sorts a whole key.
    Rows that agree in tie share a bucket and are interchangeable. attach has a row for each key at most and
    lends its other columns; it is joined to the counts of buckets, so that df is shuffled once.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if attach is not None:
        starts = starts.join(attach, keys)
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*tie))
    return dealt.withColumn("_r", own).join(starts, [*keys, "_b"]).withColumn(out, F.col("_start") + F.col("_r") - 1).drop("_b", "_r", "_start")


#: A key is hot if it has more than one in HOT_SHARE of all rows, and SPREAD rows; so HOT_SHARE keys are at most. It is dealt into parts of about that many rows.
HOT_SHARE, SPREAD = 1000, 64


def hot_keys(many: DataFrame, key: str) -> DataFrame:
    """key and _parts of the hot keys of a table: HOT_SHARE rows at most."""
    least = max(SPREAD, many.count() // HOT_SHARE)
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least)
    return materialize(counts.select(key, F.ceil(F.col("_n") / least).cast("int").alias("_parts")), "hot-keys")


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str, hot: DataFrame, hint: str | None = None) -> DataFrame:
    """many joined to few, which has a row for each key at most; the rows of a hot key are dealt into parts by a hash of by, and few repeats its row for each part."""
    hot = F.broadcast(hot)  # bounded, see hot_keys
    left = many.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right.hint(hint) if hint else right, [key, "_part"]).drop("_part")


def crc_rest(col: str, mod: int) -> Column:
    """crc32(col as text) mod mod; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lowest(df: DataFrame, by: Column, n: int) -> DataFrame:
    """The n rows of df with the lowest hash by (a long), as a bounded sample.

    Rows above three times the hash where n are expected go before they are sorted, so that few meet in one task.
    """
    span = 1 << 30
    rest = F.pmod(by, F.lit(span))
    share = 3 * n / max(1, df.count())
    return (df.where(rest < int(share * span)) if share < 1 else df).orderBy(rest, by).limit(n)


def sampled_docs(docs: DataFrame, n: int) -> DataFrame:
    """_h, doc_id and text (null: empty) of the n documents with the lowest hash of both, repeated rows once. Hashes are chosen first, so that only the texts of the sample travel."""
    hashed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_h", F.xxhash64("doc_id", "text"))
    chosen = materialize(lowest(hashed.select("_h"), F.col("_h"), n).distinct(), "sample")
    return hashed.join(F.broadcast(chosen), "_h", "left_semi").dropDuplicates(["_h"])  # n rows at most
