"""Quality rules by host: failures of document rules are added up for each host, shrunk towards an empirical beta prior, and the host's verdict returns to its documents."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import SPACES, arrow_map, guarded, materialize, read_table

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host with more than this shrunk rate of documents failing one rule is rejected.
MAX_RATE = 0.5


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    grams = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(grams) < len(words) - 2:
        reach = 0  # words before this one are counted
        for i, gram in enumerate(zip(words, words[1:], words[2:])):
            if grams[gram] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _stats(batch: pa.RecordBatch) -> dict:
    rows = [text_stats(x or "") for x in batch.column("text").to_pylist()]
    return {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(STATS)}


def document_rules() -> dict[str, Column]:
    """Rule to whether a document fails it, over the columns of STATS."""
    words = F.col("n_words")
    return {
        "short": words < 50,
        "repeats": F.col("n_repeat_words") * 100 > words * 50,
        "symbols": F.col("n_symbols") * 10 > words * 3,
        "lines": F.col("n_dup_lines") * 20 > words,
        "lengths": (F.col("word_chars") < words * 2) | (F.col("word_chars") > words * 15),
    }


def host_verdicts(stats: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """One row for each host (null is one): host, host_docs, the shrunk rate of each rule, and host_ok.

    The prior of a rule is the beta distribution whose mean and variance match the hosts' rates, after the
    variance that chance alone would give; it comes from one row of sums over all hosts.
    """
    rules = document_rules()
    fails = stats.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), *(F.count_if(c).alias(f"fail_{r}") for r, c in rules.items()))
    n = F.col("host_docs")
    sums = fails.agg(
        F.count(F.lit(1)).alias("_k"), F.sum(n).alias("_n"),
        *(F.sum(f"fail_{r}").alias(f"_f_{r}") for r in rules), *(F.sum(F.col(f"fail_{r}") * F.col(f"fail_{r}") / n).alias(f"_q_{r}") for r in rules),
    )
    for r in rules:
        mean, noise = F.col(f"_f_{r}") / F.col("_n"), F.col(f"_m_{r}") * (1 - F.col(f"_m_{r}"))
        spread = F.col(f"_q_{r}") / F.col("_n") - F.col(f"_m_{r}") * F.col(f"_m_{r}") - noise * F.col("_k") / F.col("_n")
        sums = sums.withColumn(f"_m_{r}", mean).withColumn(f"_s_{r}", F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.when(spread > 0, noise / spread - 1).otherwise(1e6))))
    # The sums are one row by construction.
    both = fails.crossJoin(F.broadcast(sums.select(*(f"_{x}_{r}" for x in "ms" for r in rules))))
    rates = {r: (F.col(f"fail_{r}") + F.col(f"_m_{r}") * F.col(f"_s_{r}")) / (n + F.col(f"_s_{r}")) for r in rules}
    rated = both.select(host, "host_docs", *(c.alias(f"rate_{r}") for r, c in rates.items()))
    return rated.withColumn("host_ok", F.greatest(*(F.col(f"rate_{r}") for r in rules)) <= max_rate)


def _with_verdicts(stats: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """verdicts is a table already, so Spark knows its size and moves no document if it is small."""
    own = verdicts.select(F.col(host).alias("_host"), F.col("host_ok").alias("_ok"))
    rules = document_rules()
    joined = stats.join(own, stats[host].eqNullSafe(own["_host"]))
    return joined.withColumn("base_failed", rules["short"] | rules["repeats"]).withColumn("kept", ~F.col("base_failed") & F.col("_ok")).drop("_host", "_ok")


FIELDS = [T.StructField(x, T.LongType()) for x in STATS]


@guarded
def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Each row of docs with STATS, base_failed and kept.

    A null text is empty and fails the base (under 50 words). A null host is a host of its own. Repeated rows
    count each. Columns of docs named like a result are replaced; all others pass. An empty table gives none.
    Statistics are made twice, once for the hosts and once for the rows, so that no text is stored between.
    """
    narrow = arrow_map(docs.select("text", host), FIELDS, _stats, drop=("text",))
    verdicts = materialize(host_verdicts(narrow, host, max_rate), "host-verdicts")
    return _with_verdicts(arrow_map(docs.drop("base_failed", "kept"), FIELDS, _stats), verdicts, host)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    stats = materialize(arrow_map(docs, FIELDS, _stats, drop=("text",)), "host-stats")
    verdicts = materialize(host_verdicts(stats), "host-verdicts")
    return _with_verdicts(stats, verdicts, "source").select("doc_id", *STATS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT doc_id, i, row(ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT w.doc_id, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), fails AS (
  SELECT source, rule, count(*) AS n, sum(bad::INT) AS f FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'lengths']) AS rule,
      unnest([n_words < 50, n_repeat_words * 100 > n_words * 50, n_symbols * 10 > n_words * 3, n_dup_lines * 20 > n_words, word_chars < n_words * 2 OR word_chars > n_words * 15]) AS bad FROM s
  ) GROUP BY source, rule
), sums AS (
  SELECT rule, count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM fails GROUP BY rule
), prior AS (
  SELECT rule, m, q / n - m * m - m * (1 - m) * k / n AS spread FROM sums
), strength AS (
  SELECT rule, m, greatest(1.0, least(1e6, CASE WHEN spread > 0 THEN m * (1 - m) / spread - 1 ELSE 1e6 END)) AS s FROM prior
), hosts AS (
  SELECT source, max((f + m * strength.s) / (n + strength.s)) <= 0.5 AS ok FROM fails JOIN strength USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ok AS kept
FROM s JOIN hosts ON s.source IS NOT DISTINCT FROM hosts.source
"""
