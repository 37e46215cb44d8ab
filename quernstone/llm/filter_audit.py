"""Filter interaction audit: what each filter removes, loses and repeats, in every order in which filters may be applied."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import materialize, read_table, text_or_empty

#: The filters whose flags a text alone decides, and that of repeated texts.
TEXT_RULES, REPEATED = "ABCD", "E"
RULES = TEXT_RULES + REPEATED
#: Nulls of the join's key are dealt into so many parts.
SALTS = 64


def text_fails(text: Column) -> dict[str, Column]:
    """Rule to whether a text (not null) fails it: few words, few distinct words, many capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, a boolean for each of RULES, and n, good, toxic: documents of the part that fail exactly these, and how many of them labels call good or toxic.

    A document repeats (E) if some row of a smaller doc_id has its text; a null doc_id is smaller than none and has no
    smaller one. A null text is empty, a null part the empty string. Rows count each; a doc_id with several labels is good, or toxic, if
    one of them says so. Texts travel as SHA-256 digests only. Copies are added up for each digest before they
    are compared, so a text that fills a third of the table is a few rows where its digest meets.
    """
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_fails(F.col("_t")).values())]
    slim = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text_or_empty().alias("_t"))
    slim = slim.select("doc_id", "part", sum(bits[1:], bits[0]).alias("_bits"), F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("_d"))
    rows = slim.groupBy("doc_id", "part", "_bits", "_d").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"_{c}") for c in ("quality", "toxic")))
    salted = rows.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("_d"), F.lit(SALTS))).otherwise(0))
    marked = salted.join(marks.withColumn("_salt", F.lit(0).cast("long")), ["doc_id", "_salt"], "left")
    mark = [F.coalesce(F.col(f"_{c}"), F.lit(False)).alias(f"_{c}") for c in ("quality", "toxic")]
    # Within a group every doc_id stands once, so the least one brings its number of rows along.
    groups = marked.groupBy("_d", "_bits", "part", *mark).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("_nameless")
    )
    least = F.min("_least.doc_id").over(Window.partitionBy("_d"))
    firsts = groups.withColumn("_first", F.col("_nameless") + F.when(F.col("_least.doc_id") == least, F.col("_least.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("_first").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("_first")).alias("n"))))
    flags = [((F.shiftright("_bits", i) % 2) == 1).alias(r) for i, r in enumerate(TEXT_RULES)]
    sums = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(f"_{c}"), F.col("n")).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))]
    return firsts.select("part", *flags, "_quality", "_toxic", split.alias("_e")).select("part", *TEXT_RULES, "_quality", "_toxic", "_e.*").where("n > 0").groupBy("part", *RULES).agg(*sums)


def subset_survivors(cells: DataFrame, rules: str = RULES, measures: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """part, subset (bit i: the i-th of rules is applied) and the sums of measures over what fails no rule of the subset, zeros included.

    One CUBE over the flags and part: a grouping set is a subset of the filters, and its row whose selected flags are all
    false holds the survivors of the subset. cells has a row for each part and combination at most, so the cube expands no documents.
    """
    cube = cells.cube(*rules, "part").agg(F.grouping_id().alias("_g"), *(F.sum(m).alias(m) for m in measures))
    passed = ~F.greatest(*(F.coalesce(F.col(r), F.lit(False)) for r in rules))
    chosen = [F.when(F.col("_g").bitwiseAND(1 << (len(rules) - i)) == 0, 1 << i).otherwise(0) for i in range(len(rules))]
    found = cube.where((F.col("_g") % 2 == 0) & passed).select("part", sum(chosen[1:], chosen[0]).alias("subset"), *measures)
    every = cells.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(rules)) - 1))))
    return every.join(found, ["part", "subset"], "left").fillna(0, list(measures))


def filter_steps(cells: DataFrame, rules: str = RULES) -> DataFrame:
    """part, filter_order, step and the counts of the step, for each part of cells and all orders of rules.

    kept, removed, redundant (fail the step's filter but went before), unique_fails (fail it alone), good_lost, toxic_lost,
    and shapley: what the filter removes, summed over all orders. All come from pairs of subsets that differ by the
    step's filter. An empty table gives none; orders grow with the factorial of the rules, five give 120.
    """
    n = len(rules)
    alive = materialize(subset_survivors(cells, rules), "filter-survivors")
    after = alive.select("part", F.col("subset").alias("_after"), *(F.col(m).alias(f"_{m}") for m in ("n", "good", "toxic")))
    pairs = alive.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_bit", F.expr("shiftleft(1, _i)")).where("(subset & _bit) = 0").withColumn("_after", F.expr("subset | _bit"))
    pairs = pairs.join(after, ["part", "_after"]).select(
        "part", "_i", "subset", F.col("_n").alias("kept"), (F.col("n") - F.col("_n")).alias("removed"), (F.col("good") - F.col("_good")).alias("good_lost"), (F.col("toxic") - F.col("_toxic")).alias("toxic_lost")
    )
    pairs = materialize(pairs, "filter-pairs")
    ways = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), F.bit_count("subset") + 1)
    alone = F.col("subset") == F.lit((1 << n) - 1) - F.expr("shiftleft(1, _i)")
    totals = pairs.groupBy("part", "_i").agg(
        F.max(F.when(F.col("subset") == 0, F.col("removed"))).alias("_fails"), F.max(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(ways * F.col("removed")).cast("long").alias("shapley")
    )
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(rules))))
    steps = cells.select("part").distinct().withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = [F.when(F.instr(F.expr("substr(filter_order, 1, step - 1)"), r) > 0, 1 << i).otherwise(0) for i, r in enumerate(rules)]
    steps = steps.withColumn("_i", F.expr(f"instr('{rules}', substr(filter_order, step, 1)) - 1"))
    steps = steps.withColumn("subset", sum(before[1:], before[0]))
    return steps.join(pairs, ["part", "_i", "subset"]).join(totals, ["part", "_i"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by lang, filters A to E in all 120 orders."""
    return filter_steps(materialize(failure_cells(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), "filter-cells"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, step, f, list_sum(list_transform(list_distinct(string_split(before, '')), lambda y: CASE WHEN y = '' THEN 0 ELSE 1 << (ascii(y) - 65) END))::INT AS before FROM (
    SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS f, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
), counted AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (fails & (coalesce(before, 0) | f) = 0) AS kept, sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails & f > 0) AS removed,
    sum(n) FILTER (fails & coalesce(before, 0) > 0 AND fails & f > 0) AS redundant, sum(n) FILTER (fails = f) AS unique_fails,
    sum(good) FILTER (fails & coalesce(before, 0) = 0 AND fails & f > 0) AS good_lost, sum(toxic) FILTER (fails & coalesce(before, 0) = 0 AND fails & f > 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM counted
"""
