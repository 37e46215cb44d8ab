"""Queries that apply each operator to the test tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import cases, cleaning, delivery, matching, profiling, recommend, reports, scoring, validation
from quernstone.schema import Field, TargetSchema
from quernstone.sources import files, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    return profiling.to_cells(table(spark, sf_dir, name), name, F.col(key), list(columns))


def cells_sql(name: str, key: str, *columns: str) -> str:
    """The same as a WITH clause: c(file, column, v, n) counts values, nulls for markers."""
    each = " UNION ALL ".join(f"SELECT '{name}' AS file, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {name}" for c in columns)
    return f"""WITH cells AS ({each}), c AS (
  SELECT file, "column", CASE WHEN lower(trim(value)) IN ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nil', 'nan', '#n/a', '?') THEN NULL ELSE trim(value) END AS v, count(*) AS n FROM cells GROUP BY ALL
)"""


# --- profiles -------------------------------------------------------------------------------------------------------

CUSTOMER = ("customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")


@query(cells_sql(*CUSTOMER) + """
SELECT file, "column", CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS non_null, count(v) AS "distinct", min(length(v)) AS min_length, max(length(v)) AS max_length,
  round(sum(length(v) * n) / sum(n) FILTER (v IS NOT NULL), 2) AS mean_length, '' AS null_markers, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_count, count(v) / sum(n) FILTER (v IS NOT NULL) AS cardinality_ratio
FROM c GROUP BY file, "column" """)
def profile_column_counts(spark, sf_dir):
    return profiling.column_counts(profiling.value_counts(cells(spark, sf_dir, *CUSTOMER)))


LINES = ("lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_quantity")


@query(cells_sql(*LINES) + r""", r AS (
  SELECT file, "column", unnest(['integer', 'number', 'boolean', 'email', 'phone', 'string']) AS type, unnest([
    sum(CASE WHEN regexp_matches(v, '^[+-]?\d+$') THEN n ELSE 0 END) / sum(n), sum(CASE WHEN regexp_matches(v, '^[+-]?(\d+\.?\d*|\.\d+)$') THEN n ELSE 0 END) / sum(n),
    sum(CASE WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', '0', '1', 't', 'f') THEN n ELSE 0 END) / sum(n), sum(CASE WHEN regexp_matches(v, '^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$') THEN n ELSE 0 END) / sum(n),
    sum(CASE WHEN regexp_matches(v, '^\+?[0-9][0-9\s\-().]{6,}[0-9]$') THEN n ELSE 0 END) / sum(n), 1.0]) AS parse_rate
  FROM c WHERE v IS NOT NULL GROUP BY file, "column"
) SELECT * FROM r WHERE parse_rate > 0""")
def type_parse_rates(spark, sf_dir):
    return profiling.type_rates(profiling.value_counts(cells(spark, sf_dir, *LINES)))


def _dated(spark, sf_dir):
    """Order dates as text: day first, month first for every fifth order whose day is at most 12."""
    o = table(spark, sf_dir, "orders")
    text = F.when((F.col("o_orderkey") % 5 == 0) & (F.day("o_orderdate") <= 12), F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.withColumn("dated", text)


DATED_SQL = "dated AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 5 = 0 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS dated FROM orders)"
RATES_SQL = DATED_SQL + """, p AS (
  """ + " UNION ALL ".join(f"SELECT '{f}' AS format, try_strptime(dated, '{f}') AS dt FROM dated" for f in X.DATE_FORMATS if f not in ("%Y/%m/%d", "%Y%m%d")) + """
), rates AS (SELECT format, count(*) / (SELECT count(*) FROM dated) AS rate, bool_or(day(dt) > 12) AS decidable FROM p WHERE dt IS NOT NULL GROUP BY format)"""


@query(f"WITH {RATES_SQL} SELECT 'orders' AS file, 'dated' AS \"column\", format, rate, decidable FROM rates")
def date_format_rates(spark, sf_dir):
    return profiling.date_rates(profiling.value_counts(profiling.to_cells(_dated(spark, sf_dir), "orders", F.col("o_orderkey"), ["dated"])))


@query(f"WITH {RATES_SQL} SELECT 'orders' AS file, 'dated' AS \"column\", max(rate) AS date_rate, string_agg(format, ',' ORDER BY format) AS date_formats FROM rates WHERE rate >= (SELECT max(rate) FROM rates) - 1e-9")
def best_date_candidate(spark, sf_dir):
    rates = profiling.date_rates(profiling.value_counts(profiling.to_cells(_dated(spark, sf_dir), "orders", F.col("o_orderkey"), ["dated"])))
    return profiling.best_dates(rates).withColumn("date_formats", F.array_join("date_formats", ","))


PARTS = ("part", "p_partkey", "p_brand", "p_type", "p_name")


@query(cells_sql(*PARTS) + r""", chars AS (
  SELECT file, "column", v, i, CASE WHEN regexp_matches(ch, '\p{Lu}') THEN 'A' WHEN regexp_matches(ch, '\p{L}') THEN 'a' WHEN regexp_matches(ch, '\p{Nd}') THEN '#' WHEN regexp_matches(ch, '\s') THEN '_' ELSE ch END AS k
  FROM (SELECT file, "column", v, i, substring(v, i, 1) AS ch FROM (SELECT file, "column", v, unnest(generate_series(1, length(v))) AS i FROM c))
), runs AS (
  SELECT file, "column", v, k, min(i) AS pos, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY file, "column", v, k ORDER BY i) AS g FROM chars) GROUP BY file, "column", v, k, g
), m AS (
  SELECT file, "column", v, string_agg(CASE WHEN len > 1 THEN k || '{' || len || '}' ELSE k END, '' ORDER BY pos) AS mask FROM runs GROUP BY file, "column", v
), s AS (SELECT file, "column", mask, CAST(sum(n) AS BIGINT) AS n FROM m JOIN c USING (file, "column", v) GROUP BY ALL)
SELECT * FROM (SELECT *, n / sum(n) OVER (PARTITION BY file, "column") AS coverage, row_number() OVER (PARTITION BY file, "column" ORDER BY n DESC, mask) AS rank FROM s) WHERE rank <= 3""")
def mask_coverage_top3(spark, sf_dir):
    return profiling.masks(profiling.value_counts(cells(spark, sf_dir, *PARTS)))


@query(cells_sql(*PARTS) + """ SELECT file, "column", v, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY file, "column" ORDER BY n DESC, v) AS rank FROM c WHERE v IS NOT NULL) WHERE rank <= 10""")
def top_values(spark, sf_dir):
    return profiling.top_values(profiling.value_counts(cells(spark, sf_dir, *PARTS)), ties="v").drop("first_row")


@query()
def sample_values(spark, sf_dir):
    return profiling.sample_values(profiling.value_counts(cells(spark, sf_dir, *PARTS)))


@query()
def profile_columns(spark, sf_dir):
    return profiling.profile_columns(cells(spark, sf_dir, *CUSTOMER))


# --- scalar functions -----------------------------------------------------------------------------------------------

NOISE_SQL = """noisy AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN chr(9) || c_name || '  ' WHEN 2 THEN ' ?' WHEN 3 THEN replace(c_name, '#', '   ') WHEN 4 THEN chr(160) || c_mktsegment
  WHEN 5 THEN '  #n/a ' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE c_name || chr(10) END AS raw FROM customer)"""


def _noisy(spark, sf_dir):
    k, name = F.col("c_custkey") % 9, F.col("c_name")
    raw = (
        F.when(k == 0, "N/A").when(k == 1, F.concat(F.lit("\t"), name, F.lit("  "))).when(k == 2, " ?").when(k == 3, F.replace(name, F.lit("#"), F.lit("   "))).when(k == 4, F.concat(F.lit("\u00a0"), "c_mktsegment"))
        .when(k == 5, "  #n/a ").when(k == 6, "").when(k == 7, None).otherwise(F.concat(name, F.lit("\n")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))


TRIM = r"regexp_replace(raw, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')"


@query(f"WITH {NOISE_SQL} SELECT c_custkey, {TRIM} AS trimmed, regexp_replace({TRIM}, '[\\s\\x{{A0}}]{{2,}}', ' ', 'g') AS collapsed FROM noisy")
def ws_cleanup(spark, sf_dir):
    return _noisy(spark, sf_dir).select("c_custkey", X.ws_trim(F.col("raw")).alias("trimmed"), X.collapse_ws(X.ws_trim(F.col("raw"))).alias("collapsed"))


@query(f"WITH {NOISE_SQL} SELECT c_custkey, lower({TRIM}) IN ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nil', 'nan', '#n/a', '?') AS marker, CASE WHEN lower({TRIM}) NOT IN ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nil', 'nan', '#n/a', '?') THEN {TRIM} END AS value FROM noisy")
def null_markers(spark, sf_dir):
    return _noisy(spark, sf_dir).select("c_custkey", X.is_null_marker(F.col("raw")).alias("marker"), X.present(F.col("raw")).alias("value"))


@query("""WITH e AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '@' || c_mktsegment || '.Example' WHEN 1 THEN 'A@B@' || c_mktsegment WHEN 2 THEN c_name ELSE NULL END AS m FROM customer)
SELECT c_custkey, CASE WHEN instr(m, '@') > 0 THEN substring(m, 1, instr(m, '@')) || lower(substring(m, instr(m, '@') + 1)) ELSE m END AS email FROM e""")
def email_domain(spark, sf_dir):
    k = F.col("c_custkey") % 4
    m = F.when(k == 0, F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".Example"))).when(k == 1, F.concat(F.lit("A@B@"), "c_mktsegment")).when(k == 2, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.email_domain_lower(m).alias("email"))


@query("""SELECT o_orderkey, try_cast(regexp_replace(t, '[, ]', '', 'g') AS BIGINT) AS value FROM (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) WHEN 1 THEN ' ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE o_orderstatus END AS t FROM orders)""")
def number_separators(spark, sf_dir):
    whole, k = F.floor("o_totalprice").cast("long"), F.col("o_orderkey") % 3
    t = F.when(k == 0, F.format_number(whole, 0)).when(k == 1, F.concat(F.lit(" "), whole.cast("string"))).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.number_text(t).try_cast("bigint").alias("value"))


@query("SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') AS key FROM orders")
def enum_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.alnum_key(F.col("o_orderpriority")).alias("key"))


@query(r"SELECT c_name, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace('theC' || substring(c_name, 2) || '_nameKey', '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> ''), ' ') AS tokens FROM customer")
def header_tokens(spark, sf_dir):
    header = F.concat(F.lit("theC"), F.substring("c_name", 2, 100), F.lit("_nameKey"))
    return table(spark, sf_dir, "customer").select("c_name", F.array_join(X.header_tokens(header), " ").alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(' · ', 'lineitem', l_returnflag, 'row ' || l_linenumber, 'column l_tax') AS label, 'case|' || coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, '') || '|' || l_orderkey AS key FROM lineitem")
def labels_and_keys(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    label = X.source_label(F.lit("lineitem"), F.col("l_returnflag"), F.col("l_linenumber"), F.lit("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), X.content_key(F.lit("case"), flag, F.col("l_orderkey")).alias("key"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def flatten_props(spark, sf_dir):
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"event_id": frame["event_id"], "k": [files.flatten(json.loads(p)).get("k") if p else None for p in frame["props"]]})

    return table(spark, sf_dir, "events").select("event_id", "props").mapInPandas(run, "event_id long, k string")


# --- cleanup --------------------------------------------------------------------------------------------------------

@query(f"""WITH {DATED_SQL}, r AS (SELECT o_orderkey, dated, try_strptime(dated, '%d/%m/%Y') AS a, try_strptime(dated, '%m/%d/%Y') AS b FROM dated)
SELECT o_orderkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN NULL END AS value, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN 'ambiguous date' ELSE 'not a date' END AS unsafe,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN least(strftime(a, '%Y-%m-%d'), strftime(b, '%Y-%m-%d')) || ',' || greatest(strftime(a, '%Y-%m-%d'), strftime(b, '%Y-%m-%d')) ELSE '' END AS alternatives FROM r""")
def date_ambiguous(spark, sf_dir):
    plan = cleaning.ColumnPlan(None, ["%d/%m/%Y", "%m/%d/%Y"])
    c = cleaning.clean_ascii(F.col("dated"), Field("joined", "date"), plan)
    return _dated(spark, sf_dir).select("o_orderkey", c.alias("c")).select("o_orderkey", "c.value", "c.unsafe", F.array_join("c.alternatives", ",").alias("alternatives"))


@query(f"""WITH {DATED_SQL}, r AS (SELECT o_orderkey, dated, coalesce(try_strptime(dated, '%d/%m/%Y'), try_strptime(dated, '%Y-%m-%d')) AS a FROM dated)
SELECT o_orderkey, strftime(a, '%Y-%m-%d') AS value, CASE WHEN a IS NULL THEN 'not a date' END AS unsafe, CASE WHEN a IS NULL THEN '' ELSE 'normalise_date' END AS steps FROM r""")
def date_normalise(spark, sf_dir):
    c = cleaning.clean_ascii(F.col("dated"), Field("joined", "date"), cleaning.ColumnPlan("%d/%m/%Y"))
    return _dated(spark, sf_dir).select("o_orderkey", c.alias("c")).select("o_orderkey", "c.value", "c.unsafe", F.array_join("c.steps.rule", ",").alias("steps"))


@query("""SELECT o_orderkey, CASE regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') WHEN '1urgent' THEN '1 Urgent' WHEN '2high' THEN '2_HIGH' END AS value,
  CASE WHEN regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') NOT IN ('1urgent', '2high') THEN 'not an allowed value' END AS unsafe FROM orders""")
def canonical_enum(spark, sf_dir):
    c = cleaning.clean_ascii(F.col("o_orderpriority"), Field("priority", "enum", allowed=["1 Urgent", "2_HIGH"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.value", "c.unsafe")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') WHEN 1 THEN '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS value, CASE WHEN c_custkey % 3 = 2 THEN 'pattern' END AS unsafe FROM customer""")
def pattern_punctuation(spark, sf_dir):
    ten = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+91"), ten)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("+91 ("), F.substring(ten, 1, 5), F.lit(") "), F.substring(ten, 6, 5))).otherwise(ten)
    c = cleaning.clean_ascii(raw, Field("mobile", pattern=r"^\+91[0-9]{10}$"))
    return table(spark, sf_dir, "customer").select("c_custkey", c.alias("c")).select("c_custkey", "c.value", "c.unsafe")


@query("""SELECT c_custkey AS record_key, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 'FIXED' END, c_mktsegment) AS segment, 'EUR' AS currency FROM customer""")
def overrides_and_constants(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_key"), F.col("c_mktsegment").alias("segment"))
    answers = rows.where("record_key % 10 = 0").select("record_key", F.lit("segment").alias("field"), F.lit("FIXED").alias("value"))
    return cleaning.fill_constants(cleaning.override_values(rows, answers, "record_key", "segment"), {"currency": "EUR", "segment": "never"})


@query("""SELECT file, "column", row, value, CASE WHEN value = 'BUILDING' THEN 'Bau' END AS mapped FROM (SELECT 'customer' AS file, 'c_mktsegment' AS "column", 0 AS col_pos, c_custkey AS row, c_mktsegment AS value FROM customer)""")
def value_map(spark, sf_dir):
    answers = spark.createDataFrame([("customer", "c_mktsegment", "BUILDING", "Bau"), ("other", "c_mktsegment", "MACHINERY", "x")], "file string, column string, raw string, answer string")
    return cleaning.map_values(cells(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), answers).drop("col_pos")


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""")
def union_sources(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return cleaning.union_sources([a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))])


# --- mapping --------------------------------------------------------------------------------------------------------

SCORES_SQL = """scores AS (SELECT p_brand AS file, p_type AS "column", 'f' || p_size AS field, p_size AS field_pos, max(((p_partkey * 37) % 101) / 100.0)::DOUBLE AS score FROM part GROUP BY ALL)"""
RANKED_SQL = SCORES_SQL + """, ranked AS (SELECT file, "column", field, score, round(score - second, 4) AS gap FROM (
  SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS second FROM scores WHERE score > 0 WINDOW w AS (PARTITION BY file, "column" ORDER BY score DESC, field_pos)) WHERE r = 1)"""
DECIDED_SQL = RANKED_SQL + """, decided AS (SELECT *, CASE WHEN score < 0.5 THEN 'unmapped' WHEN score >= 0.7 AND gap >= 0.1 OR gap >= 0.35 THEN 'auto' ELSE 'review' END AS status FROM ranked)"""


def _scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    score = (F.col("p_partkey") * 37 % 101) / 100.0
    return p.groupBy(F.col("p_brand").alias("file"), F.col("p_type").alias("column"), F.concat(F.lit("f"), "p_size").alias("field"), F.col("p_size").alias("field_pos")).agg(F.max(score).alias("score"))


@query(f"WITH {RANKED_SQL} SELECT * FROM ranked")
def mapping_rank_gap(spark, sf_dir):
    return scoring.rank_gap(_scores(spark, sf_dir))


@query(f"WITH {DECIDED_SQL} SELECT * FROM decided")
def mapping_decision(spark, sf_dir):
    return scoring.decide(scoring.rank_gap(_scores(spark, sf_dir)))


@query(f"""WITH {DECIDED_SQL} SELECT file, "column", field, score, gap, status FROM (SELECT *, row_number() OVER (PARTITION BY file, field ORDER BY score DESC, "column") AS r FROM decided WHERE status = 'auto') WHERE r = 1""")
def best_claims(spark, sf_dir):
    return scoring.best_claims(scoring.decide(scoring.rank_gap(_scores(spark, sf_dir))))


@query(f"""WITH {RANKED_SQL}, grid AS (SELECT a / 100.0::DOUBLE AS auto, g / 100.0::DOUBLE AS min_gap FROM (SELECT unnest([65, 70, 75, 80, 85, 90]) AS a), (SELECT unnest([5, 10, 15, 20]) AS g))
SELECT auto, min_gap, count(*) AS n_auto, count(*) FILTER (field = expected) AS n_right, count(*) FILTER (field IS DISTINCT FROM expected) AS n_wrong
FROM (SELECT *, CASE WHEN length("column") % 2 = 0 THEN field ELSE 'f1' END AS expected FROM ranked), grid WHERE score >= 0.5 AND (score >= auto AND gap >= min_gap OR gap >= 0.35) GROUP BY auto, min_gap""")
def threshold_sweep(spark, sf_dir):
    ranked = scoring.rank_gap(_scores(spark, sf_dir))
    truth = ranked.select("file", "column", F.when(F.length("column") % 2 == 0, F.col("field")).otherwise("f1").alias("expected"))
    grid = spark.createDataFrame([(a / 100, g / 100) for a in (65, 70, 75, 80, 85, 90) for g in (5, 10, 15, 20)], "auto double, min_gap double")
    return scoring.threshold_sweep(ranked, grid, truth)


APPLIED_SQL = "req AS (SELECT 'f' || unnest(generate_series(1, 12)) AS field), files AS (SELECT DISTINCT file FROM scores), applied AS (SELECT DISTINCT file, field FROM decided WHERE status = 'auto')"


def _applied(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    decided = scoring.decide(scoring.rank_gap(scores)).where("status = 'auto'")
    return spark.range(1, 13).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("field")), scores.select("file").distinct(), decided


@query(f"WITH {DECIDED_SQL}, {APPLIED_SQL} SELECT file, field FROM (SELECT * FROM req, files) ANTI JOIN applied USING (file, field)")
def required_field_gaps(spark, sf_dir):
    return scoring.required_gaps(*_applied(spark, sf_dir))


@query(f"""WITH {DECIDED_SQL}, {APPLIED_SQL}, s AS (SELECT file, count(DISTINCT field) AS supplied FROM applied SEMI JOIN req USING (field) GROUP BY file)
SELECT * FROM (SELECT file, coalesce(supplied, 0) AS supplied, coalesce(supplied, 0) / 12.0::DOUBLE AS share FROM files LEFT JOIN s USING (file)) WHERE share < 0.3""")
def unrecognised_file(spark, sf_dir):
    return scoring.unrecognised_files(*_applied(spark, sf_dir))


@query(f"WITH {RANKED_SQL} SELECT file, \"column\", field, score, gap FROM ranked WHERE field = 'f7' ORDER BY score DESC, file, \"column\" LIMIT 3")
def near_columns(spark, sf_dir):
    return scoring.near_columns(_scores(spark, sf_dir), "f7")


@query(cells_sql("customer", "c_custkey", "c_nationkey") + """, t AS (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS r FROM c WHERE v IS NOT NULL) WHERE r <= 10)
SELECT 'customer' AS file, 'c_nationkey' AS "column", count(*) FILTER (v IN (SELECT CAST(n_nationkey * 2 AS VARCHAR) FROM nation)) / count(*) AS reference_fit FROM t""")
def reference_fit(spark, sf_dir):
    top = profiling.top_values(profiling.value_counts(cells(spark, sf_dir, "customer", "c_custkey", "c_nationkey")), ties="v")
    known = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).cast("string").alias("v"), F.lit(True).alias("known"))
    return top.join(known, "v", "left").groupBy("file", "column").agg((F.count("known") / F.count(F.lit(1))).alias("reference_fit"))


@query()
def name_similarity(spark, sf_dir):
    """Every column of the tables against every field of a small target; driver-side, as headers are few."""
    target = [Field("customer_key", aliases=["c_custkey"]), Field("market_segment", aliases=["mkt_seg"]), Field("account_balance"), Field("date_of_order", aliases=["doo"])]
    names = [c for t in ("customer", "orders") for c in table(spark, sf_dir, t).columns]
    return spark.createDataFrame([(n, f.name, scoring.name_similarity(n, f)) for n in names for f in target], "column string, field string, similarity double")


# --- validation -----------------------------------------------------------------------------------------------------

ORDER_SCHEMA = TargetSchema("order", [
    Field("id", "integer", required=True, minimum=10, maximum=14000), Field("status", "enum", allowed=["F", "O"]), Field("priority", pattern="[1-3]-", max_length=8, min_length=6),
    Field("note", required=True), Field("mail", "email"), Field("price", "number", maximum=400000.0),
])


@query(r"""WITH o AS (SELECT o_orderkey AS record_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_orderpriority AS priority, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'x' END AS note,
  CASE WHEN o_orderkey % 3 = 0 THEN 'a@b.com' WHEN o_orderkey % 3 = 1 THEN 'a@b' END AS mail, CASE WHEN o_orderkey % 5 = 0 THEN 'cheap' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price FROM orders)
SELECT record_id, 'id' AS field, 'minimum' AS rule, id AS value FROM o WHERE CAST(id AS BIGINT) < 10 UNION ALL SELECT record_id, 'id', 'maximum', id FROM o WHERE CAST(id AS BIGINT) > 14000
UNION ALL SELECT record_id, 'status', 'type:enum', status FROM o WHERE status NOT IN ('F', 'O') UNION ALL SELECT record_id, 'priority', 'pattern', priority FROM o WHERE NOT regexp_matches(priority, '^(?:[1-3]-)')
UNION ALL SELECT record_id, 'priority', 'max_length', priority FROM o WHERE length(priority) > 8 UNION ALL SELECT record_id, 'priority', 'min_length', priority FROM o WHERE length(priority) < 6
UNION ALL SELECT record_id, 'note', 'required', note FROM o WHERE coalesce(note, '') = '' UNION ALL SELECT record_id, 'mail', 'type:email', mail FROM o WHERE NOT regexp_matches(mail, '^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$')
UNION ALL SELECT record_id, 'price', 'type:number', price FROM o WHERE try_cast(price AS DOUBLE) IS NULL UNION ALL SELECT record_id, 'price', 'maximum', price FROM o WHERE try_cast(price AS DOUBLE) > 400000""")
def validation_issues(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("record_id"), k.cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.when(k % 4 == 0, "").when(k % 4 > 1, "x").alias("note"),
        F.when(k % 3 == 0, "a@b.com").when(k % 3 == 1, "a@b").alias("mail"), F.when(k % 5 == 0, "cheap").otherwise(F.floor("o_totalprice").cast("long").cast("string")).alias("price"),
    )
    return validation.record_issues(o, ORDER_SCHEMA)


@query("""WITH p AS (SELECT p_partkey AS record_id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_partkey // 6 ELSE upper(p_name) || p_partkey % 700 END AS value FROM part),
g AS (SELECT lower(value) AS k, count(*) AS n, list(record_id ORDER BY record_id)[1:4] AS few FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT record_id, 'name' AS field, 'unique' AS rule, value, array_to_string(list_filter(few, lambda x: x <> record_id)[1:3], ',') AS others FROM p JOIN g ON lower(value) = k""")
def uniqueness_violations(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(" "), F.floor(k / 6).cast("string"))).otherwise(F.concat(F.upper("p_name"), (k % 700).cast("string")))
    return validation.uniqueness_issues(table(spark, sf_dir, "part").select(k.alias("record_id"), name.alias("name")), Field("name"))


@query("""SELECT o_orderkey AS record_id, 'o_custkey' AS field, 'reference:missing' AS rule, CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END FROM customer)""")
def reference_missing(spark, sf_dir):
    return validation.missing_references(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").select(F.expr("if(c_custkey % 5 = 0, -c_custkey, c_custkey)").alias("c_custkey")), "c_custkey", "o_orderkey")


SUPPLIERS_SQL = "s AS (SELECT s_suppkey AS record_id, s_suppkey AS id, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey * 7) % 113 END AS parent, CASE s_suppkey % 11 WHEN 0 THEN 'blocked' WHEN 1 THEN 'excluded' ELSE 'ready' END AS state FROM supplier)"


def _suppliers(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("record_id"), k.alias("id"), F.when(k % 6 != 0, k * 7 % 113).alias("parent"), F.when(k % 11 == 0, "blocked").when(k % 11 == 1, "excluded").otherwise("ready").alias("state"))


@query(f"""WITH {SUPPLIERS_SQL} SELECT record_id, 'parent' AS field, CASE WHEN parent = id THEN 'reference:self' ELSE 'reference:missing' END AS rule, CAST(parent AS VARCHAR) AS value FROM s WHERE parent IS NOT NULL AND (parent = id OR parent NOT IN (SELECT id FROM s))""")
def self_reference_invalid(spark, sf_dir):
    return validation.self_references(_suppliers(spark, sf_dir), "parent", "id")


@query(f"""WITH RECURSIVE {SUPPLIERS_SQL}, h(id, root) AS (SELECT s.id, b.id FROM s JOIN s b ON s.parent = b.id WHERE s.state = 'ready' AND b.state = 'blocked' UNION SELECT s.id, h.root FROM s JOIN h ON s.parent = h.id WHERE s.state = 'ready') SELECT id, root FROM h""")
def dependents_held(spark, sf_dir):
    set_checkpoints(spark)
    return validation.hold_dependents(_suppliers(spark, sf_dir), "parent", "id")


@query("SELECT s_suppkey AS id, s_suppkey % 7 = 0 AS excluded, s_suppkey % 3 AS open_cases, s_suppkey % 2 AS issues, CASE WHEN s_suppkey % 7 = 0 THEN 'excluded' WHEN s_suppkey % 3 > 0 OR s_suppkey % 2 > 0 THEN 'blocked' ELSE 'ready' END AS state FROM supplier")
def record_states(spark, sf_dir):
    k = F.col("s_suppkey")
    return validation.final_states(table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 7 == 0).alias("excluded"), (k % 3).alias("open_cases"), (k % 2).alias("issues")))


STATES = ("processing", "ready", "blocked", "delivered", "failed", "excluded")


@query("""WITH c AS (SELECT user_id, """ + ", ".join(f"count(*) FILTER (st = '{s}') AS {s}" for s in STATES) + """ FROM (SELECT user_id, (['ready', 'blocked', 'delivered', 'failed', 'excluded', 'processing'])[1 + (event_id % (1 + user_id % 5) + user_id) % 6] AS st FROM events) GROUP BY user_id)
SELECT *, CASE WHEN processing > 0 THEN 'processing' WHEN blocked > 0 AND delivered > 0 THEN 'partially_delivered' WHEN blocked > 0 THEN 'awaiting_review' WHEN ready > 0 AND delivered = 0 THEN 'ready_to_send' WHEN ready > 0 OR failed > 0 THEN 'partially_delivered'
  WHEN delivered > 0 AND excluded > 0 THEN 'completed_with_exclusions' WHEN delivered > 0 THEN 'completed' ELSE 'nothing_to_send' END AS status FROM c""")
def run_status(spark, sf_dir):
    names = F.array(*map(F.lit, ("ready", "blocked", "delivered", "failed", "excluded", "processing")))
    st = F.get(names, ((F.col("event_id") % (1 + F.col("user_id") % 5) + F.col("user_id")) % 6).cast("int"))
    e = table(spark, sf_dir, "events").select("user_id", st.alias("st"))
    return validation.run_status(e.groupBy("user_id").agg(*(F.count_if(F.col("st") == s).alias(s) for s in STATES)))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def state_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --- matching -------------------------------------------------------------------------------------------------------

PERSON = TargetSchema("person", [
    Field("id", required=True, unique=True, case_sensitive=True), Field("segment", required=True), Field("nation"), Field("band"), Field("tail"),
], blocking=[["id"], ["segment", "nation", "band"], ["tail", "nation"]], never_merge_on=[["segment", "nation"]])
PEOPLE_SQL = """people AS (SELECT CAST(c_custkey AS VARCHAR) AS record_id, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey // 8 AS VARCHAR) WHEN c_custkey % 4 = 1 THEN '' END AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS segment,
  CAST(c_nationkey AS VARCHAR) AS nation, CAST(CAST(floor(c_acctbal / 500) AS BIGINT) AS VARCHAR) AS band, CASE WHEN c_custkey % 3 > 0 THEN substring(c_name, 17, 2) END AS tail FROM customer)"""
PAIRS_SQL = PEOPLE_SQL + """, found AS (
  SELECT a.record_id AS left_id, b.record_id AS right_id, 'id' AS block FROM people a JOIN people b ON lower(nullif(a.id, '')) = lower(nullif(b.id, '')) AND a.record_id < b.record_id
  UNION ALL SELECT a.record_id, b.record_id, 'segment+nation+band' FROM people a JOIN people b ON lower(a.segment) = lower(b.segment) AND a.nation = b.nation AND a.band = b.band AND a.record_id < b.record_id
  UNION ALL SELECT a.record_id, b.record_id, 'tail+nation' FROM people a JOIN people b ON lower(a.tail) = lower(b.tail) AND a.nation = b.nation AND a.record_id < b.record_id
), pairs AS (SELECT left_id, right_id, string_agg(block, ',' ORDER BY block) AS blocks FROM (SELECT DISTINCT * FROM found) GROUP BY left_id, right_id)"""
_FIELDS = (("id", 3.0), ("segment", 2.0), ("nation", 1.0), ("band", 1.0), ("tail", 1.0))
_SAME = {n: (f"a.{n} = b.{n}" if n == "id" else f"lower(a.{n}) = lower(b.{n})") for n, _ in _FIELDS}
_BOTH = {n: f"nullif(a.{n}, '') IS NOT NULL AND nullif(b.{n}, '') IS NOT NULL" for n, _ in _FIELDS}
_AGREED = " + ".join(f"CASE WHEN {_BOTH[n]} AND {_SAME[n]} THEN {w} ELSE 0 END" for n, w in _FIELDS)
_ALL = " + ".join(f"CASE WHEN {_BOTH[n]} THEN {w} ELSE 0 END" for n, w in _FIELDS)
_NAMES = lambda t: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_BOTH[n]} AND {t}({_SAME[n]}) THEN '{n}' END" for n, _ in _FIELDS) + "], lambda x: x IS NOT NULL), ',')"
MATCH_SQL = PAIRS_SQL + f""", ev AS (SELECT left_id, right_id, blocks, {_NAMES('')} AS agreed, {_NAMES('NOT ')} AS conflicted, coalesce(round(({_AGREED}) / nullif({_ALL}, 0), 4), 0) AS score
  FROM pairs JOIN people a ON a.record_id = left_id JOIN people b ON b.record_id = right_id),
dec AS (SELECT *, CASE WHEN contains(',' || conflicted || ',', ',id,') THEN CASE WHEN score >= 0.72 THEN 'review' ELSE 'no_match' END WHEN contains(',' || agreed || ',', ',id,') THEN 'auto_merge'
  WHEN agreed IN ('segment', 'nation', 'segment,nation') THEN CASE WHEN score >= 0.72 THEN 'review' ELSE 'no_match' END WHEN score >= 0.92 THEN 'auto_merge' WHEN score >= 0.72 THEN 'review' ELSE 'no_match' END AS decision FROM ev)"""


def _people(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("record_id"), F.when(k % 4 == 0, F.floor(k / 8).cast("string")).when(k % 4 == 1, "").alias("id"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"), F.floor(F.col("c_acctbal") / 500).cast("string").alias("band"), F.when(k % 3 > 0, F.substring("c_name", 17, 2)).alias("tail"),
    )


@query(f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def candidate_pairs(spark, sf_dir):
    return matching.candidate_pairs(_people(spark, sf_dir), PERSON.blocking)


def _matched(spark, sf_dir):
    return matching.scored_pairs(_people(spark, sf_dir), PERSON)


@query(f"WITH {MATCH_SQL} SELECT * FROM dec")
def match_decision(spark, sf_dir):
    found = _matched(spark, sf_dir).drop("unique_agreed", "unique_conflicted")
    return found.withColumn("agreed", F.array_join("agreed", ",")).withColumn("conflicted", F.array_join("conflicted", ","))


@query()
def reconcile_fold(spark, sf_dir):
    set_checkpoints(spark)
    return matching.reconcile_records(_people(spark, sf_dir), PERSON)


HALVES_SQL = """halves AS (SELECT c_custkey AS e, 'a' AS file, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 < 7
  UNION ALL SELECT c_custkey, 'b', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE upper(c_name) END, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END FROM customer WHERE c_custkey % 10 > 3)"""


def _halves(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    a = c.where(k % 10 < 7).select(k.alias("e"), F.lit("a").alias("file"), F.col("c_name").alias("name"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    b = c.where(k % 10 > 3).select(k.alias("e"), F.lit("b").alias("file"), F.when(k % 2 == 0, "").otherwise(F.upper("c_name")).alias("name"), F.when(k % 5 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("segment"))
    rows = a.unionByName(b).withColumn("record_id", F.concat("file", F.lit("#"), F.lpad(F.col("e").cast("string"), 9, "0")))
    whole = rows.groupBy("e").agg(F.min("record_id").alias("survivor"))
    return rows, rows.join(whole, "e").select("record_id", "survivor", F.lit(None).cast("string").alias("case_with"))


@query(f"""WITH {HALVES_SQL} SELECT min(file || '#' || lpad(CAST(e AS VARCHAR), 9, '0')) AS survivor, arg_min(nullif(name, ''), file) FILTER (nullif(name, '') IS NOT NULL) AS name, arg_min(segment, file) FILTER (segment IS NOT NULL) AS segment, count(*) AS n_rows FROM halves GROUP BY e""")
def merged_records(spark, sf_dir):
    rows, survivors = _halves(spark, sf_dir)
    return matching.merge_records(rows, survivors, ["name", "segment"], ["record_id"])


@query(f"""WITH {HALVES_SQL}, l AS (SELECT e, file, 'name' AS field, nullif(name, '') AS v FROM halves UNION ALL SELECT e, file, 'segment', segment FROM halves), s AS (SELECT e, min(file || '#' || lpad(CAST(e AS VARCHAR), 9, '0')) AS survivor FROM halves GROUP BY e)
SELECT survivor, field, array_to_string(list_sort(list(DISTINCT v)), '|') AS values FROM l JOIN s USING (e) WHERE v IS NOT NULL GROUP BY survivor, field HAVING count(DISTINCT lower(v)) > 1""")
def conflicting_fields(spark, sf_dir):
    rows, survivors = _halves(spark, sf_dir)
    return matching.conflicts(rows, survivors, ["name", "segment"])


@query(f"""WITH {HALVES_SQL}, v AS (SELECT e AS entity, 'segment' AS field, CASE WHEN e % 7 = 0 THEN 'z' ELSE file END AS file, segment AS value FROM halves WHERE segment IS NOT NULL), r AS (SELECT *, CASE file WHEN 'b' THEN 0 WHEN 'a' THEN 1 ELSE 2 END AS rank FROM v)
SELECT entity, field, CASE WHEN count(*) FILTER (rank = best) = 1 AND best < 2 THEN min(value) FILTER (rank = best) END AS value FROM (SELECT *, min(rank) OVER (PARTITION BY entity) AS best FROM r) GROUP BY entity, field, best""")
def authority_resolution(spark, sf_dir):
    rows, _ = _halves(spark, sf_dir)
    values = rows.where("segment is not null").select(F.col("e").alias("entity"), F.lit("segment").alias("field"), F.when(F.col("e") % 7 == 0, "z").otherwise(F.col("file")).alias("file"), F.col("segment").alias("value"))
    return matching.prefer(values, ["b", "a"])


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text"), 256).alias("_h")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("_h")


@query(f"""WITH {DATED_SQL}, r AS (SELECT o_orderdate, try_strptime(dated, '%d/%m/%Y') AS a, try_strptime(dated, '%m/%d/%Y') AS b FROM dated), t AS (SELECT * FROM r WHERE a <> b)
SELECT '%d/%m/%Y' AS format, count(*) AS rows, count(*) FILTER (a = o_orderdate) AS agree FROM t UNION ALL SELECT '%m/%d/%Y', count(*), count(*) FILTER (b = o_orderdate) FROM t""")
def date_cross_check(spark, sf_dir):
    """Which reading of an ambiguous date agrees with the same entity's date in another file."""
    formats = ["%d/%m/%Y", "%m/%d/%Y"]
    other = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("known"))
    waiting = _dated(spark, sf_dir).select(F.col("o_orderkey").alias("entity"), F.col("dated").alias("value"))
    return matching.cross_check(waiting, other, formats)


# --- delivery -------------------------------------------------------------------------------------------------------

LOG_SQL = """log AS (SELECT 'u' || user_id % 400 AS key, (event_id // 2500)::INT AS generation, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'duplicate' WHEN 'purchase' THEN 'rolled_back' ELSE 'uncertain' END AS outcome,
  ts AS tm, event_id AS seq, CASE WHEN event_id % 4 > 0 THEN 't' || event_id END AS target_id FROM events)"""
NOW_SQL = LOG_SQL + ", now AS (SELECT * FROM (SELECT *, max(generation) OVER (PARTITION BY key) AS current_generation FROM log) WHERE generation = current_generation)"
HELD_SQL = NOW_SQL + ", held AS (SELECT key FROM now WHERE outcome IN ('accepted', 'duplicate', 'rolled_back') GROUP BY key HAVING arg_max(outcome, row(tm, seq)) <> 'rolled_back')"


def _log(spark, sf_dir):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "rejected").when(kind == "click", "accepted").when(kind == "view", "duplicate").when(kind == "purchase", "rolled_back").otherwise("uncertain")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 400).cast("string")).alias("key"), F.floor(F.col("event_id") / 2500).cast("int").alias("generation"), outcome.alias("outcome"), F.col("ts").alias("at"),
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("target_id"),
    )


@query(f"WITH {LOG_SQL} SELECT key, max(generation) AS current_generation, count(*) AS attempts FROM log GROUP BY key")
def delivery_generation(spark, sf_dir):
    return delivery.current_generation(_log(spark, sf_dir)).groupBy("key").agg(F.max("current_generation").alias("current_generation"), F.count(F.lit(1)).alias("attempts"))


@query(f"WITH {HELD_SQL} SELECT key FROM held")
def accepted_keys(spark, sf_dir):
    return delivery.accepted_keys(_log(spark, sf_dir))


@query(f"WITH {LOG_SQL} SELECT key FROM log WHERE outcome IN ('accepted', 'duplicate', 'rejected') GROUP BY key HAVING arg_max(outcome, row(tm, seq)) = 'rejected'")
def failed_keys(spark, sf_dir):
    return delivery.failed_keys(_log(spark, sf_dir))


@query(f"WITH {NOW_SQL} SELECT key, arg_max(target_id, row(tm, seq)) AS target_id, arg_max(seq, row(tm, seq)) AS seq FROM now WHERE outcome IN ('accepted', 'duplicate') AND target_id IS NOT NULL GROUP BY key")
def latest_accepted(spark, sf_dir):
    return delivery.latest_accepted(_log(spark, sf_dir))


@query(f"WITH {HELD_SQL} SELECT 'u' || c_custkey AS key, c_name FROM customer WHERE 'u' || c_custkey NOT IN (SELECT key FROM held)")
def ready_minus_accepted(spark, sf_dir):
    ready = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"), "c_name")
    return delivery.to_send(ready, _log(spark, sf_dir))


@query(f"WITH {LOG_SQL} SELECT CASE WHEN outcome IN ('accepted', 'duplicate', 'rejected', 'uncertain') THEN outcome ELSE 'failed' END AS bucket, count(*) AS n FROM log GROUP BY 1")
def delivery_buckets(spark, sf_dir):
    return delivery.buckets(_log(spark, sf_dir))


@query(f"WITH {LOG_SQL} SELECT key AS record_id, arg_max(outcome, row(tm, seq)) AS state FROM log WHERE outcome IN ('accepted', 'rolled_back') GROUP BY key")
def target_state(spark, sf_dir):
    return delivery.target_state(_log(spark, sf_dir).withColumnRenamed("key", "record_id"))


@query(f"""WITH {HELD_SQL}, la AS (SELECT key, arg_max(target_id, row(tm, seq)) AS target_id FROM now WHERE outcome IN ('accepted', 'duplicate') AND target_id IS NOT NULL GROUP BY key), top AS (SELECT key, max(generation) AS g, max(seq) AS s FROM log GROUP BY key)
SELECT key, g + 1 AS generation, 'rolled_back' AS outcome, target_id, '2025-01-01' AS at, s + 1 AS seq FROM la SEMI JOIN held USING (key) JOIN top USING (key)""")
def rollback_rows(spark, sf_dir):
    return delivery.roll_back(_log(spark, sf_dir), F.lit("2025-01-01"))


@query("""WITH i AS (SELECT event_id AS seq, 'r|u' || user_id || '|gen1' AS idempotency_key, event_type AS kind, event_id % 3 AS version FROM events), j AS (SELECT *, first_value(kind) OVER w AS f, row_number() OVER w AS n FROM i WINDOW w AS (PARTITION BY idempotency_key ORDER BY seq))
SELECT seq, idempotency_key, CASE WHEN n > 1 AND f = kind THEN 'duplicate' WHEN n > 1 THEN 'conflict' WHEN version = 2 THEN 'unknown_schema' WHEN kind = 'error' THEN 'rejected' ELSE 'accepted' END AS outcome FROM j""")
def idempotent_accept(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    payload = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("name"), F.when(F.col("event_type") != "error", "x"))
    incoming = e.select(F.col("event_id").alias("seq"), delivery.idempotency_key(F.lit("r"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit(1)).alias("idempotency_key"), payload.alias("payload"), (F.col("event_id") % 3).alias("version"))
    stored = spark.createDataFrame([], "idempotency_key string, hash string")
    return delivery.accept(incoming, stored, spark.createDataFrame([(0,), (1,)], "version long"), ["name"]).select("seq", "idempotency_key", "outcome")


@query("""SELECT o_orderkey, CASE WHEN s IS NULL OR s = 500 THEN 'uncertain' WHEN s = 409 THEN 'conflict' WHEN s >= 400 THEN 'transient' ELSE coalesce(CASE WHEN o_orderstatus = 'F' THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'accepted' END, 'transient') END AS outcome
FROM (SELECT *, ([200, 409, 500, 503, NULL, 200, 404])[1 + o_orderkey % 7] AS s FROM orders)""")
def classify_attempts(spark, sf_dir):
    status = F.get(F.array(*(F.lit(x) for x in (200, 409, 500, 503, None, 200, 404))), (F.col("o_orderkey") % 7).cast("int"))
    said = F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "accepted")
    return table(spark, sf_dir, "orders").select("o_orderkey", delivery.classify(status, said).alias("outcome"))


@query("SELECT event_id, substring(sha256('audit|' || event_type || '|' || event_id), 1, 32) AS id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def audit_latest(spark, sf_dir):
    """The newest rows of the audit report."""
    rows = delivery.latest_rows(table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq"), 500, "ts")
    return rows.select(F.col("seq").alias("event_id"), delivery.audit_id(F.lit("audit"), F.col("event_type"), F.col("seq")).alias("id"))


def set_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names; a local one is set only where there is none and Spark runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    if named := spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir"):
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


# --- reports --------------------------------------------------------------------------------------------------------

@query("""WITH f AS (SELECT p_type AS field, p_brand AS file, 's' || p_size % 2 AS sheet, p_partkey % 7 AS non_null, 7 + p_partkey % 3 AS total FROM part), g AS (SELECT field, file, sheet, sum(non_null) AS filled, max(total) AS rows FROM f GROUP BY ALL)
SELECT field, least(1.0, sum(filled) / sum(rows)) AS coverage FROM g GROUP BY field""")
def field_coverage(spark, sf_dir):
    k = F.col("p_partkey")
    return reports.field_coverage(table(spark, sf_dir, "part").select(F.col("p_type").alias("field"), F.col("p_brand").alias("file"), F.concat(F.lit("s"), (F.col("p_size") % 2).cast("string")).alias("sheet"), (k % 7).alias("non_null"), (7 + k % 3).alias("total")))


@query("""SELECT lower(p_type) AS header, count(*) AS n_columns, arg_max(p_brand, row(p_partkey % 50, p_brand)) AS best, max(p_partkey % 50) AS filled FROM part GROUP BY 1""")
def header_groups(spark, sf_dir):
    return reports.header_groups(table(spark, sf_dir, "part").select(F.col("p_type").alias("column"), F.col("p_brand").alias("file"), (F.col("p_partkey") % 50).alias("non_null")))


@query(f"""WITH {DECIDED_SQL}, t AS (SELECT file, "column", CASE WHEN length(file) % 2 = 0 THEN field WHEN length("column") % 2 = 0 THEN 'f1' END AS expected FROM ranked)
SELECT count(*) FILTER (status = 'auto' AND field IS NOT DISTINCT FROM expected) AS n_right, count(*) FILTER (status = 'auto' AND expected IS NOT NULL AND field <> expected) AS n_wrong, count(*) FILTER (status = 'auto' AND expected IS NULL) AS n_noise,
  count(*) FILTER (status = 'review' AND expected IS NOT NULL) AS n_over, count(*) FILTER (status = 'unmapped' AND expected IS NOT NULL) AS n_under,
  count(*) FILTER (status = 'auto' AND field IS NOT DISTINCT FROM expected OR expected IS NULL AND status <> 'auto') / count(*) AS agreement FROM t JOIN decided USING (file, "column")""")
def mapping_metrics(spark, sf_dir):
    ranked = scoring.rank_gap(_scores(spark, sf_dir))
    truth = ranked.select("file", "column", F.when(F.length("file") % 2 == 0, F.col("field")).when(F.length("column") % 2 == 0, "f1").alias("expected"))
    return reports.mapping_metrics(scoring.decide(ranked), truth)


@query("""SELECT user_id AS case_key, len(list_distinct(list_concat(list(event_id % 5) FILTER (event_type = 'error'), list(event_id % 7) FILTER (event_type = 'view')))) AS waiting FROM events GROUP BY user_id
HAVING count(*) FILTER (event_type = 'error') > 0 AND count(*) FILTER (event_type = 'view') > 0""")
def waiting_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_key")).agg(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id") % 5)).alias("blocked"), F.collect_list(F.when(F.col("event_type") == "view", F.col("event_id") % 7)).alias("children"))
    return reports.waiting_counts(e.where((F.size("blocked") > 0) & (F.size("children") > 0)))


@query("""SELECT name, string_agg(code, ',' ORDER BY code) AS options FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY code) AS r FROM (SELECT DISTINCT c_mktsegment AS name, c_name AS code FROM customer)) WHERE r <= 8 GROUP BY name""")
def lookup_options(spark, sf_dir):
    return reports.lookup_options(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("code")))


@query("""SELECT user_id AS run_id, max(event_id) AS version FROM events WHERE event_type = 'click' GROUP BY user_id""")
def latest_approved(spark, sf_dir):
    return reports.latest_version(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("version"), F.col("event_type").alias("state")), "click")


@query("SELECT user_id AS run_id, max(event_id) + 1 AS version FROM events GROUP BY user_id")
def next_version(spark, sf_dir):
    return reports.next_version(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("version")))


@query("SELECT c_nationkey, sha256(string_agg(c_name || ':' || c_custkey, '|' ORDER BY c_name || ':' || c_custkey)) AS fingerprint FROM customer GROUP BY c_nationkey")
def fingerprints(spark, sf_dir):
    return reports.fingerprint(table(spark, sf_dir, "customer"), "c_nationkey", F.concat_ws(":", "c_name", F.col("c_custkey").cast("string")))


@query("""SELECT v, CAST(n AS BIGINT) AS n FROM (SELECT p_type AS v, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, v LIMIT 20)""")
def values_in_column(spark, sf_dir):
    """A look at the commonest values of one column: a report."""
    return reports.values_in_column(profiling.value_counts(cells(spark, sf_dir, *PARTS)), "part", "p_type")


@query("""WITH c AS (SELECT 'customer' AS file, c_custkey AS row, c_custkey AS entity, 'c_name' AS "column", c_name AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_suppkey, 's_name', s_name FROM supplier)
SELECT entity, file, "column", value FROM c WHERE file <> 'supplier' AND entity IN (SELECT entity FROM c WHERE file = 'supplier')""")
def what_other_sources_say(spark, sf_dir):
    both = cells(spark, sf_dir, "customer", "c_custkey", "c_name").unionByName(cells(spark, sf_dir, "supplier", "s_suppkey", "s_name"))
    return reports.what_other_sources_say(both, both.select("file", "row", F.col("row").alias("entity")), "supplier")


@query()
def proposed_schema(spark, sf_dir):
    """A schema proposed from the profiles of two tables: a row for each field."""
    profiles = profiling.profile_columns(cells(spark, sf_dir, *CUSTOMER).unionByName(cells(spark, sf_dir, *PARTS))).collect()
    proposed = recommend.propose_schema(sorted(profiles, key=lambda p: (p.file, p.col_pos)), {"nation": {str(i) for i in range(25)}})
    return spark.createDataFrame([(f.name, f.type, f.required, f.unique, f.pattern, f.reference) for f in proposed.fields], "name string, type string, required boolean, is_unique boolean, pattern string, reference string")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey % 1000 AS y0, 10 AS h FROM lineitem)
SELECT l_orderkey AS page, l_linenumber AS word, CAST(sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY y0, l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line
FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY l_orderkey ORDER BY y0, l_linenumber) > 7 THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM w ORDER BY l_orderkey, l_linenumber, y0))""")
def word_lines(spark, sf_dir):
    """Lines of positioned words, as a scanned page gives them; a page is an order here."""
    w = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey") % 1000).cast("double").alias("y0"))
    placed = w.select(F.lit("scan").alias("file"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("text"), F.col("l_linenumber").cast("double").alias("x0"), "y0", (F.col("l_linenumber") + 1.0).alias("x1"), (F.col("y0") + 10).alias("y1"), F.lit(1.0).alias("confidence"))
    return words.lines(placed).select("page", F.col("text").alias("word"), "line")
