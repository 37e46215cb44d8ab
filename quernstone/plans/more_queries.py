"""More queries over operators of the migration, on the test tables and on tables of literals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import cases, cleaning, delivery, matching, profiling, reports, scoring
from quernstone.plans import queries as base
from quernstone.plans.queries import CUSTOMER, HELD_SQL, LOG_SQL, MATCH_SQL, NOISE_SQL, PARTS, TRIM, query, set_checkpoints, table
from quernstone.schema import Field, TargetSchema
from quernstone.sources import files, words

# --- scalar functions and projections ---------------------------------------------------------------------------------


@query("""SELECT c_custkey, coalesce(nullif(regexp_replace(h, '^\\s+|\\s+$', '', 'g'), ''), 'column_' || (c_custkey % 4 + 1)) AS header
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' ' || c_name || chr(9) WHEN 1 THEN '  ' END AS h FROM customer)""")
def clean_headers(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit("\t"))).when(k % 3 == 1, "  ")
    return table(spark, sf_dir, "customer").select("c_custkey", X.clean_header(raw, k % 4).alias("header"))


@query("SELECT c_custkey, nfc_normalize(c_name || 'e' || chr(769)) AS name FROM customer")
def nfc_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.nfc(F.concat("c_name", F.lit("é"))).alias("name"))


@query(r"""SELECT c_custkey, regexp_matches(v, '^(?:\+91[0-9]{10}$)') OR regexp_matches(regexp_replace(v, '[\s\-().]', '', 'g'), '^(?:\+91[0-9]{10}$)') AS fits
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+91 (' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || ') 12-345' WHEN 1 THEN '+911234567890' ELSE c_name END AS v FROM customer)""")
def relaxed_match(spark, sf_dir):
    k = F.col("c_custkey")
    v = F.when(k % 3 == 0, F.concat(F.lit("+91 ("), F.lpad(k.cast("string"), 5, "0"), F.lit(") 12-345"))).when(k % 3 == 1, "+911234567890").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.relaxed_match(v, r"\+91[0-9]{10}$").alias("fits"))


@query("""SELECT o_orderkey, 'Day first — ' || d || ' is ' || CASE WHEN o_orderkey % 4 = 0 THEN '%d/%m/%Y' ELSE strftime(o_orderdate, '%-d %B %Y') END AS label
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d FROM orders)""")
def reading_labels(spark, sf_dir):
    d = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.reading_label(d, "%d/%m/%Y").alias("label"))


@query("SELECT c_custkey, c_name AS label, c_mktsegment AS segment, CASE WHEN NOT regexp_matches(c_mktsegment, '^[A-M]') THEN 'pattern' END AS unsafe FROM customer")
def projected_columns(spark, sf_dir):
    """Two columns feed label: the later header in name order wins. A case-sensitive field is kept as it is and only tested."""
    fields = {"label": Field("label"), "segment": Field("segment", pattern="[A-M]", case_sensitive=True)}
    rows = cleaning.project(table(spark, sf_dir, "customer"), {"c_name": "label", "c_mktsegment": "segment", "c_acctbal": "label"}, fields, keep=("c_custkey",))
    return rows.select("c_custkey", F.col("label.value").alias("label"), F.col("segment.value").alias("segment"), F.col("segment.unsafe").alias("unsafe"))


@query(f"WITH {NOISE_SQL} SELECT c_custkey FROM noisy WHERE length({TRIM}) > 0")
def filled_rows(spark, sf_dir):
    return cleaning.drop_blank_rows(base._noisy(spark, sf_dir), ["raw"]).select("c_custkey")


@query(r"""SELECT c_custkey, substring(regexp_replace(regexp_replace(raw, '\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 120) AS name
FROM (SELECT c_custkey, chr(10) || ' ' || c_name || chr(9) || ' ' || repeat(c_mktsegment || '  ', c_custkey % 20) AS raw FROM customer)""")
def run_names(spark, sf_dir):
    raw = F.concat(F.lit("\n "), "c_name", F.lit("\t "), F.expr("repeat(concat(c_mktsegment, '  '), int(c_custkey % 20))"))
    return table(spark, sf_dir, "customer").select("c_custkey", reports.run_name(raw).alias("name"))


@query("""SELECT c_custkey AS run_id, c_name AS before, 'New ' || c_mktsegment AS after FROM customer WHERE c_custkey % 4 = 0""")
def renamed_runs(spark, sf_dir):
    """Names with white space, blank ones, ones that are too long and unchanged ones: the audit rows of the first."""
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    name = F.when(k % 4 == 0, F.concat(F.lit("  New\t "), "c_mktsegment", F.lit(" "))).when(k % 4 == 1, " ").when(k % 4 == 2, F.repeat("c_name", F.lit(20))).otherwise(F.col("c_name"))
    return reports.rename_runs(c.select(k.alias("run_id"), F.col("c_name").alias("name")), c.select(k.alias("run_id"), name.alias("name")))[1].select("run_id", "before", "after")


@query("SELECT o_orderkey, 'run1|' || o_custkey || '|gen' || (o_orderkey % 5) AS key FROM orders")
def idempotency_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", delivery.idempotency_key(F.lit("run1"), F.col("o_custkey"), F.col("o_orderkey") % 5).alias("key"))


# --- sources ----------------------------------------------------------------------------------------------------------


def _records(spark, sf_dir):
    """A lookup of nations, and a wider file of parts that is none."""
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    row = lambda df, file, key, cells: df.select(
        F.concat(F.lit(f"{file}##"), key).alias("record_id"), F.lit(file).alias("file"), F.lit(None).cast("string").alias("sheet"), F.col(key).cast("int").alias("row"), F.lit(None).cast("string").alias("path"),
        F.create_map(*(x for name, c in cells.items() for x in (F.lit(name), F.col(c).cast("string")))).alias("cells"), F.array(*map(F.lit, cells)).alias("col_order"),
    )
    nations = row(n, "nations.csv", "n_nationkey", {"code": "n_nationkey", "name": "n_name", "region": "n_regionkey"})
    return nations.unionByName(row(p, "parts.csv", "p_partkey", {"code": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}))


@query("SELECT 'nation' AS name, CAST(n_nationkey AS VARCHAR) AS code FROM nation")
def lookup_codes(spark, sf_dir):
    return files.load_lookups(_records(spark, sf_dir))


@query("""SELECT 'nation' AS name, CAST(n_nationkey AS VARCHAR) AS code, 'name' AS "column", n_name AS value FROM nation UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR) FROM nation""")
def lookup_columns(spark, sf_dir):
    return files.lookup_columns(_records(spark, sf_dir))


@query("SELECT 'parts.csv##' || p_partkey AS record_id, 'parts.csv' AS file FROM part")
def source_records(spark, sf_dir):
    return files.split_records(_records(spark, sf_dir))[0].select("record_id", "file")


@query("SELECT doc_id AS page FROM documents WHERE coalesce(n_chars, 0) < 60")
def pages_to_recognise(spark, sf_dir):
    return words.needs_ocr(table(spark, sf_dir, "documents").select(F.lit("scan").alias("file"), F.col("doc_id").alias("page"), F.col("n_chars").alias("chars"))).select("page")


@query("SELECT l_orderkey, l_linenumber, l_linenumber / 7.0::DOUBLE AS confidence FROM lineitem WHERE l_linenumber / 7.0::DOUBLE < 0.8")
def unsure_cells(spark, sf_dir):
    return words.unsure_cells(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") / 7.0).alias("confidence")))


@query("""WITH w AS (SELECT p_size AS line, p_partkey AS t, (p_partkey * 100 + p_partkey * 7 % 3 * 40)::DOUBLE AS x0 FROM part), g AS (SELECT *, x0 - lag(x0 + 50) OVER (PARTITION BY line ORDER BY x0) AS gap FROM w),
s AS (SELECT *, lead(gap) OVER (PARTITION BY line ORDER BY gap) / gap >= 1.8 AS jump, lead(gap) OVER (PARTITION BY line ORDER BY gap) AS next FROM g WHERE gap > 0),
l AS (SELECT line, coalesce(arg_min(next, gap) FILTER (jump) * 0.9, min(gap) * 0.5) AS lim FROM s GROUP BY line),
c AS (SELECT g.line, t, x0, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY g.line ORDER BY x0) AS cell FROM g LEFT JOIN l ON g.line = l.line)
SELECT line, CAST(cell AS BIGINT) AS cell, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY x0) AS text, min(x0) AS x0, max(x0 + 50) AS x1 FROM c GROUP BY line, cell""")
def word_cells(spark, sf_dir):
    """Cells of positioned words: a line is a part's size here, its words are its parts."""
    p = F.col("p_partkey")
    x0 = p * 100.0 + p * 7 % 3 * 40.0
    placed = table(spark, sf_dir, "part").select(F.lit("scan").alias("file"), F.lit(1).alias("page"), F.col("p_size").cast("long").alias("line"), p.cast("string").alias("text"), x0.alias("x0"), (x0 + 50).alias("x1"), F.lit(1.0).alias("confidence"))
    return words.cells(placed).select(F.col("line").cast("int").alias("line"), "cell", "text", "x0", "x1")


@query(r"""WITH m AS (SELECT DISTINCT p_brand AS v FROM part) SELECT v AS mask, '^' || replace(replace(replace(replace(replace(v, 'a', chr(1)), 'A', chr(2)), '#', '[0-9]'), chr(1), '[a-z]'), chr(2), '[A-Z]') || '$' AS pattern
FROM (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(v, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '#', 'g') AS v FROM m)""")
def mask_patterns(spark, sf_dir):
    """Patterns of single-character masks; masks are as few as shapes, and patterns are made on the driver."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace("p_brand", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "#")
    shapes = [r.v for r in table(spark, sf_dir, "part").select(v.alias("v")).distinct().collect()]
    return spark.createDataFrame([(s, profiling.mask_regex(s)) for s in shapes], "mask string, pattern string")


# --- mapping ----------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0.0::DOUBLE ELSE round(CASE WHEN p_partkey % 2 = 0 THEN m ELSE 0.75 * m + 0.25 * (p_size / 50.0::DOUBLE) END, 4)::DOUBLE END AS score
FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN (0.25 * (p_partkey % 10 / 10.0::DOUBLE) + 0.2 * (p_size / 50.0::DOUBLE)) / 0.45 ELSE (0.25 * (p_partkey % 10 / 10.0::DOUBLE) + 0.2 * (p_partkey % 7 / 7.0::DOUBLE) + 0.2 * (p_size / 50.0::DOUBLE)) / 0.65 END AS m FROM part)""")
def composite_scores(spark, sf_dir):
    """Measured signals of all parts in their weights; every fourth lacks one, a veto takes all, a vote moves a quarter."""
    k, size = F.col("p_partkey"), F.col("p_size") / 50
    signals = {"type": k % 10 / 10, "constraint": F.when(k % 4 != 0, k % 7 / 7), "name": size}
    return table(spark, sf_dir, "part").select("p_partkey", scoring.composite(signals, k % 9 == 0, F.when(k % 2 != 0, size)).alias("score"))


# --- matching and cases -----------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {MATCH_SQL}, e AS (SELECT left_id AS a, right_id AS b FROM dec WHERE decision = 'auto_merge' UNION SELECT right_id, left_id FROM dec WHERE decision = 'auto_merge'),
r(id, n) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.n = e.a) SELECT id, min(n) AS comp FROM r GROUP BY id""")
def entity_components(spark, sf_dir):
    set_checkpoints(spark)
    return matching.merged_components(base._people(spark, sf_dir), base.PERSON)


@query(f"""WITH {base.HALVES_SQL}, l AS (SELECT e, file || '#' || lpad(CAST(e AS VARCHAR), 9, '0') AS record_id, 'name' AS field, nullif(name, '') AS v FROM halves UNION ALL SELECT e, file || '#' || lpad(CAST(e AS VARCHAR), 9, '0'), 'segment', segment FROM halves),
s AS (SELECT e, min(record_id) AS survivor FROM l GROUP BY e) SELECT survivor, field, min(record_id) AS record_id FROM l JOIN s USING (e) WHERE v IS NOT NULL GROUP BY survivor, field""")
def field_sources(spark, sf_dir):
    rows, survivors = base._halves(spark, sf_dir)
    return matching.field_sources(rows, survivors, ["name", "segment"], ["record_id"]).select("survivor", "field", "source.record_id")


CASES_SQL = """o AS (SELECT o_orderkey AS id, 'o.csv' AS file, 'c' || o_custkey % 3 AS "column", 'f' AS field, CASE o_orderkey % 4 WHEN 0 THEN 'enum' WHEN 1 THEN 'date' ELSE 'string' END AS type, o_orderpriority AS raw,
  CASE WHEN o_orderkey % 4 = 1 THEN 'ambiguous date' ELSE 'bad' END AS unsafe, o_orderkey % 4 < 2 AS torn, CASE WHEN o_orderkey % 10 = 0 THEN 0.5 ELSE 1.0 END AS confidence FROM orders)"""


@query(f"""WITH {CASES_SQL}, m AS (SELECT *, confidence < 0.8 AS low, confidence >= 0.8 AND unsafe = 'ambiguous date' AS whole, confidence >= 0.8 AND type = 'enum' AS by_value FROM o),
g AS (SELECT CASE WHEN low THEN 'LOW_CONFIDENCE_EXTRACTION' WHEN torn THEN 'AMBIGUOUS_VALUE' ELSE 'VALIDATION_UNRESOLVED' END AS class, file, "column", field, CASE WHEN NOT whole THEN raw END AS raw, CASE WHEN NOT whole AND NOT by_value THEN CAST(id AS VARCHAR) END AS record_key, min(unsafe) AS why, count(DISTINCT id) AS blocks FROM m GROUP BY ALL)
SELECT class, file, "column", field, record_key, concat_ws(': ', why, raw) AS headline, blocks, class || '|' || coalesce(record_key, '') || '|' || field || '|' || file || ':' || "column" || '|' || CASE WHEN record_key IS NULL THEN concat_ws(': ', why, raw) ELSE '' END AS case_key FROM g""")
def unsafe_value_cases(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("record_id"), F.lit("o.csv").alias("file"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("column"), F.lit("f").alias("field"), F.when(k % 4 == 0, "enum").when(k % 4 == 1, "date").otherwise("string").alias("type"),
        F.col("o_orderpriority").alias("raw"), F.when(k % 4 == 1, "ambiguous date").otherwise("bad").alias("unsafe"), F.when(k % 4 < 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("alternatives"), F.when(k % 10 == 0, 0.5).otherwise(1.0).alias("confidence"),
    )
    return cases.value_cases(o).drop("options")


def _event_cases(spark, sf_dir):
    kinds = F.create_map(*(F.lit(x) for pair in (("click", "AMBIGUOUS_VALUE"), ("error", "MISSING_REQUIRED"), ("view", "CONFLICTING_FACTS")) for x in pair))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("case_key"), F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("UNMAPPED_REQUIRED")).alias("class"), (F.col("event_id") * 7 % 1000).alias("blocks"))


EVENT_CASES_SQL = "c AS (SELECT 'k' || event_id AS case_key, CASE event_type WHEN 'click' THEN 'AMBIGUOUS_VALUE' WHEN 'error' THEN 'MISSING_REQUIRED' WHEN 'view' THEN 'CONFLICTING_FACTS' ELSE 'UNMAPPED_REQUIRED' END AS class, event_id * 7 % 1000 AS blocks FROM events)"


@query(f"WITH {EVENT_CASES_SQL} SELECT class, count(*) AS n FROM c GROUP BY class")
def case_class_counts(spark, sf_dir):
    return cases.class_counts(_event_cases(spark, sf_dir))


@query(f"WITH {EVENT_CASES_SQL} SELECT * FROM c WHERE class IN ('AMBIGUOUS_VALUE', 'CONFLICTING_FACTS') ORDER BY blocks DESC, case_key LIMIT 10")
def cases_worth_checking(spark, sf_dir):
    """The ten cases that most records wait for: a report."""
    return cases.worth_checking(_event_cases(spark, sf_dir))


@query("SELECT 's' || s_suppkey AS case_key, printf('case-%03d', row_number() OVER (ORDER BY 's' || s_suppkey)) AS case_id FROM supplier")
def case_numbers(spark, sf_dir):
    set_checkpoints(spark)
    return cases.numbered(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("case_key")))


@query(f"WITH {EVENT_CASES_SQL} SELECT case_key, 'unanswered' AS what FROM c WHERE case_key NOT IN (SELECT 'k' || o_custkey FROM orders) UNION ALL SELECT DISTINCT 'k' || o_custkey, 'unmatched' FROM orders WHERE 'k' || o_custkey NOT IN (SELECT case_key FROM c)")
def open_answers(spark, sf_dir):
    found = _event_cases(spark, sf_dir)
    said = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("case_key")).distinct()
    return cases.unanswered(found, said).select("case_key", F.lit("unanswered").alias("what")).unionByName(cases.unmatched(said, found).select("case_key", F.lit("unmatched").alias("what")))


@query("""SELECT 'k' || c_custkey AS case_key, concat_ws(',', 'own', s) AS options FROM customer LEFT JOIN (SELECT o_custkey, string_agg(p, ',' ORDER BY p) AS s FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY o_custkey) ON o_custkey = c_custkey""")
def enriched_cases(spark, sf_dir):
    found = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("case_key"), F.array(F.lit("own")).alias("options"))
    more = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("case_key"), F.col("o_orderpriority").alias("value"))
    return cases.enrich(found, more).select("case_key", F.array_join("options", ",").alias("options"))


# --- delivery ---------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'note' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^(?:[1-3]-)') THEN 'priority' END) AS errors FROM orders""")
def payload_errors(spark, sf_dir):
    rules = TargetSchema("order", [Field("note", required=True), Field("status", "enum", allowed=["F", "O"]), Field("priority", pattern="[1-3]-")]).destination_rules()
    payload = F.create_map(F.lit("note"), F.when(F.col("o_orderkey") % 4 > 0, "x"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload")).select("o_orderkey", F.array_join(delivery.payload_errors(rules), ",").alias("errors"))


@query("""WITH r AS (SELECT user_id % 20 AS run_id, event_id % 30 * (1 + user_id % 2) AS version, event_type AS rules, event_id AS tm FROM events),
own AS (SELECT run_id, version, arg_max(rules, tm) AS a FROM r GROUP BY ALL), every AS (SELECT version, arg_max(rules, tm) AS b FROM r GROUP BY ALL)
SELECT run_id, version, coalesce(a, b) AS rules FROM (SELECT * FROM (SELECT DISTINCT run_id FROM r), every) LEFT JOIN own USING (run_id, version)""")
def known_rules(spark, sf_dir):
    """Rules of each run and version; odd users register even versions only, up to twice as far."""
    e, version = table(spark, sf_dir, "events"), F.col("event_id") % 30 * (1 + F.col("user_id") % 2)
    return delivery.known_rules(e.select((F.col("user_id") % 20).alias("run_id"), version.alias("version"), F.col("event_type").alias("rules"), F.col("event_id").alias("at")))


@query("SELECT event_id AS record_id, 'r' || user_id % 5 AS run_id, ts AS received_at FROM events WHERE user_id % 5 = 1 AND event_type <> 'error'")
def destination_records(spark, sf_dir):
    held = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("run_id"), F.when(F.col("event_type") == "error", "rolled_back").otherwise("accepted").alias("state"), F.col("ts").alias("received_at"))
    return delivery.list_records(held, run_id="r1").drop("state")


@query("SELECT user_id AS run_id, 'p' || max(event_id) AS payload FROM events WHERE event_type = 'click' GROUP BY user_id")
def run_snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    saved = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("fingerprint"), F.col("event_id").alias("at"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payload"))
    return reports.snapshot(saved, e.select(F.col("user_id").alias("run_id"), F.lit("click").alias("fingerprint")).distinct())


DELIVER_SQL = """k AS (SELECT c_custkey AS k, 'u' || c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS own FROM customer),
f AS (SELECT *, CASE WHEN k <= 10 THEN 'transient' WHEN k <= 20 THEN 'uncertain' WHEN k <= 25 THEN 'transient' END AS fails, CASE WHEN k <= 10 THEN 1 WHEN k <= 20 THEN 3 WHEN k <= 25 THEN 5 ELSE 0 END AS times FROM k)"""


@query(f"""WITH {DELIVER_SQL} SELECT key, attempt, CASE WHEN attempt > times THEN own WHEN fails = 'uncertain' AND k % 2 = 0 THEN 'duplicate' ELSE fails END AS outcome FROM f, (SELECT unnest([1, 2, 3]) AS attempt)
WHERE attempt = 1 OR attempt <= least(times + 1, 3) AND NOT (fails = 'uncertain' AND k % 2 = 0)""")
def delivery_log(spark, sf_dir):
    """Three attempts at most, with failures rehearsed; the destination says of even keys that it has them."""
    set_checkpoints(spark)
    ready = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("k"))
    fails = {f"u{i}": ("transient", 1) for i in range(11)} | {f"u{i}": ("uncertain", 3) for i in range(11, 21)} | {f"u{i}": ("transient", 5) for i in range(21, 26)}
    send = lambda records, attempt: records.withColumn("outcome", F.when(F.col("k") % 4 == 0, "rejected").otherwise("accepted"))
    log = delivery.deliver(ready, delivery.rehearse(lambda r, n: send(r, n), fails), lambda unsure: unsure.where("k % 2 = 0"), backoff=())
    return log.select("key", "attempt", "outcome")


RUNS_SQL = "runs AS (SELECT n_nationkey AS run_id, CASE WHEN n_nationkey % 4 > 0 THEN 1 END AS version, n_nationkey % 3 = 0 AS paused FROM nation)"


@query(f"WITH {HELD_SQL}, {RUNS_SQL} SELECT c_nationkey AS run_id, 'u' || c_custkey AS key, version FROM customer JOIN runs ON run_id = c_nationkey WHERE version IS NOT NULL AND NOT paused AND 'u' || c_custkey NOT IN (SELECT key FROM held)")
def pushed_records(spark, sf_dir):
    n = F.col("n_nationkey")
    runs = table(spark, sf_dir, "nation").select(n.alias("run_id"), F.when(n % 4 > 0, 1).alias("version"), (n % 3 == 0).alias("paused"))
    ready = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"))
    return delivery.push(ready, base._log(spark, sf_dir), runs).select("run_id", "key", "version")


@query(f"""WITH {HELD_SQL}, la AS (SELECT DISTINCT key FROM now WHERE outcome IN ('accepted', 'duplicate') AND target_id IS NOT NULL AND key IN (SELECT key FROM held))
SELECT count(*) FILTER (ends_with(key, '7') IS FALSE) AS undone, count(*) FILTER (ends_with(key, '7')) AS kept, count(*) > 0 AS paused FROM la""")
def undo_report(spark, sf_dir):
    log = base._log(spark, sf_dir)
    return delivery.undo(log, F.lit("2025-01-01"), log.where(F.col("key").endswith("7")))[1]
