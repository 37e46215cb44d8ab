"""Single operators on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import cases, cleaning, delivery, matching, profiling, recommend, reports, scoring, validation
from quernstone.plans.queries import set_checkpoints
from quernstone.schema import Field, TargetSchema
from quernstone.sources import files, words

PERSON = TargetSchema("person", [
    Field("id", required=True, unique=True), Field("email", "email", unique=True), Field("first", required=True), Field("last", required=True), Field("born", "date"), Field("phone"),
], blocking=[["id"], ["email"], ["last", "born"], ["phone"]], never_merge_on=[["first", "last"]])
PEOPLE = [
    ("a#1", "E1", "x@y.com", "Ann", "Lee", "1985-03-14", "1"), ("a#2", "E2", None, "Ann", "LEE", "1985-03-14", ""), ("b#1", "e1", None, "Anna", "Lee", None, None),
    ("b#2", None, "X@y.com", "Bo", "Ray", None, None), ("c#1", None, None, "Cy", "Fox", "1990-01-01", "7"), ("c#2", None, None, "Cy", "Fox", "1990-01-01", "7"), ("c#3", None, None, "Di", "Fox", "1990-01-01", "8"),
]


@pytest.fixture(scope="module")
def people(spark):
    set_checkpoints(spark)
    return spark.createDataFrame(PEOPLE, "record_id string, id string, email string, first string, last string, born string, phone string")


def test_pairs_and_decisions(people):
    got = {(r.left_id, r.right_id): r for r in matching.compare_pairs(matching.candidate_pairs(people, PERSON.blocking), people, PERSON).collect()}
    assert got["a#1", "b#1"].decision == "auto_merge" and got["a#1", "b#1"].blocks == "id"  # one identity, ignoring case
    assert got["a#1", "a#2"].decision == "no_match" and got["a#1", "a#2"].unique_conflicted  # same name and birthday, other identity
    assert got["a#1", "b#2"].decision == "auto_merge" and got["c#1", "c#2"].decision == "auto_merge" and got["c#1", "c#2"].score == 1.0
    assert got["c#1", "c#3"].decision == "no_match" and ("c#1", "b#2") not in got


def test_never_merge_on_names_alone(spark):
    rows = [("1", ["first", "last"], 1.0, False, False), ("2", ["first", "last", "born"], 0.95, False, False), ("3", [], 0.0, False, False), ("4", ["first"], 0.8, False, False), ("5", ["id"], 0.1, True, False), ("6", ["id"], 0.8, True, True)]
    df = spark.createDataFrame(rows, "k string, agreed array<string>, score double, unique_agreed boolean, unique_conflicted boolean")
    assert {r.k: r.decision for r in matching.decide_pairs(df, PERSON).collect()} == {"1": "review", "2": "auto_merge", "3": "no_match", "4": "review", "5": "auto_merge", "6": "review"}


def test_fold_and_merge(spark, people):
    pairs = matching.compare_pairs(matching.candidate_pairs(people, PERSON.blocking), people, PERSON)
    folded = matching.reconcile(pairs)
    root = {r.record_id: r.survivor for r in folded.where("case_with is null").collect()}
    assert root["a#1"] == root["b#1"] == root["b#2"] and root["c#1"] == root["c#2"] and "c#3" not in root
    merged = {r.survivor: r for r in matching.merge_records(people, folded, ["id", "email", "first"], ["record_id"]).collect()}
    assert len(merged) == 4 and merged["a#1"].n_rows == 3 and merged["a#1"].first == "Ann"
    human = spark.createDataFrame([("a#1", "b#1", False), ("a#1", "a#2", True)], "left_id string, right_id string, merge boolean")
    kept = {r.record_id: r.survivor for r in matching.reconcile(pairs, human).where("case_with is null").collect()}
    assert kept["b#1"] != kept["a#1"]
    found = {(r.survivor, r.field): r["values"] for r in matching.conflicts(people, folded, ["first", "last"]).collect()}
    assert found["a#1", "first"] == "Ann|Anna|Bo"


def test_delivery_cycle(spark):
    log = spark.createDataFrame([("k1", 1, "uncertain", None, 1, 1), ("k1", 1, "accepted", "t1", 2, 2), ("k2", 1, "rejected", None, 3, 3), ("k3", 1, "accepted", "t3", 4, 4)], "key string, generation int, outcome string, target_id string, at int, seq int")
    assert {r.key for r in delivery.accepted_keys(log).collect()} == {"k1", "k3"} and {r.key for r in delivery.failed_keys(log).collect()} == {"k2"}
    undo = delivery.roll_back(log, F.lit(9))
    assert {(r.key, r.generation, r.target_id) for r in undo.collect()} == {("k1", 2, "t1"), ("k3", 2, "t3")}
    after = log.unionByName(undo.select("key", "generation", "outcome", "target_id", F.col("at").cast("int"), F.col("seq").cast("int")))
    assert delivery.accepted_keys(after).count() == 0
    again = after.unionByName(spark.createDataFrame([("k1", 2, "duplicate", "t9", 20, 20)], log.schema))
    assert {r.key for r in delivery.accepted_keys(again).collect()} == {"k1"} and [r.target_id for r in delivery.latest_accepted(again).collect()] == ["t9"]
    ready = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert [r.key for r in delivery.to_send(ready, again).collect()] == ["k2"]
    key = spark.range(1).select(delivery.idempotency_key(F.lit("run"), F.lit("k"), F.lit(2)).alias("k"), delivery.payload_hash(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("h"), delivery.payload_hash(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))).alias("g")).first()
    assert key.k == "run|k|gen2" and key.h == key.g and len(key.h) == 16


def test_log_table(spark, tmp_path):
    log = spark.createDataFrame([("k", 1, 1, "accepted")], "key string, generation int, seq int, outcome string")
    for _ in range(2):
        delivery.append_attempts(log, str(tmp_path / "log"))
    assert delivery.read_log(spark, str(tmp_path / "log")).count() == 1


def test_words_to_grid(spark):
    rows = [("f", 1, t, x, y, x + 8.0 * len(t), y + 10.0, c) for t, x, y, c in [
        ("Emp", 0, 0, 1.0), ("ID", 28, 1, 1.0), ("Role", 200, 0, 1.0), ("Site", 400, 0, 1.0), ("EMP-00040", 0, 20, 0.9), ("Staff", 200, 21, 0.7), ("Engineer", 244, 20, 0.95), ("BLR", 400, 20, 1.0), ("EMP-00041", 0, 40, 1.0), ("DEL", 402, 40, 1.0),
    ]]
    w = spark.createDataFrame([tuple(float(v) if i in (3, 4, 5, 6) else v for i, v in enumerate(r)) for r in rows], "file string, page int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = {(r.line, r.column): r for r in words.grid(words.cells(words.lines(w))).collect()}
    assert got[0, 0].text == "Emp ID" and got[1, 1].text == "Staff Engineer" and got[1, 1].confidence == 0.7
    assert got[2, 2].text == "DEL" and (2, 1) not in got
    assert [r.text for r in words.unsure_cells(words.grid(words.cells(words.lines(w)))).collect()] == ["Staff Engineer"]
    assert words.gap_threshold([4, 5, 100]) == 90 and words.gap_threshold([4]) == 2 and words.gap_threshold([]) == 0


def test_recorded_pages(spark, tmp_path):
    def word(text, x, y, sure=None):
        return {"text": text, "x0": x, "y0": y, "x1": x + 8 * len(text), "y1": y + 10} | ({} if sure is None else {"confidence": sure})

    def line(y, *texts):
        return [word(t, x, y) for t, x in zip(texts, (0, 200, 400)) if t]

    first = [word("Staff", 0, 0), *line(20, "Code", "Role", "Site"), *line(40, "E1", "Clerk", "BLR"), word("E2", 0, 60, 0.4), *line(60, None, "Cook", "DEL"), *line(80, "E3", "Guard", None)]
    second = [*line(0, "Code", "Role", "Site"), *line(20, "E4", "Clerk", "GOI"), word(" ", 5, 50)]
    (tmp_path / "a.ocr.json").write_text(json.dumps([{"page": 1, "words": first}, {"page": 2, "words": second}]))
    (tmp_path / "b.ocr.json").write_text("[]")
    made = words.grid(words.cells(words.lines(words.read_recorded(spark, [str(tmp_path)]))))
    got = {r["values"]["Code"]: r for r in words.records(words.table_rows(made)).collect()}
    assert {k: r["values"] for k, r in got.items()} == {
        "E1": {"Code": "E1", "Role": "Clerk", "Site": "BLR"}, "E2": {"Code": "E2", "Role": "Cook", "Site": "DEL"}, "E3": {"Code": "E3", "Role": "Guard"}, "E4": {"Code": "E4", "Role": "Clerk", "Site": "GOI"},
    }
    assert got["E2"].confidence == {"Code": 0.4, "Role": 1.0, "Site": 1.0} and got["E4"].page == 2
    as_read = {r.record_id: r for r in words.as_records(words.table_rows(made)).collect()}
    assert sorted(as_read) == [f"a.ocr.json##{i}" for i in (1, 2, 3, 4)] and all(r.col_order == ["Code", "Role", "Site"] for r in as_read.values())
    assert (as_read["a.ocr.json##2"].cells["Role"], as_read["a.ocr.json##2"].confidence["Code"], as_read["a.ocr.json##4"].path) == ("Cook", 0.4, "page 2")
    assert {f.name for f in words.as_records(words.table_rows(made)).schema} - {"confidence"} == {c.split()[0] for c in files.RECORDS.split(", ")}


def test_large_blocks_lose_no_pair(spark):
    rows = [(f"r{i:02}", "x" if i < 30 else "y" if i < 33 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, k string")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and x == y}
    got = [(r.left_id, r.right_id) for r in matching.candidate_pairs(df, [["k"]], block_rows=4).collect()]
    assert len(got) == len(want) and set(got) == want


def test_value_cases_group(spark):
    rows = [("f", "c", "d", "date", f"0{i}/05/2020", "ambiguous date", ["x", "y"], f"r{i}", 1.0) for i in range(1, 4)] + [("f", "e", "k", "enum", "FTE", "not an allowed value", ["A"], f"r{i}", 1.0) for i in range(2)] + [("f", "m", "n", "integer", "x", "not a integer", [], "r9", 0.5)]
    df = spark.createDataFrame(rows, "file string, column string, field string, type string, raw string, unsafe string, alternatives array<string>, record_id string, confidence double")
    got = {(r["class"], r.field): (r.blocks, r.headline) for r in cases.numbered(cases.value_cases(df)).collect()}
    assert got == {("AMBIGUOUS_VALUE", "d"): (3, "ambiguous date"), ("AMBIGUOUS_VALUE", "k"): (2, "not an allowed value: FTE"), ("LOW_CONFIDENCE_EXTRACTION", "n"): (1, "not a integer: x")}


def test_dependents(spark):
    set_checkpoints(spark)
    rows = [("a", None, "blocked"), ("b", "a", "ready"), ("c", "b", "ready"), ("d", "e", "ready"), ("e", "d", "ready"), ("f", "x", "ready"), ("g", "h", "ready"), ("h", None, "excluded")]
    df = spark.createDataFrame(rows, "id string, parent string, state string")
    assert {(r.id, r.root) for r in validation.hold_dependents(df, "parent", "id").collect()} == {("b", "a"), ("c", "a")}


def test_long_chains_of_dependents(spark):
    import random

    set_checkpoints(spark)
    rng = random.Random(6)
    parents = {i: i - 1 if i < 60 else rng.randrange(400) for i in range(1, 300)}
    states = {i: "ready" if i < 59 else rng.choices(["ready", "blocked", "excluded"], [12, 1, 1])[0] for i in range(1, 300)} | {0: "blocked"}
    want = set()
    for i in range(300):
        at, seen = i, set()
        while states.get(at) == "ready" and at not in seen:
            seen.add(at)
            at = parents[at]
        if states[i] == "ready" and states.get(at) == "blocked":
            want.add((i, at))
    df = spark.createDataFrame([(i, parents.get(i), states[i]) for i in range(300)], "id int, parent int, state string")
    assert {(r.id, r.root) for r in validation.hold_dependents(df, "parent", "id").collect()} == want and (58, 0) in want


def test_uniqueness(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["A", "a", "b", "", None, "A", "a", "a"])], "record_id int, v string")
    got = {r.record_id: r.others for r in validation.uniqueness_issues(df, Field("v")).collect()}
    assert got == {0: "1,5,6", 1: "0,5,6", 5: "0,1,6", 6: "0,1,5", 7: "0,1,5"}
    assert {r.record_id for r in validation.uniqueness_issues(df, Field("v", case_sensitive=True)).collect()} == {0, 5, 1, 6, 7}


def test_authority(spark):
    df = spark.createDataFrame([("e", "f", "b", "1"), ("e", "f", "a", "2"), ("g", "f", "x", "3"), ("h", "f", "x", "4"), ("h", "f", "b", "5")], "entity string, field string, file string, value string")
    assert {r.entity: r.value for r in matching.prefer(df, ["a", "b"]).collect()} == {"e": "2", "g": None, "h": "5"}


def test_date_plans(spark):
    def plan(values):
        cells = profiling.to_cells(spark.createDataFrame(list(enumerate(values)), "id int, d string"), "f", F.col("id"), ["d"])
        return cleaning.plan_column(profiling.profile_columns(cells).first(), Field("d", "date"))

    assert plan(["13/02/2020", "01/03/2020"]).date_format == "%d/%m/%Y"
    assert plan(["01/02/2020", "03/04/2020"]).ambiguous == ["%d/%m/%Y", "%m/%d/%Y"]
    assert plan(["2020-02-01"]).date_format == "%Y-%m-%d" and plan(["x"]).date_format is None


def test_pasted_and_structured(spark):
    got = files.read_pasted(spark, "name\tcode\n\nA\t1\nB\n").collect()
    assert [r.cells for r in got] == [{"name": "A", "code": "1"}, {"name": "B", "code": None}]
    with pytest.raises(files.UnsupportedInput):
        files.read_pasted(spark, "one line")
    assert files.find_records({"meta": {}, "people": [{"a": 1}]})[0] == "$.people" and files.find_records({"a": 1}) == ("$", [{"a": 1}])
    assert files.flatten({"a": {"b": [1, None]}, "c": [{"d": 1}], "e": True}) == {"a.b": "1, ", "e": "True"}
    rows = list(files.read_csv(b"\xef\xbb\xbfEmail,,Email\na,b,c,d\n,,\nx\n"))
    assert [(r[1], r[3]) for r in rows] == [(1, {"Email": "c", "column_2": "b"}), (3, {"Email": None, "column_2": None})]
    assert files.sniff("a.csv", b"") == "empty" and files.sniff("a.txt", b" [1]") == "json" and files.sniff("a.yml", b"a: 1") == "yaml" and files.sniff("x", b"%PDF-") == "pdf" and files.lookup_name("classes.csv") == "classe"


def test_proposed_schema(spark):
    rows = [(i, f"EMP-{i:05d}", f"p{i}@x.com", "ENG" if i % 2 else "OPS", "2024-01-01") for i in range(20)]
    cells = profiling.to_cells(spark.createDataFrame(rows, "n int, emp_id string, mail string, dept string, last_sync_ts string"), "f", F.col("n"), ["emp_id", "mail", "dept", "last_sync_ts"])
    profiles = sorted(profiling.profile_columns(cells).collect(), key=lambda p: p.col_pos)
    s = recommend.propose_schema(profiles, {"department": {"ENG", "OPS"}})
    got = {f.name: f for f in s.fields}
    assert list(got) == ["emp_id", "mail", "dept"] and got["emp_id"].unique and got["emp_id"].pattern == r"^[A-Z]{3}\-[0-9]{5}$" and got["mail"].type == "email" and got["dept"].reference == "department.code"
    assert recommend.model_view(profiles[0])["unique"] == 1.0 and s.identity == "emp_id"
    best = scoring.rank_column(profiles[0], TargetSchema("e", [Field("employee_id", unique=True, pattern=r"^EMP-[0-9]{5}$", aliases=["emp_id"]), Field("phone")]))
    assert best.chosen == "employee_id" and best.reasons()


def test_snapshots(spark):
    saved = spark.createDataFrame([("r", "f1", 1, "old"), ("r", "f2", 2, "new"), ("q", "f9", 1, "x")], "run_id string, fingerprint string, at int, payload string")
    now = spark.createDataFrame([("r", "f1"), ("q", "f0")], "run_id string, fingerprint string")
    assert [tuple(r) for r in reports.snapshot(saved, now).collect()] == [("r", "old")]
    assert spark.range(1).select(reports.run_name(F.lit("  a \t b ")).alias("n")).first().n == "a b"


def test_retries(spark):
    set_checkpoints(spark)
    ready = spark.createDataFrame([(k, {"id": k}) for k in ("ok", "slow", "lost", "dead")], "key string, payload map<string,string>")
    held: set[str] = set()

    def table(records, attempt):
        held.update(r.key for r in records.select("key").collect())
        return records.withColumn("outcome", F.lit("accepted"))

    send = delivery.rehearse(table, {"slow": ("transient", 1), "lost": ("uncertain", 1), "dead": ("transient", 9)})
    log = delivery.deliver(ready, send, lambda records: records.where(F.col("key").isin(*held)), backoff=())
    got = sorted((r.key, r.attempt, r.outcome) for r in log.collect())
    assert got == [("dead", 1, "transient"), ("dead", 2, "transient"), ("dead", 3, "transient"), ("lost", 1, "duplicate"), ("ok", 1, "accepted"), ("slow", 1, "transient"), ("slow", 2, "accepted")]


def test_destination(spark):
    rules = PERSON.destination_rules() | {"required": ["id", "first"], "allowed": {"kind": ["a"]}, "patterns": {"id": "E[0-9]"}}
    rows = [("k1", {"id": "E1", "first": "x"}, 1), ("k1", {"id": "E1", "first": "x"}, 2), ("k1", {"id": "E2", "first": "x"}, 3), ("k2", {"id": "X", "first": "x"}, 4), ("k3", {"id": "E1"}, 5), ("k4", {"id": "E1", "first": "x", "kind": "b"}, 6), ("old", {"id": "E1", "first": "x"}, 7)]
    incoming = spark.createDataFrame([(k, p, s, 1) for k, p, s in rows], "idempotency_key string, payload map<string,string>, seq int, version int")
    stored = incoming.where("seq = 7").select("idempotency_key", delivery.payload_hash(F.col("payload")).alias("hash"))
    versions = spark.createDataFrame([(1,)], "version int")
    assert {r.seq: r.outcome for r in delivery.accept(incoming, stored, versions, rules).collect()} == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "rejected", 5: "rejected", 6: "rejected", 7: "duplicate"}
    registered = spark.createDataFrame([("r", 1, "own", 1), ("q", 1, "other", 2), ("q", 2, "two", 3)], "run_id string, version int, rules string, at int")
    assert {(r.run_id, r.version): r.rules for r in delivery.known_rules(registered).collect()} == {("r", 1): "own", ("r", 2): "two", ("q", 1): "other", ("q", 2): "two"}
    held = spark.createDataFrame([("1", "r", "k", "accepted", 2), ("2", "r", "k", "rolled_back", 1)], "record_id string, run_id string, natural_key string, state string, received_at int")
    assert [r.record_id for r in delivery.list_records(held, "r").collect()] == ["1"] and [r.record_id for r in delivery.list_records(held, "r", "k", True).collect()] == ["2", "1"]


def test_decisions_and_suggestions(spark):
    with pytest.raises(cases.RefusedDecision):
        cases.check_decision({"case_key": "c"}, "approve")
    assert cases.check_decision({"case_key": "c"}, "approve", None, "x") == "x" and cases.check_decision({"case_key": "c"}, "set", "y") == "y"
    checked = spark.createDataFrame([("a", 3, 3), ("b", 3, 0)], "format string, rows int, agree int")
    assert {r.format: r.recommended for r in cases.recommended_reading(checked).collect()} == {"a": True, "b": False}
    split = spark.createDataFrame([("a", 3, 2), ("b", 3, 1)], "format string, rows int, agree int")
    assert not any(r.recommended for r in cases.recommended_reading(split).collect())
    df = spark.createDataFrame([("c", ["m"]), ("d", None)], "case_key string, options array<string>")
    more = spark.createDataFrame([("c", "m"), ("c", "z"), ("d", "q")], "case_key string, value string")
    assert {r.case_key: r.options for r in cases.enrich(df, more).collect()} == {"c": ["m", "z"], "d": ["q"]}
    scoring.assert_votes_cannot_decide([scoring.Candidate("f", {}, [], 1.0)])


def test_components_forget_and_draw_together(spark):
    """Chains of which a task holds only some nodes, a loop of one node and an edge without an end, against a walk of the graph."""
    set_checkpoints(spark)
    edges = [(str(i * 7919 % 300), str((i + 1) * 7919 % 300)) for i in range(300) if i % 37] + [("loop", "loop"), ("loop", None)]
    df = spark.createDataFrame(edges, "left_id string, right_id string")
    got = [{r.id: r.comp for r in matching.components(df, held).collect()} for held in (0, 200_000)]
    near = {}
    for a, b in edges:
        if b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        ahead = [start] if start not in want else []
        while ahead:
            x = ahead.pop()
            if x not in want:
                want[x] = start
                ahead += near[x]
    assert got == [want, want]
    assert matching.components(spark.createDataFrame([], "left_id string, right_id string")).count() == 0


def test_run_names_and_deletion(spark):
    runs = spark.createDataFrame([("r1", "Payroll", 1), ("r2", "Staff", 2), ("r3", None, 3), ("r4", "Old", 4)], "run_id string, name string, at int")
    names = spark.createDataFrame([("r1", " Payroll\t 2024 "), ("r2", "  "), ("r3", "x" * 121), ("r4", "Old"), ("gone", "z")], "run_id string, name string")
    renamed, log = reports.rename_runs(runs, names)
    assert renamed.columns == runs.columns and {(r.run_id, r.name) for r in renamed.collect()} == {("r1", "Payroll 2024"), ("r2", "Staff"), ("r3", None), ("r4", "Old")}
    assert [(r.run_id, r.before, r.after) for r in log.collect()] == [("r1", "Payroll", "Payroll 2024")]
    left = reports.without_runs(runs, spark.createDataFrame([("r2",), ("r2",), ("none",)], "run_id string"))
    assert {r.run_id for r in left.collect()} == {"r1", "r3", "r4"}
