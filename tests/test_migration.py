"""The migration run from files to cases, on exports with planted faults."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quernstone.operators import cleaning, scoring
from quernstone.operators.cases import Overrides, apply_decision
from quernstone.plans import migrate
from quernstone.operators.matching import cross_check
from quernstone.plans.queries import set_checkpoints
from quernstone.schema import Field, SchemaError, TargetSchema, read_schema
from quernstone.sources import files

SCHEMA = {
    "entity": "employee", "blocking": [["employee_id"], ["work_email"], ["last_name", "date_of_birth"]], "never_merge_on": [["first_name", "last_name"]],
    "lookups": {"department": ["code", "name"]},
    "fields": {
        "employee_id": {"required": True, "unique": True, "pattern": r"^EMP-[0-9]{5}$", "case_sensitive": True, "aliases": ["emp_id", "staff_code"]},
        "first_name": {"required": True, "aliases": ["fname", "given_name"]}, "last_name": {"required": True, "aliases": ["lname", "surname"]},
        "work_email": {"type": "email", "required": True, "unique": True, "aliases": ["email"]}, "date_of_birth": {"type": "date", "aliases": ["dob"]},
        "department_code": {"required": True, "reference": "department.code", "aliases": ["dept"]}, "manager_employee_id": {"reference": "employee.employee_id", "aliases": ["manager id"]},
        "employment_type": {"type": "enum", "allowed": ["FULL_TIME", "PART_TIME", "INTERN"]},
    },
}
HEAD = "Emp ID,First Name,Last Name,Email,DOB,Dept Code,Manager ID,Employment Type\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    rows = [f"EMP-{i:05d},First{i},Last{i},p{i}@Acme.Example,{i % 12 + 13:02d}/{i % 9 + 1:02d}/1990,{'ENG' if i % 2 else 'OPS'},{'EMP-00001' if i > 1 else ''},{'Full Time' if i % 3 else 'intern'}" for i in range(1, 16)]
    rows[3] = rows[3].replace("ENG", "XXX").replace("OPS", "XXX")
    rows[4] = rows[4].replace("Full Time", "FTE").replace("intern", "FTE")
    rows[6] = rows[6].replace(",EMP-00001,", ",EMP-00004,")
    (d / "staff.csv").write_text(HEAD + "\n".join(rows) + "\n,,,,,,,\n")
    people = [{"staff_code": f"EMP-{i:05d}", "name": {"fname": f"First{i}", "lname": f"Last{i}"}, "email": f"p{i}@acme.example", "tags": ["a", "b"]} for i in (2, 3)]
    (d / "more.json").write_text(json.dumps({"meta": 1, "employees": people}))
    (d / "departments.csv").write_text("code,name\nENG,Engineering\nOPS,Operations\n")
    return d


@pytest.fixture(scope="module")
def result(spark, folder):
    set_checkpoints(spark)
    records = files.read_records(spark, [str(folder)]).cache()
    lookups = files.load_lookups(records)
    return records.where("file = 'staff.csv'"), lookups, migrate.run(records.where("file = 'staff.csv'"), lookups, read_schema(SCHEMA))


def test_reading(spark, folder):
    report = {r.file: r for r in files.file_report(spark, [str(folder)]).collect()}
    assert (report["staff.csv"].kind, report["staff.csv"].rows, report["more.json"].kind, report["more.json"].rows) == ("csv", 15, "json", 2)
    got = {r.record_id: r for r in files.read_records(spark, [str(folder)]).collect()}
    assert got["more.json##1"].cells["name.fname"] == "First2" and got["more.json##1"].cells["tags"] == "a, b" and got["more.json##2"].path == "$.employees[1]"
    assert {(r.name, r.code) for r in files.load_lookups(files.read_records(spark, [str(folder)])).collect()} == {("department", "ENG"), ("department", "OPS")}


def test_run(result):
    _, _, r = result
    chosen = {m.column: m.chosen for m in r.mappings}
    assert chosen["Emp ID"] == "employee_id" and chosen["Email"] == "work_email" and chosen["DOB"] == "date_of_birth" and chosen["Dept Code"] == "department_code"
    built = {x.record_id: x for x in r.built.collect()}
    first = built["staff.csv##1"]
    assert first.work_email.value == "p1@acme.example" and [s.rule for s in first.work_email.steps] == ["email_domain_lowercase"]
    assert first.date_of_birth.value == "1990-02-14" and first.employment_type.value == "FULL_TIME"
    states = {x.employee_id: x.state for x in r.entities.collect()}
    assert states["EMP-00004"] == "blocked" and states["EMP-00005"] == "blocked" and states["EMP-00006"] == "ready"
    assert states["EMP-00007"] == "blocked"  # its manager waits
    kinds = {(c["class"], c.field) for c in r.cases.collect()}
    assert ("UNRESOLVED_REFERENCE", "department_code") in kinds and ("AMBIGUOUS_VALUE", "employment_type") in kinds


def test_answers_replay(result):
    records, lookups, r = result
    case = next(c.asDict() for c in r.cases.collect() if c["class"] == "AMBIGUOUS_VALUE")
    assert case["options"] == ["FULL_TIME", "PART_TIME", "INTERN"] and case["headline"].endswith("FTE")
    again, left = migrate.replay(records, lookups, read_schema(SCHEMA), [{"case_key": case["case_key"], "action": "set", "value": "FULL_TIME"}, {"case_key": "gone", "action": "set"}])
    assert [d["case_key"] for d in left] == ["gone"]
    assert {x.employee_id: x.state for x in again.entities.collect()}["EMP-00005"] == "ready"


def test_no_model_can_decide_alone():
    assert scoring.Candidate("f", {}, [], vote=1.0).score <= scoring.VOTE_SHARE < scoring.FLOOR
    assert scoring.Candidate("f", {"name": 1.0}, ["type"], vote=1.0).score == 0.0


def test_names():
    dob = Field("date_of_birth")
    assert scoring.name_similarity("dob", dob) == 0.9 and scoring.name_similarity("date_of_birth", dob) == 1.0
    assert scoring.name_similarity("id", Field("is_deleted")) < 0.5 and scoring.is_contraction("dept", "department") and not scoring.is_contraction("x", "xylem")


def test_cleaning(spark):
    rows = [(1, " a\t"), (2, "N/A"), (3, "?"), (4, "x  y"), (5, "1,234"), (6, "é"), (7, None), (8, "A@B@C.D"), (9, ""), (10, "05/05/2020"), (11, "05/06/2020")]
    df = spark.createDataFrame(rows, "id int, v string")
    got = {r.id: r.c for r in df.select("id", cleaning.clean(F.col("v"), Field("f")).alias("c")).collect()}
    assert [got[i].value for i in (1, 2, 3, 4, 6, 7, 9)] == ["a", None, None, "x y", "é", None, None]
    assert [s.rule for s in got[6].steps] == ["unicode_nfc"] and [s.rule for s in got[2].steps] == ["null_marker"]
    numbers = {r.id: r.c for r in df.select("id", cleaning.clean(F.col("v"), Field("f", "integer")).alias("c")).collect()}
    assert numbers[5].value == "1234" and numbers[1].unsafe and numbers[2].unsafe is None
    torn = {r.id: r.c for r in df.select("id", cleaning.clean(F.col("v"), Field("f", "date"), cleaning.ColumnPlan(None, ["%d/%m/%Y", "%m/%d/%Y"])).alias("c")).collect()}
    assert torn[11].alternatives == ["2020-05-06", "2020-06-05"] and torn[11].value is None and torn[10].unsafe == "not a date"


def test_cross_check(spark):
    waiting = spark.createDataFrame([(1, "05/07/2018"), (2, "02/09/2019"), (3, "08/11/2021")], "entity int, value string")
    known = spark.createDataFrame([(1, "2018-07-05"), (2, "2019-09-02"), (3, "2021-11-08")], "entity int, known string")
    got = {r.format: (r.rows, r.agree) for r in cross_check(waiting, known, ["%d/%m/%Y", "%m/%d/%Y"]).collect()}
    assert got == {"%d/%m/%Y": (3, 3), "%m/%d/%Y": (3, 0)}
    assert cross_check(waiting, known.limit(0), ["%d/%m/%Y", "%m/%d/%Y"]).count() == 0


def test_schemas():
    s = read_schema({"title": "Staff Member", "type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "mail": {"type": ["string", "null"], "format": "email"}, "home": {"type": "object", "properties": {"city": {"type": "string", "maxLength": 5}}}, "kind": {"$ref": "#/$defs/k"}}, "$defs": {"k": {"enum": ["a", "b"]}}})
    assert s.entity == "staff_member" and [(f.name, f.type) for f in s.fields] == [("id", "integer"), ("mail", "email"), ("home_city", "string"), ("kind", "enum")]
    back = read_schema(s.to_json_schema())
    assert [(f.name, f.type, f.required, f.max_length, f.allowed) for f in back.fields] == [(f.name, f.type, f.required, f.max_length, f.allowed) for f in s.fields]
    assert read_schema({"joined": {"type": "date", "format": "DD/MM/YYYY"}, "n": "varchar"}).fields[0].date_format == "%d/%m/%Y"
    for bad in ({"properties": {"x": {"type": "array"}}}, {"x": {"type": "enum"}}, {"x": {"reference": "nodot"}}, {"x": {"pattern": "("}}, []):
        with pytest.raises((SchemaError, IndexError)):
            read_schema(bad).identity


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Staff" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><t>when</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>3.0</v></c><c r="B3" s="1"><v>43831</v></c></row></sheetData></worksheet>')
    got = files.read_records(spark, [str(tmp_path / "b.xlsx")]).collect()
    assert [(r.record_id, r.cells) for r in got] == [("b.xlsx#Staff#2", {"code": "3", "when": "2020-01-01"})]


def test_decisions():
    o = apply_decision(Overrides(), {"class": "UNCERTAIN_IDENTITY", "record_key": "b", "headline": "a"}, "set", "merge")
    assert o.identity == {("a", "b"): True}
    assert apply_decision(o, {"class": "MISSING_REQUIRED", "record_key": "r", "field": "f", "headline": ""}, "reject").excluded == {"r"}


PAIR = {"entity": "employee", "blocking": [["employee_id"]], "fields": {"employee_id": {"required": True, "unique": True, "case_sensitive": True}, "city": {}, "joined": {"type": "date"}}}


@pytest.fixture(scope="module")
def two_files(spark, tmp_path_factory):
    """Two exports of the same people: cities differ for some; one writes dates by day first, which only the other shows."""
    set_checkpoints(spark)
    d = tmp_path_factory.mktemp("two")
    (d / "hr.csv").write_text("Employee ID,City,Joined\n" + "".join(f"E{i:03d},{'Bonn' if i < 3 else 'Ulm'},2020-{i % 9 + 1:02d}-{i % 12 + 1:02d}\n" for i in range(1, 13)))
    (d / "payroll.csv").write_text("Employee ID,City,Joined\n" + "".join(f"E{i:03d},{'Kiel' if i < 3 else 'Ulm'},{i % 12 + 1:02d}/{i % 9 + 1:02d}/2020\n" for i in range(1, 13)))
    return files.read_records(spark, [str(d)]).cache()


def _state(result, key):
    return next((r.city, r.state) for r in result.entities.collect() if r.employee_id == key)


def test_answers_about_two_files(spark, two_files):
    schema, none = read_schema(PAIR), files.load_lookups(two_files)
    run = migrate.run(two_files, none, schema)
    cases = {(c["class"], c.field, c.record_key): c.asDict() for c in run.cases.collect()}
    dates = next(c for (kind, field, _), c in cases.items() if kind == "AMBIGUOUS_VALUE" and field == "joined")
    assert (dates["file"], dates["recommended"]) == ("payroll.csv", "%d/%m/%Y")
    torn = {c["record_key"]: c for (kind, field, _), c in cases.items() if kind == "CONFLICTING_FACTS" and field == "city"}
    assert len(torn) == 2 and all("Bonn" not in c["case_key"] for c in torn.values()) and _state(run, "E001")[1] == "blocked"
    approve = {"case_key": dates["case_key"], "action": "approve"}
    one = next(c for c in torn.values() if c["record_key"].endswith("1"))
    # the survivor's own value is an answer too
    settled, left = migrate.replay(two_files, none, schema, [approve, {"case_key": one["case_key"], "action": "set", "value": "Bonn"}])
    assert not left and _state(settled, "E001") == ("Bonn", "ready") and _state(settled, "E002")[1] == "blocked" and _state(settled, "E005") == ("Ulm", "ready")
    settled, left = migrate.replay(two_files, none, schema, [approve, {"case_key": one["case_key"], "action": "prefer_file", "value": "payroll.csv"}])
    assert not left and _state(settled, "E001") == ("Kiel", "ready") and _state(settled, "E002") == ("Kiel", "ready")
    _, left = migrate.replay(two_files, none, schema, [{"case_key": one["case_key"], "action": "approve"}])
    assert len(left) == 1 and "nothing is recommended" in left[0]["refused"]


def test_identity_answers_about_roots(spark):
    from quernstone.operators import matching

    set_checkpoints(spark)
    pairs = spark.createDataFrame([("a", "b", 0.95, "auto_merge", "id"), ("b", "c", 0.8, "review", "id")], "left_id string, right_id string, score double, decision string, blocks string")
    case = next(r for r in matching.reconcile(pairs).collect() if r.case_with)
    assert (case.record_id, case.case_with) == ("a", "c")
    human = lambda m: spark.createDataFrame([("a", "c", m)], "left_id string, right_id string, merge boolean")
    assert {(r.record_id, r.survivor, r.case_with) for r in matching.reconcile(pairs, human(True)).collect()} == {(x, "a", None) for x in "abc"}
    assert {(r.record_id, r.survivor, r.case_with) for r in matching.reconcile(pairs, human(False)).collect()} == {("a", "a", None), ("b", "a", None), ("c", "c", None)}


def test_schema_errors():
    base = {"type": "object", "properties": {"x": {"type": "string"}}}
    for bad in ({"$ref": "#/$defs/none"}, {"anyOf": [{"type": "string"}, {"type": "integer"}]}, {"type": ["string", "integer"]}):
        with pytest.raises(SchemaError):
            read_schema({**base, "properties": {"x": bad}})
    s = read_schema({"type": "object", "properties": {"id": {"type": "string", "unique": True, "aliases": ["key"], "reference": "record.id", "case_sensitive": True}, "home": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}}}}})
    assert (s["id"].unique, s["id"].aliases, s["id"].reference, s["id"].case_sensitive, s["home_city"].required) == (True, ["key"], "record.id", True, False)


def test_wrappers_and_lookups(spark, folder):
    assert files.find_records({"items": [1, 2], "people": [{"a": 1}, {"a": 2}]}) == ("$.people", [{"a": 1}, {"a": 2}])
    sources, lookups = files.split_records(files.read_records(spark, [str(folder)]))
    assert {r.file for r in sources.collect()} == {"staff.csv", "more.json"} and {r.code for r in lookups.collect()} == {"ENG", "OPS"}
    assert {(r.code, r.column, r.value) for r in files.lookup_columns(files.read_records(spark, [str(folder)])).collect()} == {("ENG", "name", "Engineering"), ("OPS", "name", "Operations")}


def test_unsure_readings_provenance_and_audit(spark):
    """A page's records beside a file's: what can't be cleaned and was read unsurely is its own kind of question; sources and the log name rows."""
    set_checkpoints(spark)
    head = ["Employee ID", "City", "Grade"]
    schema = read_schema({"entity": "employee", "blocking": [["employee_id"]], "fields": {"employee_id": {"required": True, "unique": True, "case_sensitive": True}, "city": {}, "grade": {"type": "enum", "allowed": ["JUNIOR", "SENIOR"]}}})
    cells = lambda i, city, grade: dict(zip(head, (f"E{i:03d}", city, grade)))
    filed = [(f"hr.csv##{i}", "hr.csv", None, i, None, cells(i, None if i == 1 else "Bonn", "junior" if i != 3 else "Princ1pal"), head) for i in range(1, 8)]
    read = [(f"scan##{i}", "scan", None, i, "page 1", cells(j, " Kiel ", grade), head, {"Employee ID": 1.0, "City": 0.5, "Grade": sure}) for i, (j, grade, sure) in enumerate([(1, "Junior", 0.4), (11, "Seni0r", 0.4), (12, "Sen10r", 0.9), (13, "senior", 1.0)], 1)]
    base = "record_id string, file string, sheet string, row int, path string, cells map<string,string>, col_order array<string>"
    records = spark.createDataFrame(filed, base).unionByName(spark.createDataFrame(read, base + ", confidence map<string,double>"), allowMissingColumns=True)
    result = migrate.run(records, files.load_lookups(records), schema)
    kinds = {(c["class"], c.file, c.record_key) for c in result.cases.collect() if c.field == "grade" and c.column}
    assert kinds == {("AMBIGUOUS_VALUE", "hr.csv", None), ("LOW_CONFIDENCE_EXTRACTION", "scan", "scan##2"), ("AMBIGUOUS_VALUE", "scan", None)}
    gave = {(r.survivor, r.field): (r.source.record_id, r.source.file, r.source.row) for r in result.sources.collect()}
    assert gave["hr.csv##1", "city"] == ("scan##1", "scan", 1) and gave["hr.csv##1", "grade"] == ("hr.csv##1", "hr.csv", 1) and ("hr.csv##3", "grade") not in gave
    log = migrate.audit(result, "run-1").collect()
    assert len({r.id for r in log}) == len(log) and {r.id for r in log} == {r.id for r in migrate.audit(migrate.run(records, files.load_lookups(records), schema), "run-1").collect()}
    assert [(r.record_id, r.summary) for r in log if r.action == "records.merged"] == [("scan##1", "same entity as hr.csv##1")]
    trimmed = [r for r in log if r.action == "cleanup.applied" and r.field == "city"]
    assert {(r.before, r.after) for r in trimmed} == {(" Kiel ", "Kiel")} and len(trimmed) == 4
    assert sum(r.action == "escalation.raised" for r in log) == result.cases.count() and sum(r.action == "mapping.auto_applied" for r in log) == 6
    answer = next(c.case_key for c in result.cases.collect() if c["class"] == "LOW_CONFIDENCE_EXTRACTION")
    settled, left = migrate.replay(records, files.load_lookups(records), schema, [{"case_key": answer, "action": "set", "value": "SENIOR"}])
    assert not left and {r.employee_id: r.state for r in settled.entities.collect()}["E011"] == "ready"
