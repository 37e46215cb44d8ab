"""Schemas as people write them, abbreviated headers, and scores as columns."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import scoring
from quernstone.schema import Field, SchemaError, read_schema


def test_own_form_speaks_json_schema():
    s = read_schema({"entity": "x", "fields": {"kind": {"enum": ["A", "B", None]}, "mail": {"type": "string", "format": "email"}, "note": None, "n": " Text ", "when": {"type": "date", "format": "DD/MM/YYYY"}, "day": {"type": "string", "format": "date"}, "grade": {"type": "string", "enum": [1, 2]}}})
    assert [(f.name, f.type, f.allowed, f.format) for f in s.fields] == [
        ("kind", "enum", ["A", "B"], None), ("mail", "email", [], None), ("note", "string", [], None), ("n", "string", [], None), ("when", "date", [], "DD/MM/YYYY"), ("day", "date", [], None), ("grade", "enum", ["1", "2"], None),
    ]
    assert [(f.name, f.type) for f in read_schema({"a": None, "b": " INT "}).fields] == [("a", "string"), ("b", "integer")]


def test_objects_without_a_type():
    s = read_schema({"properties": {"home": {"properties": {"city": {"type": "string", "maxLength": 5}}, "required": ["city"]}, "id": {"type": "string"}}, "required": ["home"]})
    assert [(f.name, f.required, f.max_length) for f in s.fields] == [("home_city", True, 5), ("id", False, None)]


@pytest.mark.parametrize(("bad", "named"), [({"properties": {"a": None}}, "a"), (["a", "b"], "'a'"), ({"a": 3}, "a"), ({"fields": [{"type": "string"}]}, "name"), ({"a": {"type": ["x"]}}, "a"), ({"a": {"enum": "x"}}, "a"), ({"fields": [None]}, "None")])
def test_errors_name_the_field(bad, named):
    with pytest.raises(SchemaError, match=named):
        read_schema(bad)


def test_abbreviations():
    fit = lambda header, name: scoring.abbreviation_fit(scoring.tokens(header), scoring.tokens(name))
    assert fit("dept", "department_cost_code") == 0.72 and fit("mgr", "manager_id") == 0.72 and fit("loc", "location_code") == 0.72
    assert fit("dob", "date_of_birth") == 0.9 and fit("dj", "date_of_joining") == 0.0 and fit("doj", "date_of_joining") == 0.9 and fit("id", "is_deleted") == 0.0
    assert fit("d o b", "date_of_birth") == pytest.approx(0.0) and fit("cost dept", "department_cost_code") == 0.0 and fit("emp_id", "employee_id") == pytest.approx(0.85 * 0.95)
    assert scoring.name_similarity("dept", Field("department_cost_code")) == 0.72


def test_composite_as_a_column(spark):
    rows = [(0.4, 0.9, None, False, None), (None, None, None, False, 0.5), (1.0, 0.0, 0.3, False, 0.7), (1.0, 1.0, 1.0, True, 1.0)]
    got = spark.createDataFrame(rows, "type double, name double, mask double, off boolean, vote double")
    for r in got.withColumn("score", scoring.composite({s: F.col(s) for s in ("type", "name", "mask")}, F.col("off"), F.col("vote"))).collect():
        signals = {s: r[s] for s in ("type", "name", "mask") if r[s] is not None}
        assert r.score == pytest.approx(scoring.Candidate("f", signals, ["type"] if r.off else [], r.vote).score, abs=1.01e-4)  # halves are rounded up here


def test_pattern_or_allowed_value():
    from types import SimpleNamespace

    top = [SimpleNamespace(v=v, n=1) for v in ("A-1", "A-2", "other", "zz")]
    profile = SimpleNamespace(column="code", types={}, top=top, sample=[], masks=[], non_null=4, cardinality_ratio=1.0, date_rate=None)
    fit = lambda **how: scoring.score_pair(profile, Field("code", **how)).signals.get("constraint")
    assert fit(pattern="^A-[0-9]$") == 0.5 and fit(allowed=["Other"]) == 0.25 and fit(pattern="^A-[0-9]$", allowed=["Other"]) == 0.75 and fit() is None
