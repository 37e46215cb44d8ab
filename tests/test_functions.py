"""Column expressions against plain Python, on generated text."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import profiling, scoring
from quernstone.operators.recommend import offer_aliases
from quernstone.schema import Field, TargetSchema

ALPHABET = st.sampled_from(list("abzABZ019 \t\n -_.@#/,+éÉßñ日²()"))
TEXTS = st.lists(st.text(ALPHABET, max_size=14), min_size=1, max_size=40)


def python_mask(value):
    shape = "".join("#" if unicodedata.category(c) == "Nd" else "A" if unicodedata.category(c) == "Lu" else "a" if c.isalpha() else "_" if c.isspace() else c for c in value)
    return "".join(m[1] + (f"{{{len(m[0])}}}" if len(m[0]) > 1 else "") for m in re.finditer(r"(.)\1*", shape, re.S))


@settings(max_examples=12, deadline=None)
@given(TEXTS)
def test_expressions(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    v = F.col("v")
    got = df.select("i", X.mask(v).alias("mask"), X.ws_trim(v).alias("trim"), X.collapse_ws(v).alias("collapse"), X.alnum_key(v).alias("key"), X.email_domain_lower(v).alias("mail"), X.nfc(v).alias("nfc"), X.prefix_match(v, "[a-z]+[0-9]").alias("prefix"), X.is_null_marker(v).alias("marker")).orderBy("i").collect()
    for r, value in zip(got, values):
        assert r.mask == python_mask(value)
        assert r.trim == value.strip() and r.collapse == re.sub(r"\s{2,}", " ", value)
        assert r.key == re.sub(r"[^a-z0-9]+", "", value.lower())
        head, at, tail = value.partition("@")
        assert r.mail == head + at + (tail.lower() if at else "")
        assert r.nfc == unicodedata.normalize("NFC", value) and r.prefix == bool(re.match("[a-z]+[0-9]", value))
        assert r.marker == (value.strip().lower() in X.NULL_MARKERS)


def test_dates(spark):
    cases = [("2024-1-5", "%Y-%m-%d", "2024-01-05"), ("31/02/2024", "%d/%m/%Y", None), ("05/06/2020", "%m/%d/%Y", "2020-05-06"), ("5 Jan 2024", "%d %b %Y", "2024-01-05"), ("Jan 5, 2024", "%b %d, %Y", "2024-01-05"), ("0000-00-00", "%Y-%m-%d", None), ("", "%Y-%m-%d", None)]
    for value, fmt, want in cases:
        row = spark.createDataFrame([(value,)], "v string").select(X.render_date(X.read_date(F.col("v"), fmt)).alias("d")).first()
        assert row.d == want, (value, fmt)


def test_profile(spark):
    rows = [(i, v) for i, v in enumerate(["EMP-1", "EMP-2", " EMP-3 ", "n/a", None, "EMP-1", "?", "x@y.com"])]
    cells = profiling.to_cells(spark.createDataFrame(rows, "id int, code string"), "f", F.col("id"), ["code"])
    p = profiling.profile_columns(cells).first()
    assert (p.total, p.non_null, p.null_count, p["distinct"], p.null_markers) == (8, 5, 3, 4, "?,n/a")
    assert p.top[0].v == "EMP-1" and p.top[0].n == 2 and p.types == {"email": 0.2, "string": 1.0} and p.masks[0].mask == "A{3}-#"
    assert profiling.mask_regex("A{3}-#{5}") == r"^[A-Z]{3}\-[0-9]{5}$" and profiling.mask_regex("---") is None
    assert set(p.sample) == {"EMP-1", "EMP-2", "EMP-3", "x@y.com"}
    assert profiling.profile_columns(cells.limit(0)).count() == 0


def test_within_file_resolution():
    c = lambda name, score: scoring.Candidate(name, {"name": score}, [])
    a = scoring.Mapping("f", "a", [c("x", 0.9), c("y", 0.2)]).decide()
    b = scoring.Mapping("f", "b", [c("x", 0.95), c("z", 0.1)]).decide()
    scoring.resolve_within_file([a, b])
    assert (a.chosen, a.status, b.chosen) == (None, "unmapped", "x")


def test_alias_offers():
    schema = TargetSchema("e", [Field("mobile", aliases=["cell"])])
    assert offer_aliases(schema, ["Cell", "handy", "fax"], {"handy": {"mobile": 0.8}, "fax": {"mobile": 0.5}, "Cell": {"mobile": 1.0}}) == {"mobile": ["handy"]}
