"""Recorded replies: keys, states, votes, and a run that takes them."""

import hashlib
import json
from types import SimpleNamespace

from quernstone.operators import replies
from quernstone.plans import migrate
from quernstone.plans.queries import set_checkpoints
from quernstone.schema import read_schema
from quernstone.sources import files

FIELDS = ["code", "city"]
CALL = {"provider": "p", "model": "m", "prompt_version": "v", "latency_ms": 7, "input_tokens": 1, "output_tokens": 2, "cached": False}


def key_of(*parts):
    return hashlib.sha256(json.dumps(list(parts), sort_keys=True).encode()).hexdigest()[:32]


def asked(spark, rows):
    return spark.createDataFrame(rows, replies.REQUEST)


def store_of(spark, tmp_path, held):
    for key, payload in held.items():
        (tmp_path / f"{key}.json").write_text(json.dumps({"payload": payload, "call": CALL}, indent=2))
    return replies.read_store(spark, [str(tmp_path)])


def vote(field, share, reason="r"):
    return {"target_field": field, "vote": share, "reason": reason}


def test_keys_are_of_ascii_json(spark):
    texts = ["", "plain", 'a "quoted" \\ text', "line\nend\r\ttab", "é ü 中文", "emoji 😀 and \x7f \x00 \x1b \b\f", " edge "]
    rows = [("f", "c", "m", "v1", "MappingVote", a, b) for a in texts for b in texts]
    got = asked(spark, rows).withColumn("k", replies.request_key("model", "version", "kind", "system", "user")).collect()
    assert len(got) == 49
    assert all(r.k == key_of("m", "v1", "MappingVote", r.system, r.user) for r in got)
    empty = asked(spark, [("f", "c", None, "v1", "MappingVote", None, "u")]).select(replies.request_key(*(replies.F.col(c) for c in ("model", "version", "kind", "system", "user")))).first()[0]
    assert empty == key_of("", "v1", "MappingVote", "", "u")


def test_states_and_votes(spark, tmp_path):
    bad = {"no_reason": {"source_column": "A", "votes": [{"target_field": "code", "vote": 0.5}]}, "above": {"source_column": "A", "votes": [vote("code", 1.5)]}, "text": {"source_column": "A", "votes": [vote("code", "high")]}, "many": {"source_column": "A", "votes": [vote("code", 0.5)] * 6}, "none": None}
    good = {"A": {"source_column": "A", "votes": [vote("code", 0.9), vote("invented", 1.0), vote("code", 0.4), vote("city", 0.2)]}, "empty": {"source_column": "E", "votes": []}}
    key = lambda u: key_of("m", "v1", "MappingVote", "s", u)
    store = store_of(spark, tmp_path, {key(u): p for u, p in (bad | good).items()})
    requests = asked(spark, [("f", u, "m", "v1", "MappingVote", "s", u) for u in [*bad, *good, "unheard", "unheard"]])
    got = replies.replay(requests, store)
    states = {r.column: r.state for r in got.collect()}
    assert states == {**dict.fromkeys(bad, "invalid"), **dict.fromkeys(good, "replayed"), "unheard": "missing"}
    assert {(r.column, r.field, r.vote) for r in replies.column_votes(got, FIELDS).collect()} == {("A", "code", 0.4), ("A", "city", 0.2)}
    assert [tuple(r) for r in replies.rejected_names(got, FIELDS).collect()] == [("f", "A", "invented")]
    assert sorted(r.user for r in replies.to_record(got).collect()) == sorted([*bad, "unheard"])
    assert all(r.call.cached and r.call.latency_ms == 7 for r in got.where("state = 'replayed'").collect())
    assert replies.replay(requests.limit(0), store).count() == 0 and replies.replay(requests, store.limit(0)).where("state = 'missing'").count() == 9


def test_whole_files(spark, tmp_path):
    place = lambda c, f, s, other=None: {"source_column": c, "target_field": f, "confidence": s, "runner_up": other, "reason": "r"}
    payload = {"assignments": [place("A", "code", 0.9, "city"), place("A", "nonsense", 0.8), place("B", None, 0.3, "city"), place("B", "city", 0.7, "city"), place("C", "nonsense", 0.9, "made up"), place("ghost", "code", 1.0), place("D", "code", 0.33333, "city")]}
    store = store_of(spark, tmp_path, {key_of("m", "w", "FileAssignment", "s", "u"): payload})
    got = replies.replay(asked(spark, [("f", None, "m", "w", "FileAssignment", "s", "u")]), store)
    columns = spark.createDataFrame([("f", c) for c in "ABCDD"] + [("other", "ghost")], "file string, column string")
    votes = {(r.column, r.field): r.vote for r in replies.file_votes(got, columns, FIELDS).collect()}
    assert votes == {("A", "code"): 0.9, ("A", "city"): 0.1, ("B", "city"): 0.7, ("D", "code"): 0.33333, ("D", "city"): 0.3333}


def test_investigations(spark, tmp_path):
    store = store_of(spark, tmp_path, {key_of("m", "i/investigate", "Finding", "s", u): {"settled": u == "yes", "suggestion": "X1", "conclusion": "c"} for u in ("yes", "no")})
    got = replies.replay(asked(spark, [("f", u, "m", "i/investigate", "Finding", "s", u) for u in ("yes", "no")]), store)
    assert {(r.column, r.settled, r.suggestion) for r in replies.findings(got, "column").collect()} == {("yes", True, "X1"), ("no", False, None)}


def test_a_run_takes_recorded_votes(spark, tmp_path):
    """A header that says nothing is mapped with a recorded vote, and stays open without one."""
    set_checkpoints(spark)
    path = tmp_path / "people.csv"
    path.write_text("q7,town\n" + "".join(f"EMP-{i:04d},Rome\n" for i in range(1, 31)))
    schema = read_schema({"entity": "person", "fields": [{"name": "code", "required": True, "unique": True, "pattern": "EMP-[0-9]{4}"}, {"name": "city", "aliases": ["town"]}]})
    records, lookups = files.split_records(files.read_records(spark, [str(path)]))
    profiles = migrate.gather(records, lookups, schema).profiles
    requests = replies.column_requests(spark, profiles, schema, "m", "v1", "Fields:\n{schema}", "Column:\n{profile}")
    file = profiles[0].file
    held = {r.column: key_of("m", "v1", "MappingVote", r.system, r.user) for r in requests.collect()}
    assert "EMP-" not in requests.where("column = 'town'").first().user and all("Rome" not in r.system for r in requests.collect())
    (tmp_path / "store").mkdir()
    store = store_of(spark, tmp_path / "store", {held["q7"]: {"source_column": "q7", "votes": [vote("code", 1.0), vote("payroll", 1.0)]}})
    source = replies.vote_source(replies.column_votes(replies.replay(requests, store), ["code", "city"]))
    assert source(file, profiles, schema) == {"q7": {"code": 1.0}}
    score = lambda votes: {m.column: {c.field: c.score for c in m.candidates} for m in migrate.map_columns(migrate.gather(records, lookups, schema, votes), schema, migrate.Overrides())[0]}
    with_vote, without = score(source), score(None)
    assert with_vote["q7"]["code"] > without["q7"]["code"] and with_vote["town"] == without["town"]
    by_name = replies.vote_source(replies.opinions(store, ["code", "city"]))
    assert by_name("any file", [SimpleNamespace(column="q7"), SimpleNamespace(column="town")], schema) == {"q7": {"code": 1.0}}
    whole = replies.file_requests(spark, profiles, schema, "m", "w1", "{schema}", "{file}: {columns}").collect()
    assert len(whole) == 1 and whole[0].user.index("q7") < whole[0].user.index("town")
