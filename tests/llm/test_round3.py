"""Turn repair, filter audit and one-bit codes: brute force, both ways of long conversations, and edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import bit_codes, filter_audit, turn_repair
from quernstone.llm.turn_repair import BLANK, CUT, DUPLICATE, NONE, START, audit_of, best_path, matrix, ranked, search

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def least(turns):
    """(cost, audit) by sweeping the turns: the least pair of each state, inserts in any number."""
    def closed(ways):
        while True:
            more = dict(ways)
            for s, (c, a) in ways.items():
                t = "a" if s == "u" else "u"
                more[t] = min(more.get(t, (c + 2, a + "I")), (c + 2, a + "I"))
            if more == ways:
                return ways
            ways = more

    ways = closed({"": (0, "")})
    for initial, fault in turns:
        after = {}

        def put(s, way):
            after[s] = min(after.get(s, way), way)

        for s, (c, a) in ways.items():
            put(s, (c + 3, a + "D"))
            if fault in (NONE, CUT):
                cut = fault == CUT
                if initial in NEXT[s]:
                    put(NEXT[s][initial], (c + cut, a + "K"))
                put("a" if s == "u" else "u", (c + cut + 2, a + "R"))
        ways = closed(after)
    return min(w for s, w in ways.items() if s in ("", "a"))


def test_search_is_least():
    rng = random.Random(3)
    for n in range(7):
        for _ in range(300):
            turns = [(rng.choice("suaxu"), rng.choice([NONE, NONE, NONE, BLANK, DUPLICATE, CUT])) for _ in range(n)]
            (found,) = search(turns, START, True).values()
            assert found == least(turns), turns


def test_chunks_compose():
    rng = random.Random(4)
    for _ in range(200):
        turns = [(rng.choice("uauasx"), rng.choice([NONE, NONE, NONE, BLANK, DUPLICATE, CUT])) for _ in range(rng.randrange(1, 40))]
        chunks = [matrix(turns[i : i + 4]) for i in range(0, len(turns), 4)]
        path = best_path([{s: ranked(e) for s, e in c.items()} for c in chunks])
        audit = "".join(c[s][e][1] for c, (s, e) in zip(chunks, path)) + "I" * turn_repair.CLOSING[path[-1][1]]
        assert audit == least(turns)[1]
    long = [(rng.choice("uauas"), rng.choice([NONE, NONE, BLANK, CUT])) for _ in range(3000)]
    assert "".join(audit_of(long)) == least(long)[1]


TURNS = "conv_id long, turn long, role string, text string"


def long_rows():
    rng = random.Random(6)
    rows = [(7, rng.choice([None, *range(900)]), rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes.", "", f"so {rng.random()}", f"and {rng.random()}!"])) for _ in range(1500)]
    return rows + [(7, 5, "user", "same text.")] * 700 + [(None, i, "user" if i % 2 == 0 else "assistant", f"Turn {i // 3}.") for i in range(800)] + [(8, 1, "user", "Hi?"), (8, 2, "assistant", "Ho.")]


def test_long_conversations_as_short_ones(spark):
    turns = spark.createDataFrame(long_rows(), TURNS)
    short = {r.conv_id: r for r in turn_repair.reports(turn_repair.edits(turns)).collect()}
    parts = turn_repair.reports(turn_repair.edits(turns, long_turns=500))
    assert {r.conv_id: r for r in parts.collect()} == short and set(short) == {7, None, 8}
    assert short[8].audit == "KK" and short[7].duplicate >= 699


def test_turn_edges(spark):
    rows = [(None, None, None, None), (1, 1, "user", "A?"), (1, 1, "user", "A?"), (1, 2, "assistant", " \t\n"), (2, None, "assistant", "x"), (2, 3, "", "Y."), (3, 1, "system", "Only.")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("cost", F.lit("clash")).withColumn("_c", F.lit(1)).withColumn("_fault", F.lit(1))
    got = {r.conv_id: r for r in turn_repair.reports(turn_repair.edits(turns)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[None].blank, got[None].audit, got[None].cost, got[None].repaired_sha256, got[None].gaps) == (1, "D", 3, empty, 0)
    assert (got[1].duplicate, got[1].blank, got[1].illegal, got[1].audit, got[1].cost) == (1, 1, 1, "KDDI", 8)
    assert (got[2].truncated, got[2].illegal, got[2].audit, got[2].cost, got[2].gaps) == (1, 1, least([("a", CUT), ("", NONE)])[1], least([("a", CUT), ("", NONE)])[0], 0)
    assert (got[3].audit, got[3].cost) == ("D", 3)
    gone = turn_repair.reports(turn_repair.edits(turns, F.lit(0))).collect()
    assert {r.conv_id for r in gone} == {None, 1, 2, 3} and all((r.audit, r.cost, r.gaps, r.repaired_sha256) == ("", 0, 0, empty) for r in gone)
    assert turn_repair.reports(turn_repair.edits(turns.limit(0))).count() == 0


def brute_audit(docs, labels):
    marks = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        marks[i][0] |= q == 1
        marks[i][1] |= t == 1
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = text.encode().split()
        own = {"A": len(words) < 200, "B": len(set(words)) * 100 < len(words) * 50, "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
               "D": any(c in "#$%&*|" for c in text), "E": i is not None and first[text] < i}
        fails[lang or ""].append(({k for k, v in own.items() if v}, *(marks[i] if i is not None else (False, False))))
    out = set()
    for part, rows in fails.items():
        gone, steps = defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in rows if f in r[0] and not r[0] & before]
                gone[f] += len(here)
                steps.append((part, "".join(order), k + 1, sum(not r[0] & {*before, f} for r in rows), len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)))
        out |= {(*s, gone[s[1][s[2] - 1]]) for s in steps}
    return out


def test_filter_audit(spark):
    long = " ".join(f"w{i}" for i in range(210))
    docs = [(None, None, None), (None, "", "en"), (1, long, "en"), (2, long, "en"), (2, long, "de"), (3, long + " #", "en"), (4, long.upper(), "de"), (5, "", None), (6, "a b " * 150, "en"), (7, long, None), (7, long, None)]
    docs += [(100 + i, "copy " * 40, "en") for i in range(50)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, 1, 1), (None, 1, 1), (105, 1, 1), (6, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("A", F.lit(True)).withColumn("_d", F.lit(1)).withColumn("n", F.lit(7))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(3))
    got = filter_audit.filter_steps(filter_audit.failure_cells(frame, marks)).collect()
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == 3 * 600 and {tuple(r[x] for x in names) for r in got} == brute_audit(docs, labels)
    assert filter_audit.filter_steps(filter_audit.failure_cells(frame.limit(0), marks)).count() == 0
    assert filter_audit.filter_steps(filter_audit.failure_cells(frame, marks.limit(0))).where("good_lost > 0").count() == 0


def nearest(rows, n=20):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = []
    for k, (i, v) in enumerate(usable):
        if i % 20 == 0:
            best = sorted((-float(bit_codes.exact(v, w[None])[0]), j) for m, (j, w) in enumerate(usable) if m != k and len(w) == len(v))[:n]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("length", [3, 64, 100])
def test_bit_codes(spark, length):
    rng = np.random.default_rng(length)
    base = rng.standard_normal((900, length)) * rng.lognormal(0, 1.0, (900, 1))
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in enumerate(base)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(20, rows[3][1]), (None, rows[1][1]), (40, None), (60, [0.0] * length), (80, [None] + [1.0] * (length - 1)), (100, [float("nan")] * length), (120, [float("inf")] * length), (140, [1.0] * (length + 1)), (160, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("_row", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in bit_codes.nearest_by_codes(frame, lambda i: i % 20 == 0).collect())
    want = nearest(rows)
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.99 * len(want)
    assert [g[3] for g in got if g[0] == 0][:20] == [w[3] for w in want if w[0] == 0][:20]  # ties of copies, in order of their ids
    assert bit_codes.nearest_by_codes(frame.limit(0), lambda i: i % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors, queries = rng.standard_normal((4000, 64)), bit_codes.unit(rng.standard_normal((20, 64)))[0]
    codes, factors, norms = bit_codes.encode(vectors)
    assert np.allclose(norms, np.linalg.norm(vectors, axis=1)) and codes.dtype == np.uint64 and codes.shape == (4000, 4)
    scale, off = bit_codes.corrections(factors, norms, 256)
    guess, true = (queries @ bit_codes.rotation(64)) @ bit_codes.signs_of(codes).T * scale, queries @ vectors.T
    assert np.corrcoef(guess.ravel(), true.ravel())[0, 1] > 0.95
    assert 0 < (np.abs(guess - true) > off).sum() < 0.005 * true.size


def test_damage_follows_the_checksum(spark):
    got = {r.conv_id: r for r in turn_repair.op11_turn_repair(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    held = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        harm = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if harm == 1 else r.text.translate(str.maketrans("", "", ".!?")) if harm == 2 else r.text
        held[r.conv_id] += [("user" if harm == 4 else r.role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    assert set(got) == set(held)
    for conv, turns in held.items():
        seen, faults = set(), []
        for t in turns:
            bare = t[1].strip(" \t\n\r\x0b\x0c")
            faults.append(BLANK if not bare else DUPLICATE if t in seen else NONE if bare[-1] in ".!?" else CUT)
            seen.add(t)
        assert (got[conv].cost, got[conv].audit) == least([(t[0][:1], f) for t, f in zip(turns, faults)])
        assert (got[conv].blank, got[conv].duplicate, got[conv].truncated) == tuple(faults.count(x) for x in (BLANK, DUPLICATE, CUT))
