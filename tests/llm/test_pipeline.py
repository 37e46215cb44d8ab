"""Every stage of the pipeline against plain Python, on the rows that the stage before kept."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from quernstone.llm import host_rules, near_dups
from quernstone.llm.common import materialize, read_table
from quernstone.llm.shingles import normal, shingles

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs, out = read_table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), "test")
        out[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()], before)
    return out


def test_names_and_columns(stages):
    assert list(stages) == ["quality rules", "near-dedup", "benchmark decontamination", "mixing", "sharding"]
    for name, (before, after, _) in stages.items():
        if name != "sharding":
            assert set(after[0]) == set(before[0])


def test_quality(stages):
    before, after, _ = stages["quality rules"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {i for i, keep in con.sql(f"SELECT doc_id, kept FROM ({host_rules.ORACLE_SQL})").fetchall() if keep}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want) and 0 < len(want) < len(before)


def test_near_dedup(stages):
    before, after, frame = stages["near-dedup"]
    before = sorted(before, key=lambda r: r["doc_id"])
    idf = near_dups.inverse_frequencies(frame)
    own = [near_dups.weights(h, idf) for h in shingles([normal(r["text"]) for r in before])]
    parent = list(range(len(before)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(before)):
        for b in range(a):
            if near_dups.similarity(own[a], own[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(r["doc_id"] for r in after) == [r["doc_id"] for i, r in enumerate(before) if root(i) == i]


def test_decontamination(stages):
    before, after, _ = stages["benchmark decontamination"]
    grams = set()
    for (text,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        w = WORD.findall((text or "").encode().lower())
        grams |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}

    def dirty(text):
        w = WORD.findall((text or "").encode().lower())
        return any(tuple(w[i:i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not dirty(r["text"]))


def test_mixing(stages):
    before, after, _ = stages["mixing"]
    taken = Counter(r["doc_id"] for r in after)
    assert set(taken) <= {r["doc_id"] for r in before} and max(taken.values()) <= 2
    words = {r["doc_id"]: len(r["text"].encode().split()) for r in before}
    total, mixed = sum(words.values()), sum(words[i] * n for i, n in taken.items())
    assert abs(mixed - 1.5 * total) < 0.05 * total


def test_sharding(stages):
    before, after, _ = stages["sharding"]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    crc = {r["doc_id"]: (zlib.crc32(r["text"].encode()), len(r["text"].encode()) + 1) for r in before}
    shards = defaultdict(list)
    for r in after:
        assert (r["text_crc32"], r["size"]) == crc[r["doc_id"]]
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    one = defaultdict(set)
    for r in after:
        one[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in one.values())


def test_reruns_agree(spark):
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == second
