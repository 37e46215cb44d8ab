"""Null, empty, very long, tied and repeated rows, empty tables, and columns whose names clash, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import decontaminate, host_rules, html_text, licences, line_crf, lm_score, mixing, near_dups, pii, sharding
from quernstone.llm.common import drop_tables, lowest, materialize, number_within

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{i % 97} other{i % 89}" for i in range(60))
LONG = " ".join(f"w{i}" for i in range(60_000))
ROWS = [
    (None, None, None, None, None), (None, WORDS, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", "en", "a", 3), (3, WORDS, "en", "a", 5), (3, WORDS, "en", "a", 5),
    (4, WORDS.upper(), "en", "b", 5), (5, LONG, "en", "b", 9), (6, "Released under the MIT License.\nmail x@y.com or 4111 1111 1111 1111", "en", "b", 7), (7, "einzig\x00 ü ß 𝒳", "de", None, 1),
]
BENCH = [(1, " ".join(WORDS.split()[5:25])), (1, "w17 w18 w19"), (2, None), (None, "einzig"), (3, "")]
N = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def with_clashes(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def test_host_rules(docs, none):
    got = host_rules.judge(with_clashes(docs, "kept", "n_words", "base_failed", "host_ok", "_ok", "_host", "_m_short", "a.b", "mine")).collect()
    assert len(got) == N and all(r.mine == "clash" and r.host_ok == "clash" for r in got)
    empty = [r for r in got if not (r.text or "").split()]
    assert empty and all(r.n_words == 0 and r.base_failed and not r.kept for r in empty)
    assert host_rules.judge(none).count() == 0


def test_shards(docs, none, spark):
    got = sharding.shard_texts(with_clashes(docs, "size", "shard", "slot", "_group", "_class", "_b", "mine"), 4).collect()
    assert len(got) == N and {r.mine for r in got} == {"clash"}
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert {r["size"] for r in got if r.doc_id == 1} == {1} and {r.shard for r in got if r["size"] == 1} != set()
    assert len({r.shard for r in got if r.text_crc32 == 0}) == 1  # null and empty are one group
    assert sharding.shard_texts(none, 4).count() == 0
    same = spark.createDataFrame([(i, "x") for i in range(9)], "doc_id long, text string")
    assert {r.shard for r in sharding.shard_texts(same, 4).collect()} == {0}
    assert sorted(r.slot for r in sharding.shard_texts(same, 4).collect()) == list(range(9))


def test_mix(docs, none):
    got = mixing.mix(with_clashes(docs, "copies", "target", "source_size", "_passes", "_s", "_r", "mine"), mixing.word_count()).collect()
    assert len(got) == N and all(0 <= r.copies <= 2 and r.mine == "clash" for r in got)
    assert all(r.copies == 0 for r in got if r["size"] == 0)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r["size"] for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert mixing.mix(none, mixing.word_count()).count() == 0


def test_pii(docs, none):
    got = pii.find_pii(with_clashes(docs, "spans", "n_card", "_x", "mine")).collect()
    assert len(got) == N and sum(r.n_email for r in got) == 1 and sum(r.n_card for r in got) == 1
    assert all(r.spans == "" for r in got if r.doc_id in (1, 2))
    assert pii.find_pii(none).count() == 0


def test_licences(docs, none):
    got = licences.scan_licences(with_clashes(docs, "families", "licence", "_th", "_id", "_copies", "mine")).collect()
    assert len(got) == N and [(r.licence, r.n_licences) for r in got if r.doc_id == 6] == [("mit", 1)]
    assert all(r.n_licences == 0 and r.licence is None and r.families == "" for r in got if r.doc_id != 6)
    assert licences.scan_licences(none).count() == 0


def test_decontaminate(docs, none, bench):
    got = decontaminate.contamination(with_clashes(docs, "n_hit", "contaminated", "_th", "_id", "_h", "_hit", "mine"), bench).collect()
    assert len(got) == N
    assert {r["_th"] for r in got} == {"clash"}
    hit = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got if r.contaminated}
    assert hit == {(None, 120, 20, 1), (3, 120, 20, 1), (4, 120, 20, 1), (5, 60_000, 3, 1), (7, 3, 1, 1)}
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {None, 1, 2, 6}


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (6, 0), (99, 1), (7, None)], "doc_id long, quality int")
    got = line_crf.score_quality(with_clashes(docs, "score", "_x", "mine"), line_crf.fit_field(docs, labels)).collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got)
    flat = line_crf.fit_field(none, labels)
    assert line_crf.score_quality(none, flat).count() == 0
    assert {r.score for r in line_crf.score_quality(docs, flat).collect()} == {0.5}


def test_lm(docs, none):
    marked = docs.withColumn("held_out", F.col("doc_id") == 5)
    got = lm_score.score_documents(with_clashes(marked, "score", "n_tokens", "_row", "_words", "_k", "mine")).collect()
    assert len(got) == N and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert {r.n_known for r in got if r.doc_id == 5} == {1}  # none of its words is in training, only the end
    assert {r.train_tokens for r in got} == {sum(len((r[1] or "").encode().lower().split()) + 1 for r in ROWS if r[0] not in (5, None))}
    assert lm_score.score_documents(none.withColumn("held_out", F.lit(False))).count() == 0


def test_near_dups(docs, none):
    got = near_dups.classes(with_clashes(docs, "class_id", "_digest", "_bands", "_comp", "mine")).collect()
    assert len(got) == N
    assert {r.class_id for r in got if r.doc_id in (3, 4) or (r.doc_id is None and r.text)} == {3}
    assert {r.class_id for r in got if not (r.text or "").strip()} == {1}
    assert {r.class_id for r in got if r.doc_id in (5, 6, 7)} == {5, 6, 7}
    assert sorted(r.doc_id for r in near_dups.keep_one(docs).collect()) == [1, 3, 5, 6, 7]
    assert near_dups.classes(none).count() == 0 and near_dups.keep_one(none).count() == 0


def test_html(spark):
    rows = [(1, None, "clash"), (2, "", "clash"), (3, "<p>one", "clash"), (3, "<p>one", "clash"), (4, "<div" * 500 + ">" * 3, "clash"), (5, "<p>" + "a b " * 100_000, "clash")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, n_chars string")).collect()
    assert [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0] and [r.text for r in got if r.page_id == 3] == ["one", "one"]
    assert [r.n_chars for r in got if r.page_id == 5] == [399_999]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_stages(spark, docs, none, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, none):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, str(tmp_path))
            if name != "sharding":
                assert kept.columns == start.columns
                assert kept.count() <= 2 * start.count()
        assert kept.count() <= 2 * start.count()


def test_helpers(spark):
    df = spark.range(1000).withColumn("k", F.lit(1))
    assert sorted(r.at for r in number_within(df, ["k"], ["id"], "at", buckets=7).collect()) == list(range(1000))
    few = {r.id for r in lowest(spark.range(5000), F.xxhash64("id"), 50).collect()}
    every = sorted(spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")).collect(), key=lambda r: r.h)
    assert few == {r.id for r in every[:50]}


def test_drop_tables(spark):
    drop_tables(spark)
    made = materialize(spark.range(3), "test")
    assert made.count() == 3 and drop_tables(spark) == 1 and drop_tables(spark) == 0
